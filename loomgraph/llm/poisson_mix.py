"""Mixing sources to target weights by Poisson replication.

A source's rate is the number of times that each of its documents is to occur on average: target weight x epochs x
bytes of all / bytes of the source. A document's count inverts the Poisson distribution with that mean at a uniform
number that its doc_id and the seed fix, so a rerun, or a run over other partitions, makes the same choice. Each
document is exploded by its count. Every copy has a random key, the hash of (seed, doc_id, copy); copies are dealt to
partitions by it and sorted by it there: a global shuffle that nothing has to be sampled for.

Weights are a mapping of source to share; by default the shares are the sources' bytes to the power TEMPER, so that a
source with a third of all bytes is held back. A source without a weight gets none and its documents go.
Rates over LIMIT are sums of independent Poisson numbers of equal rates below it, which is the same distribution.

Null sources are a source of their own. Null texts have one byte, as every text has one more byte than its length.
Repeated rows (equal doc_id) get equal counts. An empty table gives an empty result. Extra columns are kept, whatever
their names, but for those named mix_copy, mix_count or mix_key (or with another prefix than mix), which give way.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty, unused

TEMPER, LIMIT, SEED = 0.7, 32.0, 17
#: Up to so many sources (about 40 numbers each) their rates are broadcast; beyond, documents are dealt by source and salt.
FEW_SOURCES, SALTS = 5_000, 64


def source_rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """(mix_source, rate, parts, cdf) for each source: its rate is that of `parts` Poisson numbers with that distribution."""
    sizes = stored(docs.groupBy(F.col("source").alias("mix_source")).agg(F.sum(F.octet_length(text_or_empty()) + 1).cast("double").alias("bytes")), "mix-sizes")
    if weights is None:
        share = F.pow("bytes", F.lit(TEMPER))
    else:
        share = F.lit(0.0)
        for name, weight in weights.items():
            share = F.when(F.col("mix_source").eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(share)
    sizes = sizes.withColumn("share", share)
    total, shares = sizes.agg(F.sum("bytes"), F.sum("share")).first()
    rate = F.col("share") / F.lit(shares or 1.0) * F.lit(float(epochs * (total or 0))) / F.col("bytes")
    rates = sizes.select("mix_source", rate.alias("rate")).withColumn("parts", F.greatest(F.ceil(F.col("rate") / LIMIT), F.lit(1)).cast("int"))
    rates = rates.withColumn("mean", F.col("rate") / F.col("parts"))
    # P(X <= k) for k = 0, 1, ... until nothing is left of a double's precision.
    cdf = F.expr(
        "aggregate(sequence(1, cast(mean + 12 * sqrt(mean) + 30 as int)), named_struct('p', exp(-mean), 'c', array(exp(-mean))),"
        " (s, k) -> named_struct('p', s.p * mean / k, 'c', concat(s.c, array(element_at(s.c, -1) + s.p * mean / k))), s -> s.c)"
    )
    return rates.select("mix_source", "rate", "parts", cdf.alias("cdf"))


def _draw(seed: int) -> str:
    """The i-th uniform number of a document, as uniform() makes it."""
    return f"cast(conv(substring(md5(concat_ws(':', '{seed}', cast(i as string), coalesce(cast(doc_id as string), ''))), 1, 13), 16, 10) as long) / {float(1 << 52)!r}D"


def poisson_mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, epochs: float = 1.0, seed: int = SEED, prefix: str = "mix") -> DataFrame:
    """The columns of docs with mix_copy (from 1), mix_count and mix_key, a row for each copy, in the order of a global shuffle."""
    copy, count, key = (f"{prefix}_{x}" for x in ("copy", "count", "key"))
    docs = docs.drop(copy, count, key)
    source, parts, cdf, salt, row = (unused(f"_{prefix}_{x}", docs) for x in ("source", "parts", "cdf", "salt", "row"))
    rates = stored(source_rates(docs, weights, epochs).select(F.col("mix_source").alias(source), F.col("parts").alias(parts), F.col("cdf").alias(cdf)), "mix-rates")
    if rates.count() <= FEW_SOURCES:
        joined = docs.join(F.broadcast(rates), docs["source"].eqNullSafe(rates[source]))
    else:
        salted = rates.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = docs.withColumn(row, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        joined = dealt.join(salted, dealt["source"].eqNullSafe(salted[source]) & (F.col(row) == F.col(salt)))
    counted = joined.withColumn(count, F.expr(f"aggregate(sequence(1, `{parts}`), 0, (n, i) -> n + size(filter(`{cdf}`, c -> c <= {_draw(seed)})))"))
    copies = counted.filter(F.col(count) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(count))))
    order = F.md5(F.concat_ws(":", F.lit(f"order{seed}"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col(copy).cast("string")))
    return copies.withColumn(key, order).select(*(f"`{c}`" for c in docs.columns), copy, count, key).repartition(key).sortWithinPartitions(key)


ORACLE_SQL = f"""
WITH sizes AS (SELECT source, CAST(sum(strlen(coalesce(text, '')) + 1) AS DOUBLE) AS bytes FROM documents GROUP BY source),
     shares AS (SELECT source, bytes, pow(bytes, {TEMPER}) AS share FROM sizes),
     rates AS (SELECT source, share / (SELECT sum(share) FROM shares) * (SELECT sum(bytes) FROM sizes) / bytes AS rate FROM shares),
     parts AS (SELECT source, rate, greatest(CAST(ceil(rate / {LIMIT}) AS INT), 1) AS parts FROM rates),
     steps AS (SELECT source, parts, k, exp(-rate / parts + k * ln(rate / parts) - lgamma(k + 1)) AS p FROM parts, range(0, 150) AS t(k)),
     cdf AS (SELECT source, parts, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM steps),
     lists AS (SELECT source, parts, list(c ORDER BY k) AS cs FROM cdf GROUP BY source, parts),
     draws AS (SELECT d.doc_id, d.source, list_sum(list_transform(range(1, parts + 1), lambda i: len(list_filter(cs, lambda c: c <= CAST('0x' || substr(md5('{SEED}:' || i || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / {float(1 << 52)!r}))))::INT AS mix_count
               FROM documents d JOIN lists l ON d.source IS NOT DISTINCT FROM l.source)
SELECT doc_id, source, mix_copy, mix_count, md5('order{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || mix_copy) AS mix_key
FROM (SELECT doc_id, source, mix_count, CAST(unnest(range(1, mix_count + 1)) AS INT) AS mix_copy FROM draws)
"""
