"""Texts that contain texts, for whole tables of both: substrings of up to three characters are joined, `contains` verifies.

A text can only lie in a label that holds each of its trigrams, so it is looked up by the one that the fewest labels hold.
A text of up to three characters is itself such a substring. No pair is compared that shares none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3
#: Labels of one substring that are joined in one task; a substring of more is split.
BLOCK = 16_384


def _substrings(text: Column, length: int) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=({'.' * length}))"), F.lit(1))


def gram_index(rows: DataFrame, key: str, texts: Sequence[Column]) -> DataFrame:
    """gram, key: every substring of one to three characters of a row's lower-cased texts, once a key. It may be stored and given to `containing`."""
    lowered = [F.lower(F.coalesce(t.cast("string"), F.lit(""))) for t in texts]
    every = F.flatten(F.array(*(_substrings(t, n) for t in lowered for n in range(1, GRAM + 1))))
    found = rows.filter(F.col(key).isNotNull()).select(F.explode(F.array_distinct(every)).alias("gram"), F.col(key).alias("key"))
    return found.distinct()


def containing(wanted: DataFrame, text: str, rows: DataFrame, key: str, texts: Sequence[Column], index: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """text, key: each distinct lower-cased wanted text with the keys of the rows of which a text contains it, in any case.

    Null and empty wanted texts, and rows with a null key, have no pairs. index: a stored `gram_index` of the same rows.
    """
    index = gram_index(rows, key, texts) if index is None else index
    asked = wanted.select(F.lower(F.col(text).cast("string")).alias("text")).filter("text != ''").distinct()
    short = F.length("text") <= GRAM
    asked = asked.select("text", F.explode(F.array_distinct(F.when(short, F.array("text")).otherwise(_substrings(F.col("text"), GRAM)))).alias("gram"))
    counts = index.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    size = F.coalesce("n", F.lit(0))
    rarest = asked.join(counts, "gram", "left").groupBy("text").agg(F.min(F.struct(size.alias("n"), "gram")).alias("first"))
    blocks = F.ceil(F.col("first.n") / block).cast("int")
    probes = rarest.filter("first.n > 0").select("text", F.col("first.gram").alias("gram"), blocks.alias("blocks"))
    hit = index.join(probes.select("gram", "blocks").distinct(), "gram").select("gram", "key", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("part"))
    probes = probes.select("text", "gram", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"))
    near = probes.join(hit, ["gram", "part"]).select("text", "key")
    held = rows.select(F.col(key).alias("key"), F.array(*(F.lower(t.cast("string")) for t in texts)).alias("held"))
    inside = F.exists("held", lambda t: F.coalesce(F.contains(t, F.col("text")), F.lit(False)))
    return near.join(held, "key").filter(inside).select("text", "key")


def search_texts(nodes: DataFrame, texts: DataFrame, text: str, columns: Sequence[str] = ("label", "synonyms"), fallback: object | None = None, preferred: Column | None = None, index: DataFrame | None = None) -> DataFrame:
    """The rows of texts with node_id, and match: 'search' or 'fallback' (null: no node), which replace columns of these names.

    As `graph.search` for each row: the node whose label or synonyms contain the text, preferred ones (a condition) first, then by id;
    else the fallback id if it is a node's. A null or empty text finds nothing, so it takes the fallback.
    """
    there = [F.col(c) for c in columns if c in nodes.columns]
    late = F.lit(0) if preferred is None else F.when(preferred, 0).when(preferred.isNotNull(), 1).otherwise(2)
    places = nodes.groupBy(F.col("id").alias("key")).agg(F.min(late).alias("late"))
    searched = nodes
    if index is None:  # of nodes with equal texts only the first can be found, so only that one is searched
        held = [f"held{k}" for k in range(len(there))]
        alike = nodes.select(F.col("id").alias("key"), *(F.lower(t.cast("string")).alias(h) for t, h in zip(there, held, strict=True)))
        firsts = alike.join(places, "key").groupBy(*held).agg(F.min(F.struct("late", "key")).alias("first"))
        searched, there = firsts.select(F.col("first.key").alias("id"), *held), [F.col(h) for h in held]
    found = containing(texts, text, searched, "id", there, index)
    best = found.join(places, "key").groupBy(F.col("text").alias("_asked")).agg(F.min_by("key", F.struct("late", "key")).alias("_found"))
    kept = [c for c in texts.columns if c not in ("node_id", "match")]
    out = texts.join(best, F.lower(F.col(text).cast("string")) == F.col("_asked"), "left")
    other = F.lit(None)
    if fallback is not None:
        one = nodes.filter(F.col("id") == F.lit(fallback)).agg(F.max("id").alias("_other"))  # one row, always
        out, other = out.crossJoin(F.broadcast(one)), F.col("_other")
    match = F.when(F.col("_found").isNotNull(), "search").when(other.isNotNull(), "fallback")
    return out.select(*kept, F.coalesce("_found", other).alias("node_id"), match.alias("match"))


def allow_fragments(df: DataFrame, label: Column, fragments: DataFrame, column: str) -> DataFrame:
    """Rows whose label contains one of the table's fragments, in any case. Null and empty fragments allow nothing."""
    labels = df.select(F.lower(label.cast("string")).alias("_label")).filter("_label is not null").distinct()
    allowed = containing(fragments, column, labels, "_label", [F.col("_label")]).select(F.col("key").alias("_allowed"))
    return df.join(allowed, F.lower(label.cast("string")) == F.col("_allowed"), "left_semi")
