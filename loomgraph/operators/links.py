"""Edge tables: semi, equi, multi-key, token-overlap and anchored joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def known_only(rows: DataFrame, key: str, nodes: DataFrame, id_column: str = "id") -> DataFrame:
    """Rows whose key is a node."""
    return rows.join(nodes.select(F.col(id_column).alias("_known")), F.col(key) == F.col("_known"), "left_semi")


def one_to_many(sources: DataFrame, source_key: Column, targets: DataFrame, target_key: Column) -> DataFrame:
    """source_id, target_id: equal normalised symbols; blank ones match nothing."""
    left = sources.select(F.col("id").alias("source_id"), X.match_key(source_key).alias("_key")).filter("_key != ''")
    right = targets.select(F.col("id").alias("target_id"), X.match_key(target_key).alias("_key")).filter("_key != ''")
    return left.join(right, "_key").select("source_id", "target_id")


def multi_key(targets: DataFrame, row: str, name: Column, nodes: DataFrame, symbol: Column, label: Column, synonyms: Column, order: Column) -> DataFrame:
    """row, id: nodes whose symbol (all), label (the last of equal ones) or a synonym (the first) is the name; distinct."""
    keyed = nodes.select("id", X.match_key(symbol).alias("_symbol"), X.match_key(label).alias("_label"), F.transform(synonyms, X.match_key).alias("_synonyms"), order.alias("_order"))
    symbols = keyed.select(F.col("_symbol").alias("_key"), "id")
    labels = keyed.groupBy(F.col("_label").alias("_key")).agg(F.max_by("id", "_order").alias("id"))
    named = keyed.select("id", "_order", F.posexplode("_synonyms").alias("_pos", "_key"))
    firsts = named.groupBy("_key").agg(F.min_by("id", F.struct("_order", "_pos")).alias("id"))
    keys = symbols.unionByName(labels).unionByName(firsts).filter("_key is not null and _key != ''").distinct()
    wanted = targets.select(row, X.match_key(name).alias("_key")).filter("_key != ''").groupBy(row).agg(F.min("_key").alias("_key"), F.max("_key").alias("_last"), F.collect_set("_key").alias("_all"))
    # keys are distinct by id, so a row of one name makes no pair twice: only rows of several names need their pairs compared
    once = wanted.filter("_key = _last").select(row, "_key").join(keys, "_key").select(row, "id")
    several = wanted.filter("_key != _last").select(row, F.explode("_all").alias("_key")).join(keys, "_key").select(row, "id").distinct()
    return once.unionByName(several)


def token_overlap(
    left: DataFrame, left_id: str, left_text: Column, right: DataFrame, right_id: str, right_text: Column,
    separators: str = r"[\s-]+", stop: Sequence[str] = (), block: int = 4096,
) -> DataFrame:
    """left_id, right_id: pairs that share a token, once each. Tokens are joined by equality, so no pair is compared that shares none.

    A pair is made at its rarest common token only, so common tokens bring no pairs that others have brought already. A token
    of more than `block` ids on a side is split there, and the other side's ids go to each of its parts: no task meets more
    than `block` of both.
    """

    def tokens(df: DataFrame, key: str, text: Column) -> DataFrame:
        rows = df.select(F.col(key).alias("id"), F.explode(F.array_distinct(F.split(F.lower(F.trim(text)), separators))).alias("token")).filter("token != ''")
        return (rows.filter(~F.col("token").isin(*stop)) if stop else rows).distinct()

    sides = [tokens(left, left_id, left_text), tokens(right, right_id, right_text)]
    counts = [side.groupBy("token").agg(F.count("*").alias(name)) for side, name in zip(sides, ("n0", "n1"), strict=True)]
    parts = [F.ceil(F.col(n) / block).cast("int").alias(name) for n, name in (("n0", "parts0"), ("n1", "parts1"))]
    shared = counts[0].join(counts[1], "token").select("token", (F.col("n0") * F.col("n1")).alias("pairs"), *parts)

    def dealt(side: DataFrame, own: int, tokens_name: str, id_name: str) -> DataFrame:
        """A row for each token and part of the other side, with all tokens of the id, rarest first."""
        rows = side.join(shared, "token").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pairs", "token", "parts0", "parts1"))).alias("every"))
        rows = rows.select(F.col("id").alias(id_name), F.col("every.token").alias(tokens_name), F.explode("every").alias("one"))
        mine = F.pmod(F.xxhash64(id_name), F.col(f"one.parts{own}")).cast("int").alias(f"part{own}")
        others = F.explode(F.sequence(F.lit(0), F.col(f"one.parts{1 - own}") - 1)).alias(f"part{1 - own}")
        return rows.select(id_name, tokens_name, F.col("one.token").alias("token"), mine, others)

    met = dealt(sides[0], 0, "tokens0", "id0").join(dealt(sides[1], 1, "tokens1", "id1"), ["token", "part0", "part1"])
    rarest = F.get(F.array_intersect("tokens0", "tokens1"), F.lit(0))
    return met.filter(rarest == F.col("token")).select(F.col("id0").alias(left_id), F.col("id1").alias(right_id))


def anchor(nodes: DataFrame, label: str, preferred: str | None = None, source: str = "source") -> DataFrame:
    """The one node whose label contains the text: of the preferred source if there is one, then by id."""
    found = nodes.filter(F.contains(F.lower("label"), F.lit(label.lower())))
    first = F.coalesce(F.col(source) != F.lit(preferred), F.lit(True)) if preferred else F.lit(True)
    return found.orderBy(first, "id").limit(1)


def to_anchor(rows: DataFrame, key: str, one: DataFrame, outward: bool = True) -> DataFrame:
    """source_id, target_id: an edge between the anchor (one row at most) and every row."""
    node = F.broadcast(one.select(F.col("id").alias("_anchor")))
    ends = ("_anchor", key) if outward else (key, "_anchor")
    return rows.crossJoin(node).select(F.col(ends[0]).alias("source_id"), F.col(ends[1]).alias("target_id"), *[c for c in rows.columns if c != key])


def mentioning(rows: DataFrame, text: Column, words: Sequence[str]) -> DataFrame:
    return rows.filter(X.mentions(F.lower(text), words))


def enrich(base: DataFrame, detail: DataFrame, key: str) -> DataFrame:
    """base with the detail's further columns; of several detail rows of a key the smallest counts, so base keeps its rows."""
    more = [c for c in detail.columns if c != key]
    one = detail.groupBy(key).agg(F.min(F.struct(*more)).alias("_more"))
    return base.join(one, key, "left").select(*base.columns, *(F.col(f"_more.{c}").alias(c) for c in more))
