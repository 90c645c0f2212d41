"""Grouped text reports: one aggregation per anchor folds rows into sections of lines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def fold_lines(df: DataFrame, keys: Sequence[str], line: Column, order: Sequence[Column | str], name: str = "text", delimiter: str = "\n") -> DataFrame:
    """Per group the lines in order, joined. A group is one report and becomes one row."""
    rows = df.withColumn("_line", line).withColumn("_order", F.struct(*order))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_order", "_line"))), lambda x: x["_line"])
    return rows.groupBy(*keys).agg(F.array_join(lines, delimiter).alias(name))


def capped(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int | None) -> DataFrame:
    """The first n rows of each group, or all of them (None)."""
    if n is None:
        return df
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def remarks(values: Sequence[tuple[str, Column]]) -> Column:
    """' (a; label: b)' of the values that are filled, or nothing."""
    parts = F.array_compact(F.array(*(F.concat(F.lit(f"{label}: " if label else ""), X.filled(c.cast("string"))) for label, c in values), F.lit(None).cast("string")))
    return F.when(F.size(parts) > 0, F.concat(F.lit(" ("), F.array_join(parts, "; "), F.lit(")"))).otherwise("")


def _first_filled(details: Sequence[tuple[str, Column]], at: Column) -> list[Column]:
    return [F.min_by(X.filled(c.cast("string")), F.when(X.filled(c.cast("string")).isNotNull(), at)).alias(f"_d{k}") for k, (_, c) in enumerate(details)]


def bucketed(df: DataFrame, key: str, bucket: Column, name: Column, details: Sequence[tuple[str, Column]], order: Sequence[str], buckets: Sequence[str], title: str) -> DataFrame:
    """key, text: within each bucket, in the given order of buckets, the distinct names. A name's details are those of its last row, in all buckets."""
    at = F.struct(*order)
    rows = df.select(key, bucket.alias("_bucket"), name.alias("_name"), at.alias("_at"), F.struct(F.lit(0).alias("_"), *(X.filled(c.cast("string")).alias(f"_d{k}") for k, (_, c) in enumerate(details))).alias("_row")).filter("_name is not null")
    last = rows.groupBy(key, "_name").agg(F.max_by("_row", "_at").alias("_row"), F.collect_set("_bucket").alias("_buckets"))
    lines = last.select(key, "_name", F.col("_row.*"), F.explode("_buckets").alias("_bucket"))
    place = F.array_position(F.array(*map(F.lit, buckets)), F.col("_bucket"))
    line = F.concat(F.lit("- "), F.col("_name"), remarks([(label, F.col(f"_d{k}")) for k, (label, _) in enumerate(details)]))
    sections = fold_lines(lines.withColumn("_place", place).filter("_place > 0"), [key, "_place", "_bucket"], line, ["_name"], "_lines")
    body = fold_lines(sections, [key], F.concat(F.col("_bucket"), F.lit(":\n"), F.col("_lines")), ["_place"], "text")
    return body.select(key, F.concat(F.lit(f"{title}\n"), F.col("text")).alias("text"))


def two_level(df: DataFrame, key: str, first: Column, second: Column, name: Column, details: Sequence[tuple[str, Column]], order: Sequence[str], firsts: Sequence[str], seconds: dict[str, str], title: str) -> DataFrame:
    """key, text: in the given orders, the first level's headings, the second level's (by their shown names), and under each the
    distinct names with each detail's first filled value. Rows of other values of either level are left out."""
    rows = df.select("*", first.alias("_first"), second.alias("_second"), name.alias("_name")).filter(F.col("_name").isNotNull() & F.col("_first").isin(*firsts) & F.col("_second").isin(*seconds))
    merged = rows.groupBy(key, "_first", "_second", "_name").agg(F.lit(1).alias("_one"), *_first_filled(details, F.struct(*order)))
    line = F.concat(F.lit("  - "), F.col("_name"), remarks([(label, F.col(f"_d{k}")) for k, (label, _) in enumerate(details)]))
    inner = fold_lines(merged.withColumn("_place", F.array_position(F.array(*map(F.lit, seconds)), F.col("_second"))), [key, "_first", "_place"], line, ["_name"], "_lines")
    shown = F.concat(F.lit("- "), F.get(F.array(*map(F.lit, seconds.values())), (F.col("_place") - 1).cast("int")), F.lit(":\n"), F.col("_lines"))
    outer = fold_lines(inner, [key, "_first"], shown, ["_place"], "_lines")
    body = fold_lines(outer.withColumn("_at", F.array_position(F.array(*map(F.lit, firsts)), F.col("_first"))), [key], F.concat(F.col("_first"), F.lit("\n"), F.col("_lines")), ["_at"], "text", "\n\n")
    return body.select(key, F.concat(F.lit(f"{title}\n"), F.col("text")).alias("text"))


def listed(df: DataFrame, key: str, name: Column, title: str, details: Sequence[tuple[str, Column]] = (), unnamed: Column | None = None) -> DataFrame:
    """key, text: a line for each row with its own details, sorted by name and details; equal lines once. A blank name is replaced by `unnamed`."""
    shown = name if unnamed is None else X.first_filled(name, unnamed.cast("string"))
    lines = df.select(key, shown.alias("_name"), F.struct(F.lit(0).alias("_"), *(X.filled(c.cast("string")).alias(f"_d{k}") for k, (_, c) in enumerate(details))).alias("_row"))
    lines = lines.filter("_name is not null").distinct()
    body = fold_lines(lines, [key], F.concat(F.lit("- "), F.col("_name"), remarks([(label, F.col(f"_row._d{k}")) for k, (label, _) in enumerate(details)])), ["_name", "_row"])
    return body.select(key, F.concat(F.lit(f"{title}\n"), F.col("text")).alias("text"))


def listed_pairs(df: DataFrame, key: str, head: Column, item: Column, title: str, details: Sequence[tuple[str, Column]] = (), order: Sequence[str] = ()) -> DataFrame:
    """key, text: for each head, sorted, its distinct items in the given order (by name if there is none), each with the details of its first row."""
    rows = df.select(key, head.alias("_head"), item.alias("_item"), F.struct(*order, item.alias("_item")).alias("_at"), F.struct(F.lit(0).alias("_"), *(X.filled(c.cast("string")).alias(f"_d{k}") for k, (_, c) in enumerate(details))).alias("_row"))
    pairs = rows.filter("_head is not null and _item is not null").groupBy(key, "_head", "_item").agg(F.min("_at").alias("_at"), F.min_by("_row", "_at").alias("_row")).select(key, "_head", "_item", "_at", "_row.*")
    line = F.concat(F.col("_item"), remarks([(label, F.col(f"_d{k}")) for k, (label, _) in enumerate(details)]))
    lines = fold_lines(pairs, [key, "_head"], line, ["_at"], "_items", ", ")
    body = fold_lines(lines, [key], F.concat(F.lit("- "), F.col("_head"), F.lit(": "), F.col("_items")), ["_head"])
    return body.select(key, F.concat(F.lit(f"{title}\n"), F.col("text")).alias("text"))


def top_preferred(df: DataFrame, key: str, name: Column, preferred: Sequence[str], title: str, k: int = 15) -> DataFrame:
    """key, text: k distinct names, those with a preferred prefix first."""
    first = ~F.exists(F.array(*map(F.lit, preferred)), lambda p: F.startswith(F.col("_name"), p))
    names = capped(df.select(key, name.alias("_name")).filter("_name is not null").distinct().withColumn("_late", first), [key], ["_late", "_name"], k)
    body = fold_lines(names, [key], F.concat(F.lit("- "), F.col("_name")), ["_late", "_name"])
    return body.select(key, F.concat(F.lit(f"{title}\n"), F.col("text")).alias("text"))


def _with_parts(anchors: DataFrame, key: str, parts: Sequence[tuple[DataFrame, str]]) -> tuple[DataFrame, list[Column]]:
    """anchors with the text of every part, each joined once; and the columns to show, with the sentence for anchors without rows."""
    for k, (part, _) in enumerate(parts):
        anchors = anchors.join(part.select(key, F.col("text").alias(f"_text{k}")), key, "left")
    return anchors, [F.coalesce(f"_text{k}", F.lit(sentence)) for k, (_, sentence) in enumerate(parts)]


def framed(anchors: DataFrame, key: str, found: Column, kinds: Mapping[str, tuple[str, Sequence[str]]], parts: Mapping[str, tuple[DataFrame, str]], closing: str, missing: str) -> DataFrame:
    """key, kind, text, anchor_found, a row for each kind of report: its heading with the anchor's id, its parts and a closing rule;
    or the sentence for an anchor that isn't there. kinds: heading and names of parts. A part is built once for all kinds."""
    rows, texts = _with_parts(anchors.select(key, found.alias("anchor_found")), key, list(parts.values()))
    shown = dict(zip(parts, texts, strict=True))
    made = [F.struct(F.lit(kind).alias("kind"), F.concat_ws("\n\n", F.concat(F.lit(f"{heading} "), F.col(key).cast("string")), *(shown[n] for n in names), F.lit(closing)).alias("text")) for kind, (heading, names) in kinds.items()]
    rows = rows.select(key, "anchor_found", F.explode(F.array(*made)).alias("_made"))
    return rows.select(key, "_made.kind", F.when(F.col("anchor_found"), F.col("_made.text")).otherwise(F.lit(missing)).alias("text"), "anchor_found")


def combined(anchors: DataFrame, key: str, parts: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """key, text: the parts' texts below one another; each part has a sentence for anchors without rows."""
    rows, texts = _with_parts(anchors.select(key), key, parts)
    return rows.select(key, F.concat_ws("\n\n", *texts).alias("text"))
