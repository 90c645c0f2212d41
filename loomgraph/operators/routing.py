"""Question routing over a column of questions: scores, intent, ids, strategy, prompt. Works on batches and on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.specs import QUESTIONS, Routing

RULES = "Answer from the context only. Say so where the context does not hold the answer."
MISSING = "The graph has no node for this question's subject, so there is no answer."


def scores(question: Column, spec: Routing = QUESTIONS) -> dict[str, Column]:
    """Per intent how many of its words the lower-cased question contains."""
    q = F.lower(F.coalesce(question, F.lit("")))
    return {intent: X.hits(q, words) for intent, words in spec.keywords.items()}


def question_ids(question: Column, spec: Routing = QUESTIONS) -> Column:
    """The distinct ids in the question, in the order of the patterns."""
    found = [F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(f"({p})"), 1) for p in spec.patterns]
    return F.array_distinct(F.flatten(F.array(*found)))


def classify(df: DataFrame, question: str = "question", spec: Routing = QUESTIONS) -> DataFrame:
    """df with score_<intent>, intent, notes and focus_entities."""
    q = F.lower(F.coalesce(F.col(question), F.lit("")))
    scored = df.withColumns({f"score_{k}": c for k, c in scores(F.col(question), spec).items()})
    names = list(spec.keywords)
    top = F.array_max(F.array(*(F.struct(F.col(f"score_{n}").alias("score"), F.lit(-k).alias("rank"), F.lit(n).alias("name")) for k, n in enumerate(names))))
    general, words, general_note = spec.general
    none, none_note = spec.other
    intent = F.when(top["score"] > 0, top["name"]).when(X.mentions(q, words), F.lit(general)).otherwise(F.lit(none))
    listed = F.concat_ws(", ", *(F.concat(F.lit(f"{n}: "), F.col(f"score_{n}").cast("string")) for n in names))
    note = F.when(top["score"] > 0, F.concat(F.lit("Selected "), top["name"], F.lit(" based on keyword hits: "), listed)).when(X.mentions(q, words), F.lit(general_note)).otherwise(F.lit(none_note))
    result = scored.withColumns({"intent": intent, "notes": note})
    for words, target, needs_score, text in spec.overrides:
        applies = X.mentions(q, words) & (F.col("intent") != target)
        if needs_score:
            applies = applies & (F.col(f"score_{target}") > 0)
        result = result.withColumns({"notes": F.when(applies, F.concat("notes", F.lit(text))).otherwise(F.col("notes")), "intent": F.when(applies, F.lit(target)).otherwise(F.col("intent"))})
    return result.withColumn("focus_entities", question_ids(F.col(question), spec))


def route(classified: DataFrame, reports: DataFrame | None = None, spec: Routing = QUESTIONS) -> DataFrame:
    """With strategy, debug (a map), description and, of a table (strategy, context, anchor_found) of reports, the context."""
    strategy = F.lit(None).cast("string")
    for intent, name in spec.strategies.items():
        strategy = F.when(F.col("intent") == intent, F.lit(name)).otherwise(strategy)
    routed = classified.withColumn("strategy", strategy)
    focus = F.array_join("focus_entities", ", ")
    some = F.size("focus_entities") > 0
    debug = F.map_from_arrays(
        F.concat(F.array(*map(F.lit, ("intent_type", "intent_notes", "strategy"))), F.when(some, F.array(F.lit("focus_entities"))).otherwise(F.array().cast("array<string>"))),
        F.concat(F.array("intent", "notes", "strategy"), F.when(some, F.array(focus)).otherwise(F.array().cast("array<string>"))),
    )
    lines = [F.concat(F.lit("Intent: "), "intent"), F.concat(F.lit("Notes: "), "notes"), F.concat(F.lit("Strategy: "), "strategy"), F.when(some, F.concat(F.lit("Focus entities: "), focus))]
    routed = routed.withColumns({"debug": debug, "description": F.concat_ws("\n", *lines)})
    if reports is not None:  # no more rows than strategies, each a report of capped length
        known = reports.filter(F.col("strategy").isin(*set(spec.strategies.values()))).groupBy("strategy").agg(F.min(F.struct("context", "anchor_found")).alias("_r"))
        routed = routed.join(F.broadcast(known.select("strategy", "_r.context", "_r.anchor_found")), "strategy", "left")
    return routed


def prompts(routed: DataFrame, question: str = "question", rules: str = RULES) -> DataFrame:
    """With prompt and answer: where the anchor is missing the answer is given at once and there is no prompt."""
    found = F.coalesce(F.col("anchor_found"), F.lit(False))
    prompt = F.concat(F.lit(rules), F.lit("\n\nIntent: "), "intent", F.lit("\n\nQuestion: "), F.coalesce(F.col(question), F.lit("")), F.lit("\n\nContext:\n"), F.coalesce("context", F.lit("")))
    return routed.withColumns({"prompt": F.when(found, prompt), "answer": F.when(~found, F.lit(MISSING))})
