"""Text, number and rule expressions. All are native columns; nothing here runs Python on executors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java's \\s with Unicode classes, so that no-break spaces count as white space.
SPACE = r"(?U)\s+"


def clean(c: Column) -> Column:
    """White space (no-break spaces too) squeezed and trimmed; null: ''."""
    return F.coalesce(F.trim(F.regexp_replace(c, SPACE, " ")), F.lit(""))


def term_key(c: Column) -> Column:
    """Key of a vocabulary term: cleaned and lower-cased."""
    return F.lower(clean(c))


def match_key(c: Column) -> Column:
    """Key of a symbol: trimmed and lower-cased; inner white space stays."""
    return F.lower(F.trim(c))


def filled(c: Column) -> Column:
    """The trimmed text, or null where it is blank."""
    return F.nullif(F.trim(c), F.lit(""))


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*(filled(c) for c in columns))


def slug(c: Column) -> Column:
    """Runs of non-word characters to '_', none at the ends, upper case."""
    return F.upper(F.regexp_replace(F.regexp_replace(c, r"(?U)[^\w]+", "_"), "^_+|_+$", ""))


def measure_key(c: Column) -> Column:
    """ASCII key of a measured quantity: Greek beta spelled out, parentheses opened; nothing left: 'unknown'."""
    text = F.replace(F.replace(F.replace(F.lower(c), F.lit("β"), F.lit("beta")), F.lit("("), F.lit("_")), F.lit(")"), F.lit(""))
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(text, "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit("unknown"))


def core_part(c: Column) -> Column:
    """'core' of 'core (qualifier)'."""
    return F.trim(F.regexp_extract(F.trim(c), r"^(.*?)(?:\s*\((.+)\))?$", 1))


def qualifier(c: Column) -> Column:
    """'qualifier' of 'core (qualifier)', or null."""
    return F.nullif(F.trim(F.regexp_extract(F.trim(c), r"^(.*?)(?:\s*\((.+)\))?$", 2)), F.lit(""))


def tolerant_int(c: Column) -> Column:
    return F.when(F.trim(c).rlike(r"^[+-]?\d{1,18}$"), F.trim(c)).cast("long")


def tolerant_double(c: Column) -> Column:
    """A leading '<' is dropped; blank, '-' and anything else that isn't a plain number are null."""
    text = F.trim(F.regexp_replace(F.trim(c), "^<", ""))
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text).try_cast("double")


def packed_list(c: Column, delimiters: str = "|,") -> Column:
    """The trimmed parts between any of the delimiters that aren't blank."""
    parts = F.transform(F.split(c, f"[{delimiters}]"), lambda x: F.trim(x))
    return F.coalesce(F.filter(parts, lambda x: x != ""), F.array().cast("array<string>"))


def pack(*columns: Column, delimiter: str = "|") -> Column:
    """The filled ones of the columns, joined."""
    return F.concat_ws(delimiter, *(filled(c) for c in columns))


def curie(iri: Column) -> Column:
    """Last segment of an address, its first '_' as ':'."""
    return F.regexp_replace(last_segment(iri), "^([^_]*)_", "$1:")


def last_segment(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def absolute_url(base: str, href: Column) -> Column:
    return F.when(href.startswith("/"), F.concat(F.lit(base), href)).otherwise(href)


def mentions(c: Column, words: Sequence[str]) -> Column:
    """Whether any of the words occurs in the text, as a substring; null: no."""
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.coalesce(c, F.lit("")), w))


def hits(c: Column, words: Sequence[str]) -> Column:
    """How many of the words occur in the text."""
    return F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.coalesce(c, F.lit("")), w)))


def by_rules(rules: Sequence[tuple[Column, str | None]], otherwise: str | None) -> Column:
    """The value of the first rule that holds."""
    result = F.lit(otherwise).cast("string")
    for condition, value in reversed(rules):
        result = F.when(condition, F.lit(value)).otherwise(result)
    return result


def analyte_class(c: Column) -> Column:
    name = F.lower(c)
    return by_rules(
        [
            (mentions(name, ["abeta", "aβ", "amyloid"]), "amyloid"),
            (mentions(name, ["tau"]), "tau"),
            (mentions(name, ["nfl", "neurofilament", "nf-l"]), "neurodegeneration"),
            (mentions(name, ["gfap", "mcp", "s100", "trem", "ykl"]), "inflammation"),
        ],
        "other",
    )


def effect_direction(effect: Column) -> Column:
    """Above, below or at 1; null and NaN are neither above nor below."""
    fine = effect.isNotNull() & ~F.isnan(effect)
    return by_rules([(fine & (effect > 1), "increased"), (fine & (effect < 1), "decreased")], "no_change")


def direction(c: Column) -> Column:
    s = F.lower(F.trim(c))
    return F.when(
        filled(c).isNotNull(),
        F.coalesce(
            by_rules(
                [
                    (mentions(s, ["increase", "higher"]) | s.isin("up", "upregulated"), "increased"),
                    (mentions(s, ["decrease", "lower"]) | s.isin("down", "downregulated"), "decreased"),
                    (F.contains(s, F.lit("no")) & F.contains(s, F.lit("change")), "no_change"),
                ],
                None,
            ),
            s,
        ),
    ).otherwise("unknown")


def fluid_bucket(c: Column) -> Column:
    s = F.lower(c)
    return by_rules([(mentions(s, ["csf"]), "CSF"), (mentions(s, ["plasma", "serum"]), "Plasma/Serum")], "Other/unspecified")


def development_bucket(status: Column, trial: Column, phase: Column, has_phase3: Column) -> Column:
    """One of six buckets; phase may be any text."""
    trial, value = F.coalesce(F.lower(trial), F.lit("")), tolerant_double(phase.cast("string"))
    ongoing = mentions(trial, ["ongoing", "recruiting"])
    return by_rules(
        [
            (mentions(F.lower(status), ["approved"]), "Approved or marketed"),
            (F.lower(has_phase3.cast("string")).eqNullSafe(F.lit("true")), "Phase 3 trials"),
            (F.coalesce(value >= 3, F.lit(False)), "Phase 3 trials"),
            (ongoing & F.coalesce(value > 0, F.lit(False)), "Ongoing Phase 1–2 trials"),
            (ongoing, "Ongoing (phase unknown)"),
            (mentions(trial, ["discontinue", "terminated", "halted"]), "Discontinued or terminated"),
        ],
        "Status unclear / other",
    )


def phase_max(status: Column) -> Column:
    """The largest digit behind the word 'phase', or null."""
    return F.array_max(F.transform(F.regexp_extract_all(F.lower(status), F.lit(r"phase\s*(\d)"), 1), lambda x: x.cast("int")))


def phase_status(status: Column) -> Column:
    text = F.lower(status)
    rules = [
        (filled(status).isNull(), None),
        (mentions(text, ["approved"]), "approved"),
        (mentions(text, ["discontinued", "terminated", "halted", "suspended"]), "discontinued"),
        (phase_max(status).isNotNull(), "ongoing"),
    ]
    return by_rules(rules, "unknown")


def action_type(therapy: Column) -> Column:
    t = F.lower(therapy)
    return by_rules(
        [
            (mentions(t, ["immunotherapy"]), "antibody"),
            (mentions(t, ["dna/rna", "rna"]), "gene_therapy"),
            (mentions(t, ["small molecule"]), "small_molecule"),
            (mentions(t, ["dietary", "supplement"]), "supplement"),
            (mentions(t, ["procedural", "device"]), "device_or_procedure"),
        ],
        None,
    )


def without_timeline(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(c, r"\s*\(timeline\)\s*$", "")), F.lit(""))


def summary(c: Column, sentences: int = 2, leading: str | None = None) -> Column:
    """The first sentences of the cleaned text, without a leading word, whatever follows it, with a full stop; nothing: null."""
    text = clean(c)
    if leading:
        text = F.regexp_replace(text, f"^(?i:{leading})\\s*", "")
    parts = F.filter(F.transform(F.split(text, r"\.(\s+|$)"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) > 0, F.concat(F.array_join(F.slice(parts, 1, sentences), ". "), F.lit(".")))
