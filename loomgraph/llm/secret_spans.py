"""Secret scans: fixed patterns, and sliding-window Shannon entropy per character class over candidate strings.

Fixed patterns (kinds assign, access and hex) are matched leftmost and non-overlapping, each kind by itself; matches
that are too short are dropped. Beyond them, runs of 20 or more characters of [A-Za-z0-9+/_=-] are candidates. A
candidate has the class of all its characters: hex, lower (letters of one case and digits) or mixed; runs of digits
alone or letters alone of one case are none. A window of WINDOW characters moves over it; one character enters and
one leaves, so its entropy follows from the two changed counts. The windows at or above the threshold of the candidate's
class make up spans; so do, by themselves, the windows of letters and digits alone at or above the threshold of their
own class, whatever name or path stands before them, unless they are part of an address. The allow-list suppresses
spans that are addresses, paths, file names or placeholders by what is in the span. Those left, joined, are the
spans of the kind entropy. Windows that overlap a span of a fixed pattern are left to it.

Offsets count code points, ends are exclusive. A null text is an empty text without spans. Texts are scanned whole,
whatever their length, in time that grows with it. Repeated rows get the same spans; an empty table gives an empty result;
extra columns stay in redact_secrets and are left out by find_secrets.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: Bits a character, over a window of 20.
THRESHOLDS = {"hex": 3.1, "lower": 3.6, "mixed": 3.75}
ALLOWED = re.compile(r"://|^/|/[a-z_-]+/|^[A-Za-z]+([-_/][A-Za-z]+)+$|(?i:example|placeholder|changeme|x{6}|0{8}|1234567|abcdef)", re.ASCII)
LEAST = min(THRESHOLDS.values())
SPACE = re.compile(r"\s")
_TERM = [0.0] + [k * math.log2(k) for k in range(1, WINDOW + 2)]


def character_class(run: str) -> str | None:
    digit, lower, upper = (any(a <= c <= b for c in set(run)) for a, b in (("0", "9"), ("a", "z"), ("A", "Z")))
    if not digit or not (lower or upper):
        return None
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", run):
        return "hex"
    return "mixed" if lower and upper else "lower"


def _windows(run: str) -> Iterator[tuple[int, float]]:
    """The end of each window and its entropy."""
    counts: dict[str, int] = {}
    total = 0.0
    for end, entering in enumerate(run, 1):
        n = counts.get(entering, 0)
        counts[entering] = n + 1
        total += _TERM[n + 1] - _TERM[n]
        if end > WINDOW:
            leaving = run[end - WINDOW - 1]
            n = counts[leaving]
            counts[leaving] = n - 1
            total += _TERM[n - 1] - _TERM[n]
        if end >= WINDOW:
            yield end, math.log2(WINDOW) - total / WINDOW + 1e-9


def _merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def high_windows(run: str, threshold: float) -> list[tuple[int, int]]:
    """Where windows of at least that entropy are, merged where they touch."""
    return _merged([(end - WINDOW, end) for end, entropy in _windows(run) if entropy >= threshold])


def _high(run: str, kind: str, start: int, fixed: list[tuple[int, int]], k: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Spans in the run by the threshold of its class, and those of letters and digits by that of each window's.

    fixed: spans of the fixed patterns, in order and apart from one another; the first that may reach into the run is k.
    """
    whole, own = [], []
    for end, entropy in _windows(run):
        while k < len(fixed) and fixed[k][1] <= start + end - WINDOW:
            k += 1
        if entropy < LEAST or k < len(fixed) and fixed[k][0] < start + end:
            continue
        place = (end - WINDOW, end)
        if entropy >= THRESHOLDS[kind]:
            whole.append(place)
        if (part := run[place[0] : end]).isalnum() and (mine := character_class(part)) and entropy >= THRESHOLDS[mine]:
            own.append(place)
    return _merged(whole), _merged(own)


def _in_address(text: str, marks: list[int], at: int) -> bool:
    """Whether at is behind :// (at one of the marks) without a space between."""
    k = bisect.bisect_right(marks, at - len("://"))
    return k > 0 and not SPACE.search(text, marks[k - 1], at)


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end), sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    fixed = _merged([(a, b) for a, _, b in found])
    ends = [b for _, b in fixed]
    marks = [m.start() for m in re.finditer("://", text)]
    for m in CANDIDATE.finditer(text):
        run = m.group()
        if (kind := character_class(run)) is None:
            continue
        around = text[max(0, m.start() - 3) : m.end()]
        if "://" in around:
            continue
        whole, own = _high(run, kind, m.start(), fixed, bisect.bisect_right(ends, m.start()))
        good = [x for x in whole if not ALLOWED.search(run[x[0] : x[1]])]
        within = lambda x: (k := bisect.bisect_right(good, (x[0], len(run)))) > 0 and x[1] <= good[k - 1][1]
        rest = [x for x in own if not within(x) and not ALLOWED.search(run[x[0] : x[1]])]
        if rest and not _in_address(text, marks, m.start()):
            good += rest
        found += [(a + m.start(), 3, b + m.start()) for a, b in _merged(good)]
    return sorted(found)


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def without_secrets(text: str, mark: str = "[SECRET]") -> str:
    out, at = [], 0
    for a, _, b in spans(text):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        rows = []
        for text in batch.column("text"):
            found = spans(text.as_py() or "")
            base = [x for x in found if x[1] < 3]
            n = [sum(x[1] == k for x in base) for k in range(3)]
            rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found)))
        columns = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:])], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, the number of matches of each fixed pattern, their digest, and all spans as kind:start:end."""
    return docs.select("doc_id", "text").mapInArrow(_scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        column = pa.array([None if (t := x.as_py()) is None else without_secrets(t) for x in batch.column("text")], batch.schema.field("text").type)
        k = batch.schema.get_field_index("text")
        yield pa.RecordBatch.from_arrays([column if i == k else batch.column(i) for i in range(batch.num_columns)], schema=batch.schema)


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by [SECRET]; n_chars, where there is one, follows the text."""
    out = docs.mapInArrow(_redact, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out
