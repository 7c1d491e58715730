"""Secret scan: three fixed patterns and a sliding window of Shannon entropy.

Base spans are the leftmost non-overlapping matches of the three patterns. The method adds
spans of kind `entropy`: a candidate is a maximal run of token characters; a window of
WINDOW characters slides over each stretch of one character class in it, its entropy kept
up to date from counts of characters that enter and leave. Windows above the class's
threshold are joined to spans; spans of all classes that overlap are one. Candidates on the allow
list are passed over: words are allowed only while they look like words, so letters in random
cases and groups of letters and digits are not.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.llm.textbytes import slices, texts

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: runs are maximal, so a least length in the pattern drops the same matches as a check afterwards
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = {"assign": 6, "access": 20}
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: character classes with the entropy in bits that WINDOW random characters usually exceed
CLASSES = (("hexadecimal", re.compile(r"[0-9A-Fa-f]{20,}"), 2.9), ("base64", re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 3.7))
#: what looks random and is none: numbers, ids with public meaning, examples
ALLOW = (
    re.compile(r"[0-9+/_=-]+"),
    re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.IGNORECASE),
    re.compile(r"(?:.*[-+/_=])?(?:example|placeholder|x{5,}|X{5,})(?:[-+/_=].*)?|.*EXAMPLE.*"),
)
#: words joined by separators, each with a few digits at its end; its letters fall into lower, Capitalised and UPPER parts
WORDS = re.compile(r"(?:[A-Za-z]+[0-9]{0,4}[-_/=+]+)*(?:[A-Za-z]+[0-9]{0,4})?")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: letters of a part on average, and digits in all characters, of what looks like words
PART_LETTERS, DIGIT_SHARE = 3, 0.25
#: texts that cannot hold any span are told apart by one linear pass
POSSIBLE = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]|[0-9a-f]{24}|[A-Za-z0-9+/_=-]{20}"""

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) in code points; too short matches are used up and dropped."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def entropy_windows(run: str, least: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Joined windows of `run` whose entropy is above `least`, by counts of one character in, one out."""
    if len(run) < window:
        return []
    part = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    total = 0.0
    spans: list[tuple[int, int]] = []
    for i, ch in enumerate(run):
        c = counts.get(ch, 0)
        total += part[c + 1] - part[c]
        counts[ch] = c + 1
        if i >= window - 1:
            if math.log2(window) - total / window > least:
                lo = i - window + 1
                if spans and lo <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], i + 1)
                else:
                    spans.append((lo, i + 1))
            old = run[i - window + 1]
            c = counts[old]
            total += part[c - 1] - part[c]
            counts[old] = c - 1
    return spans


def wordlike(candidate: str) -> bool:
    if not WORDS.fullmatch(candidate):
        return False
    parts = PART.findall(candidate)
    return sum(map(len, parts)) >= PART_LETTERS * len(parts) and sum(c.isdigit() for c in candidate) <= DIGIT_SHARE * len(candidate)


def allowed(candidate: str, allow: tuple[re.Pattern, ...] = ALLOW) -> bool:
    return any(p.fullmatch(candidate) for p in allow) or wordlike(candidate)


def entropy_spans(text: str) -> list[Span]:
    out: list[tuple[int, int]] = []
    for m in CANDIDATE.finditer(text):
        if allowed(m.group()):
            continue
        found = (
            (m.start() + r.start() + a, m.start() + r.start() + b)
            for _, chars, least in CLASSES
            for r in chars.finditer(m.group())
            if not allowed(r.group())
            for a, b in entropy_windows(r.group(), least)
        )
        for a, b in sorted(found):
            if out and a < out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
    return [(a, b, "entropy") for a, b in out]


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in ordered(spans))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string"


def scan(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> one row for each row, nothing shuffled. A null text is empty: no spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            column = texts(batch)
            n = len(column)
            counts = {k: [0] * n for k in KINDS}
            sha, spans = [nothing] * n, [""] * n
            for lo, hi in slices(column):
                part = column.slice(lo, hi - lo)
                for i in pc.indices_nonzero(pc.match_substring_regex(part, POSSIBLE)).to_pylist():
                    text = part[i].as_py()
                    base = base_spans(text)
                    more = base + entropy_spans(text)
                    for _, _, k in more:
                        counts[k][lo + i] += 1
                    sha[lo + i] = hashlib.sha256(joined(base).encode()).hexdigest()
                    spans[lo + i] = joined(more)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(sha, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


MARK = {"assign": "<SECRET>", "access": "<ACCESS_KEY>", "hex": "<HEX>", "entropy": "<TOKEN>"}


def masked(text: str | None) -> str | None:
    """The text with each stretch of overlapping spans replaced by one mark (of its first span's kind)."""
    if not text:
        return text
    out, at, end, kind = [], 0, -1, ""
    start = 0
    for a, b, k in ordered(base_spans(text) + entropy_spans(text)):
        if a < end:
            end = max(end, b)
            continue
        if end >= 0:
            out += [text[at:start], MARK[kind]]
            at = end
        start, end, kind = a, b, k
    return text if end < 0 else "".join([*out, text[at:start], MARK[kind], text[end:]])


def redact(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with the spans in `column` masked; all columns and rows stay, null and clean texts unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index(column)
            raw = batch.column(i)
            text = texts(batch, column)
            hit = set(pc.indices_nonzero(pc.match_substring_regex(text, POSSIBLE)).to_pylist())
            new = pa.array([masked(x.as_py()) if k in hit else x.as_py() for k, x in enumerate(raw)], raw.type) if hit else raw
            yield pa.RecordBatch.from_arrays([new if k == i else c for k, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
