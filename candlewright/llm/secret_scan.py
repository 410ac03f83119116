"""Secret scans: fixed patterns, and a battery of randomness tests over long tokens.

The encoding of a long token is the smallest known alphabet that holds it. Chi-squared uniformity over that
alphabet, runs about its middle and lag-one serial correlation, joined by Fisher's rule, say how well the token
agrees with a random draw. That probability times the ratio of the alphabet's probability to that of ordinary text is
an e-value: ordinary tokens have at most 1 in the mean, the more so the worse they do in the battery. Ordinary text is
what the table itself says in words too short to be candidates, counted by pairs of characters, or one of four styles
where that says less. The step-up rule of Benjamini and Hochberg for e-values then holds the share of false finds, among all
tokens of a length class in the table, so that the many short ones do not drown the few long ones.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, map_arrow, named, table, text_chunks, utf8, with_field

ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{32}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KINDS = ("assign", "access", "hex", "random")

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Alphabets of encodings, smallest first.
ALPHABETS = (
    DIGITS, DIGITS + "abcdef", DIGITS + "ABCDEF", LOWER, UPPER, UPPER + "234567", DIGITS + LOWER, DIGITS + UPPER,
    UPPER + LOWER + DIGITS, UPPER + LOWER + DIGITS + "+/", UPPER + LOWER + DIGITS + "-_", UPPER + LOWER + DIGITS + "+/-_",
)
#: Percentages of the letters a to z in English text, as commonly published.
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)
#: Shares of small letters, capitals, digits and other characters in ordinary text: words, names in capitals, mixed names, numbers.
STYLES = ((0.90, 0.06, 0.02, 0.02), (0.02, 0.88, 0.05, 0.05), (0.60, 0.25, 0.10, 0.05), (0.03, 0.02, 0.90, 0.05))
#: At most this share of finds may be ordinary text.
FALSE_SHARE = 0.001
#: Width of a step of evidence, in natural logarithms, and the most steps told apart.
STEP, MOST_STEPS = 0.25, 2000
#: Lower ends of the length classes.
LENGTHS = (20, 32, 48, 80)

_ORDINARY = tuple(
    {c: math.log(small * p / sum(LETTERS)) for c, p in zip(LOWER, LETTERS, strict=True)}
    | {c: math.log(capital * p / sum(LETTERS)) for c, p in zip(UPPER, LETTERS, strict=True)}
    | {c: math.log(digit / 10) for c in DIGITS}
    | {c: math.log(other / 5) for c in "+/-_="}
    for small, capital, digit, other in STYLES
)


#: Characters of candidates without their case: letters, digits, and the others; all else parts words.
SYMBOLS = LOWER + DIGITS + "+/_=-"
_SYMBOL = np.full(256, len(SYMBOLS), np.uint8)
for _i, _c in enumerate(SYMBOLS):
    _SYMBOL[[ord(_c), ord(_c.upper())]] = _i
#: Share of a pair's probability that goes by the single character, as where names are joined; and that of a change of case.
ALONE, CASE = 0.15, 0.1


def _pairs(texts: bytes) -> np.ndarray:
    """How often each symbol follows each other in words of less than a candidate's length; after the last symbol, starts."""
    size = len(SYMBOLS)
    codes = np.append(_SYMBOL[np.frombuffer(texts, np.uint8)], np.uint8(size))
    ends = np.flatnonzero(codes == size)
    lengths = np.diff(ends, prepend=-1) - 1
    short = np.repeat(lengths < LENGTHS[0], lengths + 1)
    before = np.append(np.uint8(size), codes[:-1]).astype(np.int64)
    held = short & (codes < size)
    return np.bincount(before[held] * size + codes[held], minlength=(size + 1) * size)


class Ordinary:
    """The text of a table by pairs of its characters."""

    def __init__(self, pairs: np.ndarray):
        size = len(SYMBOLS)
        counts = pairs.reshape(size + 1, size).astype(float)
        general = np.array([0.7 * p / sum(LETTERS) for p in LETTERS] + [0.02] * 10 + [0.02] * 5)
        single = 0.5 * general + 0.5 * (counts.sum(axis=0) + 1) / (counts.sum() + size)
        follows = (counts + 20 * single) / (counts.sum(axis=1, keepdims=True) + 20)
        chance = np.log((1 - ALONE) * follows + ALONE * single)
        self.chance = {a + b: chance[i, j] for i, a in enumerate([*SYMBOLS, ""]) for j, b in enumerate(SYMBOLS)}

    def log(self, token: str) -> float:
        """Logarithm of the probability of a token of this length."""
        small = token.lower()
        total = self.chance[small[0]] + sum(self.chance[small[i : i + 2]] for i in range(len(small) - 1))
        kept, changed, open_ = math.log(1 - CASE), math.log(CASE), math.log(0.5)
        last = None
        for c in token:
            if c.isalpha():
                upper = c.isupper()
                total += open_ if last is None else kept if upper == last else changed
                last = upper
            else:
                last = None
        return total


def ordinary(docs: DataFrame, text: str = "text") -> Ordinary:
    """Counts the pairs of a whole table where it lies; a few thousand numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(SYMBOLS) + 1) * len(SYMBOLS), np.int64)
        for chunk in text_chunks(batches):
            total += _pairs(b"\0".join(utf8(chunk)))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], ["pair", "n"])

    got = docs.select(named(text).alias("text")).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    pairs = np.zeros((len(SYMBOLS) + 1) * len(SYMBOLS), np.int64)
    pairs[[r.pair for r in got]] = [r.n for r in got]
    return Ordinary(pairs)


def _log_tail(z: float) -> float:
    """Logarithm of a standard normal's probability to lie above ``z``, however small."""
    return math.log(0.5 * math.erfc(z / math.sqrt(2))) if z < 8 else -z * z / 2 - math.log(z * math.sqrt(2 * math.pi))


def _two_sided(z: float) -> float:
    return min(0.0, math.log(2) + _log_tail(abs(z)))


def _chi_squared_above(x: float, freedom: int) -> float:
    """Logarithm of the upper tail by Wilson and Hilferty's cube-root rule, far out by Chernoff's bound."""
    z = ((x / freedom) ** (1 / 3) - (1 - 2 / (9 * freedom))) / math.sqrt(2 / (9 * freedom))
    return _log_tail(z) if z < 8 else -freedom / 2 * (x / freedom - 1 - math.log(x / freedom))


def alphabet(token: str) -> str | None:
    """The smallest alphabet that holds the token without its padding."""
    have = set(token)
    return next((a for a in ALPHABETS if have <= set(a)), None)


def randomness(token: str, letters: str) -> float:
    """Logarithm of the probability that a random string of this alphabet looks less random, over the three tests."""
    n, size = len(token), len(letters)
    place = {c: i for i, c in enumerate(letters)}
    values = [place[c] for c in token]
    expected = n / size
    counts = [token.count(c) for c in letters]
    uniform = _chi_squared_above(sum((c - expected) ** 2 / expected for c in counts), size - 1)
    signs = [2 * v >= size for v in values]
    ups = sum(signs)
    downs = n - ups
    if not ups or not downs:
        runs = (1 - n) * math.log(2)
    else:
        mean = 2 * ups * downs / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        runs = _two_sided((1 + sum(a != b for a, b in zip(signs, signs[1:], strict=False)) - mean) / math.sqrt(max(spread, 1e-9)))
    middle = sum(values) / n
    around = sum((v - middle) ** 2 for v in values)
    lag = sum((a - middle) * (b - middle) for a, b in zip(values, values[1:], strict=False))
    serial = _two_sided((lag / around + 1 / n) * math.sqrt(n)) if around else (1 - n) * math.log(2)
    half = -(uniform + runs + serial)  # half a chi-squared with 6 degrees of freedom, whose upper tail this is
    return math.log(1 + half + half * half / 2) - half


def evidence(token: str, letters: str, table_: Ordinary | None = None) -> float:
    """Natural logarithm of the e-value against ordinary text, the mean of the table's and the styles.

    A token has one alphabet of several, hence the last term.
    """
    styles = [sum(map(style.__getitem__, token)) for style in _ORDINARY] + ([table_.log(token)] if table_ else [])
    top = max(styles)
    plain = top + math.log(sum(math.exp(x - top) for x in styles) / len(styles))
    against = -plain - len(token) * math.log(len(letters))
    return against + randomness(token, letters) - math.log(len(ALPHABETS))


def candidates(text: str, table_: Ordinary | None = None) -> list[tuple[int, int, int, int]]:
    """(start, end, length class, evidence in steps) of the long tokens of a text."""
    found = []
    for m in CANDIDATE.finditer(text):
        token = m[0].rstrip("=")
        letters = alphabet(token)
        if letters and len(token) >= LENGTHS[0]:
            steps = min(max(math.floor(evidence(token, letters, table_) / STEP), -1), MOST_STEPS)
            found.append((m.start(), m.start() + len(token), max(low for low in LENGTHS if low <= len(token)), steps))
    return found


def limits_of(counts: dict[tuple[int, int], int], false_share: float = FALSE_SHARE) -> dict[int, int]:
    """By length class, the steps of evidence from which on tokens are found, from how many tokens have how many.

    The step-up rule: the most tokens such that the least evidence among k of m is at least m / (false_share k).
    """
    out = {}
    for band in {b for b, _ in counts}:
        own = sorted(((s, n) for (b, s), n in counts.items() if b == band), reverse=True)
        total, above = sum(n for _, n in own), 0
        for steps, n in own:
            above += n
            if steps > 0 and steps * STEP >= math.log(total / (false_share * above)):
                out[band] = steps
    return out


def random_spans(text: str, limits: dict[int, int] | None = None, table_: Ordinary | None = None) -> list[tuple[int, int]]:
    """Spans of tokens found under ``limits``, or under those of the text's own tokens."""
    found = candidates(text, table_)
    if limits is None:
        limits = limits_of(Counter((band, steps) for _, _, band, steps in found))
    return [(a, b) for a, b, band, steps in found if band in limits and steps >= limits[band]]


def false_find_limits(docs: DataFrame, text: str = "text", false_share: float = FALSE_SHARE, table_: Ordinary | None = None) -> dict[int, int]:
    """limits_of all tokens of a table: tasks count evidence by length class, at most MOST_STEPS counts for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for chunk in text_chunks(batches):
            for t in chunk.column(0).to_pylist():
                counts.update((band, steps) for _, _, band, steps in (candidates(t, table_) if t else ()))
        yield pa.RecordBatch.from_arrays([pa.array([f(k) for k in counts], pa.int64()) for f in (lambda k: k[0], lambda k: k[1], counts.get)], ["band", "steps", "n"])

    seen = docs.select(named(text).alias("text")).mapInArrow(run, "band long, steps long, n long")
    return limits_of({(r["band"], r["steps"]): r["n"] for r in seen.groupBy("band", "steps").agg(F.sum("n").alias("n")).collect()}, false_share)


def scan(text: str, limits: dict[int, int] | None = None, table_: Ordinary | None = None) -> list[tuple[int, str, int]]:
    """(start, kind, end) of all secrets of a text, by start and then kind as in KINDS."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if LONG_HEX.search(text):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    base = list(found)
    found += [(a, 3, b) for a, b in random_spans(text, limits, table_) if not any(a < end and start < b for start, _, end in base)]
    return [(a, KINDS[k], b) for a, k, b in sorted(found)]


def redacted(text: str, mark: str = "[SECRET]", limits: dict[int, int] | None = None, table_: Ordinary | None = None) -> str:
    """The text with each stretch of secrets replaced by ``mark``."""
    out, at = [], 0
    for start, _, end in scan(text, limits, table_):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


_SPANS = "array<struct<kind:string,start:long,end:long>>"


def secret_spans(docs: DataFrame, text: str = "text", to: str = "secrets") -> DataFrame:
    """``docs`` with the array ``to`` of (kind, start, end), in code points, end exclusive.

    Null and empty texts have none; whole texts are scanned however long; repeated rows are alike, and count as often
    as they occur in the false-discovery control; tokens of equal evidence are found or not together; an empty table
    gives an empty one. Other columns are carried unchanged, whatever their names, and one named ``to`` is replaced.
    """
    table_ = ordinary(docs, text)
    limits = false_find_limits(docs, text, table_=table_)
    kept, schema = with_field(docs, to, _SPANS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for chunk in text_chunks(batches, text):
            spans = [[{"kind": k, "start": a, "end": b} for a, k, b in scan(t, limits, table_)] if t else [] for t in chunk.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*chunk.columns, pa.array(spans, kind)], [*chunk.schema.names, to])

    return map_arrow(kept, run, schema)


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with secrets in ``text`` replaced by a mark, and ``length`` set to the new code points.

    Null texts stay null; rows and columns are kept, and ``length`` is left alone where it is absent, or null. Otherwise
    as secret_spans.
    """
    table_ = ordinary(docs, text)
    limits = false_find_limits(docs, text, table_=table_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, text):
            new = [t and redacted(t, limits=limits, table_=table_) for t in chunk.column(text).to_pylist()]
            at = chunk.schema.get_field_index(text)
            yield chunk.set_column(at, chunk.schema.field(at), pa.array(new, chunk.schema.field(at).type))

    out = map_arrow(docs, run, docs.schema)
    if length is None or length not in docs.columns:
        return out
    now = F.char_length(F.col(f"`{text}`")).cast(docs.schema[length].dataType)
    return out.withColumn(length, F.when(F.col(f"`{text}`").isNull() | F.col(f"`{length}`").isNull(), F.col(f"`{length}`")).otherwise(now))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans per document and their digests, by the contract of this query."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_spans(docs, to=free_name(docs, "secrets")).drop("text")
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans")
    )
