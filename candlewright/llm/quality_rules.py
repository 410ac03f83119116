"""Quality rules as a short-circuit cascade, with DataFrame functions only.

Every rule looks at counts of one text. A sample of bounded size gives each rule's cost, counted as the characters
that it looks at, and its rejection rate; the cascade then asks the rules with the most rejections per cost first and
stops at the first that rejects. The order changes the time taken and the reported first reason, never the verdict.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text; null has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def _lines(text: Column) -> Column:
    """The \\n-split lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")


def _count_symbols(text: Column, characters: str) -> Column:
    text = F.coalesce(text, F.lit(""))
    return (F.octet_length(text) - F.octet_length(_without(text, characters))).cast("long")


def _covered(windows: Column) -> Column:
    """Words in windows whose hash occurs more than once; sorting brings equal windows side by side."""

    def repeated(pairs: Column) -> Column:
        same = lambda x, at: F.get(pairs, at)["h"].eqNullSafe(x["h"])
        hits = F.filter(pairs, lambda x, i: same(x, i - 1) | same(x, i + 1))
        starts = F.array_sort(F.transform(hits, lambda x: x["i"]))
        zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total"))
        step = lambda acc, at: F.struct(at.alias("last"), (acc["total"] + F.least(F.lit(WINDOW), at - acc["last"])).alias("total"))
        return F.aggregate(starts, zero, step, lambda acc: acc["total"].cast("long"))

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _let(pairs, repeated)


def _repeat_words(words_: Column) -> Column:
    """Words inside windows of five words that the text holds twice or more, the first included."""
    each = F.transform(words_, lambda x: F.xxhash64(x))
    follow = lambda a: lambda x, i: F.xxhash64(x, *(F.get(a, i + k) for k in range(1, WINDOW)))
    hashes = _let(each, lambda a: F.transform(F.slice(a, F.lit(1), F.size(a) - (WINDOW - 1)), follow(a)))
    found = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_covered(h)))
    return F.when(F.size(words_) <= WINDOW, F.lit(0).cast("long")).otherwise(found)


class Counts:
    """Counts of a text as expressions; those in ``ready`` are read from columns of these names instead."""

    def __init__(self, text: str, words_: Column | str, ready: tuple[str, ...] = ()):
        self._text, self._ready = F.col(f"`{text}`"), ready
        self._words = F.col(f"`{words_}`") if isinstance(words_, str) else words_

    def __getattr__(self, name: str) -> Column:
        if name in self._ready:
            return F.col(name)
        text, words_ = self._text, self._words
        return {
            "n_chars": lambda: F.char_length(F.coalesce(text, F.lit(""))).cast("long"),
            "n_words": lambda: F.size(words_).cast("long"),
            "word_chars": lambda: F.char_length(F.array_join(words_, "")).cast("long"),
            "n_symbols": lambda: _count_symbols(text, SYMBOLS),
            "n_shouts": lambda: _count_symbols(text, "!"),
            "n_lines": lambda: F.size(_lines(text)).cast("long"),
            "n_dup_lines": lambda: _let(_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
            "n_repeat_words": lambda: _repeat_words(words_),
        }[name]()


@dataclass(frozen=True)
class Rule:
    """Rejects a text where ``fails`` is true; ``work`` is about the number of characters that it looks at, passes counted each."""

    name: str
    fails: Callable[[Counts], Column]
    work: Callable[[Counts], Column] = lambda c: c.n_chars


#: Thresholds are whole-number comparisons, so that other engines give the same verdicts.
RULES = (
    Rule("few_words", lambda c: c.n_words < 10, lambda c: F.lit(1)),
    Rule("repeated_windows", lambda c: 100 * c.n_repeat_words > 20 * c.n_words, lambda c: c.n_chars + 8 * WINDOW * c.n_words),
    Rule("symbols", lambda c: 10 * c.n_symbols > c.n_words, lambda c: len(SYMBOLS) * c.n_chars),
    Rule("shouting", lambda c: 2 * c.n_shouts > c.n_words),
    Rule("repeated_lines", lambda c: 100 * c.n_dup_lines > 50 * c.n_lines, lambda c: 4 * c.n_chars),
    Rule("word_length", lambda c: (c.word_chars < 2 * c.n_words) | (c.word_chars > 15 * c.n_words)),
)


def rule_order(docs: DataFrame, rules=RULES, text: str = "text", sample_rows: int = 2000) -> list[Rule]:
    """Rules by rejections per cost on about ``sample_rows`` rows, best first; ties keep the given order.

    The sample decides the order alone. It is drawn from all rows where they lie, and one job counts what each rule
    rejects there and the characters it looks at: no clock, so that equal input has an equal order. Costs are compared
    as powers of two times that of the cheapest rule. An empty table keeps the given order.
    """
    w = free_name(docs, "words")
    share = min(1.0, sample_rows / max(docs.count(), 1))
    sample = docs.select(F.col(f"`{text}`").alias(text)).sample(share, seed=3).withColumn(w, words(F.col(f"`{text}`")))
    counts = Counts(text, w)
    measures = [m for i, r in enumerate(rules) for m in (F.count_if(r.fails(counts)).alias(f"n{i}"), F.sum(r.work(counts).cast("long")).alias(f"c{i}"))]
    got = sample.agg(F.count("*").alias("rows"), *measures).first()
    if not got["rows"]:
        return list(rules)
    return ordered(rules, [float(got[f"c{i}"]) for i in range(len(rules))], [got[f"n{i}"] for i in range(len(rules))])


def ordered(rules, work: list[float], rejected: list[int]) -> list[Rule]:
    """Rules by rejections per cost; a cost below a thousandth is one."""
    cost = [max(t, 1e-3) for t in work]
    power = [round(math.log2(c / min(cost))) for c in cost]
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: -rejected[i] / 2 ** power[i])]


def first_reason(counts: Counts, rules) -> Column:
    """Name of the first rule that rejects, or null; later rules are not evaluated."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.fails(counts), F.lit(rule.name)).otherwise(out)
    return out


def quality_filter(docs: DataFrame, text: str = "text", rules=RULES, sample_rows: int = 2000) -> DataFrame:
    """Rows that no rule rejects, with their columns unchanged.

    Null and blank texts have no words and go (few_words). Repeated rows are judged alike; an empty table
    stays empty. Other columns may have any names.
    """
    in_order = rule_order(docs, rules, text, sample_rows)
    # Bound once: as a column of its own the words would be split anew wherever a pushed filter names them.
    reason = _let(words(F.col(f"`{text}`")), lambda w: first_reason(Counts(text, w), in_order))
    return docs.where(reason.isNull())


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_report(docs: DataFrame, rules=RULES, sample_rows: int = 2000) -> DataFrame:
    """(doc_id, five counts, base_failed, kept) of every row of (doc_id, text).

    A null, empty or blank text has no words: its counts are 0, it fails the base and is not kept. Whole texts are
    counted however long; repeated rows are alike; an empty table gives an empty result; other columns are not
    looked at.
    """
    in_order = rule_order(docs, rules, "text", sample_rows)
    plain = docs.select("doc_id", "text", words(F.col("text")).alias("words"))
    counts = Counts("text", "words")
    counted = plain.select("doc_id", "text", "words", *(getattr(counts, name).alias(name) for name in BASE))
    known = Counts("text", "words", BASE)
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.select("doc_id", *BASE, base_failed.alias("base_failed"), first_reason(known, in_order).alias("reason")).select(
        "doc_id", *BASE, "base_failed", (~F.col("base_failed") & F.col("reason").isNull()).alias("kept")
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP3_SQL = r"""
with w as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
  from documents),
c as (
  select doc_id, text, ws, ls, cast(len(ws) as bigint) as n_words,
         cast(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
         cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         cast(length(regexp_replace(text, '[^!]', '', 'g')) as bigint) as n_shouts,
         cast(len(ls) as bigint) as n_lines,
         cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines
  from w),
g as (select doc_id, unnest(range(1, n_words - 3)) as i, ws from c where n_words > 5),
k as (select doc_id, i, array_to_string(ws[i:i+4], ' ') as win from g),
d as (select doc_id, i from k qualify count(*) over (partition by doc_id, win) > 1),
p as (select distinct doc_id, i + o as pos from d, (select unnest(range(0, 5)) as o)),
r as (select doc_id, count(*) as n from p group by doc_id),
a as (select c.*, cast(coalesce(r.n, 0) as bigint) as n_repeat_words from c left join r using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words or 10 * n_symbols > n_words
            or 2 * n_shouts > n_words or 100 * n_dup_lines > 50 * n_lines
            or word_chars < 2 * n_words or word_chars > 15 * n_words) as kept
from a
"""
