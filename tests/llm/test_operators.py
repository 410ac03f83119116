"""Each operator against a plain version, an exact round trip or held-out labels, and on odd input."""

import hashlib
import math
import random
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import classes, documents, item_matches, words
from pyspark.sql import functions as F

from candlewright.llm import bpe, chat_format, common, html_extraction, language_id, lm_scoring, ngram_join, quality_classifier, quality_rules, secret_scan
from candlewright.llm import decontamination as dec
from candlewright.llm.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (6, "é ü 漢字 😀 a b c d"), (7, "long " * 30_000), (None, "no id here at all is given")]


def table(spark, name):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()]


def vocabulary():
    rng = random.Random(1)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(4000)]


def prose(rng, n, v=vocabulary()):
    return " ".join(rng.choice(v) for _ in range(n))


# Common


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (200, 200)]
    got = dict(common.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_keeps_components(spark, monkeypatch):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = sorted(common.components(df).collect())
    monkeypatch.setattr(common, "FOREST_EDGES", 20)
    assert sorted(common.components(df.repartition(9)).collect()) == want


def test_release_deletes_what_was_stored(spark, monkeypatch):
    monkeypatch.setattr(common, "_STORED", [])
    df = common.stored(spark.range(5))
    assert df.count() == 5 and len(common._STORED) == 1
    assert common.release(spark) == 1 and common.release(spark) == 0
    with pytest.raises(Exception, match="(?i)not.*(found|exist)"):
        common.stored(df)


# 1


def test_op1_finds_exact_and_near_items(spark):
    rng = random.Random(2)
    items = [(i, prose(rng, rng.randint(20, 60))) for i in range(30)]
    docs, want = [], set()
    for d in range(120):
        text = prose(rng, rng.randint(5, 300))
        if d % 3 == 0:
            i, item = items[d % 30]
            changed = item.split()
            if d % 2:
                changed[-1] = "changed"
            text = f"{text}\n{' '.join(changed).upper() if d % 4 == 0 else ' '.join(changed)}. {prose(rng, 40)}"
            want.add((d, i))
        docs.append((d, text))
    got = dec.contaminated_spans(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    for r in got:
        assert dec.normal(dict(docs)[r.doc_id][r.start : r.end]).split()[:10] == dec.normal(dict(items)[r.item_id]).split()[:10]


def test_op1_hamming_index_is_complete():
    rng = np.random.default_rng(3)
    grams = [common.mix(rng.integers(0, 1 << 60, 20).astype(np.uint64)) for _ in range(40)]
    items = dec.Items(list(range(40)), grams, 5)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 24), replace=False)) for _ in range(300)], np.uint64)
    prints = items.prints[rng.integers(0, 40, 300)] ^ flips
    want = {(i, j) for i in range(300) for j in range(40) if bin(int(prints[i] ^ items.prints[j])).count("1") <= dec.RADIUS}
    assert set(zip(*(x.tolist() for x in items.near(prints, 0)), strict=True)) == want


def test_op1_recall_at_the_threshold(spark):
    """Against all windows: items with so many words changed that their similarity lies just over 0.8."""
    rng = random.Random(6)
    items = [(i, prose(rng, rng.randint(15, 60))) for i in range(60)]
    docs = []
    for d in range(600):
        words_ = items[d % 60][1].split()
        for at in range(rng.randint(0, 2)):
            words_[rng.choice((0, 1, len(words_) - 2, len(words_) - 1, rng.randrange(len(words_))))] = f"new{at}"
        docs.append((d, f"{prose(rng, rng.randint(0, 30))} {' '.join(words_)} {prose(rng, 20)}"))
    want = item_matches(docs, items)
    got = {(r.doc_id, r.item_id): r.similarity for r in dec.contaminated_spans(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len([s for s in want.values() if s < 0.9]) > 100
    assert got.keys() <= want.keys() and len(got) >= 0.99 * len(want)
    assert all(got[k] == pytest.approx(want[k]) for k in got)


def test_op1_query_against_all_windows(spark):
    docs, bench = ([r[:2] for r in table(spark, t)] for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in dec.op1_benchmark_decontamination(spark, SF).collect()}
    assert got == item_matches(docs, bench).keys() and got


def test_op1_long_text_full_of_items(spark):
    rng = random.Random(8)
    item = prose(rng, 30)
    text = " ".join([item] * 3000 + [prose(rng, 50_000)])
    got = dec.contaminated_spans(documents(spark, [(1, text), (2, text)]), spark.createDataFrame([(9, item)], "item_id long, text string"))
    assert [(r.doc_id, r["count"]) for r in got.groupBy("doc_id").count().orderBy("doc_id").collect()] == [(1, 3000), (2, 3000)]
    assert all(text[r.start : r.end] == item for r in got.where("doc_id = 1 and similarity = 1").collect())


def odd_columns(docs):
    """The rows of ``docs`` with columns that operators might use for themselves, and names with dots and marks."""
    names = ["sid", "_id", "_hash", "_bare", "_text_hash", "text_hash", "root", "class_id", "words", "reason", "key", "a.b", "c`d", "n", "item_id", "to", "secrets"]
    return docs.withColumns({n if n.isidentifier() else n.replace(".", "?").replace("`", "!"): F.lit(i) for i, n in enumerate(names)}).toDF(*docs.columns, *names)


def test_stages_keep_any_columns(spark):
    """Every operator of the pipeline on a table with clashing names."""
    rng = random.Random(9)
    text = prose(rng, 40)
    docs = odd_columns(documents(spark, [(1, text), (2, text + " end"), (3, prose(rng, 40) + " token=abcdefgh123"), (4, None)]))
    bench = spark.createDataFrame([(1, prose(rng, 20))], "item_id long, text string")
    for out, n in ((quality_rules.quality_filter(docs), 3), (ngram_join.one_of_each(docs), 3), (dec.decontaminate(docs, bench), 4), (secret_scan.redact(docs), 4)):
        assert out.columns == docs.columns
        rows = out.collect()
        assert len(rows) == n and all(r["a.b"] == 11 and r["c`d"] == 12 for r in rows)
    coded = bpe.decode(bpe.encode(docs, bpe.default_path(), to="to"), bpe.default_path(), ids="to")
    assert sorted(coded.columns) == sorted([*docs.columns, "decoded"]) and coded.count() == 4
    assert secret_scan.secret_spans(docs).where("doc_id = 3").first()["secrets"][0]["kind"] == "assign"


def test_op1_passes_and_odd_input(spark, monkeypatch):
    rng = random.Random(5)
    items = [(i, prose(rng, 25)) for i in range(12)] + [(50, None), (51, ""), (52, "two words"), (53, items_text := prose(rng, 30)), (54, items_text)]
    docs = [*ODD, (10, items[3][1]), (11, prose(rng, 9) + " two words " + prose(rng, 9)), (12, items_text)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    once = sorted(map(tuple, dec.contaminated_spans(documents(spark, docs), bench).collect()))
    assert {(r[0], r[1]) for r in once} == {(10, 3), (11, 52), (12, 53), (12, 54)}
    monkeypatch.setattr(dec, "ITEMS_A_PASS", 4)
    assert sorted(map(tuple, dec.contaminated_spans(documents(spark, docs), bench).collect())) == once
    left = dec.decontaminate(documents(spark, docs), bench)
    assert sorted(r.doc_id for r in left.where("doc_id is not null").collect()) == [1, 2, 3, 4, 5, 5, 6, 7]
    assert left.where("doc_id is null").count() == 1
    monkeypatch.setattr(dec, "LOOK_SHINGLES", 60)  # several first looks, each before passes of its own
    assert sorted(map(tuple, dec.contaminated_spans(documents(spark, docs), bench).collect())) == once
    assert sorted(map(tuple, dec.decontaminate(documents(spark, docs), bench).collect()), key=repr) == sorted(map(tuple, left.collect()), key=repr)
    assert dec.contaminated_spans(documents(spark, docs), bench.limit(0)).count() == 0


# 2


def test_op2_reads_back(spark):
    want = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for conv, _, role, text in sorted(table(spark, "conversations"), key=lambda r: (r[0], r[1])):
        want.setdefault(conv, []).append((role or "", text or ""))
    got = chat_format.op2_chat_format(spark, SF).collect()
    assert len(got) == len(want)
    for r in got:
        turns = want[r.conv_id]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()


def test_op2_hard_texts(spark):
    import public_tokenizers

    hard = ["<|end|>", "<\\|end|>", "<\\\\|text|><|turn|>", "[INST][\\INST]</s><s>", "<|endoftext|>", "", "  é漢😀\n ", "<<|end|>>", None]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(hard * 2)] + [(2, None, None, None), (None, 0, "assistant", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    t = chat_format.Template()
    for r in chat_format.format_conversations(turns, public_tokenizers.path("byte_bpe_50k.json")).collect():
        said = [(a or "", b or "") for c, _, a, b in rows if c == r.conv_id]
        assert t.parse(r.formatted) == said
        starts, ends, mask = (np.array(x) for x in (r.token_starts, r.token_ends, r.loss_mask))
        parts = chat_format.masked_text(r.formatted, starts, ends, mask)
        assert [t.unescape(p) for p in parts] == [b for a, b in said if a == "assistant" and b]


def test_op2_odd_tables(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    long = "word <|end|> é " * 40_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (2, 0, "assistant", "same"), (2, 0, "assistant", "same"), (2, 1, "system", ""), *((3 + i, 0, "assistant", f"{i} x" * i) for i in range(100))]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("formatted", F.lit(1)).withColumn("a.b", F.lit(2))
    t = chat_format.Template()
    got = {r.conv_id: r for r in chat_format.format_conversations(turns, path).collect()}
    assert len(got) == 102 and t.parse(got[1].formatted) == [("user", long), ("assistant", long)]
    assert t.parse(got[2].formatted) == [("assistant", "same"), ("assistant", "same"), ("system", "")]
    for r in got.values():
        parts = chat_format.masked_text(r.formatted, np.array(r.token_starts), np.array(r.token_ends), np.array(r.loss_mask))
        assert "".join(t.unescape(p) for p in parts) == "".join(x for role, x in t.parse(r.formatted) if role == "assistant")
    assert chat_format.format_conversations(turns.limit(0), path).count() == 0


# 3


def plain_counts(text):
    w = [x.decode() for x in words(text)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    twice = {x for x, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, x in enumerate(windows) if x in twice for k in range(5)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_op3_counts(spark):
    rng = random.Random(7)
    rows = [(d, t) for d, t in ODD if d not in (5, None)] + [(100 + i, " ".join(rng.choice("ab |é\n") + rng.choice("x*") for _ in range(rng.randint(0, 60)))) for i in range(80)]
    got = {r.doc_id: r for r in quality_rules.quality_report(documents(spark, rows)).collect()}
    for d, t in rows:
        r = got[d]
        n = plain_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n, d
        assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0])
        assert not (r.base_failed and r.kept)


def test_op3_order_is_by_rejections_per_cost():
    a, b, c, d = quality_rules.RULES[:4]
    order = quality_rules.ordered((a, b, c, d), [0.010, 0.011, 0.080, 0.0], [10, 10, 500, 0])
    assert order == [c, a, b, d]
    assert quality_rules.ordered((a, b), [0.5, 0.0], [0, 0]) == [a, b]


def test_op3_report_of_odd_tables(spark):
    docs = documents(spark, ODD).withColumn("words", F.lit(1)).withColumn("reason", F.lit(2)).withColumn("n_words", F.lit(3))
    got = quality_rules.quality_report(docs)
    assert got.count() == len(ODD) and got.where("doc_id = 5").distinct().count() == 1
    assert quality_rules.quality_report(docs.limit(0)).count() == 0
    assert [tuple(r) for r in got.where("doc_id = 1").collect()] == [(1, 0, 0, 0, 0, 0, True, False)]


def test_op3_order_does_not_change_the_verdict(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in quality_rules.quality_report(docs).where("kept").collect()}
    reverse = quality_rules.quality_filter(docs, rules=quality_rules.RULES[::-1])
    assert reverse.columns == docs.columns
    assert {r.doc_id for r in reverse.collect()} == kept
    clash = docs.withColumnsRenamed({"lang": "words", "source": "reason"})
    assert {r.doc_id for r in quality_rules.quality_filter(clash).collect()} == kept
    assert quality_rules.quality_filter(docs.limit(0)).count() == 0
    assert "Python" not in quality_rules.op3_quality_rules(spark, SF)._jdf.queryExecution().toString()


# 4


def copies(rng, n_groups, size, length):
    rows = []
    for _ in range(n_groups):
        base = prose(rng, length).split()
        for k in range(size):
            text = list(base)
            for _ in range(k % 7):
                text[rng.randrange(len(text))] = f"w{rng.randrange(10**6)}"
            rows.append(" ".join(text))
    return rows


def test_op4_equals_all_pairs(spark):
    rng = random.Random(11)
    texts = copies(rng, 12, 5, 60) + copies(rng, 2, 60, 80) + [prose(rng, rng.randint(1, 40)) for _ in range(40)]
    texts += ["a b c", "a b c", "a b c d", "x", "x", "", None, " "] + [texts[0]] * 25
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(documents(spark, rows)).collect()}
    assert got == classes(rows)


def test_op4_large_group_is_split_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 32)
    rng = random.Random(12)
    rows = list(enumerate(copies(rng, 1, 150, 120) + [prose(rng, 50) for _ in range(20)]))
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(documents(spark, rows)).collect()}
    assert got == classes(rows)


def test_op4_odd_rows(spark):
    found = ngram_join.near_duplicates(documents(spark, ODD))
    assert found.count() == len(ODD)
    got = {r.doc_id: (r.class_id, r.n_links) for r in found.collect()}
    assert got[1] == (1, 0) and got[2] == (2, 0) and got[3] == (3, 0)
    assert got[4] == (4, 2) and got[5] == (4, 2) and got[None] == (None, 0)
    left = ngram_join.one_of_each(documents(spark, ODD))
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 2, 3, 4, 6, 7]
    assert left.columns == documents(spark, ODD).columns
    assert ngram_join.near_duplicates(documents(spark, ODD).limit(0)).count() == 0


def test_op4_one_of_each_root(spark):
    rng = random.Random(13)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (8, d), (9, a + " end"), (None, None), (None, "")]
    left = ngram_join.one_of_each(documents(spark, rows))
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter([(9, a + " end"), (None, b), (7, c), (7, d), (None, None), (None, "")])


def test_op4_query_equals_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.op4_ngram_jaccard_join(spark, sf).collect()}
    assert got == classes(rows)


def test_op4_thousands_of_near_copies(spark):
    """A group whose members differ in a few words each, against counts by matrix product."""
    rng = random.Random(16)
    base = prose(rng, 150).split()
    rows, sets = [], []
    for d in range(2500):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = f"w{rng.randrange(10**6)}"
        rows.append((d, " ".join(own)))
        sets.append(frozenset(zip(*(own[k:] for k in range(5)), strict=False)))
    names = {g: i for i, g in enumerate({g for s in sets for g in s})}
    has = np.zeros((len(sets), len(names)), np.float32)
    for d, s in enumerate(sets):
        has[d, [names[g] for g in s]] = 1
    both, size = has @ has.T, has.sum(axis=1)
    links = (5 * both >= 4 * (size[:, None] + size[None, :] - both)).sum(axis=1) - 1
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(documents(spark, rows)).collect()}
    assert got == {d: (0, int(n)) for d, n in enumerate(links)}


def deeper_rows(monkeypatch):
    """Rows that go to the second split of near_duplicates, one number for each call."""
    seen, real = [], ngram_join._buckets

    def spy(df, runs, total):
        if runs is None:
            seen.append(df.count())
        return real(df, runs, total)

    monkeypatch.setattr(ngram_join, "_buckets", spy)
    return seen


def test_op4_buckets_of_near_copies_are_not_split(spark, monkeypatch):
    seen = deeper_rows(monkeypatch)
    for n in (250, 500):
        rows = list(enumerate(copies(random.Random(17), 1, n, 150)))
        got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(documents(spark, rows)).collect()}
        assert got == classes(rows)
        assert seen.pop() <= 2 * n


def test_op4_near_copies_among_texts_with_a_common_part(spark, monkeypatch):
    """Buckets of one large group, of a smaller one and of texts alike to few, which share half of their words."""
    seen = deeper_rows(monkeypatch)
    rng = random.Random(18)
    part = prose(rng, 90)
    texts = [f"{part} {t}" for t in copies(rng, 1, 160, 70) + copies(rng, 1, 60, 70) + copies(rng, 40, 2, 70)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    for close in (ngram_join.CLOSE, ngram_join.POSITIONS + 1):
        monkeypatch.setattr(ngram_join, "CLOSE", close)
        got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(documents(spark, rows)).collect()}
        assert got == classes(rows)
    assert 0 < seen[0] < seen[1]


def test_op4_runs():
    assert ngram_join.runs_for(0.999999, 0.8) > ngram_join.runs_for(0.99, 0.8) > ngram_join.runs_for(0.99, 0.95)


def test_op4_runs_reach_the_recall_in_split_buckets():
    """Sketches drawn minimum by minimum, and both splits of a large bucket: what 128 minima and eight levels lose."""

    def met(p, levels):
        if levels == 0:
            return 1.0
        one = p * met(p, levels - 1)
        return 0.75 * one + 0.25 * (1 - (1 - one) ** 2)

    for similarity in (0.8, 0.9):
        runs = ngram_join.runs_for(0.999999, similarity)
        share = lambda k, s=similarity: math.comb(128, k) * s**k * (1 - s) ** (128 - k)
        missed = lambda n: sum(share(k) * (1 - met(k / 128, ngram_join.LEVELS + ngram_join.DEEPER)) ** n for k in range(129))  # noqa: E731, B023
        assert missed(runs) <= 1e-6 < missed(runs - 1)


# 5


def test_op5_held_out_accuracy(spark):
    got = {r.doc_id: r for r in language_id.op5_language_id(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    held = [d for d in docs if got[d.doc_id].held_out and d.lang]
    assert all(got[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2) for d in docs)
    assert sum(got[d.doc_id].lang_pred == d.lang for d in held) >= 0.95 * len(held)


def test_op5_odd_texts(spark):
    docs = documents(spark, ODD + [(20, "123 !!")])
    net = language_id.train(documents(spark, [(i, prose(random.Random(i), 40)) for i in range(8)]))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, net).collect()}
    assert all(got[d] == ("und", 0.0) for d in (1, 2, 3, 20))
    assert got[6][0] == "en" and 0 < got[6][1] <= 1
    assert {r.lang_pred for r in language_id.identify(docs, None).collect()} == {"und"}
    assert language_id.train(docs.limit(0)) is None


def test_op5_responses_and_gradients():
    """The network as a plain convolution over one-hot bytes, and its gradients by differences."""
    rng = np.random.default_rng(41)
    x = rng.integers(0, 256, (5, language_id.WINDOW), np.uint8)
    tables = [[rng.normal(0, 0.5, (256, language_id.FILTERS)) for _ in range(w)] for w in language_id.WIDTHS]
    width = language_id.FILTERS * len(tables)
    net = language_id.Network(["a", "b", "c"], tables, rng.normal(0, 0.5, width), rng.normal(0, 0.5, (width, 3)), rng.normal(0, 0.5, 3))
    one_hot = np.eye(256)[x]
    tops = [np.max([sum(one_hot[:, i + k] @ rows[k] for k in range(len(rows))) for i in range(language_id.WINDOW - len(rows) + 1)], axis=0) for rows in tables]
    logits = np.maximum(np.concatenate(tops, axis=1) + net.bias, 0) @ net.layer + net.shift
    plain = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    assert np.allclose(net.probabilities(x), plain, atol=1e-5)
    y, weight = np.array([0, 1, 2, 1, 0]), np.array([0.1, 0.2, 0.3, 0.2, 0.2])

    def loss():
        top = np.maximum(net.pooled(x)[0], 0) @ net.layer + net.shift
        return -(weight * (top - np.log(np.exp(top).sum(axis=1, keepdims=True)))[np.arange(5), y]).sum()

    flat = [t for rows in tables for t in rows] + [net.bias, net.layer, net.shift]
    for p, g in zip(flat, language_id.gradients(net, x, y, weight), strict=True):
        for at in [tuple(np.unravel_index(np.argmax(np.abs(g)), g.shape)), *(tuple(rng.integers(0, n) for n in p.shape) for _ in range(3))]:
            was = p[at]
            p[at] = was + 1e-5
            up = loss()
            p[at] = was - 1e-5
            down = loss()
            p[at] = was
            assert g[at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-6)


def test_op5_learns_every_language(spark):
    rng = random.Random(42)
    rows = [(i, chr(0x4E00 + i % 230) * 3 + " " + chr(0x4E00 + i % 230) * 40, f"l{i % 230}") for i in range(230 * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language_id.train(docs, docs_each=2)
    assert net.names == sorted({r[2] for r in rows}) and rng
    assert language_id.identify(docs.limit(0), net).count() == 0


def test_op5_windows_cover_the_text():
    text = bytes(range(1, 256)) * 3
    assert language_id.windows(text).tobytes().rstrip(b"\0") == text


# 6


BASE = (
    ("assign", re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE), 8),
    ("access", re.compile(r"(AKIA[A-Z0-9]+)"), 16),
    ("hex", re.compile(r"([0-9a-f]+)"), 32),
)


def base_digest(text):
    """By the contract, with patterns of this test; where letters of other scripts fold to s or k, by hand."""
    spans = [(m.start(), i, m.end()) for i, (_, p, least) in enumerate(BASE) for m in p.finditer((text or "").replace("\u017f", "\u0100").replace("\u212a", "\u0100")) if m.end(1) - m.start(1) >= least]
    return hashlib.sha256(",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in sorted(spans)).encode()).hexdigest()


def test_op6_base_spans(spark):
    texts = dict(table(spark, "documents")[i][:2] for i in range(200)) | {-1: None, -2: "", -3: 'secret: api_key: "x1234567" Token="abcdefgh" pasſword=longenough1 AKIAAKIA12345678 AKIA123 ' + "f" * 40 + "g" + "0" * 31}
    got = secret_scan.secret_spans(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    for r in got:
        base = ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.secrets if s.kind != "random")
        assert hashlib.sha256(base.encode()).hexdigest() == base_digest(texts[r.doc_id])


def test_op6_random_tokens_are_found_and_text_is_not():
    rng = random.Random(13)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    b64 = secret_scan.ALPHABETS[9]
    hits = sum(bool(secret_scan.random_spans(f"see {draw(b64, 40)} there")) for _ in range(200))
    assert hits >= 190
    calm = ["a" * 50, "0" * 40, "donaudampfschifffahrtsgesellschaft", "the-quick-brown-fox-jumps-over-lazy-dogs", "abcdefghijklmnopqrstuvwxyzabcdefgh", "/usr/local/share/documents/letters"]
    assert not any(secret_scan.random_spans(f"x {t} y") for t in calm)


def test_op6_step_up_rule():
    counts = {(20, 100): 1, (20, 40): 3, (20, 5): 996, (80, 20): 1, (32, -1): 50}
    step = secret_scan.STEP
    limits = secret_scan.limits_of(counts, 0.01)
    for band in (20, 80, 32):
        values = sorted((s * step for (b, s), n in counts.items() if b == band for _ in range(n)), reverse=True)
        most = max((k for k, v in enumerate(values, 1) if v > 0 and v >= math.log(len(values) / (0.01 * k))), default=0)
        assert sum(v >= limits[band] * step for v in values) == most if band in limits else most == 0


def test_op6_rates_by_alphabet_and_length(spark):
    """Hits among random tokens of every encoding and length class, and false finds among ordinary names of a table."""
    rng = random.Random(14)
    words_ = ["".join(rng.choices(secret_scan.LOWER, secret_scan.LETTERS, k=rng.randint(2, 9))) for _ in range(3000)]
    joins = ["-".join, "_".join, "/".join, "".join, lambda w: "".join(x.capitalize() for x in w), lambda w: "_".join(w).upper(), lambda w: "-".join(w) + f"-{rng.randint(1, 2030)}"]
    names, tokens = [], []
    for _ in range(4000):
        name = joins[rng.randrange(len(joins))](rng.choices(words_, k=rng.randint(4, 14)))
        names.append(f"x {name} y")
    for letters in secret_scan.ALPHABETS:
        for n in (24, 40, 64, 100):
            tokens += [(letters, n, "x " + "".join(rng.choice(letters) for _ in range(n)) + " y") for _ in range(25)]
    docs = documents(spark, list(enumerate(names + [t for *_, t in tokens])))
    found = {r.doc_id for r in secret_scan.secret_spans(docs).collect() if any(s.kind in ("random", "hex") for s in r.secrets)}
    assert len([d for d in found if d < len(names)]) <= 0.001 * len(found) + 1
    hits = Counter((a, n) for i, (a, n, _) in enumerate(tokens) if i + len(names) in found)
    # Digits alone cannot be told from numbers.
    assert all(hits[a, n] >= (15 if n == 24 else 20 if n == 40 else 24) for a in secret_scan.ALPHABETS[1:] for n in (24, 40, 64, 100)), hits


POLISH = "wszystko dobrze jest tylko kiedy człowiek pracuje razem przez cały dzień nasze miasto było bardzo piękne wieczorem stary zegar odpowiada najlepszy czas szybko zawsze droga wolność powietrze krzyk przyszłość wrzesień szczotka".split()
GERMAN = "geschwindigkeit verwaltung rechnung schifffahrt gesellschaft wirtschaft entwicklung zusammenarbeit bedeutung verschiedene werden zwischen sprache schreiben hoffnung".split()
ENGLISH = "request handler session buffer encode decode value index parser stream network socket thread connect timeout config manager service database result update AES256 SHA512 SQL HTTP UTF8 get set".split()


def test_op6_ordinary_long_tokens_are_left_alone(spark):
    """Compounds, identifiers, paths and UUIDs of a table that also holds their words; at most a hundredth of the finds is false."""
    rng = random.Random(21)
    many = lambda w, n: [rng.choice(w) for _ in range(n)]
    fold = str.maketrans("ąćęłńóśźż", "acelnoszz")
    calm = ["".join(x.translate(fold).capitalize() for x in many(POLISH, 4)) for _ in range(150)] + ["".join(many(GERMAN, 3)) for _ in range(150)]
    calm += ["_".join(many(ENGLISH, 5)) for _ in range(150)] + ["".join(x.capitalize() for x in many(ENGLISH, 5)) for _ in range(150)] + ["/".join(["", *many(ENGLISH, 6)]) for _ in range(150)]
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    calm += ["-".join(map(hexes, (8, 4, 4, 4, 12))) for _ in range(150)]
    tokens = ["".join(rng.choice(secret_scan.ALPHABETS[9]) for _ in range(n)) for n in (40, 64) for _ in range(100)]
    prose = [" ".join(many(w, 60)).translate(fold) for w in (POLISH, GERMAN, ENGLISH) for _ in range(60)]
    docs = documents(spark, list(enumerate([f"see {t} there" for t in calm + tokens] + prose)))
    found = {r.doc_id for r in secret_scan.secret_spans(docs).collect() if r.secrets}
    false = [calm[d] for d in found if d < len(calm)]
    hits = sum(len(calm) <= d < len(calm) + len(tokens) for d in found)
    assert len(false) <= 0.01 * len(found) and hits >= 195, (false[:9], len(false), hits)


def test_op6_odd_tables(spark):
    rng = random.Random(15)
    token = "".join(rng.choice(secret_scan.ALPHABETS[9]) for _ in range(60))
    long = "word " * 200_000 + f"password=abcdefgh1 {token} " + "z" * 100_000
    docs = documents(spark, [(1, long), (1, long), (2, None), (3, "")])
    got = secret_scan.secret_spans(docs).collect()
    assert sorted((r.doc_id, [s.kind for s in r.secrets]) for r in got) == [(1, ["assign", "random"])] * 2 + [(2, []), (3, [])]
    assert secret_scan.secret_spans(docs.limit(0)).count() == secret_scan.redact(docs.limit(0)).count() == 0


def test_op6_redaction_keeps_rows_and_columns(spark):
    docs = documents(spark, [*ODD, (30, "é password=abcdefgh123 tail")])
    out = secret_scan.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("doc_id = 30").first()["text"] == "é [SECRET] tail"
    assert out.where("doc_id = 30").first()["n_chars"] == len("é [SECRET] tail")
    assert out.where("doc_id = 1").first()["text"] is None
    assert secret_scan.secret_spans(docs.withColumn("secrets", F.lit(1))).where("doc_id = 30").first()["secrets"][0]["kind"] == "assign"


# 7


def plain_ppm(texts, order):
    counts = [{} for _ in range(order + 1)]
    for t in texts:
        d = bytes(order) + t + b"\0"
        for i in range(order, len(d)):
            for k in range(order + 1):
                counts[k].setdefault(d[i - k : i], Counter())[d[i]] += 1

    def score(t):
        d, total = bytes(order) + t + b"\0", 0.0
        for i in range(order, len(d)):
            out = set()
            for k in range(order, -1, -1):
                seen = counts[k].get(d[i - k : i])
                if seen is None:
                    continue
                left = {c: n for c, n in seen.items() if c not in out}
                whole = sum(left.values()) + len(left)
                if d[i] in left:
                    total += math.log10(left[d[i]] / whole)
                    break
                total += math.log10(len(left) / whole) if left else 0
                out |= set(seen)
            else:
                total -= math.log10(256 - len(out))
        return total

    return score


def all_runs(texts):
    return np.concatenate([packed for packed, _ in lm_scoring._runs(texts)])


def test_op7_equals_plain_model(spark):
    rng = random.Random(17)
    rows = [(i, prose(rng, rng.randint(0, 60)).upper() if i % 5 == 0 else prose(rng, rng.randint(0, 60))) for i in range(40)] + [(90, None), (91, "é\x1cü"), (92, "same text"), (92, "same text"), (93, "ze\0ro\0"), (94, "\0"), (95, "ab " * 20_000)]
    docs = documents(spark, rows)
    got = lm_scoring.lm_scores(docs, F.col("doc_id") % 10 != 0, frequent_words=50).collect()
    assert len(got) == len(rows)
    low = lambda t: (t or "").encode().lower()
    train = [low(t) for d, t in rows if d % 10]
    model, counts = plain_ppm(train, lm_scoring.ORDER), Counter(w for t in train for w in t.split())
    total, kinds, ends = sum(counts.values()) + len(train), len(counts) + 1, len(train)
    price = lambda n: math.log10((n + 0.1) / (total + 0.1 * (kinds + 1)))
    for r in got:
        text = low(dict(rows)[r.doc_id])
        own = text.split()
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own) + 1, sum(counts[w] > 0 for w in own) + 1, total)
        assert r.base_score == pytest.approx(sum(price(counts[w]) for w in own) + price(ends))
        assert r.score == pytest.approx(model(text))


def test_op7_probabilities_add_up(spark):
    texts = [t.encode() for _, t in enumerate(vocabulary()[:300])]
    runs, n = np.unique(all_runs(texts), return_counts=True)
    for least in (1, 3):
        trie = lm_scoring.Trie(runs, n, least)
        for context in (b"\0\0\0\0\0", b"abcde", b"zzzzz", b"\0\0\0ab"):
            high = int.from_bytes(context, "big") << 8
            assert (10 ** trie.log10(high | np.arange(256))).sum() == pytest.approx(1)


def test_op7_learns_every_run(spark):
    """Over two million distinct runs, each seen once, in many chunks and buckets."""
    rng = np.random.default_rng(18)
    rows = [(i, rng.integers(97, 123, 75_000, np.uint8).tobytes().decode()) for i in range(30)] + [(30, prose(random.Random(18), 200))]
    got = {r.doc_id: r.score for r in lm_scoring.lm_scores(documents(spark, rows), F.col("doc_id") % 10 != 0).collect()}
    runs, n = np.unique(all_runs([t.encode() for d, t in rows if d % 10]), return_counts=True)
    assert len(runs) > 2_000_000
    trie = lm_scoring.Trie(runs, n)
    for d in (0, 1, 20, 30):
        assert got[d] == pytest.approx(trie.log10(all_runs([rows[d][1].encode()])).sum())


def test_op7_chunks_and_buckets_change_nothing(spark, monkeypatch):
    rng = random.Random(19)
    docs = documents(spark, [(i, prose(rng, rng.randint(0, 60))) for i in range(60)]).repartition(3)
    want = sorted(map(tuple, lm_scoring.lm_scores(docs, F.col("doc_id") % 10 != 0).collect()))
    monkeypatch.setattr(lm_scoring, "CHUNK", 700)
    monkeypatch.setattr(lm_scoring, "STEP", 13)
    got = sorted(map(tuple, lm_scoring.lm_scores(docs, F.col("doc_id") % 10 != 0).collect()))
    assert [r[0] for r in got] == [r[0] for r in want] and all(a == pytest.approx(b) for a, b in zip(got, want, strict=True))


def test_op7_hashes_are_those_of_spark(spark):
    words_ = ["", "a", "é", "漢字", "x" * 100, *vocabulary()[:50]]
    got = {r.w: r.h for r in spark.createDataFrame([(w,) for w in words_], "w string").selectExpr("w", "xxhash64(cast(w as binary)) as h").collect()}
    numbers = lm_scoring.WordNumbers()
    assert all(np.uint64(numbers[w.encode()]).view(np.int64) == got[w] for w in words_)


def test_op7_nothing_to_learn(spark):
    got = lm_scoring.lm_scores(documents(spark, [(1, "ab"), (2, None)]), F.lit(False)).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in got] == [(2, 0, 0), (1, 0, 0)]
    assert [r.score for r in got] == pytest.approx([-3 * math.log10(256), -math.log10(256)])
    assert lm_scoring.lm_scores(documents(spark, []), F.lit(True)).count() == 0


# 8


def test_op8_equals_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    rng = random.Random(19)
    odd = "abc ABC éÉßΣσ'’sdtll \n\t\x1c\x85\xa0　½²123 é 漢字 İ !?_#|<> 😀 ofthe ing tion"
    texts = [t for _, t, *_ in table(spark, "documents")[:60]]
    texts += ["".join(rng.choice(odd) if rng.random() < 0.9 else rng.choice(["<|endoftext|>", "<|startoftext|>", "'re", "'ll"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += [None, "", "   ", "x" * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    coded = bpe.encode(docs, bpe.default_path())
    for r in bpe.decode(coded, bpe.default_path()).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.input_ids == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False)


def test_op8_very_long_words(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    texts = ["x" * 200_000, "ab" * 60_000, "thing" * 30_000, "Z" * 70_000 + " end"]
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string").withColumn("input_ids", F.lit("clash"))
    began = time.monotonic()
    got = bpe.encode(docs, bpe.default_path()).collect()
    assert time.monotonic() - began < 120
    assert len(got) == 5 and all(r.input_ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids for r in got)
    assert bpe.encode(docs.limit(0), bpe.default_path()).count() == 0


def test_op8_digests(spark):
    ids = {r.doc_id: r.input_ids for r in bpe.encode(spark.read.parquet(f"{SF}/documents.parquet"), bpe.default_path()).collect()}
    for r in bpe.op8_bpe(spark, SF).collect():
        assert r.n_tokens == len(ids[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{r.n_tokens}I", *ids[r.doc_id])).hexdigest()


def test_op8_cuts_change_nothing():
    made = bpe.load(bpe.default_path())
    for word in ("thtionsing", "zqxjvk", "élan", "hello", "x", "qzqz's"):
        whole = "".join(made.characters[b] for b in word.encode()) + made.end
        assert [i for f in made.cut(word) for i in made.merged(f)] == made.merged(whole)


# 9

PAGE = (
    '<html><head><title>T</title><style>p{{}}</style></head><body class="has-sidebar"><div class="site-header"><a>Home</a></div><nav>x</nav><div id="cookie-notice">cookies!</div>'
    '<main><div class="content with-sidebar"><h1>Head &amp; line {0}</h1><p>One <b>two</b>\nthree&nbsp;four {0}<p>Five<ul><li>a{0}<li>b{0}</ul><div class="ad">buy</div><form><p>in form</p></form>'
    "<table><tr><td>c1<td>c2{0}</table><script>if(a<b){{'</p>'}}</script><blockquote>q{0}</blockquote><div><p>Read our terms</p></div></div></main>"
    "<aside>s</aside><section id=comments><p>c</p></section><footer>f</footer></body>"
)


def test_op9_main_text_and_templates(spark):
    rows = [(i, f"https://www.one.example/{i}", PAGE.format(i)) for i in range(12)] + [(50, "http://two.example:80/", PAGE.format("x")), (51, None, None), (52, "x", ""), (53, "x", "<p>bare <i>te</i>xt<")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in html_extraction.main_text(pages).collect()}
    assert got[3].text == "Head & line 3\nOne two three four 3\na3\nb3\nc23\nq3"
    assert got[50].text.endswith("qx\nRead our terms") and "\nFive\n" in got[50].text
    assert (got[51].text, got[51].n_chars, got[52].text) == ("", 0, "")
    assert got[53].text == "bare text<"
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_extraction.main_text(pages.limit(0)).count() == 0


def test_op9_copies_are_one_page(spark, monkeypatch):
    rows = [(i, "https://one.example/", PAGE.format("x")) for i in range(12)] + [(20 + i, "https://one.example/", PAGE.format(i)) for i in range(3)]
    rows += [(40 + i, "https://two.example/", f"<html><body><article><p>Same words<p>but one</article><i>{i}</i></body></html>") for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    for limit in (html_extraction.BROADCAST_ROWS, -1):
        monkeypatch.setattr(html_extraction, "BROADCAST_ROWS", limit)
        got = {r.page_id: r.text for r in html_extraction.main_text(pages).collect()}
        assert got[0] == got[11] == "Head & line x\nOne two three four x\nFive\nax\nbx\nc1\nc2x\nqx\nRead our terms"
        assert got[20].endswith("Read our terms")
    node = html_extraction.parse("<html><body><article><p>Same words</article></body></html>")
    every = frozenset(n.hash for n in html_extraction.hashed(node) if n.tag in ("html", "body", "article"))
    assert html_extraction.extract("<html><body><article><p>Same words</article></body></html>", every) == "Same words"


@pytest.mark.parametrize("name", ["page-with-sidebar", "layout-no-sidebar", "content-has-sidebar", "wrap_without_nav", "site-overlay", "with-left-sidebar"])
@pytest.mark.parametrize("top", ["article", "main"])
def test_op9_names_keep_the_article(name, top):
    page = f'<body><div class="{name}"><{top}><p>Whole text</{top}><div class="left-sidebar">s</div></div>'
    assert html_extraction.extract(page) == "Whole text"


def test_op9_names_still_drop():
    teasers = '<div class="related-posts"><article>teaser</article></div><div class="right-sidebar">s</div>'
    assert html_extraction.extract(f"<body><article>One</article>{teasers}") == "One"
    assert html_extraction.extract(f"<body><p>Bare</p>{teasers.replace('article', 'p')}") == "Bare"


def test_op9_keeps_what_an_article_holds():
    page = '<article><div class="entry-header"><h1>Title</h1></div><div id="post-header">By</div><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be<svg><style>s{}</style><text>drawn</text></svg><p><object>one</object> <canvas>two</canvas> <map>three</map><div class="ad">buy</div></article>'
    assert html_extraction.extract(page) == "Title\nBy\nLet x=2 be\ndrawn\none two three"


def test_op9_join_beyond_broadcast(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"https://h{i % 2}.example/{i}", PAGE.format(i)) for i in range(40)], "page_id long, url string, html string")
    want = sorted(map(tuple, html_extraction.main_text(pages).collect()))
    monkeypatch.setattr(html_extraction, "BROADCAST_ROWS", -1)
    assert sorted(map(tuple, html_extraction.main_text(pages).collect())) == want


MENUS = [("news", "sport", "weather"), ("one", "two", "three", "four"), ("a page", "another"), ("far", "away")]


def site(i, article):
    """A page of a site whose notice and advert recur in words, and whose menu recurs in shape alone."""
    menu = "".join(f'<li><a href="/{w}{i}">{w} {i}</a></li>' for w in MENUS[i % 4] * (1 + i % 3))
    body = f'<h1>Title {i}</h1><p>Text {i} of it.</p><div class="x7">Buy one, get none</div><ul><li><a href="/s{i}">source {i}</a></li><li><a href="/t{i}">other source {i}</a></li></ul><p>End {i}.</p>'
    inner = f"<article>{body}</article>" if article else f"<div>{body.replace('<ul>', '<p>').replace('</ul>', '</p>').replace('<li>', '').replace('</li>', ' ')}</div>"
    return f'<html><body><div class="q1"><ul>{menu}</ul></div><div class="q2">We keep crumbs. <b>Fine</b></div>{inner}<div class="q3"><p>All rights kept</p></div><script>var x = "<p>{i}</p>"</script></body></html>'


@pytest.mark.parametrize("article", [True, False])
def test_op9_recurrence_alone(spark, article):
    """With all lists of elements and names off: menus, notices and adverts, with and without an article."""
    pages = spark.createDataFrame([(i, f"https://h.example/{i}", site(i, article)) for i in range(24)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extraction.main_text(pages, lists=False).collect()}
    sources = "\nsource {0}\nother source {0}" if article else "\nsource {0} other source {0}"
    assert all(got[i] == ("Title {0}\nText {0} of it." + (sources if article else "") + "\nEnd {0}.").format(i) for i in got) and len(got) == 24
    plain = {i: html_extraction.extract(site(i, article), lists=False) for i in range(24)}
    assert all("Buy one" in t and (article or ("All rights" in t and "We keep" in t)) for t in plain.values())
    few = spark.createDataFrame([(i, f"https://h.example/{i}", site(i, article)) for i in range(7)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extraction.main_text(few, lists=False).collect()} == {i: plain[i] for i in range(7)}


def test_op9_lists_of_links_in_a_text_stay(spark):
    """A list of links that has the shape of the menu, but not its place, on a third of the pages."""
    menu = "<nav><ul><li><a>one {0}</a></li><li><a>two {0}</a></li></ul></nav>"
    sources = "<ul><li><a>source {0}</a></li><li><a>other {0}</a></li></ul>"
    pages = [f"<body>{menu}<div><p>Text {{0}}</p>{sources if i % 3 == 0 else ''}</div>".format(i) for i in range(24)]
    df = spark.createDataFrame([(i, "https://h.example/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extraction.main_text(df, lists=False).collect()}
    assert got == {i: f"Text {i}" + (f"\nsource {i}\nother {i}" if i % 3 == 0 else "") for i in range(24)}


def test_op9_templates_work_on_the_given_pages(spark):
    """On hosts of eight pages or more every menu goes by recurrence, and the text stays what lists alone make of it."""
    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    with_host = {r.page_id: (r.host, r.html) for r in pages.select("page_id", "html", html_extraction.host_of(F.col("url")).alias("host")).collect()}
    many = {h for h, n in Counter(h for h, _ in with_host.values()).items() if n >= html_extraction.MIN_PAGES}
    body = pages.withColumn("html", F.regexp_replace("html", "</?article[^>]*>", " "))
    bare = {r.page_id: r.text for r in html_extraction.main_text(body, lists=False).collect()}
    off = {i: html_extraction.extract(html.replace("<article>", " ").replace("</article>", " "), lists=False) for i, (_, html) in with_host.items()}
    changed = {i for i in off if off[i] != bare[i]}
    assert changed == {i for i, (h, _) in with_host.items() if h in many} and changed
    full = {r.page_id: r.text for r in html_extraction.op9_html_extraction(spark, sf).collect()}
    assert full == {i: html_extraction.extract(html) for i, (_, html) in with_host.items()}


def test_op9_slash_closes_no_element():
    assert html_extraction.extract('<body><div class="ad"/>buy</div><p>Text<br/>more</p><p><svg/>end') == "Text more\nend"


def test_op9_odd_pages(spark):
    long = "<p>word &amp; word</p>" * 60_000
    rows = [(1, None, f"<article>{long}</article>"), (1, None, f"<article>{long}</article>"), (2, None, "<article>x"), (3, "", "<"), (4, "no url", "&lt;b&gt;"), (None, "https://h/", "<b>null id</b>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("hashes", F.lit(2))
    got = sorted((r.page_id or 0, r.text) for r in html_extraction.main_text(pages).collect())
    assert got == [(0, "null id"), *[(1, "\n".join(["word & word"] * 60_000))] * 2, (2, "x"), (3, "<"), (4, "<b>")]


def test_op9_given_pages(spark):
    for r in html_extraction.op9_html_extraction(spark, SF).collect():
        assert r.text and "<" not in r.text.replace("<|", "") or r.text == ""


# 10


def test_op10_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in quality_classifier.op10_quality_classifier(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    held = [r for r in labels if r.doc_id in got and got[r.doc_id].held_out and r.quality is not None]
    assert sum(got[r.doc_id].predicted == r.quality for r in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())


def plain_leader(rows, passes):
    """The published per-coordinate update, with dictionaries."""
    z, n = Counter(), Counter()
    weight = lambda i: 0.0 if abs(z[i]) <= quality_classifier.L1 else -(z[i] - math.copysign(quality_classifier.L1, z[i])) / ((quality_classifier.BETA + math.sqrt(n[i])) / quality_classifier.ALPHA + quality_classifier.L2)
    for _ in range(passes):
        for x, label in rows:
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - label) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality_classifier.ALPHA * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z}


def test_op10_update_rule():
    rng = random.Random(43)
    rows = [({i: rng.random() for i in rng.sample(range(30), 8)}, rng.randint(0, 1)) for _ in range(80)]
    leader = quality_classifier.Leader(31)
    for _ in range(3):
        for x, label in rows:
            leader.learn(np.array(list(x)), np.array(list(x.values())), label)
    want = plain_leader([(x | {30: 1.0}, label) for x, label in rows], 3)
    assert leader.weights() == pytest.approx(np.array([want[i] for i in range(31)]))


def test_op10_query_equals_plain_training(spark):
    """Weights and scores of the query from features counted anew, in the order of the query."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.doc_id in docs and r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    order = np.argsort(common.mix(np.array([d for d, _ in labels], np.int64).view(np.uint64)), kind="stable")
    make = lambda t: dict(zip(*(a.tolist() for a in quality_classifier.features(t.encode(), common.WordHashes(), quality_classifier.Shapes())), strict=True))
    bias = 1 << quality_classifier.BITS
    want = plain_leader([(make(docs[labels[i][0]]) | {bias: 1.0}, labels[i][1]) for i in order], quality_classifier.PASSES)
    got = {r.doc_id: r.score for r in quality_classifier.op10_quality_classifier(spark, SF).collect()}
    for d in list(docs)[:60]:
        plain = 1 / (1 + math.exp(-sum(want.get(i, 0) * v for i, v in make(docs[d]).items()) - want[bias]))
        assert got[d] == pytest.approx(plain, abs=1e-4)


def test_op10_bound_of_features(spark):
    docs = documents(spark, [(i, prose(random.Random(i), 60)) for i in range(200)]).withColumn("label", F.lit(9)).withColumn("place", F.lit(9))
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    assert quality_classifier.train(docs, labels, features_=4000).any()
    assert quality_classifier.score(docs.limit(0), np.zeros((1 << quality_classifier.BITS) + 1, np.float32)).count() == 0


def test_op10_odd_input(spark):
    docs = documents(spark, ODD)
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (6, None)], "doc_id long, quality int")
    got = quality_classifier.score(docs, quality_classifier.train(docs, labels)).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    empty = quality_classifier.train(docs.limit(0), labels.limit(0))
    assert not empty.any()


# Registry


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(SQL) <= set(QUERIES)


def test_shared_dir_without_the_setting(monkeypatch):
    """Spark does not let the setting be changed, so the folder is kept by the process and is the same at each call."""
    from types import SimpleNamespace

    from candlewright.llm import common

    monkeypatch.setattr(common, "_MADE", [])
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d), sparkContext=SimpleNamespace(master="local[2]"))
    assert common.shared_dir(session) == common.shared_dir(session)
    session.sparkContext.master = "spark://host:7077"
    with pytest.raises(ValueError):
        common.shared_dir(session)


def test_op10_shapes_and_repeats_are_whole():
    from candlewright.llm.quality_classifier import Shapes, WordHashes, features, shape

    assert shape(b"a1b2c3d4e5f6") == b"x9x9x9x9x9x9"
    many, more = (features(b"a b " * n, WordHashes(), Shapes()) for n in (100, 1000))
    assert set(many[0]) != set(more[0])


def test_op5_numbers_in_other_forms_are_no_letters():
    assert not any(language_id._LETTER.search(t) for t in ("½ ² ① 12 _", "", "٣", "Ⅷ !"))
    assert all(language_id._LETTER.search(t) for t in ("1 é", "日", "ʰ", "ª"))


def test_op9_templates_by_brute_force(spark, monkeypatch):
    """Subtrees counted host by host over distinct pages; the join by parts of a host gives what the broadcast does."""
    rng = random.Random(31)
    menu = lambda h, k: f"<nav><ul>{''.join(f'<li><a href=/{i}>{h} part {i}</a></li>' for i in range(k))}</ul></nav>"
    pages = []
    for h, n in (("a.com", 30), ("b.com", 9), ("c.com", 7), ("d.com", 20)):
        for i in range(n):
            body = "".join(f"<p>{' '.join(rng.choice(['rain', 'wind', 'sun', 'snow', str(rng.randint(0, 99))]) for _ in range(12))}</p>" for _ in range(3))
            end = "<div>all rights are with us</div>" if i % 3 else ""
            pages.append((len(pages), f"http://{h}/{i}", f"<html><body>{menu(h, 4)}<div>{body}</div>{end}</body></html>"))
    pages += [(900 + i, "http://d.com/0", pages[-1][2]) for i in range(12)] + [(950, None, None), (951, "x", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    want = set()
    for host in ("a.com", "b.com", "c.com", "d.com", ""):
        own = {h or "" for _, u, h in pages if (f"//{host}/" in (u or "") if host else "//" not in (u or ""))}
        held = Counter()
        for page in own:
            nodes = [n for n in html_extraction.hashed(html_extraction.parse(page)) if n.tag != "#root" and n.tag not in html_extraction.INLINE]
            held.update({h for n in nodes for h in (n.hash, n.shape) if h})
        want |= {(host, h) for h, n in held.items() if n >= html_extraction.MIN_PAGES and n >= html_extraction.MIN_SHARE * len(own)}
    assert {(r.host, r.hash) for r in html_extraction.site_templates(df).collect()} == want and {h for h, _ in want} == {"a.com", "b.com", "d.com"}
    sent = sorted(map(tuple, html_extraction.main_text(df).collect()), key=repr)
    monkeypatch.setattr(html_extraction, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, html_extraction.main_text(df).collect()), key=repr) == sent
    assert not any("part 1" in r[2] for r in sent if r[1] and "a.com" in r[1])


def test_op10_very_long_text_and_the_threshold(spark):
    """A text of a million words is scored whole, repeated rows alike, and a score of exactly the threshold counts as good."""
    weights = np.zeros((1 << quality_classifier.BITS) + 1, np.float32)
    long = "word " * 999_999
    place, value = quality_classifier.features((long + "marker").encode(), quality_classifier.WordHashes(), quality_classifier.Shapes())
    only = set(place) - set(quality_classifier.features(long.encode(), quality_classifier.WordHashes(), quality_classifier.Shapes())[0])
    weights[sorted(only)] = 1e6
    docs = documents(spark, [(1, long), (2, long + "marker"), (3, "word"), (3, "word"), (4, None)])
    got = sorted((r.doc_id, r.score) for r in quality_classifier.score(docs, weights).collect())
    assert [d for d, _ in got] == [1, 2, 3, 3, 4] and got[0][1] == 0.5 and got[1][1] > 0.99 and got[2] == got[3]
    weights[:] = 0
    weights[-1] = math.log(0.7 / 0.3)
    scores = quality_classifier.score(docs, weights).withColumn("predicted", (F.col("score") >= quality_classifier.THRESHOLD).cast("int"))
    assert all((r.score >= 0.7) == bool(r.predicted) for r in scores.collect())


def test_op5_columns_of_any_name(spark):
    """Extra columns named as the result's, or as helpers, are not looked at."""
    rows_ = [(i, "le chat est ici " * 9, "fr") for i in range(40)] + [(100 + i, "the cat is here " * 9, "en") for i in range(40)]
    plain = spark.createDataFrame(rows_, "doc_id long, text string, lang string")
    odd = plain.withColumns({c: F.lit("x") for c in ("share", "score", "lang_pred", "held_out", "bytes", "count")})
    want = sorted(map(tuple, language_id.identify(plain, language_id.train(plain)).select("doc_id", "lang_pred").collect()))
    assert sorted(map(tuple, language_id.identify(odd, language_id.train(odd)).select("doc_id", "lang_pred").collect())) == want
