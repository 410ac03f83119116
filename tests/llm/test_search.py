"""op11, op12 and op13 against brute force, on fixtures of odd input and on the given tables' SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from candlewright.llm import prefix_trie as P
from candlewright.llm import ranked_search as R
from candlewright.llm import topk_search as T
from candlewright.llm.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_ranked_search", "op13_topk_search"])
def test_equals_sql(name, spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF), con.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(got.select(*want.columns).collect()) == sorted(want.fetchall())


# op13


def ranked(rows, queries, k, own=False):
    """All scores of every query; None ids last among equals."""
    out = []
    for q, vector in sorted({(q, tuple(v.items())) for q, v in queries if q is not None}):
        found = [(-sum(w * c.get(t, 0) for t, w in vector), i is None, i) for i, c in rows if own or i != q]
        out += [(q, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found)[:k])]
    return out


def sparse(spark, rows):
    cells = [(i, list(v), [float(x) for x in v.values()]) for i, v in rows]
    return spark.createDataFrame(cells, "id long, terms array<long>, vals array<double>")


@pytest.mark.parametrize("send", [0, 1 << 26])
def test_op13_sparse_vectors_and_packs(spark, send, monkeypatch):
    """Signed sparse vectors, repeated rows, empty ones, null ids; several shards and packs, sent or shuffled."""
    draw = random.Random(3)
    rows = [(i, {t: draw.choice([-3, -1, 1, 2, 7]) for t in draw.sample(range(40), draw.randint(0, 8))}) for i in range(300)]
    rows += [(None, {1: 7, 2: 7}), (None, {1: 7, 2: 7}), (300, {}), (301, {5: 1}), (301, {5: 1})] + [(400 + i, {0: 5, 1: 5}) for i in range(100)]
    monkeypatch.setattr(T, "PACK_QUERIES", 9)
    queries = [(q, v) for q, v in rows if q is None or q % 10 == 0] + [(1000, {99: 4}), (1001, {0: 3, 1: -2})]
    got = T.top_k(sparse(spark, rows).repartition(5), sparse(spark, queries), 7, broadcast_bytes=send)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(ranked(rows, queries, 7), key=repr)


def test_op13_shard_prunes_and_stays_exact():
    """A shard finds what all scores say, also where a score to beat is given, and passes over most of a sparse shard."""
    draw = np.random.default_rng(5)
    dense = draw.integers(-90, 90, (2000, 48)) * (draw.random((2000, 48)) < 0.2)
    row, term = np.nonzero(dense)
    shard = T.Shard(np.arange(2000), np.cumsum(np.bincount(row, minlength=2000)), term.astype(np.int64), dense[row, term].astype(float))
    probed = []
    add = shard._add
    shard._add = lambda t, w, rows, scores: (probed.append(len(rows)), add(t, w, rows, scores))
    for q in range(0, 2000, 100):
        terms = np.flatnonzero(dense[q])
        scores = dense @ dense[q]
        order = [i for i in np.lexsort((np.arange(2000), -scores)) if i != q]
        for beat in (-np.inf, float(scores[order[2]])):
            rows, found = shard.search(terms, dense[q][terms].astype(float), 5, q, beat)
            keep = [i for i in order[:5] if scores[i] >= beat]
            assert rows.tolist()[: len(keep)] == keep and found.tolist()[: len(keep)] == scores[keep].tolist()
    assert probed and np.mean(probed) < 1000


def test_op13_odd_vectors(spark, tmp_path):
    """Null, empty, non-finite and huge components; the widest scores are exact, and what a long cannot hold is an error."""
    vectors = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, []), (6, [-0.001, 0.0]), (7, [1.0, 2.0]), (None, [9.0, 9.0]), (7, [1.0, 2.0])]
    schema = "vec_id long, embedding array<float>, label int, id string, vals string"
    spark.createDataFrame([(i, v, 0, "x", "y") for i, v in vectors], schema).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(map(tuple, QUERIES["op13_topk_search"](spark, str(tmp_path)).collect()))
    assert got == [(0, 1, None, 256 * 9 * 256 + 512 * 9 * 256), (0, 2, 7, 327680), (0, 3, 7, 327680), (0, 4, 5, 0), (0, 5, 6, -256)]
    wide = [(0, {0: 2**30 - 1, 1: 3}), (1, {0: 2**30, 1: 5}), (2, {0: 2**30, 1: 6})]
    assert [tuple(r) for r in T.top_k(sparse(spark, wide), sparse(spark, wide[:1]), 2).orderBy("rank").collect()] == ranked(wide, wide[:1], 2)
    with pytest.raises(Exception, match="OverflowError"):
        T.top_k(sparse(spark, [(1, {0: 2**50})]), sparse(spark, [(0, {0: 2**50})]), 2).collect()


def test_op13_empty_table(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert QUERIES["op13_topk_search"](spark, str(tmp_path)).collect() == []


# op12


def said(text):
    small = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", small)


def lexical(docs, items, k=20):
    """Ranks by scoring every document for every item."""
    split = [(d, Counter(said(t))) for d, t in docs if said(t)]
    total, length = len(split), sum(sum(c.values()) for _, c in split)
    df = Counter(t for _, c in split for t in c)
    out = []
    for item, text in sorted(set(items), key=repr):
        asked, found = Counter(said(text)), []
        for d, c in split:
            m = 75 + (25 * sum(c.values()) * total) // length
            score = sum(q * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in asked.items() if c[t])
            if score > 0:
                found.append((-score, d is None, d))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def texts_of(spark, tmp_path, docs, items):
    spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, n long, terms string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("shape", ["one tree", "small trees"])
def test_op12_brute_force(spark, tmp_path, monkeypatch, shape):
    """Ties, repeats, nulls, empty and very long texts, unequal cases and scripts; shards of 64 rows, trees of 20 terms, passes of 60."""
    if shape == "small trees":
        for name, value in (("SHARD_ROWS", 64), ("LEAF_ROWS", 3), ("TREE_TERMS", 20), ("PASS_TERMS", 60), ("GROUPS", 4)):
            monkeypatch.setattr(R, name, value)
    draw = random.Random(9)
    words = ["Alpha", "beta", "gamma7", "émile", "ÉMILE", "naïve", "\u65e5\u672c", "x", "K\u212a"] + [f"w{i}" for i in range(60)]
    docs = [(i, draw.choice(" ,-_\n").join(draw.choices(words, k=draw.randint(1, 40)))) for i in range(400)]
    docs += [(900 + i, "same text about Beta and x") for i in range(60)] + [(5, docs[5][1]), (None, "alpha beta x"), (1000, None), (1001, ""), (1002, "!?"), (1003, "x " * 50000)]
    items = [(i, " ".join(draw.choices(words, k=12))) for i in range(25)] + [(1, "beta beta X"), (1, "beta beta X"), (1, "émile"), (None, "alpha"), (50, None), (51, ""), (52, "unheard")]
    got = QUERIES["op12_ranked_search"](spark, texts_of(spark, tmp_path, docs, items)).collect()
    assert sorted(map(tuple, got), key=repr) == lexical(docs, items)


def test_op12_tree_prunes():
    """The best of 4,000 rows in four vocabularies: as by scoring all, with less than half of the leaves."""
    draw = np.random.default_rng(2)
    n, width = 4000, 400
    chance = np.full((n, width), 0.002)
    for i in range(n):
        chance[i, i % 4 * 100 : i % 4 * 100 + 100] = 0.1
    cells = draw.integers(1, 10**9, (n, width)) * (draw.random((n, width)) < chance)
    row, column = np.nonzero(cells)
    tree = R.Tree(np.arange(n), np.cumsum(np.bincount(row, minlength=n)), column, cells[row, column], width)
    opened = 0
    for q in range(20):
        asked = np.sort(draw.choice(100, 12, replace=False)) + 100 * (q % 4)
        times = draw.integers(1, 3, 12)
        scores = cells[:, asked] @ times
        ids, found, leaves = tree.search(asked, times, 20, 1)
        order = np.lexsort((np.arange(n), -scores))[:20]
        best = np.lexsort((ids, -found))[:20]
        assert ids[best].tolist() == order.tolist() and found[best].tolist() == scores[order].tolist()
        opened += leaves
    assert opened < 20 * (1 << tree.levels[-1]) / 2


def test_op12_empty_tables(spark, tmp_path):
    assert QUERIES["op12_ranked_search"](spark, texts_of(spark, tmp_path / "a", [], [(1, "a")])).collect() == []
    assert QUERIES["op12_ranked_search"](spark, texts_of(spark, tmp_path / "b", [(1, "a")], [])).collect() == []


# op11


def trie(turns):
    """Every node by listing every prefix of every rebuilt conversation."""
    own = {}
    for c, turn, role, text in turns:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(own.get(c - c % 100, [])[:h] + v[h:])
    members = {}
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(c)
    kids, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if rebuilt[c] == p)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def spoken(seed, n=260):
    """Few texts, so that conversations share starts, are starts of others, or are equal; missing bases and turns."""
    draw = random.Random(seed)
    turns = []
    for c in [*range(0, n), *range(700, 760)]:
        if c == 100:
            continue
        for t in range(draw.choice([1, 2, 3, 8, 8, 12])):
            turns.append((c, t, draw.choice(["user", "assistant"]), draw.choice(["a", "b", "\u00e9\u65e5", ""])))
    turns += [(c, t, "user", f"copy {t}") for c in range(1000, 1100) for t in range(9)]
    turns += [(5, None, None, "no turn"), (6, 0, None, None), (None, 1, "user", "lost"), (300, 1, "user", "alone")]
    draw.shuffle(turns)
    return turns


def talk(spark, tmp_path, turns):
    schema = "conv_id long, turn long, role string, text string, keys string, part long"
    spark.createDataFrame([(*t, "x", 1) for t in turns], schema).repartition(4).write.parquet(str(tmp_path / "conversations.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("rows, turns, send", [(50_000, 400_000, 200_000), (7, 400_000, 200_000), (50_000, 20, 0), (1, 1, 200_000)])
def test_op11_brute_force(spark, tmp_path, monkeypatch, rows, turns, send):
    """One chunk a partition, chunks of few conversations or turns, shared nodes sent or shuffled."""
    for name, value in (("CHUNK_ROWS", rows), ("CHUNK_TURNS", turns), ("BROADCAST_NODES", send)):
        monkeypatch.setattr(P, name, value)
    data = spoken(rows + turns)
    got = QUERIES["op11_prefix_trie"](spark, talk(spark, tmp_path, data)).collect()
    assert sorted(map(tuple, got), key=repr) == trie(data)


def test_op11_long_conversation_and_ties(spark, tmp_path):
    """Many turns, twice; turns of one number in the order of role and text; equal rows are turns of their own."""
    data = [(c, t, "user", f"t{t % 7}") for c in (1, 2) for t in range(150)]
    data += [(3, 1, "b", "x"), (3, 1, "a", "z"), (3, 1, "a", "y"), (3, 1, "a", "y"), (4, 0, "user", "word " * 100_000)]
    got = QUERIES["op11_prefix_trie"](spark, talk(spark, tmp_path, data)).collect()
    assert sorted(map(tuple, got), key=repr) == trie(data)


def test_op11_empty_table(spark, tmp_path):
    assert QUERIES["op11_prefix_trie"](spark, talk(spark, tmp_path / "a", [])).collect() == []
    assert QUERIES["op11_prefix_trie"](spark, talk(spark, tmp_path / "b", [(None, 1, "a", "b")])).collect() == []
