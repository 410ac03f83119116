"""Conversation prefix trie: union-find over the common prefixes of sorted neighbours, deepest first.

A conversation is the sequence of its turns, each as 16 bytes of a hash, so that conversations in the order of these
bytes have all that share their first turns side by side. Range partitions are sorted and cut into chunks. In a chunk
neighbours are united in descending depth of what they share; each merge is a branching node, and the turns between
two merges are nodes with one child. What no other chunk can share is complete. The paths of a chunk's first and last
conversation, which others may share, are contracted to one row with a number of each kind for each depth; one pass
over these rows in order, which holds one path, merges them across the boundaries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: Conversations and turns of a chunk at most, unless one conversation has more; conversations of a range partition about.
CHUNK_ROWS, CHUNK_TURNS, PART_ROWS = 50_000, 400_000, 200_000
#: Shared nodes that are sent to every task; beyond, complete nodes are joined with their parents by a shuffle.
BROADCAST_NODES = 200_000
#: Parts that the children of one shared node are spread over in that shuffle.
SALTS = 32
_KEY = 16

_NODE = "depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, conv_id long, parent_conv_id long, parent binary, ends binary"
_PATH = "array<struct<n: long, least: long, kids: long, leaves: long, saved: long, ends: binary>>"
_CHUNK = f"part long, chunk long, first binary, last binary, sizes_first array<long>, sizes_last array<long>, on_first {_PATH}, on_last {_PATH}"


def turn_key(role: Column, text: Column) -> Column:
    """16 bytes for a turn; equal turns alone have equal ones."""
    return F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * _KEY))


def sequences(turns: DataFrame, shared: int = 6, group: int = 100) -> DataFrame:
    """(conv_id, keys, sizes) of the rebuilt conversations: keys of 16 bytes a turn in one string, code points of each turn.

    ``turns`` has conv_id, turn, role and text. Turns stand in the order of turn, null first, equal ones in that of role,
    the text's first 64 characters and a hash of all. A conversation starts with the first crc32(conv_id) % shared turns
    of that whose id is less by conv_id % group, and goes on with its own beyond so many. Null roles and texts are empty;
    rows without a conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    base = F.col("conv_id") - F.col("conv_id") % group
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), base.cast("long").alias("base"),
        F.struct(F.col("turn"), role.alias("role"), F.substring(text, 1, 64).alias("head"), turn_key(role, text).alias("key"), F.length(text).cast("long").alias("size")).alias("t"),
    )
    own = rows.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select(
        "base", "conv_id", F.transform("t", lambda x: F.struct(x["key"].alias("key"), x["size"].alias("size"))).alias("t")
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).cast("int")
    heads = own.where("conv_id = base").select("base", F.slice("t", 1, shared - 1).alias("head"))
    rest = F.slice("t", h + 1, F.greatest(F.size("t") - h, F.lit(0)))
    both = own.join(heads, "base", "left").select("conv_id", F.concat(F.slice(F.coalesce("head", F.slice("t", 1, 0)), F.lit(1), h), rest).alias("t"))
    return both.select("conv_id", F.unhex(F.array_join(F.transform("t", lambda x: F.hex(x["key"])), "")).alias("keys"), F.transform("t", lambda x: x["size"]).alias("sizes"))


def _common(a: bytes, b: bytes) -> int:
    """Turns that two sequences share at their start."""
    n = min(len(a), len(b)) // _KEY
    low, high = 0, n
    if a[: n * _KEY] == b[: n * _KEY]:
        return n
    while low < high:  # the first differing turn, by halving
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[: middle * _KEY] == b[: middle * _KEY] else (low, middle - 1)
    return low


def prefixes(keys: bytes) -> list[bytes]:
    """A name of 16 bytes for each prefix of a sequence, the empty one included."""
    state, out = xxhash.xxh3_128(), []
    for at in range(0, len(keys) + 1, _KEY):
        out.append(state.digest())
        state.update(keys[at : at + _KEY])
    return out


def _listed(ids: np.ndarray) -> bytes:
    return ",".join(map(str, ids.tolist())).encode()


class Forest:
    """The trie of the sorted conversations of a chunk: complete nodes as rows, and what stands on its two outer paths."""

    def __init__(self, ids: np.ndarray, keys: list[bytes], sizes: list[np.ndarray]):
        n = len(ids)
        self.ids, self.keys, self.sizes = ids, keys, sizes
        self.rows: list[list] = []
        length = [len(k) // _KEY for k in keys]
        shared = np.array([_common(a, b) for a, b in zip(keys, keys[1:], strict=False)], np.int64)
        self.first: list = [None] * (length[0] + 1)
        self.last: list = [None] * (length[-1] + 1)
        self.up = list(range(n))
        # Of each group its first and last row, depth, least id, children, leaves, saved tokens, and rows of children without a parent yet.
        self.left, self.right, self.depth = list(range(n)), list(range(n)), length
        self.least, self.kids, self.leaves, self.saved = ids.tolist(), [0] * n, [0] * n, [0] * n
        self.orphans: list[list[int]] = [[] for _ in range(n)]
        self.length = list(length)
        self.names: dict[bool, list[bytes]] = {}
        for i in np.argsort(-shared, kind="stable").tolist():
            self._unite(i, i + 1, int(shared[i]))
        root = self._top(0)
        self._close(root, -1)

    def _top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def _unite(self, i: int, j: int, depth: int) -> None:
        """Merges the groups of two neighbours at a node of this depth."""
        a, b = self._top(i), self._top(j)
        for x in (a, b):
            if self.depth[x] > depth:
                self._close(x, depth)
        self.up[b] = a
        self.right[a] = self.right[b]
        self.least[a] = min(self.least[a], self.least[b])
        for numbers in (self.kids, self.leaves, self.saved):
            numbers[a] += numbers[b]
        self.orphans[a] += self.orphans[b]
        self.orphans[b] = []

    def _close(self, x: int, above: int) -> None:
        """Completes a group's nodes from its depth up to one below ``above``, and makes it the node there with one child."""
        at, members = self.depth[x], self.right[x] - self.left[x] + 1
        start, stop = self.left[x], self.left[x]
        while stop <= self.right[x] and self.length[stop] == at:  # conversations that end here come first
            stop += 1
        ends = _listed(self.ids[start:stop])
        outer = self.left[x] == 0 or self.right[x] == len(self.ids) - 1
        if outer:
            path = self.first if self.left[x] == 0 else self.last
            for d in range(above + 1, at + 1):
                path[d] = (members, self.least[x], 0, 0, 0, b"")
            path[at] = (members, self.least[x], self.kids[x], self.leaves[x], self.saved[x], ends)
            for row in self.orphans[x]:
                self.rows[row][7] = self._name(self.left[x] == 0, at)
            self.orphans[x], self.kids[x], self.leaves[x], self.saved[x] = [], 0, 0, 0
        else:
            for row in self.orphans[x]:
                self.rows[row][6] = self.least[x]
            sizes, saved = self.sizes[start], self.saved[x]
            leaves, kids, digest = self.leaves[x] if self.kids[x] else 1, self.kids[x], hashlib.sha256(ends).digest()
            for d in range(at, above, -1):
                saved += (members - 1) * int(sizes[d - 1])
                self.rows.append([d, members, kids, leaves, saved, self.least[x], self.least[x], None, digest])
                kids, digest = 1, _NONE
            self.rows[-1][6] = None
            self.orphans[x], self.kids[x], self.leaves[x], self.saved[x] = [len(self.rows) - 1], 1, leaves, saved
        self.depth[x] = above

    def _name(self, first: bool, depth: int) -> bytes:
        if first not in self.names:
            self.names[first] = prefixes(self.keys[0 if first else -1])
        return self.names[first][depth]


_NONE = hashlib.sha256(b"").digest()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes], list[np.ndarray]]]:
    """Ids, keys and sizes of as many sorted rows as a chunk takes."""
    ids: list[int] = []
    keys: list[bytes] = []
    sizes: list[np.ndarray] = []
    turns = 0
    for batch in batches:
        ends = batch.column("sizes").offsets.to_numpy()
        flat = batch.column("sizes").flatten().to_numpy()
        for i, (c, k) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("keys").to_pylist(), strict=True)):
            if ids and (len(ids) >= CHUNK_ROWS or turns + len(k) // _KEY > CHUNK_TURNS):
                yield np.array(ids), keys, sizes
                ids, keys, sizes, turns = [], [], [], 0
            ids.append(c)
            keys.append(k)
            sizes.append(flat[ends[i] - ends[0] : ends[i + 1] - ends[0]].copy())
            turns += len(k) // _KEY
    if ids:
        yield np.array(ids), keys, sizes


def _forests(schema: pa.Schema):
    """Sorted rows to the complete nodes of their chunks, and a row for each chunk's outer paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, width = TaskContext.get().partitionId(), len(_NODE.split(", "))
        for chunk, (ids, keys, sizes) in enumerate(_chunks(batches)):
            forest = Forest(ids, keys, sizes)
            for start in range(0, len(forest.rows), 20_000):
                rows = forest.rows[start : start + 20_000]
                nodes = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=False)]
                yield pa.RecordBatch.from_arrays(nodes + [pa.nulls(len(rows), t) for t in schema.types[width:]], schema=schema)
            outer = [part, chunk, keys[0], keys[-1], sizes[0].tolist(), sizes[-1].tolist()]
            paths = [[None if p is None else dict(zip(("n", "least", "kids", "leaves", "saved", "ends"), p, strict=True)) for p in x] for x in (forest.first, forest.last)]
            values = [pa.array([x], t) for x, t in zip([*outer, *paths], schema.types[width:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, t) for t in schema.types[:width]] + values, schema=schema)

    return run


class Path:
    """Shared nodes from the root to where the rows read so far have led; nodes that are left are complete."""

    def __init__(self):
        self.keys, self.open, self.names = b"", [], []
        self.done: list[tuple] = []

    def _close(self) -> None:
        node, depth = self.open.pop(), len(self.open)
        leaves = node["leaves"] if node["kids"] else 1
        saved = node["saved"] + (node["n"] - 1) * node["size"]
        name, above = self.names.pop(), self.names[-1] if self.names else None
        self.done.append((depth, node["n"], node["kids"], leaves, saved, node["least"], None, above, node["sha"].digest(), name))
        if self.open:
            self.open[-1]["kids"] += 1
            self.open[-1]["leaves"] += leaves
            self.open[-1]["saved"] += saved

    def go(self, keys: bytes, sizes: list[int], numbers: list[dict | None]) -> None:
        """Leaves the nodes that ``keys`` does not pass, opens those that it does, and adds what a chunk has for each depth."""
        if self.open:
            stay = _common(self.keys, keys)
            while len(self.open) > stay + 1:
                self._close()
        names = prefixes(keys)
        for depth in range(len(self.open), len(names)):
            size = sizes[depth - 1] if depth else 0
            self.open.append({"n": 0, "least": None, "kids": 0, "leaves": 0, "saved": 0, "size": size, "sha": hashlib.sha256(), "ended": False})
            self.names.append(names[depth])
        self.keys = keys
        for node, more in zip(self.open, numbers, strict=False):
            if more is not None:
                for c in ("n", "kids", "leaves", "saved"):
                    node[c] += more[c]
                node["least"] = more["least"] if node["least"] is None else min(node["least"], more["least"])
                if more["ends"]:
                    node["sha"].update((b"," if node["ended"] else b"") + more["ends"])
                    node["ended"] = True

    def finish(self) -> None:
        while self.open:
            self._close()


def _merged(schema: pa.Schema):
    """Chunks in order to the nodes on their outer paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = Path()

        def rows() -> pa.RecordBatch:
            done, path.done = path.done, []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)

        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("first", "last", "sizes_first", "sizes_last", "on_first", "on_last")}
                path.go(row["first"], row["sizes_first"], row["on_first"])
                path.go(row["last"], row["sizes_last"], row["on_last"])
                if len(path.done) > 10_000:
                    yield rows()
        path.finish()
        if path.done:
            yield rows()

    return run


def prefix_trie(turns: DataFrame) -> DataFrame:
    """Every node of the trie of the rebuilt conversations, as sequences() makes them; an empty table has no node.

    Returns conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (long) and ends_sha256. Equal
    conversations are members of the same nodes. A conversation is held whole by one task, as 16 bytes a turn.
    """
    found = stored(sequences(turns))
    parts = 1 + found.count() // PART_ROWS
    spread = max(parts, min(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + parts * 8))
    ordered = found.repartitionByRange(spread, "keys", "conv_id").sortWithinPartitions("keys", "conv_id")
    empty = turns.sparkSession.createDataFrame([], f"{_NODE}, {_CHUNK}").toArrow().schema
    both = stored(ordered.mapInArrow(_forests(empty), f"{_NODE}, {_CHUNK}"))
    names = [c.split(" ")[0] for c in _NODE.split(", ")]
    outer = both.where("part is not null").select("part", "chunk", "first", "last", "sizes_first", "sizes_last", "on_first", "on_last")
    shape = turns.sparkSession.createDataFrame([], f"{_NODE}, name binary").toArrow().schema
    shared = stored(outer.repartition(1).sortWithinPartitions("part", "chunk").mapInArrow(_merged(shape), f"{_NODE}, name binary"))
    inner = both.where("part is null").select(*names)
    above = shared.select(F.col("name").alias("parent"), F.col("depth").alias("above"), F.col("conv_id").alias("least"))
    few = shared.count() <= BROADCAST_NODES
    if few:
        nodes = inner.unionByName(shared.select(*names)).join(F.broadcast(above), "parent", "left")
    else:
        salt = F.when(F.col("parent").isNotNull(), F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)))
        many = above.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
        nodes = inner.unionByName(shared.select(*names)).withColumn("salt", salt).join(many, ["parent", "salt"], "left")
    return nodes.select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "least").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.lower(F.hex("ends")).alias("ends_sha256"),
    )


OP11_SQL = """with o as (
    select conv_id as c, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) as k, length(coalesce(text, '')) as size,
        row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), substring(coalesce(text, ''), 1, 64), sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) as pos
    from conversations where conv_id is not null),
ids as (select distinct c from o),
h as (select c, c - c % 100 as base, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(cast(c as varchar), ''), lambda x: [ord(x), 0, 0, 0, 0, 0, 0, 0]))),
        lambda a, v: case when xor(a, v) % 2 = 1 then xor(xor(a, v) // 2, 3988292384) else xor(a, v) // 2 end), 4294967295) % 6 as h from ids),
r as (select h.c, o.pos, o.k, o.size from h join o on o.c = h.base and o.pos <= h.h union all select h.c, o.pos, o.k, o.size from h join o on o.c = h.c and o.pos > h.h),
s as (select c, row_number() over (partition by c order by pos) as depth, k, size from r),
l as (select ids.c, count(s.k) as n, coalesce(string_agg(k, '' order by depth), '') as key from ids left join s on s.c = ids.c group by ids.c),
p as (select c, 0 as depth, '' as key, 0 as size from ids union all select s.c, s.depth, substring(l.key, 1, 64 * s.depth), s.size from s join l using (c)),
m as (select depth, key, any_value(size) as size, min(c) as conv_id, count(*) as n_convs from p group by depth, key),
e as (select key, sha256(string_agg(c, ',' order by c)) as ends from l group by key),
k as (select depth - 1 as depth, substring(key, 1, 64 * (depth - 1)) as key, count(*) as n_children from m where depth > 0 group by all),
x as (select m.*, coalesce(k.n_children, 0) as n_children from m left join k using (depth, key)),
u as (select a.depth, a.key, count(*) filter (b.n_children = 0) as n_leaves, sum((b.n_convs - 1) * b.size) as saved
    from (select depth, key, unnest(range(0, depth + 1)) as up, n_children, n_convs, size from x) b join x a on a.depth = b.up and a.key = substring(b.key, 1, 64 * b.up) group by all)
select x.conv_id, cast(x.depth as bigint) as depth, q.conv_id as parent_conv_id, x.n_convs, cast(x.n_children as bigint) as n_children, u.n_leaves, cast(u.saved as bigint) as saved_tokens,
    coalesce(e.ends, sha256('')) as ends_sha256
from x join u using (depth, key) left join m q on q.depth = x.depth - 1 and q.key = substring(x.key, 1, 64 * (x.depth - 1)) left join e on e.key = x.key"""


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the trie of all conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations"))
