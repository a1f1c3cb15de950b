"""The prefix trie of conversations, by truncation peeling.

Every distinct conversation is a path of turn hashes. Peeling descends from the greatest depth: the
nodes that survive from the depth below are stripped of their last turn, meet the conversations that
end at this depth, and are grouped again; counts, minima, leaves and savings of the subtrees are summed
while the nodes are found.

Spark orders the paths and cuts that order into ranges, so a turn that a third of all conversations
open with is spread over many tasks. A range peels its own paths, all depths in one pass. Only
prefixes of its first and its last path can go on in a neighbouring range: these two paths come back
with what was summed at each of their depths, and are peeled in the next round, with far fewer rows,
until one range holds all. The number of Spark jobs grows with the logarithm of the table, not with
the depth.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierglass.llm import words as W
from tierglass.llm.common import cut, table

#: Turns of all paths that one task peels at a time, about.
TURNS = 1 << 16
#: Ranges of a round at most; beyond, tasks get larger.
RANGES = 100_000
WORD = r"[^\x20\x09-\x0D]+"
#: Conversations of one group share the head of its first one, of so many turns less one at most.
GROUP, HEADS = 20, 4

TURN = "struct<a:long,b:long,words:long>"
ENTRY = "struct<depth:long,n:long,first:long,children:long,leaves:long,saved:long,ends:string>"
COUNTS = "conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
KEYS = "parent_conv_id long, parent_a long, parent_b long, key_a long, key_b long"
PEELED = f"{COUNTS}, {KEYS}, path array<{TURN}>, entries array<{ENTRY}>"
_NO_ENDS = hashlib.sha256(b"").hexdigest()
_FAR = np.iinfo(np.int64).max


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path): the turns of each conversation in order, as hashes of role and text.

    A null role or text counts as empty. Turns of a null number come first; turns of one number come in
    an order that their content fixes. Rows without a conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return (
        conversations.where("conv_id is not null")
        .select(
            F.col("conv_id").cast("long").alias("conv_id"),
            "turn",
            F.xxhash64(role, text).alias("a"),
            F.xxhash64(text, F.lit(1), role).alias("b"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
        )
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "a", "b", "words"))).alias("turns"))
        .select("conv_id", F.expr("transform(turns, t -> struct(t.a AS a, t.b AS b, t.words AS words))").alias("path"))
    )


def with_shared_heads(own: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """Conversations rebuilt: the first h turns from the first conversation of the group, then their own.

    h is the crc32 of the id modulo ``heads``. Where the first conversation of a group is missing, nothing
    stands in for those turns.
    """
    own = cut(own)
    head = own.where(f"conv_id % {group} = 0").select(
        F.col("conv_id").alias("_base"), F.slice("path", 1, heads).alias("_head")
    )
    return (
        own.withColumn("_h", (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int"))
        .join(head, F.expr(f"conv_id - conv_id % {group} = _base"), "left")
        .select(
            "conv_id",
            F.expr(
                f"concat(slice(coalesce(_head, CAST(array() AS array<{TURN}>)), 1, _h), slice(path, _h + 1, 1 + size(path)))"
            ).alias("path"),
        )
    )


def _ended(rebuilt: DataFrame) -> DataFrame:
    """One row for each distinct path: how many conversations are it, their least id, digest of their ids.

    Ids are gathered in groups of 4,096 neighbours, so that the many copies of a hot conversation are
    few rows; the digest reads these in order, one at a time.
    """
    blocks = (
        rebuilt.groupBy(
            F.xxhash64("path").alias("a"),
            F.xxhash64(F.lit(1), "path").alias("b"),
            F.shiftright("conv_id", 12).alias("block"),
        )
        .agg(F.sort_array(F.collect_set("conv_id")).alias("ids"), F.first("path").alias("path"))
        .repartition("a", "b")
        .sortWithinPartitions("a", "b", "block")
    )

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, n, first, path = None, None, 0, 0, None
        for batch in batches:
            done = []
            for i, now in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())):
                ids = batch.column("ids")[i].as_py()
                if now != key:
                    if key is not None:
                        done.append((path, n, first, digest.hexdigest()))
                    key, digest, n, first, path = now, hashlib.sha256(), 0, ids[0], batch.column("path").slice(i, 1)
                else:
                    digest.update(b",")
                digest.update(",".join(map(str, ids)).encode())
                n += len(ids)
            if done:
                yield _ended_rows(done)
        if key is not None:
            yield _ended_rows([(path, n, first, digest.hexdigest())])

    return blocks.mapInArrow(W.task(digests), f"path array<{TURN}>, entries array<{ENTRY}>")


def _ended_rows(done: list[tuple]) -> pa.RecordBatch:
    path = pa.concat_arrays([p for p, *_ in done])
    depth = np.diff(path.offsets.to_numpy())
    zero = pa.array(np.zeros(len(done), np.int64))
    values = [
        pa.array(depth, pa.int64()),
        pa.array([n for _, n, _, _ in done], pa.int64()),
        pa.array([f for _, _, f, _ in done], pa.int64()),
        *[zero] * 3,
        pa.array([d for *_, d in done], pa.string()),
    ]
    names = ["depth", "n", "first", "children", "leaves", "saved", "ends"]
    entries = pa.ListArray.from_arrays(
        pa.array(np.arange(len(done) + 1, dtype=np.int32)), pa.StructArray.from_arrays(values, names)
    )
    return pa.RecordBatch.from_arrays([path, entries], ["path", "entries"])


class _Least:
    """Minimum of any stretch of an array."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        step = 1
        while 2 * step <= len(values):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Least value of values[start:end]; of an empty stretch a very large one."""
        out = np.full(len(start), _FAR)
        some = np.flatnonzero(end > start)
        size = (end - start)[some]
        level = np.frexp(size.astype(np.float64))[1] - 1
        for k in np.unique(level):
            at = some[level == k]
            out[at] = np.minimum(self.rows[k][start[at]], self.rows[k][end[at] - (1 << int(k))])
        return out


class _Range:
    """The ordered paths of one range."""

    def __init__(self, table: pa.Table):
        path = table.column("path").combine_chunks()
        entries = table.column("entries").combine_chunks()
        self.offsets = path.offsets.to_numpy().astype(np.int64)
        flat = path.values
        self.a, self.b, self.words = (flat.field(c).to_numpy() for c in ("a", "b", "words"))
        self.lengths = np.diff(self.offsets)
        at = entries.offsets.to_numpy().astype(np.int64)
        rows = np.repeat(np.arange(len(self.lengths)), np.diff(at))
        inner = entries.values
        self.entry = {c: inner.field(c).to_numpy() for c in ("depth", "n", "first", "children", "leaves", "saved")}
        self.ends = np.array(inner.field("ends").to_pylist(), object)
        order = np.lexsort((rows, -self.entry["depth"]))
        self.entry = {c: v[order] for c, v in self.entry.items()}
        self.entry["row"], self.ends = rows[order], self.ends[order]
        self.shared = self._shared()
        self.least = _Least(self.shared)

    def _shared(self) -> np.ndarray:
        """Turns that each path shares with the one before."""
        out = np.zeros(len(self.lengths), np.int64)
        m = np.minimum(self.lengths[:-1], self.lengths[1:])
        out[1:] = m
        rows = np.repeat(np.arange(len(m)), m)
        if len(rows):
            k = np.arange(len(rows)) - np.repeat(np.cumsum(m) - m, m)
            x, y = self.offsets[:-1][rows] + k, self.offsets[1:][rows] + k
            other = np.flatnonzero((self.a[x] != self.a[y]) | (self.b[x] != self.b[y]))
            np.minimum.at(out, rows[other] + 1, k[other])
        return out

    def keys(self, rows: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the first turns of these paths."""
        out = []
        for values, base in ((self.a, 0xD1342543DE82EF95), (self.b, 0x9E3779B97F4A7C15)):
            powers = np.full(depth, base, np.uint64).cumprod(dtype=np.uint64)
            h = [np.sum(W.mix(values[s : s + depth].view(np.uint64)) * powers, dtype=np.uint64) for s in self.offsets[rows]]
            out.append(W.mix(np.array(h, np.uint64) + np.uint64(depth)).view(np.int64))
        return out[0], out[1]


def _peel(paths_of_range: pa.Table, final: bool, keyed: bool) -> Iterator[pa.RecordBatch]:
    """Nodes whose members all lie in this range, and what was summed on its two outer paths.

    ``final``: there is no other range. ``keyed``: nodes get keys, by which children that were
    finished earlier find their parent.
    """
    x = _Range(paths_of_range)
    rows_n = len(x.lengths)
    last_row = rows_n - 1
    fields = ("n", "first", "children", "leaves", "saved")
    alive = {c: np.zeros(0, np.int64) for c in ("row", *fields, "node")}
    waiting: dict | None = None  # nodes one deeper, which learn their parent now
    outer: tuple[list, list] = ([], [])
    borders = np.searchsorted(-x.entry["depth"], -np.arange(int(x.lengths.max()), -2, -1), "left")
    for k, depth in enumerate(range(int(x.lengths.max()), -1, -1)):
        new = slice(borders[k], borders[k + 1])
        row = np.concatenate([alive["row"], x.entry["row"][new]])
        if not len(row):
            continue
        order = np.argsort(row, kind="stable")
        row = row[order]
        item = {c: np.concatenate([alive[c], x.entry[c][new]])[order] for c in fields}
        node = np.concatenate([alive["node"], np.full(new.stop - new.start, -1)])[order]
        ends = np.concatenate([np.full(len(alive["row"]), None, object), x.ends[new]])[order]
        start = np.ones(len(row), bool)
        start[1:] = (row[1:] > row[:-1]) & (x.least.of(row[:-1] + 1, row[1:] + 1) < depth)
        at = np.flatnonzero(start)
        group = np.cumsum(start) - 1
        total = {c: np.add.reduceat(item[c], at) for c in ("n", "children", "leaves", "saved")}
        total["first"] = np.minimum.reduceat(item["first"], at)
        digest = np.full(len(at), None, object)
        digest[group[ends != None]] = ends[ends != None]  # noqa: E711
        rep, end = row[at], row[np.append(at[1:] - 1, len(row) - 1)]
        one = np.ones(len(at), np.int64)
        first_path = (x.least.of(one, rep + 1) >= depth) & ~np.full(len(at), final)
        last_path = (x.least.of(end + 1, one * rows_n) >= depth) & ~np.full(len(at), final)
        open_ = first_path | last_path
        if waiting is not None:
            child = np.flatnonzero(node >= 0)
            parent = group[child]
            waiting["parent_conv_id"][node[child]] = total["first"][parent]
            unknown = open_[parent]
            if unknown.any():
                waiting["parent_a"] = np.zeros(len(waiting["conv_id"]), np.int64)
                waiting["parent_b"] = np.zeros(len(waiting["conv_id"]), np.int64)
                waiting["open"] = np.zeros(len(waiting["conv_id"]), bool)
                for g in np.unique(parent[unknown]):
                    own = node[child[parent == g]]
                    key = x.keys(rep[g : g + 1], depth)
                    waiting["parent_a"][own], waiting["parent_b"][own], waiting["open"][own] = *(h[0] for h in key), True
            yield _node_rows(waiting)
            waiting = None
        leaf = ~open_ & (total["children"] == 0)
        total["leaves"] = total["leaves"] + leaf
        if depth:
            last_words = x.words[x.offsets[rep] + depth - 1]
            total["saved"] = total["saved"] + np.where(open_, 0, (total["n"] - 1) * last_words)
        for g in np.flatnonzero(open_):
            entry = (depth, *(int(total[c][g]) for c in fields), digest[g])
            outer[1 if last_path[g] else 0].append(entry)
        closed = np.flatnonzero(~open_)
        if len(closed):
            waiting = {
                "conv_id": total["first"][closed],
                "depth": depth,
                **{c: total[c][closed] for c in ("n", "children", "leaves", "saved")},
                "ends": np.where(digest[closed] == None, _NO_ENDS, digest[closed]),  # noqa: E711
                "parent_conv_id": np.zeros(len(closed), np.int64),
                "keys": x.keys(rep[closed], depth) if keyed else None,
            }
        number = np.full(len(at), -1)
        number[closed] = np.arange(len(closed))
        alive = {c: np.where(open_, 0, total[c]) for c in ("n", "leaves", "saved")}
        alive |= {"first": total["first"], "children": (~open_).astype(np.int64), "row": rep, "node": number}
    if waiting is not None:
        yield _node_rows(waiting, root=True)
    for entries, row in zip(outer, (0, last_row)):
        if entries:
            yield _outer_row(paths_of_range, row, entries)


_SCHEMA = pa.schema(
    [
        *((c, pa.int64()) for c in ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens")),
        ("ends_sha256", pa.string()),
        *((c, pa.int64()) for c in ("parent_conv_id", "parent_a", "parent_b", "key_a", "key_b")),
    ]
)
_TURNS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("words", pa.int64())]))
_ENTRIES = pa.list_(
    pa.struct(
        [*((c, pa.int64()) for c in ("depth", "n", "first", "children", "leaves", "saved")), ("ends", pa.string())]
    )
)


def _node_rows(nodes: dict, root: bool = False) -> pa.RecordBatch:
    n = len(nodes["conv_id"])
    nothing = pa.nulls(n, pa.int64())
    unknown = nodes.get("open", np.zeros(n, bool)) | root
    parent = pa.array(nodes["parent_conv_id"], mask=unknown)
    far = [pa.array(nodes[c], mask=~nodes["open"]) if "open" in nodes else nothing for c in ("parent_a", "parent_b")]
    keys = [pa.array(h) for h in nodes["keys"]] if nodes["keys"] else [nothing, nothing]
    values = [
        pa.array(nodes["conv_id"]),
        pa.array(np.full(n, nodes["depth"], np.int64)),
        *(pa.array(nodes[c].astype(np.int64)) for c in ("n", "children", "leaves", "saved")),
        pa.array(list(nodes["ends"]), pa.string()),
        parent,
        *far,
        *keys,
        pa.nulls(n, _TURNS),
        pa.nulls(n, _ENTRIES),
    ]
    return pa.RecordBatch.from_arrays(values, [*_SCHEMA.names, "path", "entries"])


def _outer_row(paths_of_range: pa.Table, row: int, entries: list[tuple]) -> pa.RecordBatch:
    path = paths_of_range.column("path").slice(row, 1).combine_chunks()
    names = [f.name for f in _ENTRIES.value_type]
    value = pa.array([[dict(zip(names, e)) for e in entries]], _ENTRIES)
    nothing = [pa.nulls(1, f.type) for f in _SCHEMA]
    return pa.RecordBatch.from_arrays([*nothing, path.cast(_TURNS), value], [*_SCHEMA.names, "path", "entries"])


def _round(rows: DataFrame, ranges: int, keyed: bool) -> DataFrame:
    final = ranges == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [b for b in batches if len(b)]:
            yield from _peel(pa.Table.from_batches(held), final, keyed)

    dealt = rows.repartition(1) if final else rows.repartitionByRange(ranges, "path")
    return cut(dealt.sortWithinPartitions("path").mapInArrow(W.task(run), PEELED))


def prefix_trie(rebuilt: DataFrame, turns: int = TURNS) -> DataFrame:
    """One row for every node of the trie of ``rebuilt`` (conv_id, path).

    Returns conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    and ends_sha256 (digest of the ids that end at the node, ascending, joined by commas). The root has
    depth 0 and no parent. Rows of one conv_id and path count once; an empty table has no nodes, not even
    a root. ``turns`` bounds what a task peels at a time and changes no result.

    A path is one row of 24 bytes a turn.
    """
    rows = cut(_ended(rebuilt))
    done, keyed = [], False
    while True:
        left, size = rows.agg(F.count("*"), F.sum(F.size("path") + F.size("entries"))).first()
        if not left:
            break
        # Eight rows a range at least, of which two come back, so that rounds end for any length of path.
        ranges = max(1, min(-(-size // turns), left // 8, RANGES))
        peeled = _round(rows, ranges, keyed)
        done.append(peeled.where("conv_id is not null").drop("path", "entries"))
        if ranges == 1:
            break
        rows, keyed = peeled.where("conv_id is null").select("path", "entries"), True
    columns = [
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    ]
    if not done:
        return rows.sparkSession.createDataFrame([], f"{COUNTS}, {KEYS}").select(*columns)
    nodes = done[0]
    for more in done[1:]:
        nodes = nodes.unionAll(more)
    if len(done) == 1:
        return nodes.select(*columns)
    late = done[1]
    for more in done[2:]:
        late = late.unionAll(more)
    parents = late.select(
        F.col("key_a").alias("parent_a"),
        F.col("key_b").alias("parent_b"),
        (F.col("depth") + 1).alias("depth"),
        F.col("conv_id").alias("late_parent"),
    )
    found = nodes.where("parent_a is not null").join(parents, ["parent_a", "parent_b", "depth"])
    return (
        nodes.where("parent_a is null")
        .select(*columns)
        .unionAll(found.withColumn("parent_conv_id", F.col("late_parent")).select(*columns))
    )


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt with shared heads."""
    return prefix_trie(with_shared_heads(paths(table(spark, sf_dir, "conversations"))))


SQL = r"""
WITH RECURSIVE own AS (
  SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS l
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
counted AS (
  SELECT c, l, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
    lambda x, y: list_reduce([xor(x, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda p, q: xor(p >> 1, (p & 1) * 3988292384))), 4294967295) % 4 AS h
  FROM own),
rebuilt AS (
  SELECT a.c, list_concat(coalesce(b.l, [])[1:a.h], a.l[a.h + 1:]) AS l
  FROM counted a LEFT JOIN own b ON b.c = a.c - a.c % 20),
prefixes AS (SELECT c, d, l[1:d] AS p, l FROM (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT d, p, min(c) AS conv_id, count(*) AS n,
    string_agg(CASE WHEN len(l) = d THEN c::VARCHAR END, ',' ORDER BY c) AS ends
  FROM prefixes GROUP BY d, p),
costs AS (
  SELECT *, CASE WHEN d = 0 THEN 0 ELSE (n - 1) * len(regexp_extract_all(p[d].t, '[^\x20\x09-\x0D]+')) END AS cost,
    row_number() OVER () AS id FROM nodes),
edges AS (
  SELECT x.id AS child, y.id AS parent, y.conv_id AS parent_conv_id
  FROM costs x JOIN costs y ON y.d = x.d - 1 AND y.p = x.p[1:x.d - 1]),
fans AS (SELECT parent AS id, count(*) AS n_children FROM edges GROUP BY parent),
up AS (
  SELECT id, id AS top FROM costs UNION ALL SELECT up.id, e.parent FROM up JOIN edges e ON e.child = up.top),
subtree AS (
  SELECT u.top AS id, sum(c.cost) AS saved, count(*) FILTER (WHERE f.id IS NULL) AS n_leaves
  FROM up u JOIN costs c ON c.id = u.id LEFT JOIN fans f ON f.id = u.id GROUP BY u.top)
SELECT c.conv_id, c.d::BIGINT AS depth, e.parent_conv_id, c.n::BIGINT AS n_convs, coalesce(f.n_children, 0)::BIGINT AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(c.ends, '')) AS ends_sha256
FROM costs c JOIN subtree s USING (id) LEFT JOIN fans f USING (id) LEFT JOIN edges e ON e.child = c.id
"""


def brute_force(rows: list[tuple], group: int = GROUP, heads: int = HEADS) -> list[tuple]:
    """Plain-Python answer for small inputs (conv_id, turn, role, text), for tests; ``heads`` 1 rebuilds none."""
    own: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        whole[c] = tuple(own.get(c - c % group, [])[:h] + turns[h:])
    nodes = {p[:d]: None for p in whole.values() for d in range(len(p) + 1)}
    out = []
    for p in nodes:
        members = [c for c, q in whole.items() if q[: len(p)] == p]
        below = [q for q in nodes if q[: len(p)] == p]
        children = [q for q in below if len(q) == len(p) + 1]
        saved = 0
        for q in below:
            n = sum(r[: len(q)] == q for r in whole.values())
            saved += (n - 1) * len(re.findall(WORD, q[-1][1])) if q else 0
        leaves = sum(not any(r[:-1] == q for r in nodes if r) for q in below)
        parent = min(c for c, q in whole.items() if q[: len(p) - 1] == p[:-1]) if p else None
        ends = ",".join(map(str, sorted(c for c in members if whole[c] == p)))
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(members), len(p), parent, len(members), len(children), leaves, saved, digest))
    return out
