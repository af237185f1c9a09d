"""A Merkle manifest of a dataset: a tree of SHA-256 midstates a source, and one over the sources.

A leaf is the digest of a row. Up to RUN consecutive nodes become the digest of their digests, as hex text. That text fills one
block of SHA-256, so what a parent has read before a child is a state of eight words: a midstate. Parents retain one for each child
slot, and folding a changed leaf up its path resumes the state of its slot with the new digest and the siblings to the right
alone; those to the left are in the state already.

Leaves are numbered within their source by ranges of (source, doc_id), of which only totals are gathered. A task builds subtrees
of HEIGHT levels (RUN ** HEIGHT leaves) and passes on their tops, until a source has one; the sources' tops are numbered and built
alike. On the way down each subtree gets the path above it, a record a level, so that leaves meet one row a subtree and fold the
whole way in one task. A source may hold any share of the rows.

Defined results: a null is `-` in a leaf and differs from an empty text. Within a source, rows without doc_id come first, rows of
one doc_id by their leaf digest; equal rows are as many leaves. Sources are ordered bytewise, a null one first, and differs from
an empty one. Without siblings on the whole path the proof is the digest of nothing. Extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.shared import cut, shuffle_count, table

RUN, HEIGHT = 3, 7
#: Rows that a task works on at once; whole subtrees, so up to one more of these.
ROWS_AT_ONCE = 1 << 15
STEP = np.dtype([("left", "u1"), ("right", "u1"), ("state", "<u4", 8), ("sib", "<u4", (RUN - 1, 8))])


def _root(x: int) -> int:
    """The integer part of a cube root."""
    r = round(x ** (1 / 3))
    while r**3 > x:
        r -= max(1, (r**3 - x) // (3 * r * r))
    while (r + 1) ** 3 <= x:
        r += 1
    return r


_PRIMES = [p for p in range(2, 312) if all(p % q for q in range(2, isqrt(p) + 1))]
_K = [np.uint32(_root(p << 96) & 0xFFFFFFFF) for p in _PRIMES]
START = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _PRIMES[:8]], np.uint32)
_HEX = np.array([[ord(c) for c in f"{b:02x}"] for b in range(256)], np.uint8)


def _turn(x, n):
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """States (n, 8) after one more block (n, 16) each."""
    out = np.empty_like(state)
    for lo in range(0, len(state), 8192):
        w = list(np.ascontiguousarray(block[lo : lo + 8192].T))
        for t in range(16, 64):
            a, b = w[t - 15], w[t - 2]
            w.append(w[t - 16] + w[t - 7] + (_turn(a, 7) ^ _turn(a, 18) ^ (a >> np.uint32(3))) + (_turn(b, 17) ^ _turn(b, 19) ^ (b >> np.uint32(10))))
        s = np.ascontiguousarray(state[lo : lo + 8192].T)
        a, b, c, d, e, f, g, h = s
        for k, x in zip(_K, w):
            t1 = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + ((e & f) ^ (~e & g)) + k + x
            t2 = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) ^ (a & c) ^ (b & c))
            a, b, c, d, e, f, g, h = t1 + t2, a, b, c, d + t1, e, f, g
        out[lo : lo + 8192] = (s + np.stack([a, b, c, d, e, f, g, h])).T
    return out


def hex_text(words: np.ndarray) -> np.ndarray:
    """(n, 64) characters of digests (n, 8)."""
    return _HEX[words.astype(">u4").view(np.uint8).reshape(len(words), 32)].reshape(len(words), 64)


def absorb(state: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """States after one more digest each, read as hex text."""
    return compress(state, hex_text(digest).view(">u4").astype(np.uint32))


def finish(state: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Digests of what n digests each have led to."""
    last = np.zeros((len(state), 16), np.uint32)
    last[:, 0], last[:, 14], last[:, 15] = 1 << 31, n.astype(np.uint64) >> np.uint64(23), (n.astype(np.uint64) << np.uint64(9)) & np.uint64(0xFFFFFFFF)
    return compress(state, last)


def levels(size: np.ndarray) -> np.ndarray:
    """How many levels stand above `size` nodes."""
    return (np.asarray(size)[:, None] > RUN ** np.arange(40, dtype=np.int64)).sum(1)


def grow(key: np.ndarray, digest: np.ndarray):
    """Parents of nodes; neighbours of one key are the children of one. (first child, parent of each node, step of each node, digests)."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    k = np.diff(np.r_[first, len(key)])
    parent = np.repeat(np.arange(len(first)), k)
    slot = np.arange(len(key)) - first[parent]
    state, before = np.tile(START, (len(first), 1)), np.zeros((len(first), RUN, 8), np.uint32)
    for c in range(RUN):
        has = np.flatnonzero(k > c)
        before[has, c] = state[has]
        state[has] = absorb(state[has], digest[first[has] + c])
    step = np.zeros(len(key), STEP)
    step["left"], step["right"], step["state"] = slot, k[parent] - 1 - slot, before[parent, slot]
    for c in range(RUN - 1):
        at = c + (slot <= c)
        has = np.flatnonzero(at < k[parent])
        step["sib"][has, c] = digest[first[parent[has]] + at[has]]
    return first, parent, step, finish(state, k)


def climb(fold: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Digests one level up: the retained state resumed with the node itself and its siblings to the right."""
    state, left, right = absorb(np.ascontiguousarray(step["state"]), fold), step["left"].astype(np.int64), step["right"].astype(np.int64)
    for c in range(RUN - 1):
        has = np.flatnonzero(right > c)
        state[has] = absorb(state[has], step["sib"][has, left[has] + c])
    return finish(state, left + 1 + right)


def _words(column) -> np.ndarray:
    """Digests (n, 8) of a column of 32 bytes each."""
    return np.frombuffer(b"".join(column.to_pylist()), ">u4").astype(np.uint32).reshape(-1, 8)


def _binary(words: np.ndarray) -> pa.Array:
    raw = words.astype(">u4").tobytes()
    return pa.array([raw[k : k + 32] for k in range(0, len(raw), 32)], pa.binary())


def _hexes(words: np.ndarray) -> pa.Array:
    raw = hex_text(words).tobytes().decode()
    return pa.array([raw[k : k + 64] for k in range(0, len(raw), 64)], pa.string())


def _whole_blocks(batches):
    """Tables of whole subtrees with the number of each row's subtree, from batches sorted by (g, block)."""
    held, n = [], 0

    def numbered(t):
        g, block = t.column("g").combine_chunks().dictionary_encode().indices.to_numpy(), t.column("block").to_numpy()
        return np.cumsum(np.r_[0, (g[1:] != g[:-1]) | (block[1:] != block[:-1])])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        n += batch.num_rows
        if n > ROWS_AT_ONCE:
            t = pa.concat_tables(held)
            at = numbered(t)
            done = int(np.searchsorted(at, at[-1]))
            if done:
                yield t.slice(0, done), at[:done]
            held, n = [t.slice(done)], t.num_rows - done
    if held:
        t = pa.concat_tables(held)
        yield t, numbered(t)


class _Trees:
    """The subtrees of some nodes, level by level: after `up`, digests of the next level; `step` and `moves` speak of each node's way there."""

    def __init__(self, at, t, height: int):
        self.block = RUN**height
        self.bid, self.pos, self.digest = at, t.column("idx").to_numpy() % self.block, _words(t.column("digest"))
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        self.levels, self.level = np.minimum(levels(t.column("size").to_numpy()[first]), height), 0
        self.where = np.arange(len(at))

    def up(self) -> bool:
        """Moves every node one level up; false when all are at their tops. Trees that are done keep their digest."""
        if not (self.levels > self.level).any():
            return False
        first, parent, step, digest = grow(self.bid * self.block + self.pos // RUN, self.digest)
        moving = self.levels[self.bid] > self.level
        digest[~moving[first]] = self.digest[first][~moving[first]]
        self.step, self.moves, self.where = step[self.where], moving[self.where], parent[self.where]
        self.bid, self.pos, self.digest, self.level = self.bid[first], self.pos[first] // RUN, digest, self.level + 1
        return True


def _tops(height: int):
    def run(batches):
        for t, at in _whole_blocks(batches):
            trees = _Trees(at, t, height)
            while trees.up():
                pass
            first = pa.array(np.flatnonzero(np.r_[True, at[1:] != at[:-1]]))
            size = -(-t.column("size").take(first).to_numpy() // RUN**height)
            yield pa.record_batch([t.column("g").take(first).combine_chunks(), t.column("block").take(first).combine_chunks(), pa.array(size), _binary(trees.digest)], ["g", "idx", "size", "digest"])

    return run


def _paths(height: int):
    def run(batches):
        """For each node the records of its way to the root: those in its subtree, then those that the subtree's row brings."""
        for t, at in _whole_blocks(batches):
            heads = np.flatnonzero(t.column("kind").to_numpy() == 0)
            nodes = np.flatnonzero(t.column("kind").to_numpy() == 1)
            above, t, at = t.take(pa.array(heads)), t.take(pa.array(nodes)), at[nodes]
            trees = _Trees(at, t, height)
            own = [b""] * len(at)
            while trees.up():
                for k in np.flatnonzero(trees.moves):
                    own[k] += trees.step[k].tobytes()
            path = above.column("path").to_pylist()
            head = pa.array(at)
            yield pa.record_batch([t.column("g").combine_chunks(), t.column("idx").combine_chunks(), pa.array([o + path[b] for o, b in zip(own, at)], pa.binary()), *(above.column(c).take(head).combine_chunks() for c in ("subroot", "root"))], ["g", "block", "path", "subroot", "root"])

    return run


def _fold(height: int):
    def run(batches):
        for t, at in _whole_blocks(batches):
            kind = t.column("kind").to_numpy()
            above, rows = t.filter(pa.array(kind == 0)), np.flatnonzero(kind == 1)
            t, at = t.take(pa.array(rows)), at[rows]
            leaf = _words(t.column("digest"))
            trees = _Trees(at, t, height)
            fold, proof, count = _words(t.column("changed")), np.tile(START, (len(at), 1)), np.zeros(len(at), np.int64)

            def climbed(rows, step):
                fold[rows] = climb(fold[rows], step)
                siblings = step["left"] + step["right"]
                for c in range(RUN - 1):
                    has = np.flatnonzero(siblings > c)
                    proof[rows[has]] = absorb(proof[rows[has]], np.ascontiguousarray(step["sib"][has, c]))
                count[rows] += siblings

            while trees.up():
                moved = np.flatnonzero(trees.moves)
                climbed(moved, trees.step[moved])
            path = [np.frombuffer(p, STEP) for p in above.column("path").to_pylist()]
            long = np.array([len(p) for p in path])
            for k in range(long.max(initial=0)):
                step = np.zeros(len(path), STEP)
                for b in np.flatnonzero(long > k):
                    step[b] = path[b][k]
                moved = np.flatnonzero(long[at] > k)
                climbed(moved, step[at[moved]])
            head = pa.array(at)
            subroot, root = (above.column(c).take(head).combine_chunks() for c in ("subroot", "root"))
            folded = _hexes(fold)
            same = pa.array([a == b for a, b in zip(folded.to_pylist(), root.to_pylist())], pa.bool_())
            yield pa.record_batch([t.column("doc_id").combine_chunks(), _hexes(leaf), subroot, root, _hexes(finish(proof, count)), folded, same], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return run


def _field(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    """The digest of a row with this text."""
    return F.unhex(F.sha2(F.concat(*[_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], _field(text)), 256))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows(g, ...) with `idx`, the place within g by `order`, and `size`, the number of rows of g.

    Rows are dealt by range of (g, order); equal ones by their place in the table, so that no value fills a range of its own. Only
    groups that span ranges, two a range at most, are broadcast.
    """
    keys = ["g", *order, "_place"]
    ranged = cut(rows.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(shuffle_count(rows), *keys).withColumn("_range", F.spark_partition_id()))
    w = W.partitionBy("g")
    counts = ranged.groupBy("_range", "g").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(w.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_n").over(w))
    spanning = F.broadcast(counts.filter("_all > _n").select("_range", "g", "_before", "_all"))
    inside = W.partitionBy("_range", "g")
    out = ranged.withColumn("_k", F.row_number().over(inside.orderBy(*order, "_place")) - 1).withColumn("_n", F.count("*").over(inside))
    out = out.join(spanning, ["_range", "g"], "left")
    return out.withColumns({"idx": F.col("_k") + F.coalesce("_before", F.lit(0)), "size": F.coalesce("_all", "_n")}).drop("_place", "_range", "_k", "_n", "_before", "_all")


def _dealt(nodes: DataFrame, height: int, *order: str) -> DataFrame:
    """Nodes with the subtree that they stand in, each subtree in one task and in order."""
    own = F.expr(f"idx div {RUN**height}")
    blocks = nodes.withColumn("block", F.coalesce("block", own) if "block" in nodes.columns else own)
    return blocks.repartition("g", "block").sortWithinPartitions("g", "block", *order)


def _rounds(nodes: DataFrame, height: int) -> list[DataFrame]:
    """Nodes, the tops of their subtrees, the tops of theirs, and so on to one node a group."""
    out = [nodes]
    while (out[-1].agg(F.max("size")).first()[0] or 0) > 1:
        dealt = _dealt(out[-1].select("g", "idx", "size", "digest"), height, "idx")
        out.append(cut(dealt.mapInArrow(_tops(height), "g string, idx long, size long, digest binary")))
    return out


def _meeting(nodes: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """Nodes behind the row of their subtree."""
    return _dealt(nodes.withColumn("kind", F.lit(1)).unionByName(above.withColumn("kind", F.lit(0)), allowMissingColumns=True), height, "kind", "idx")


def _down(rounds: list[DataFrame], above: DataFrame, height: int) -> DataFrame:
    """(g, block, path, subroot, root): the paths of the nodes of rounds[0], each of which heads the subtree `block` of the round below; `above` are those of the nodes over rounds[-1]."""
    for nodes in reversed(rounds):
        above = cut(_meeting(nodes.select("g", "idx", "size", "digest"), above, height).mapInArrow(_paths(height), "g string, block long, path binary, subroot string, root string"))
    return above


def manifest(docs: DataFrame, found: Column, height: int = HEIGHT) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for docs(doc_id, source, lang, n_chars, text); paths are folded from the leaves of `found`, the text as it is now."""
    group, text = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")), F.col("text")
    marks = docs.select(group.alias("g"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(text).alias("digest"), F.when(~text.eqNullSafe(found), leaf_digest(found)).alias("changed"))
    leaves = numbered(cut(marks), "doc_id", "digest").withColumn("changed", F.coalesce("changed", "digest"))
    trees = _rounds(cut(leaves), height)
    tops = trees[-1].select(F.lit("").alias("g"), F.col("g").alias("name"), "digest")
    sources = cut(numbered(tops, "name"))
    whole, zero = _rounds(sources, height), F.lit(0).cast("long").alias("block")
    root = whole[-1].select("g", zero, F.unhex(F.lit("")).alias("path"), F.lit(None).cast("string").alias("subroot"), F.lower(F.hex("digest")).alias("root"))
    ways = _down(whole[:-1], root, height).select("block", "path", "root")
    heads = sources.withColumnRenamed("idx", "block").join(ways, "block").select(F.col("name").alias("g"), zero, "path", F.lower(F.hex("digest")).alias("subroot"), "root")
    return _meeting(trees[0], _down(trees[1:-1], heads, height), height).mapInArrow(_fold(height), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def query(spark, sf_dir: str) -> DataFrame:
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return manifest(table(spark, sf_dir, "documents"), F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))
