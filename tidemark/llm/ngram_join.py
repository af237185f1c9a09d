"""N-gram Jaccard self-join by signature trees.

Texts are sets of 5-word shingles. Two sets link when their Jaccard similarity reaches a bound (0.75). The join is exact:

1. Each text's set is hashed in an Arrow task and named by a 64-bit hash of its own, its node: texts with equal sets are one.
2. A node is posted under the first `n - ceil(t * n) + 1` shingles of its set in an order that puts frequent shingles last
   (prefix filter: sets over the bound share one of these). Frequencies come from a sketch of fixed size over all texts; it
   only orders, so it cannot lose a pair. Shingles that exactly the same nodes have make one group.
3. In each group the nodes are leaves of signature trees: a tree node holds the OR of its bitmaps, its range of sizes, its
   largest collision excess and its component if it has only one. First, leaves under one bottom node are compared, each with
   its best partner by bound, in two groups a leaf. This is linear, and joins most copies of a text.
4. Then two trees are walked together from their roots; a pair of tree nodes is dropped when the largest possible overlap is
   below what the smallest sizes require, when the sizes are out of proportion, or when both lie in one component. Pairs of
   leaves that remain are tested exactly. Where very many remain between two components, each leaf's best partner goes first;
   if the components stay apart, a last walk passes on every pair, so nothing is lost. A leaf knows its smallest few groups:
   a pair that meets in one of these is passed on there, not in each later group that it shares.
5. Large groups are cut into blocks, and pairs of blocks are separate tasks. Leaves of a group's largest component meet only
   the others.

Defined results: a null or empty text, or one without words, has no shingles and no links. A text with fewer than five words
has one shingle, the whole sequence. Each doc_id is one document and is returned once: where its rows have different texts, it
has the links of all, and the size of the largest set. A row without doc_id is returned with its own size and null ids, and is
linked with nothing. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import scan
from tidemark.llm.shared import Shelf, bounded_batches, bucket_of, components, id_filter, shuffle_count

WIDTH = 5
#: Least similarity as a fraction of whole numbers, so that the test is exact.
NEED, OF = 75, 100
SKETCH = 1 << 18
SKETCH_PARTS = 64
#: Leaves of one block of a large group, and children of a tree node.
BLOCK, FANOUT = 1024, 8
#: Bytes of bitmaps dealt to one task, and sets that a task remembers to have posted.
TASK_BYTES, SEEN = 8 << 20, 1 << 20
#: Pairs between two components that a walk passes on before only each leaf's best partner goes, and groups that a leaf knows.
MANY, KNOWN = 256, 4
_SHORTEST, _LONGEST = 1 << 10, 1 << 20  # bits of the shortest and the longest bitmap

_FIRST_PASS = "doc_id long, n long, node long, first long, bits binary, part int, counts binary"


def sets_of(data: np.ndarray, off: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(shingle sets of a slice's texts, their sizes, their nodes); the node of an empty set is 0."""
    sets = scan.shingle_sets(data, off, WIDTH)
    n = np.array([len(s) for s in sets], np.int64)
    node, some = np.zeros(len(n), np.uint64), np.flatnonzero(n)
    if len(some):
        flat, opens = np.concatenate(sets), (np.cumsum(n) - n)[some]
        total = np.add.reduceat(scan.mix(flat * np.uint64(3) + np.uint64(1)), opens)
        node[some] = scan.mix(np.bitwise_xor.reduceat(scan.mix(flat), opens) + scan.mix(total + n[some].astype(np.uint64)))
    return sets, n, node.view(np.int64)


def _first_pass(batches):
    """A row for each text, then the task's sketch in parts."""
    total, names = np.zeros(SKETCH, np.int64), [c.split()[0] for c in _FIRST_PASS.split(", ")]
    for batch in batches:
        size, nodes, first, bits = [], [], [], []
        for _, data, off in scan.texts(batch.column("text")):
            sets, n, node = sets_of(data, off)
            size.append(n)
            nodes.append(node)
            first += [int(s[0]) >> 1 if len(s) else 0 for s in sets]
            bits += [bitmap(s) if len(s) else None for s in sets]
            np.add.at(total, (np.concatenate(sets) % np.uint64(SKETCH)).astype(np.int64), 1)
        size, nodes = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (size, nodes))
        yield pa.record_batch([batch.column("doc_id"), pa.array(size), pa.array(nodes, mask=size == 0), pa.array(first, pa.int64()), pa.array(bits, pa.binary()), pa.nulls(len(size), pa.int32()), pa.nulls(len(size), pa.binary())], names)
    parts, none = [p.tobytes() for p in total.astype(np.int32).reshape(SKETCH_PARTS, -1)], pa.nulls(SKETCH_PARTS, pa.int64())
    yield pa.record_batch([none, none, none, none, pa.nulls(SKETCH_PARTS, pa.binary()), pa.array(range(SKETCH_PARTS), pa.int32()), pa.array(parts, pa.binary())], names)


def _sum_sketch(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(SKETCH // SKETCH_PARTS, np.int64)
    for c in pdf["counts"]:
        total += np.frombuffer(c, np.int32)
    return pd.DataFrame({"part": [pdf["part"].iloc[0]], "counts": [total.tobytes()]})


def frequent_buckets(passed: DataFrame) -> np.ndarray:
    """Which of the sketch's buckets hold a frequent shingle: a fixed number of flags, whatever the size of the input."""
    parts = passed.filter("part IS NOT NULL").select("part", "counts").groupBy("part").applyInPandas(_sum_sketch, "part int, counts binary").collect()
    total, each = np.zeros(SKETCH, np.int64), SKETCH // SKETCH_PARTS
    for r in parts:
        total[r.part * each : (r.part + 1) * each] = np.frombuffer(bytes(r.counts), np.int64)
    return total > 2 * total.mean() + 50


def bitmap(s: np.ndarray) -> bytes:
    """Bits of a set, at two to four bits a shingle, small sets at more; the width is a power of two, so a wide bitmap folds onto a narrower one."""
    width = min(_LONGEST, max(_SHORTEST, 1 << int(np.ceil(np.log2(2 * max(1, len(s)))))))
    bits = np.zeros(width, bool)
    bits[((s >> np.uint64(20)) % np.uint64(width)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _posts(frequent: np.ndarray):
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            tokens, nodes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for _, data, off in scan.texts(batch.column("text")):
                sets, n, node = sets_of(data, off)
                for s, own in zip(sets, node.tolist()):
                    if not len(s) or own in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(own)
                    hot = frequent[(s % np.uint64(SKETCH)).astype(np.int64)]
                    first = np.concatenate([s[~hot], s[hot]])[: len(s) - -(-NEED * len(s) // OF) + 1]
                    tokens.append(first)
                    nodes.append(np.full(len(first), own))
            yield pa.record_batch([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(nodes))], ["token", "node"])

    return run


class Forest:
    """Signature trees of many groups, level by level from the leaves. Rows come sorted by unit (the tree they belong to)."""

    def __init__(self, unit: np.ndarray, bits: np.ndarray, n: np.ndarray, comp: np.ndarray):
        none = np.zeros(len(n), np.int64)
        self.levels = [{"unit": unit, "bits": bits, "low": n, "high": n, "excess": n - np.bitwise_count(bits).sum(1).astype(np.int64), "one": comp, "first": none, "count": none}]
        while len(self.levels[-1]["unit"]) > len(np.unique(unit)):
            self.raise_level()

    def raise_level(self) -> None:
        x = self.levels[-1]
        opens = np.flatnonzero(np.concatenate([[True], x["unit"][1:] != x["unit"][:-1]]))
        sizes = np.diff(np.append(opens, len(x["unit"])))
        at = np.flatnonzero((np.arange(len(x["unit"])) - np.repeat(opens, sizes)) % FANOUT == 0)
        least, most = np.minimum.reduceat(x["one"], at), np.maximum.reduceat(x["one"], at)
        self.levels.append(
            {
                "unit": x["unit"][at],
                "bits": np.bitwise_or.reduceat(x["bits"], at, axis=0),
                "low": np.minimum.reduceat(x["low"], at),
                "high": np.maximum.reduceat(x["high"], at),
                "excess": np.maximum.reduceat(x["excess"], at),
                "one": np.where(least == most, least, -1),
                "first": at,
                "count": np.diff(np.append(at, len(x["unit"]))),
            }
        )

    def roots(self, units: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.levels[-1]["unit"], units)


def possible(a: dict, i: np.ndarray, b: dict, j: np.ndarray) -> np.ndarray:
    """Which pairs of nodes may hold a linked pair of different components."""
    ok = (NEED * np.maximum(a["low"][i], b["low"][j]) <= OF * np.minimum(a["high"][i], b["high"][j])) & ((a["one"][i] != b["one"][j]) | (a["one"][i] < 0))
    out = np.zeros(len(ok), bool)
    at = np.flatnonzero(ok)
    step = max(64, (1 << 20) // a["bits"].shape[1])
    for lo in range(0, len(at), step):
        x, y = i[at[lo : lo + step]], j[at[lo : lo + step]]
        most = np.bitwise_count(a["bits"][x] & b["bits"][y]).sum(1).astype(np.int64) + np.minimum(a["excess"][x], b["excess"][y])
        out[at[lo : lo + step]] = (NEED + OF) * most >= NEED * (a["low"][x] + b["low"][y])
    return out


def walk(a: Forest, b: Forest, i: np.ndarray, j: np.ndarray, most: int = 1 << 19):
    """Yields pairs of leaves that no bound excludes, from pairs of roots (i, j) of forests of one height; at most about `most` pairs are open at once."""
    todo = [(len(a.levels) - 1, i, j)]
    while todo:
        level, i, j = todo.pop()
        if a is b:
            i, j = i[i <= j], j[i <= j]
        ok = possible(a.levels[level], i, b.levels[level], j)
        i, j = i[ok], j[ok]
        if not level or not len(i):
            yield i, j
            continue
        x, y = a.levels[level], b.levels[level]
        step = max(1, most // FANOUT**2)
        for lo in range(0, len(i), step):
            p, q = i[lo : lo + step], j[lo : lo + step]
            wide = y["count"][q]
            total = x["count"][p] * wide
            owner = np.repeat(np.arange(len(p)), total)
            k = np.arange(len(owner)) - np.repeat(np.cumsum(total) - total, total)
            todo.append((level - 1, x["first"][p][owner] + k // wide[owner], y["first"][q][owner] + k % wide[owner]))


def _bounds(a: dict, b: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Largest possible overlap of pairs of leaves over the sum of their sizes."""
    out, step = np.zeros(len(i)), max(64, (1 << 20) // a["bits"].shape[1])
    for lo in range(0, len(i), step):
        x, y = i[lo : lo + step], j[lo : lo + step]
        out[lo : lo + step] = (np.bitwise_count(a["bits"][x] & b["bits"][y]).sum(1) + np.minimum(a["excess"][x], b["excess"][y])) / (a["low"][x] + b["low"][y])
    return out


def _best(score: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which pairs are the best by score for one of their two leaves; names: the nodes of both."""
    leaf, other, both = names.T.ravel(), names[:, ::-1].T.ravel(), np.tile(score, 2)
    order = np.lexsort((other, -both, leaf))
    keep = np.zeros(len(score), bool)
    if len(score):
        keep[order[np.concatenate([[True], np.diff(leaf[order]) != 0])] % len(score)] = True
    return keep


def _siblings(pdf: pd.DataFrame) -> pd.DataFrame:
    """Each leaf with its best partner under one bottom node of its group's tree, for trees that begin at two places."""
    pdf = pdf.assign(width=pdf["bits"].str.len() // 8).sort_values(["gid", "block", "width", "first", "n", "node"], kind="stable")
    node, n, raw, width = (pdf[c].to_numpy() for c in ("node", "n", "bits", "width"))
    unit = pdf.groupby(["gid", "block", "width"], sort=False).ngroup().to_numpy(np.int64)
    found = [np.zeros((0, 2), np.int64)]
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        leaves = Forest(unit[rows], _matrix(list(raw[rows]), w), n[rows].astype(np.int64), np.arange(len(rows))).levels[0]
        at = np.arange(len(rows)) - np.searchsorted(unit[rows], unit[rows])
        i, j = [], []
        for k in range(1, FANOUT):
            x, y = np.arange(len(rows) - k), np.arange(k, len(rows))
            under = (unit[rows][x] == unit[rows][y]) & ((at[x] // FANOUT == at[y] // FANOUT) | ((at[x] + FANOUT // 2) // FANOUT == (at[y] + FANOUT // 2) // FANOUT))
            i.append(x[under])
            j.append(y[under])
        i, j = np.concatenate(i), np.concatenate(j)
        ok = possible(leaves, i, leaves, j)
        i, j = i[ok], j[ok]
        names = np.stack([node[rows[i]], node[rows[j]]], 1)
        found.append(names[_best(_bounds(leaves, leaves, i, j), names)])
    return _pairs(np.concatenate(found), None)


def _pairs(pairs: np.ndarray, partial: np.ndarray | None) -> pd.DataFrame:
    partial = np.zeros(len(pairs), bool) if partial is None else partial
    out = pd.DataFrame({"a": pairs.min(1), "b": pairs.max(1), "partial": partial}) if len(pairs) else pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1], "partial": partial})
    return out[out["a"] != out["b"]].groupby(["a", "b"], as_index=False, sort=True)["partial"].max().astype({"a": np.int64, "b": np.int64, "partial": bool})


def _matrix(raw: list[bytes], words: int) -> np.ndarray:
    """Bitmaps of one width as rows, folded to `words` words."""
    m = np.frombuffer(b"".join(raw), np.uint64).reshape(len(raw), -1)
    while m.shape[1] > words:
        m = m[:, : m.shape[1] // 2] | m[:, m.shape[1] // 2 :]
    return m


def _tree_pairs(many: int | None):
    return lambda pdf: _candidates(pdf, many)


def _candidates(pdf: pd.DataFrame, many: int | None) -> pd.DataFrame:
    """Candidates of the groups that share a task. Sets that may link have bitmaps of one width, or of one and twice that.

    `partial` marks pairs that stand for more than `many` of their two components.
    """
    pdf = pdf.assign(width=pdf["bits"].str.len() // 8).sort_values(["gid", "left", "right", "block", "comp", "first", "n", "node"], kind="stable")
    group = pdf.groupby(["gid", "left", "right"], sort=False).ngroup().to_numpy(np.int64)
    # A unit is one side of a group: twice the group, plus one for the right block.
    unit = 2 * group + ((pdf["block"] == pdf["right"]) & (pdf["left"] != pdf["right"])).to_numpy(np.int64)
    selfs = np.unique(group[(pdf["left"] == pdf["right"]).to_numpy()])
    width, n, node, comp, raw = pdf["width"].to_numpy(), pdf["n"].to_numpy(np.int64), pdf["node"].to_numpy(np.int64), pdf["comp"].to_numpy(np.int64), pdf["bits"].to_numpy()
    gid, low = pdf["gid"].to_numpy(np.int64), np.full((len(pdf), KNOWN), np.iinfo(np.int64).max)
    for k, known in enumerate(pdf["low"]):
        low[k, : len(known)] = known
    # Components are numbered within the task.
    comp = np.unique(comp, return_inverse=True)[1].astype(np.int64)
    found, partial = [np.zeros((0, 2), np.int64)], [np.zeros(0, bool)]

    def meet(a, b, rows_a, rows_b, left, right):
        """Walks the trees of the units left[k], right[k] where both exist."""
        ok = np.isin(left, a.levels[0]["unit"]) & np.isin(right, b.levels[0]["unit"])
        if ok.any():
            while len(a.levels) < len(b.levels):
                a.raise_level()
            while len(b.levels) < len(a.levels):
                b.raise_level()
            for i, j in walk(a, b, a.roots(left[ok]), b.roots(right[ok])):
                met, here = np.zeros(len(i), bool), gid[rows_a[i]]
                for x, y in product(range(KNOWN), repeat=2):
                    x, y = low[rows_a[i], x], low[rows_b[j], y]
                    met |= (x == y) & (x < here)
                i, j = i[~met], j[~met]
                names = np.stack([node[rows_a[i]], node[rows_b[j]]], 1)
                more = np.zeros(len(i), bool)
                if many is not None and len(i) > many:
                    x, y = comp[rows_a[i]], comp[rows_b[j]]
                    _, which, count = np.unique(np.minimum(x, y) * (len(comp) + 1) + np.maximum(x, y), return_inverse=True, return_counts=True)
                    more = count[which] > many
                    keep = ~more | _best(_bounds(a.levels[0], b.levels[0], i, j), names)
                    names, more = names[keep], more[keep]
                found.append(names)
                partial.append(more)

    every = np.unique(group)
    others = every[~np.isin(every, selfs)]
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        a = Forest(unit[rows], _matrix(list(raw[rows]), w), n[rows], comp[rows])
        meet(a, a, rows, rows, 2 * selfs, 2 * selfs)
        meet(a, Forest(unit[rows], a.levels[0]["bits"], n[rows], comp[rows]), rows, rows, 2 * others, 2 * others + 1)
        twice = np.flatnonzero(width == 2 * w)
        if len(twice):
            b = Forest(unit[twice], _matrix(list(raw[twice]), w), n[twice], comp[twice])
            meet(a, b, rows, twice, 2 * selfs, 2 * selfs)
            meet(a, b, rows, twice, 2 * others, 2 * others + 1)
            meet(a, b, rows, twice, 2 * others + 1, 2 * others)
    return _pairs(np.concatenate(found), np.concatenate(partial))


def _sets(wanted):
    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(wanted(batch.column("doc_id").to_numpy(zero_copy_only=False))))
            nodes, items = [np.zeros(0, np.int64)], []
            for _, data, off in scan.texts(batch.column("text")):
                sets, _, node = sets_of(data, off)
                nodes.append(node)
                items += [s.tobytes() for s in sets]
            yield pa.record_batch([pa.array(np.concatenate(nodes)), pa.array(items, pa.binary())], ["node", "items"])

    return run


def _verify(batches):
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("items_a").to_pylist(), batch.column("items_b").to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            small, large = (x, y) if len(x) < len(y) else (y, x)
            at = np.searchsorted(large, small)
            both = int((large[np.minimum(at, len(large) - 1)] == small).sum()) if len(small) else 0
            keep.append(OF * both >= NEED * (len(x) + len(y) - both) and both > 0)
        got = batch.filter(pa.array(keep, pa.bool_()))
        yield pa.record_batch([got.column("a"), got.column("b")], ["a", "b"])


class Join:
    """One run: its tables, and the links found so far."""

    def __init__(self, docs: DataFrame):
        self.docs = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.shelf, self.parts = Shelf(docs.sparkSession), shuffle_count(docs)
        self.passed = self.shelf.keep(self.docs.mapInArrow(_first_pass, _FIRST_PASS))
        self.named = self.docs.filter("doc_id IS NOT NULL")
        known = self.passed.filter("part IS NULL AND doc_id IS NOT NULL AND node IS NOT NULL")
        self.nodes = self.shelf.keep(known.groupBy("node").agg(F.min("doc_id").alias("id"), *(F.first(c).alias(c) for c in ("n", "first", "bits"))))
        self.bytes_a_leaf = (self.nodes.agg(F.avg(F.octet_length("bits"))).first()[0] or 0) + 64
        # An id with several texts links their nodes.
        several = known.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z").drop("z")
        self.links = self.shelf.keep(known.select("doc_id", F.col("node").alias("b")).join(several, "doc_id").filter("a <> b").select("a", "b").distinct())

    def lanes(self, rows: DataFrame, *place: str) -> DataFrame:
        """rows with `lane`: as many lanes as leave each a bounded number of bytes, for hashes fall evenly."""
        n = max(self.parts, int(rows.count() * self.bytes_a_leaf / TASK_BYTES) + 1)
        return rows.join(self.nodes.select("node", "n", "first", "bits"), "node").withColumn("lane", bucket_of(*place, n=n)).groupBy("lane")

    def groups(self) -> DataFrame:
        """(gid, node): the nodes that share a shingle of their prefixes, once for all shingles that the same nodes share."""
        posts = self.named.select("text").mapInArrow(_posts(frequent_buckets(self.passed)), "token long, node long")
        from pyspark.sql import Window as W

        whole = W.partitionBy("token")
        marked = posts.withColumn("lo", F.min("node").over(whole)).withColumn("hi", F.max("node").over(whole)).withColumn("x", F.bit_xor(F.xxhash64("node")).over(whole))
        return self.shelf.keep(marked.filter("lo <> hi").select(F.xxhash64("x", "lo", "hi").alias("gid"), "node").distinct())

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets reach the bound; only texts that occur in pairs are hashed again."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = self.shelf.keep(self.nodes.select("node", "id").join(wanted, "node"))
        sets = self.named.mapInArrow(_sets(id_filter(wanted.select("id"))), "node long, items binary")
        sets = sets.join(wanted.select("node"), "node", "left_semi").groupBy("node").agg(F.first("items").alias("items"))
        sets = self.shelf.keep(sets)
        with_a = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("items").alias("items_a")), "a")
        both = with_a.join(sets.select(F.col("node").alias("b"), F.col("items").alias("items_b")), "b")
        out = self.shelf.keep(both.select("a", "b", "items_a", "items_b").mapInArrow(_verify, "a long, b long"))
        self.shelf.drop(wanted, sets)
        return out

    def add(self, pairs: DataFrame) -> None:
        found, before = self.verified(pairs), self.links
        self.links = self.shelf.keep(before.unionByName(found))
        self.shelf.drop(found, before)

    def first_links(self, groups: DataFrame) -> None:
        """Joins leaves under one bottom node, in two groups a leaf."""
        picks = groups.groupBy("node").agg(F.min("gid").alias("a"), F.max("gid").alias("b"))
        picks = picks.select("node", F.explode(F.array_distinct(F.array("a", "b"))).alias("gid"))
        picks = self.shelf.keep(picks)
        sizes = picks.groupBy("gid").agg(F.count("*").alias("members")).filter("members > 1")
        rows = picks.join(sizes, "gid").withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / BLOCK))).drop("members")
        near = self.shelf.keep(self.lanes(rows, "gid", "block").applyInPandas(_siblings, "a long, b long, partial boolean").select("a", "b").distinct())
        self.add(near)
        self.shelf.drop(picks, near)

    def open_groups(self, groups: DataFrame, among: DataFrame | None) -> DataFrame:
        """Leaves of groups with more than one component, dealt over pairs of blocks; only those of components `among`, if given.

        A group's largest component has blocks of its own where the group is large, numbered -1, -2, ...; they do not meet
        each other.
        """
        comps = components(self.links).select(F.col("id").alias("node"), F.col("component_id").alias("comp"))
        known = groups.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("gid")), 1, KNOWN).alias("low"))
        rows = groups.join(known, "node").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        rows = rows if among is None else rows.join(among, "comp", "left_semi")
        each = rows.groupBy("gid", "comp").agg(F.count("*").alias("c"))
        spread = each.groupBy("gid").agg(F.max_by("comp", "c").alias("hub"), F.max("c").alias("m"), F.sum("c").alias("total"), F.count("*").alias("comps")).filter("comps > 1")
        large = F.col("total") > BLOCK
        spread = spread.withColumn("hubs", F.when(large, F.ceil(F.col("m") / BLOCK)).otherwise(0).cast("int")).withColumn("blocks", F.when(large, F.ceil((F.col("total") - F.col("m")) / BLOCK)).otherwise(1).cast("int"))
        rows = rows.join(spread.select("gid", "hub", "hubs", "blocks"), "gid")
        in_hub, turn = (F.col("comp") == F.col("hub")) & (F.col("hubs") > 0), F.xxhash64("node", F.lit(1))
        rows = rows.withColumn("block", F.when(in_hub, -1 - F.pmod(turn, F.greatest("hubs", F.lit(1)))).otherwise(F.pmod(turn, "blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.when(in_hub, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.sequence(-F.col("hubs"), F.col("blocks") - 1))))
        return self.shelf.keep(rows.select("gid", "node", "comp", "low", "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right")))

    def walk(self, groups: DataFrame, many: int | None, among: DataFrame | None = None) -> DataFrame | None:
        """Walks the trees of open groups and adds what they link. Returns the components (comp) of which pairs are left to walk, if any."""
        ready = self.open_groups(groups, among)
        pairs = self.lanes(ready, "gid", "left", "right").applyInPandas(_tree_pairs(many), "a long, b long, partial boolean")
        pairs = self.shelf.keep(pairs.groupBy("a", "b").agg(F.max("partial").alias("partial")))
        self.add(pairs)
        rest = pairs.filter("partial").select("a", "b")
        if rest.isEmpty():
            return None
        comps = components(self.links)
        for side in ("a", "b"):
            rest = rest.join(comps.select(F.col("id").alias(side), F.col("component_id").alias(f"comp_{side}")), side, "left").withColumn(f"comp_{side}", F.coalesce(f"comp_{side}", side))
        rest = self.shelf.keep(rest.filter("comp_a <> comp_b").select(F.explode(F.array("comp_a", "comp_b")).alias("comp")).distinct())
        self.shelf.drop(ready, pairs)
        return None if rest.isEmpty() else rest

    def result(self) -> DataFrame:
        comps = components(self.links).select(F.col("id").alias("node"), F.col("component_id").alias("label"))
        known = self.nodes.select("node", "id").join(comps, "node", "left").withColumn("label", F.coalesce("label", "node"))
        least = known.groupBy("label").agg(F.min("id").alias("component_id"))
        known = known.join(least, "label").select("node", F.col("id").alias("class_id"), "component_id")
        rows = self.passed.filter("part IS NULL").select("doc_id", "n", "node")
        ids = rows.filter("doc_id IS NOT NULL").join(known, "node", "left").groupBy("doc_id")
        ids = ids.agg(F.max("n").alias("n_shingles"), F.coalesce(F.min("class_id"), "doc_id").alias("class_id"), F.coalesce(F.min("component_id"), "doc_id").alias("component_id"))
        none = F.lit(None).cast("long")
        return ids.unionByName(rows.filter("doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), none.alias("class_id"), none.alias("component_id")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) for each document of docs(doc_id, text).

    class_id is the smallest doc_id with the same set, component_id the smallest one reachable by links.
    """
    run = Join(docs)
    groups = run.groups()
    run.first_links(groups)
    left = run.walk(groups, MANY)
    if left is not None:
        run.walk(groups, None, left)
    run.shelf.drop(groups)
    return run.result()
