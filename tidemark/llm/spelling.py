"""Spelling variants of the corpus's words by a trie of letter-group counts.

A word is a vector of counts, one a letter group: how often letters of the group occur in it. One inserted code point adds one to a
count, one deleted takes one off, one replaced does both or neither. So words within one edit have vectors that differ by a
surplus of one and a deficit of one at most. A trie arranges the words by one group's count after the other; a depth-first
search follows a word's own counts and spends that budget on the way. Words at the leaves that it reaches are verified.

The upper trie is cut where a node holds NODE_WORDS words or fewer (or a share of 1 / PARTS of a larger vocabulary): what lies
below such a node is built and searched in one task. A few numbers a node of the upper trie reach the driver, by level; with them
every word is sent to the nodes that its budget reaches, its own one among them. A task returns a row a word, with the number of
its near words there and the best of them, so pairs are never written out.

Defined results: a null text has no runs; a null doc_id is empty in the hash of a run. Rows that share a doc_id are texts of
their own. Extra columns are ignored; a corpus without words gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import bounded_batches, cut, table

LEAST, TWICE, FORM_TIMES, SPOIL = 7, 2, 10, 31
#: Words that a task takes at most as targets, and the number of tasks beyond which these grow instead.
NODE_WORDS, PARTS = 8192, 20_000
#: A leaf of the trie in a task; words listed at once; words of more code points are verified one by one.
FEW, AT_ONCE, WIDE, MANY = 8, 1 << 16, 32, 64
#: Words that a task counts before it passes them on; texts that are read run by run.
HELD, LONG = 200_000, 1 << 20

RUNS = re.compile("[a-zÀ-ÿ]{7,}")
_LETTERS = b"eainrtosldcumhgpbkfvwyzjqx"
LEVELS = len(_LETTERS) + 6
_GROUP = np.array([len(_LETTERS) + b % 6 for b in range(256)])
_GROUP[list(_LETTERS)] = np.arange(len(_LETTERS))


def _counted(counts: Counter):
    yield pa.record_batch([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])


def _runs(batches):
    """Words and how often they occur in some texts, after the spoiling of some runs of a document."""
    total = Counter()
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id"), pc.ascii_lower(batch.column("text"))):
            text = text.as_py()
            if not text:
                continue
            found = Counter(RUNS.findall(text) if len(text) < LONG else (m.group() for m in RUNS.finditer(text)))
            start = zlib.crc32(f"{'' if doc_id.as_py() is None else doc_id.as_py()}:".encode())
            for run, n in found.items():
                h = zlib.crc32(run.encode(), start)
                if h % SPOIL == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                    if len(run) < LEAST:
                        continue
                total[run] += n
            if len(total) > HELD:
                yield from _counted(total)
                total.clear()
    yield from _counted(total)


def words(docs: DataFrame) -> DataFrame:
    """(word, n): words of LEAST code points or more that occur TWICE or more in docs(doc_id, text)."""
    found = bounded_batches(docs).select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_runs, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= TWICE)


def vectors(raw: list[bytes]) -> np.ndarray:
    """(n, LEVELS) counts of words in Latin-1. Counts over 250 are cut, which only brings vectors nearer."""
    flat = np.frombuffer(b"".join(raw), np.uint8)
    owner = np.repeat(np.arange(len(raw)), [len(w) for w in raw])
    return np.minimum(np.bincount(owner * LEVELS + _GROUP[flat], minlength=len(raw) * LEVELS), 250).astype(np.uint8).reshape(-1, LEVELS)


def search(levels: list, vec: np.ndarray):
    """Depth-first: for each vector the leaves within a surplus of one and a deficit of one. Yields (vectors, leaves, whether exact).

    A level is (keys, inner, leaf): the children of its nodes by node * 256 + count, ascending; each is a node of the next level
    (inner) or a leaf, and -1 of the other.
    """
    stack = [(0, np.arange(len(vec)), *(np.zeros(len(vec), np.int64) for _ in range(3)))]
    while stack:
        depth, q, node, up, down = stack.pop()
        if len(q) > AT_ONCE:
            stack += [(depth, *(x[lo : lo + AT_ONCE] for x in (q, node, up, down))) for lo in range(0, len(q), AT_ONCE)]
            continue
        keys, inner, leaf = levels[depth]
        met = []
        for more in (-1, 0, 1):
            may = down == 0 if more < 0 else up == 0 if more else np.ones(len(q), bool)
            count = vec[q, depth].astype(np.int64) + more
            key = np.where(may & (count >= 0), node * 256 + count, -1)
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == key)
            met.append((q[hit], at[hit], up[hit] + (more > 0), down[hit] + (more < 0)))
        q, at, up, down = (np.concatenate(x) for x in zip(*met))
        ends = leaf[at] >= 0
        yield q[ends], leaf[at[ends]], (up[ends] == 0) & (down[ends] == 0)
        on = ~ends
        if on.any():
            stack.append((depth + 1, q[on], inner[at[on]], up[on], down[on]))


def trie(vec: np.ndarray):
    """(levels, first, last): the trie of sorted vectors, whose leaves are ranges of them with FEW vectors or fewer, or of one vector."""
    differ = vec[1:] != vec[:-1]
    first_differ = np.r_[-1, np.where(differ.any(1), differ.argmax(1), LEVELS)]
    rows, node, levels, lows, highs, leaves = np.arange(len(vec)), np.zeros(len(vec), np.int64), [], [], [], 0
    for depth in range(LEVELS):
        new = np.r_[True, node[1:] != node[:-1]] | (first_differ[rows] == depth)
        start = np.flatnonzero(new)
        size = np.diff(np.r_[start, len(rows)])
        ends = (size <= FEW) | (depth == LEVELS - 1)
        leaf, inner = np.full(len(start), -1), np.full(len(start), -1)
        leaf[ends], inner[~ends] = leaves + np.arange(ends.sum()), np.arange((~ends).sum())
        lows.append(rows[start[ends]])
        highs.append(rows[start[ends]] + size[ends])
        leaves += ends.sum()
        levels.append((node[start] * 256 + vec[rows[start], depth], inner, leaf))
        child = np.cumsum(new) - 1
        stay = inner[child] >= 0
        rows, node = rows[stay], inner[child[stay]]
        if not len(rows):
            break
    return levels, np.concatenate(lows), np.concatenate(highs)


def _one_edit(a: bytes, b: bytes) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    n, k = min(len(a), len(b)), 0
    while k < n and a[k] == b[k]:
        k += 1
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


class _Words:
    """Words in Latin-1 laid out for comparison from both ends."""

    def __init__(self, raw: list[bytes]):
        self.raw, self.size = raw, np.array([len(w) for w in raw])
        lines = lambda ws: np.frombuffer(b"".join(w[:WIDE].ljust(WIDE, b"\0") for w in ws), np.uint8).reshape(-1, WIDE)
        self.ahead, self.back = lines(raw), lines([w[::-1][:WIDE] for w in raw])


def near(a: _Words, i: np.ndarray, b: _Words, j: np.ndarray) -> np.ndarray:
    """Which pairs of words differ by exactly one code point inserted, deleted or replaced."""
    long, short = np.maximum(a.size[i], b.size[j]), np.minimum(a.size[i], b.size[j])

    def shared(x, y):
        differ = x[i] != y[j]
        return np.minimum(np.where(differ.any(1), differ.argmax(1), WIDE), short)

    ahead = shared(a.ahead, b.ahead)
    ok = (long - short <= 1) & (ahead + shared(a.back, b.back) >= long - 1) & ~((ahead == long) & (short == long))
    for k in np.flatnonzero(long > WIDE):
        ok[k] = _one_edit(a.raw[i[k]], b.raw[j[k]])
    return ok


def _halves(raw: list[bytes], ids) -> dict:
    """Words of a large leaf by the beginnings and ends that a word within one edit has whole."""
    found = defaultdict(list)
    for k in ids:
        w = raw[k]
        for half in {(len(w) + d) // 2 for d in (-1, 0, 1)}:
            found[0, w[:half]].append(k)
        for rest in {n - n // 2 for n in (len(w) - 1, len(w), len(w) + 1)}:
            found[1, w[len(w) - rest :]].append(k)
    return found


def near_in_node(t: pa.Table) -> pa.Table:
    """For each word sent to a node: its near words among the node's own ones, and the best of them (most frequent, then smallest)."""
    raw = [w.encode("latin-1") for w in t.column("word").to_pylist()]
    n, own = t.column("n").to_numpy(), np.flatnonzero(t.column("own").to_numpy(zero_copy_only=False))
    vec = vectors(raw)
    own = own[np.lexsort(vec[own].T[::-1])]
    levels, low, high = trie(vec[own])
    all_words, targets = _Words(raw), _Words([raw[k] for k in own])
    # Places in the order of preference.
    liked = np.array(sorted(range(len(own)), key=lambda k: (-n[own[k]], targets.raw[k])))
    place = np.empty(len(own), np.int64)
    place[liked] = np.arange(len(own))
    best, count, halves = np.full(len(raw), len(own)), np.zeros(len(raw), np.int64), {}

    def take(q, j):
        gap = targets_vec[j].astype(np.int16) - vec[q]
        within = (np.maximum(gap, 0).sum(1) <= 1) & (np.maximum(-gap, 0).sum(1) <= 1)
        q, j = q[within], j[within]
        ok = near(all_words, q, targets, j)
        np.minimum.at(best, q[ok], place[j[ok]])
        np.add.at(count, q[ok], 1)

    targets_vec = vec[own]
    for q, leaf, _ in search(levels, vec):
        size = high[leaf] - low[leaf]
        for k in np.flatnonzero(size > MANY):
            if leaf[k] not in halves:
                halves[leaf[k]] = _halves(targets.raw, range(low[leaf[k]], high[leaf[k]]))
            w, h = raw[q[k]], halves[leaf[k]]
            half = len(w) // 2
            j = np.array(sorted({*h.get((0, w[:half]), ()), *h.get((1, w[half:]), ())}), np.int64)
            take(np.full(len(j), q[k]), j)
        q, leaf, size = (x[size <= MANY] for x in (q, leaf, size))
        for lo in range(0, len(q), AT_ONCE // MANY):
            s = size[lo : lo + AT_ONCE // MANY]
            j = np.repeat(low[leaf[lo : lo + len(s)]] - np.r_[0, np.cumsum(s)[:-1]], s) + np.arange(s.sum())
            take(np.repeat(q[lo : lo + len(s)], s), j)
    mine = np.zeros(len(raw), bool)
    mine[own] = True
    out = np.flatnonzero(mine | (count > 0))
    got = liked[np.where(count[out] > 0, best[out], 0)]
    none = pa.array(count[out] == 0)
    best_word = pc.if_else(none, pa.scalar(None, pa.string()), t.column("word").take(pa.array(own[got])))
    best_n = pc.if_else(none, pa.scalar(None, pa.int64()), pa.array(n[own[got]]))
    return pa.table([t.column("word").take(pa.array(out)), pa.array(n[out]), pa.array(count[out]), best_n, best_word], ["word", "n", "n_near", "near_n", "near_word"])


def upper_trie(vecs: DataFrame, most: int) -> list:
    """Levels of the trie whose leaves hold `most` words or fewer, as far as one vector can be split. A level is counted by Spark; its nodes are as many as there are leaves at most."""
    levels, parents, leaves = [], {b"": 0}, 0
    for depth in range(LEVELS):
        prefix, above = F.substring("vec", 1, depth + 1), F.substring("vec", 1, depth)
        of = vecs if depth == 0 else vecs.join(F.broadcast(vecs.sparkSession.createDataFrame([(p,) for p in parents], "p binary")), above == F.col("p"), "left_semi")
        nodes = sorted((bytes(r.p), r["n"]) for r in of.groupBy(prefix.alias("p")).agg(F.count("*").alias("n")).collect())
        nodes.sort(key=lambda x: parents[x[0][:-1]] * 256 + x[0][-1])
        ends = np.array([n <= most or depth == LEVELS - 1 for _, n in nodes])
        leaf, inner = np.full(len(nodes), -1), np.full(len(nodes), -1)
        leaf[ends], inner[~ends] = leaves + np.arange(ends.sum()), np.arange((~ends).sum())
        levels.append((np.array([parents[p[:-1]] * 256 + p[-1] for p, _ in nodes]), inner, leaf))
        leaves += int(ends.sum())
        parents = {p: int(k) for (p, _), k in zip(nodes, inner) if k >= 0}
        if not parents:
            break
    return levels


def _with_vectors(batches):
    for batch in batches:
        raw = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
        vec = vectors(raw)
        yield pa.record_batch([*batch.columns, pa.array([v.tobytes() for v in vec], pa.binary())], [*batch.schema.names, "vec"])


def _sent(levels):
    def run(batches):
        for batch in batches:
            vec = np.frombuffer(b"".join(batch.column("vec").to_pylist()), np.uint8).reshape(-1, LEVELS)
            for q, leaf, own in search(levels, vec):
                at = pa.array(q)
                yield pa.record_batch([pa.array(leaf), batch.column("word").take(at), batch.column("n").take(at), pa.array(own)], ["node", "word", "n", "own"])

    return run


def near_words(vocabulary: DataFrame, node_words: int = NODE_WORDS) -> DataFrame:
    """(word, n, n_near, near_n, near_word) of every word of vocabulary(word, n): how many words are within one edit, and the best of them."""
    vecs = cut(vocabulary.select("word", "n").mapInArrow(_with_vectors, "word string, n long, vec binary"))
    total = vecs.count()
    if not total:
        return vecs.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.col("n").alias("near_n"), F.col("word").alias("near_word"))
    levels = upper_trie(vecs, max(node_words, -(-total // PARTS)))
    sent = vecs.mapInArrow(_sent(levels), "node long, word string, n long, own boolean")
    found = sent.groupBy("node").applyInArrow(near_in_node, "word string, n long, n_near long, near_n long, near_word string")
    best = F.min(F.when(F.col("n_near") > 0, F.struct((-F.col("near_n")).alias("k"), F.col("near_word").alias("w"))))
    merged = found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b"))
    return merged.select("word", "n", "n_near", (-F.col("b.k")).alias("near_n"), F.col("b.w").alias("near_word"))


def variants(docs: DataFrame, node_words: int = NODE_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the words of docs(doc_id, text).

    A form is at least FORM_TIMES as frequent as its word, so a chain of them has no more links than a count has digits, and
    doubling its reach settles it in a few joins. A word is the form of no more words than lie within one edit.
    """
    is_form = F.col("near_n") >= F.col("n") * FORM_TIMES
    found = cut(near_words(cut(words(docs)), node_words).select("word", "n", "n_near", F.when(is_form, F.col("near_word")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")))
    roots = cut(found.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if roots.join(ahead, "root", "left_semi").isEmpty():
            break
        roots = cut(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
