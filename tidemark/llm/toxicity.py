"""Toxicity classifier: subword-bag embeddings, averaged, under a linear softmax; both are trained together in numpy.

A word is the bag of all its byte n-grams (with word edges) and itself, hashed to a fixed number of embeddings; a text is the
mean of its words. Words end at white space and ASCII signs, so a text without them is one word, of which every byte counts. A
misspelt word shares most n-grams with the word it stands for, seen or not. Training reads whole texts of a sample of labelled
documents that are not held out, of at most TRAIN_ROWS rows and TRAIN_BYTES together; the rarer class counts more, by the root
of the classes' ratio.

Because the softmax is linear, a word's part of the score is one number; tasks keep it for the words they have met.

Defined results: a null text counts as empty; a text without words gets the score of the bias alone. Repeated rows are scored
each. A null doc_id has a null held_out. Without labelled rows of both classes every score is the share of label 1 in the sample. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import scan
from tidemark.llm.labelled import held_out, sample
from tidemark.llm.shared import bounded_batches, table

GRAMS = (3, 4, 5)
BUCKETS, DIMS = 1 << 18, 4
TRAIN_ROWS, TRAIN_BYTES = 8000, 24 << 20
#: Passes over the sample, or more where it is small, so that a model takes STEPS steps at least.
EPOCHS, STEPS, BATCH, RATE = 10, 1000, 128, 0.05
THRESHOLD = 0.5
#: Bytes of text whose n-grams are held at once. A longer word is read piece by piece.
PART_BYTES = 1 << 19
#: N-grams of distinct words that training holds, four bytes each; with more, those of a batch are made for each step.
HELD_GRAMS = 1 << 24


_SIGNS = np.zeros(256, bool)
_SIGNS[list(scan.WORD_BREAKS)] = True
_SIGNS[list(b".,;:!?%$#&*()[]{}\"/|-+=@~<>_'")] = True


def words(data: np.ndarray, off: np.ndarray):
    """(lower-case bytes, starts, ends, text index) of the words, cut at white space and ASCII signs."""
    data = scan.lower(data)
    return data, *scan.spans(data, off, _SIGNS)


def subwords(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(embedding numbers, word index) of the n-grams of each word, ascending by word."""
    size = ends - starts + 2
    base = np.cumsum(size) - size
    buf = np.full(int(size.sum()), ord("<"), np.uint8)
    owner = np.repeat(np.arange(len(size)), size)
    k = np.arange(len(buf)) - base[owner]
    inner = (k > 0) & (k < size[owner] - 1)
    buf[inner] = data[(starts[owner] + k - 1)[inner]]
    buf[base + size - 1] = ord(">")
    ids, who = [scan.span_hashes(buf, base, base + size)], [np.arange(len(size))]
    for g in GRAMS:
        at = np.flatnonzero(k + g <= size[owner])
        ids.append(scan.span_hashes(buf, at, at + g))
        who.append(owner[at])
    ids, who = (np.concatenate(ids) % np.uint64(BUCKETS)).astype(np.int32), np.concatenate(who)
    order = np.argsort(who, kind="stable")
    return ids[order], who[order]


def word_means(parts: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mean of `parts` over the n-grams of each word; the n-grams of about PART_BYTES are held at once."""
    out, size = np.zeros(len(starts)), ends - starts
    long = size > PART_BYTES
    for k in np.flatnonzero(long):
        word = np.concatenate([np.frombuffer(b"<", np.uint8), data[starts[k] : ends[k]], np.frombuffer(b">", np.uint8)])
        total, count = float(parts[int(scan.span_hashes(word, np.array([0]), np.array([len(word)]))[0] % np.uint64(BUCKETS))]), 1
        for lo in range(0, len(word), PART_BYTES):
            piece = word[lo : lo + PART_BYTES + max(GRAMS) - 1]
            for g in GRAMS:
                at = np.arange(min(PART_BYTES, len(piece) - g + 1))
                total += parts[(scan.span_hashes(piece, at, at + g) % np.uint64(BUCKETS)).astype(np.int32)].sum(dtype=np.float64)
                count += len(at)
        out[k] = total / count
    rest = np.flatnonzero(~long)
    for which in np.split(rest, np.flatnonzero(np.diff(np.cumsum(size[rest]) // PART_BYTES)) + 1):
        ids, who = subwords(data, starts[which], ends[which])
        out[which] = np.bincount(who, parts[ids], len(which)) / np.bincount(who, minlength=len(which))
    return out


class Model:
    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.p = {"grams": r.normal(0, 0.001, (BUCKETS, DIMS)), "classes": r.normal(0, 0.3, (DIMS, 2)), "bias": np.zeros(2)}
        self.m, self.v, self.t = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0

    def parts(self) -> tuple[np.ndarray, float]:
        """(what each embedding adds to the difference of the two logits, the bias)."""
        side = self.p["classes"][:, 1] - self.p["classes"][:, 0]
        return self.p["grams"] @ side, float(self.p["bias"][1] - self.p["bias"][0])

    def step(self, grams, own, word, doc, y, rate, weight):
        """own: numbers of the batch's distinct words; word/doc: the words of each text in order, by place in own; weight: of each class."""
        p, n_words, per_word = self.p, len(own), grams.count[own].astype(float)
        vec, met, cuts = np.zeros((n_words, DIMS)), np.zeros(BUCKETS, bool), grams.cuts(own)
        one = grams.part(own) if len(cuts) == 2 else None
        for lo, hi in zip(cuts, cuts[1:]):
            ids, who, times = one or grams.part(own[lo:hi])
            met[ids], opens = True, np.searchsorted(who, np.arange(hi - lo))
            for w in np.split(np.arange(hi - lo), np.flatnonzero(np.diff(opens // PART_BYTES)) + 1):
                a, b = opens[w[0]], opens[w[-1] + 1] if w[-1] + 1 < hi - lo else len(ids)
                rows = p["grams"][ids[a:b]]
                vec[lo + w] = np.add.reduceat(rows if times is None else rows * times[a:b, None], opens[w] - a, axis=0) / per_word[lo + w, None]
        size = np.maximum(np.bincount(doc, minlength=len(y)), 1)
        mean = np.stack([np.bincount(doc, vec[word, d], len(y)) for d in range(DIMS)], 1) / size[:, None]
        z = mean @ p["classes"] + p["bias"]
        z -= z.max(1, keepdims=True)
        soft = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        soft[np.arange(len(y)), y] -= 1
        d = soft * weight[y][:, None] / len(y)
        back = (d @ p["classes"].T) / size[:, None]
        to_word = np.stack([np.bincount(word, back[doc, k], n_words) for k in range(DIMS)], 1) / per_word[:, None]
        place, met = np.cumsum(met, dtype=np.int32) - 1, np.flatnonzero(met)
        sums = np.zeros((DIMS, len(met)))
        for lo, hi in zip(cuts, cuts[1:]):
            ids, who, times = one or grams.part(own[lo:hi])
            at = place[ids]
            for k in range(DIMS):
                back = to_word[lo:hi, k][who]
                sums[k] += np.bincount(at, back if times is None else back * times, len(met))
        g = {"classes": mean.T @ d, "bias": d.sum(0), "grams": sums.T}
        self.t += 1
        for k, x in g.items():
            # Only the embeddings met in the batch move.
            at = met if k == "grams" else slice(None)
            m, v = 0.9 * self.m[k][at] + 0.1 * x, 0.99 * self.v[k][at] + 0.01 * x * x
            self.m[k][at], self.v[k][at] = m, v
            p[k][at] -= rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-7)


def word_parts(texts: list[str]):
    """(lower-case bytes, starts, ends, text index) of the words of the texts in order, about PART_BYTES at a time; a longer word comes alone."""
    sizes = np.cumsum([len(t.encode()) for t in texts])
    groups = [0, *(np.flatnonzero(np.diff(sizes // PART_BYTES)) + 1), len(texts)]
    for first, last in zip(groups, groups[1:]):
        data, off = scan.column_bytes(pa.array(texts[first:last], pa.large_string()))
        lo = 0
        while lo < len(data):
            hi = min(lo + PART_BYTES, len(data))
            if hi < len(data):
                # A part ends behind a sign or with a text; without either it is one word, which goes on to the next of them.
                ends = np.concatenate([np.flatnonzero(_SIGNS[data[lo:hi]])[-1:] + lo + 1, off[(off > lo) & (off <= hi)][-1:]])
                while not len(ends):
                    signs = np.flatnonzero(_SIGNS[data[hi : hi + PART_BYTES]])[:1] + hi
                    ends = np.minimum(signs, off[off > hi][0]) if len(signs) else off[(off > hi) & (off <= hi + PART_BYTES)][:1]
                    hi += PART_BYTES
                hi = int(ends.max())
            at = np.searchsorted(off, lo, "right") - 1
            if hi - lo > PART_BYTES:
                yield scan.lower(data[lo:hi]), np.array([0]), np.array([hi - lo]), np.array([first + at])
            else:
                part, starts, ends, doc = words(data[lo:hi], np.concatenate([[lo], off[(off > lo) & (off < hi)], [hi]]) - lo)
                yield part, starts, ends, doc + first + at
            lo = hi


def whole_hash(word: np.ndarray) -> np.uint64:
    """The hash that `scan.span_hashes` gives to all of the bytes, from PART_BYTES of them at a time."""
    total = 0
    for lo in range(0, len(word), PART_BYTES):
        piece = word[lo : lo + PART_BYTES]
        total += int((scan._TABLE[piece] * scan.powers(len(piece))[0]).sum(dtype=np.uint64)) * pow(scan._BASE, lo, 1 << 64)
    return scan.mix(np.array([(total + len(word)) % (1 << 64)], np.uint64))[0]


def vocabulary(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the distinct words, start and end of each, words of the texts in order, their texts); words are numbered by hash.

    What is held follows the bytes of the texts: a word is kept once, and what a byte needs while words are cut is held for one
    part only.
    """
    known, number, seen = np.zeros(0, np.uint64), np.zeros(0, np.int32), 0
    kept, sizes, local, docs = bytearray(), [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for data, starts, ends, doc in word_parts(texts):
        h = scan.span_hashes(data, starts, ends) if len(data) <= PART_BYTES else np.array([whole_hash(data)])
        h, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(known, h)
        new = np.append(known, np.uint64(0))[at] != h
        new |= at == len(known)
        fresh = np.flatnonzero(new)
        fresh = fresh[np.argsort(first[fresh])]
        numbers = np.zeros(len(h), np.int32)
        numbers[~new], numbers[fresh] = number[at[~new]], seen + np.arange(len(fresh))
        known, number, seen = np.insert(known, at[new], h[new]), np.insert(number, at[new], numbers[new]), seen + len(fresh)
        raw, starts, ends = memoryview(data), starts[first[fresh]], ends[first[fresh]]
        kept += b"".join(raw[a:b] for a, b in zip(starts, ends))
        sizes.append(ends - starts)
        local.append(numbers[inverse])
        docs.append(doc.astype(np.int32))
    sizes = np.concatenate(sizes)
    ends = np.cumsum(sizes)
    rank = np.zeros(seen, np.int32)
    rank[number] = np.arange(seen)
    return np.frombuffer(bytes(kept), np.uint8), np.stack([ends - sizes, ends], 1)[number], rank[np.concatenate(local)], np.concatenate(docs)


class Grams:
    """N-grams of numbered words, for a bounded number of bytes at a time. Those of all words are held where there are at most HELD_GRAMS.

    A word of more than PART_BYTES is held as the embeddings that it meets and how often it meets each.
    """

    def __init__(self, data: np.ndarray, spans: np.ndarray):
        self.data, (self.starts, self.ends) = data, spans.T
        self.size = self.ends - self.starts
        self.count = 1 + sum(np.maximum(self.size + 3 - g, 0) for g in GRAMS)
        self.long = {int(k): self._counted(data[self.starts[k] : self.ends[k]]) for k in np.flatnonzero(self.size > PART_BYTES)}
        self.opens, self.held = np.concatenate([[0], np.cumsum(np.where(self.size > PART_BYTES, 0, self.count))]), None
        if self.opens[-1] <= HELD_GRAMS:
            every, held = np.arange(len(self.size)), np.zeros(self.opens[-1], np.int32)
            cuts = self.cuts(every, PART_BYTES // 8 + 1)
            for lo, hi in zip(cuts, cuts[1:]):
                if self.opens[lo] < self.opens[hi]:
                    held[self.opens[lo] : self.opens[hi]] = self.part(every[lo:hi])[0]
            self.held = held

    @staticmethod
    def _counted(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        word = np.concatenate([np.frombuffer(b"<", np.uint8), word, np.frombuffer(b">", np.uint8)])
        times = np.bincount([int(whole_hash(word) % np.uint64(BUCKETS))], minlength=BUCKETS)
        for lo in range(0, len(word), PART_BYTES):
            piece = word[lo : lo + PART_BYTES + max(GRAMS) - 1]
            for g in GRAMS:
                at = np.arange(min(PART_BYTES, len(piece) - g + 1))
                times += np.bincount((scan.span_hashes(piece, at, at + g) % np.uint64(BUCKETS)).astype(np.int32), minlength=BUCKETS)
        ids = np.flatnonzero(times).astype(np.int32)
        return ids, times[ids].astype(np.int32)

    def cuts(self, own: np.ndarray, most: int = 0) -> list[int]:
        """Where parts of own begin, and its end: about `most` (PART_BYTES) bytes each, a longer word alone."""
        if not len(own):
            return [0]
        size, most = self.size[own], most or PART_BYTES
        alone = size > PART_BYTES
        group = np.cumsum(np.where(alone, 0, size)) // most
        return [0, *(np.flatnonzero((np.diff(group) != 0) | alone[1:] | alone[:-1]) + 1).tolist(), len(own)]

    def part(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """(embedding numbers, place of their word in own, how often; None: once each) of one part of words."""
        if len(own) == 1 and int(own[0]) in self.long:
            ids, times = self.long[int(own[0])]
            return ids, np.zeros(len(ids), np.int64), times
        if self.held is None:
            return *subwords(self.data, self.starts[own], self.ends[own]), None
        count = self.count[own]
        at = np.repeat(self.opens[own] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return self.held[at], np.repeat(np.arange(len(own)), count), None


def train(texts: list[str], y: np.ndarray, seed: int = 5) -> Model:
    model, r = Model(seed), np.random.default_rng(seed)
    y = np.asarray(y, np.int64)
    share = (y.sum() + 1) / (len(y) + 2)
    model.p["bias"] = np.log(np.array([1 - share, share]))
    if len(set(y.tolist())) < 2:
        model.p["classes"] *= 0
        return model
    data, spans, word, doc = vocabulary(texts)
    bounds = np.searchsorted(doc, np.arange(len(y) + 1))
    del texts, doc
    grams = Grams(data, spans)
    count = np.bincount(y, minlength=2)
    weight = np.sqrt(count.max() / np.maximum(count, 1))
    steps = -(-len(y) // BATCH)
    epochs = max(EPOCHS, -(-STEPS // steps))
    total = epochs * steps
    for _ in range(epochs):
        order = r.permutation(len(y))
        for lo in range(0, len(y), BATCH):
            which = order[lo : lo + BATCH]
            each = bounds[which + 1] - bounds[which]
            w = np.concatenate([word[bounds[i] : bounds[i + 1]] for i in which])
            own, local = np.unique(w, return_inverse=True)
            model.step(grams, own, local, np.repeat(np.arange(len(which)), each), y[which], RATE * (1 - model.t / total) + 0.002, weight)
    return model


class _Words(scan.Memo):
    def __init__(self, parts: np.ndarray):
        super().__init__(1, np.float64)
        self.parts = parts

    def means(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        data, starts, ends, doc = words(data, off)
        n = len(off) - 1
        if not len(starts):
            return np.zeros(n)

        values = self.look(scan.span_hashes(data, starts, ends), lambda which: word_means(self.parts, data, starts[which], ends[which])[:, None])
        return np.bincount(doc, values[:, 0], n) / np.maximum(np.bincount(doc, minlength=n), 1)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of docs(doc_id, text); score is the probability of label 1."""
    parts, bias = model.parts()
    parts = parts.astype(np.float32)

    def run(batches):
        memo = _Words(parts)
        for batch in batches:
            got = [memo.means(data, off) for _, data, off in scan.texts(batch.column("text"))]
            z = np.clip(np.concatenate([np.zeros(0), *got]) + bias, -30, 30)
            yield pa.record_batch([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-z)))], ["doc_id", "score"])

    return bounded_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    rows = sample(docs, labels, "toxic", most, TRAIN_BYTES)
    y = rows["_y"].to_numpy().copy()
    # The texts go with the frame: training lets them go once their words are known.
    return train(rows.pop("text").tolist(), y)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
