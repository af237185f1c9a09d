"""Best-fit packing of documents into sequences, by bin completion.

Each task encodes documents and cuts only those over the capacity, into full pieces; what is left over is the first piece.
Full pieces are sequences by themselves. The others are dealt at random over tasks and packed there in batches of bounded
size. The incumbent of a batch is best fit decreasing, and a lower bound on the number of sequences tells when it is the best
there is. Otherwise branch and bound looks for one sequence less, in windows of the incumbent: those of its sequences that
waste most, and others beside them. In a window the longest piece left opens a sequence, and the undominated fillings of the
rest of it are tried, fullest first. A filling is dominated when a longer piece that is left could take the place of one of its
pieces, or one piece of at least their length that of several. A branch ends when its waste so far leaves no better solution
of the window. The effort is bounded: EFFORT visits for a batch, WINDOW_EFFORT for a window; then the incumbent stands, which
`complete` returns beside the bound.

Sequences that a batch leaves with room go on as candidates of the next batch, so a task ends with about one sequence that is
not full; there are as many tasks as leave each several batches.

Defined results: a null text is empty and has only its end token. Repeated rows of one id are packed each. Rows without doc_id
are packed like others. Ties are broken by doc_id and piece. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import scan
from tidemark.llm.encoding import encoder as encoder_of
from tidemark.llm.shared import bounded_batches, cut, table
from tidemark.llm.token_counts import tokenizer_path

CAPACITY, END = 1024, 2
#: Pieces packed together, and pieces dealt to one task.
BATCH, TASK_ROWS = 4096, 16384
#: Partial fillings visited for a batch and for one window of it, and the sequences that a window takes beside wasteful ones.
EFFORT, WINDOW_EFFORT, BESIDE = 200_000, 20_000, 80


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of docs(doc_id, text)."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        encoder = encoder_of(path)
        for batch in batches:
            ids, out = batch.column("doc_id").to_pylist(), {k: [] for k in names}
            for lo, data, off in scan.texts(batch.column("text")):
                tokens, at = encoder.encode(data, off)
                for k in range(len(at) - 1):
                    own = np.append(tokens[at[k] : at[k + 1]], np.uint32(end)).astype("<u4")
                    first = len(own) % capacity or min(len(own), capacity)
                    cuts = [0, *range(first, len(own) + 1, capacity)]
                    for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        for name, v in zip(names, (ids[lo + k], piece, a, b - a, zlib.crc32(own[a:b].tobytes()))):
                            out[name].append(v)
            yield pa.record_batch([pa.array(out[k], pa.int32() if k == "piece" else pa.int64()) for k in names], names)

    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Stock:
    """How many pieces of each length are left; `there` has a bit for each length that is left."""

    def __init__(self, lengths, capacity: int):
        self.count, self.there, self.total = [0] * (capacity + 1), 0, 0
        for x in lengths:
            self.put(x)

    def take(self, x: int) -> None:
        self.count[x] -= 1
        self.total -= x
        if not self.count[x]:
            self.there ^= 1 << x

    def put(self, x: int) -> None:
        self.count[x] += 1
        self.total += x
        self.there |= 1 << x

    def largest(self, most: int) -> int:
        """The longest left of at most that length, or 0."""
        return (self.there & ((2 << most) - 1)).bit_length() - 1 if most > 0 and self.there & ((2 << most) - 1) else 0

    def lengths(self) -> list[int]:
        return [x for x, n in enumerate(self.count) for _ in range(n)]


class Effort:
    """Visits that are left."""

    def __init__(self, most: int):
        self.left = most


def _sums(stock: Stock, total: int, top: int, pieces: int, effort: Effort):
    """Descending tuples of exactly `pieces` lengths that are left, none over `top`, of that total."""
    if pieces == 1:
        if total <= top and stock.count[total] > 0:
            yield (total,)
        return
    x = stock.largest(min(top, total - pieces + 1))
    while x * pieces >= total and x:
        effort.left -= 1
        if effort.left <= 0:
            return
        stock.count[x] -= 1
        if stock.count[x] >= 0:
            for rest in _sums(stock, total - x, x, pieces - 1, effort):
                stock.count[x] += 1
                yield (x, *rest)
                stock.count[x] -= 1
        stock.count[x] += 1
        x = stock.largest(x - 1)


def dominated(stock: Stock, filling: tuple[int, ...], room: int) -> bool:
    """Whether one piece left over could replace one or more pieces of the filling and be as long or longer."""
    slack = room - sum(filling)
    if stock.largest(slack) and any(stock.count[y] > filling.count(y) for y in range(1, slack + 1)):
        return True
    # Of fillings with very many pieces, groups of up to three are tested.
    sizes = range(1, min(len(filling), 3 if len(filling) > 8 else 8) + 1)
    for part in {c for k in sizes for c in combinations(filling, k)}:
        least, most = sum(part) + (len(part) == 1), min(room, sum(part) + slack)
        y = stock.largest(most)
        while y >= least and y:
            if stock.count[y] > filling.count(y):
                return True
            y = stock.largest(y - 1)
    return False


def fillings(stock: Stock, room: int, lose: int, effort: Effort):
    """Undominated fillings of `room` that leave at most `lose` of it, fullest first, then of fewest pieces."""
    least = (stock.there & -stock.there).bit_length() - 1
    for total in range(min(room, stock.total), max(0, room - lose) - 1, -1):
        if total == 0:
            if not stock.largest(room):
                yield ()
            return
        for pieces in range(1, total // least + 1 if least > 0 else 1):
            for got in _sums(stock, total, total, pieces, effort):
                if not dominated(stock, got, room):
                    yield got
            if effort.left <= 0:
                return


def least_bins(lengths: list[int], capacity: int) -> int:
    """A lower bound on the number of bins: pieces over half the capacity need one each, and only some room beside them can serve the rest."""
    count = np.bincount(lengths, minlength=capacity + 1)
    number, total = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    best, half = -(-int(total[-1]) // capacity), capacity // 2
    for k in range(1, half + 1):
        # Pieces over capacity - k stand alone; those up to half of at least k share with the rest over half.
        alone, wide = int(number[capacity] - number[capacity - k]), int(number[capacity - k] - number[half])
        rest = int(total[half] - total[k - 1]) - (wide * capacity - int(total[capacity - k] - total[half]))
        best = max(best, alone + wide + max(0, -(-rest // capacity)))
    return best


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing over lengths: each goes where the least room stays."""
    bins, rooms = [], []  # rooms: sorted (room, bin)
    for x in sorted(lengths, reverse=True):
        k = bisect_right(rooms, (x, -1))
        if k < len(rooms):
            room, b = rooms.pop(k)
        else:
            bins.append([])
            room, b = capacity, len(bins) - 1
        bins[b].append(x)
        if room > x:
            rooms.insert(bisect_right(rooms, (room - x, b)), (room - x, b))
    return bins


def search(lengths: list[int], capacity: int, most: int, effort: Effort) -> list[list[int]] | None:
    """At most `most` bins for the lengths, or None where the branches or the effort end without."""
    stock, waste = Stock(lengths, capacity), 0
    allowed = most * capacity - stock.total
    trail: list[list] = []  # [largest, fillings to try, the filling taken, its waste]

    def advance() -> bool:
        """The next filling of the last bin, or of the last one before it that has another."""
        nonlocal waste
        while trail:
            largest, options, got, lost = trail[-1]
            for x in got or ():
                stock.put(x)
            waste -= lost
            got = next(options, None)
            lost = capacity - largest - sum(got or ())
            if got is not None and waste + lost <= allowed:
                for x in got:
                    stock.take(x)
                trail[-1][2:] = got, lost
                waste += lost
                return True
            trail.pop()
            stock.put(largest)
        return False

    while stock.total:
        largest = stock.largest(capacity)
        stock.take(largest)
        trail.append([largest, fillings(stock, capacity - largest, min(capacity - largest, allowed - waste), effort), None, 0])
        if not advance() or effort.left <= 0:
            return None
    return [[largest, *got] for largest, _, got, _ in trail]


def complete(lengths: list[int], capacity: int = CAPACITY, effort: int = EFFORT) -> tuple[list[list[int]], int]:
    """(bins, lower bound): few bins for the lengths, each a list of lengths. As many as the bound are the fewest possible."""
    if not lengths:
        return [], 0
    bins, least, left, r, tries = best_fit(lengths, capacity), least_bins(lengths, capacity), effort, np.random.default_rng(len(lengths)), 0
    while len(bins) > least and left > 0:
        waste = np.array([capacity - sum(b) for b in bins])
        # As many wasteful bins as waste a bin's room together: the most wasteful, later others by chance of their waste.
        need = int(np.searchsorted(np.cumsum(np.sort(waste)[::-1]), capacity)) + 1
        if need > len(bins):
            break
        chosen = np.argsort(-waste, kind="stable")[:need] if not tries else r.choice(len(bins), min(2 * need, int((waste > 0).sum())), replace=False, p=waste / waste.sum())
        others = np.setdiff1d(np.arange(len(bins)), chosen)
        window = np.concatenate([chosen, r.choice(others, min(BESIDE, len(others)), replace=False)])
        tries, visits = tries + 1, Effort(min(left, WINDOW_EFFORT))
        got = search([x for k in window for x in bins[k]], capacity, len(window) - 1, visits) if waste[window].sum() >= capacity else None
        left -= max(500, min(left, WINDOW_EFFORT) - max(0, visits.left))
        if got is not None:
            bins = [bins[k] for k in np.setdiff1d(np.arange(len(bins)), window)] + got
    return bins, least


def _pack(capacity: int, batch_rows: int):
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def rows_of(pdf: pd.DataFrame, last: bool, task: int, number: int):
        """Closed sequences as rows, the pieces that wait, and the next free number."""
        lengths = pdf["length"].to_numpy()
        order = np.argsort(-lengths, kind="stable")
        by_length: dict[int, list[int]] = {}
        for k in order[::-1].tolist():
            by_length.setdefault(int(lengths[k]), []).append(k)
        bins, _ = complete(lengths.tolist(), capacity)
        full = [b for b in bins if last or sum(b) >= capacity - 2]
        if not last and not full:
            full = sorted(bins, key=sum)[len(bins) // 2 :]
        seq, offset, taken = np.full(len(pdf), -1), np.zeros(len(pdf), np.int64), np.zeros(len(pdf), bool)
        for b in full:
            at = 0
            for x in b:
                k = by_length[x].pop()
                seq[k], offset[k], taken[k] = number, at, True
                at += x
            number += 1
        done = pdf[taken].assign(sequence_id=(task << 36) + seq[taken], offset=offset[taken])
        return done, pdf[~taken], number

    def run(batches):
        from pyspark import TaskContext

        task, number, held = TaskContext.get().partitionId(), 0, None
        for pdf in batches:
            held = pdf if held is None or not len(held) else pd.concat([held, pdf], ignore_index=True)
            while len(held) >= batch_rows:
                part, rest = held.iloc[: 2 * batch_rows], held.iloc[2 * batch_rows :]
                done, wait, number = rows_of(part.reset_index(drop=True), False, task, number)
                yield done[[*names, "sequence_id", "offset"]]
                held = pd.concat([wait, rest], ignore_index=True)
        if held is not None and len(held):
            yield rows_of(held.reset_index(drop=True), True, task, number)[0][[*names, "sequence_id", "offset"]]

    return run


def pack(made: DataFrame, capacity: int = CAPACITY, batch_rows: int = BATCH) -> DataFrame:
    """made (pieces) with sequence_id and offset. Sequences of full pieces have negative numbers, unlike the others."""
    made = cut(made)
    whole = made.filter(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    # Places in the checkpoint deal evenly, whatever ids repeat.
    rest = made.filter(F.col("length") < capacity).withColumn("_k", F.xxhash64(F.monotonically_increasing_id()))
    tasks = -(-rest.count() // TASK_ROWS) or 1
    rest = rest.repartition(tasks, "_k").sortWithinPartitions("_k", "doc_id", "piece").drop("_k")
    packed = rest.mapInPandas(_pack(capacity, batch_rows), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return whole.unionByName(packed)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")))
