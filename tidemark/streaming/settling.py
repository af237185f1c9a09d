"""Verdicts and windows day by day: a keyed streaming state over the facts of each day.

Facts are small and come from Spark joins of snapshots (see `daily`): a day's number of counters and, for the days that it may be
measured from, the share of counters that fell, the frozen share, the shortfall and the gains by tag. What follows from them goes
day by day: one state a series holds the facts of its last KEEP days and what had been decided before these. A batch adds its facts
and goes on from there, so that it does not matter in how many batches days come, nor whether one comes again.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Iterator
from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.verdicts import BACK, MOST_HELD, PARTIAL, RECOVERED
from tidemark.operators.windows import AROUND, DIP, EARLY, HIGH, LEAST_AROUND, MERGE_DAYS, PAIR_HIGH, PAIR_LOW, STALL

#: Days whose facts are kept, so that they may come again; days of the hub beyond these that medians and windows look at; days that
#: a frozen share waits for its window.
KEEP, CONTEXT, FROZEN_DAYS = 45, 75, 30
OUT = "series string, kind string, day date, at date, verdict string, base date, pipeline_tag string, dl long"


def _at(values: np.ndarray, shift: int) -> np.ndarray:
    """values[k + shift] at k; nan outside."""
    out = np.full(len(values), np.nan)
    k = np.arange(len(values)) + shift
    inside = (k >= 0) & (k < len(values))
    out[inside] = values[k[inside]]
    return out


def windows_of(tot: pd.Series, frozen: dict, least_frozen: float, snaps: list) -> list[tuple]:
    """`windows.find` for one series in memory: (first, last) of each window."""
    days, n = list(tot.index), len(tot)
    if not n:
        return []
    median = tot.rolling(2 * AROUND + 1, center=True, min_periods=LEAST_AROUND).median().to_numpy()
    r = np.divide(tot.to_numpy(), median, out=np.ones(n), where=np.nan_to_num(median) > 0)
    stalled = (r < STALL) | np.array([(frozen.get(d) or 0) >= least_frozen for d in days])
    with np.errstate(invalid="ignore"):
        reach = np.select([(_at(r, 3) > HIGH) & (_at(r, 4) > HIGH), _at(r, 3) > HIGH, _at(r, 2) > HIGH], [4, 3, 2], 1)
        early = np.select([(_at(r, -1) > EARLY) & (_at(r, -2) > EARLY), _at(r, -1) > EARLY], [2, 1], 0)
    edge = np.diff(np.r_[0, stalled.astype(int), 0])
    found, until = [], -1
    for first, last in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1):
        begin = max(first, until + 1)
        if begin <= last:
            until = last + reach[last]
            found.append((begin - early[begin], until))
    # Measurements: the days up to a snapshot; those behind the last one go with it.
    taken, d64 = np.array(sorted(snaps), "datetime64[D]"), np.array(days, "datetime64[D]")
    block = np.minimum(np.searchsorted(taken, d64), max(len(taken) - 1, 0)) if len(taken) else np.arange(n)
    lo = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    hi = np.r_[lo[1:], n] - 1
    w = (hi - lo + 1).astype(float)
    mean = np.add.reduceat(r, lo) / w
    half = (mean >= STALL) & (mean < DIP) & (np.maximum(lo, 1) <= np.minimum(hi, n - 3))

    def made_up(side: int) -> np.ndarray:
        with np.errstate(invalid="ignore"):
            both = 2 * (mean * w + _at(mean, side) * _at(w, side)) / (w + _at(w, side))
            return half & (_at(mean, side) > HIGH) & (both >= PAIR_LOW) & (both <= PAIR_HIGH)

    before = np.flatnonzero(made_up(-1))
    behind = np.flatnonzero(made_up(1) & ~made_up(-1) & (hi + 1 < n - 1))
    ends = np.array([x for x in found if x[1] < n - 1] + list(zip(lo[before - 1], hi[before])) + list(zip(lo[behind], hi[behind + 1])), int).reshape(-1, 2)
    first, last = d64[ends[:, 0]], d64[ends[:, 1]]
    if len(taken):
        # The snapshot that closes a window's last day, and the day behind the one before its first.
        closes, opened = np.searchsorted(taken, last), np.searchsorted(taken, first) - 1
        last = np.where(closes < len(taken), np.maximum(last, taken[np.minimum(closes, len(taken) - 1)]), last)
        first = np.where(opened >= 0, np.minimum(first, taken[np.maximum(opened, 0)] + 1), first)
    order = np.lexsort((last, first))
    order = order[last[order] < d64[-1]]
    if not len(order):
        return []
    first, upto = first[order], np.maximum.accumulate(last[order])
    apart = np.flatnonzero(np.r_[True, first[1:] > upto[:-1] + MERGE_DAYS])
    return list(zip(first[apart].tolist(), upto[np.r_[apart[1:], len(order)] - 1].tolist()))


def start() -> dict:
    """What is decided before any day."""
    return {"whole": [], "since": None, "first": 0.0, "hub": {}, "frozen": {}, "pending": [], "skip": [], "log": []}


def _measure(s: dict, fact: dict, base: str, day: str) -> list:
    """Writes the gains since `base`, a day's average on each of the days between; the days written."""
    gains = fact["pairs"].get(base, {}).get("gains", {})
    first, last = date.fromisoformat(base), date.fromisoformat(day)
    gap = (last - first).days
    between = [(first + timedelta(k + 1)).isoformat() for k in range(gap)]
    for d in between:
        s["hub"][d] = {tag: int(np.rint(v / gap)) for tag, v in sorted(gains.items())}
    return between


def _judge(s: dict, day: str, fact: dict, facts: dict) -> None:
    """Appends the day's verdict, and measures what it settles."""
    verdict = lambda d, v, base=None: s["log"].append({"kind": "verdict", "day": d, "at": day, "verdict": v, "base": base})
    if s["whole"] and fact["n"] < PARTIAL * s["whole"][-1][1]:
        s["skip"].append(day)
        return verdict(day, "partial")
    before, s["whole"] = [d for d, _ in s["whole"]], [*s["whole"], [day, fact["n"]]][-(CONTEXT + MOST_HELD) :]
    if not before:
        return verdict(day, "first")
    pair = fact["pairs"].get(before[-1], {})
    if s["since"] is None:
        near = (date.fromisoformat(day) - date.fromisoformat(before[-1])).days == 1
        if near and pair.get("frozen") is not None:
            s["frozen"][day] = pair["frozen"]
        if (pair.get("back") or 0.0) <= BACK:
            verdict(day, "use", before[-1])
            _measure(s, fact, before[-1], day)
        else:
            s["since"], s["first"] = before[-1], pair.get("missing") or 0.0
            s["skip"].append(day)
            verdict(day, "hold")
        return None
    held = before[before.index(s["since"]) + 1 :]
    if (fact["pairs"].get(s["since"], {}).get("missing") or 0.0) <= RECOVERED * s["first"]:
        verdict(day, "use", s["since"])
        _measure(s, fact, s["since"], day)
        s["pending"] = sorted({*s["pending"], *held})
    elif len(held) >= MOST_HELD:
        s["skip"] = [d for d in s["skip"] if d not in held]
        for base, d in zip([s["since"], *held], [*held, day]):
            verdict(d, "release", base)
            _measure(s, fact if d == day else facts[d], base, d)
    else:
        s["skip"].append(day)
        return verdict(day, "hold")
    s["since"] = None


def _open(s: dict, day: str, least_frozen: float) -> None:
    """Opens windows among days that none has settled, and spreads what they hold over their days."""
    tot = pd.Series({date.fromisoformat(d): float(sum(s["hub"][d].values())) for d in sorted(s["hub"])}, dtype=float)
    skip, pending = set(s["skip"]), set(s["pending"])
    frozen = {date.fromisoformat(d): v for d, v in s["frozen"].items() if d not in skip} | {date.fromisoformat(d): 1.0 for d in pending}
    # The oldest days of a history that is cut have no neighbours any more; they were judged when they had.
    cut = date.fromisoformat(s["cut"]) if s.get("cut") else date.min
    for a, b in windows_of(tot, frozen, least_frozen, [date.fromisoformat(d) for d, _ in s["whole"]]):
        inside = [d.isoformat() for d in tot.index if a <= d <= b]
        if a < cut or set(inside[:-1]) <= skip - pending:
            continue
        tags = sorted({t for d in inside for t in s["hub"][d]})
        even = {t: int(np.rint(sum(s["hub"][d].get(t, 0) for d in inside) / len(inside))) for t in tags}
        for d in inside:
            s["hub"][d] = dict(even)
        s["skip"] = sorted({*s["skip"], *inside[:-1]})
        s["pending"] = sorted(pending := pending - set(inside))
        s["log"].append({"kind": "window", "day": a.isoformat(), "at": day, "base": b.isoformat()})
    s["frozen"] = {d: v for d, v in s["frozen"].items() if d >= (date.fromisoformat(day) - timedelta(FROZEN_DAYS)).isoformat()}


def fold(s: dict, facts: dict, days: list, least_frozen: float, context: int = CONTEXT) -> dict:
    """The state after some days, in order; `facts` of days before them may be asked for where held days are released."""
    for day in days:
        _judge(s, day, facts[day], facts)
        _open(s, day, least_frozen)
        oldest = (date.fromisoformat(day) - timedelta(context)).isoformat()
        gone = sorted(d for d in s["hub"] if d < oldest)
        if gone:
            s["log"] += [{"kind": "hub", "day": d, "at": day, "tags": s["hub"].pop(d)} for d in gone]
            s["cut"] = (date.fromisoformat(oldest) + timedelta(2 * AROUND)).isoformat()
        s["log"] += [{"kind": "skip", "day": d, "at": day} for d in s["skip"] if d < oldest]
        s["skip"] = [d for d in s["skip"] if d >= oldest]
    return s


def advance(state: dict, new: dict, least_frozen: float, keep: int = KEEP, context: int = CONTEXT) -> tuple[dict, dict, list]:
    """(state, what is decided now, days that came too late) after new facts {day: fact}.

    `state`: facts of the last days and, as of the day before them, what was decided. Facts of a day older than these cannot be
    taken in any more; such a history is to be rebuilt as a batch.
    """
    late = sorted(d for d in new if d <= state["floor"])
    facts = state["facts"] | {d: f for d, f in new.items() if d > state["floor"]}
    days = sorted(facts)
    open_ = [d for d in days if d > state["floor"]]
    base, done = state["base"], []
    if open_:
        newest = date.fromisoformat(open_[-1])
        old = [d for d in open_ if d < (newest - timedelta(keep)).isoformat()]
        base = fold(copy.deepcopy(base), facts, old, least_frozen, context)
        done, base["log"] = base["log"], []
        floor = old[-1] if old else state["floor"]
        # Facts of days before the floor stay as long as a release may ask for them.
        facts = {d: f for d, f in facts.items() if d > floor or d in {x for x, _ in base["whole"][-MOST_HELD - 1 :]}}
        state = {"floor": floor, "base": base, "facts": facts}
    now = fold(copy.deepcopy(base), facts, [d for d in sorted(facts) if d > state["floor"]], least_frozen, context)
    # What has just left the open days is told for the last time.
    now["log"] = done + now["log"]
    return state, now, late


def decided(series: str, now: dict, late: list, floor: str) -> pd.DataFrame:
    """What the state says of a series, as rows of OUT.

    verdict and window (day, base: its first and last): told at the day `at`; what was told after the day of the `floor` row is
    told again, and counts in place of what had been told. hub and skip: the days as they stand. late: days that came too late.
    """
    rows = [(series, x["kind"], x["day"], x["at"], x.get("verdict"), x.get("base"), None, None) for x in now["log"] if x["kind"] != "hub"]
    hub = [(x["day"], x["tags"]) for x in now["log"] if x["kind"] == "hub"] + list(now["hub"].items())
    rows += [(series, "hub", d, None, None, None, tag, v) for d, tags in hub for tag, v in tags.items()]
    rows += [(series, "skip", d, None, None, None, None, None) for d in now["skip"]] + [(series, "late", d, None, None, None, None, None) for d in late]
    rows.append((series, "floor", floor or None, None, None, None, None, None))
    df = pd.DataFrame(rows, columns=["series", "kind", "day", "at", "verdict", "base", "pipeline_tag", "dl"])
    for c in ("day", "at", "base"):
        df[c] = [date.fromisoformat(x) if isinstance(x, str) else None for x in df[c]]
    df["dl"] = df["dl"].astype("Int64")
    return df


class Settler(StatefulProcessor):
    """One state a series; its rows are (series, day, body), the body a day's facts as JSON. Of two rows of a day the later delivery (greater `at`) counts."""

    def __init__(self, least_frozen: float):
        self.least_frozen = least_frozen

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("settled", "body string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues=None) -> Iterator[pd.DataFrame]:
        state = json.loads(self.kept.get()[0]) if self.kept.exists() else {"floor": "", "base": start(), "facts": {}}
        got = pd.concat(list(rows)).sort_values("at", kind="stable")
        told = state["floor"]
        state, now, late = advance(state, {str(d)[:10]: json.loads(b) for d, b in zip(got["day"], got["body"])}, self.least_frozen)
        self.kept.update((json.dumps(state),))
        yield decided(key[0], now, late, told)

    def close(self) -> None:
        pass


def settled(facts: DataFrame, least_frozen: float) -> DataFrame:
    """Rows of OUT from a stream of facts (series, day, at, body). The session needs RocksDB as its state store."""
    return facts.groupBy("series").transformWithStateInPandas(statefulProcessor=Settler(least_frozen), outputStructType=OUT, outputMode="append", timeMode="none")
