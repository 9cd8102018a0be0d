"""Periodic runs of words, found by string synchronising sets.

A run is a maximal stretch of words with smallest period q (words q apart are identical) and at least
max(LEAST, POWER * q) long. For a scale t, a position is in the synchronising set if the least hash of the t-word
windows that start within t of it is that of the first or the last of them: whether it is in the set depends on the
2t words behind it alone. In a run of period t <= p < 2t some member lies in any t positions, its copy p further on is
a member too, and no position between the two has the same 2t words. So members with equal contexts, next to each
other in the order of (context, position), propose p = their distance, and every proposal is extended word by word. Scales are
powers of two from SMALL; shorter periods are found by comparing every word with the one p behind it. Windows of
period t / 4 or less lie inside runs that earlier steps found; they take no part in a scale's set, so that highly
periodic regions do not fill it.

Windows are told apart by 64-bit hashes of their words, words by their exact bytes; what equal hashes propose is
verified, and a run could only be missed if two different windows of a document had one hash (n**2 / 2**65 for n words).

Documents of a batch lie in one array with a mark of its own behind each, so that no window that crosses a mark
equals another; a scale goes on with those documents alone that are long enough for it. There is no shuffle: a task
holds at most CHUNK words at a time, or one document if it is longer; work per word grows with the logarithm of its length.

Defined results: a null text has no words; a text without runs has an empty list and keeps all its words; very long
texts are read whole; equal rows give equal results; an empty table gives an empty result; other columns stay, whatever
their names (the two new names get underscores behind them where the table has them).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from larder.llm.columns import free_name, named, packed

LEAST = 6
POWER = 4
SMALL = 8  # the first scale; shorter periods are compared directly
CHUNK = 1 << 18  # words held at once
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs; the numbers are odd constants of multiplicative hashing."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
    return x


def _shifted(a: np.ndarray, by: int, fill) -> np.ndarray:
    out = np.full_like(a, fill)
    if by < len(a):
        out[:-by] = a[by:]
    return out


def _window_least(a: np.ndarray, width: int) -> np.ndarray:
    """The least of a[i : i + width] for every i, by windows of powers of two."""
    out, have = a, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out, _shifted(out, step, TOP))
        have += step
    return out


def _stretches(ids: np.ndarray, p: int, least: int) -> np.ndarray:
    """(start, end, p) of the maximal stretches in which words p apart agree, if `least` words long or longer."""
    if len(ids) <= p:
        return np.zeros((0, 3), np.int64)
    same = np.zeros(len(ids) - p + 2, np.int8)
    same[1:-1] = ids[:-p] == ids[p:]
    edge = np.flatnonzero(same[1:] != same[:-1])
    start, end = edge[::2], edge[1::2] + p
    keep = end - start >= least
    return np.column_stack([start[keep], end[keep], np.full(keep.sum(), p)])


def _reach(ids: np.ndarray, a: int, b: int, step: int) -> int:
    """How many words from a and b on agree, walking by step (1 or -1)."""
    total, size = 0, 64
    while True:
        room = min(size, (len(ids) - max(a, b)) if step > 0 else min(a, b) + 1)
        if room <= 0:
            return total
        x, y = (ids[a : a + room], ids[b : b + room]) if step > 0 else (ids[a - room + 1 : a + 1][::-1], ids[b - room + 1 : b + 1][::-1])
        differ = np.flatnonzero(x != y)
        if len(differ):
            return total + int(differ[0])
        total, a, b, size = total + room, a + step * room, b + step * room, size * 2


def _extended(ids: np.ndarray, place: np.ndarray, period: np.ndarray, reach: int) -> list:
    """The maximal stretches of each proposal (place, period), whose first reach + period words are known to be periodic."""
    order = np.lexsort((place, period))
    place, period = place[order], period[order]
    # proposals of one period whose known parts overlap by a period lie in one stretch
    first = np.ones(len(place), bool)
    first[1:] = (period[1:] != period[:-1]) | (place[1:] - place[:-1] > reach)
    out, last = [], (0, 0, 0)
    for s, p in zip(place[first].tolist(), period[first].tolist()):
        if p == last[2] and s + p <= last[1]:
            continue
        last = (s - _reach(ids, s - 1, s + p - 1, -1), s + p + _reach(ids, s, s + p, 1), p)
        out.append(last)
    return out


def _covered(found: np.ndarray, size: int, scale: int) -> np.ndarray:
    """Whether the window of `scale` words at each position lies in a stretch of a quarter of its length or less."""
    inner = found[(found[:, 2] * POWER <= scale) & (found[:, 1] - found[:, 0] >= scale)]
    depth = np.zeros(size + 1, np.int32)
    np.add.at(depth, inner[:, 0], 1)
    np.add.at(depth, inner[:, 1] - scale + 1, -1)
    return np.cumsum(depth[:-1]) > 0


def find_runs(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(start, end, period) of all runs, by start and period. ids: word numbers of documents one behind the other, each
    with a number of its own behind it; sizes: their words, without that."""
    found = [_stretches(ids, p, max(LEAST, POWER * p)) for p in range(1, SMALL)]
    found = _smallest(np.concatenate(found))
    place = np.arange(len(ids))  # of what is still looked at, in the whole array
    with np.errstate(over="ignore"):
        h = _mixed(ids.astype(np.uint64), ids.astype(np.uint64) >> np.uint64(7))
    t, width = SMALL, 1
    while True:
        long = sizes >= POWER * t
        if not long.any():
            return found
        if not long.all():
            keep = np.repeat(long, sizes + 1)
            h, place, sizes = h[keep], place[keep], sizes[long]
        while width < t:
            h, width = _mixed(h, _shifted(h, width, TOP)), width * 2
        context = _mixed(h, _shifted(h, t, TOP))
        own = np.where(_covered(found, len(ids), t)[place], TOP, h) if len(found) else h
        least = _window_least(own, t + 1)
        members = np.flatnonzero(((own == least) | (_shifted(own, t, TOP) == least)) & (least != TOP))
        key = context[members]
        order = np.argsort(key, kind="stable")
        a, b = members[order[:-1]], members[order[1:]]
        near = (key[order[:-1]] == key[order[1:]]) & (b - a >= t) & (b - a < 2 * t)
        if near.any():
            more = [s for s in _extended(ids, place[a[near]], (b - a)[near], 2 * t) if s[1] - s[0] >= max(LEAST, POWER * s[2])]
            if more:
                found = _smallest(np.concatenate([found, np.array(more, np.int64)]))
        h, width, t = context, 2 * t, 2 * t


def _smallest(found: np.ndarray) -> np.ndarray:
    """Each stretch once, with its smallest period, by start and period."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    found = found[new]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _of_texts(texts: list) -> tuple[list, list]:
    """Runs (lists of start, length, period) and collapsed texts of a few texts, given as bytes."""
    numbers, all_words, sizes, parts = _Numbers(), [], [], []
    for k, text in enumerate(texts):
        words = text.split()
        all_words.append(words)
        sizes.append(len(words))
        parts += [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)), np.array([-1 - k], np.int64)]
    sizes = np.array(sizes, np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    found = find_runs(np.concatenate(parts), sizes)
    doc = np.searchsorted(starts, found[:, 0], "right") - 1
    at = np.searchsorted(doc, np.arange(len(texts) + 1))
    runs, collapsed = [], []
    for k, words in enumerate(all_words):
        own = found[at[k] : at[k + 1]] - (starts[k], starts[k], 0)
        runs.append([{"start": s, "length": e - s, "period": p} for s, e, p in own.tolist()])
        if len(own):
            depth = np.zeros(len(words) + 1, np.int64)
            np.add.at(depth, own[:, 0] + own[:, 2], 1)
            np.add.at(depth, own[:, 1], -1)
            words = [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]
        collapsed.append(b" ".join(words).decode())
    return runs, collapsed


def periodic_runs(docs: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """docs with `runs`, an array of (start, length, period) by start and period, and `collapsed`, the words that no
    run holds behind its first period, joined by single spaces."""
    runs = free_name(runs, docs.columns)
    collapsed = free_name(collapsed, [*docs.columns, runs])
    own = packed(docs, named(text).alias("text"))
    none = own.select("own", F.array().cast(RUNS).alias("runs"), F.lit("").alias("collapsed"))
    runs_type = to_arrow_schema(none.schema).field("runs").type

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            k = 0
            while k < batch.num_rows:
                texts, held, first = [], 0, k
                while k < batch.num_rows and (held < CHUNK or not texts):
                    texts.append((column[k].as_py() or "").encode())
                    held += len(texts[-1]) // 5 + 1
                    k += 1
                found, kept = _of_texts(texts)
                part = batch.column(0).slice(first, k - first)
                yield pa.RecordBatch.from_arrays([part, pa.array(found, runs_type), pa.array(kept, pa.string())], ["own", "runs", "collapsed"])

    return own.mapInArrow(run, none.schema).select("own.*", F.col("runs").alias(runs), F.col("collapsed").alias(collapsed))
