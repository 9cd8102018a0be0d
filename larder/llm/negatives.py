"""Hard-negative mining by a secondary-sort shuffle.

Vectors become whole numbers, floor(256 x). Anchors and rows are dealt to a grid of blocks (a cell is one block of
anchors by one block of rows, both of bounded size) whose inner products are one matrix product each, twice:

1. each cell gives the POSITIVES best rows of every anchor's label; the best of these over all cells are its positives;
2. each cell, which now knows the windows (from LOW % of a positive's score to the score itself), gives for every
   window its NEGATIVES best rows of other labels. What is left of the pairs (at most a few rows per anchor and
   cell) is shuffled by anchor and sorted within partitions by (anchor, score descending, positives first, id). One
   pass over each partition opens a window at a positive, hands every negative to the windows that are open, and closes a
   window that is full or whose lower end is passed. It holds the open windows of one anchor and nothing else.

The secondary sort is DataFrame repartition and sortWithinPartitions, the same shuffle as
repartitionAndSortWithinPartitions without Python objects. No cell holds more than ANCHOR_BLOCK x ROW_BLOCK pairs, a
frequent label or anchor has no cell of its own, and all pairs are looked at: nothing is sampled.

Defined results: rows without an id, a label or a vector, and those with a null or non-finite component take no part.
Of rows with one id, the least by label, then vector, counts. Vectors of different lengths multiply as if the
shorter one ended in zeros, and an empty one has score 0 with every row. Equal scores go by the smaller id. Scores are exact:
whole numbers beyond 2**53 are multiplied as Python integers, and a score beyond 64 bits is an error. An anchor without
positives or a window without negatives gives no row; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.columns import named
from larder.session import staged

ANCHOR_BLOCK = 2_048
ROW_BLOCK = 8_192
POSITIVES = 5
NEGATIVES = 5
LOW = 80
SCALE = 256

_FOUND = "anchor_id bigint, score bigint, id bigint"
_MINED = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def usable(vectors: DataFrame, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", new_label: Column | None = None) -> DataFrame:
    """(id, label, v): the rows that take part, one of each id."""
    own = vectors.select(named(vec_id).cast("bigint").alias("id"), (named(label) if new_label is None else new_label).cast("bigint").alias("label"), named(vector).cast("array<double>").alias("v"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return own.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite).groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


def _dealt(rows: DataFrame, block: int) -> tuple[DataFrame, int]:
    """rows with the number of their block, and how many blocks there are: by a hash of the id, so that they are even."""
    blocks = max(1, -(-rows.count() // block))
    return rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")), blocks


def _matrix(v: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE x) of list rows, padded with zeros."""
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    offsets, flat = v.offsets.to_numpy(), np.floor(SCALE * v.values.to_numpy())
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), width))
    flat = flat[offsets[0] : offsets[-1]]
    if len(flat) == out.size:
        return flat.reshape(out.shape)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = np.array([[int(x) for x in r] for r in a], object).reshape(a.shape), np.array([[int(x) for x in r] for r in b], object).reshape(b.shape)
    return (whole[0] @ whole[1].T) if a.shape[1] else np.zeros((len(a), len(b)), np.int64)


def _best(score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the n best by score, ties by the smaller id."""
    if len(score) > 4 * n and score.dtype != object:
        at = np.flatnonzero(score >= np.partition(score, len(score) - n)[len(score) - n])
        return at[np.lexsort((ids[at], -score[at]))[:n]]
    return np.array(sorted(range(len(score)), key=lambda i: (-score[i], ids[i]))[:n], np.int64)


def _sides(anchors: pa.Table, rows: pa.Table) -> tuple:
    width = max([len(v) for t in (anchors, rows) for v in t.column("v")] or [0]) if anchors.num_rows and rows.num_rows else 0
    return _matrix(anchors.column("v"), width), _matrix(rows.column("v"), width)


def _found(anchor: list, score: list, ids: list) -> pa.Table:
    return pa.table({"anchor_id": pa.array(anchor, pa.int64()), "score": pa.array(score, pa.int64()), "id": pa.array(ids, pa.int64())})


def _cell_positives(key: tuple, anchors: pa.Table, rows: pa.Table) -> pa.Table:
    out = [], [], []
    if anchors.num_rows and rows.num_rows:
        a, b = _sides(anchors, rows)
        who, ids = anchors.column("id").to_numpy(), rows.column("id").to_numpy()
        mine, theirs = anchors.column("label").to_numpy(), rows.column("label").to_numpy()
        for label in np.unique(mine):
            i, j = np.flatnonzero(mine == label), np.flatnonzero(theirs == label)
            if not len(j):
                continue
            for n, s in zip(i.tolist(), _scores(a[i], b[j])):
                other = ids[j] != who[n]
                at = _best(s[other], ids[j][other], POSITIVES)
                out[0].extend([who[n]] * len(at))
                out[1].extend(s[other][at].tolist())
                out[2].extend(ids[j][other][at].tolist())
    return _found(*out)


def _cell_negatives(key: tuple, anchors: pa.Table, rows: pa.Table) -> pa.Table:
    out = [], [], []
    if anchors.num_rows and rows.num_rows:
        a, b = _sides(anchors, rows)
        who, ids = anchors.column("id").to_numpy(), rows.column("id").to_numpy()
        mine, theirs = anchors.column("label").to_numpy(), rows.column("label").to_numpy()
        tops = anchors.column("tops").to_pylist()
        for k in range(0, len(a), 256):
            scores = _scores(a[k : k + 256], b)
            for n, s in enumerate(scores, k):
                if max(tops[n]) < 0:
                    continue  # no score lies between 80 % of a negative number and itself
                low = -(-LOW * min(t for t in tops[n] if t >= 0) // 100)
                at = np.flatnonzero((theirs != mine[n]) & (s >= low) & (s <= max(tops[n])))
                taken = set()
                for top in set(tops[n]):
                    inside = at[(100 * s[at] >= LOW * top) & (s[at] <= top)]
                    taken.update(inside[_best(s[inside], ids[inside], NEGATIVES)].tolist())
                out[0].extend([who[n]] * len(taken))
                out[1].extend(int(s[j]) for j in taken)
                out[2].extend(int(ids[j]) for j in taken)
    return _found(*out)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs sorted by (anchor, score descending, positives first, id) to mined rows; open holds [positive, score, given]."""
    anchor, open_ = None, []
    for batch in batches:
        rows = []
        for a, score, positive, i in zip(*(batch.column(c).to_pylist() for c in ("anchor_id", "score", "positive", "id"))):
            if a != anchor:
                anchor, open_ = a, []
            if positive:
                open_.append([i, score, 0])
                continue
            open_ = [w for w in open_ if w[2] < NEGATIVES and 100 * score >= LOW * w[1]]
            for w in open_:
                w[2] += 1
                rows.append((a, w[0], w[2], i, w[1], score))
        columns = list(zip(*rows)) or [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def mine_hard_negatives(vectors: DataFrame, anchors: Column | None = None, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", new_label: Column | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). `anchors` says of `id` which rows are
    anchors (all where it is None); `new_label` takes the place of the label column."""
    rows = staged(usable(vectors, vec_id, label, vector, new_label), "negatives-rows")
    asked, a_blocks = _dealt(rows if anchors is None else rows.where(anchors), ANCHOR_BLOCK)
    dealt, r_blocks = _dealt(rows, ROW_BLOCK)
    cell = lambda df, n, anchor: df.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("*", (F.col("block") * r_blocks + F.col("other") if anchor else F.col("other") * r_blocks + F.col("block")).cast("bigint").alias("cell")).drop("block", "other")
    here = cell(dealt, a_blocks, False)
    found = cell(asked, r_blocks, True).groupBy("cell").cogroup(here.groupBy("cell")).applyInArrow(_cell_positives, _FOUND)
    # the POSITIVES best of the few that each cell found: bounded lists, merged before and after the shuffle
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id")))
    chosen = staged(found.groupBy("anchor_id").agg(F.slice(order, 1, POSITIVES).alias("p")), "negatives-positives")
    known = asked.join(chosen.withColumnRenamed("anchor_id", "id"), "id").select(*(F.col(c).alias(c) for c in ("id", "label", "v", "block")), F.transform("p", lambda p: -p["s"]).alias("tops"))
    near = cell(known, r_blocks, True).groupBy("cell").cogroup(here.groupBy("cell")).applyInArrow(_cell_negatives, _FOUND)
    positive = chosen.select("anchor_id", F.explode("p").alias("p")).select("anchor_id", (-F.col("p.s")).alias("score"), F.col("p.id").alias("id"), F.lit(True).alias("positive"))
    pairs = positive.unionByName(near.withColumn("positive", F.lit(False)))
    return pairs.repartition("anchor_id").sortWithinPartitions("anchor_id", F.desc("score"), F.desc("positive"), "id").mapInArrow(_windows, _MINED)
