"""Embedding near-duplicates by collision counts of one-dimensional projections.

The projections that are counted are directions of one random rotation, so for unit vectors with
cosine c the squared differences of their projections sum to at most r2 = 2 - 2c. At most `MISSES`
of them can exceed the half window w = sqrt(r2 / (MISSES + 1)): a pair that is a link
collides in at least PROJECTIONS - MISSES windows. The count asked for is therefore
calibrated to a recall of 1 among the pairs that meet; pairs that reach it are verified by
their cosine in double precision.

Which pairs meet: a table sorts its rows by the halves (below zero or not) of `bits` further projections,
and rows in the same halves of all of them form a bucket. A link at the threshold lies in one
half of a projection in a share 1 - arccos(c) / pi, so that with `plan(rows, c)` tables at most one such link
in 1 / MISSED meets in none of them (closer pairs far fewer). `bits` grows with the largest label, so
buckets stay of a size and work grows with rows times tables, not with the square of a label. A bucket's rows
are sorted by a projection and each query block meets the run of rows in its window. A pair counts in
the first table that it meets in.

Equal vectors of a label are one node with a weight, so a crowd of copies costs no pairs. Buckets of
more than `tile` rows are cut into tiles, and a pair of tiles is one bounded task group. A
group returns, per row, how many links it has there, and the edges of a spanning forest in
place of all pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and
rows without a label, link with nothing and are their own component; vectors of other lengths
are compared among themselves; equal vectors link like others; equal vec_ids are rows of
their own, and a component's id is its least vec_id. Other columns are neither read nor required; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.graph import connected_components
from larder.session import staged

COSINE = 0.93
PROJECTIONS = 32
MISSES = 9
TILE = 4096
BLOCK = 256
SEED = 20240229
MISSED = 1e-4  # of the links at the threshold: the share that may meet in no table
LEAST_BITS, BUCKET = 8, 64  # bits of a table at least; rows of the largest label that a bucket should have


@lru_cache(maxsize=64)
def rotation(dim: int, number: int = 0) -> np.ndarray:
    """dim x dim, orthonormal, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng([SEED + dim, number]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def plan(rows: int, cosine: float) -> tuple[int, int]:
    """(bits of a table, tables) for a label of so many rows."""
    bits = int(min(max(LEAST_BITS, math.ceil(math.log2(max(rows, 1) / BUCKET))), 30))
    met = (1 - math.acos(max(min(cosine, 1.0), -1.0)) / math.pi) ** bits
    return bits, 1 if met >= 1 else math.ceil(math.log(MISSED) / math.log1p(-met))


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vector: str) -> str:
    """SQL: whether a vector has a direction."""
    v = f"cast({vector} as array<double>)"
    return f"coalesce({vector} is not null and size({vector}) > 0 and forall({v}, x -> x is not null and abs(x) < double('Infinity') and not isnan(x)) and exists({v}, x -> x <> 0), false)"


@lru_cache(maxsize=8)
def _directions(dim: int, n: int) -> np.ndarray:
    """dim x n: columns of further rotations."""
    return np.concatenate([rotation(dim, 1 + i) for i in range(-(-n // dim))], axis=1)[:, :n]


def _coded(bits: int, tables: int):
    """Rows to the number of their bucket in each table."""

    def run(batches):
        weights = 1 << np.arange(bits)
        for batch in batches:
            vectors, out = batch.column("v"), np.zeros((batch.num_rows, tables), np.int32)
            sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
            flat, ends = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate([[0], np.cumsum(sizes)])
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                x = flat[ends[at][:, None] + np.arange(dim)[None, :]]
                above = (unit_rows(x) @ _directions(int(dim), bits * tables) >= 0).reshape(len(at), tables, bits)
                out[at] = above @ weights
            codes = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, tables, dtype=np.int32)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, codes], [*batch.schema.names, "codes"])

    return run


def colliding_pairs(left: np.ndarray, right: np.ndarray | None, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of unit rows with cosine of at least `cosine`; right None: pairs i < j of left."""
    other = left if right is None else right
    dim = left.shape[1]
    m = min(PROJECTIONS, dim)
    radius2 = max(2 - 2 * cosine, 0.0)
    window = np.float32(np.sqrt(radius2 / (MISSES + 1)) + 1e-6)
    asked = m - MISSES
    turned = rotation(dim)[:, :m]
    p, q = (left @ turned).astype(np.float32), (other @ turned).astype(np.float32)
    lo, ro = np.argsort(p[:, 0], kind="stable"), np.argsort(q[:, 0], kind="stable")
    p, q = p[lo], np.ascontiguousarray(q[ro].T)
    reach, ii, jj = np.float32(np.sqrt(radius2) + 1e-6), [], []
    for k in range(0, len(p), BLOCK):
        block = p[k : k + BLOCK]
        a, b = np.searchsorted(q[0], block[0, 0] - reach, "left"), np.searchsorted(q[0], block[-1, 0] + reach, "right")
        if a == b:
            continue
        count = np.zeros((len(block), b - a), np.int8)
        for j in range(m):
            count += np.abs(block[:, j, None] - q[j, a:b]) <= window
        x, y = np.nonzero(count >= asked)
        x, y = lo[x + k], ro[y + a]
        if right is None:
            x, y = x[x < y], y[x < y]
        for s in range(0, len(x), 100_000):
            i, j = x[s : s + 100_000], y[s : s + 100_000]
            near = np.einsum("ij,ij->i", left[i], other[j]) >= cosine
            ii.append(i[near])
            jj.append(j[near])
    none = np.zeros(0, np.int64)
    return np.concatenate(ii or [none]), np.concatenate(jj or [none])


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that the links (i, j) connect it with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _bucket_links(x: np.ndarray, codes: np.ndarray, first: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the links of a bucket or of a pair of its tiles, whose first has `first` rows; pairs that met in an
    earlier table were counted there."""
    if first == len(x):
        i, j = colliding_pairs(x, None, cosine)
    else:
        i, j = colliding_pairs(x[:first], x[first:], cosine)
        j = j + first
    new = np.ones(len(i), bool)
    for s in range(0, len(i), 100_000):
        new[s : s + 100_000] = ~(codes[i[s : s + 100_000]] == codes[j[s : s + 100_000]]).any(axis=1)
    return i[new], j[new]


def _linked(cosine: float):
    """A group holds many buckets, and pairs of tiles of large ones."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        table = key[2].as_py()
        row, side, code, low, high = (group.column(c).to_numpy() for c in ("row", "side", "code", "low", "high"))
        order = np.lexsort((row, side, high, low, code))

        def matrix(name):
            return group.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(row), -1)[order]

        x, codes, weight = unit_rows(matrix("v")), matrix("codes")[:, :table], group.column("copies").to_numpy()[order]
        row, side, code, low, high = (c[order] for c in (row, side, code, low, high))
        cuts = np.flatnonzero((np.diff(code) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)) + 1
        ii, jj = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in zip([0, *cuts], [*cuts, len(row)], strict=True):
            i, j = _bucket_links(x[a:b], codes[a:b], int((side[a:b] == 0).sum()), cosine)
            ii.append(i + a)
            jj.append(j + a)
        # the rows of a bucket that has several tiles come once for each pair of them
        i, j = np.concatenate(ii), np.concatenate(jj)
        counts = np.bincount(i, weight[j], len(row)) + np.bincount(j, weight[i], len(row))
        root = forest(len(row), i, j)
        own = np.flatnonzero(counts)
        return pa.table({"row": pa.array(row[own]), "n": pa.array(counts[own].astype(np.int64)), "root": pa.array(row[root[own]])})

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    own = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    rows = staged(own.withColumn("dim", F.when(F.col("label").isNotNull() & F.expr(usable("v")), F.size("v"))), "vectors")
    known = rows.where("dim is not null")
    nodes = staged(known.groupBy("label", "dim", "v").agg(F.min("row").alias("row"), F.count("*").alias("copies"), F.min("vec_id").alias("least")), "vector-nodes")
    largest = nodes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    coded = staged(nodes.mapInArrow(_coded(*plan(largest, cosine)), nodes.withColumn("codes", F.array().cast("array<int>")).schema), "vector-codes")
    # the buckets are dealt by numbers alone; vectors join those rows that meet others
    keys = ["label", "dim", "table", "code"]
    placed = coded.select("row", "label", "dim", F.posexplode("codes").alias("table", "code"))
    crowded = placed.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").withColumn("tiles", F.ceil(F.col("n") / tile).cast("int")).drop("n")
    dealt = placed.join(crowded, keys).withColumn("tile", F.pmod(F.xxhash64("row"), F.col("tiles")).cast("int"))
    # a tile meets itself and every other tile of its bucket, as the first or the second of the pair
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = met.select("row", *keys, F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), (F.col("tile") > F.col("other")).cast("int").alias("side"))
    # many buckets go to one group, as a group has a price of its own
    deal = F.pmod(F.xxhash64("code", "low", "high"), F.lit(max(1, -(-largest // tile))))
    pairs = met.join(coded.select("row", "v", "codes", "copies"), "row").groupBy("label", "dim", "table", deal.alias("deal"))
    found = staged(pairs.applyInArrow(_linked(cosine), "row long, n long, root long"), "vector-links")
    counts = found.groupBy("row").agg(F.sum("n").alias("n_links"))
    groups = connected_components(found, "row", "root").select(F.col("node").alias("row"), "component")
    linked = staged(counts.join(groups, "row").join(nodes.select("row", "least"), "row"), "vector-components")
    names = staged(linked.groupBy("component").agg(F.min("least").alias("component_id")), "vector-names")
    told = nodes.join(linked.join(names, "component").select("row", "n_links", "component_id"), "row", "left")
    # a vector's copies are links too
    told = staged(told.select("label", "v", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")), "vector-told")
    alone = rows.where("dim is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    result = known.join(told, ["label", "v"]).select("vec_id", "n_links", "component_id").unionByName(alone)
    return result.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
