"""SimHash near-duplicates: generalised pigeonhole search over 64-bit fingerprints.

Fingerprints: ASCII lower case, words between ASCII blanks, 4-word shingles with repeats,
XXH64 with seed 42, majority vote per bit. Links: at most `max_bits` differing bits.

Search: correlated bits are grouped into partitions. For a fingerprint q and thresholds
e_1..e_m with sum(e_i) = max_bits - m + 1, each fingerprint within max_bits of q agrees with
it, in some partition i, but for at most e_i bits; -1 skips a partition. Each q gets its own
thresholds by dynamic programming on the counts of the values near its own, so that it spends
its probes where its values are rare. Probes meet the index in an equi-join whose condition
verifies the distance, so that candidates are never rows.

Defined results: null or blank text has fingerprint zero, and links like any other; rows with
equal ids are rows of their own; a component of rows without ids has a null id; an empty table
gives an empty result. Other columns are neither read nor required.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.columns import named, unpacked
from larder.llm.graph import connected_components
from larder.session import staged

MAX_BITS = 4
PARTS = 4
WIDTH = 64 // PARTS
LARGEST = 2  # of a partition's threshold: 137 probes
MOST_BITS = PARTS * (LARGEST + 1) - 1  # the largest distance that they reach
PROBE_COST = 2.0  # of sending one probe, in candidates verified
BLOCK = 65536  # shingles counted at once


def fingerprint(text: bytes | None) -> int:
    """The fingerprint as a signed 64-bit number."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= 4:
        h = xxhash.xxh64_intdigest(b" ".join(words), 42)
        return h - (1 << 64) if h >> 63 else h
    line, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-4])]
    digest, counts, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(words) - 3
    for k in range(0, n, BLOCK):
        h = np.array([digest(line[s:e], 42) for s, e in zip(starts[k : k + BLOCK], ends[k + 3 : k + 3 + BLOCK], strict=False)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def _fingerprints(batches):
    for batch in batches:
        found = [fingerprint(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("own"), pa.array(found, pa.int64())], ["own", "fp"])


def with_fingerprints(docs: DataFrame, own: Column, text: str = "text") -> DataFrame:
    """(own, fp): a column made of the row's, and the fingerprint of its text."""
    rows = docs.select(own.alias("own"), named(text).cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints, rows.select("own", F.lit(0).cast("long").alias("fp")).schema)


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _together(batches):
    total, rows = np.zeros((64, 64)), 0
    for batch in batches:
        bits = _bits(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
        total += bits.T @ bits
        rows += len(bits)
    yield pa.RecordBatch.from_arrays([pa.array(range(4097), pa.int32()), pa.array([*total.ravel(), float(rows)], pa.float64())], ["pos", "n"])


def correlated_partitions(fps: DataFrame) -> list[list[int]]:
    """Groups of WIDTH bits: a seed with the most correlation, and the bits closest to its
    group so far. The statistics are 64 x 64 sums over all fingerprints."""
    sums = fps.mapInArrow(_together, "pos int, n double").groupBy("pos").agg(F.sum("n").alias("n")).orderBy("pos").collect()
    both, rows = np.array([r.n for r in sums[:4096]]).reshape(64, 64), max(sums[4096].n, 1.0) if sums else 1.0
    p = np.diag(both) / rows
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    near = np.abs(both / rows - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(near, 0)
    left, groups = set(range(64)), []
    while left:
        free = sorted(left)
        group = [max(free, key=lambda b: near[b, free].sum())]
        while len(group) < WIDTH:
            group.append(max((b for b in free if b not in group), key=lambda b: near[b, group].sum()))
        left -= set(group)
        groups.append(sorted(group))
    return groups


def _values(fps: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """The value of each partition, rows x parts."""
    bits, weights = _bits(fps), 1 << np.arange(WIDTH)
    return np.stack([bits[:, g].astype(np.int64) @ weights for g in groups], axis=1)


def _masks(radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(WIDTH), r)], np.int64)


def _ball_counts(counts: np.ndarray) -> np.ndarray:
    """counts[v] to [e, v]: rows whose value differs from v in at most e bits."""
    every, out = np.arange(1 << WIDTH), []
    total = np.zeros(1 << WIDTH)
    for r in range(LARGEST + 1):
        for c in combinations(range(WIDTH), r):
            total = total + counts[every ^ sum(1 << b for b in c)]
        out.append(total)
    return np.stack(out)


def allocate(costs: np.ndarray, total: int) -> np.ndarray:
    """Thresholds (rows x parts) of the least cost that sum to `total`. costs: parts x rows x
    thresholds from -1; by dynamic programming over the parts."""
    parts, rows, kinds = costs.shape
    low, high = -parts, parts * (kinds - 2)
    best = np.full((high - low + 1, rows), np.inf)
    best[-low] = 0
    steps = []
    for cost in costs:
        new, pick = np.full_like(best, np.inf), np.zeros(best.shape, np.int8)
        for e in range(-1, kinds - 1):
            for s in range(len(best)):
                if 0 <= s - e < len(best):
                    better = (x := best[s - e] + cost[:, e + 1]) < new[s]
                    new[s, better], pick[s, better] = x[better], e
        best = new
        steps.append(pick)
    at, every, out = np.full(rows, total - low), np.arange(rows), []
    for pick in reversed(steps):
        out.append(e := pick[at, every])
        at = at - e
    return np.stack(out[::-1], axis=1)


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct fingerprints (column __fp, no repeats) that
    differ in at most max_bits bits; a pair may come more than once."""
    if max_bits > MOST_BITS:
        raise ValueError(f"thresholds up to {LARGEST} in {PARTS} partitions reach {MOST_BITS} bits, not {max_bits}")
    groups = correlated_partitions(fps)

    def index(batches):
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            values = _values(own, groups)
            yield pa.RecordBatch.from_arrays([pa.array((values + (np.arange(PARTS) << WIDTH)).T.ravel().astype(np.int32)), pa.array(np.tile(own, PARTS))], ["key", "a"])

    entries = fps.mapInArrow(index, "key int, a long")
    # at most PARTS * 2**WIDTH counts, however many fingerprints there are
    seen = entries.groupBy("key").count().toArrow()
    counts = np.zeros((PARTS, 1 << WIDTH))
    keys = seen["key"].to_numpy().astype(np.int64)
    counts[keys >> WIDTH, keys & ((1 << WIDTH) - 1)] = seen["count"].to_numpy()
    balls = fps.sparkSession.sparkContext.broadcast(np.stack([_ball_counts(c) for c in counts]).astype(np.float32))

    def probes(batches):
        near, sizes = balls.value, np.array([len(_masks(r)) for r in range(LARGEST + 1)])
        masks = [_masks(r) for r in range(LARGEST + 1)]
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                own = batch.column(0).slice(k, 2000).to_numpy(zero_copy_only=False)
                values = _values(own, groups)
                cost = np.zeros((PARTS, len(own), LARGEST + 2))
                for i in range(PARTS):
                    cost[i, :, 1:] = near[i][:, values[:, i]].T + PROBE_COST * sizes
                chosen = allocate(cost, max_bits - PARTS + 1)
                for i in range(PARTS):
                    for e in range(LARGEST + 1):
                        if len(rows := np.flatnonzero(chosen[:, i] == e)):
                            keys = (values[rows, i][:, None] ^ masks[e][None, :]) + (i << WIDTH)
                            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().astype(np.int32)), pa.array(np.repeat(own[rows], len(masks[e])))], ["key", "b"])

    asked = fps.mapInArrow(probes, "key int, b long")
    near = (entries.a < asked.b) & (F.bit_count(entries.a.bitwiseXOR(asked.b)) <= max_bits)
    return asked.join(entries, (asked.key == entries.key) & near).select("a", "b")


def _components(fps: DataFrame) -> DataFrame:
    """(fp, root) of the fingerprints (column fp, no repeats) that have links."""
    return connected_components(links(fps.select(F.col("fp").alias("__fp"))), "a", "b").select(F.col("node").alias("fp"), F.col("component").alias("root"))


def fingerprint_components(rows: DataFrame) -> DataFrame:
    """(fp, component_id) for each distinct fp of rows (own, fp): the least `own` reachable."""
    nodes = staged(rows.groupBy("fp").agg(F.min("own").alias("least")), "simhash-nodes")
    placed = staged(nodes.join(_components(nodes), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-placed")
    roots = staged(placed.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-roots")
    return staged(placed.join(roots, "root").select("fp", "component_id"), "simhash-components")


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row."""
    rows = staged(with_fingerprints(docs, named(doc_id), text), "simhash-rows")
    return rows.join(fingerprint_components(rows), "fp").select(F.col("own").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay: of each component the row with the least id (rows without
    an id last), and of rows that tie the first one written. Columns and their order stay, whatever their names."""
    rows = staged(with_fingerprints(docs, F.struct(*map(named, docs.columns)), text).withColumn("row", F.monotonically_increasing_id()), "simhash-documents")
    keys = rows.select("row", F.col("own").getField(doc_id).alias("id"), "fp")
    nodes = staged(keys.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")), "simhash-nodes")
    kept = nodes.join(_components(nodes), "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    # the row numbers are the small side: hashing them spares a sort of whole texts
    return unpacked(rows.join(staged(kept, "simhash-kept").hint("shuffle_hash"), "row", "left_semi"))
