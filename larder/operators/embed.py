"""Vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from larder.session import staged

DIM = 1536
QUERY_BLOCK = 8_192  # queries of a cell
ROW_BLOCK = 8_192  # rows of a cell
LEAST_BLOCK = 500  # rows for which a core more is worth its while
CODEWORDS = 256
RERANK = (2, 4, 6, 8, 12, 16, 24, 32)  # rows compared exactly, times k
PRODUCT = 1_000_000  # distances held at once
SLICE = 256  # rows that a task turns into Python objects at once
KNOWN_GRAMS = 1 << 20  # places for grams whose bucket a worker remembers
CHARS = 4_095  # characters that a gram's number tells apart
PIECE = 1 << 17  # characters of a text whose grams are held at once


def _grams(text: str) -> list[str]:
    t = f" {text} ".lower()
    return [t[i : i + n] for n in (3, 4, 5) for i in range(len(t) - n + 1)]


class _Buckets:
    """Counts of a text's grams by bucket. Characters are numbered from 1 as they come, so that a gram is one 64-bit number
    of 12 bits a character; a table with one place for each hash of such numbers remembers buckets. When the characters run out, all is forgotten."""

    def __init__(self, dim: int):
        self.dim = dim
        self.forget()

    def forget(self) -> None:
        self.number, self.n_chars = np.zeros(0x110000, np.uint16), 0
        self.known, self.bucket = np.zeros(KNOWN_GRAMS, np.uint64), np.zeros(KNOWN_GRAMS, np.int32)

    def counts(self, text: str) -> np.ndarray:
        t = f" {text} ".lower()
        chars = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        new = np.unique(chars[self.number[chars] == 0])
        if self.n_chars + len(new) > CHARS:
            self.forget()
            new = np.unique(chars)
            if len(new) > CHARS:
                return np.bincount([self.of(g) for g in _grams(text)], minlength=self.dim)
        self.number[new] = np.arange(self.n_chars + 1, self.n_chars + 1 + len(new))
        self.n_chars += len(new)
        codes, out = self.number[chars].astype(np.uint64), np.zeros(self.dim, np.int64)
        for k in range(0, len(codes), PIECE):
            out += np.bincount(self.buckets(t, codes[k : k + PIECE + 4], k, min(PIECE, len(codes) - k)), minlength=self.dim)
        return out

    def buckets(self, t: str, codes: np.ndarray, start: int, n: int) -> np.ndarray:
        """Of the grams that begin at the n places from start on."""
        grams, made = [], codes
        for size in (2, 3, 4, 5):
            made = (made[:-1] << np.uint64(12)) | codes[size - 1 :] if len(codes) >= size else codes[:0]
            if size > 2:
                grams.append(made[:n])
        sizes = [len(g) for g in grams]
        gram = np.concatenate(grams)
        place = ((gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(KNOWN_GRAMS)
        out, missed = self.bucket[place], np.flatnonzero(self.known[place] != gram)
        if len(missed):
            fresh, first, back = np.unique(gram[missed], return_index=True, return_inverse=True)
            at, ends = missed[first], np.cumsum(sizes)
            which = np.searchsorted(ends, at, "right")
            begin = start + at - (ends - sizes)[which]
            found = np.array([self.of(t[i : i + 3 + w]) for i, w in zip(begin.tolist(), which.tolist())], np.int32)
            out[missed] = found[back]
            # of grams that share a place the last stays, number and bucket alike
            self.known[place[at]], self.bucket[place[at]] = fresh, found
        return out

    def of(self, gram: str) -> int:
        return int.from_bytes(hashlib.md5(gram.encode()).digest(), "big") % self.dim


def hash_embed(df: DataFrame, key: str, text: str, dim: int = DIM) -> DataFrame:
    """(key, embedding): counts of 3- to 5-character pieces in md5 buckets (big-endian, modulo dim), normalized;
    zero for the empty text. Nulls count as empty."""
    own = df.select(F.col(key), F.col(text).alias("__text"))

    def run(batches):
        buckets = _Buckets(dim)
        for batch in batches:
            for part in _slices(batch):
                rows = []
                for t in part.column("__text").to_pylist():
                    v = buckets.counts(t or "").astype(np.float64)
                    n = np.linalg.norm(v)
                    rows.append((v / n if n else v).astype(np.float32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.float32()))], [key, "embedding"])

    return own.mapInArrow(run, own.select(key, F.array().cast("array<float>").alias("embedding")).schema)


def apply_provider(df: DataFrame, make: Callable, inputs: list[str], output: str, schema: str, dim: int | None = None) -> DataFrame:
    """Df with `output` from a user's batch function. make() is called once per task and gives a function from a
    pandas frame of `inputs`, at most SLICE rows, to a sequence; its length, and its vectors' dimension, are checked."""
    out = df.select("*", F.lit(None).cast(schema).alias(output)).schema
    kind = to_arrow_type(out[output].dataType)

    def run(batches):
        provider = make()
        for batch in batches:
            for part in _slices(batch):
                frame = part.select(inputs).to_pandas()
                for name in frame.select_dtypes("datetimetz").columns:  # in the session's zone, as pandas functions get them
                    frame[name] = frame[name].dt.tz_localize(None)
                values = list(provider(frame))
                if len(values) != len(frame):
                    raise ValueError(f"{len(values)} outputs for {len(frame)} inputs")
                if dim is not None and any(len(v) != dim for v in values):
                    raise ValueError(f"an output of another dimension than {dim}")
                yield part.append_column(output, pa.Array.from_pandas(pd.Series(values, dtype=object), type=kind))

    return df.mapInArrow(run, out)


def _slices(batch: pa.RecordBatch):
    """A batch in slices of SLICE rows: what a task turns into Python objects at once does not grow with Spark's batches."""
    return (batch.slice(k, SLICE) for k in range(0, batch.num_rows, SLICE))


def check_vectors(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """One row: n, n_null, n_wrong_dim."""
    v = F.col(vector)
    return df.agg(F.count("*").alias("n"), F.count_if(v.isNull()).alias("n_null"), F.count_if(F.size(v) != dim).alias("n_wrong_dim"))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalize(df: DataFrame, vector: str, out: str) -> DataFrame:
    """Unit vectors as doubles; zero vectors stay."""
    sized = df.withColumn("__norm", norm(F.col(vector)))
    unit = F.transform(F.col(vector), lambda x: F.when(F.col("__norm") > 0, x / F.col("__norm")).otherwise(x.cast("double")))
    return sized.withColumn(out, unit).drop("__norm")


def _known(df: DataFrame, vector: str) -> DataFrame:
    return df.where(F.col(vector).isNotNull() & (norm(F.col(vector)) > 0))


def knn(queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "query_id", key: str = "segment_id", vector: str = "embedding", scope: str | None = None) -> DataFrame:
    """K1: (query_id, key, distance, rank): the exact k nearest by cosine distance, rounded to 6 digits, ties by key.
    Null and zero vectors are left out; with `scope`, only rows of the query's scope count, and a null scope meets none.

    Queries and rows are dealt to the cells of a grid (`_dealt`); a cell is one Arrow co-group of bounded size that keeps
    its k best of every query. No query passes through the driver, and no pair of vectors ever becomes a row.
    """
    met = F.col(scope) if scope else F.lit(0)
    rows = _known(corpus, vector).select(F.col(key), F.col(vector).alias("__v"), met.alias("__s")).where(F.col("__s").isNotNull())
    asked = _known(queries, vector).select(query_id, F.col(vector).alias("__v"), met.alias("__s")).where(F.col("__s").isNotNull())
    found = _over_grid(asked, rows, scope is not None, query_id, key, _nearest_in_cell(k, query_id, key))
    return _ranked(found, k, query_id, key)


def _ranked(found: DataFrame, k: int, query_id: str, key: str) -> DataFrame:
    order = Window.partitionBy(query_id).orderBy("distance", key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _over_grid(asked: DataFrame, rows: DataFrame, scoped: bool, query_id: str, key: str, cell: Callable) -> DataFrame:
    """(query_id, key, distance) of cell(asked, rows) in every cell; both sides have __s, the scope within which they meet."""
    types = asked.select(F.col(query_id)).schema[0].dataType, rows.select(F.col(key)).schema[0].dataType
    schema = asked.select(F.lit(None).cast(types[0]).alias(query_id), F.lit(None).cast(types[1]).alias(key), F.lit(0.0).alias("distance")).schema
    empty = to_arrow_schema(schema).empty_table()
    left, right = _dealt(asked, rows, scoped, query_id, key)

    def run(_, a: pa.Table, b: pa.Table) -> pa.Table:
        return cell(a, b).cast(empty.schema) if a.num_rows and b.num_rows else empty

    return left.groupBy("__g", "__c").cogroup(right.groupBy("__g", "__c")).applyInArrow(run, schema)


def _dealt(asked: DataFrame, rows: DataFrame, scoped: bool, query_id: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with their cells (__g, __c). A scope of more than ROW_BLOCK rows or QUERY_BLOCK queries has a grid of its own,
    each of its rows once for every block of queries and the other way round; smaller scopes share cells by a hash. So a
    cell holds about a block of either side, however large a scope is and however many there are."""
    cores = asked.sparkSession.sparkContext.defaultParallelism
    blocks = lambda n: max(1, -(-n // ROW_BLOCK), min(cores, n // LEAST_BLOCK))
    number = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    if not scoped:
        qb, rb = max(1, -(-asked.count() // QUERY_BLOCK)), blocks(rows.count())
        a = asked.select("*", F.lit(0).cast("long").alias("__g"), F.explode(F.sequence(F.lit(0), F.lit(rb - 1))).alias("__n"))
        b = rows.select("*", F.lit(0).cast("long").alias("__g"), F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("__n"))
        return a.withColumn("__c", number(query_id, F.lit(qb)) * rb + F.col("__n")).drop("__n"), b.withColumn("__c", F.col("__n") * rb + number(key, F.lit(rb))).drop("__n")
    counts = asked.groupBy("__s").agg(F.count("*").alias("q")).join(rows.groupBy("__s").agg(F.count("*").alias("r")), "__s")
    hot = (F.col("q") > QUERY_BLOCK) | (F.col("r") > ROW_BLOCK)
    counts = staged(counts.withColumn("hot", hot), "scopes")
    size = counts.agg(F.count_if("hot").alias("hot"), F.coalesce(F.sum(F.when(~F.col("hot"), F.greatest("r", F.col("q")))), F.lit(0)).alias("n")).first()
    shared = F.pmod(F.xxhash64("__s"), F.lit(blocks(size.n)))
    if not size.hot:
        own = lambda df: df.select("*", shared.alias("__g"), F.lit(-1).alias("__c"))
        return own(asked), own(rows)
    # the hot scopes are at most as many as there are blocks; the planner chooses the join by their size
    up = lambda c, block: F.ceil(F.col(c) / block).cast("int")
    grid = counts.where("hot").select("__s", up("q", QUERY_BLOCK).alias("__qb"), up("r", ROW_BLOCK).alias("__rb"))

    def own(df: DataFrame, c: str, mine: str, other: str, cell: Callable) -> DataFrame:
        known = df.join(grid, "__s", "left").select("*", F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other) - 1, F.lit(0)))).alias("__n"))
        is_hot = F.col("__qb").isNotNull()
        at = F.when(is_hot, cell(number(c, F.coalesce(mine, F.lit(1))), F.col("__n"))).otherwise(F.lit(-1))
        return known.select(*df.columns, F.when(is_hot, F.xxhash64("__s")).otherwise(shared).alias("__g"), at.alias("__c"))

    return own(asked, query_id, "__qb", "__rb", lambda i, n: i * F.col("__rb") + n), own(rows, key, "__rb", "__qb", lambda i, n: n * F.col("__rb") + i)


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """List rows of one length as a matrix."""
    flat = pc.list_flatten(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
    return np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _meetings(asked: pa.Table, rows: pa.Table):
    """(places of queries, places of rows in order of their keys) for each scope of a cell, at most PRODUCT pairs at once."""
    values = asked.column("__s").to_pylist() + rows.column("__s").to_pylist()
    codes, _ = pd.factorize(np.asarray(values, object))
    mine, theirs = codes[: asked.num_rows], codes[asked.num_rows :]
    by_query, by_row = np.argsort(mine, kind="stable"), np.argsort(theirs, kind="stable")
    for code in np.intersect1d(mine, theirs):
        who = by_query[np.searchsorted(mine[by_query], code) : np.searchsorted(mine[by_query], code, "right")]
        met = by_row[np.searchsorted(theirs[by_row], code) : np.searchsorted(theirs[by_row], code, "right")]
        step = max(1, PRODUCT // len(met))
        for i in range(0, len(who), step):
            yield who[i : i + step], met


def _least(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k least numbers of every row of d, ties by column."""
    cut = np.full(len(d), np.inf) if d.shape[1] <= k else np.partition(d, k - 1, axis=1)[:, k - 1]
    i, j = np.nonzero(d <= cut[:, None])  # all that tie with the k-th, then the first k of them
    order = np.lexsort((j, d[i, j], i))
    i, j = i[order], j[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep]


def _by_key(rows: pa.Table, key: str) -> pa.Table:
    """Sorted by key, so that ties go by place."""
    return rows.take(pa.array(np.argsort(np.asarray(rows.column(key).to_pylist()), kind="stable")))


def _cell_result(asked: pa.Table, rows: pa.Table, query_id: str, key: str, found: list) -> pa.Table:
    i, j, d = (np.concatenate([f[n] for f in found]) if found else np.zeros(0, int) for n in range(3))
    return pa.table({query_id: asked.column(query_id).take(pa.array(i, pa.int64())), key: rows.column(key).take(pa.array(j, pa.int64())), "distance": pa.array(d, pa.float64())})


def _nearest_in_cell(k: int, query_id: str, key: str) -> Callable:
    def cell(asked: pa.Table, rows: pa.Table) -> pa.Table:
        rows, found = _by_key(rows, key), []
        q, v = _unit(_vectors(asked.column("__v"))), _unit(_vectors(rows.column("__v")))
        for who, met in _meetings(asked, rows):
            d = np.round(1 - q[who] @ v[met].T, 6) + 0.0  # no negative zero
            i, j = _least(d, k)
            found.append((who[i], met[j], d[i, j]))
        return _cell_result(asked, rows, query_id, key, found)

    return cell


@dataclass
class Quantizer:
    """What tasks need of an index; its size depends on the dimension and on the number of cells alone."""

    centres: np.ndarray  # cells x dim
    books: np.ndarray  # parts x CODEWORDS x width, of vectors padded with zeros

    def parted(self, x: np.ndarray) -> np.ndarray:
        """n x parts x width."""
        parts, _, width = self.books.shape
        out = np.zeros((len(x), parts * width))
        out[:, : x.shape[1]] = x
        return out.reshape(len(x), parts, width)

    def nearest_cells(self, unit: np.ndarray) -> np.ndarray:
        return np.argsort((self.centres**2).sum(axis=1) - 2 * unit @ self.centres.T, axis=1, kind="stable")

    def encoded(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and codes of unit vectors."""
        cell = self.nearest_cells(unit)[:, 0]
        rest = self.parted(unit - self.centres[cell])
        code = np.empty(rest.shape[:2], np.uint8)
        for p, book in enumerate(self.books):
            code[:, p] = np.argmin((book**2).sum(axis=1) - 2 * rest[:, p] @ book.T, axis=1)
        return cell, code


@dataclass
class VectorIndex:
    """Product-quantized residuals: `rows` (key, __v) and `codes` (key, __s: the cell, code: a byte for each part of the residual)."""

    rows: DataFrame
    codes: DataFrame
    quantizer: Quantizer
    key: str


def _lloyd(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k codewords of x, from k of its rows at even distances; with fewer rows, the rows and zeros."""
    if len(x) <= k:
        return np.concatenate([x, np.zeros((k - len(x), x.shape[1]))])
    book = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        near = np.argmin((book**2).sum(axis=1) - 2 * x @ book.T, axis=1)
        n = np.bincount(near, minlength=k)
        for j in range(x.shape[1]):
            book[:, j] = np.where(n > 0, np.bincount(near, x[:, j], k) / np.maximum(n, 1), book[:, j])
    return book


def build_vector_index(corpus: DataFrame, key: str = "segment_id", vector: str = "embedding", cells: int | None = None, sample: int = 20_000, part: int = 4) -> VectorIndex | None:
    """An index of every known vector of the corpus, None if there is none. Cells (k-means) and codewords (one Spark group for each
    part of `part` dimensions) are fitted on at most `sample` rows, the first by a hash of the key; a row then takes one byte for each part."""
    rows = _known(corpus, vector).select(F.col(key), F.col(vector).alias("__v"))
    count = rows.count()
    if not count:
        return None
    cells = cells or max(16, min(round(count**0.5 / 4), sample // 20))
    some = staged(l2_normalize(rows.orderBy(F.xxhash64(key)).limit(sample), "__v", "__u").select("__u"), "index-sample")
    centres = np.asarray(KMeans(k=cells, seed=1, featuresCol="__f", maxIter=10).fit(some.select(array_to_vector("__u").alias("__f"))).clusterCenters())
    parts = -(-centres.shape[1] // part)
    quantizer = Quantizer(centres, np.zeros((parts, CODEWORDS, part)))

    def rests(batches):
        for batch in batches:
            for part_ in _slices(batch):
                unit = _vectors(part_.column("__u"))
                rest = quantizer.parted(unit - centres[quantizer.nearest_cells(unit)[:, 0]])
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(parts, dtype=np.int32), len(unit))), pa.array(list(rest.reshape(-1, part)), pa.list_(pa.float64()))], ["part", "rest"])

    def fit(table: pa.Table) -> pa.Table:
        book = _lloyd(_vectors(table.column("rest")), CODEWORDS)
        return pa.table({"part": table.column("part")[:1], "book": pa.array([book.ravel()], pa.list_(pa.float64()))})

    fitted = some.mapInArrow(rests, "part int, rest array<double>").groupBy("part").applyInArrow(fit, "part int, book array<double>").collect()
    books = np.zeros((parts, CODEWORDS, part))
    for r in fitted:
        books[r.part] = np.asarray(r.book).reshape(CODEWORDS, part)
    ready = Quantizer(centres, books)
    schema = rows.select(key, F.lit(0).alias("__s"), F.lit(b"").cast("binary").alias("code")).schema
    key_type = to_arrow_type(schema[key].dataType)

    def encode(batches):
        for batch in batches:
            for rows_ in _slices(batch):
                cell, code = ready.encoded(_unit(_vectors(rows_.column("__v"))))
                yield pa.RecordBatch.from_arrays([rows_.column(0).cast(key_type), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary())], [key, "__s", "code"])

    return VectorIndex(rows, staged(rows.mapInArrow(encode, schema), "index-codes"), ready, key)


def search_index(index: VectorIndex, queries: DataFrame, k: int, probes: int, rerank: int, query_id: str = "query_id", vector: str = "embedding") -> DataFrame:
    """As knn, approximately: each query reads the codes of its `probes` nearest cells, and the `rerank` rows that look nearest
    by their codes are compared with it exactly."""
    asked = _known(queries, vector).select(query_id, F.col(vector).alias("__v"))
    near = _looked_near(index, asked, probes, rerank, query_id)
    picked = near.select(query_id, index.key).join(index.rows, index.key).withColumnRenamed("__v", "__r").join(asked, query_id)
    dot = F.aggregate(F.zip_with("__v", "__r", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    exact = picked.select(query_id, index.key, (F.round(1 - dot / (norm(F.col("__v")) * norm(F.col("__r"))), 6) + 0.0).alias("distance"))
    return _ranked(exact, k, query_id, index.key)


def _looked_near(index: VectorIndex, asked: DataFrame, probes: int, rerank: int, query_id: str) -> DataFrame:
    """(query_id, key, distance, rank) by codes alone."""
    quantizer, key = index.quantizer, index.key
    probing = asked.select(query_id, "__v", F.lit(0).alias("__s")).schema
    id_type = to_arrow_type(probing[query_id].dataType)

    def probe(batches):
        for batch in batches:
            for some in _slices(batch):
                cells = quantizer.nearest_cells(_unit(_vectors(some.column("__v"))))[:, :probes]
                again = pa.array(np.repeat(np.arange(some.num_rows), cells.shape[1]))
                yield pa.RecordBatch.from_arrays([some.column(0).take(again).cast(id_type), some.column(1).take(again), pa.array(cells.ravel().astype(np.int32))], [query_id, "__v", "__s"])

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        b, found = _by_key(b, key), []
        q, centres = _unit(_vectors(a.column("__v"))), quantizer.centres
        code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, -1)
        where = np.asarray(b.column("__s").to_pylist())
        few = max(1, PRODUCT // quantizer.books[..., 0].size)  # queries whose tables are held at once
        for all_, met in _meetings(a, b):
            for who in (all_[i : i + few] for i in range(0, len(all_), few)):
                tables = np.einsum("qpw,pcw->qpc", quantizer.parted(q[who]), quantizer.books)  # what a codeword adds to a product
                d = np.repeat(1 - q[who] @ centres[where[met[0]]][:, None], len(met), axis=1)
                for p in range(code.shape[1]):
                    d -= tables[:, p][:, code[met, p]]
                i, j = _least(d, rerank)
                found.append((who[i], met[j], d[i, j]))
        return _cell_result(a, b, query_id, key, found)

    return _ranked(_over_grid(asked.mapInArrow(probe, probing), index.codes, True, query_id, key, cell), rerank, query_id, key)


def calibrated(index: VectorIndex, queries: DataFrame, k: int, recall: float, trials: int, query_id: str = "query_id", vector: str = "embedding") -> tuple[int, int]:
    """(probes, rerank) that find `recall` of the k exact neighbours of up to `trials` rows of the index, taken by a hash
    and none of them equal to a query: the queries themselves have no say. At most trials x k places reach the driver."""
    asked = _known(queries, vector).select(F.xxhash64(vector).alias("__h")).distinct()
    tried = index.rows.withColumn("__h", F.xxhash64("__v")).join(asked, "__h", "left_anti").orderBy(F.xxhash64(index.key, F.lit(7))).limit(trials)
    tried = staged(tried.select(F.col(index.key).alias("__t"), "__v"), "index-trials")
    exact = staged(knn(tried, index.rows, k + 1, "__t", index.key, "__v").where(F.col("__t") != F.col(index.key)).where(F.col("rank") <= k + 1).select("__t", index.key), "index-exact")
    cell_of = index.codes.select(index.key, "__s").join(exact, index.key).join(tried, "__t").select("__v", "__s").toPandas()
    if not len(cell_of):
        return len(index.quantizer.centres), RERANK[0] * k
    order = index.quantizer.nearest_cells(_unit(np.asarray(cell_of["__v"].tolist(), np.float64)))
    place = np.sort(np.argmax(order == cell_of["__s"].to_numpy()[:, None], axis=1) + 1)
    within = (1 + recall) / 2  # half of what may be missed is left to the codes
    probes = int(place[max(0, int(np.ceil(within * len(place))) - 1)])
    near = _looked_near(index, tried.withColumnRenamed("__t", "__q"), probes, RERANK[-1] * k, "__q").select(F.col("__q").alias("__t"), index.key, "rank")
    ranks = np.array([r["rank"] for r in exact.join(near, ["__t", index.key]).select("rank").collect()])
    for times in RERANK:
        if (ranks <= times * k + 1).sum() >= recall * len(place):
            return probes, times * k + 1
    return probes, RERANK[-1] * k


def ann(queries: DataFrame, corpus: DataFrame, k: int, cells: int | None = None, probes: int | None = None, rerank: int | None = None, sample: int = 20_000, query_id: str = "query_id", key: str = "segment_id", vector: str = "embedding", recall: float = 0.95, trials: int = 500) -> DataFrame:
    """K2: as knn, approximately, by an index of product-quantized residuals. Every row is indexed. What is not given of
    probes and rerank is calibrated to `recall` on other vectors than the queries."""
    index = build_vector_index(corpus, key, vector, cells, sample)
    if index is None:
        return knn(queries, corpus, k, query_id, key, vector)
    if probes is None:
        probes, fitting = calibrated(index, queries, k, recall, trials, query_id, vector)
        rerank = rerank or fitting
    return search_index(index, queries, k, probes, rerank or RERANK[-1] * k, query_id, vector)


def max_sim_rank(queries: DataFrame, frames: DataFrame, k: int, query_id: str = "query_id") -> DataFrame:
    """(query_id, memory_id, similarity, rank): memories by their most similar of the k nearest frames."""
    near = knn(queries, frames, k, query_id, "frame_id").join(frames.select("frame_id", "memory_id"), "frame_id")
    best = near.groupBy(query_id, "memory_id").agg(F.round(F.max(1 - F.col("distance")), 6).alias("similarity"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("similarity"), "memory_id")))


