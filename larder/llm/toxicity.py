"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), x_i = 1 for every hashed
term i of the text. The pairwise part learns what additive weights miss: terms that are
harmless alone and not together.

Training takes a documented, bounded sample: at most `sample` labelled ids outside the held out
fold, the first by a hash of their id, one text of each (of several the one whose hash is least). Spark counts in how
many of these rows each term is; only terms of `MIN_ROWS` rows and more reach the driver, as no others can be trained,
and of a row with more than `MOST_TERMS` such terms those of most rows. Terms are trained if they alone
tell the label apart (a chi-squared level), or if they do so together with another frequent term
(`_paired`), whether or not they tell anything alone. The level, whether prefixes count, and the number of
epochs are chosen by cross-validation in FOLDS parts of that sample; the machine is then fitted on all of it. The
held out fold takes no part in any of this. Scoring reads every whole text in Arrow batches with
the model broadcast (fixed size: 2**BITS x (FACTORS + 1) floats).

Defined results: null and empty texts have no terms and score by the bias alone; rows without
an id are scored, never learned from, and count as not held out; of several labels of one id
the largest counts; without any usable label every score is 0; an empty table gives an empty result. Very
long texts are scored whole. `drop_toxic` keeps every other column, whatever its name; `toxicity_scores`
reads the id and the text alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.columns import named, packed, unpacked
from larder.session import staged

BITS = 18
FACTORS = 4
SAMPLE = 8_000
MOST_TERMS = 8_192  # of a sampled row, those of most rows; ties by number
MIN_ROWS = 3  # sampled rows that a hashed term needs, else it stays at zero
LEVELS = (6.63, 10.83, 20.0)  # chi-squared that a term needs against the label: by chance one in 100, 1,000, 100,000
FREQUENT = 768  # terms whose pairs are looked at
PAIR_LEVEL = 40.0  # chi-squared of a pair: beyond chance for 300,000 pairs
EPOCHS = 30
FOLDS = 3  # parts of the sample that settings are chosen by
BATCH = 256
BLOCK = 500_000  # numbers counted at once
RATE = 0.4
DECAY = 1e-4
PREFIXES = (4, 5, 6)
KNOWN = 200_000  # words whose hash a worker remembers
HALF = 1 << (BITS - 1)
_WORD = re.compile(r"[^\W_]+")


@dataclass
class Machine:
    bias: float
    weights: np.ndarray  # terms
    factors: np.ndarray  # terms x FACTORS
    fitted: bool = True

    def __post_init__(self):
        self.told = self.weights != 0

    def margin(self, terms: np.ndarray) -> float:
        terms = terms[self.told[terms]]
        v = self.factors[terms]
        pairs = 0.5 * float((v.sum(axis=0) ** 2 - (v * v).sum(axis=0)).sum())
        return self.bias + float(self.weights[terms].sum()) + pairs


class Terms:
    """Texts to their distinct hashed terms: words, and the first PREFIXES letters of longer words,
    which carry over to inflected and compounded forms. Words are numbered below HALF, prefixes from it on."""

    def __init__(self):
        self.known: dict[str, tuple[int, ...]] = {}

    def of(self, text: str | None) -> np.ndarray:
        if len(self.known) > KNOWN:
            self.known = {}
        words, known = set(_WORD.findall((text or "").lower())), self.known
        for w in words.difference(known):
            starts = (HALF + (xxhash.xxh32_intdigest(w[:n].encode()) >> (33 - BITS)) for n in PREFIXES if len(w) > n)
            known[w] = (xxhash.xxh32_intdigest(w.encode()) >> (33 - BITS), *starts)
        found = set(chain.from_iterable(map(known.__getitem__, words)))
        return np.sort(np.fromiter(found, np.int32, len(found)))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def _counts(values: np.ndarray, size: int) -> np.ndarray:
    """How often each number occurs, in blocks: bincount makes a wide copy of what it is given."""
    out = np.zeros(size, np.int64)
    for k in range(0, len(values), BLOCK):
        out += np.bincount(values[k : k + BLOCK], minlength=size)
    return out


class Rows:
    """Rows of terms, laid end to end."""

    def __init__(self, terms: np.ndarray, start: np.ndarray):
        self.terms, self.start, self.n = terms.astype(np.int32, copy=False), start, len(start) - 1

    @cached_property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.n, dtype=np.int32), np.diff(self.start))

    @classmethod
    def of(cls, rows) -> Rows:
        rows = [np.asarray(r, np.int32) for r in rows]
        return cls(np.concatenate(rows or [np.zeros(0, np.int32)]), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64))

    def __len__(self) -> int:
        return self.n

    def __iter__(self):
        return (self.terms[a:b] for a, b in zip(self.start, self.start[1:], strict=False))

    def take(self, chosen: np.ndarray) -> Rows:
        start = np.concatenate([[0], np.cumsum(self.start[chosen + 1] - self.start[chosen])]).astype(np.int64)
        terms = np.empty(start[-1], np.int32)
        for i, a, b in zip(chosen, start, start[1:], strict=False):
            terms[a:b] = self.terms[self.start[i] : self.start[i + 1]]
        return Rows(terms, start)

    def part(self, a: int, b: int) -> Rows:
        return Rows(self.terms[self.start[a] : self.start[b]], self.start[a : b + 1] - self.start[a])

    def renumbered(self, told: np.ndarray) -> Rows:
        """Only the terms that are told, by a dense number."""
        keep = told[self.terms]
        start = np.concatenate([[0], np.cumsum(_counts(self.row[keep], self.n))])
        return Rows((np.cumsum(told, dtype=np.int32) - 1)[self.terms[keep]], start)

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, values, self.n)


def _surprise(rows: Rows, toxic: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The chi-squared statistic of each term against the label."""
    n, k = rows.n, float(toxic.sum())
    a = _counts(rows.terms[(toxic > 0)[rows.row]], len(seen)).astype(np.float64)
    b = seen - a
    c, d = k - a, (n - k) - b
    return n * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * k * (n - k), 1e-9)


def _paired(rows: Rows, toxic: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Terms that with another of the FREQUENT ones tell the label: n times the squared correlation
    of the label with the product of both terms, all without their means, reaches PAIR_LEVEL."""
    out = np.zeros(len(seen), bool)
    often = np.flatnonzero(seen >= max(MIN_ROWS, rows.n // 100))
    often = often[np.lexsort((often, -seen[often]))][:FREQUENT]
    often = np.sort(often[seen[often] <= 0.99 * rows.n])
    if not len(often):
        return out
    place = np.full(len(seen), -1, np.int32)
    place[often] = np.arange(len(often))
    size, mean = len(often), seen[often].astype(np.float32) / rows.n
    y = (toxic - toxic.mean()).astype(np.float32)
    together, spread = np.zeros((size, size), np.float32), np.zeros((size, size), np.float32)
    for k in range(0, rows.n, 1000):
        part = slice(rows.start[k], rows.start[min(k + 1000, rows.n)])
        at, row = place[rows.terms[part]], rows.row[part] - k
        x = np.zeros((min(1000, rows.n - k), size), np.float32)
        x[row[at >= 0], at[at >= 0]] = 1
        x -= mean
        together += x.T @ (x * y[k : k + 1000, None])
        x *= x
        spread += x.T @ x  # the sum of squares of the products
    level = together**2 / np.maximum(spread * (y**2).mean(), 1e-9)
    np.fill_diagonal(level, 0)
    out[often] = level.max(axis=1) >= PAIR_LEVEL
    return out


class _Fit:
    """AdaGrad on the logistic loss, in batches, rows in a fixed shuffled order."""

    def __init__(self, rows: Rows, toxic: np.ndarray, told: np.ndarray, seed: int):
        self.told, self.rows, self.toxic = told, rows.renumbered(told), toxic
        self.n, self.rng = int(told.sum()), np.random.default_rng(seed)
        share = min(max(float(toxic.mean()), 1e-6), 1 - 1e-6)
        self.w, self.v, self.b = np.zeros(self.n), self.rng.normal(0, 0.01, (self.n, FACTORS)), float(np.log(share / (1 - share)))
        self.gw, self.gv, self.gb = np.full(self.n, 1e-2), np.full((self.n, FACTORS), 1e-2), 1e-2

    def margins(self, rows: Rows) -> np.ndarray:
        out = []
        for k in range(0, rows.n, BATCH):
            own = rows.part(k, min(k + BATCH, rows.n))
            vt = self.v[own.terms]
            square = sum(own.sums(vt[:, f]) ** 2 for f in range(FACTORS)) - own.sums((vt * vt).sum(axis=1))
            out.append(self.b + own.sums(self.w[own.terms]) + 0.5 * square)
        return np.concatenate(out or [np.zeros(0)])

    def epoch(self) -> None:
        order = self.rng.permutation(self.rows.n)
        for k in range(0, len(order), BATCH):
            own = self.rows.take(order[k : k + BATCH])
            terms, vt, scale = own.terms, self.v[own.terms], 1.0 / own.n
            total = np.stack([own.sums(vt[:, f]) for f in range(FACTORS)], axis=1)
            z = self.b + own.sums(self.w[terms]) + 0.5 * ((total**2).sum(axis=1) - own.sums((vt * vt).sum(axis=1)))
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - self.toxic[order[k : k + BATCH]]
            at, place = np.unique(terms, return_inverse=True)
            each = error[own.row]
            dw = np.bincount(place, each, len(at)) * scale + DECAY * self.w[at]
            dv = np.stack([np.bincount(place, each * (total[own.row, f] - vt[:, f]), len(at)) for f in range(FACTORS)], axis=1) * scale + DECAY * self.v[at]
            self.gw[at] += dw * dw
            self.gv[at] += dv * dv
            self.gb += float(error.mean()) ** 2
            self.w[at] -= RATE * dw / np.sqrt(self.gw[at])
            self.v[at] -= RATE * 0.5 * dv / np.sqrt(self.gv[at])
            self.b -= RATE * float(error.mean()) / self.gb**0.5

    def machine(self) -> Machine:
        size, at = len(self.told), np.flatnonzero(self.told)
        weights, factors = np.zeros(size, np.float32), np.zeros((size, FACTORS), np.float32)
        weights[at], factors[at] = self.w, self.v
        return Machine(self.b, weights, factors)


class _Terms:
    """What is known of the terms of some rows, for any level."""

    def __init__(self, rows: Rows, toxic: np.ndarray):
        self.seen = _counts(rows.terms, 1 << BITS)
        self.surprise, self.paired = _surprise(rows, toxic, self.seen), _paired(rows, toxic, self.seen)

    def told(self, level: float, prefixes: bool) -> np.ndarray:
        """The terms to train."""
        told = (self.seen >= MIN_ROWS) & ((self.surprise >= level) | self.paired)
        if not told.any():
            told = self.seen >= MIN_ROWS
        if not prefixes:
            told[HALF:] = False
        return told


def _ranked(margins: np.ndarray, toxic: np.ndarray) -> float:
    """The share of pairs of a toxic and a clean row whose margins are in order; ties count half."""
    values, place, count = np.unique(margins, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[place]
    k = toxic.sum()
    return float((rank[toxic > 0].sum() - k * (k + 1) / 2) / (k * (len(toxic) - k)))


def choose(rows: Rows, toxic: np.ndarray, seed: int) -> tuple[float, bool, int]:
    """(level, prefixes, epochs). The rows are cut into FOLDS parts, each scored by a machine of the others. Of each
    setting that number of epochs counts which has the least loss, and of the settings that which
    ranks the rows best: the level with prefixes first, then whether that level does better without them."""
    if min(toxic.sum(), (1 - toxic).sum()) < 5 * FOLDS:
        return LEVELS[1], True, EPOCHS // 2

    def tried(settings: list[tuple[float, bool]]) -> list[tuple[float, float, bool, int]]:
        margins = np.zeros((len(settings), EPOCHS, rows.n), np.float32)
        for k in range(FOLDS):
            check = np.arange(rows.n) % FOLDS == k
            own, other = rows.take(np.flatnonzero(~check)), rows.take(np.flatnonzero(check))
            about = _Terms(own, toxic[~check])
            for i, (level, prefixes) in enumerate(settings):
                told = about.told(level, prefixes)
                fit, checked = _Fit(own, toxic[~check], told, seed), other.renumbered(told)
                for e in range(EPOCHS):
                    fit.epoch()
                    margins[i, e, check] = fit.margins(checked)
        losses = np.logaddexp(0, np.where(toxic > 0, -1, 1) * margins).sum(axis=2)
        return [(_ranked(margins[i, e], toxic), level, prefixes, int(e) + 1) for i, ((level, prefixes), e) in enumerate(zip(settings, losses.argmin(axis=1), strict=True))]

    best = max(tried([(level, True) for level in LEVELS]))
    return max(best, tried([(best[1], False)])[0])[1:]


def train(rows: Rows | list[np.ndarray], toxic: np.ndarray, seed: int = 7) -> Machine:
    """A machine by the settings that suit the rows; their order is shuffled once, the same for equal rows."""
    size = 1 << BITS
    if not len(rows) or len(np.unique(toxic)) < 2:
        return Machine(0.0, np.zeros(size, np.float32), np.zeros((size, FACTORS), np.float32), False)
    order = np.random.default_rng(seed).permutation(len(rows))
    own, toxic = (rows if isinstance(rows, Rows) else Rows.of(rows)).take(order), np.asarray(toxic, np.float64)[order]
    level, prefixes, epochs = choose(own, toxic, seed)
    fit = _Fit(own, toxic, _Terms(own, toxic).told(level, prefixes), seed)
    for _ in range(epochs):
        fit.epoch()
    return fit.machine()


def _hashed(batches):
    terms = Terms()
    for batch in batches:
        found = [terms.of(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("toxic"), batch.column("order"), pa.array(found, pa.list_(pa.int32()))], ["id", "toxic", "order", "terms"])


def _trainable(rows: DataFrame) -> DataFrame:
    """The rows with those of their terms that can be trained; the counts are 2**BITS numbers at most."""
    counted = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_ROWS).toArrow()
    counts = np.zeros(1 << BITS, np.int32)
    counts[counted.column("term").to_numpy()] = counted.column("n").to_numpy()
    seen = rows.sparkSession.sparkContext.broadcast(counts)

    def kept(terms):
        terms = terms[seen.value[terms] > 0]
        if len(terms) > MOST_TERMS:
            terms = np.sort(terms[np.lexsort((terms, -seen.value[terms]))[:MOST_TERMS]])
        return terms

    def run(batches):
        for batch in batches:
            lists = batch.column("terms")
            found = pa.array([kept(np.asarray(t.values.to_numpy(zero_copy_only=False), np.int32)) for t in lists], pa.list_(pa.int32()))
            yield batch.set_column(batch.schema.get_field_index("terms"), "terms", found)

    return rows.mapInArrow(run, rows.schema)


def _in_order(got: pa.Table) -> tuple[Rows, np.ndarray]:
    """Rows and labels, by the hash of the text: the order in which rows arrive must not matter; the ids take no part."""
    order = pc.sort_indices(got.select(["order", "toxic"]), [("order", "ascending"), ("toxic", "ascending")]).to_numpy().astype(np.int64)
    lists = got.column("terms").combine_chunks()
    start = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return Rows(lists.flatten().to_numpy(zero_copy_only=False), start).take(order), got.column("toxic").to_numpy()[order].astype(np.float64)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> Machine:
    """A machine from at most `sample` labelled ids (doc_id, toxic) of the learning folds, one text of each."""
    chosen = (
        labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("toxic").isNotNull() & (fold(F.col("id")) != 0))
        .groupBy("id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("id"), "id").limit(sample)
    )
    own = docs.select(named(doc_id).alias("id"), named(text).alias("text"))
    known = own.join(F.broadcast(chosen), "id").select("id", "toxic", F.xxhash64("text").alias("order"), "text")  # at most `sample` rows are broadcast
    hashed = known.mapInArrow(_hashed, known.select("id", "toxic", "order", F.array().cast("array<int>").alias("terms")).schema)
    # a repeated id counts once, so that no more than `sample` rows are gathered
    rows = hashed.groupBy("id").agg(F.first("toxic").alias("toxic"), F.min(F.struct("order", "terms")).alias("least")).select("toxic", "least.order", "least.terms")
    return train(*_in_order(_trainable(staged(rows, "toxicity-sample")).toArrow()))


def _scored(rows: DataFrame, machine: Machine) -> DataFrame:
    """own and score of rows (own, text)."""
    model = rows.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        terms, m = Terms(), model.value
        for batch in batches:
            margins = np.array([m.margin(terms.of(t)) for t in batch.column("text").to_pylist()], np.float64)
            scores = 1 / (1 + np.exp(-np.clip(margins, -500, 500))) if m.fitted else np.zeros(len(margins))
            yield pa.RecordBatch.from_arrays([batch.column("own"), pa.array(scores, pa.float64())], ["own", "score"])

    return rows.mapInArrow(run, rows.select("own", F.lit(0.0).alias("score")).schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs (doc_id, text)."""
    scored = _scored(docs.select(F.struct("doc_id").alias("own"), "text"), fit(docs, labels, sample)).select("own.doc_id", "score")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that score under 0.5, columns as they were."""
    return unpacked(_scored(packed(docs, named("text").alias("text")), fit(docs, labels, sample)).where("score < 0.5"))
