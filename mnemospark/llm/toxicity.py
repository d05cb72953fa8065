"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over word and word-start features is fitted with numpy from confirmed toxic
examples and unlabelled text.  The risk of the negative class cannot be read off unlabelled
text directly, since that holds toxic examples too; it is estimated as ``R_u(-) - p * R_p(-)``
with the class prior ``p``, kept from going negative: where it would, the step goes the other
way, which undoes the overfitting that made it so.

The part of the risk that unlabelled text has is that of all texts.  A few times the gradient is
summed over all of them, at the weights of that moment; the steps between take a sample's
gradient plus the difference of both sums there (variance-reduced steps), so that where they
come to rest is decided by all texts, and the sample decides only how far each step looks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, bounded, documents_of, raw_texts, small_batches, written

#: Weights of words are multiples of one over this.
UNIT = float(1 << 30)
#: What stands between words: anything but letters.
BETWEEN = r"[^\pL]+"
LOW = (1 << 31) - 1


def _valid(texts: pa.Array) -> pa.Array:
    """Texts with bytes that are no UTF-8 replaced; null as empty."""
    try:
        texts = texts.fill_null("")
        texts.validate(full=True)
        return texts
    except pa.ArrowInvalid:
        return pa.array([raw.decode("utf-8", "replace") for raw in raw_texts(texts)], pa.string())


def distinct_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The distinct words of each text: text numbers, word numbers, and the words.  A word is a
    run of letters, lower-cased."""
    lists = pc.split_pattern_regex(pc.utf8_lower(_valid(texts)), pattern=BETWEEN)
    flat = lists.flatten().dictionary_encode()
    words = flat.dictionary.to_pylist()
    pairs = np.repeat(np.arange(len(texts), dtype=np.int64) << 31, lists.value_lengths().to_numpy()) | flat.indices.to_numpy()
    pairs.sort()
    keep = np.concatenate(([True], pairs[1:] != pairs[:-1])) if len(pairs) else np.zeros(0, bool)
    if "" in words:
        keep &= (pairs & LOW) != words.index("")
    pairs = pairs[keep]
    return pairs >> 31, pairs & LOW, words


#: Odd multipliers of the hashes of word starts, modulo 2**64.
STEP, FINISH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def features_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """31-bit hashes of whole words (XXH32) and of their starts of 3 to 8 letters, word by word;
    how many each word has."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    length = np.fromiter(map(len, words), np.int64, n)
    letters = np.array(words, "U8").view(np.uint32).reshape(n, 8).astype(np.uint64)
    found = np.zeros((n, 7), np.int64)
    found[:, 0] = np.fromiter(map(xxhash.xxh32_intdigest, words), np.int64, n) >> 1
    state = np.zeros(n, np.uint64)
    for k in range(8):
        state = (state + letters[:, k] + np.uint64(1)) * STEP
        if k >= 2:
            found[:, k - 1] = ((state ^ (state >> np.uint64(29))) * FINISH >> np.uint64(33)).astype(np.int64)
    there = np.concatenate((np.ones((n, 1), bool), length[:, None] >= np.arange(3, 9)), axis=1)
    return found[there], there.sum(axis=1)


class Features:
    """Features of the texts of a batch; those of words are remembered up to a bound."""

    def __init__(self, remember: int = 200_000) -> None:
        self.remember = remember
        self.known: dict[str, int] = {}
        self.flat, self.ends = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _numbers(self, words: list[str]) -> np.ndarray:
        """The number of each word in the tables; new words are entered."""
        if len(self.known) > self.remember:
            self.__init__(self.remember)
        fresh = [w for w in words if w not in self.known]
        flat, sizes = features_of(fresh)
        self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
        self.flat = np.concatenate((self.flat, flat))
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(sizes)))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Each text's features, once for every distinct word that has them, as sorted
        ``text number << 31 | feature``; the number of distinct words of every text."""
        row, word, words = distinct_words(texts)
        number = self._numbers(words)[word]
        start, n = self.ends[number], self.ends[number + 1] - self.ends[number]
        inner = np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)
        both = (np.repeat(row, n) << 31) | self.flat[inner]
        both.sort()
        return both, np.bincount(row, minlength=len(texts))


@dataclass(frozen=True)
class Fit:
    """Settings.  ``most_positive`` bounds the labelled rows that are learned from; ``sampled`` are the
    unlabelled documents that steps look at between the ``passes`` over all of them; the model
    has the weights of ``most_features`` features."""

    most_positive: int = 2000
    sampled: int = 6000
    passes: int = 3
    most_features: int = 1024
    least_documents: int = 3
    steps: int = 400
    rate: float = 0.05
    decay: float = 0.03  # divided by the number of positives
    seed: str = "toxicity"


@dataclass(frozen=True)
class Model:
    weights: dict[int, float]
    size_weight: float
    bias: float

    def scorer(self, remember: int = 200_000):
        """Scores of a batch of texts, with the weights of words remembered up to a bound.

        Weights are rounded to multiples of 2**-30, so that sums are exact in any order and a
        text's score does not depend on its batch.
        """
        known: dict[str, float] = {}
        keys = np.array(sorted(self.weights), np.int64)
        values = np.append(np.array([self.weights[k] for k in keys.tolist()]), 0.0)

        def scores(texts: pa.Array) -> np.ndarray:
            row, word, words = distinct_words(texts)
            if len(known) > remember:
                known.clear()
            fresh = [w for w in words if w not in known]
            flat, sizes = features_of(fresh)
            at = np.searchsorted(keys, flat)
            at[np.append(keys, -1)[at] != flat] = len(keys)
            sums = np.bincount(np.repeat(np.arange(len(fresh)), sizes), weights=values[at], minlength=len(fresh))
            known.update(zip(fresh, np.rint(sums * UNIT).tolist(), strict=True))
            weight = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
            root = np.sqrt(np.bincount(row, minlength=len(texts)))
            sums = np.bincount(row, weights=weight[word], minlength=len(texts)) / UNIT
            return _sigmoid(self.bias + sums / np.maximum(root, 1) + self.size_weight * root)

        return scores


def learnable(doc_id: Column) -> Column:
    """Rows whose labels may be learned from: CRC32 of the id as text, modulo 4, is not 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(True))


def feature_counts(docs: DataFrame, confirmed: DataFrame) -> DataFrame:
    """``f``, ``p``, ``u``: in how many confirmed toxic documents, and in how many of all that may
    be learned from, a feature is; the feature -1 has the numbers of documents.

    One pass over all texts that may be learned from; a task sums over its batches before
    anything is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, held, size = Features(), [], 0

        def summed() -> pa.RecordBatch:
            f, at = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
            p, u = (np.bincount(at, weights=np.concatenate([x[k] for x in held])).astype(np.int64) for k in (1, 2))
            held[:] = [(f, p, u)]
            return pa.RecordBatch.from_arrays([pa.array(f), pa.array(p), pa.array(u)], names=["f", "p", "u"])

        for batch in small_batches(batches, "text", 1 << 20):
            toxic = batch.column(0).to_numpy(zero_copy_only=False)
            both, _ = features.of(batch.column(1))
            both = both[np.concatenate(([True], both[1:] != both[:-1]))] if len(both) else both
            f, u = np.unique(both & LOW, return_counts=True)
            marked = np.unique(both[toxic[both >> 31]] & LOW, return_counts=True) if toxic.any() else ([], [])
            p = np.zeros(len(f), np.int64)
            p[np.searchsorted(f, marked[0])] = marked[1]
            held.append((np.append(f, -1), np.append(p, toxic.sum()), np.append(u, len(toxic))))
            size += len(f)
            if size > 1_000_000:
                out = summed()
                size = out.num_rows
                if size > 500_000:
                    yield out
                    held.clear()
                    size = 0
        if held:
            yield summed()

    texts = documents_of(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("doc_id").isNotNull() & learnable(F.col("doc_id")))
    marked = texts.join(bounded(confirmed.select(F.col("doc_id").alias("c_id"))), F.col("doc_id") == F.col("c_id"), "left").select(F.col("c_id").isNotNull().alias("toxic"), "text")
    return marked.mapInArrow(run, "f long, p long, u long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))


def _vocabulary(counts: DataFrame, fit: Fit) -> np.ndarray:
    """The features whose document rates differ most between positive and unlabelled rows."""
    totals = counts.filter("f = -1").first()
    if totals is None:
        return np.zeros(0, np.int64)
    p, u = (F.col("p") + 0.5) / (totals.p + 1), (F.col("u") + 0.5) / (totals.u + 1)
    ranked = counts.filter((F.col("f") >= 0) & (F.col("p") >= fit.least_documents)).select("f", (F.abs(p - u) / F.sqrt(u * (1 - u))).alias("contrast"))
    best = ranked.orderBy(F.col("contrast").desc(), "f").limit(fit.most_features).select("f").toArrow()
    return np.sort(best.column("f").to_numpy())


ROWS = "doc_id long, words int, features array<int>, counts array<int>"


def _feature_rows(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """A row for each document that may be learned from: its distinct ``words``, and the
    ``features`` of the vocabulary that it has, by their place there, with their ``counts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in small_batches(batches, "text", 1 << 20):
            both, words = features.of(batch.column(1))
            both, count = np.unique(both[np.isin(both & LOW, vocabulary)], return_counts=True)
            row, feature = both >> 31, np.searchsorted(vocabulary, both & LOW)
            offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=batch.num_rows)))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (feature, count)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words.astype(np.int32)), *lists], names=["doc_id", "words", "features", "counts"])

    texts = documents_of(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("doc_id").isNotNull() & learnable(F.col("doc_id")))
    return texts.mapInArrow(run, ROWS)


def _sample(rows: DataFrame, ids: DataFrame) -> pa.Table:
    """The sampled documents' rows on the driver, with their ``kind``."""
    found = rows.join(F.broadcast(ids), "doc_id").select("kind", "doc_id", "words", "features", "counts").toArrow()  # as many ids as the sample's bound
    return found.sort_by([("kind", "ascending"), ("doc_id", "ascending"), ("words", "ascending")])


#: Sums over all texts are of multiples of one over this, so their order does not matter.
GRAIN = float(1 << 20)


def over_all(rows: DataFrame, size: int):
    """A function from weights to the mean loss of all unlabelled rows as negatives, and the mean
    of its gradient; each call is one pass over the stored rows, summed in the tasks."""

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size + 2, np.int64)
            for batch in batches:
                if batch.num_rows:
                    x = _Rows(pa.Table.from_batches([batch]))
                    b = x.margins(w)
                    sums = np.concatenate((x.gradient(_sigmoid(b), size), [_softplus(b).sum()]))
                    total += np.append(np.rint(sums * GRAIN).astype(np.int64), batch.num_rows)
            yield pa.record_batch({"i": pa.array(np.arange(size + 2), pa.int32()), "x": pa.array(total)})

        sums = rows.mapInArrow(run, "i int, x long").groupBy("i").agg(F.sum("x").alias("x")).collect()
        total = np.zeros(size + 2)
        for r in sums:
            total[r.i] = r.x
        n = max(total[-1], 1)
        return float(total[-2] / GRAIN / n), total[:-2] / GRAIN / n

    return at


class _Rows:
    """Sparse rows of counts over the square root of the number of words."""

    def __init__(self, table: pa.Table) -> None:
        words = table.column("words").to_numpy().astype(np.float64)
        features = table.column("features").combine_chunks()
        self.n = len(words)
        self.row = np.repeat(np.arange(self.n), features.value_lengths().to_numpy())
        self.key = features.flatten().to_numpy()
        self.root = np.sqrt(words)
        self.value = table.column("counts").combine_chunks().flatten().to_numpy() / np.maximum(self.root, 1)[self.row]

    def margins(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.key] * self.value, minlength=self.n) + self.root * w[-2] + w[-1]

    def gradient(self, g: np.ndarray, size: int) -> np.ndarray:
        out = np.bincount(self.key, weights=self.value * g[self.row], minlength=size)
        out[-2], out[-1] = self.root @ g, g.sum()
        return out


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Negatives:
    """The loss of unlabelled rows as negatives and its gradient: those of the sample, moved by what
    sums over all rows have told at an anchor."""

    def __init__(self, u: _Rows, size: int, whole=None) -> None:
        self.u, self.size, self.whole = u, size, whole
        self.anchor, self.shift, self.slope = np.zeros(size), 0.0, np.zeros(size)

    def _own(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        b = self.u.margins(w)
        return _softplus(b).mean(), self.u.gradient(_sigmoid(b) / self.u.n, self.size)

    def move(self, w: np.ndarray) -> None:
        if self.whole is not None:
            (loss, slope), (own, own_slope) = self.whole(w), self._own(w)
            self.anchor, self.shift, self.slope = w.copy(), loss - own, slope - own_slope

    def at(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        loss, slope = self._own(w)
        return loss + self.shift + self.slope @ (w - self.anchor), slope + self.slope


def risk(p: _Rows, u: Negatives, w: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the positive-unlabelled risk of the logistic loss at weights ``w``: that
    of positives, and the estimate of that of negatives, ``R_u(-) - prior * R_p(-)``."""
    a = p.margins(w)
    return prior * _softplus(-a).mean(), u.at(w)[0] - prior * _softplus(a).mean()


def step_of(p: _Rows, u: Negatives, w: np.ndarray, prior: float) -> np.ndarray:
    """The direction to leave ``w``: the gradient of both parts of the risk, or, where the
    negative part is below zero, minus the gradient of that part."""
    a, size = p.margins(w), len(w)
    loss, slope = u.at(w)
    of_negative = slope - p.gradient(prior * _sigmoid(a) / p.n, size)
    if loss - prior * _softplus(a).mean() < 0:
        return -of_negative
    return p.gradient(-prior * _sigmoid(-a) / p.n, size) + of_negative


def train(positive: pa.Table, unlabelled: pa.Table, vocabulary: np.ndarray, prior: float, fit: Fit = Fit(), whole=None) -> Model:
    """Minimise the non-negative positive-unlabelled risk of the logistic loss with Adam.

    ``whole``: the function of :func:`over_all`, asked ``passes`` times; without it the unlabelled
    rows given are all there are.  Without positives, unlabelled rows or features the score is
    the prior for every text.
    """
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    constant = Model({}, 0.0, math.log(prior / (1 - prior)))
    if not positive.num_rows or not unlabelled.num_rows or not len(vocabulary):
        return constant
    size = len(vocabulary) + 2
    p, u = _Rows(positive), Negatives(_Rows(unlabelled), size, whole)
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    w[-1] = constant.bias
    for step in range(1, fit.steps + 1):
        if (step - 1) % -(-fit.steps // fit.passes) == 0:
            u.move(w)
        g = step_of(p, u, w, prior)
        g[:-1] += fit.decay / p.n * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - fit.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(dict(zip(vocabulary.tolist(), w[:-2].tolist(), strict=True)), float(w[-2]), float(w[-1]))


def fitted(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> Model:
    """Fit on rows whose labels may be learned from.

    The vocabulary comes from the rates of features in all confirmed toxic documents and in all
    texts that may be learned from; the class prior is the share of toxic among all labels.  The
    unlabelled risk is that of all these texts, whatever their label, of which a table of features
    is stored once.  Of documents confirmed toxic at most ``most_positive``, by a seeded hash, are
    learned from: a bound on labelled rows.
    """
    bound_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).filter(learnable(F.col("doc_id")))
    prior = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    order = [F.xxhash64("doc_id", F.lit(fit.seed)), F.col("doc_id")]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter(F.col("doc_id").isNotNull()).filter(learnable(F.col("doc_id")))
    confirmed = written(known.filter("toxic = 1").select("doc_id").distinct().join(texts.distinct(), "doc_id", "left_semi"), "confirmed", small=True)
    counts = written(feature_counts(docs, confirmed), "features", small=True)
    vocabulary = _vocabulary(counts, fit)
    rows = written(_feature_rows(docs, vocabulary), "feature_rows", per_core=2)
    positive = confirmed.orderBy(*order).limit(fit.most_positive).withColumn("kind", F.lit("p"))
    unlabelled = rows.select("doc_id").distinct().orderBy(*order).limit(fit.sampled).withColumn("kind", F.lit("u"))
    sample = _sample(rows, positive.union(unlabelled))
    kind = sample.column("kind").to_numpy(zero_copy_only=False) == "p"
    return train(sample.filter(pa.array(kind)), sample.filter(pa.array(~kind)), vocabulary, prior or 0.0, fit, over_all(rows.select("words", "features", "counts"), len(vocabulary) + 2))


def scored(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``doc_id``, ``sig``, ``score``, ``predicted`` of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in small_batches(batches, "text", 1 << 20):
            found = score(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=["doc_id", "sig", "score", "predicted"])

    return documents_of(docs).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, sig long, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, fit: Fit = Fit()) -> DataFrame:
    """Score every document for toxicity.

    Returns per input row ``doc_id``, ``held_out`` (its label is never learned), ``score`` from
    0 to 1 and ``predicted`` (1 from ``threshold``), and ``sig`` (hash of the text).  A score
    depends on the text alone.  Null and empty texts get the score of a text without words.  A
    null ``doc_id`` is not held out and has no label.  Repeated rows get equal scores.  Empty
    tables give no rows; without labels every score is the smallest prior.
    """
    rows = scored(docs, fitted(docs, labels, fit), threshold)
    return rows.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "score", "predicted", "sig")


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, fit: Fit = Fit()) -> DataFrame:
    """The documents scored below ``threshold``, with all their columns, whatever their names.

    Rows pass through the scoring as they are, so nothing is joined or shuffled; null and empty
    texts get the score of a text without words, repeated rows go or stay together, and an
    empty table gives no rows.
    """
    model = fitted(docs, labels, fit)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            for part in small_batches([batch], f"c{at}", 1 << 20):
                yield part.filter(pa.array(score(part.column(at).cast(pa.string())) < threshold))

    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # Spark reads names that go to Python as expressions
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
