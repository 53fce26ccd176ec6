"""Operator 10: toxicity by class-conditional Kneser-Ney language models.

``fit`` learns one model per class (toxic, ordinary) from a bounded sample of labelled
rows: at most ``per_class`` distinct texts of each class, of at most ``max_bytes`` each.
Both models have two orders of interpolated Kneser-Ney smoothing with one absolute
discount per class and order, estimated from its counts of counts (n1 / (n1 + 2 n2)):

- words: continuation counts (a word counts once for each different word before it) of the
  class, backed off to continuation counts shared by both classes;
- word pairs: pair counts of the class given the word before, backed off to the pairs of
  both classes together, so that a rare expression is judged alike by both classes.

Runs of ``COPIED`` words that occurred before in the sample are not counted again, so a
copied passage counts once however many texts hold it.

A text's features are the length-normalised log-likelihood ratios under either order, of
the whole text and of its most toxic passage of each length in ``WINDOWS``. Each of ``FOLDS``
parts of the sample is held out in turn, and its features come from models of the others; the
logistic calibration that turns features into a score from 0 to 1 is fitted to these, with the
ridge under which held-out texts are likeliest. The model used is the mean of these models, since
one of all parts would give unseen texts other features than those that calibrated it. The same is
done whatever the sample's size.

``score`` applies the model to every whole text. Labels, language, source and ids are no
inputs of a score.

Cases: null and empty texts score as a text without evidence (the calibration at zero
ratios); rows without label or text are not learned from; with one class missing every
score is 0.0; an empty table gives an empty result; repeated rows and further columns
pass through.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenweave.llm import textops as X
from lumenweave.llm.common import crc_fold, read, release

PER_CLASS = 1500
MAX_BYTES = 1 << 15
#: Lengths of the passages, in tokens, whose best ratio is a feature.
WINDOWS = (1, 4, 16)
COPIED = 8
THRESHOLD = 0.7
#: Parts of the sample that are held out in turn, and ridges of the calibration tried on what was held out.
FOLDS = 4
RIDGES = (0.01, 0.1, 1.0, 10.0)

#: ASCII characters other than letters and digits separate words; other scripts stay.
NOT_ALNUM = np.array([c < 0x30 or 0x39 < c < 0x41 or 0x5A < c < 0x61 or 0x7A < c < 0x80 for c in range(256)])


class Table:
    """Values of 64-bit keys: sorted keys with an index of their leading bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order].astype(np.float32)
        self._index()

    def __getstate__(self) -> tuple[np.ndarray, np.ndarray]:
        return self.keys, self.values  # the index is made again where it is needed

    def __setstate__(self, state: tuple[np.ndarray, np.ndarray]) -> None:
        self.keys, self.values = state
        self._index()

    def _index(self) -> None:
        keys = self.keys
        self.shift = np.uint64(64 - max(1, len(keys).bit_length()))
        heads = np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift
        self.starts = np.append(np.searchsorted(self.keys, heads), len(keys)).astype(np.int32)

    def get(self, keys: np.ndarray, default: float | np.ndarray = 0.0) -> np.ndarray:
        out = np.array(np.broadcast_to(np.asarray(default, float), len(keys)))
        head = (keys >> self.shift).astype(np.int64)
        at, stop, left = self.starts[head].astype(np.int64), self.starts[head + 1], np.arange(len(keys))
        while len(left):
            left = left[at[left] < stop[left]]
            hit = self.keys[at[left]] == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit]
            at[left] += 1
        return out


@dataclass
class Model:
    """Log-likelihood ratios of words, of word pairs and of contexts (for unseen pairs); ``weights``: logistic calibration."""

    words: Table
    pairs: Table
    contexts: Table
    weights: np.ndarray


def _before(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The token before each; 0 at the start of a text."""
    out = np.concatenate([np.zeros(1, np.uint64), h[:-1]])[: len(h)]
    out[(np.cumsum(counts) - counts)[counts > 0]] = 0
    return out


def _pairs(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return X.mix(before * X.SEQ[20] + h * X.SEQ[21])


def _tokens(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for row, data, offsets in X.string_blocks(texts):
        yield row, *X.tokens(data, offsets, NOT_ALNUM)


def ratios(model: Model, h: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Log-likelihood ratio of each token by words and by pairs. A word that neither class has seen is no evidence: 0."""
    before = _before(h, counts)
    by_word = model.words.get(h, np.nan)
    by_pair = model.pairs.get(_pairs(before, h), model.contexts.get(before))
    unseen = np.isnan(by_word)
    return [np.where(unseen, 0.0, by_word), np.where(unseen, 0.0, by_pair)]


def features(model: Model, h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per row and order: mean ratio of the whole text, and of the best window of each length; 0 without tokens."""
    ends = np.cumsum(counts)
    begins, full, out = ends - counts, counts > 0, []
    for llr in ratios(model, h, counts):
        sums = np.concatenate([[0.0], np.cumsum(llr)])
        out.append((sums[ends] - sums[begins]) / np.maximum(counts, 1))
        for size in WINDOWS:
            # windows at a row's end are shorter but are divided by the full length
            stop = np.minimum(np.arange(len(h)) + size, np.repeat(ends, counts))
            best = np.zeros(len(counts))
            if full.any():
                best[full] = np.maximum.reduceat((sums[stop] - sums[: len(h)]) / size, begins[full])
            out.append(best)
    return np.stack(out, 1)


def discount(counts: np.ndarray) -> float:
    """n1 / (n1 + 2 n2) of the counts of counts; one half where that is undefined."""
    n1, n2 = int((counts == 1).sum()), int((counts == 2).sum())
    return n1 / (n1 + 2 * n2) if n1 and n2 else 0.5


def _first_uses(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Tokens outside any run of COPIED tokens that occurred before."""
    runs, per_row = X.sequences(h, counts, COPIED)
    again = np.ones(len(runs), bool)
    again[np.unique(runs, return_index=True)[1]] = False
    begins = np.repeat(np.cumsum(counts) - counts, per_row) + np.arange(len(runs)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, begins[again], 1)
    np.add.at(cover, begins[again] + COPIED, -1)
    return np.cumsum(cover)[:-1] == 0


def _conditional(pair: np.ndarray, context: np.ndarray, every: np.ndarray, every_context: np.ndarray, backoff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interpolated estimates of pairs ``every`` from the occurrences ``pair``; also the contexts and what each leaves to the back-off."""
    kinds, first, n = np.unique(pair, return_index=True, return_counts=True)
    d = discount(n)
    contexts, at = np.unique(context[first], return_inverse=True)
    total = np.bincount(at, weights=n, minlength=len(contexts))
    left = d * np.bincount(at, minlength=len(contexts)) / np.maximum(total, 1)
    count = Table(kinds, n.astype(float)).get(every)
    return np.maximum(count - d, 0) / Table(contexts, total).get(every_context, 1.0) + Table(contexts, left).get(every_context, 1.0) * backoff, contexts, left


def _train(h: np.ndarray, counts: np.ndarray, y: np.ndarray) -> Model:
    """Token hashes of all texts, tokens per text and label of each text."""
    before, kept, label = _before(h, counts), _first_uses(h, counts), np.repeat(y, counts)
    h, before, label = h[kept], before[kept], label[kept]
    pair, words = _pairs(before, h), np.unique(h)
    word = np.searchsorted(words, h)

    def continuations(own: np.ndarray) -> np.ndarray:
        first = np.flatnonzero(own)[np.unique(pair[own], return_index=True)[1]]
        return np.bincount(word[first], minlength=len(words)).astype(float)

    shared = continuations(np.ones(len(h), bool)) + 0.5
    shared /= shared.sum() + 0.5  # half a count for everything unseen
    every, first = np.unique(pair, return_index=True)
    both, _, _ = _conditional(pair, before, every, before[first], shared[word[first]])
    log_word, log_pair, log_left = {}, {}, {}
    for c in (0, 1):
        own = label == c
        count = continuations(own)
        n, d = max(count.sum(), 1.0), discount(count)
        left = d * (count > 0).sum() / n if count.any() else 1.0
        # what the sizes of the classes alone say about a word that neither has seen is taken off
        log_word[c] = np.log(np.maximum(count - d, 0) / n + left * shared) - np.log(left)
        p, contexts, left = _conditional(pair[own], before[own], every, before[first], both)
        log_pair[c], log_left[c] = np.log(p), (contexts, np.log(left))
    contexts = np.unique(before)
    rest = Table(*log_left[1]).get(contexts) - Table(*log_left[0]).get(contexts)
    return Model(Table(words, log_word[1] - log_word[0]), Table(every, log_pair[1] - log_pair[0]), Table(contexts, rest), np.zeros(2 * (len(WINDOWS) + 1) + 1))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps with a small ridge; both classes weigh alike."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    b, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (y - p)) - penalty @ b
        b = b + np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, g)
    return b


def _ridge(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> float:
    """The ridge of RIDGES under which texts are likeliest by a calibration that didn't see them; both classes weigh alike."""
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))

    def likelihood(ridge: float) -> float:
        total = 0.0
        for k in range(FOLDS):
            own = fold == k
            b = _logistic(x[~own], y[~own], ridge)
            z = np.clip(x[own] @ b[:-1] + b[-1], -30, 30)
            total += float((weight[own] * (y[own] * z - np.logaddexp(0, z))).sum())
        return total

    return max(RIDGES, key=likelihood)


def _mean(models: list[Model], h: np.ndarray, counts: np.ndarray) -> Model:
    """One model whose ratios are the means of several's over all tokens of the sample; a word that one hasn't seen is no evidence there."""
    before = _before(h, counts)
    words, contexts = np.unique(h), np.unique(before)
    every, first = np.unique(_pairs(before, h), return_index=True)
    by_word, by_pair, rest = np.zeros(len(words)), np.zeros(len(every)), np.zeros(len(contexts))
    for m in models:
        own = m.words.get(words, np.nan)
        by_word += np.nan_to_num(own)
        pair = m.pairs.get(every, m.contexts.get(before[first]))
        by_pair += np.where(np.isnan(own)[np.searchsorted(words, h[first])], 0.0, pair)
        rest += m.contexts.get(contexts)
    n = max(1, len(models))
    return Model(Table(words, by_word / n), Table(every, by_pair / n), Table(contexts, rest / n), np.zeros(2 * (len(WINDOWS) + 1) + 1))


def _cross_fit(h: np.ndarray, counts: np.ndarray, y: np.ndarray) -> Model:
    """The mean of the models that each leave one fold out; its calibration sees each text's features by the one that left it out.

    A model of all texts would give unseen texts other features than those that calibrated it.
    """
    fold = np.zeros(len(y), np.int64)
    for c in (0, 1):
        fold[y == c] = np.arange((y == c).sum()) % FOLDS
    x = np.zeros((len(y), 2 * (len(WINDOWS) + 1)))


    def without(k: int) -> Model | None:
        own = np.repeat(fold == k, counts)
        # with a single text of a class, one fold leaves none of it: its texts then tell nothing apart
        if len(set(y[fold != k].tolist())) < 2:
            return None
        model = _train(h[~own], counts[fold != k], y[fold != k])
        x[fold == k] = features(model, h[own], counts[fold == k])
        return model

    with ThreadPoolExecutor(2) as pool:  # sorting and searching, which NumPy does outside the interpreter's lock
        models = [m for m in pool.map(without, range(FOLDS)) if m is not None]
    model = _mean(models, h, counts)
    model.weights = _logistic(x, y, _ridge(x, y, fold) if min((y == c).sum() for c in (0, 1)) >= FOLDS else max(RIDGES))
    return model


def fit(labelled: DataFrame, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES, text: str = "text", label: str = "toxic") -> Model | None:
    """Model from a DataFrame of text and 0/1 label. None when a class has no row."""
    rows = labelled.select(F.col(text).alias("text"), F.col(label).cast("int").alias("y")).filter(F.col("text").isNotNull() & F.col("y").isin(0, 1) & (F.octet_length("text") <= max_bytes))
    rows = rows.withColumn("o", F.xxhash64("text")).dropDuplicates(["o", "y"])
    picked = [rows.filter(F.col("y") == c).orderBy("o").limit(per_class) for c in (0, 1)]

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = list(batches)
        table = pa.Table.from_batches(some).sort_by([("y", "ascending"), ("o", "ascending")]) if some else None
        y = table["y"].to_numpy() if some else np.zeros(0)
        if len(set(y.tolist())) == 2:
            blocks = [(h, counts) for _, h, counts in _tokens(table["text"])]
            model = _cross_fit(np.concatenate([h for h, _ in blocks]), np.concatenate([n for _, n in blocks]), np.asarray(y))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])
        X.give_back()

    # the bounded sample is one task's work, which leaves the driver's memory alone
    release(labelled.sparkSession)
    found = picked[0].unionAll(picked[1]).repartition(1).mapInArrow(train, "model binary").collect()
    raw = found.pop()["model"] if found else None
    model = pickle.loads(raw) if raw else None
    del raw, found
    X.give_back()
    return model


def probability(model: Model | None, texts: pa.Array) -> np.ndarray:
    out = np.zeros(len(texts))
    if model is not None:
        for row, h, counts in _tokens(texts):
            z = features(model, h, counts) @ model.weights[:-1] + model.weights[-1]
            out[row : row + len(counts)] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    return out


def score(docs: DataFrame, model: Model | None, text: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with ``out``: double from 0 to 1. An existing column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by per_class * max_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [i for i, n in enumerate(batch.schema.names) if n != out]
            values = pa.array(probability(shared.value, batch.column(text)))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [values], names=[batch.schema.names[i] for i in keep] + [out])

    schema = T.StructType([f for f in docs.schema.fields if f.name != out] + [T.StructField(out, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def fit_from_tables(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model | None:
    """Learn from labelled rows of folds 0 and 2 of crc32(doc_id) mod 3."""
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic").filter(crc_fold("doc_id", 3) != 1)
    # the sample is chosen by ids and hashes, so that only its bounded rows move as texts
    keys = docs.select("doc_id", F.xxhash64("text").alias("o"), F.octet_length("text").alias("size")).filter(F.col("size") <= MAX_BYTES).join(labels, "doc_id")
    keys = keys.filter(F.col("toxic").isin(0, 1)).groupBy("o", "toxic").agg(F.min("doc_id").alias("doc_id"))
    few = [keys.filter(F.col("toxic") == c).orderBy("o").limit(PER_CLASS).select("doc_id", "toxic") for c in (0, 1)]
    return fit(docs.select("doc_id", "text").join(F.broadcast(few[0].unionAll(few[1])), "doc_id"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit_from_tables(spark, docs, sf_dir))
    return scored.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (crc_fold("doc_id", 3) == 1).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents that score THRESHOLD or more go. Columns of the caller keep their values, whatever their names."""
    out = "__toxicity"
    return score(docs, fit_from_tables(spark, docs, sf_dir), out=out).filter(F.col(out) < THRESHOLD).select(*docs.columns)
