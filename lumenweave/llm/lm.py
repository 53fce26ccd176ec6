"""Operator 6: language-model scoring with deleted interpolation.

The model mixes three maximum-likelihood estimates of a token w after v,
``a*c(v,w)/c(v) + b*c(w)/N + c/(V+1)``. The weights depend on the bucket of the context's
frequency, floor(log2(c(v)+1)), and are learned by expectation-maximisation on held-out
counts: one learning text in ``FOLDS`` is held out of the counts, the likelihood of its
tokens is maximised, and the final counts cover all learning texts.

Vocabulary: every learning word has its own counts of words and pairs; unseen words have
none. The ``VOCABULARY`` most frequent words are numbered in a table. It is broadcast, and so
are the counts of the pairs of the ``DENSE`` most frequent words and of other pairs that are
frequent enough to fill much of a range (at most ``HEAVY_PAIRS``): bounded whatever the corpus.
Pairs with a word outside it (the tail) are keyed by the words' hashes, counted and joined
with the word counts by shuffles; the results do not depend on the table's size.

Passes. (1) Word counts: per-block sums, then a partially aggregated count. (2) Pair
counts: sorted, packed arrays per block and key range; yields a histogram of held-out
events for EM, and the dense pairs. (3) Per document: tokens, base score over vocabulary
words, scores of dense pairs, and its rare words, which are joined with the word counts.
(4) The other pairs of each document, packed per key range; a range counts its pairs over
the learning texts, scores them and returns one sum per document, packed by document
bucket; the buckets add up the ranges' sums. (5) Only with more than ``VOCABULARY`` learning
words: tail pairs per document, their counts, and their sums per document.

Cases: null and empty texts are one end token; repeated rows (same id and text) are
counted as rows and get one result each, as do null ids and ids of several texts; without learning texts N = V = 0 and every
probability is that of the uniform estimate; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.llm import textops as X
from lumenweave.llm.common import crc_fold, discard, read, release, row_keys, stow

VOCABULARY = 1 << 20
DENSE = 2048
FOLDS = 16
BUCKETS = 48
#: Cells per doubling in the histogram of held-out events.
CELLS = 4
RANGE_TOKENS = 1_000_000
#: Pairs of the table that occur oftener than a share of a range are broadcast too: at most HEAVY_PAIRS of them.
HEAVY_SHARE, HEAVY_PAIRS = 1 / 16, 1 << 20
UNIT_BYTES = 2 << 20
END = np.uint64(0xE0D0E0D0E0D0E0D1)


@dataclass
class Vocabulary:
    words: np.ndarray  # sorted hashes
    rank: np.ndarray  # class of each: 0 is the most frequent
    count: np.ndarray  # by class, then the sum over all words without a class
    held: np.ndarray  # the part of ``count`` in held-out texts
    rare_types: int
    n: int
    v: int

    @property
    def rare(self) -> int:
        return len(self.words)

    def classes(self, h: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(h), np.int64)
        h, back = np.unique(h, return_inverse=True)  # sorted probes keep to the cache
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, self.rank[at], self.rare)[back]


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches with the token hashes of their texts (each followed by END) and tokens per row, UNIT_BYTES at a time."""
    for batch in batches:
        row, held = 0, []
        size = 0
        for first, data, offsets in X.string_blocks(batch.column("text")):
            h, counts = X.tokens(data, offsets)
            ends = np.cumsum(counts)
            held.append((np.insert(h, ends, END), counts + 1))
            size += len(data)
            if size >= UNIT_BYTES:
                n = first + len(counts)
                yield batch.slice(row, n - row), np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
                row, held, size = n, [], 0
                X.give_back()
        if held:
            yield batch.slice(row), np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            X.give_back()


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often each occurs."""
    key = np.sort(key)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    return key[first], np.diff(np.append(first, len(key)))


def _counted(key: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their occurrences, and those in held-out texts."""
    kinds, n = _runs(key)
    some, m = _runs(key[held])
    own = np.zeros(len(kinds), np.int64)
    own[np.searchsorted(kinds, some)] = m
    return kinds, n, own


def _sums(key: np.ndarray, *weights: np.ndarray) -> list[np.ndarray]:
    """Distinct keys and the sums of each weight."""
    key, at = np.unique(key, return_inverse=True)
    return [key, *(np.bincount(at, weights=w, minlength=len(key)).astype(np.int64) for w in weights)]


def word_counts(docs: DataFrame) -> DataFrame:
    """(w, n, held) over rows of docs (doc_id, text, learn, held)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, h, counts in _units(batches):
            held = np.repeat(batch.column("held").to_numpy(zero_copy_only=False), counts)
            key, n, m = _counted(h, held)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n), pa.array(m)], names=["w", "n", "held"])

    rows = docs.filter("learn").select("text", "held").mapInArrow(run, "w long, n long, held long")
    return rows.groupBy("w").agg(F.sum("n").alias("n"), F.sum("held").alias("held"))


def vocabulary(words: DataFrame, limit: int = VOCABULARY) -> Vocabulary:
    spread = sorted(((r["n"], r["types"], r["held"]) for r in words.groupBy("n").agg(F.count("*").alias("types"), F.sum("held").alias("held")).collect()), reverse=True)
    n, v = sum(c * t for c, t, _ in spread), sum(t for _, t, _ in spread)
    least, used = float("inf"), 0
    for c, types, _ in spread:
        if used + types > limit:
            break
        least, used = c, used + types
    top = words.filter(F.col("n") >= (least if used else 1 << 62)).toArrow()
    h, count, held = top["w"].to_numpy().view(np.uint64), top["n"].to_numpy(), top["held"].to_numpy()
    order = np.lexsort((h, -count))
    h, count, held = h[order], count[order], held[order]
    by_hash = np.argsort(h)
    all_held = sum(x for _, _, x in spread)
    return Vocabulary(h[by_hash], by_hash.astype(np.int64), np.append(count, n - count.sum()).astype(np.int64), np.append(held, all_held - held.sum()).astype(np.int64), v - used, n, v)


def _contexts(c: np.ndarray, counts: np.ndarray, end: int) -> np.ndarray:
    """Class of the token before each; a text begins after an end."""
    before = np.empty_like(c)
    before[1:] = c[:-1]
    before[(np.cumsum(counts) - counts)[counts > 0]] = end
    return before


def _planes(x: np.ndarray) -> bytes:
    """Little-endian int32 bytes, plane by plane, which the shuffle's codec packs well."""
    return np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplane(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<i4").ravel().astype(np.int64)


_SHIFT = np.int64(24)
_LOW = np.int64((1 << 24) - 1)


def _range_of(key: np.ndarray, ranges: int) -> np.ndarray:
    return (X.mix(key.view(np.uint64)) % np.uint64(ranges)).astype(np.int64)


def _split(part: np.ndarray, ranges: int) -> list[tuple[int, np.ndarray]]:
    """(range, its positions in order) of the ranges that occur."""
    order = np.argsort(part.astype(np.uint16 if ranges < 1 << 16 else np.int64), kind="stable")
    used, first = np.unique(part[order], return_index=True)
    return list(zip(used.tolist(), np.split(order, first[1:]), strict=True)) if len(used) else []


def _heavy_from(n: int) -> int:
    """Occurrences from which a pair is heavy."""
    return max(int(RANGE_TOKENS * HEAVY_SHARE), -(-n // HEAVY_PAIRS))


def _estimates(ctx: np.ndarray, word: np.ndarray, pair: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the context, and the bigram and unigram estimates, from counts of context, word and pair."""
    bucket = np.minimum(np.log2(ctx + 1).astype(np.int64), BUCKETS - 1)
    return bucket, pair / np.maximum(ctx, 1), word / max(n, 1)


def _cells(ctx: np.ndarray, word: np.ndarray, pair: np.ndarray, n: int, events: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Histogram of held-out events: cell, events, and the weighted sums of both log estimates."""
    bucket, q2, q1 = _estimates(ctx, word, pair, n)
    x = np.where(q2 > 0, np.log2(np.maximum(q2, 1e-300)), -999.0)
    y = np.where(q1 > 0, np.log2(np.maximum(q1, 1e-300)), -999.0)
    cell = (bucket * 8192 + np.round(x * CELLS).astype(np.int64) % 8192) * 8192 + np.round(y * CELLS).astype(np.int64) % 8192
    cell, at = np.unique(cell, return_inverse=True)
    wt = events.astype(float)
    return cell, *(np.bincount(at, weights=z, minlength=len(cell)).astype(float) for z in (wt, wt * x, wt * y))


def pair_statistics(docs: DataFrame, voc: Vocabulary, ranges: int) -> DataFrame:
    """Rows (kind, a, b, n, x, y): kind 0, a cell of held-out events; kind 1, the count of a dense or heavy pair."""
    shared, heavy_from = docs.sparkSession.sparkContext.broadcast(voc), _heavy_from(voc.n)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = shared.value
        end = int(voc.classes(np.array([END]))[0])
        for batch, h, counts in _units(batches):
            c = voc.classes(h)
            v = _contexts(c, counts, end)
            known = (v != voc.rare) & (c != voc.rare)  # the others are tail pairs
            held = np.repeat(batch.column("held").to_numpy(zero_copy_only=False), counts)
            key, n, m = _counted(((v << _SHIFT) | c)[known], held[known])
            part = _range_of(key, ranges)
            used = _split(part, ranges)
            blobs = [b"".join((_planes(np.diff(key[i] >> _SHIFT, prepend=0)), _planes(key[i] & _LOW), _planes(n[i]), _planes(m[i]))) for _, i in used]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in used], pa.int32()), pa.array(blobs, pa.binary())], names=["p", "blob"])

    def count(table: pa.Table) -> pa.Table:
        voc = shared.value
        parts = []
        for b in table["blob"].to_pylist():
            q = len(b) // 4
            dv, w, n, m = (_unplane(b[i * q : (i + 1) * q]) for i in range(4))
            parts.append(((np.cumsum(dv) << _SHIFT) | w, n, m))
        key, n, m = _sums(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        v, w = key >> _SHIFT, key & _LOW
        ev = m > 0
        train = voc.count - voc.held
        cell, total, mx, my = _cells(train[v[ev]], train[w[ev]], (n - m)[ev], int(train.sum()), m[ev])
        dense = (v < DENSE) & (w < DENSE) | (n >= heavy_from)
        k = dense.sum()
        return pa.table(
            {
                "kind": pa.array(np.repeat([0, 1], [len(cell), k]).astype(np.int32)),
                "a": pa.array(np.concatenate([cell, key[dense]])),
                "b": pa.array(np.concatenate([cell // (8192 * 8192), n[dense]])),
                "n": pa.array(np.concatenate([total, np.zeros(k)])),
                "x": pa.array(np.concatenate([mx, np.zeros(k)])),
                "y": pa.array(np.concatenate([my, np.zeros(k)])),
            }
        )

    packed = docs.filter("learn").select("text", "held").mapInArrow(pack, "p int, blob binary")
    rows = packed.groupBy("p").applyInArrow(count, "kind int, a long, b long, n double, x double, y double")
    return rows.groupBy("kind", "a", "b").agg(F.sum("n").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"))


def tail_pairs(docs: DataFrame, voc: Vocabulary) -> DataFrame:
    """(doc_id, learn, held, v, w, tail, m): each document's pairs with a word outside the table; tail: 1 v, 2 w, 3 both."""
    shared = docs.sparkSession.sparkContext.broadcast(voc)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = shared.value
        for batch, h, counts in _units(batches):
            c = voc.classes(h) == voc.rare
            v, row = _contexts(h, counts, END), np.repeat(np.arange(len(counts)), counts)
            tail = _contexts(c, counts, bool(voc.classes(np.array([END]))[0] == voc.rare)) + 2 * c.astype(np.int8)
            used = np.flatnonzero(tail)
            used = used[np.lexsort((h[used], v[used], row[used]))]
            new = np.ones(len(used), bool)
            new[1:] = (row[used][1:] != row[used][:-1]) | (v[used][1:] != v[used][:-1]) | (h[used][1:] != h[used][:-1])
            m = np.diff(np.append(np.flatnonzero(new), len(used)))
            used = used[new]
            at = pa.array(row[used])
            columns = [*(batch.column(k).take(at) for k in ("doc_id", "learn", "held")), pa.array(v[used].view(np.int64)), pa.array(h[used].view(np.int64)), pa.array(tail[used].astype(np.int32)), pa.array(m.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "learn", "held", "v", "w", "tail", "m"])

    return docs.select("doc_id", "text", "learn", "held").mapInArrow(run, "doc_id long, learn boolean, held boolean, v long, w long, tail int, m long")


def tail_counts(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """(v, w, n, held, v_n, v_held, w_n, w_held) of distinct tail pairs; counts of words in the table are null."""
    out = pairs.groupBy("v", "w", "tail").agg(F.sum(F.when(F.col("learn"), F.col("m")).otherwise(0)).alias("n"), F.sum(F.when(F.col("learn") & F.col("held"), F.col("m")).otherwise(0)).alias("held"))
    for side, bit in (("v", 1), ("w", 2)):
        # words of the table may be frequent: their rows are spread by a key that matches nothing of use
        own = F.col("tail").bitwiseAND(bit) != 0
        counts = words.select(F.col("w").alias("key"), F.col("n").alias(f"{side}_n"), F.col("held").alias(f"{side}_held"))
        out = out.withColumn("key", F.when(own, F.col(side)).otherwise(F.xxhash64("v", "w"))).join(counts, "key", "left").drop("key")
    return out.drop("tail")


def _tail_sides(voc: Vocabulary, batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """Occurrences of contexts and of words, and those in held-out texts."""
    out = []
    for side in ("v", "w"):
        c = voc.classes(batch.column(side).to_numpy().view(np.uint64))
        n, held = (batch.column(f"{side}_{k}").fill_null(0).to_numpy() for k in ("n", "held"))
        out.append((np.where(c == voc.rare, n, voc.count[c]), np.where(c == voc.rare, held, voc.held[c])))
    return out


def tail_cells(counted: DataFrame, voc: Vocabulary) -> DataFrame:
    """Rows of kind 0 as in ``pair_statistics``, of the tail pairs."""
    shared = counted.sparkSession.sparkContext.broadcast(voc)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = shared.value
        for batch in batches:
            (v, v_held), (w, w_held) = _tail_sides(voc, batch)
            n, m = batch.column("n").to_numpy(), batch.column("held").to_numpy()
            cell, total, mx, my = _cells(v - v_held, w - w_held, n - m, voc.n - int(voc.held.sum()), m)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(cell), np.int32)), pa.array(cell), pa.array(cell // (8192 * 8192)), pa.array(total), pa.array(mx), pa.array(my)], names=["kind", "a", "b", "n", "x", "y"])

    return counted.filter("held > 0").mapInArrow(run, "kind int, a long, b long, n double, x double, y double")


def tail_scores(counted: DataFrame, voc: Vocabulary, weights: np.ndarray) -> DataFrame:
    """(v, w, log_p) of the tail pairs."""
    shared = counted.sparkSession.sparkContext.broadcast((voc, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, weights = shared.value
        for batch in batches:
            (v, _), (w, _) = _tail_sides(voc, batch)
            log_p = _log_mix(voc, weights, v, w, batch.column("n").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("v"), batch.column("w"), pa.array(log_p)], names=["v", "w", "log_p"])

    return counted.mapInArrow(run, "v long, w long, log_p double")


def expectation_maximisation(bucket: np.ndarray, n: np.ndarray, log2_pair: np.ndarray, log2_word: np.ndarray, uniform: float, steps: int = 60) -> np.ndarray:
    """(BUCKETS, 3) weights of pair, word and uniform estimate; buckets without events take the nearest lower one's."""
    q = np.stack([np.where(log2_pair > -900, np.exp2(log2_pair), 0), np.where(log2_word > -900, np.exp2(log2_word), 0), np.full(len(n), uniform)], 1)
    weights = np.tile([0.4, 0.5, 0.1], (BUCKETS, 1))
    for _ in range(steps):
        r = weights[bucket] * q
        r *= (n / r.sum(1))[:, None]
        new = np.stack([np.bincount(bucket, weights=r[:, k], minlength=BUCKETS) for k in range(3)], 1)
        seen = new.sum(1) > 0
        weights[seen] = new[seen] / new[seen].sum(1, keepdims=True)
    last = np.array([0.0, 0.5, 0.5])
    for b in range(BUCKETS):
        if seen[b]:
            last = weights[b]
        weights[b] = np.maximum(last, 1e-6) / np.maximum(last, 1e-6).sum()
    return weights


def _log_mix(voc: Vocabulary, weights: np.ndarray, ctx: np.ndarray, word: np.ndarray, pair: np.ndarray) -> np.ndarray:
    bucket, q2, q1 = _estimates(ctx, word, pair, voc.n)
    k = weights[bucket]
    if not voc.n:
        return np.zeros(len(ctx))
    return np.log10(k[:, 0] * q2 + k[:, 1] * q1 + k[:, 2] / (voc.v + 1))


def _among(heavy: np.ndarray, key: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted ``heavy``, and the positions that have them, of those keys ``asked`` that are heavy."""
    asked = np.flatnonzero(asked)
    if not len(heavy):
        return asked[:0], asked[:0]
    at = np.minimum(np.searchsorted(heavy, key[asked]), len(heavy) - 1)
    hit = heavy[at] == key[asked]
    return at[hit], asked[hit]


def _log_p(voc: Vocabulary, weights: np.ndarray, v: np.ndarray, w: np.ndarray, pair: np.ndarray) -> np.ndarray:
    return _log_mix(voc, weights, voc.count[v], voc.count[w], pair)


def scores(docs: DataFrame, learn: str = "learn", limit: int = VOCABULARY) -> DataFrame:
    """docs: (doc_id, text, learn boolean). Adds n_tokens, n_known, train_tokens, base_score and score to doc_id and learn.

    ``limit``: words in the broadcast table; no result depends on it.
    """
    spark = docs.sparkSession
    keyed, clashes = row_keys(docs.select("doc_id", "text", F.col(learn).alias("learn")))
    docs = keyed.select(F.col("__key").alias("doc_id"), "text", "learn", (F.pmod(F.xxhash64("text"), F.lit(FOLDS)) == 0).alias("held")).fillna({"held": False})
    words = stow(word_counts(docs))
    voc = vocabulary(words, limit)
    release(spark)
    ranges = max(12, -(-voc.n // RANGE_TOKENS))
    stats = stow(pair_statistics(docs, voc, ranges))
    release(spark)
    cells = stats.filter("kind = 0")
    if voc.rare_types:
        tail = stow(tail_pairs(docs, voc))
        counted = stow(tail_counts(tail, words))
        release(spark)
        cells = cells.unionByName(tail_cells(counted, voc)).groupBy("kind", "a", "b").agg(F.sum("n").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"))
    cells = cells.toArrow()  # at most BUCKETS * cells per estimate squared
    n = cells["n"].to_numpy()
    weights = expectation_maximisation(cells["b"].to_numpy(), n, cells["x"].to_numpy() / n, cells["y"].to_numpy() / n, 1 / (voc.v + 1)) if len(n) else np.tile([1e-6, 0.5, 0.5], (BUCKETS, 1))
    pairs = stats.filter("kind = 1").select("a", "b").toArrow()  # at most DENSE squared + HEAVY_PAIRS
    dense = np.zeros((DENSE, DENSE), np.int64 if voc.n >= 1 << 31 else np.int32)
    key, n = pairs["a"].to_numpy(), pairs["b"].to_numpy()
    v, w = key >> _SHIFT, key & _LOW
    inside = (v < DENSE) & (w < DENSE)
    dense[v[inside], w[inside]] = n[inside]
    order = np.argsort(key[~inside])
    heavy, heavy_n = key[~inside][order], n[~inside][order]
    shared = spark.sparkContext.broadcast((voc, weights, dense, heavy, heavy_n))
    total = voc.n + 0.5 * (voc.v + 1)

    def per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, weights, dense, heavy, heavy_n = shared.value
        end = int(voc.classes(np.array([END]))[0])
        for batch, h, counts in _units(batches):
            c = voc.classes(h)
            v, row = _contexts(c, counts, end), np.repeat(np.arange(len(counts)), counts)
            known = c != voc.rare
            base = np.bincount(row[known], weights=np.log10((voc.count[c[known]] + 0.5) / total), minlength=len(counts)).astype(float)
            near = (v < min(DENSE, voc.rare)) & (c < min(DENSE, voc.rare))
            direct = np.bincount(row[near], weights=_log_p(voc, weights, v[near], c[near], dense[v[near], c[near]]), minlength=len(counts)).astype(float)
            at, often = _among(heavy, (v << _SHIFT) | c, ~near)
            direct += np.bincount(row[often], weights=_log_p(voc, weights, v[often], c[often], heavy_n[at]), minlength=len(counts))
            rare = ~known
            at, w, m = row[rare], h[rare].view(np.int64), None
            order = np.lexsort((w, at))
            at, w = at[order], w[order]
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1]) | (w[1:] != w[:-1])
            m = np.diff(np.append(np.flatnonzero(new), len(at))).astype(np.int32)
            at, w = at[new], w[new]
            offsets = pa.array(np.searchsorted(at, np.arange(len(counts) + 1)).astype(np.int32))
            words = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(w), pa.array(m)], ["w", "m"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("learn"), pa.array(counts), pa.array(np.bincount(row[known], minlength=len(counts))), pa.array(base), pa.array(direct), words],
                names=["doc_id", "learn", "n_tokens", "known", "base", "direct", "rare"],
            )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, _, _, heavy, _ = shared.value
        end, limit = int(voc.classes(np.array([END]))[0]), min(DENSE, voc.rare)
        for batch, h, counts in _units(batches):
            c = voc.classes(h)
            v, row = _contexts(c, counts, end), np.repeat(np.arange(len(counts)), counts)
            far = (v >= limit) | (c >= limit)
            if voc.rare_types:  # else words outside the table are unseen and have no counts
                far &= (v != voc.rare) & (c != voc.rare)
            far[_among(heavy, (v << _SHIFT) | c, far)[1]] = False
            bits = np.int64(max(1, len(counts).bit_length()))  # 45 bits of a pair and those of a batch's row fit one sort key
            both, m = _runs((((v[far] << _SHIFT) | c[far]) << bits) | row[far])
            key, row = both >> bits, both & ((np.int64(1) << bits) - 1)
            part = _range_of(key, ranges)
            ids, learn = batch.column("doc_id").to_numpy(), batch.column("learn").to_numpy(zero_copy_only=False)
            out: dict[str, list] = {"p": [], "ids": [], "learn": [], "blob": []}
            for p, i in _split(part, ranges):
                used, local = np.unique(row[i], return_inverse=True)
                out["p"].append(p)
                out["ids"].append(ids[used])
                out["learn"].append(np.packbits(learn[used]).tobytes())
                out["blob"].append(b"".join((_planes(np.diff(key[i] >> _SHIFT, prepend=0)), _planes(key[i] & _LOW), _planes(local), _planes(m[i]))))
            yield pa.RecordBatch.from_arrays([pa.array(out["p"], pa.int32()), pa.array(out["ids"], pa.list_(pa.int64())), pa.array(out["learn"], pa.binary()), pa.array(out["blob"], pa.binary())], names=list(out))

    def score_range(table: pa.Table) -> pa.Table:
        voc, weights, *_ = shared.value
        keys, docs_of, many, ids, learn, at = [], [], [], [], [], 0
        for i in range(table.num_rows):
            own, bits, b = table["ids"][i].values.to_numpy(), table["learn"][i].as_py(), table["blob"][i].as_py()
            q = len(b) // 4
            dv, w, local, m = (_unplane(b[i * q : (i + 1) * q]) for i in range(4))
            keys.append((np.cumsum(dv) << _SHIFT) | w)
            docs_of.append((local + at).astype(np.int32))
            many.append(m.astype(np.int32))
            ids.append(own)
            learn.append(np.unpackbits(np.frombuffer(bits, np.uint8))[: len(own)].astype(bool))
            at += len(own)
        key, doc, m, ids, learn = (np.concatenate(x) for x in (keys, docs_of, many, ids, learn))
        del keys, docs_of, many
        order = np.argsort(key)
        key, doc, m = key[order], doc[order], m[order]
        del order
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        seen = np.add.reduceat(np.where(learn[doc], m, 0), first)
        log_p = _log_p(voc, weights, key[first] >> _SHIFT, key[first] & _LOW, seen)
        part = np.bincount(doc, weights=m * np.repeat(log_p, np.diff(np.append(first, len(key)))), minlength=len(ids))
        ids, at = np.unique(ids, return_inverse=True)
        part = np.bincount(at, weights=part, minlength=len(ids))
        used = _split(_range_of(ids, ranges), ranges)
        return pa.table({"bucket": pa.array([k for k, _ in used], pa.int32()), "ids": pa.array([ids[i] for _, i in used], pa.list_(pa.int64())), "parts": pa.array([part[i] for _, i in used], pa.list_(pa.float64()))})

    def gather(table: pa.Table) -> pa.Table:
        ids, parts = (table[c].combine_chunks().flatten().to_numpy() for c in ("ids", "parts"))
        ids, at = np.unique(ids, return_inverse=True)
        return pa.table({"doc_id": ids, "far": np.bincount(at, weights=parts, minlength=len(ids))})

    rows = stow(docs.select("doc_id", "text", "learn").mapInArrow(per_document, "doc_id long, learn boolean, n_tokens long, known long, base double, direct double, rare array<struct<w: long, m: int>>"))
    release(spark)
    one = F.log10((F.coalesce("n", F.lit(0)) + 0.5) / total)
    rare = rows.select("doc_id", F.explode("rare").alias("r")).select("doc_id", "r.w", "r.m").join(words.select("w", "n"), "w", "left")
    rare = rare.groupBy("doc_id").agg(F.sum(F.col("m") * one).alias("rare_base"), F.sum(F.when(F.col("n").isNotNull(), F.col("m"))).alias("rare_known"))
    packed = docs.select("doc_id", "text", "learn").mapInArrow(pack, "p int, ids array<long>, learn binary, blob binary")
    far = packed.groupBy("p").applyInArrow(score_range, "bucket int, ids array<long>, parts array<double>").groupBy("bucket").applyInArrow(gather, "doc_id long, far double")
    if voc.rare_types:
        own = tail.join(tail_scores(counted, voc, weights), ["v", "w"]).select("doc_id", (F.col("m") * F.col("log_p")).alias("far"))
        far = far.unionByName(own).groupBy("doc_id").agg(F.sum("far").alias("far"))
    copies = rows.groupBy("doc_id").agg(F.count("*").alias("copies"))
    zero = F.lit(0.0)
    discard(stats)
    out = rows.join(copies, "doc_id").join(rare, "doc_id", "left").join(far, "doc_id", "left")
    if clashes:
        own = keyed.filter("__clash").select("__key", F.col("doc_id").alias("own")).distinct()
        out = out.join(own, F.col("doc_id") == F.col("__key"), "left").withColumn("doc_id", F.when(F.col("__key").isNull(), F.col("doc_id")).otherwise(F.col("own")))
    return out.select(
        "doc_id",
        "learn",
        "n_tokens",
        (F.col("known") + F.coalesce(F.col("rare_known") / F.col("copies"), F.lit(0)).cast("long")).alias("n_known"),
        F.lit(voc.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce(F.col("rare_base") / F.col("copies"), zero)).alias("base_score"),
        (F.col("direct") + F.coalesce(F.col("far") / F.col("copies"), zero)).alias("score"),
    )


def op6_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", (crc_fold("doc_id", 5) != 1).alias("learn"))
    return scores(docs).select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
