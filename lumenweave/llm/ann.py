"""Operator 7: approximate nearest neighbours by cross-polytope hashing.

Vectors are scaled to unit length, turned by pseudo-random rotations (three rounds of
random signs and a fast Hadamard transform) and hashed to the nearest signed axis. A
table's key is one or more such hashes, the last over fewer axes, so that the number of
buckets follows the number of rows and the expected bucket keeps its size. A query probes
the buckets of its best key combinations in every table (multiprobe). Candidates meet
their queries bucket by bucket; a bucket returns each query's best ``k``, scored exactly on
the original vectors in double precision, and the tables' answers merge by rank.

Equal vectors are one candidate that carries its ``k + 1`` smallest ids, which are all that
can appear in a result, so a vector copied into a third of all rows costs one row. Large
buckets are split into a grid of salted parts of about ``PART`` candidates and ``QUERY_PART``
queries. Queries that found fewer than ``k`` candidates are answered exactly, in blocks
against all rows.

Probes and bucket size follow the table at hand: ``SAMPLE`` queries are answered exactly, and
their true neighbours' keys tell how many probes find them. If the given setting finds fewer
than ``RECALL`` of them, the cheapest bucket size, probes and tables that reach it are used. What
reaches it always, and is the cheapest where vectors are few or have no structure, is one table of two
buckets that are both probed.

Nearness is the inner product, while hashing sees directions: where lengths differ, rows
are scaled by the greatest length M and get one more coordinate, sqrt(1 - |x|^2 / M^2)
(0 for queries), which makes the order of directions that of inner products.

Cases: null, zero or empty vectors, and those with null or non-finite components, or of
another dimension than most, take no part; ties go to the smaller id; repeated ids are
rows of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenweave.llm.common import cut, read, small, stow

NEIGHBOURS = 20
TABLES = 8
PROBES = 8
BUCKET = 512
PART = 4096
QUERY_PART = 4096
#: Lengths that differ by less are equal up to rounding.
SAME_LENGTH = 1e-6
QUERY_BLOCK = 4096
#: Queries whose exact answers choose the probes, and the share of neighbours to be found among them: 0.9 and a margin.
SAMPLE = 256
RECALL = 0.95
MOST_PROBES = 512
#: A probe's cost besides its candidates, in candidates.
PROBE_COST = 256
SEED = 97


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the last axis (a power of two), orthonormal."""
    n, h = x.shape[-1], 1
    while h < n:
        x = x.reshape(*x.shape[:-1][:1], -1, 2, h) if x.ndim == 2 else x
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


class Hasher:
    """Cross-polytope keys for ``tables`` tables of about ``buckets`` buckets each."""

    def __init__(self, dim: int, buckets: float, tables: int = TABLES, seed: int = SEED):
        self.size, self.tables = 1 << max(0, (dim - 1).bit_length()), tables
        self.axes, left = [], max(2.0, buckets)
        while left > 1.5 and len(self.axes) < 6:
            self.axes.append(int(min(self.size, max(1, round(left / 2)))))
            left /= 2 * self.axes[-1]
        rng = np.random.Generator(np.random.PCG64(seed))
        self.signs = rng.choice(np.array([-1.0, 1.0], np.float32), (tables, len(self.axes), 3, self.size))

    def rotated(self, x: np.ndarray, table: int, j: int) -> np.ndarray:
        y = np.zeros((len(x), self.size), np.float32)
        y[:, : x.shape[1]] = x
        for s in self.signs[table, j]:
            y = hadamard(y * s)
        return y[:, : self.axes[j]]

    def keys(self, x: np.ndarray, table: int) -> np.ndarray:
        key = np.zeros(len(x), np.int64)
        for j, m in enumerate(self.axes):
            y = self.rotated(x, table, j)
            at = np.abs(y).argmax(1)
            key = key * (2 * m) + at * 2 + (y[np.arange(len(y)), at] < 0)
        return key

    def probes(self, x: np.ndarray, table: int, n: int) -> np.ndarray:
        """(rows, up to n) keys in order of the loss against the best combination."""
        keys, loss = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1), np.float32)
        for j, m in enumerate(self.axes):
            y = self.rotated(x, table, j)
            y = np.stack([y, -y], 2).reshape(len(x), 2 * m)
            top = np.argsort(-y, 1, kind="stable")[:, : min(n, 2 * m)]
            best = np.take_along_axis(y, top, 1)
            cost = (best[:, :1] - best) ** 2
            keys = (keys[:, :, None] * (2 * m) + top[:, None, :]).reshape(len(x), -1)
            loss = (loss[:, :, None] + cost[:, None, :]).reshape(len(x), -1)
            keep = np.argsort(loss, 1, kind="stable")[:, :n]
            keys, loss = np.take_along_axis(keys, keep, 1), np.take_along_axis(loss, keep, 1)
        return keys


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def _unit(x: np.ndarray, longest: float | None = None, row: bool = True) -> np.ndarray:
    """Directions to hash; with ``longest``, those of the space with one more coordinate."""
    length = np.linalg.norm(x, axis=1, keepdims=True)
    if longest is None:
        return (x / length).astype(np.float32)
    if not row:
        return np.concatenate([x / length, np.zeros((len(x), 1))], 1).astype(np.float32)
    return np.concatenate([x / longest, np.sqrt(np.maximum(1 - (length / longest) ** 2, 0))], 1).astype(np.float32)


def _best(q: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices and exact scores of the ``k`` nearest of ``c``, ties kept generously by a small margin."""
    rough = q @ c.T
    k = min(k, len(c))
    top = np.argpartition(-rough, k - 1, axis=1)[:, :k] if k < len(c) else np.tile(np.arange(len(c)), (len(q), 1))
    exact = np.zeros(top.shape)
    for d in range(q.shape[1]):  # one order of addition for every vector, so equal vectors score alike
        exact += q[:, d : d + 1] * c[top, d]
    return top, exact


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    v = F.col(vector)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: x.cast("double")).alias("v")).filter("v IS NOT NULL AND size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(~bad & F.exists("v", lambda x: x != 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, id_col: str = "vec_id", vector: str = "embedding", tables: int = TABLES, probes: int = PROBES, bucket: int = BUCKET) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's nearest rows of ``vectors``, its own id excluded."""
    spark = vectors.sparkSession
    rows, asked = usable(vectors, id_col, vector), usable(queries, id_col, vector)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    dim = sizes[0]["d"]
    rows, asked = rows.filter(F.size("v") == dim), asked.filter(F.size("v") == dim)
    # distinct vectors with their smallest ids; min-k by a bounded aggregation
    h = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit("v"), "v").alias("h2")]
    numbered = rows.select("id", *h)
    few = Window.partitionBy("h1", "h2").orderBy("id")
    salted = Window.partitionBy("h1", "h2", F.pmod("id", F.lit(64))).orderBy("id")
    ids = numbered.withColumn("r", F.row_number().over(salted)).filter(F.col("r") <= k + 1).withColumn("r", F.row_number().over(few)).filter(F.col("r") <= k + 1)
    ids = cut(ids.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.min("id").alias("id")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    items = stow(rows.join(ids.select("id", "ids"), "id").dropDuplicates(["id"]).withColumn("norm", norm))
    asked = asked.select("id", "v", *h)
    questions = cut(asked.groupBy("h1", "h2").agg(F.min("id").alias("qid"), F.any_value("v").alias("v")))
    wanted = asked.select("id", "h1", "h2").join(questions.select("h1", "h2", "qid"), ["h1", "h2"]).select(F.col("id").alias("query_id"), "qid")
    n, low, high = items.agg(F.count("*"), F.min("norm"), F.max("norm")).first()
    if low is None:
        return spark.createDataFrame([], schema)
    longest = None if high <= low * (1 + SAME_LENGTH) else high
    space = dim + (longest is not None)
    setting = _setting(items, questions, k, dim, longest, n, tables, probes, bucket)
    asked = questions.select("qid", "v")
    found = stow(_hashed(items, asked, k, dim, longest, Hasher(space, n / setting[1], setting[2]), setting[0]))
    enough = found.groupBy("qid").agg(F.sum(F.size("ids")).alias("n")).filter(F.col("n") >= k + 1).select("qid")
    rest = cut(questions.select("qid", "v").join(enough, "qid", "left_anti"))
    found = found.join(rest.select("qid"), "qid", "left_anti").unionByName(_exact(items, rest, k, dim))
    answers = wanted.join(found, "qid").select("query_id", F.explode("ids").alias("vec_id"), "score").filter("vec_id != query_id").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _setting(items: DataFrame, questions: DataFrame, k: int, dim: int, longest: float | None, n: int, tables: int, probes: int, bucket: int) -> tuple[int, int, int]:
    """Probes, bucket size and tables that find RECALL of the sampled queries' neighbours: the given ones if they do, else the cheapest found.

    Where vectors have no structure at all, up to four times the tables are tried; the last resort is one
    table of two buckets, both probed.
    """
    sample = cut(questions.orderBy("h1", "h2").limit(SAMPLE).select("qid", "v"))
    truth = _exact(items, sample, k, dim).select("qid", F.get("ids", F.lit(0)).alias("id"))
    # at most SAMPLE * (k + 1) rows; a query's own vector is no neighbour to be found
    rows = items.join(F.broadcast(truth), "id").select("qid", F.col("v").alias("near")).join(F.broadcast(sample), "qid").filter("near != v").select("v", "near").toArrow()
    if not rows.num_rows:
        return probes, bucket, tables
    asked, at = np.unique(_matrix(rows["v"], dim), axis=0, return_inverse=True)
    asked, near, at = _unit(asked, longest, False), _unit(_matrix(rows["near"], dim), longest), at.ravel()
    space = near.shape[1]

    def needed(hasher: Hasher, most: int) -> np.ndarray:
        """Per neighbour, the probes that reach it in its best table; ``most`` + 1 if none does."""
        out = np.full(len(near), most + 1)
        for t in range(hasher.tables):
            keys = hasher.keys(near, t)
            tried = np.concatenate([hasher.probes(asked[i : i + 16], t, most) for i in range(0, len(asked), 16)])
            hit = tried[at] == keys[:, None]
            out = np.where(hit.any(1), np.minimum(out, hit.argmax(1) + 1), out)
        return out

    if (needed(Hasher(space, n / bucket, tables), probes) <= probes).mean() >= RECALL:
        return probes, bucket, tables
    best, least = (2, max(1, n // 2), 1), float(n + 2 * PROBE_COST)
    for many in (tables, 2 * tables, 4 * tables):
        for size in (bucket // 8, bucket // 2, bucket, bucket * 4, bucket * 16):
            if size * 2 > n:
                break
            found = np.sort(needed(Hasher(space, n / size, many), MOST_PROBES))
            p = int(found[int(np.ceil(RECALL * len(found))) - 1])
            cost = float(many * p * (size + PROBE_COST))
            if p <= MOST_PROBES and cost < least:
                best, least = (p, size, many), cost
        if best[2] == many:
            break
    return best


_FOUND = "qid long, ids array<long>, score double"


def _pack(qid: np.ndarray, ids: list, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(qid, pa.int64()), pa.array(ids, pa.list_(pa.int64())), pa.array(score, pa.float64())], names=["qid", "ids", "score"])


def _hashed(items: DataFrame, questions: DataFrame, k: int, dim: int, longest: float | None, hasher: Hasher, probes: int) -> DataFrame:
    rows = max(16, (1 << 19) // (probes * max(1, dim)))  # bounds the probed combinations held at once

    def place(probe: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows)):
                x = _unit(_matrix(batch.column("v"), dim), longest, not probe)
                keys = np.concatenate([hasher.probes(x, t, probes) if probe else hasher.keys(x, t)[:, None] for t in range(hasher.tables)], 1)
                ends = np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))], names=[*batch.schema.names, "keys"])

        return run

    width = int(min(probes, np.prod([2.0 * m for m in hasher.axes])))
    kept = stow(items.select("id", "ids", "v").mapInArrow(place(False), "id long, ids array<long>, v array<double>, keys array<long>"))
    probed = stow(questions.select("qid", "v").mapInArrow(place(True), "qid long, v array<double>, keys array<long>"))
    kept = kept.select("id", "ids", "v", F.posexplode("keys").alias("t", "key"))
    probed = probed.select("qid", "v", F.posexplode("keys").alias("t", "key")).withColumn("t", F.floor(F.col("t") / width).cast("int"))
    rows, asked = kept.groupBy("t", "key").agg(F.count("*").alias("n")), probed.groupBy("t", "key").agg(F.count("*").alias("q"))
    many = rows.join(asked, ["t", "key"]).filter((F.col("n") > PART) | (F.col("q") > QUERY_PART))
    large = cut(many.select("t", "key", F.ceil(F.col("n") / PART).cast("int").alias("parts"), F.ceil(F.col("q") / QUERY_PART).cast("int").alias("sides")))

    def dealt(df: DataFrame, name: str, own: str, over: str, other: str, others: str) -> DataFrame:
        """Each row in one part of its own kind and in all parts of the other kind."""
        df = df.join(small(large), ["t", "key"], "left").withColumn(own, F.coalesce(F.pmod(F.xxhash64(name), F.col(over)), F.lit(0)).cast("int"))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(others, F.lit(1)) - 1))).drop("parts", "sides")

    kept, probed = dealt(kept, "id", "part", "parts", "side", "sides"), dealt(probed, "qid", "side", "sides", "part", "parts")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([], pa.schema([("qid", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())]))
        c, ids, out = _matrix(left["v"], dim), left["ids"].combine_chunks(), []
        for at in range(0, right.num_rows, 1024):
            some = right.slice(at, 1024)
            top, score = _best(_matrix(some["v"], dim), c, k + 1)
            qid = np.repeat(some["qid"].to_numpy(), top.shape[1])
            out.append(pa.RecordBatch.from_arrays([pa.array(qid), ids.take(pa.array(top.ravel())), pa.array(score.ravel())], names=["qid", "ids", "score"]))
        return pa.Table.from_batches(out)

    on = ["t", "key", "part", "side"]
    pairs = kept.groupBy(*on).cogroup(probed.groupBy(*on)).applyInArrow(meet, _FOUND)
    pairs = pairs.withColumn("first", F.get("ids", F.lit(0))).dropDuplicates(["qid", "first"])
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "first")
    return pairs.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).select("qid", "ids", "score")


def _exact(items: DataFrame, questions: DataFrame, k: int, dim: int) -> DataFrame:
    """All rows against blocks of at most QUERY_BLOCK queries, each block broadcast."""
    spark, out = items.sparkSession, None
    blocks = -(-questions.count() // QUERY_BLOCK)
    for b in range(blocks):
        block = questions.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).toArrow()
        shared = spark.sparkContext.broadcast((block["qid"].to_numpy(), _matrix(block["v"], dim))) if block.num_rows else None
        if shared is None:
            continue

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qid, q = shared.value
            for batch in batches:
                if batch.num_rows:
                    top, score = _best(q, _matrix(batch.column("v"), dim), k + 1)
                    ids = batch.column("ids").take(pa.array(top.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, top.shape[1])), ids, pa.array(score.ravel())], names=["qid", "ids", "score"])

        some = items.select("ids", "v").mapInArrow(run, _FOUND)
        best = Window.partitionBy("qid").orderBy(F.desc("score"), F.get("ids", F.lit(0)))
        some = some.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).drop("r")
        out = some if out is None else out.unionAll(some)
    return out if out is not None else spark.createDataFrame([], _FOUND)


def op7_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.filter(F.col("vec_id") % 20 == 0))
