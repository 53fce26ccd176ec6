"""Operator 1: removal of repeated strings by a depth-limited radix sort of suffixes.

Texts are sequences of units, bytes or words (lower-cased A-Z, white space between), and a
threshold of so many units is given; everything below holds for both.

Suffixes are ordered by most-significant-digit passes, and only as deep as the threshold
of ``length`` units; after each pass a bucket of one suffix is dropped, and the groups that
are equal at full depth are exactly the repeated windows. A digit is a run of units, its
bucket the run's hash (64 bits where a pass only drops, 128 where it decides), so a pass
is a partially aggregated count and a join, without order inside a bucket.

To sort far fewer suffixes than units, windows are handled in bundles. Each window of
``length`` units has an anchor, the position of the least gram hash in its first half,
which depends on its units alone; equal windows have equal anchors at equal offsets. The
windows of an anchor are one bundle (about a fifth of ``length``), refined where needed:

1. first digit: the units behind an anchor that all its windows hold. Anchors whose
   digit is unique are dropped with all their windows (most of a corpus ends here).
2. whole bundle: the string that spans all windows of a bundle, if it occurs twice,
   decides all of them. Undecided bundles go on, each decided group sending one member.
3. the same two steps for blocks of ``BLOCK`` neighbouring offsets.
4. last digit: the windows of undecided blocks one by one.

Every step is exact (up to 128-bit hash collisions) at any group size: counts are
aggregated before they are shuffled, and nothing gathers a group in one task.

Cases: null and short texts have no windows; repeated rows (same id and text) are copies
of each other and lose the whole text if it is long enough; rows with null ids or with an
id that other texts have too are told apart by a hash of id and text; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.llm import textops as X
from lumenweave.llm.anchors import anchors, digests, gram, reach
from lumenweave.llm.common import apart, discard, once, read, release, row_keys, stow

LENGTH = 400
#: Words of a passage, the least over 50.
PASSAGE = 51
#: Offsets of a block: bytes, words.
BLOCK = {False: 14, True: 5}
#: Rows of a batch that a pass returns.
ROWS = 50_000
_SMALL, _BIG = pa.int32(), pa.int64()


class _Out:
    """Columns gathered until they fill a batch."""

    def __init__(self, **kinds: pa.DataType):
        self.kinds, self.parts, self.held = kinds, [], 0

    def add(self, **columns) -> Iterator[pa.RecordBatch]:
        self.parts.append(columns)
        self.held += len(columns["id"])
        if self.held >= ROWS:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            columns = [pa.array(np.concatenate([np.asarray(p[k]) for p in self.parts]), t) for k, t in self.kinds.items()]
            yield pa.RecordBatch.from_arrays(columns, names=list(self.kinds))
        self.parts, self.held = [], 0


def _h128(b: bytes) -> bytes:
    return xxhash.xxh3_128_digest(b)


def _longs(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    g = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return g[:, 0], g[:, 1]


def _unit_blocks(texts: pa.Array, words: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, units, offsets) of blocks of texts."""
    for row, data, offsets in X.string_blocks(texts):
        if words:
            h, counts = X.tokens(data, offsets)
            yield row, h, np.concatenate([[0], np.cumsum(counts)])
        else:
            yield row, data, offsets


def _listed_rows(batches: Iterator[pa.RecordBatch], words: bool) -> Iterator[tuple[int, memoryview, int, pa.StructArray]]:
    """(id, units as bytes, bytes per unit, todo) of each row of (id, body, todo)."""
    for batch in batches:
        ids, todo = batch.column("id").to_pylist(), batch.column("todo")
        for row, units, offsets in _unit_blocks(batch.column("body"), words):
            view, size = memoryview(np.ascontiguousarray(units).view(np.uint8)), units.itemsize
            for i in range(len(offsets) - 1):
                yield ids[row + i], view[offsets[i] * size : offsets[i + 1] * size], size, todo[row + i].values


def _first_digit(length: int, words: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(id=_BIG, pos=_SMALL, lo=_SMALL, hi=_SMALL, h=_BIG)
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for row, units, offsets in _unit_blocks(batch.column("body"), words):
                text, pos, lo, hi = anchors(units, offsets, length)
                if len(pos):
                    h = digests(units, pos, length - reach(length, gram(units)) + 1)
                    yield from out.add(id=ids[row + text], pos=pos - offsets[text], lo=lo, hi=hi, h=h)
        yield from out.rest()

    return run


def _bundles(length: int, words: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(id=_BIG, pos=_SMALL, lo=_SMALL, hi=_SMALL, h=_BIG, g1=_BIG, g2=_BIG)
        for doc, body, u, todo in _listed_rows(batches, words):
            pos, lo, hi, h = (todo.field(k).to_numpy() for k in ("pos", "lo", "hi", "h"))
            g1, g2 = _longs([_h128(b"%d,%d;" % (a, b) + body[(p - b) * u : (p - a + length) * u]) for p, a, b in zip(pos.tolist(), lo.tolist(), hi.tolist(), strict=True)])
            yield from out.add(id=np.full(len(pos), doc), pos=pos, lo=lo, hi=hi, h=h, g1=g1, g2=g2)
        yield from out.rest()

    return run


def _blocks(length: int, words: bool) -> Callable:
    block = BLOCK[words]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(id=_BIG, s0=_SMALL, s1=_SMALL, open=pa.bool_(), h=_BIG, g1=_BIG, g2=_BIG)
        for doc, body, u, todo in _listed_rows(batches, words):
            s0, s1, is_open, core, span = [], [], [], [], []
            for p, lo, hi, o in zip(*(todo.field(k).to_pylist() for k in ("pos", "lo", "hi", "open")), strict=True):
                for b in range(lo // block, hi // block + 1):
                    low, high = max(lo, b * block), min(hi, b * block + block - 1)
                    s0.append(p - high)
                    s1.append(p - low)
                    is_open.append(o)
                    # what all windows of the whole block hold
                    core.append(xxhash.xxh3_64_digest(b"%d;" % b + body[(p - b * block) * u : (p - (b + 1) * block + 1 + length) * u]))
                    span.append(_h128(b"%d,%d;" % (low, high) + body[(p - high) * u : (p - low + length) * u]))
            g1, g2 = _longs(span)
            yield from out.add(id=np.full(len(s0), doc), s0=s0, s1=s1, open=is_open, h=np.frombuffer(b"".join(core), np.int64), g1=g1, g2=g2)
        yield from out.rest()

    return run


def _windows(length: int, words: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(id=_BIG, s0=_SMALL, open=pa.bool_(), g1=_BIG, g2=_BIG)
        for doc, body, u, todo in _listed_rows(batches, words):
            s, is_open, full = [], [], []
            for a, b, o in zip(*(todo.field(k).to_pylist() for k in ("s0", "s1", "open")), strict=True):
                for x in range(a, b + 1):
                    s.append(x)
                    is_open.append(o)
                    full.append(_h128(body[x * u : (x + length) * u]))
            g1, g2 = _longs(full)
            yield from out.add(id=np.full(len(s), doc), s0=s, open=is_open, g1=g1, g2=g2)
        yield from out.rest()

    return run


def _repeated(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").select(*map(apart, key))


def _decide(rows: DataFrame, *place: str) -> DataFrame:
    """Adds ``done`` (the row's group has another member) and ``lead`` (it is the group's first)."""
    groups = rows.groupBy("g1", "g2").agg(F.count("*").alias("n"), F.min(F.struct("id", *place)).alias("lead")).filter("n > 1").drop("n")
    out = rows.join(groups.select(apart("g1"), apart("g2"), "lead"), ["g1", "g2"], "left")
    return out.withColumn("done", F.col("lead").isNotNull()).withColumn("lead", F.col("lead") == F.struct("id", *place)).drop("g1", "g2")


def _listed(rows: DataFrame, *columns: str) -> DataFrame:
    """One row per document; as long as the document at most."""
    return rows.groupBy("id").agg(F.collect_list(F.struct(*columns)).alias("todo"))


def _next(rows: DataFrame, own: Column) -> DataFrame:
    """Undecided rows (``own``), and the members that others may still equal."""
    hard = rows.filter(own).select("h").distinct()
    others = rows.filter(~own & (~F.col("done") | F.col("lead"))).join(hard, "h", "left_semi")
    return rows.filter(own).withColumn("open", F.lit(True)).unionByName(others.withColumn("open", F.lit(False)))


def _spans(body: DataFrame, length: int, words: bool) -> tuple[DataFrame, DataFrame]:
    """Of (id, body) with unique ids: (id, todo array<struct<s0, s1>>) start ranges of repeated windows, and a stowed (id, body, ..) of a superset of those rows."""
    spark = body.sparkSession
    # a word takes a byte and a separator at least
    long_enough = body.filter(F.octet_length("body") >= (2 * length - 1 if words else length))
    first = stow(long_enough.mapInArrow(_first_digit(length, words), "id long, pos int, lo int, hi int, h long"))
    kept = first.join(_repeated(first, "h"), "h", "left_semi")
    todo = stow(_listed(kept, "pos", "lo", "hi", "h"))
    discard(first)
    release(spark)
    sub = stow(long_enough.join(todo, "id"))
    discard(todo)
    release(spark)
    bundles = stow(_decide(sub.mapInArrow(_bundles(length, words), "id long, pos int, lo int, hi int, h long, g1 long, g2 long"), "pos"))
    release(spark)
    spans = bundles.filter("done").select("id", (F.col("pos") - F.col("hi")).alias("s0"), (F.col("pos") - F.col("lo")).alias("s1"))
    todo = _listed(_next(bundles, ~F.col("done")), "pos", "lo", "hi", "open")
    split = stow(sub.select("id", "body").join(todo, "id").mapInArrow(_blocks(length, words), "id long, s0 int, s1 int, open boolean, h long, g1 long, g2 long"))
    release(spark)
    blocks = stow(_decide(split.join(_repeated(split, "h"), "h", "left_semi"), "s0").withColumnRenamed("open", "wanted"))
    discard(split)
    spans = spans.unionByName(blocks.filter("done AND wanted").select("id", "s0", "s1"))
    todo = _listed(_next(blocks, ~F.col("done") & F.col("wanted")), "s0", "s1", "open")
    windows = stow(sub.select("id", "body").join(todo, "id").mapInArrow(_windows(length, words), "id long, s0 int, open boolean, g1 long, g2 long"))
    release(spark)
    hit = windows.filter("open").join(_repeated(windows, "g1", "g2"), ["g1", "g2"], "left_semi")
    out = stow(_listed(spans.unionByName(hit.select("id", "s0", F.col("s0").alias("s1"))), "s0", "s1"))
    discard(bundles, blocks, windows)
    release(spark)
    return out, sub


def _rows_of(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(keyed rows, one (id, body) for each key, keys of repeated rows if there can be any)."""
    keyed, clashes = row_keys(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), "id")
    body = once(keyed, clashes).select(F.col("__key").alias("id"), F.col("text").cast("binary").alias("body"))
    again = keyed.filter("__clash").groupBy("__key").count().filter("count > 1").select(F.col("__key").alias("id")) if clashes else None
    return keyed, body, again


def _with_whole(spans: DataFrame, again: DataFrame | None, body: DataFrame, units: Column, length: int) -> DataFrame:
    """Rows that occur more than once are one repeated run."""
    if again is None:
        return spans
    whole = body.join(again, "id", "left_semi").withColumn("n", units).filter(F.col("n") >= length)
    whole = whole.select("id", F.array(F.struct(F.lit(0).alias("s0"), (F.col("n") - length).cast("int").alias("s1"))).alias("todo"))
    return spans.join(whole, "id", "left_anti").unionByName(whole)


def repeated_words(docs: DataFrame, length: int = PASSAGE, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_repeated long): words of each row's text inside runs of ``length`` words that occur elsewhere too; rows without any are missing. For ``key`` see ``common.row_keys``."""
    _, body, again = _rows_of(docs, id_col, text)
    spans, sub = _spans(body, length, True)
    discard(sub)
    words = F.size(F.array_remove(F.split(F.col("body").cast("string"), r"[\x20\x09-\x0D]+"), ""))
    spans = _with_whole(spans, again, body, words, length)
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    stop = lambda s: (s["s1"] + length).cast("long")
    step = lambda a, s: F.struct((a["n"] + F.greatest(stop(s) - F.greatest(a["upto"], s["s0"].cast("long")), F.lit(0).cast("long"))).alias("n"), F.greatest(a["upto"], stop(s)).alias("upto"))
    return spans.select(F.col("id").alias("key"), F.aggregate(F.array_sort("todo"), zero, step, lambda a: a["n"]).alias("n_repeated"))


def strip_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts that lose bytes: (key, spans array<struct<start, stop>> of maximal removed runs, kept binary). For ``key`` see ``common.row_keys``."""
    _, body, again = _rows_of(docs, id_col, text)
    spans, sub = _spans(body, length, False)
    spans = _with_whole(spans, again, body, F.octet_length("body"), length)
    bodies = sub.select("id", "body") if again is None else body

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            runs, kept = [], []
            for at in range(batch.num_rows):
                todo = batch.column("todo")[at].values
                s0, s1 = todo.field("s0").to_numpy().astype(np.int64), todo.field("s1").to_numpy().astype(np.int64) + length
                order = np.argsort(s0, kind="stable")
                s0, upto = s0[order], np.maximum.accumulate(s1[order])
                new = np.concatenate([[True], s0[1:] > upto[:-1]])
                starts, stops = s0[new], upto[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(s0) - 1]])]
                data = batch.column("body")[at].as_buffer().to_pybytes()
                edges = np.concatenate([[0], np.stack([starts, stops], 1).ravel(), [len(data)]])
                kept.append(b"".join(data[a:b] for a, b in edges.reshape(-1, 2).tolist()))
                runs.append([{"start": a, "stop": b} for a, b in zip(starts.tolist(), stops.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(runs, span), pa.array(kept, pa.binary())], names=["key", "spans", "kept"])

    return bodies.join(spans, "id").mapInArrow(run, "key long, spans array<struct<start: long, stop: long>>, kept binary")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns from runs of LENGTH bytes, and n_repeated_words: words inside runs of PASSAGE words that occur elsewhere too."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    passages = repeated_words(docs)
    cleaned = strip_repeats(docs).select(
        "key",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"]).alias("removed"),
        F.size("spans").cast("long").alias("spans"),
        F.sha2("kept", 256).alias("sha"),
    )
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    whole = row_keys(docs)[0].select("doc_id", F.col("__key").alias("key"), F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("whole"))
    out = whole.join(cleaned, "key", "left").join(passages, "key", "left")
    n = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return out.select("doc_id", "n_bytes", n("removed").alias("n_removed"), n("spans").alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"), n("n_repeated").alias("n_repeated_words"))
