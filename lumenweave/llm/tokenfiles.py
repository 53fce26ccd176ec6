"""Operator 12: token ids in binary files of Simple-8b words, written and read by Spark.

``write_ids`` encodes whole texts, appends ``end`` to each, and writes them in ascending order of
id. Texts are dealt by ranges of (id, hash of the text, place of the row), so that even a third of all
rows with one id splits; each task writes files of up to ``FILE_SEGMENTS`` segments through Spark's own
writer, whose commits survive lost executors and which reaches any file system. ``read_ids`` gives
the documents back with their places in the whole sequence; ``Segment`` decodes any part of one.

A file is a sequence of records, each ended by ``MARK``. All but the last are segments: magic, five
counts (documents, ids, words, escapes, blocks), the documents' ids (64 bits), whether each is set
(bytes, padded to 8), their starts within the segment, the blocks' first words and first escapes
(32 bits each), the words of ``simple8b`` and the escapes (padded to 8). The last is a directory: magic,
part, file within the part, documents and ids of the file, then the segments' lengths, and their
number. All integers are little-endian and stand at multiples of 8 from the beginning of their record.

Cases: a null text counts as empty, and an empty one has the end id alone; null ids come first; rows
of one id follow the hash of their text; repeated rows each have a place; an empty table gives no
documents; other columns are ignored; a very long text is one document of one segment.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenweave.llm import simple8b
from lumenweave.llm.common import read, remove, shared_dir, shuffle_partitions, small, stow
from lumenweave.llm.segments import as_bytes, byte_bpe, split
from lumenweave.llm.textops import give_back

#: Ends every record of a file; Spark's writer puts it there.
MARK = "LWS8BEND"
SEGMENT, DIRECTORY = b"LWS8BSEG", b"LWS8BDIR"
#: Ids after which a segment ends (with the document that reaches it), and segments of a file.
SEGMENT_IDS = 1 << 19
FILE_SEGMENTS = 16
#: Bytes of text that a worker encodes at once.
SLICE_BYTES = 8 << 20


@lru_cache(maxsize=2)
def vocabulary(path: str) -> str:
    """The tokenizer's file, read on the driver; workers get its content."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 8)


def pack_segment(doc_ids: list, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """A record of documents (ids may be None) with ``sizes`` token ids each, ``ids`` in turn."""
    words, escapes, first_word, first_escape = simple8b.pack(ids)
    counts = np.array([len(doc_ids), len(ids), len(words), len(escapes), len(first_word)], "<i8")
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype("<i8")
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    known = bytes(d is not None for d in doc_ids)
    body = [SEGMENT, counts.tobytes(), keys.tobytes(), _padded(known), starts.tobytes()]
    body += [_padded(first_word.astype("<u4").tobytes()), _padded(first_escape.astype("<u4").tobytes()), words.astype("<u8").tobytes(), _padded(escapes.astype("<u4").tobytes())]
    return b"".join(body)


class Segment:
    """A view of one record of documents."""

    def __init__(self, raw: memoryview) -> None:
        if bytes(raw[:8]) != SEGMENT:
            raise ValueError("not a segment")
        n_docs, self.n_ids, n_words, n_escapes, n_blocks = np.frombuffer(raw, "<i8", 5, 8).tolist()
        at = 48

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += -(-out.nbytes // 8) * 8
            return out

        keys, known = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [int(k) if ok else None for k, ok in zip(keys, known)]
        self.starts = take("<i8", n_docs)
        self.sizes = np.diff(np.append(self.starts, self.n_ids))
        self._first_word, self._first_escape = take("<u4", n_blocks), take("<u4", n_blocks)
        self._words, self._escapes = take("<u8", n_words), take("<u4", n_escapes)

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the segment; only the blocks that hold them are decoded."""
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        a, b = start // simple8b.BLOCK, -(-stop // simple8b.BLOCK)
        more = b < len(self._first_word)
        words = slice(int(self._first_word[a]), int(self._first_word[b]) if more else None)
        escapes = slice(int(self._first_escape[a]), int(self._first_escape[b]) if more else None)
        low = a * simple8b.BLOCK
        out = simple8b.unpack(self._words[words], self._escapes[escapes], self._first_word[a:b].astype(np.int64) - words.start, min(b * simple8b.BLOCK, self.n_ids) - low)
        return out[start - low : stop - low]


def _directory(part: int, file: int, docs: int, ids: int, lengths: list[int]) -> bytes:
    return DIRECTORY + np.array([part, file, docs, ids, *lengths, len(lengths)], "<i8").tobytes()


def open_file(raw: bytes) -> tuple[int, int, Iterator[Segment]]:
    """Part and number of a file, and its segments."""
    view, mark = memoryview(raw), len(MARK)
    n = int(np.frombuffer(raw, "<i8", 1, len(raw) - mark - 8)[0])
    at = len(raw) - mark - 8 * (n + 6)
    if bytes(view[at : at + 8]) != DIRECTORY:
        raise ValueError("not a file of token ids")
    numbers = np.frombuffer(raw, "<i8", n + 4, at + 8).tolist()
    ends = np.cumsum([0] + [x + mark for x in numbers[4:]]).tolist()
    return numbers[0], numbers[1], (Segment(view[a : b - mark]) for a, b in zip(ends, ends[1:]))


def _slices(texts: pa.Array) -> Iterator[slice]:
    """Runs of rows of about ``SLICE_BYTES``."""
    ends = np.cumsum(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False))
    row = 0
    while row < len(texts):
        stop = int(np.searchsorted(ends, (ends[row - 1] if row else 0) + SLICE_BYTES, side="right"))
        stop = max(stop, row + 1)
        yield slice(row, stop)
        row = stop


def _writer(spec: object, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, file = byte_bpe(spec.value), TaskContext.get().partitionId(), 0
        keys: list = []
        sizes: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        lengths: list[int] = []
        totals = [0, 0]

        def record(raw: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["record"])

        def segment() -> pa.RecordBatch:
            size, all_ids = np.concatenate(sizes), np.concatenate(ids)
            raw = pack_segment(keys, size, all_ids)
            totals[0] += len(keys)
            totals[1] += len(all_ids)
            lengths.append(len(raw))
            for x in (keys, sizes, ids):
                x.clear()
            return record(raw)

        def directory() -> pa.RecordBatch:
            nonlocal file
            out = record(_directory(part, file, *totals, lengths))
            file += 1
            totals[:] = 0, 0
            lengths.clear()
            return out

        held = 0
        for batch in batches:
            texts = as_bytes(batch.column(1))
            names = batch.column(0).to_pylist()
            for rows in _slices(texts):
                some = texts.slice(rows.start, rows.stop - rows.start)
                index, upto, distinct = split(some, whole=not coder.splits, fine=not coder.holds_added(some))
                coded = coder.encode(distinct)
                count = np.fromiter((len(c) // 4 for c in coded), np.int64, len(coded))
                many, known = count[index], np.frombuffer(b"".join(coded), "<i4")
                ends = np.cumsum(many)
                flat = known[np.repeat((np.cumsum(count) - count)[index] - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)]
                stops = np.concatenate([[0], ends])[upto]
                size = np.diff(stops, prepend=0)
                # ids of the documents in turn, each with the end id
                out = np.full(len(flat) + len(size), end, np.int64)
                here = np.ones(len(out), bool)
                here[stops + np.arange(len(stops))] = False
                out[here] = flat
                size, stops, base, row = size + 1, stops + np.arange(1, len(stops) + 1), 0, 0
                while row < len(size):
                    stop = min(int(np.searchsorted(stops, base + SEGMENT_IDS - held)) + 1, len(size))
                    keys += names[rows.start + row : rows.start + stop]
                    sizes.append(size[row:stop])
                    ids.append(out[base : stops[stop - 1]])
                    held += int(stops[stop - 1]) - base
                    base, row = int(stops[stop - 1]), stop
                    if held >= SEGMENT_IDS:
                        held = 0
                        yield segment()
                        if len(lengths) == FILE_SEGMENTS:
                            yield directory()
        if held:
            yield segment()
        if lengths:
            yield directory()
        give_back()

    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str, end: int = 0, id_col: str = "doc_id", text: str = "text") -> None:
    """Write the token ids of all texts of ``docs`` to files under ``path``."""
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(vocabulary(tokenizer))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumns({"__hash": F.xxhash64("text"), "__place": F.monotonically_increasing_id()})
    order = [F.asc_nulls_first("doc_id"), "__hash", "__place"]
    dealt = rows.repartitionByRange(max(1, shuffle_partitions(spark)), *order).sortWithinPartitions(*order)
    records = dealt.select("doc_id", "text").mapInArrow(_writer(spec, end), "record binary")
    # a record is bytes, not characters: the writer passes them on as they are
    records.select(F.col("record").cast("string")).write.option("lineSep", MARK).option("maxRecordsPerFile", FILE_SEGMENTS + 1).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).filter("length > 0").select("content")


def _reader(kinds: pa.Schema, values):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                part, file, found = open_file(content.as_buffer().to_pybytes())
                before = 0
                for s in found:
                    n = len(s.doc_ids)
                    columns = [[part] * n, [file] * n, s.doc_ids, s.starts + before, s.sizes, values(s)]
                    before += s.n_ids
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)

    return run


def _documents(spark: SparkSession, path: str, name: str, kind: pa.DataType, sql: str, values) -> DataFrame:
    schema = pa.schema([("part", pa.int64()), ("file", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), (name, kind)])
    return _files(spark, path).mapInArrow(_reader(schema, values), f"part long, file long, doc_id long, start long, n_tokens long, {name} {sql}")


def _offsets(found: DataFrame) -> DataFrame:
    """Ids before each file: a row for each file, whose number is that of files."""
    total = found.groupBy("part", "file").agg(F.sum("n_tokens").alias("ids"))
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    return total.select("part", "file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before"))


def _placed(found: DataFrame, offsets: DataFrame) -> DataFrame:
    return found.join(small(offsets), ["part", "file"]).withColumn("start", F.col("start") + F.col("before")).drop("part", "file", "before")


def _split_ids(s: Segment) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(s.starts, s.n_ids).astype(np.int32)), pa.array(s.ids().astype(np.int64)))


def _checksums(s: Segment) -> list[int]:
    raw = memoryview(s.ids().astype("<u4").tobytes())
    ends = 4 * np.append(s.starts, s.n_ids)
    return [zlib.crc32(raw[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Columns doc_id, start, n_tokens and ids (array<long>) of files that ``write_ids`` wrote."""
    found = _documents(spark, path, "ids", pa.list_(pa.int64()), "array<long>", _split_ids)
    sizes = _documents(spark, path, "none", pa.int8(), "byte", lambda s: np.zeros(len(s.doc_ids), np.int8))
    return _placed(found, _offsets(sizes))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """Columns doc_id, start, n_tokens and ids_crc32 of files that ``write_ids`` wrote, each read once."""
    found = stow(_documents(spark, path, "ids_crc32", pa.int64(), "long", _checksums))
    return _placed(found, _offsets(found))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    write_ids(docs, path, default_tokenizer())
    out = checksums(spark, path)
    remove(spark, path)
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")
