"""Operator 5: byte-level BPE encoding and decoding with a local rank file.

``encode`` adds the token ids of every whole text, ``decode`` adds the bytes that ids
stand for. The merges are the tiktoken library's. Long texts are cut only where no
match of the splitting pattern can cross: in front of white space that follows a letter,
digit or mark, since a match holds white space only at its beginning (or is all white
space). White-space runs too long for the library's back-tracking are split by the
``regex`` module and merged piece by piece, with the same result.

Cases: null texts count as empty; empty texts have no ids; repeated rows and further
columns pass through unchanged; an existing column named as an output is replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenweave.llm.common import read

#: Texts longer than this many characters are cut at safe boundaries.
CHUNK_CHARS = 1 << 16
#: Rows that a Python worker turns into ids or bytes at once.
SLICE_ROWS = 256
#: Longest white-space run given to the library's own splitter.
LONG_SPACE = 512
_SAFE = regex.compile(r"(?<=[0-9A-Za-z.,;:!?)])(?=[ \n\t])")
_SPACE_RUN = regex.compile(r"\s{%d,}" % LONG_SPACE)


@lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_chunks(text: str, limit: int = CHUNK_CHARS) -> Iterator[str]:
    """Cut ``text`` into parts of about ``limit`` characters that encode independently."""
    start = 0
    while len(text) - start > limit:
        hit = _SAFE.search(text, start + limit)
        if hit is None:
            break
        yield text[start : hit.start()]
        start = hit.start()
    yield text[start:]


def encode_text(enc: tiktoken.Encoding, pattern: str, text: str) -> np.ndarray:
    """Token ids of one text as the library gives them."""
    parts = []
    for chunk in safe_chunks(text):
        if _SPACE_RUN.search(chunk):
            ids: list[int] = []
            for m in regex.finditer(pattern, chunk):
                ids += enc._encode_single_piece(m.group()) if hasattr(enc, "_encode_single_piece") else enc.encode_ordinary(m.group())
            parts.append(np.array(ids, np.int32))
        else:
            parts.append(np.frombuffer(enc._core_bpe.encode_to_tiktoken_buffer(chunk, set()), np.uint32).astype(np.int32))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _with_column(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name != name] + [T.StructField(name, kind)])


def _replace(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    keep = [i for i, n in enumerate(batch.schema.names) if n != name]
    return pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [values], names=[batch.schema.names[i] for i in keep] + [name])


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch small enough that what a part expands to stays small."""
    for at in range(0, batch.num_rows, SLICE_ROWS):
        yield batch.slice(at, SLICE_ROWS)


def _encoder(ranks_path: str, pattern: str, text: str, out: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        for part in chain.from_iterable(map(_slices, batches)):
            ids = [encode_text(enc, pattern, t.as_py() or "") for t in part.column(text)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            yield _replace(part, out, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))))

    return run


def _decoder(ranks_path: str, pattern: str, ids: str, out: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        for part in chain.from_iterable(map(_slices, batches)):
            # one row's ids at a time become Python integers
            rows = (x.values.to_numpy().tolist() if x.is_valid else [] for x in part.column(ids))
            yield _replace(part, out, pa.array([enc.decode_bytes(x) for x in rows], pa.binary()))

    return run


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with ``out``: array<int> of the ids of column ``text``. Null: no ids."""
    return df.mapInArrow(_encoder(ranks_path, pattern, text, out), _with_column(df.schema, out, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``: the raw bytes that column ``ids`` stands for (not forced to be valid UTF-8)."""
    return df.mapInArrow(_decoder(ranks_path, pattern, ids, out), _with_column(df.schema, out, T.BinaryType()))


def round_trip(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encode``, then ``decode`` of its ids, in one Python worker; column ``text`` is not returned."""
    code, back = _encoder(ranks_path, pattern, text, ids), _decoder(ranks_path, pattern, ids, decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in back(code(batches)):
            yield batch.drop_columns([text])

    schema = _with_column(_with_column(df.schema, ids, T.ArrayType(T.IntegerType())), decoded, T.BinaryType())
    return df.mapInArrow(run, T.StructType([f for f in schema.fields if f.name != text]))


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def digest(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    coded = round_trip(docs.select("doc_id", "text"), ranks_path, pattern)
    return coded.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(read(spark, sf_dir, "documents"), *default_vocabulary())
