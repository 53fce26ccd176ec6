"""Operator 11: alignment of two tokenizers' tokens by segment deduplication.

A is a byte-level BPE of the tokenizers library over space + text, B a sentencepiece model over
the text (it puts the space in front itself). Texts split into segments in front of white-space runs,
where neither vocabulary can merge across (``Pair.splits`` verifies that on entries and settings;
where it fails, a whole text is one segment). Then:

1. Each block of texts (some MB) becomes its distinct segments and, per text, their numbers.
2. Blocks' segments meet in buckets by hash, where distinct ones are tokenised and aligned once
   (once for each ``SALT_BLOCKS`` blocks, so that a segment of all blocks fills no bucket).
3. Alignments go back to the blocks that asked, and texts are composed from them.
4. The blocks' counts of texts that hold an id pair linked are summed, and every text's links are
   looked up in the sums: broadcast while the distinct pairs are few, else joined to blocks.

A word that all texts hold is one entry of each block. Blocks and what is composed are tables in
the shared folder.

Token bytes: A's entries byte-level decoded; B's pieces in UTF-8 with U+2581 as a space and <0xHH> as
that byte. Places where tokens of both end cut them into groups; every A token of a group is linked
with every B token of it.

Cases: null and empty texts, and texts whose joined token bytes differ from space + text (a U+2581,
for one), have no tokens: zeros and an empty string; each row counts as a document, repeated rows and
null or shared ids included; a very long text is a block of its own; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.llm.common import discard, read, release, shuffle_partitions, small, stow
from lumenweave.llm.segments import ByteBpe, as_bytes, split
from lumenweave.llm.textops import give_back
from lumenweave.llm.tokenfiles import vocabulary

BLOCK_BYTES = 8 << 20
#: Distinct segments aligned at once, and link products of one step.
SOME_SEGMENTS, SOME_LINKS = 1 << 14, 1 << 22
#: Numbers of an alignment from here on take 32 bits; 16 else.
WIDE = (1 << 16) - 1
_META = "▁"


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol-buffer message (the public wire format)."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            yield tag >> 3, raw[at : at + size]
            at += size


class Pair:
    """Both tokenizers over segments of space + text."""

    def __init__(self, spec: str, model: bytes) -> None:
        import sentencepiece

        self.a = ByteBpe(spec, special=False)
        self._b = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self._b.get_piece_size()
        pieces = [self._b.id_to_piece(i) for i in range(n)]
        self._b_bytes = [bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace(_META, " ").encode() for i, p in enumerate(pieces)]
        self._b_lengths = np.array([len(x) for x in self._b_bytes], np.int64)
        self._space = self._b.piece_to_id(_META)
        # text rules of the model: field 3 of a model; of these 2 is a table of replacements, 3, 4 and 5 add a space in front, drop repeated ones and mark spaces
        rules = dict(_fields(next((v for k, v in _fields(model) if k == 3), b"")))
        plain = not rules.get(2) and rules.get(3, 1) == 1 and rules.get(4, 1) == 0 and rules.get(5, 1) == 1
        crosses = any(_META in p[1:].lstrip(_META) or (p.strip(_META) and p.endswith(_META)) for p in pieces)
        self.splits = self.a.splits and plain and not crosses and self._space != self._b.unk_id()

    def _encode_b(self, segments: list[bytes]) -> list[list[int]]:
        """The model adds the first space of a segment itself, except to nothing at all."""
        ids = self._b.encode([s[1:].decode(errors="replace") for s in segments], num_threads=1)
        return [[self._space] if s == b" " else x for s, x in zip(segments, ids)]

    def align(self, segments: list[bytes]) -> list[bytes | None]:
        """Each segment's alignment as ``Aligned`` reads it; None where token bytes differ from the segment."""
        a_raw, b_ids = self.a.encode(segments, memo=False), self._encode_b(segments)
        n_a, n_b = np.array([len(x) // 4 for x in a_raw], np.int64), np.array([len(x) for x in b_ids], np.int64)
        a, b = np.frombuffer(b"".join(a_raw), "<i4").astype(np.int64), np.fromiter(chain.from_iterable(b_ids), np.int64, int(n_b.sum()))
        size = np.array([len(x) for x in segments], np.int64)
        a_end, b_end, stop = np.cumsum(self.a.lengths[a]), np.cumsum(self._b_lengths[b]), np.cumsum(size)
        fits = all(np.array_equal(np.append(0, ends)[np.cumsum(n)], stop) for ends, n in ((a_end, n_a), (b_end, n_b)))
        joined = b"".join(segments)
        if not fits or b"".join([self.a.bytes[i] for i in a.tolist()]) != joined or b"".join([self._b_bytes[i] for i in b.tolist()]) != joined:
            if len(segments) == 1:
                return [None]
            half = len(segments) // 2
            return self.align(segments[:half]) + self.align(segments[half:])
        both = np.intersect1d(a_end, b_end, assume_unique=True)
        of = np.searchsorted(stop, both)
        a_many, b_many = (np.diff(np.searchsorted(ends, both, side="right"), prepend=0) for ends in (a_end, b_end))
        n_groups = np.bincount(of, minlength=len(segments))
        # one row of numbers a segment: groups, A tokens of each, B tokens of each, A ids, B ids
        parts = [(np.arange(len(segments)), n_groups), (of, a_many), (of, b_many), (np.repeat(np.arange(len(segments)), n_a), a), (np.repeat(np.arange(len(segments)), n_b), b)]
        owner, values = (np.concatenate([x[k] for x in parts]) for k in (0, 1))
        order = np.argsort(owner, kind="stable")
        values, cuts = values[order], np.cumsum(1 + 2 * n_groups + n_a + n_b).tolist()
        if len(values) and values.max() >= WIDE:
            rows = [values[p:q] for p, q in zip([0, *cuts], cuts)]
            return [x.astype("<u2").tobytes() if x.max() < WIDE else b"\xff\xff" + x.astype("<u4").tobytes() for x in rows]
        raw = values.astype("<u2").tobytes()
        return [raw[2 * p : 2 * q] for p, q in zip([0, *cuts], cuts)]


def _numbers(record: bytes) -> np.ndarray:
    return np.frombuffer(record, "<u4", offset=2) if record[:2] == b"\xff\xff" else np.frombuffer(record, "<u2")


class Aligned:
    """Alignments of several segments at once: ``a`` and ``b`` ids, the group of each, and each group's segment (``of``)."""

    def __init__(self, records: list[bytes]) -> None:
        n = len(records)
        if any(r[:2] == b"\xff\xff" for r in records):
            rows = [_numbers(r) for r in records]
            size, w = np.array([len(r) for r in rows], np.int64), np.concatenate(rows).astype(np.int64)
        else:
            size, w = np.array([len(r) // 2 for r in records], np.int64), np.frombuffer(b"".join(records), "<u2").astype(np.int64)
        start = np.cumsum(size) - size
        self.n_groups = w[start] if n else np.zeros(0, np.int64)
        self.of = np.repeat(np.arange(n), self.n_groups)
        inner = np.arange(len(self.of)) - np.repeat(np.cumsum(self.n_groups) - self.n_groups, self.n_groups)
        a_many = w[start[self.of] + 1 + inner]
        b_many = w[start[self.of] + 1 + self.n_groups[self.of] + inner]
        self.n_a, self.n_b = (np.bincount(self.of, x, n).astype(np.int64) for x in (a_many, b_many))
        take = lambda first, many: w[np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
        at = start + 1 + 2 * self.n_groups
        self.a, self.b = take(at, self.n_a), take(at + self.n_a, self.n_b)
        self.a_group, self.b_group = np.repeat(np.arange(len(self.of)), a_many), np.repeat(np.arange(len(self.of)), b_many)

    def texts(self) -> list[str]:
        """``a1,a2|b1;..`` of each segment."""
        a, b = (list(map(str, x.tolist())) for x in (self.a, self.b))
        edges = np.arange(len(self.of) + 1)
        p, r = np.searchsorted(self.a_group, edges).tolist(), np.searchsorted(self.b_group, edges).tolist()
        groups = [f"{a[i]}|{b[j]}" if k - i == 1 == m - j else f"{','.join(a[i:k])}|{','.join(b[j:m])}" for i, k, j, m in zip(p, p[1:], r, r[1:])]
        ends = np.concatenate([[0], np.cumsum(self.n_groups)]).tolist()
        return [";".join(groups[i:k]) for i, k in zip(ends, ends[1:])]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Linked pairs (A id << 32 | B id) of each segment in turn, how often each, and the pairs of each segment."""
        of, n = self.of, len(self.n_groups)

        def counted(ids: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            key, often = np.unique((group << 20) | ids, return_counts=True)
            return key & ((1 << 20) - 1), often, np.searchsorted(key, np.arange(len(of) + 1) << 20)

        a_id, a_often, a_at = counted(self.a, self.a_group)
        b_id, b_often, b_at = counted(self.b, self.b_group)
        each = np.diff(a_at) * np.diff(b_at)
        parts, first, done = [], 0, np.cumsum(each)
        while first < len(of):
            # whole segments' groups, up to so many products
            stop = max(int(np.searchsorted(done, (done[first - 1] if first else 0) + SOME_LINKS, side="right")), first + 1)
            stop = int(np.searchsorted(of, of[stop - 1], side="right"))
            g = np.repeat(np.arange(first, stop), each[first:stop])
            k = np.arange(len(g)) - np.repeat(done[first:stop] - each[first:stop] - (done[first - 1] if first else 0), each[first:stop])
            wide = (b_at[1:] - b_at[:-1])[g]
            x, y = a_at[g] + k // wide, b_at[g] + k % wide
            own, pair, many = of[g], (a_id[x] << 32) | b_id[y], a_often[x] * b_often[y]
            order = np.lexsort((pair, own))
            own, pair, many = own[order], pair[order], many[order]
            new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (pair[1:] != pair[:-1])])) if len(own) else np.zeros(0, np.int64)
            parts.append((own[new], pair[new], np.add.reduceat(many, new) if len(new) else many))
            first = stop
        own, pair, many = (np.concatenate(x) if parts else np.zeros(0, np.int64) for x in (zip(*parts) if parts else [()] * 3))
        return pair.astype(np.int64), many.astype(np.int64), np.bincount(own.astype(np.int64), minlength=n)


@lru_cache(maxsize=1)
def _pair(spec: str, model: bytes) -> Pair:
    return Pair(spec, model)


@lru_cache(maxsize=2)
def model_bytes(path: str) -> bytes:
    """The model's file, read on the driver; workers get its content."""
    with open(path, "rb") as f:
        return f.read()


def _squeeze(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays (32-bit integers) or bytes as one compressed value."""
    parts = [x if isinstance(x, bytes) else np.asarray(x).astype("<i4").tobytes() for x in arrays]
    raw = np.array([len(parts), *map(len, parts)], "<i8").tobytes() + b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unsqueeze(value: bytes) -> list[bytes]:
    raw = pa.decompress(value[8:], int.from_bytes(value[:8], "little"), "zstd", asbytes=True)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    ends = 8 * (n + 1) + np.cumsum([0, *np.frombuffer(raw, "<i8", n, 8)])
    return [raw[p:q] for p, q in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _ints(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i4").astype(np.int64)


def _listed(numbers: np.ndarray, items: list[bytes]) -> bytes:
    """Ascending numbers and a value of each."""
    return _squeeze(np.diff(numbers, prepend=0), np.array([len(x) for x in items]), b"".join(items))


def _unlisted(value: bytes) -> tuple[np.ndarray, list[bytes]]:
    steps, sizes, body = _unsqueeze(value)
    ends = np.concatenate([[0], np.cumsum(_ints(sizes))]).tolist()
    return np.cumsum(_ints(steps)), [body[p:q] for p, q in zip(ends, ends[1:])]


_BLOCKS = "block long, doc_ids array<long>, texts binary, segments binary, n int"


def _blocks(files: object):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, block = not _pair(*files.value).splits, TaskContext.get().partitionId() << 32
        ids: list = []
        held: list[pa.Array] = []
        size = 0

        def out() -> pa.RecordBatch:
            nonlocal block
            numbers, upto, segments = split(pa.concat_arrays(held), whole)
            values = [[block], [list(ids)], [_squeeze(upto, numbers)], [_listed(np.arange(len(segments)), segments)], [len(segments)]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int32()]
            block += 1
            ids.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["block", "doc_ids", "texts", "segments", "n"])

        for batch in batches:
            texts = as_bytes(batch.column(1), " ")
            lengths = pa.compute.binary_length(texts).to_numpy(zero_copy_only=False)
            names, row = batch.column(0).to_pylist(), 0
            while row < len(texts):
                ends = size + np.cumsum(lengths[row:])
                stop = row + min(int(np.searchsorted(ends, BLOCK_BYTES)) + 1, len(ends))
                held.append(texts.slice(row, stop - row))
                ids += names[row:stop]
                size, row = int(ends[stop - row - 1]), stop
                if size >= BLOCK_BYTES:
                    yield out()
                    size = 0
        if ids:
            yield out()
        give_back()

    return run


_ASKED = "bucket int, salt int, block long, asked binary"


def _asker(buckets: int, salts: int):
    """Each block's segments, dealt to buckets by a hash of the segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                _, segments = _unlisted(value)
                of = np.fromiter(map(zlib.crc32, segments), np.int64, len(segments)) % buckets
                order = np.argsort(of, kind="stable")
                used, starts = np.unique(of[order], return_index=True)
                rows = [_listed(some, [segments[i] for i in some.tolist()]) for some in np.split(order, starts[1:])] if len(order) else []
                columns = [used, np.full(len(used), block % salts), np.full(len(used), block), rows]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["bucket", "salt", "block", "asked"])

    return run


def _answerer(files: object):
    """A bucket's distinct segments aligned once; each block gets its own back (empty where token bytes differ)."""

    def run(asked: pa.Table) -> pa.Table:
        pair = _pair(*files.value)
        known: dict[bytes, bytes | None] = {}
        for value in asked.column("asked"):
            known.update(dict.fromkeys(_unlisted(value.as_py())[1]))
        distinct = list(known)
        for at in range(0, len(distinct), SOME_SEGMENTS):
            some = distinct[at : at + SOME_SEGMENTS]
            known.update(zip(some, pair.align(some)))
        answers = []
        for value in asked.column("asked"):
            numbers, segments = _unlisted(value.as_py())
            answers.append(_listed(numbers, [known[s] or b"" for s in segments]))
        return pa.Table.from_arrays([asked.column("block"), pa.array(answers, pa.binary())], ["of", "answer"])

    return run


_COMPOSED = "block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, groups_sha256 array<string>, links binary, pairs array<long>, holders array<long>"


def _compose(blocks: pa.Table, answers: pa.Table) -> pa.Table:
    """One block's texts from the alignments of its segments: their counts, hashes and links by numbers of the block's distinct pairs."""
    block, ids = blocks.column("block")[0].as_py(), blocks.column("doc_ids")[0].as_py()
    upto, numbers = map(_ints, _unsqueeze(blocks.column("texts")[0].as_py()))
    n_docs = len(ids)
    records: list[bytes] = [b""] * blocks.column("n")[0].as_py()
    for value in answers.column("answer"):
        for i, record in zip(*_unlisted(value.as_py())):
            records[i] = record
    known = np.array([r != b"" for r in records], bool)
    # of a segment without tokens stands an empty row, which no good text uses
    found = Aligned([r or b"\0\0" for r in records])
    groups = found.texts()
    pairs, often, sizes = found.links()
    owner = np.repeat(np.arange(n_docs), np.diff(upto, prepend=0))
    ok = np.diff(upto, prepend=0) > 0
    if len(numbers):
        ok[np.unique(owner[~known[numbers]])] = False
    counts = [np.bincount(owner, x[numbers] if len(numbers) else None, n_docs).astype(np.int64) * ok for x in (found.n_a, found.n_b, found.n_groups)]
    hashes, start = [], 0
    listed = numbers.tolist()
    for stop, fine in zip(upto.tolist(), ok.tolist()):
        hashes.append(hashlib.sha256(";".join([groups[i] for i in listed[start:stop]]).encode()).hexdigest() if fine else "")
        start = stop
    # a text's segments once each, then its pairs once each
    used = ok[owner] if len(owner) else np.zeros(0, bool)
    width = max(1, len(groups))
    both, times = np.unique(owner[used] * width + numbers[used], return_counts=True)
    doc, segment = both // width, both % width
    first = np.cumsum(sizes) - sizes
    many = sizes[segment]
    at = np.repeat(first[segment] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    distinct, number = np.unique(pairs, return_inverse=True)
    key = np.repeat(doc, many) * max(1, len(distinct)) + number[at]
    weight = often[at] * np.repeat(times, many)
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    link, links = (key[new] % max(1, len(distinct))).astype(np.int32), key[new] // max(1, len(distinct))
    weight = np.add.reduceat(weight, new) if len(new) else weight
    holders = np.bincount(link, minlength=len(distinct)).astype(np.int64)
    links_of = np.bincount(links, minlength=n_docs)
    # steps between the ascending links of a document; its first counts from 0
    steps = np.diff(link, prepend=0)
    heads = (np.cumsum(links_of) - links_of)[links_of > 0]
    steps[heads] = link[heads]
    if len(weight) and weight.max() >> 31:
        raise OverflowError("a pair is linked over 2^31 times in one document")
    values = [block, ids, *counts, hashes, _squeeze(links_of, steps, weight), distinct, holders]
    kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.int64())] * 3, pa.list_(pa.string()), pa.binary(), *[pa.list_(pa.int64())] * 2]
    return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], [c.split()[0] for c in _COMPOSED.split(", ")])


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _documents(blocks: pa.Table, count: np.ndarray, best: np.ndarray) -> pa.Table:
    """One block's documents, from how many documents hold each of its pairs and whether it is its A id's most frequent."""
    row = {c: blocks.column(c)[0].values for c in ("doc_ids", "n_a", "n_b", "n_groups", "groups_sha256")}
    sizes, steps, often = map(_ints, _unsqueeze(blocks.column("links")[0].as_py()))
    stop = np.cumsum(sizes)
    total = np.concatenate([[0], np.cumsum(steps)])
    link = total[1:] - np.repeat(total[stop - sizes], sizes)
    sums = []
    for values in (often, often * best[link], often * count[link]) if len(link) else [often] * 3:
        total = np.concatenate([[0], np.cumsum(values)])
        sums.append(pa.array(total[stop] - total[stop - sizes], pa.int64()))
    columns = [row["doc_ids"], row["n_a"], row["n_b"], row["n_groups"], *sums, row["groups_sha256"]]
    return pa.Table.from_arrays(columns, [c.split()[0] for c in _RESULT.split(", ")])


def _look_up(blocks: pa.Table, counts: pa.Table) -> pa.Table:
    counts = counts.sort_by("number")
    return _documents(blocks, counts.column("count").to_numpy(), counts.column("best").to_numpy())


def _looker(table: object):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, count, best = table.value
        for batch in batches:
            for i in range(batch.num_rows):
                one = pa.Table.from_batches([batch.slice(i, 1)])
                at = np.searchsorted(keys, one.column("pairs")[0].values.to_numpy(zero_copy_only=False))
                at = np.minimum(at, max(0, len(keys) - 1))  # pairs that no good text holds are not in the table, and not looked at
                yield from _documents(one, count[at] if len(keys) else count, best[at] if len(keys) else best).to_batches()

    return run


def pair_counts(composed: DataFrame) -> DataFrame:
    """Columns pair, count (documents that hold it linked) and best (1 if no pair of its A id has more)."""
    held = composed.select(F.explode(F.arrays_zip("pairs", "holders")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.holders").alias("n")).filter("n > 0")
    counts = stow(held.groupBy("pair").agg(F.sum("n").alias("count")))
    highest = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("count").alias("most"))
    return counts.join(small(highest), F.shiftright("pair", 32) == F.col("a")).select("pair", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))


#: Entries of blocks and segments in a bucket, blocks of one salt, and distinct pairs that are broadcast (16 bytes each).
BUCKET, SALT_BLOCKS, PAIRS = 1 << 18, 1 << 16, 1 << 20


def align(docs: DataFrame, tokenizer: str, model: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: counts of its tokens, groups and links, and the hash of its groups."""
    spark = docs.sparkSession
    files = spark.sparkContext.broadcast((vocabulary(tokenizer), model_bytes(model)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    blocks = stow(rows.mapInArrow(_blocks(files), _BLOCKS))
    total = blocks.agg(F.count("*").alias("blocks"), F.coalesce(F.sum("n"), F.lit(0)).alias("entries")).first()
    salts = 1 + total["blocks"] // SALT_BLOCKS
    buckets = max(shuffle_partitions(spark), total["entries"] // (salts * BUCKET) + 1)
    asked = blocks.select("block", "segments").mapInArrow(_asker(buckets, salts), _ASKED)
    answers = asked.groupBy("bucket", "salt").applyInArrow(_answerer(files), "of long, answer binary")
    composed = stow(blocks.drop("segments").groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(_compose, _COMPOSED))
    discard(blocks)
    del asked, answers
    release(spark)
    counts = stow(pair_counts(composed))
    slim = composed.drop("holders")
    if counts.count() <= PAIRS:
        table = counts.orderBy("pair").toPandas()
        held = spark.sparkContext.broadcast((table["pair"].to_numpy(), table["count"].to_numpy(), table["best"].to_numpy()))
        return slim.mapInArrow(_looker(held), _RESULT)
    pairs = composed.select(F.col("block").alias("of"), F.posexplode("pairs").alias("number", "pair"))
    counted = pairs.join(counts, "pair", "left").select("of", "number", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("best", F.lit(0)).alias("best"))
    return slim.drop("pairs").groupBy("block").cogroup(counted.groupBy("of")).applyInArrow(_look_up, _RESULT)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
