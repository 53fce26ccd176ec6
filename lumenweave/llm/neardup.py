"""Operator 2: n-gram Jaccard join and the groups it forms.

Documents become sets of hashed five-word shingles; two link when 100 * |A & B| >=
75 * |A | B|. Equal sets are collapsed first (one row each, whatever their number).

Candidates. A document's keys are its ``KEYS`` smallest shingle hashes (all of them when
it has no more). Of two linked sets, each of the first elements of the union belongs to
both with chance 0.75 or more, so they share no key with a chance below 0.25**48 < 1e-28,
less than that of a hash collision; sets of up to 48 shingles cannot miss at all.

Pass 1 (star): in every key's bucket the members are compared with the smallest member
only, which joins large groups of near copies with a number of rows linear in the group.
Pass 2 (tiles): of a document's keys in buckets whose members are not all in one group yet,
all but the most frequent are kept: linked sets share at least ``common_keys``, so leaving out
that many less one loses no shared rarest key (exact for unions to 48 shingles, else a
chance below 1e-12 a link). In buckets of more than ``HEAVY`` members a document stays only if
enough of its shingles are in another document of such buckets, counted exactly; one with
text of its own beyond a quarter can't link there. Buckets that are crowded still are split by what
else their members share (``_crowds``), as where texts consist of common passages. A bucket's largest group, whose members
aren't compared with each other, is dealt apart from the rest, so that rows grow with the
square only of what may link and doesn't, and no task holds a whole bucket. Tiles are
sorted by set size and compare members of different groups whose sizes allow a
link, by parity bitmaps: popcount(a ^ b) never exceeds the symmetric difference, so
(|A| + |B| - popcount) / 2 bounds the overlap from above. Only pairs that the bound
admits leave a tile.
Verification: admitted pairs are compared exactly by intersecting sorted shingle arrays.

Cases: null and wordless texts have no shingles and are linked with nothing; texts of
fewer than five words are one shingle; repeated rows (same id and text) share a result;
ties go to the smallest id; an empty table gives an empty result; other columns pass
through ``stage``. ``groups`` takes ids to be unique but for repeated rows (rows without an
id are left alone); ``stage`` also takes null and shared ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import accumulate
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenweave.llm import textops as X
from lumenweave.llm.common import apart, cut, discard, once, read, release, row_keys, small, stow
from lumenweave.llm.graph import components

WORDS = 5
PERCENT = 75
KEYS = 48
#: Chance that two linked sets share fewer keys than ``common_keys`` says, and unions up to which it is counted exactly.
MISS = 1e-12
LARGE = 1600
HEAVY = 256
#: Further star passes, over the open buckets of more than STAR_SIZE members, with other pivots.
STAR_ROUNDS = 2
STAR_SIZE = 12
TILE = 1024
#: Shingles of a task that counts in how many sets they are.
RANGE = 1 << 17
MAX_BITS = 1 << 15
_SIGN = np.uint64(1 << 63)


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first row, sorted distinct shingle hashes of a block's rows, offsets)."""
    for row, data, offsets in X.string_blocks(texts):
        h, counts = X.tokens(data, offsets)
        s, n = X.sequences(h, counts, WORDS)
        short = np.flatnonzero((counts > 0) & (counts < WORDS))
        owner = np.repeat(np.arange(len(counts)), n)
        if len(short):
            ends = np.cumsum(counts)
            with np.errstate(over="ignore"):
                whole = np.array([X.mix(np.atleast_1d((h[ends[i] - counts[i] : ends[i]] * X.SEQ[: counts[i]]).sum() + X.SEQ[40] * np.uint64(counts[i])))[0] for i in short], np.uint64)
            s, owner = np.concatenate([s, whole]), np.concatenate([owner, short])
        order = np.lexsort((s, owner))
        s, owner = s[order], owner[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
        s, owner = s[new], owner[new]
        yield row, s, np.searchsorted(owner, np.arange(len(counts) + 1))


def _surely_shared(union: int) -> int:
    """Least number of the KEYS smallest hashes of a union of linked sets that both hold, but for a chance below MISS."""
    both = -(-PERCENT * union // 100)
    if union <= KEYS:
        return both
    ways, limit = 0, MISS * comb(union, KEYS)
    for s in range(KEYS + 1):
        ways += comb(both, s) * comb(union - both, KEYS - s)
        if ways > limit:
            return s
    return KEYS


def common_keys(n: int) -> int:
    """Keys that a set of ``n`` shares at least with any set it links to (whose union has up to 4/3 n elements)."""
    return max(1, min(_surely_shared(u) for u in range(n, max(n, 100 * n // PERCENT) + 1)))


@cache
def _steps() -> tuple[list[int], list[int], int]:
    """``common_keys`` of the sizes to KEYS; beyond, where each step down begins; its least value."""
    unions = [_surely_shared(u) for u in range(1, LARGE + 1)]
    # a binomial tail bounds what larger unions give
    share, tail, least = PERCENT / 100, 0.0, 0
    while (tail := tail + comb(KEYS, least) * share**least * (1 - share) ** (KEYS - least)) <= MISS:
        least += 1
    to = [min(unions[n - 1 : max(n, 100 * n // PERCENT)]) for n in range(1, LARGE * PERCENT // 100)]
    falling = list(accumulate(to[KEYS:], min))
    begins = [KEYS + 1 + next((i for i, v in enumerate(falling) if v < s), len(falling)) for s in range(falling[0], least, -1)]
    return to[:KEYS], begins, least


def _common_keys(n: str) -> Column:
    """``common_keys`` of a column, or less."""
    few, begins, least = _steps()
    many = sum(((F.col(n) < b).cast("int") for b in begins), F.lit(least))
    return F.when(F.col(n) <= KEYS, F.element_at(F.array(*map(F.lit, few)), F.least(F.col(n), F.lit(KEYS)).cast("int"))).otherwise(many)


def bits_for(n: int) -> int:
    """Bitmap width of a set of ``n``: the power of two at or above 4n, from 64 to MAX_BITS."""
    return min(MAX_BITS, max(64, 1 << (4 * n - 1).bit_length()))


def parity_bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    odd = np.bincount((s >> np.uint64(7)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


_SKETCH = "doc_id long, n long, s1 long, s2 long, keys array<long>, bitmap binary"


def sketches(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: set size, 128-bit hash of the set, keys and parity bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for row, s, at in shingle_sets(batch.column(1)):
                sizes = np.diff(at)
                with np.errstate(over="ignore"):
                    a, b = np.concatenate([[np.uint64(0)], np.cumsum(X.mix(s))]), np.concatenate([[np.uint64(0)], np.cumsum(X.mix(s * X.SEQ[50]))])
                    s1, s2 = a[at[1:]] - a[at[:-1]], b[at[1:]] - b[at[:-1]]
                sets = [s[at[i] : at[i + 1]] for i in range(len(sizes))]
                take = np.minimum(sizes, KEYS)
                flat = np.concatenate([x[:KEYS] for x in sets]) if sets else np.zeros(0, np.uint64)
                keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(take)]).astype(np.int32)), pa.array(flat.view(np.int64)))
                maps = pa.array([parity_bitmap(x, bits_for(len(x))).tobytes() for x in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(row, len(sizes)), pa.array(sizes.astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), keys, maps], names=["doc_id", "n", "s1", "s2", "keys", "bitmap"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, _SKETCH)


def _can_link(a: np.ndarray, b: np.ndarray, differ: np.ndarray | int = 0) -> np.ndarray:
    """Whether sizes a, b with a symmetric difference of at least ``differ`` can reach PERCENT."""
    differ = np.maximum(differ, np.abs(a - b))
    # overlap (a + b - d) / 2, union (a + b + d) / 2
    return 100 * (a + b - differ) >= PERCENT * (a + b + differ)


class Bitmaps:
    """Parity bitmaps of a table's rows, as matrices by width; a wider map folds to a narrower by exclusive or."""

    def __init__(self, maps: list[bytes]):
        self.maps, self.width = maps, np.array([len(m) for m in maps], np.int64)
        self._made: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def at(self, w: int) -> tuple[np.ndarray, np.ndarray]:
        """(row to matrix row, matrix) of the rows of width w or 2w, at width w."""
        if w not in self._made:
            place, parts, used = np.full(len(self.maps), -1, np.int64), [], 0
            for wide in (w, 2 * w):
                own = np.flatnonzero(self.width == wide)
                m = np.frombuffer(b"".join([self.maps[i] for i in own.tolist()]), np.uint8).reshape(-1, wide // w, w)
                parts.append(np.bitwise_xor.reduce(m, axis=1))
                place[own] = np.arange(used, used + len(own))
                used += len(own)
            self._made[w] = place, np.ascontiguousarray(np.concatenate(parts)).view(np.uint64)
        return self._made[w]

    def differ(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """popcount(map_i ^ map_j) at the width of the smaller set (size_i <= size_j <= 4/3 size_i)."""
        out, width = np.zeros(len(i), np.int64), self.width[i]
        for w in np.unique(width):
            own, (place, matrix) = np.flatnonzero(width == w), self.at(int(w))
            for at in range(0, len(own), 1 << 15):
                o = own[at : at + (1 << 15)]
                out[o] = np.bitwise_count(matrix[place[i[o]]] ^ matrix[place[j[o]]]).sum(1, dtype=np.int64)
        return out


def _admit(sizes: np.ndarray, maps: Bitmaps, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    swap = sizes[i] > sizes[j]
    a, b = np.where(swap, j, i), np.where(swap, i, j)
    ok = _can_link(sizes[a], sizes[b])
    ok[ok] = _can_link(sizes[a[ok]], sizes[b[ok]], maps.differ(a[ok], b[ok]))
    return ok


def _tile_pairs(table: pa.Table) -> pa.RecordBatch:
    """Admitted pairs of different labels inside each (key, tile) of a table sorted by key, tile, size."""
    key, tile, side = (table[c].to_numpy() for c in ("key", "tile", "side"))
    node, label, sizes = (table[c].to_numpy() for c in ("node", "label", "n"))
    maps = Bitmaps(table["bitmap"].to_pylist())
    out, i, d = [], np.arange(len(node)), 0
    while len(i):
        d += 1
        i = i[i + d < len(node)]
        j = i + d
        live = (key[i] == key[j]) & (tile[i] == tile[j]) & _can_link(sizes[i], sizes[j])
        i, j = i[live], j[live]  # sizes rise, so a pair of sizes too far apart ends its row
        test = (label[i] != label[j]) & ((side[i] < 0) | (side[i] != side[j]))
        if test.any():
            a, b = i[test], j[test]
            ok = _admit(sizes, maps, a, b)
            out.append((node[a[ok]], node[b[ok]]))
    a = np.concatenate([x for x, _ in out]) if out else np.zeros(0, np.int64)
    b = np.concatenate([x for _, x in out]) if out else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], names=["a", "b"])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut a sorted stream at tile borders, some thousands of rows at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        if table.num_rows < 4 * TILE:
            continue
        key, tile = table["key"].to_numpy(), table["tile"].to_numpy()
        border = np.flatnonzero((key[1:] != key[:-1]) | (tile[1:] != tile[:-1]))
        if len(border):
            yield _tile_pairs(table.slice(0, border[-1] + 1))
            held = table.slice(border[-1] + 1).combine_chunks().to_batches()
    if held:
        yield _tile_pairs(pa.Table.from_batches(held))


def _verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b) of the pairs that link, by exact intersection of sorted arrays."""
    body = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    rows = pairs.join(body.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    rows = rows.join(body.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                left, right = part.column("text_a").dictionary_encode(), part.column("text_b").dictionary_encode()
                sets = []
                for side in (left, right):
                    own = []
                    for _, s, offsets in shingle_sets(side.dictionary):
                        own += [s[offsets[i] : offsets[i + 1]] for i in range(len(offsets) - 1)]
                    sets.append([own[i] for i in side.indices.to_numpy()])
                keep = []
                for x, y in zip(*sets, strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both > 0 and 100 * both >= PERCENT * (len(x) + len(y) - both))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long").distinct()


def _admitted(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs that size and bitmap admit."""
    maps = reps.select("node", "n", "bitmap")
    rows = pairs.join(maps.toDF("a", "na", "ma"), "a").join(maps.toDF("b", "nb", "mb"), "b").filter(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if m:
                sizes = np.concatenate([batch.column(c).to_numpy() for c in ("na", "nb")])
                ok = _admit(sizes, Bitmaps(batch.column("ma").to_pylist() + batch.column("mb").to_pylist()), np.arange(m), np.arange(m, 2 * m))
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    return rows.select("a", "b", "na", "nb", "ma", "mb").mapInArrow(run, "a long, b long")


def _open(keyed: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, label, size) of the buckets that hold more than one group."""
    named = stow(keyed.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")))
    mixed = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).filter("low < high").select(apart("key"), "size")
    out = stow(named.join(mixed, "key"))
    discard(named)
    return out


def _sets(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sketch: doc_id, n, s1, s2 per row; sets: s1, s2, node = smallest id; reps: node, n, keys, bitmap per set)."""
    whole = stow(sketches(docs))
    sets = cut(whole.filter("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("node")))
    reps = stow(whole.join(sets.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "node"))
    sketch = stow(whole.select("doc_id", "n", "s1", "s2"))
    discard(whole)
    release(docs.sparkSession)
    return sketch, sets, reps


def _keyed(reps: DataFrame) -> DataFrame:
    """(key, node, pivot, size) of the keys of at least two sets; pivot: the smallest node of the key."""
    keyed = reps.select("node", F.explode("keys").alias("key"))
    pivots = keyed.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("size")).filter("size > 1")
    return stow(keyed.join(pivots.select(apart("key"), "pivot", "size"), "key"))


def _prefixes(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """(key, node, label) of ``rows`` without the ``common_keys`` - 1 most frequent keys of each node.

    Two linked sets share at least so many keys, so the rarest key that they share stays in both:
    at least that number less one of either's keys comes after it in the order.
    """
    frequent_first = Window.partitionBy("node").orderBy(F.desc("size"), F.desc("key"))
    ranked = rows.join(reps.select("node", "n"), "node").withColumn("at", F.row_number().over(frequent_first))
    return ranked.filter(F.col("at") >= _common_keys("n")).select("key", "node", "label")


def _dealt(rows: DataFrame) -> DataFrame:
    """(key, tile, side, node, label) of ``rows`` (key, node, label): every two members of a key with different labels meet in one tile.

    A key of more than HEAVY members is dealt into parts of TILE: those of its largest label (no
    two of which are compared) apart from the rest. Tile (p, q) holds part p of the largest label
    and part q of the rest, further tiles two parts of the rest.
    """
    buckets = rows.groupBy("key", "label").agg(F.count("*").alias("m")).groupBy("key").agg(F.sum("m").alias("all"), F.max(F.struct("m", "label")).alias("top")).filter("all > top.m")
    rows = rows.join(buckets.select(apart("key"), "all", "top"), "key")
    alone, most = F.col("all") <= HEAVY, F.col("label") == F.col("top.label")
    parts = lambda m: F.when(alone, 1).otherwise(F.ceil(m / TILE)).cast("long")
    rows = rows.select("key", "node", "label", most.alias("most"), parts(F.col("top.m")).alias("p"), parts(F.col("all") - F.col("top.m")).alias("q"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("most"), F.col("p")).otherwise(F.col("q"))))
    rows = rows.withColumn("to", F.explode(F.sequence(F.lit(0), F.when(F.col("most"), F.col("q")).otherwise(F.col("p") + F.col("q") - 1) - 1)))
    other = F.col("to") - F.col("p")
    other = other + (other >= F.col("own")).cast("long")
    lo, hi = F.least("own", other), F.greatest("own", other)
    with_most = F.col("to") < F.col("p")
    tile = F.when(F.col("most"), F.col("own") * F.col("q") + F.col("to")).when(with_most, F.col("to") * F.col("q") + F.col("own")).otherwise((F.col("p") + lo) * F.col("q") + hi)
    # rows of the same side aren't compared, but those of side -1, which meet in the first tile of their part
    side = F.when(F.col("most"), 0).when(F.col("to") == 0, -1).when(with_most, 1).otherwise((F.col("own") == hi).cast("int"))
    return rows.select("key", tile.alias("tile"), side.alias("side"), "node", "label")


def _shared_shingles(texts: DataFrame, ranges: int) -> DataFrame:
    """(node, shared): how many shingles of each row of ``texts`` (node, text) another row has too."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            for row, s, at in shingle_sets(batch.column(1)):
                if not len(s):
                    continue
                block = nodes[row : row + len(at) - 1]
                owner = np.repeat(np.arange(len(block)), np.diff(at))
                kinds, place, count = np.unique(s, return_inverse=True, return_counts=True)
                again = count[place] > 1
                known = np.bincount(owner[again], minlength=len(block))
                alone, marks = s[~again], kinds[count > 1]
                of, of_marks = ((x >> np.uint64(20)) % np.uint64(ranges) for x in (alone, marks))
                order = np.argsort(of, kind="stable")
                alone, of, held = alone[order], of[order], block[owner[~again]][order]
                order = np.argsort(of_marks, kind="stable")
                marks, of_marks = marks[order], of_marks[order]
                # the block's own counts are dealt by node
                of_known = X.mix(block.astype(np.uint64)) % np.uint64(ranges)
                order = np.argsort(of_known, kind="stable")
                block, known, of_known = block[order], known[order], of_known[order]
                into = np.unique(np.concatenate([of, of_marks, of_known]))
                cuts, cuts_marks, cuts_known = (np.append(np.searchsorted(x, into), len(x)).astype(np.int32) for x in (of, of_marks, of_known))
                lists = [pa.ListArray.from_arrays(pa.array(c), pa.array(v)) for c, v in ((cuts, alone.view(np.int64)), (cuts, held), (cuts_marks, marks.view(np.int64)), (cuts_known, block), (cuts_known, known))]
                yield pa.RecordBatch.from_arrays([pa.array(into.astype(np.int64)), *lists], names=["range", "alone", "held", "marks", "block", "known"])

    def judge(table: pa.Table) -> pa.Table:
        alone, held, marks, block, known = (np.concatenate([c.flatten().to_numpy() for c in table[name].chunks]) for name in ("alone", "held", "marks", "block", "known"))
        kinds, place, count = np.unique(alone, return_inverse=True, return_counts=True)
        again = (count[place] > 1) | np.isin(alone, marks)
        node, at = np.unique(np.concatenate([held[again], block]), return_inverse=True)
        shared = np.bincount(at, weights=np.concatenate([np.ones(again.sum()), known]), minlength=len(node))
        return pa.table({"node": pa.array(node, pa.int64()), "shared": pa.array(shared.astype(np.int64))})

    blobs = texts.select("node", "text").mapInArrow(gather, "range long, alone array<long>, held array<long>, marks array<long>, block array<long>, known array<long>")
    return blobs.groupBy("range").applyInArrow(judge, "node long, shared long").groupBy("node").agg(F.sum("shared").alias("shared"))


def _linkable(rows: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """``rows`` (key, node, label) without those of keys of more than HEAVY members whose node can't link to any member.

    Two sets that link and meet in such a key have only shingles in common that two of its
    nodes hold. So a set with too few of those, for its own size and the smallest set of the
    key, has no link there. Its links through rarer keys are found by these.
    """
    large = cut(rows.groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") > HEAVY).select("key"))
    if large.isEmpty():
        return rows
    of_large = small(large.withColumn("large", F.lit(True)))
    hard = stow(rows.join(of_large, "key").select("key", "node", "label"))
    nodes = stow(hard.select("node").distinct().join(reps.select("node", "n"), "node"))
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"])
    ranges = nodes.agg(F.sum("n")).first()[0] // RANGE + 1
    sizes = cut(_shared_shingles(texts, ranges).join(nodes, "node").filter(100 * F.col("shared") >= PERCENT * F.col("n")))
    hard_rows = hard.join(sizes, "node")
    least = hard_rows.groupBy("key").agg(F.min("n").alias("least"))
    # linked sets have (100 + PERCENT) * overlap >= PERCENT * (one size + the other)
    able = hard_rows.join(small(least), "key").filter((100 + PERCENT) * F.col("shared") >= PERCENT * (F.col("n") + F.col("least")))
    out = stow(rows.join(of_large, "key", "left").filter("large IS NULL").select("key", "node", "label").unionAll(able.select("key", "node", "label")))
    discard(hard, nodes)
    return out


#: Classes in common that may tell the members of a crowded bucket apart.
DEPTH = 8


def _exploded(texts: DataFrame) -> DataFrame:
    """(node, s): the shingles of ``texts`` (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            for row, s, at in shingle_sets(batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(nodes[row : row + len(at) - 1], np.diff(at))), pa.array(s.view(np.int64))], names=["node", "s"])

    return texts.select("node", "text").mapInArrow(run, "node long, s long")


def _crowds(crowded: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(key, node, label) of finer buckets for the members of ``crowded`` (key, node, label).

    Shingles that the same members hold form a class, whose weight is their number: a passage that many
    texts hold is one. Linked sets have classes in common that weigh at least PERCENT of either's size.
    With classes in one order, rare first, the first in common begins a part of either's list of at
    least that weight; the second one of that weight less the first's, and so on. So the members of a
    class may be dealt by the next class in common, and those by the next, and few of a set's
    classes come in question each time. Members to whom what they have in common weighs enough
    without another class stay together too. A bucket is split where that makes fewer rows than
    its tiles would have; no pair that links is lost either way.
    """
    nodes = stow(crowded.select("node", "label").distinct().join(reps.select("node", F.ceil(F.col("n") * PERCENT / 100).cast("int").alias("need")), "node"))
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(small(nodes.select("node")), "node", "left_semi").dropDuplicates(["node"])
    own = stow(_exploded(texts))
    named = own.groupBy("s").agg(F.bit_xor(F.xxhash64("node")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("h2"), F.count("*").alias("m")).filter("m > 1")
    named = named.select(apart("s"), F.xxhash64("h1", "h2", "m").alias("key"), "m")
    spots = own.join(named, "s").groupBy("node", "m", "key").agg(F.count("*").cast("int").alias("weight"))
    spots = spots.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("m", "key", "weight"))).alias("c"))
    # of each class what its place and all later ones weigh
    rest = F.transform("c", lambda x, i: F.aggregate(F.slice("c", i + 1, F.size("c")), F.lit(0), lambda t, y: t + y["weight"]))
    lists = stow(nodes.join(spots, "node").withColumn("rest", rest))

    def after(at: Column, least: Column) -> Column:
        """Places behind ``at`` whose rest weighs at least ``least``."""
        return F.filter(F.sequence(F.lit(0), F.size("c") - 1), lambda i: (i > at) & (F.get("rest", i) >= least))

    step = lists.select("node", "label", "need", "c", "rest", F.explode(after(F.lit(-1), F.col("need"))).alias("at"))
    state = step.select("node", "label", F.get("c", F.col("at"))["key"].alias("key"), "at", F.get("c", F.col("at"))["weight"].alias("has"))
    done = None
    for depth in range(DEPTH):
        state = stow(state)
        kept = state if depth + 1 == DEPTH else None
        if kept is None:
            big = state.groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") > TILE).select(apart("key"), "m")
            inside = state.join(big, "key").join(lists.select("node", "need", "c", "rest"), "node").withColumn("next", after(F.col("at"), F.col("need") - F.col("has")))
            split = stow(inside.groupBy("key").agg(F.sum(F.size("next")).alias("finer"), F.first("m").alias("m")).filter(F.col("finer") * TILE < F.col("m") * F.col("m")).select(apart("key"), F.lit(True).alias("split")))
            if split.isEmpty():
                kept = state
            else:
                marked = state.join(small(split), "key", "left")
                inside = inside.join(small(split), "key")
                kept = marked.filter("split IS NULL").drop("split").unionByName(inside.filter("has >= need").select(*state.columns))
                state = inside.select("node", "label", "key", "has", "c", F.explode("next").alias("at"))
                state = state.select("node", "label", F.xxhash64("key", F.get("c", F.col("at"))["key"]).alias("key"), "at", (F.col("has") + F.get("c", F.col("at"))["weight"]).alias("has"))
        part = kept.select("key", "node", "label")
        done = part if done is None else done.unionByName(part)
        if kept is state:
            break
    return done


def _candidates(rows: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b) of the pairs of different labels that tiles of ``rows`` (key, node, label, size) admit."""
    kept = stow(_prefixes(rows, reps))
    able = _linkable(kept, reps, docs)
    crowds = cut(able.groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") > TILE).select("key"))
    placed = able
    if not crowds.isEmpty():
        marks = small(crowds.withColumn("crowd", F.lit(True)))
        marked = able.join(marks, "key", "left")
        finer = _crowds(marked.filter("crowd").select("key", "node", "label"), reps, docs)
        placed = marked.filter("crowd IS NULL").select("key", "node", "label").unionByName(finer)
    tiled = _dealt(placed).join(reps.select("node", "n", "bitmap"), "node").repartition("key", "tile").sortWithinPartitions("key", "tile", "n")
    found = cut(tiled.select("key", "tile", "side", "node", "label", "n", "bitmap").mapInArrow(_tiles, "a long, b long").distinct())
    discard(*{kept, able})
    return found


def link_pairs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The join itself: (pairs, members) of ``docs`` (doc_id, text).

    pairs (a, b, a < b): all links between different shingle sets, each set named by its
    smallest doc_id; members (doc_id, node): the set of every row that has shingles. Two rows
    link when their nodes are equal or a pair. Rows of pairs grow with the square of a group
    of near copies, as the links themselves do; ``groups`` needs none of that.
    """
    sketch, sets, reps = _sets(docs)
    rows = _keyed(reps).select("key", "node", F.col("node").alias("label"), "size")
    found = _candidates(rows, reps, docs)
    pairs = cut(_verify(found, docs))
    return pairs, sketch.filter("n > 0").join(sets, ["s1", "s2"]).select("doc_id", "node")


def link_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, node, n_links): of every row with shingles, its set and the number of other rows it links to."""
    pairs, members = link_pairs(docs)
    many = cut(members.groupBy("node").agg(F.count("*").alias("n")))
    both = pairs.select("a", "b").unionAll(pairs.select("b", "a"))
    far = both.join(many.toDF("b", "n"), "b").groupBy("a").agg(F.sum("n").alias("far")).withColumnRenamed("a", "node")
    total = many.join(far, "node", "left").select("node", (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"))
    return members.join(total, "node").select("doc_id", "node", "n_links")


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    sketch, sets, reps = _sets(docs)
    keyed = _keyed(reps)
    release(spark)
    star = keyed.filter("node != pivot").groupBy(F.col("pivot").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("shared")).filter("shared > 2").select("a", "b")
    links = cut(_verify(cut(_admitted(star, reps)), docs))
    release(spark)
    labels = components(links)
    open_rows = _open(keyed, labels)
    for _ in range(STAR_ROUNDS):
        large = open_rows.filter(F.col("size") > STAR_SIZE)
        if large.isEmpty():
            break
        pivots = large.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", "key").alias("o"), F.col("node").alias("pivot"), F.col("label").alias("own"))).alias("p")).select(apart("key"), "p.pivot", "p.own")
        star = large.join(pivots, "key").filter("label != own").select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct()
        more = cut(_verify(cut(_admitted(star, reps)), docs))
        release(spark)
        if more.isEmpty():
            break
        links = links.unionAll(more)
        labels = components(links)
        discard(open_rows)
        open_rows = _open(keyed, labels)
    discard(keyed)
    found = _candidates(open_rows, reps, docs)
    discard(open_rows, reps)
    release(spark)
    more = cut(_verify(found, docs)) if not found.isEmpty() else links.limit(0)
    labels = components(links.unionAll(more)) if not more.isEmpty() else labels
    named_sets = sets.join(labels, "node", "left").select("s1", "s2", F.coalesce("label", "node").alias("component_id"))
    out = sketch.join(named_sets, ["s1", "s2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(read(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: of each group the document of the smallest id stays.

    Rows whose id is null or not theirs alone go by a hash of id and text (below all other
    ids), so they are judged by their text; of repeated rows (same id and text) one stays.
    """
    keyed, clashes = row_keys(docs)
    kept = groups(keyed.select(F.col("__key").alias("doc_id"), "text")).filter("doc_id = component_id").select(F.col("doc_id").alias("__key")).distinct()
    return once(keyed.join(kept, "__key", "left_semi"), clashes).select(*docs.columns)
