"""Exact k nearest neighbours by squared distance, ties to the smaller id."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.plans.lineage import cut, small, wide

#: Points of a candidate block, a leaf of the tree; and queries that meet it in one task.
BLOCK = 512
QUERIES = 4096
#: Queries of small images that meet their candidates in one group.
BATCH_QUERIES = 1 << 13
#: Levels of the tree below a region, whose leaves one group holds; and queries that meet a region in one group at least and at most, and such groups of a table in between.
REGION_LEVELS, REGION_QUERIES, GROUPS = 6, (1 << 11, 1 << 14), 64
#: Sampled points for each leaf, leaves of an image at most, and leaves that are broadcast at once.
SAMPLE, MOST_LEAVES, BROADCAST_LEAVES = 16, 1 << 14, 1 << 17


class Tree:
    """Median splits of one image's points, breadth first: node n has children 2 n + 1 and 2 n + 2; all leaves are at one depth.

    Nodes of level ``top`` are regions. ``fit`` gives every node the bounding box of its leaves' points, for ``reached``.
    """

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        self.depth, self.top, nodes = depth, max(0, depth - REGION_LEVELS), (1 << depth) - 1
        self.dim, self.cut = np.zeros(nodes, np.int64), np.zeros(nodes)
        parts = {0: sample}
        for n in range(nodes):
            own = parts.pop(n)
            if len(own):
                self.dim[n] = int(np.argmax(own.max(0) - own.min(0)))
                self.cut[n] = np.median(own[:, self.dim[n]])
            low = own[:, self.dim[n]] <= self.cut[n]
            parts[2 * n + 1], parts[2 * n + 2] = own[low], own[~low]

    def leaf(self, points: np.ndarray) -> np.ndarray:
        """The leaf (from 0) of each point."""
        at = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (points[np.arange(len(points)), self.dim[at]] > self.cut[at])
        return at - len(self.dim)

    def fit(self, leaves: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        n, d = len(self.dim), low.shape[1]
        self.low, self.high = np.full((2 * n + 1, d), np.inf), np.full((2 * n + 1, d), -np.inf)
        self.low[n + leaves], self.high[n + leaves] = low, high
        for k in range(n - 1, -1, -1):
            self.low[k], self.high[k] = np.minimum(self.low[2 * k + 1], self.low[2 * k + 2]), np.maximum(self.high[2 * k + 1], self.high[2 * k + 2])

    def _gap(self, points: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        return (np.maximum(np.maximum(self.low[nodes] - points, points - self.high[nodes]), 0) ** 2).sum(1)

    def nearest(self, points: np.ndarray) -> np.ndarray:
        """A leaf with points, by going down to the nearer child each time."""
        at = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            left, right = self._gap(points, 2 * at + 1), self._gap(points, 2 * at + 2)
            at = 2 * at + 1 + (right < left)
        return at - len(self.dim)

    def reached(self, points: np.ndarray, reach: np.ndarray, root: np.ndarray | int = 0, top: int = 0, bottom: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(point, node) for all nodes of level ``bottom`` (the leaves) below ``root`` of level ``top`` whose box comes within ``reach`` (a squared distance) of a point."""
        bottom = self.depth if bottom is None else bottom
        point, at = np.arange(len(points)), np.zeros(len(points), np.int64) + root + (1 << top) - 1
        for _ in range(top, bottom):
            point, at = np.repeat(point, 2), np.stack([2 * at + 1, 2 * at + 2], 1).ravel()
            near = self._gap(points[point], at) <= reach[point]
            point, at = point[near], at[near]
        return point, at - ((1 << bottom) - 1)


class Region:
    """Candidates below one node of a tree, sorted by leaf and id."""

    def __init__(self, tree: Tree, node: int, frame: pd.DataFrame, features: list[str]) -> None:
        self.tree, self.node = tree, node
        leaf, ids = frame["block"].to_numpy(), frame["j"].to_numpy()
        order = np.lexsort((ids, leaf))
        self.ids, self.c = ids[order], [frame[f"c_{f}"].to_numpy(np.float64)[order] for f in features]
        below = tree.depth - tree.top
        self.first = node << below
        self.starts = np.searchsorted(leaf[order], np.arange(self.first, self.first + (1 << below) + 1))

    def meet(self, points: np.ndarray, point: np.ndarray, leaf: np.ndarray, k: int, reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, column, dist2): the k nearest of each pair of point and leaf, none beyond the point's ``reach``."""
        order = np.argsort(leaf, kind="stable")
        point, leaf = point[order], leaf[order] - self.first
        edges = np.flatnonzero(np.diff(leaf, prepend=-1, append=-1))
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for begin, end in zip(edges[:-1], edges[1:], strict=True):
            low, high = self.starts[leaf[begin]], self.starts[leaf[begin] + 1]
            for at in range(begin, end if high > low else begin, 256):
                some = point[at : min(at + 256, end)]
                d = reduce(np.add, [(v[:, None] - c[None, low:high]) ** 2 for v, c in zip(points[some].T, self.c, strict=True)])
                row, column, _ = _least(d, k, None if reach is None else reach[some])
                out.append((some[row], low + column, d[row, column]))
        return tuple(map(np.concatenate, zip(*out, strict=True)))

    def best(self, k: int, *found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k nearest of each point among what was ``found``, by point, distance and id."""
        point, column, d = map(np.concatenate, zip(*found, strict=True))
        order = np.lexsort((self.ids[column], d, point))
        point, column, d = point[order], column[order], d[order]
        first = np.arange(len(point)) - np.searchsorted(point, point) < k
        return point[first], column[first], d[first]

    def inside(self, points: np.ndarray, reach: np.ndarray, k: int, home: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What is found in all leaves of the region within ``reach``, ``home`` left out."""
        point, leaf = self.tree.reached(points, reach, self.node, self.tree.top)
        other = slice(None) if home is None else leaf != home[point]
        return self.meet(points, point[other], leaf[other], k, reach)


def _bound(point: np.ndarray, d: np.ndarray, n: int, k: int) -> np.ndarray:
    """How far each of ``n`` points need look: a little beyond its k-th of sorted finds, or anywhere if it has fewer."""
    ends, out = np.searchsorted(point, np.arange(n), "right"), np.full(n, np.inf)
    full = np.bincount(point, minlength=n) >= k
    out[full] = d[ends[full] - 1] * (1 + 1e-9)
    return out


def _trees(points: DataFrame, features: list[str], sizes: DataFrame) -> dict[int, Tree]:
    """A tree for each image of ``sizes`` (image_id, n), from a bounded sample of its points (image_id, i, features)."""
    rate = F.least(F.lit(1.0), F.lit(float(SAMPLE * MOST_LEAVES)) / F.col("n"), F.lit(float(SAMPLE)) / BLOCK)
    share = F.greatest(rate, F.least(F.lit(1.0), F.lit(4096.0) / F.col("n")))
    some = points.join(F.broadcast(sizes), "image_id").filter(F.pmod(F.xxhash64("i"), F.lit(1 << 20)) < share * (1 << 20))
    out = {}
    for image, rows in some.select("image_id", "n", *features).toPandas().groupby("image_id"):
        depth = min(MOST_LEAVES.bit_length() - 1, max(0, int(np.ceil(np.log2(rows["n"].iloc[0] / BLOCK)))))
        out[int(image)] = Tree(rows[features].to_numpy(np.float64), depth)
    return out


def _by_tree(rows: DataFrame, features: list[str], trees: object, schema: str, run) -> DataFrame:
    """``run``(tree, frame, points) for the rows of each image within each batch of ``rows`` (image_id, .., features)."""

    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for image, part in frame.groupby("image_id"):
                yield run(trees.value[int(image)], part, part[features].to_numpy(np.float64))

    return rows.mapInPandas(go, schema)


def boxes(points: DataFrame, features: list[str], by: list[str]) -> DataFrame:
    """Bounding box (lo_*, hi_*) of each group."""
    return points.groupBy(*by).agg(*[f(v).alias(f"{name}_{v}") for v in features for name, f in (("lo", F.min), ("hi", F.max))])


def _least(d: np.ndarray, k: int, reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, rank from 1) of the k least of each row of ``d``, ties to the first column; none beyond its row's ``reach``."""
    bound = np.partition(d, k - 1, 1)[:, k - 1] if d.shape[1] > k else np.full(len(d), np.inf)
    row, column = np.nonzero(~(d > (bound if reach is None else np.minimum(bound, reach))[:, None]))
    order = np.lexsort((column, d[row, column], row))
    row, column = row[order], column[order]
    rank = np.arange(1, len(row) + 1) - np.searchsorted(row, row)
    return row[rank <= k], column[rank <= k], rank[rank <= k]


def nearest_in_memory(q: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """(queries, min(k, candidates)): each query's nearest candidates, nearest first, ties to the first; sums in the order of ``_meet``."""
    out = [np.zeros((0, min(k, len(c))), np.int64)]
    for at in range(0, len(q) if len(c) else 0, 256):
        d = reduce(np.add, [(v[:, None] - o[None, :]) ** 2 for v, o in zip(q[at : at + 256].T, c.T, strict=True)])
        out.append(_least(d, k)[1].reshape(len(d), -1))
    return np.concatenate(out) if len(c) else np.zeros((len(q), 0), np.int64)


def _block_meeting(features: list[str], k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Of one image: queries (q, features) and a block of candidates (j, c_*)."""

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"image_id": [], "q": [], "rank": [], "j": [], "dist2": []})
        b = b.sort_values("j")
        ids, q, out = b["j"].to_numpy(), a["q"].to_numpy(), []
        own, cols = ([x[c].to_numpy(np.float64) for c in names] for x, names in ((a, features), (b, [f"c_{f}" for f in features])))
        for at in range(0, len(a), 256):
            end = at + 256
            d = reduce(np.add, [(v[at:end, None] - c[None, :]) ** 2 for v, c in zip(own, cols, strict=True)])
            row, column, rank = _least(d, k)
            out.append((q[at + row], rank, ids[column], d[row, column]))
        return pd.DataFrame({"image_id": a["image_id"].iloc[0], **dict(zip(("q", "rank", "j", "dist2"), map(np.concatenate, zip(*out, strict=True)), strict=True))})

    return meet


def _meet_small(left: DataFrame, right: DataFrame, features: list[str], k: int, queries: int) -> DataFrame:
    """``_meet`` of images that are one block each, some of them in a group."""
    meet, batches = _block_meeting(features, k), -(-queries // BATCH_QUERIES) or 1
    batch = F.pmod(F.xxhash64("image_id"), F.lit(batches))

    def some(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        blocks = dict(iter(b.groupby("r_image_id")))
        out = [meet(part, blocks[image]) for image, part in a.groupby("image_id") if image in blocks]
        return pd.concat(out) if out else meet(a[:0], b[:0])

    sides = left.withColumn("batch", batch).groupBy("batch"), right.withColumn("other", batch).withColumnRenamed("image_id", "r_image_id").groupBy("other")
    return sides[0].cogroup(sides[1]).applyInPandas(some, "image_id long, q long, rank int, j long, dist2 double")


def _paired(left: DataFrame, right: DataFrame, by: str, queries: int, run: Callable, schema: str) -> DataFrame:
    """``run`` for each image's ``by`` and some ``queries`` of the rows (q, ..) on the left, with all rows on the right."""
    parts = small(cut(left.groupBy("image_id", by).count().select("image_id", by, F.ceil(F.col("count") / queries).cast("int").alias("parts"))))
    left = left.join(parts, ["image_id", by]).withColumn("part", F.pmod(F.xxhash64("q"), F.col("parts")).cast("int")).drop("parts")
    right = right.join(parts, ["image_id", by]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    on = ["image_id", by, "part"]
    right = right.toDF(*[f"r_{c}" if c in on else c for c in right.columns])
    return left.groupBy(*on).cogroup(right.groupBy(*[f"r_{c}" for c in on])).applyInPandas(run, schema)


def _meet(left: DataFrame, right: DataFrame, features: list[str], k: int) -> DataFrame:
    """(image_id, q, rank, j, dist2): each query's k nearest in its block. Left: q, features, block; right: j, c_*, block."""
    return _paired(left, right, "block", QUERIES, _block_meeting(features, k), "image_id long, q long, rank int, j long, dist2 double")


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("image_id", "q").orderBy("dist2", "j")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("image_id", "q", "rank", "j", "dist2")


def nearest(queries: DataFrame, candidates: DataFrame, features: list[str], k: int, apart: bool = False) -> DataFrame:
    """(image_id, q, rank, j, dist2): for each query the k nearest candidates of its image.

    The candidates of an image of more than BLOCK points are dealt to the leaves of a tree of median splits,
    which is built from a sample and broadcast with the boxes of its nodes, so many images at a time as
    keep that small. Some neighbouring leaves are a region, held by one group: there a query meets its nearest
    leaf, whose k-th distance bounds what it need meet besides, then the region's other leaves within that
    reach; only what is left to look at in other regions is shuffled to those. ``apart``: no two
    candidates of an image have equal features.
    """
    right = candidates.select("image_id", F.col("i").alias("j"), *[F.col(f).alias(f"c_{f}") for f in features])
    left = queries.select("image_id", F.col("i").alias("q"), *features)
    sizes = cut(right.groupBy("image_id").agg(F.count("*").alias("n")))
    large = sizes.filter(F.col("n") > BLOCK)
    one = F.lit(0).cast("long").alias("block")
    if large.isEmpty():
        most = left.groupBy("image_id").count().agg(F.max("count"), F.sum("count")).first()
        if (most[0] or 0) <= QUERIES:
            return _meet_small(left, right, features, k, most[1] or 0)
        return _meet(left.select("*", one), right.select("*", one), features, k)
    leaves = large.agg(F.sum(F.least(F.lit(MOST_LEAVES), F.ceil(2 * F.col("n") / BLOCK)))).first()[0]
    turns = int(-(-leaves // BROADCAST_LEAVES))
    few = sizes.filter(F.col("n") <= BLOCK).select("image_id")
    parts = [] if few.isEmpty() else [_meet(left.join(small(few), "image_id", "left_semi").select("*", one), right.join(small(few), "image_id", "left_semi").select("*", one), features, k)]
    for turn in range(turns):
        mine = large.filter(F.pmod(F.xxhash64("image_id"), F.lit(turns)) == turn)
        if turns == 1 or not mine.isEmpty():
            ids = small(mine.select("image_id"))
            parts.append(_nearest_large(left.join(ids, "image_id", "left_semi"), right.join(ids, "image_id", "left_semi"), mine, features, k, apart))
    return reduce(DataFrame.unionByName, parts)


def _nearest_large(left: DataFrame, right: DataFrame, sizes: DataFrame, features: list[str], k: int, apart: bool) -> DataFrame:
    if not apart:  # of equal points only the k of smallest ids can be among the nearest, so a flat area fills no leaf
        same = Window.partitionBy("image_id", *[f"c_{f}" for f in features]).orderBy("j")
        right = right.withColumn("again", F.row_number().over(same)).filter(F.col("again") <= k).drop("again")
    context, named = left.sparkSession.sparkContext, right.withColumnsRenamed({f"c_{f}": f for f in features})
    trees = _trees(named.withColumnRenamed("j", "i"), features, sizes)
    kind = ", ".join(f"{f} double" for f in features)
    plain = [F.col(f).cast("double").alias(f) for f in features]
    held = context.broadcast(trees)
    at_leaf = lambda tree, rows, leaf: rows.assign(block=leaf, region=leaf >> (tree.depth - tree.top))
    dealt = _by_tree(named.select("image_id", "j", *plain), features, held, f"image_id long, j long, {kind}, block long, region long", lambda tree, rows, points: at_leaf(tree, rows, tree.leaf(points)))
    dealt = cut(dealt)
    for image, walls in boxes(dealt, features, ["image_id", "block"]).toPandas().groupby("image_id"):
        trees[int(image)].fit(walls["block"].to_numpy(), walls[[f"lo_{f}" for f in features]].to_numpy(), walls[[f"hi_{f}" for f in features]].to_numpy())
    held = context.broadcast(trees)
    home = cut(_by_tree(left.select("image_id", "q", *plain), features, held, f"image_id long, q long, {kind}, block long, region long", lambda tree, rows, at: at_leaf(tree, rows, tree.nearest(at))))
    right = dealt.select("image_id", "j", *[F.col(f).alias(f"c_{f}") for f in features], "block", "region")
    least, most = REGION_QUERIES
    queries = min(most, max(least, -(-home.count() // GROUPS)))

    def lists(point: np.ndarray, values: np.ndarray, n: int) -> list[np.ndarray]:
        return np.split(values, np.searchsorted(point, np.arange(1, n)))

    def first(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a):
            return pd.DataFrame({c: [] for c in ("image_id", "q", *features, "reach", "js", "ds", "regions")})
        tree, points, own, n = held.value[int(a["image_id"].iloc[0])], a[features].to_numpy(np.float64), a["block"].to_numpy(), len(a)
        region = Region(tree, int(a["region"].iloc[0]), b, features)
        found = region.best(k, region.meet(points, np.arange(n), own, k))
        found = region.best(k, found, region.inside(points, _bound(found[0], found[2], n, k), k, own))
        reach = _bound(found[0], found[2], n, k)
        point, other = tree.reached(points, reach, bottom=tree.top)
        point, other = point[other != region.node], other[other != region.node]
        out = a[["image_id", "q", *features]].assign(reach=reach)
        return out.assign(js=lists(found[0], region.ids[found[1]], n), ds=lists(found[0], found[2], n), regions=lists(point, other, n))

    def further(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"image_id": [], "q": [], "j": [], "dist2": []})
        region = Region(held.value[int(a["image_id"].iloc[0])], int(a["region"].iloc[0]), b, features)
        point, column, d = region.best(k, region.inside(a[features].to_numpy(np.float64), a["reach"].to_numpy(), k))
        return pd.DataFrame({"image_id": a["image_id"].iloc[0], "q": a["q"].to_numpy()[point], "j": region.ids[column], "dist2": d})

    met = cut(_paired(home, right, "region", queries, first, f"image_id long, q long, {kind}, reach double, js array<long>, ds array<double>, regions array<long>"))
    away = met.select("image_id", "q", *features, "reach", F.explode("regions").alias("region"))
    pairs = _paired(away, right, "region", queries, further, "image_id long, q long, j long, dist2 double")
    rows = lambda df: df.select("image_id", "q", F.posexplode(F.arrays_zip("js", "ds")).alias("at", "o")).select("image_id", "q", (F.col("at") + 1).alias("rank"), F.col("o.js").alias("j"), F.col("o.ds").alias("dist2"))
    is_open = F.size("regions") > 0
    return rows(met.filter(~is_open)).unionByName(_ranked(rows(met.filter(is_open)).drop("rank").unionByName(pairs), k))


#: Vectors of a block at most and at least, and the blocks in between.
VECTORS, LEAST_VECTORS, BLOCKS = 1 << 15, 1 << 11, 8
#: Queries that meet a block at once.
CHUNK = 256


def _exact(q: np.ndarray, c: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Squared distances of pairs of rows of ``q`` and ``c``, in one order of addition."""
    d = np.zeros(np.broadcast_shapes(row.shape, column.shape))
    for x in range(c.shape[1]):
        d += (q[row, x] - c[column, x]) ** 2
    return d


def _top(q: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, dist2): each query's k nearest, ties to the first.

    Products give distances up to an error that is bounded; the k-th least of the minima of 256 groups bounds
    the k-th distance, and what may come below it is computed exactly. Values that aren't finite go without.
    """
    groups = max(256, 4 * k)
    parts, own, other = len(c) // groups, (q * q).sum(1), (c * c).sum(1)
    plain = parts < 2 or not (np.isfinite(own).all() and np.isfinite(other).all())
    slack = 16 * (c.shape[1] + 4) * np.finfo(float).eps
    step = 64 if plain else CHUNK
    out = []
    for at in range(0, len(q), step):
        some = q[at : at + step]
        if plain:
            d = _exact(some, c, np.arange(len(some))[:, None], np.arange(len(c))[None, :])
            top = np.argsort(d, axis=1, kind="stable")[:, :k]
            row, column = np.repeat(np.arange(len(some)), top.shape[1]), top.ravel()
            out.append((at + row, column, d[row, column]))
            continue
        near = some @ c.T
        near *= -2
        near += other
        least = near[:, : parts * groups].reshape(len(some), parts, groups).min(1)
        bound = np.partition(least, k - 1, 1)[:, k - 1] + slack * (own[at : at + step] + other.max())
        row, column = np.divmod(np.flatnonzero(near <= bound[:, None]), len(c))
        d = _exact(some, c, row, column)
        order = np.lexsort((column, d, row))
        row, column, d = row[order], column[order], d[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        out.append((at + row[first], column[first], d[first]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def nearest_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """Exact neighbours among all rows of (i, v array<double>), one image: every two blocks meet once, in a task of their own, both ways."""
    n = vectors.count()
    blocks = max(1, -(-n // min(VECTORS, max(LEAST_VECTORS, -(-n // BLOCKS)))))
    rows = vectors.select("i", "v").withColumn("own", F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("int"))
    left = rows.withColumn("other", F.explode(F.sequence(F.col("own"), F.lit(blocks - 1))))
    right = rows.withColumnsRenamed({"own": "r_other"}).withColumn("r_own", F.explode(F.sequence(F.lit(0), F.col("r_other"))))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"q": np.zeros(0, np.int64), "j": np.zeros(0, np.int64), "dist2": np.zeros(0)})]
        if len(a) and len(b):
            a, b = a.sort_values("i"), b.sort_values("i")
            ends = [(x["i"].to_numpy(), np.stack(x["v"].to_numpy()).astype(np.float64)) for x in (a, b)]
            for (ids, q), (others, c) in (ends, ends[::-1])[: 1 if a["own"].iloc[0] == a["other"].iloc[0] else 2]:
                row, column, d = _top(q, c, k)
                out.append(pd.DataFrame({"q": ids[row], "j": others[column], "dist2": d}))
        return pd.concat(out)

    pairs = left.groupBy("own", "other").cogroup(right.groupBy("r_own", "r_other")).applyInPandas(meet, "q long, j long, dist2 double")
    order = Window.partitionBy("q").orderBy("dist2", "j")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("q", "rank", "j", "dist2")


def rebuilding_weights(z: np.ndarray, ridge: float = 1e-10) -> np.ndarray:
    """Weights (queries, k) that sum to one, of offsets ``z`` (queries, k, d); see ``lle_weights``."""
    k, d, zt = z.shape[1], z.shape[2], z.transpose(0, 2, 1)
    if k > d:
        w = 1 - (z @ np.linalg.solve(zt @ z + ridge * np.eye(d), zt.sum(2, keepdims=True)))[:, :, 0]
    else:
        w = np.linalg.solve(z @ zt + ridge * np.eye(k), np.ones((len(z), k, 1)))[:, :, 0]
    return w / w.sum(1, keepdims=True)


def lle_weights(found: DataFrame, points: DataFrame, features: list[str], ridge: float = 1e-10) -> DataFrame:
    """(image_id, q, j, v): weights that rebuild each query from its neighbours and sum to one.

    The ridge system (Z Z' + ridge I) w = 1 of a query's k offsets Z is solved through the
    d x d matrix (ridge I + Z' Z) of its d features, which stays well conditioned when k > d.
    One row per query with its neighbours' offsets reaches the kernel, which solves batches.
    """
    own = points.select("image_id", F.col("i").alias("q"), F.array(*features).alias("own"))
    near = points.select("image_id", F.col("i").alias("j"), F.array(*features).alias("z"))
    rows = found.select("image_id", "q", "rank", "j").join(wide(near), ["image_id", "j"])
    lists = rows.groupBy("image_id", "q").agg(F.array_sort(F.collect_list(F.struct("rank", "j", "z"))).alias("n"))

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k, part in frame.groupby(frame["js"].map(len)):
                own = np.stack(part["own"].to_list())
                z = np.stack(part["zs"].to_list()).reshape(len(part), k, -1) - own[:, None, :]
                w = rebuilding_weights(z, ridge)
                yield pd.DataFrame({"image_id": np.repeat(part["image_id"].to_numpy(), k), "q": np.repeat(part["q"].to_numpy(), k), "j": np.concatenate(part["js"].to_list()), "v": w.ravel()})

    packed = lists.select("image_id", "q", F.col("n.j").alias("js"), F.flatten("n.z").alias("zs")).join(wide(own), ["image_id", "q"])
    return packed.mapInPandas(solve, "image_id long, q long, j long, v double")
