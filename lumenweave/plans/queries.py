"""The engine's operators as registered queries over the shared tables, and equivalent SQL.

Every query runs over a whole table: ``part`` as one image (see ``sources.pixels``), or
``embeddings`` as points. Doubles are rounded to six digits, as sums come in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.functions import pixel as fx
from lumenweave.operators import affinity, color, grid, krylov, linalg, matte, multigrid, neighbors
from lumenweave.plans import oracle_sql as M
from lumenweave.plans.lineage import cut
from lumenweave.sources.pixels import PART_WIDTH, part_pixels

NEW_W, NEW_H = 23, 31
BOX_R = 2
#: Rows of an image where ``part`` is cut into many.
TILE_ROWS = 10
UNIFORM = [1.0] * 9
STENCIL = [0.0, 1.0, 0.0, 1.0, -4.0, 1.0, 0.0, 1.0, 0.0]


def r6(c: Column | str) -> Column:
    return F.round(c, 6) + F.lit(0.0)


def r4(c: Column | str) -> Column:
    return F.round(c, 4) + F.lit(0.0)


def _px(spark: SparkSession, sf_dir: str, alpha: bool = False) -> DataFrame:
    px = part_pixels(spark, sf_dir)
    return px.withColumn("alpha", fx.clip((32 - F.col("x")) / 24.0)) if alpha else px


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as many images of TILE_ROWS rows, so that operators that take an image a task have many tasks."""
    return part_pixels(spark, sf_dir, TILE_ROWS).withColumn("alpha", fx.clip((32 - F.col("x")) / 24.0))


def _v(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("i", *[c for c in ("j",) if c in df.columns], *[r6(c).alias(c) for c in columns or ("v",)])


def _t(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("image_id", "i", *[r6(c).alias(c) for c in columns])


def scan_pixels(spark, sf_dir):
    return _px(spark, sf_dir).select("i", "x", "y", r6("r").alias("r"), r6("g").alias("g"), r6("b").alias("b"), "t")


def rgb_to_gray(spark, sf_dir):
    return _px(spark, sf_dir).select("i", r6(fx.gray(F.col("r"), F.col("g"), F.col("b"))).alias("v"))


def quantize_u8(spark, sf_dir):
    return _px(spark, sf_dir).select("i", *[fx.to_byte(F.col(c) * 1.25 - 0.0625).alias(c) for c in "rgb"])


def outer_products(spark, sf_dir):
    v = [F.col(c) for c in "rgb"]
    return _px(spark, sf_dir).select("i", *[r6(c).alias(f"p_{a}{b}") for a, row in zip("rgb", fx.outer(v, v), strict=True) for b, c in zip("rgb", row, strict=True)])


def quadratic_forms(spark, sf_dir):
    """v' A w of each pixel with v = (r, g, b), A = outer(v, 1) and w = (1, t, b)."""
    v, one = [F.col(c) for c in "rgb"], F.lit(1.0)
    return _px(spark, sf_dir).select("i", r6(fx.quadratic(v, fx.outer(v, [one, one, one]), [one, F.col("t"), F.col("b")])).alias("v"))


def trimap_split(spark, sf_dir):
    return _px(spark, sf_dir).select("i", *[v.alias(k) for k, v in fx.trimap_flags(F.col("t")).items()])


def trimap_soft(spark, sf_dir):
    return _px(spark, sf_dir, True).select("i", *[v.alias(k) for k, v in fx.trimap_flags(F.col("alpha"), soft=True).items()])


def trimap_counts(spark, sf_dir):
    f = fx.trimap_flags(F.col("t"))
    return _px(spark, sf_dir).agg(F.count_if(f["is_fg"]).alias("n_fg"), F.count_if(f["is_bg"]).alias("n_bg"), F.count_if(f["is_unknown"]).alias("n_unknown"), F.min("t").alias("low"), F.max("t").alias("high"))


def validate_image(spark, sf_dir):
    """Of every four images one has no foreground, one no background, and one too much red."""
    k, t = F.col("image_id") % 4, F.col("t")
    spoilt = _tiles(spark, sf_dir).withColumns({"t": F.when((k == 0) | ((k == 1) & (t == 0)), 0.5).otherwise(t), "r": F.when(k == 2, 1.25 * F.col("r")).otherwise(F.col("r"))})
    return matte.validate(spoilt).select("image_id", "problem")


def pixel_grid(spark, sf_dir):
    n = _px(spark, sf_dir).count()
    return grid.grid(spark, PART_WIDTH, -(-n // PART_WIDTH))


def window_3x3(spark, sf_dir):
    return grid.taps(_px(spark, sf_dir), grid.NINE).select(F.col("c").alias("i"), "off", "j")


def stencil_coo(spark, sf_dir):
    return _v(grid.stencil_matrix(_px(spark, sf_dir), grid.NINE, STENCIL))


def uniform_laplacian(spark, sf_dir):
    return _v(linalg.laplacian(grid.stencil_matrix(_px(spark, sf_dir), grid.NINE, UNIFORM)))


def resize_nearest(spark, sf_dir):
    return grid.resize_nearest(_px(spark, sf_dir), NEW_W, NEW_H, ["r8", "g8", "b8"]).select("i", "r8", "g8", "b8")


def resize_bilinear(spark, sf_dir):
    return _v(grid.resize_bilinear(_px(spark, sf_dir), NEW_W, NEW_H, ["r", "g", "b"]), "r", "g", "b")


def _box(mode):
    return lambda spark, sf_dir: grid.box_sums(_px(spark, sf_dir), BOX_R, ["r8", "g8"], mode).select("x", "y", F.col("r8").alias("r"), F.col("g8").alias("g"))


def dilate(spark, sf_dir):
    return grid.dilate(_px(spark, sf_dir), F.col("r8") > 240, BOX_R).select("x", "y", "grown")


def window_moments(spark, sf_dir):
    return grid.window_moments(_px(spark, sf_dir)).drop("image_id")


def cf_affinity(spark, sf_dir):
    return _v(affinity.closed_form_affinity(_px(spark, sf_dir)))


def cf_laplacian(spark, sf_dir):
    return _v(affinity.closed_form_laplacian(_px(spark, sf_dir)))


def cf_system(spark, sf_dir):
    px = _px(spark, sf_dir)
    a, b = linalg.system(affinity.closed_form_laplacian(px), px)
    return _v(a.unionByName(b.withColumn("j", F.lit(-1).cast("long"))))


def _w(spark, sf_dir):
    return grid.stencil_matrix(_px(spark, sf_dir), grid.NINE, STENCIL)


def _x(spark, sf_dir):
    return _px(spark, sf_dir).select("image_id", "i", F.col("r").alias("v"))


def coo_add(spark, sf_dir):
    w = _w(spark, sf_dir)
    return _v(linalg.add(w, linalg.scale(linalg.diagonal(_x(spark, sf_dir)), 2.0)))


def coo_transpose(spark, sf_dir):
    return _v(linalg.transpose(linalg.scale_rows(_w(spark, sf_dir), _x(spark, sf_dir))))


def coo_symmetrise(spark, sf_dir):
    return _v(linalg.symmetrise(linalg.scale_rows(_w(spark, sf_dir), _x(spark, sf_dir))))


def coo_triangles(spark, sf_dir):
    w = _w(spark, sf_dir)
    return linalg.lower(w).withColumn("part", F.lit("lower")).unionByName(linalg.upper(w).withColumn("part", F.lit("upper"))).select("part", "i", "j", r6("v").alias("v"))


def matvec(spark, sf_dir):
    return _v(linalg.matvec(_w(spark, sf_dir), _x(spark, sf_dir)))


def matmat(spark, sf_dir):
    w = _w(spark, sf_dir)
    return _v(linalg.matmat(w, w))


def row_sum(spark, sf_dir):
    return _v(linalg.row_sums(linalg.scale_rows(_w(spark, sf_dir), _x(spark, sf_dir))))


def inner_product(spark, sf_dir):
    x = _x(spark, sf_dir)
    return linalg.dot(x, linalg.matvec(_w(spark, sf_dir), x)).select(r6("v").alias("v"))


def knn_embeddings(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("i"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return neighbors.nearest_vectors(v, 10).select("q", "rank", "j", F.round("dist2", 6).alias("dist2"))


def knn_graph(spark, sf_dir):
    return _v(affinity.knn_graph(_px(spark, sf_dir)))


def knn_laplacian(spark, sf_dir):
    return _v(affinity.knn_laplacian(_px(spark, sf_dir)))


def label_expand_1(spark, sf_dir):
    return _v(affinity.expand_labels(_px(spark, sf_dir), 1, 0.25), "t")


def edge_trim(spark, sf_dir):
    return _t(affinity.trim_edges(_tiles(spark, sf_dir)), "t")


def _unknown() -> Column:
    return ~((F.col("t") > 0.8) | (F.col("t") < 0.2))


def color_similarity(spark, sf_dir):
    return _v(affinity.color_similarity(_px(spark, sf_dir), 5, 0.05, _unknown(), _unknown()))


def patch_bhattacharyya(spark, sf_dir):
    return _v(affinity.patch_distances(_px(spark, sf_dir)), "fg", "bg")


def patch_trim(spark, sf_dir):
    return _v(affinity.trim_patches(_px(spark, sf_dir)), "t")


def local_affinity(spark, sf_dir):
    return _v(affinity.local_affinity(_px(spark, sf_dir)))


def lle_weights(spark, sf_dir):
    return affinity.color_mixture(_px(spark, sf_dir), 20, 1.0, _unknown()).select("i", "j", F.round("v", 4).alias("v"))


def known_unknown_mixture(spark, sf_dir):
    return affinity.known_to_unknown(_px(spark, sf_dir)).select("i", F.round("alpha", 4).alias("alpha"), F.round("confidence", 4).alias("confidence"))


def ifm_system(spark, sf_dir):
    """Entries of A with b as column -1."""
    a, b = affinity.information_flow_system(_px(spark, sf_dir))
    return a.unionByName(b.withColumn("j", F.lit(-1).cast("long"))).select("i", "j", (F.round("v", 3) + F.lit(0.0)).alias("v"))


def running_sums(spark, sf_dir):
    return grid.running_sums(_px(spark, sf_dir), ["r8", "g8"]).select("x", "y", F.col("r8").alias("r"), F.col("g8").alias("g"))


def windows_at(spark, sf_dir):
    px = _px(spark, sf_dir)
    return grid.windows_at(px, px.filter("r8 > 240"), 1, ["r8"]).select(F.col("c").alias("i"), "off", "j", F.col("n_r8").alias("v"))


def box_fill(spark, sf_dir):
    return grid.box_sums(_px(spark, sf_dir), BOX_R, ["r8", "g8"], "same", 7).select("x", "y", F.col("r8").alias("r"), F.col("g8").alias("g"))


def lkm_apply(spark, sf_dir):
    px = _px(spark, sf_dir)
    return _v(affinity.large_kernel_apply(px, _x(spark, sf_dir), 2))


def lkm_diagonal(spark, sf_dir):
    return _v(affinity.large_kernel_diagonal(_px(spark, sf_dir), 2))


def restrict(spark, sf_dir):
    px = _px(spark, sf_dir)
    w2, h2 = PART_WIDTH // 2, px.select("h").first()["h"] // 2
    taps = [(dx, dy, (2 - abs(dx)) * (2 - abs(dy)) / 16.0) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    table = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(k).alias("k")) for a, b, k in taps])
    coarse = grid.grid(spark, w2, h2).withColumn("o", F.explode(table)).select("i", (2 * F.col("x") + F.col("o.dx")).alias("x"), (2 * F.col("y") + F.col("o.dy")).alias("y"), "o.k")
    return _v(coarse.join(px.select("x", "y", "r"), ["x", "y"]).groupBy("i").agg(F.sum(F.col("k") * F.col("r")).alias("v")))


def _system(spark, sf_dir):
    px = _px(spark, sf_dir)
    a, b = linalg.system(affinity.closed_form_laplacian(px), px)
    return cut(a), b


def jacobi_3(spark, sf_dir):
    a, b = _system(spark, sf_dir)
    return _v(linalg.jacobi(a, b, 3))


def alpha_jacobi_3(spark, sf_dir):
    a, b = _system(spark, sf_dir)
    return linalg.jacobi(a, b, 3).select("i", r6(fx.clip(F.col("v"))).alias("alpha"))


def cg_3(spark, sf_dir):
    a, b = _system(spark, sf_dir)
    return _v(linalg.conjugate_gradients(a, b, 3))


_FB = ["f_r", "f_g", "f_b", "b_r", "b_g", "b_b"]


def fb_ml_level(spark, sf_dir):
    """The coarsest level of the whole table as one image, by tables."""
    return _v(color.estimate_multilevel(_px(spark, sf_dir, True), levels=1, in_tasks=False), *_FB)


def fb_ml(spark, sf_dir):
    """All levels of many images, each a task."""
    return _t(color.estimate_multilevel(_tiles(spark, sf_dir)), *_FB)


def fb_ml_sizes(spark, sf_dir):
    """Images of 8 to 13 rows in one call, by tables: as many levels and sizes as images need."""
    return _t(color.estimate_foreground_background(_sizes(spark, sf_dir), "ml", in_tasks=False), *_FB)


def _sizes(spark, sf_dir):
    """``part`` as images of width 40 whose heights go from 8 to 13 in turn."""
    px, at = _px(spark, sf_dir, True), F.col("y") % 63
    tops = [0, 8, 17, 27, 38, 50, 63]
    k = sum((F.when(at >= t, 1).otherwise(0) for t in tops[2:-1]), F.when(at >= tops[1], 1).otherwise(0))
    top = (F.floor(F.col("y") / 63) * 63 + F.element_at(F.array(*[F.lit(t) for t in tops]), F.col("k") + 1)).cast("int")
    high = F.least(F.element_at(F.array(*[F.lit(b - a) for a, b in zip(tops, tops[1:])]), F.col("k") + 1), F.col("h") - F.col("top")).cast("int")
    px = px.withColumn("k", k).withColumn("top", top).withColumn("tall", high)
    return px.withColumns({"image_id": (F.floor(F.col("y") / 63) * 6 + F.col("k")).cast("long"), "i": F.col("i") - F.col("top").cast("long") * F.col("w"), "y": F.col("y") - F.col("top"), "h": F.col("tall")}).drop("k", "top", "tall")


def fb_cf(spark, sf_dir):
    """Solved far below the default tolerance, as the mattes are."""
    out = color.estimate_closed_form(_tiles(spark, sf_dir), rtol=1e-13, max_iter=5000)
    return out.select("image_id", "i", *[F.round(c, 3).alias(c) for c in _FB])


def fb_cf_5(spark, sf_dir):
    """Five steps over tables on the whole table as one image, three channels in one state."""
    return _v(color.estimate_closed_form(_px(spark, sf_dir, True), rtol=1e-13, max_iter=5, in_tasks=False), *_FB)


def lkm_cg_4(spark, sf_dir):
    """Four preconditioned steps over tables with window sums in the matrix' place, on the whole table as one image."""
    return _v(matte.solve_large_kernel_tables(_px(spark, sf_dir), 2, 1e-7, 100.0, "jacobi", atol=1e-12, max_iterations=4), "x")


def vcycle(spark, sf_dir):
    """One V-cycle for the closed-form system, from a hierarchy of tables down to 256 unknowns or fewer."""
    a, b = _system(spark, sf_dir)
    return _v(multigrid.Hierarchy(a, _px(spark, sf_dir)).cycle(b))


def gauss_seidel(spark, sf_dir):
    """One sweep over nine colours for the closed-form system."""
    a, b = _system(spark, sf_dir)
    return _v(multigrid.gauss_seidel(a, b, multigrid.colours(_px(spark, sf_dir))))


def least_squares_4(spark, sf_dir):
    """Four steps for a table whose row k * 10^9 + i holds the difference of pixel i to its left (0) or upper (1) neighbour, or (2) a tenth of the pixel itself; right sides r and g of the pixel."""
    px = _px(spark, sf_dir)
    big = F.lit(1_000_000_000).cast("long")
    entry = lambda k, j, v, ok: F.when(ok, F.struct((k * big + F.col("i")).alias("i"), j.alias("j"), F.lit(v).alias("v")))
    i, left, up = F.col("i"), F.col("x") > 0, F.col("y") > 0
    cells = [entry(0, i, 1.0, left), entry(0, i - 1, -1.0, left), entry(1, i, 1.0, up), entry(1, i - F.col("w"), -1.0, up), entry(2, i, 0.1, F.lit(True))]
    a = px.select("image_id", F.inline(F.array_compact(F.array(*cells))))
    b = px.select("image_id", F.explode(F.array(*[(k * big + i) for k in range(3)])).alias("i"), "r", "g")
    return _v(krylov.least_squares(a, b, ["r", "g"], 4), "x_r", "x_g")


def blend(spark, sf_dir):
    px = _px(spark, sf_dir, True).withColumns({f"o_{c}": 1 - F.col(c) for c in "rgb"})
    return _v(color.blend(px, ["r", "g", "b"], ["o_r", "o_g", "o_b"], "alpha"), "r", "g", "b")


def stack(spark, sf_dir):
    px = _px(spark, sf_dir, True)
    return color.stack(px.select("image_id", "i", "r8", "g8"), px.select("image_id", "i", "b8")).select("i", "r8_0", "g8_0", "b8_1")


def guided_filter(spark, sf_dir):
    return _v(color.guided_filter(_px(spark, sf_dir, True), "alpha", 2))


def fast_guided_filter(spark, sf_dir):
    return _v(color.fast_guided_filter(_px(spark, sf_dir, True), "alpha", 8))


def _alpha(method, preconditioner):
    """Many images, solved far below the default tolerance, so that a result doesn't depend on the solver."""
    if method == "ifm":  # row-normalised weights make this system unsymmetric, and its answer depend on the path
        return lambda spark, sf_dir: matte.alpha(_tiles(spark, sf_dir), method, preconditioner).select("image_id", "i", F.round("alpha", 2).alias("alpha"))
    return lambda spark, sf_dir: matte.alpha(_tiles(spark, sf_dir), method, preconditioner, radius=2, absolute_tolerance=1e-9).select("image_id", "i", r4("alpha").alias("alpha"))


QUERIES = {
    f.__name__: f
    for f in (
        alpha_jacobi_3, scan_pixels, rgb_to_gray, quantize_u8, outer_products, quadratic_forms, trimap_split, trimap_soft, trimap_counts, validate_image, pixel_grid, window_3x3, stencil_coo, uniform_laplacian,
        resize_nearest, resize_bilinear, dilate, window_moments, cf_affinity, cf_laplacian, cf_system, coo_add, coo_transpose, coo_symmetrise, coo_triangles, matvec, matmat,
        row_sum, inner_product, running_sums, windows_at, box_fill, knn_embeddings, knn_graph, knn_laplacian, label_expand_1, edge_trim, color_similarity, patch_bhattacharyya, patch_trim, local_affinity,
        lle_weights, known_unknown_mixture, ifm_system, lkm_apply, lkm_diagonal, restrict, jacobi_3, cg_3, vcycle, gauss_seidel, least_squares_4, lkm_cg_4, fb_cf, fb_cf_5, fb_ml, fb_ml_level, fb_ml_sizes, blend, stack, guided_filter, fast_guided_filter,
    )
} | {f"box_{m}": _box(m) for m in ("valid", "same", "full")}
QUERIES |= {f"alpha_{m}_{p or 'none'}": _alpha(m, p) for m, ps in matte.METHODS.items() for p in ps}

# SQL for DuckDB


def _pixels_sql(images: str) -> str:
    """CTEs dims, px, nine and taps over ``images``, SQL of (img, top, h): row spans of the table.

    i runs through the table; base is an image's first; yl counts rows within the image, and y keeps
    images so far apart that no window reaches from one into another.
    """
    return f"""
whole AS (SELECT (max(p_partkey) // 40 + 1)::INTEGER AS rows FROM part),
dims AS (SELECT img::BIGINT AS img, (top * 40)::BIGINT AS base, top::INTEGER AS top, 40 AS w, h::INTEGER AS h FROM ({images})),
px0 AS (SELECT p_partkey::BIGINT AS i, img, base, (p_partkey % 40)::INTEGER AS x, (p_partkey // 40 - top + 1000000 * img)::INTEGER AS y, (p_partkey // 40 - top)::INTEGER AS yl, w, h,
  (5 * p_size)::BIGINT AS r8, (6 * (p_partkey % 40) + p_size % 16)::BIGINT AS g8, ((4 * (p_partkey // 40) + p_size) % 256)::BIGINT AS b8 FROM part JOIN dims ON p_partkey // 40 >= top AND p_partkey // 40 < top + h),
px AS (SELECT *, r8 / 255.0::DOUBLE AS r, g8 / 255.0::DOUBLE AS g, b8 / 255.0::DOUBLE AS b,
  CASE WHEN x < 8 THEN 1.0 WHEN x >= 32 THEN 0.0 ELSE 0.5 END::DOUBLE AS t, greatest(0.0, least(1.0, (32 - x) / 24.0))::DOUBLE AS alpha FROM px0),
nine AS (SELECT (3 * (dx + 1) + dy + 1)::INTEGER AS off, dx, dy FROM (SELECT unnest(range(-1, 2)) AS dx) a, (SELECT unnest(range(-1, 2)) AS dy) b),
taps AS (SELECT i AS c, off, (greatest(0, least(w - 1, x + dx)) + greatest(0, least(h - 1, yl + dy)) * w + base)::BIGINT AS j FROM px, nine)
"""


_PX = _pixels_sql("SELECT 0 AS img, 0 AS top, rows AS h FROM whole")
_TILES = _pixels_sql(f"SELECT img, img * {TILE_ROWS} AS top, least({TILE_ROWS}, rows - img * {TILE_ROWS}) AS h FROM whole, LATERAL (SELECT unnest(range((rows + {TILE_ROWS - 1}) // {TILE_ROWS})) AS img)")
_HEIGHTS = _pixels_sql(
    "SELECT 6 * block + k AS img, 63 * block + [0, 8, 17, 27, 38, 50][k + 1] AS top, least(8 + k, rows - (63 * block + [0, 8, 17, 27, 38, 50][k + 1])) AS h"
    " FROM whole, LATERAL (SELECT unnest(range(rows // 63 + 1)) AS block) a, (SELECT unnest(range(6)) AS k) b WHERE 63 * block + [0, 8, 17, 27, 38, 50][k + 1] < rows"
)
_W = _PX + """,
w AS (SELECT c AS i, j, sum(CASE WHEN off = 4 THEN -4.0 WHEN off % 2 = 1 THEN 1.0 ELSE 0.0 END) AS v FROM taps GROUP BY 1, 2)
"""
_MOMENTS = _PX + """,
m AS (SELECT c AS i, sum(r8)::BIGINT AS s_r, sum(g8)::BIGINT AS s_g, sum(b8)::BIGINT AS s_b,
  (9 * sum(r8 * r8) - sum(r8) * sum(r8))::BIGINT AS c_rr, (9 * sum(r8 * g8) - sum(r8) * sum(g8))::BIGINT AS c_rg, (9 * sum(r8 * b8) - sum(r8) * sum(b8))::BIGINT AS c_rb,
  (9 * sum(g8 * g8) - sum(g8) * sum(g8))::BIGINT AS c_gg, (9 * sum(g8 * b8) - sum(g8) * sum(b8))::BIGINT AS c_gb, (9 * sum(b8 * b8) - sum(b8) * sum(b8))::BIGINT AS c_bb
  FROM taps JOIN px ON px.i = taps.j GROUP BY c)
"""
_INV = """,
e{0} AS (SELECT i, s_r, s_g, s_b, c_rr + k AS rr, c_rg::DOUBLE AS rg, c_rb::DOUBLE AS rb, c_gg + k AS gg, c_gb::DOUBLE AS gb, c_bb + k AS bb FROM m{0}, (SELECT (9.0 * 255.0 * 255.0 * 1e-7)::DOUBLE AS k)),
f{0} AS (SELECT *, gg * bb - gb * gb AS krr, rb * gb - rg * bb AS krg, rg * gb - rb * gg AS krb, rr * bb - rb * rb AS kgg, rb * rg - rr * gb AS kgb, rr * gg - rg * rg AS kbb FROM e{0}),
n{0} AS (SELECT i, s_r, s_g, s_b, krr / det AS krr, krg / det AS krg, krb / det AS krb, kgg / det AS kgg, kgb / det AS kgb, kbb / det AS kbb FROM (SELECT *, rr * krr + rg * krg + rb * krb AS det FROM f{0})),
d{0} AS (SELECT c, off, j, (9 * r8 - s_r)::DOUBLE AS dr, (9 * g8 - s_g)::DOUBLE AS dg, (9 * b8 - s_b)::DOUBLE AS db, krr, krg, krb, kgg, kgb, kbb FROM taps JOIN px ON px.i = taps.j JOIN n{0} n ON n.i = taps.c),
aff{0} AS (SELECT p.j AS i, q.j AS j, sum(1 + p.dr * (p.krr * q.dr + p.krg * q.dg + p.krb * q.db) + p.dg * (p.krg * q.dr + p.kgg * q.dg + p.kgb * q.db) + p.db * (p.krb * q.dr + p.kgb * q.dg + p.kbb * q.db)) AS v
  FROM d{0} p JOIN d{0} q ON p.c = q.c GROUP BY 1, 2)
"""
_CF = _MOMENTS + _INV.format("") + """,
lap AS (SELECT i, j, sum(v) AS v FROM (SELECT i, j, -v / 81.0 AS v FROM aff UNION ALL SELECT i, i, 1.0 FROM px) GROUP BY 1, 2)
"""
_SYS = _CF.replace("\nlap AS", "\nlap AS MATERIALIZED") + """,
a AS MATERIALIZED (SELECT i, j, sum(v) AS v FROM (SELECT * FROM lap UNION ALL SELECT i, i, 100.0 FROM px WHERE t IN (0.0, 1.0)) GROUP BY 1, 2),
b AS (SELECT i, CASE WHEN t = 1.0 THEN 100.0 ELSE 0.0 END::DOUBLE AS v FROM px),
dg AS (SELECT i, v FROM a WHERE i = j)
"""
_JACOBI = _SYS + """,
x1 AS MATERIALIZED (SELECT b.i, 0.8 * b.v / dg.v AS v FROM b JOIN dg USING (i)),
x2 AS MATERIALIZED (SELECT b.i, x1.v + 0.8 * (b.v - s.v) / dg.v AS v FROM b JOIN dg USING (i) JOIN x1 USING (i) JOIN (SELECT a.i, sum(a.v * x1.v) AS v FROM a JOIN x1 ON x1.i = a.j GROUP BY a.i) s USING (i)),
x3 AS (SELECT b.i, x2.v + 0.8 * (b.v - s.v) / dg.v AS v FROM b JOIN dg USING (i) JOIN x2 USING (i) JOIN (SELECT a.i, sum(a.v * x2.v) AS v FROM a JOIN x2 ON x2.i = a.j GROUP BY a.i) s USING (i))
"""


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes} {select}"


def _r(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c.split('.')[-1]}" for c in columns)


def _box_sql(mode: str) -> str:
    r = BOX_R
    low, high = {"valid": (r, -r), "same": (0, 0), "full": (-r, r)}[mode]
    return _with(
        _PX,
        f"""SELECT cx::INTEGER AS x, cy::INTEGER AS y, coalesce(sum(r8), 0)::BIGINT AS r, coalesce(sum(g8), 0)::BIGINT AS g
        FROM (SELECT unnest(range({low}, w + {high})) AS cx, h FROM dims) a, LATERAL (SELECT unnest(range({low}, a.h + {high})) AS cy) b
        LEFT JOIN px ON px.x BETWEEN cx - {r} AND cx + {r} AND px.y BETWEEN cy - {r} AND cy + {r} GROUP BY cx, cy""",
    )


def _knn_sql(scale: float, k: int) -> str:
    return f"""SELECT least(q, j) AS a, greatest(q, j) AS b FROM (
      SELECT p.i AS q, c.i AS j, row_number() OVER (PARTITION BY p.i ORDER BY (((pow(p.r - c.r, 2) + pow(p.g - c.g, 2)) + pow(p.b - c.b, 2)) + pow(p.fx - c.fx, 2)) + pow(p.fy - c.fy, 2), c.i) AS n
      FROM {scale_name(scale)} p JOIN {scale_name(scale)} c USING (img)) WHERE n <= {k}"""


def scale_name(scale: float) -> str:
    return "near1" if scale == 1.0 else "near2"


_KNN = _PX + f""",
near1 AS (SELECT i, img, r, g, b, (x + 1) / (sqrt((w * w + h * h)::DOUBLE) / 2.0) AS fx, (yl + 1) / (sqrt((w * w + h * h)::DOUBLE) / 2.0) AS fy FROM px),
near2 AS (SELECT i, img, r, g, b, 0.01::DOUBLE * (x + 1) / (sqrt((w * w + h * h)::DOUBLE) / 2.0) AS fx, 0.01::DOUBLE * (yl + 1) / (sqrt((w * w + h * h)::DOUBLE) / 2.0) AS fy FROM px),
edges AS (SELECT DISTINCT a, b FROM ({_knn_sql(1.0, 10)} UNION ALL {_knn_sql(0.01, 2)})),
graph AS (SELECT i, j, sum(v) AS v FROM (SELECT a AS i, b AS j, 1.0 AS v FROM edges UNION ALL SELECT b, a, 1.0 FROM edges) GROUP BY 1, 2)
"""
_NEAREST = """SELECT q.i, s.{0} FROM q JOIN px s ON s.i = q.j"""
_LEVEL = _PX + """,
size AS (SELECT CASE WHEN w < h THEN 2 ELSE ceil(2.0 * w / h)::INTEGER END AS lw, CASE WHEN w < h THEN ceil(2.0 * h / w)::INTEGER ELSE 2 END AS lh FROM dims),
spot AS (SELECT (x + y * lw)::BIGINT AS i, x, y, lw, lh, (least(w - 1, floor(x * w / lw::DOUBLE)) + least(h - 1, floor(y * h / lh::DOUBLE)) * w)::BIGINT AS src
  FROM dims, size, LATERAL (SELECT unnest(range(lw)) AS x) a, LATERAL (SELECT unnest(range(lh)) AS y) b),
l0 AS (SELECT q.i, 0::BIGINT AS img, q.x, q.y, lw, lh, r, g, b, alpha, r AS f_r, g AS f_g, b AS f_b, r AS b_r, g AS b_g, b AS b_b FROM spot q JOIN px ON px.i = q.src),
four AS (SELECT * FROM (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) AS o(dx, dy))
"""


def _pass_sql(old: str, new: str) -> str:
    rgb = "rgb"
    near = ", ".join(f"sum(d * n.{s}_{c}) AS s_{s}{c}" for s in "fb" for c in rgb)
    solved = ", ".join(
        f"greatest(0.0, least(1.0, ((q2 * (alpha * {c} + s_f{c})) - (q01 * ((1 - alpha) * {c} + s_b{c}))) / det)) AS f_{c}, greatest(0.0, least(1.0, ((q1 * ((1 - alpha) * {c} + s_b{c})) - (q01 * (alpha * {c} + s_f{c}))) / det)) AS b_{c}"
        for c in rgb
    )
    return f""",
g{new} AS (SELECT l.i, sum(d) AS d, {near} FROM (
    SELECT l.i, (greatest(0, least(lw - 1, x + dx)) + greatest(0, least(lh - 1, y + dy)) * lw + img * 1000000000)::BIGINT AS j, alpha FROM {old} l, four) l
  JOIN {old} n ON n.i = l.j, LATERAL (SELECT 1e-5 + abs(l.alpha - n.alpha) AS d) k GROUP BY l.i),
{new} AS (SELECT i, img, x, y, lw, lh, r, g, b, alpha, {solved} FROM (
  SELECT *, alpha * alpha + d AS q1, alpha * (1 - alpha) AS q01, (1 - alpha) * (1 - alpha) + d AS q2, (alpha * alpha + d) * ((1 - alpha) * (1 - alpha) + d) - alpha * (1 - alpha) * alpha * (1 - alpha) AS det
  FROM {old} JOIN g{new} USING (i)))
"""


ORACLES = {
    "scan_pixels": _with(_PX, f"SELECT i, x, y, {_r('r', 'g', 'b')}, t FROM px"),
    "rgb_to_gray": _with(_PX, "SELECT i, round((299 * r + 587 * g + 114 * b) / 1000, 6) + 0.0 AS v FROM px"),
    "quantize_u8": _with(_PX, "SELECT i, " + ", ".join(f"trunc(greatest(0.0, least(255.0, ({c} * 1.25::DOUBLE - 0.0625::DOUBLE) * 255)))::INTEGER AS {c}" for c in "rgb") + " FROM px"),
    "trimap_split": _with(_PX, "SELECT i, t = 1.0 AS is_fg, t = 0.0 AS is_bg, t IN (0.0, 1.0) AS is_known, t NOT IN (0.0, 1.0) AS is_unknown FROM px"),
    "trimap_soft": _with(_PX, "SELECT i, alpha > 0.8::DOUBLE AS is_fg, alpha < 0.2::DOUBLE AS is_bg, alpha > 0.8::DOUBLE OR alpha < 0.2::DOUBLE AS is_known, NOT (alpha > 0.8::DOUBLE OR alpha < 0.2::DOUBLE) AS is_unknown FROM px"),
    "trimap_counts": _with(_PX, "SELECT count(*) FILTER (t = 1.0) AS n_fg, count(*) FILTER (t = 0.0) AS n_bg, count(*) FILTER (t NOT IN (0.0, 1.0)) AS n_unknown, min(t) AS low, max(t) AS high FROM px"),
    "validate_image": _with(
        _TILES
        + """,
spoilt AS (SELECT img, CASE WHEN img % 4 = 0 OR (img % 4 = 1 AND t = 0) THEN 0.5 ELSE t END AS t, CASE WHEN img % 4 = 2 THEN 1.25 ELSE 1.0 END * r AS r FROM px)""",
        """SELECT img AS image_id, CASE WHEN max(r) > 1 THEN 'values lie outside 0 to 1' WHEN count(*) FILTER (t = 1) = 0 THEN 'the trimap has no foreground' ELSE 'the trimap has no background' END AS problem
        FROM spoilt GROUP BY img HAVING max(r) > 1 OR count(*) FILTER (t = 1) = 0 OR count(*) FILTER (t = 0) = 0""",
    ),
    "pixel_grid": _with(_PX, "SELECT (x + y * w)::BIGINT AS i, x::INTEGER AS x, y::INTEGER AS y FROM dims, LATERAL (SELECT unnest(range(w)) AS x) a, LATERAL (SELECT unnest(range(h)) AS y) b"),
    "window_3x3": _with(_PX, "SELECT c AS i, off, j FROM taps"),
    "stencil_coo": _with(_W, f"SELECT i, j, {_r('v')} FROM w"),
    "uniform_laplacian": _with(_PX, f"SELECT i, j, {_r('v')} FROM (SELECT i, j, sum(v) AS v FROM (SELECT c AS i, j, -1.0::DOUBLE / 9.0 AS v FROM taps UNION ALL SELECT i, i, 1.0 FROM px) GROUP BY 1, 2)"),
    "resize_nearest": _with(_PX, f"SELECT q.i, r8, g8, b8 FROM (SELECT (x + y * {NEW_W})::BIGINT AS i, (least(w - 1, floor(x * w / {NEW_W}.0::DOUBLE)) + least(h - 1, floor(y * h / {NEW_H}.0::DOUBLE)) * w)::BIGINT AS j FROM dims, (SELECT unnest(range({NEW_W})) AS x) a, (SELECT unnest(range({NEW_H})) AS y) b) q JOIN px ON px.i = q.j"),
    "resize_bilinear": _with(
        _PX,
        f"""SELECT q.i, {", ".join(f"round(sum(k * {c}), 6) + 0.0 AS {c}" for c in "rgb")} FROM (
        SELECT i, (greatest(0, least(w - 1, x0 + dx)) + greatest(0, least(h - 1, y0 + dy)) * w)::BIGINT AS j, (CASE WHEN dx = 1 THEN fx - x0 ELSE 1 - (fx - x0) END) * (CASE WHEN dy = 1 THEN fy - y0 ELSE 1 - (fy - y0) END) AS k
        FROM (SELECT *, floor(fx) AS x0, floor(fy) AS y0 FROM (SELECT (x + y * {NEW_W})::BIGINT AS i, w, h, (x + 0.5) * w / {NEW_W}.0::DOUBLE - 0.5 AS fx, (y + 0.5) * h / {NEW_H}.0::DOUBLE - 0.5 AS fy FROM dims, (SELECT unnest(range({NEW_W})) AS x) a, (SELECT unnest(range({NEW_H})) AS y) b)),
        (SELECT unnest([0, 1]) AS dx) c, (SELECT unnest([0, 1]) AS dy) d) q JOIN px ON px.i = q.j GROUP BY q.i""",
    ),
    "box_valid": _box_sql("valid"),
    "box_same": _box_sql("same"),
    "box_full": _box_sql("full"),
    "dilate": _with(_PX, f"SELECT p.x, p.y, bool_or(q.r8 > 240) AS grown FROM px p JOIN px q ON q.x BETWEEN p.x - {BOX_R} AND p.x + {BOX_R} AND q.y BETWEEN p.y - {BOX_R} AND p.y + {BOX_R} GROUP BY p.x, p.y"),
    "window_moments": _with(_MOMENTS, "SELECT * FROM m"),
    "cf_affinity": _with(_CF, f"SELECT i, j, {_r('v')} FROM aff"),
    "cf_laplacian": _with(_CF, f"SELECT i, j, {_r('v')} FROM lap"),
    "cf_system": _with(_SYS, f"SELECT i, j, {_r('v')} FROM (SELECT i, j, v FROM a UNION ALL SELECT i, -1, v FROM b)"),
    "coo_add": _with(_W, f"SELECT i, j, {_r('v')} FROM (SELECT i, j, sum(v) AS v FROM (SELECT * FROM w UNION ALL SELECT i, i, 2.0 * r FROM px) GROUP BY 1, 2)"),
    "coo_transpose": _with(_W, f"SELECT w.j AS i, w.i AS j, round(w.v * px.r, 6) + 0.0 AS v FROM w JOIN px ON px.i = w.i"),
    "coo_symmetrise": _with(_W, f"SELECT i, j, {_r('v')} FROM (SELECT i, j, sum(v) AS v FROM (SELECT w.i, w.j, w.v * px.r AS v FROM w JOIN px ON px.i = w.i UNION ALL SELECT w.j, w.i, w.v * px.r FROM w JOIN px ON px.i = w.i) GROUP BY 1, 2)"),
    "coo_triangles": _with(_W, f"SELECT CASE WHEN i >= j THEN 'lower' ELSE 'upper' END AS part, i, j, {_r('v')} FROM w"),
    "matvec": _with(_W, "SELECT w.i, round(sum(w.v * px.r), 6) + 0.0 AS v FROM w JOIN px ON px.i = w.j GROUP BY w.i"),
    "matmat": _with(_W, "SELECT a.i, b.j, round(sum(a.v * b.v), 6) + 0.0 AS v FROM w a JOIN w b ON a.j = b.i GROUP BY 1, 2"),
    "row_sum": _with(_W, "SELECT w.i, round(sum(w.v * px.r), 6) + 0.0 AS v FROM w JOIN px ON px.i = w.i GROUP BY w.i"),
    "inner_product": _with(_W, "SELECT round(sum(p.r * w.v * q.r), 6) + 0.0 AS v FROM w JOIN px p ON p.i = w.i JOIN px q ON q.i = w.j"),
    "knn_embeddings": """SELECT q, n::INTEGER AS rank, j, round(dist2, 6) AS dist2 FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist2, j) AS n FROM (
        SELECT a.vec_id AS q, b.vec_id AS j, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist2
        FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) a, (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) b)) WHERE n <= 10""",
    "knn_graph": _with(_KNN, f"SELECT i, j, {_r('v')} FROM graph"),
    "knn_laplacian": _with(_KNN, f"SELECT i, j, {_r('v')} FROM (SELECT i, j, sum(v) AS v FROM (SELECT i, j, -v AS v FROM graph UNION ALL SELECT i, i, sum(v) FROM graph GROUP BY i) GROUP BY 1, 2)"),
    "label_expand_1": _with(
        _PX,
        """SELECT px.i, coalesce(o.label, px.t) AS t FROM px LEFT JOIN (
        SELECT i, arg_min(label, d2 * 100 + off) AS label FROM (
          SELECT p.i, CASE WHEN k.t > 0.8 THEN 1.0 ELSE 0.0 END::DOUBLE AS label, (k.x - p.x) * (k.x - p.x) + (k.y - p.y) * (k.y - p.y) AS d2, (k.y - p.y + 1) * 3 + k.x - p.x + 1 AS off
          FROM px p JOIN px k ON abs(k.x - p.x) <= 1 AND abs(k.y - p.y) <= 1 AND (k.t > 0.8 OR k.t < 0.2) AND NOT (p.t > 0.8 OR p.t < 0.2)
          WHERE sqrt(((p.r - k.r) * (p.r - k.r) + (p.g - k.g) * (p.g - k.g)) + (p.b - k.b) * (p.b - k.b)) < 0.25) GROUP BY i) o ON o.i = px.i""",
    ),
    "restrict": _with(_PX, "SELECT c.i, round(sum(k * r), 6) + 0.0 AS v FROM (SELECT (x + y * (w // 2))::BIGINT AS i, 2 * x + dx AS fx, 2 * y + dy AS fy, (2 - abs(dx)) * (2 - abs(dy)) / 16.0::DOUBLE AS k FROM dims, nine, LATERAL (SELECT unnest(range(w // 2)) AS x) a, LATERAL (SELECT unnest(range(h // 2)) AS y) b) c JOIN px ON px.x = c.fx AND px.y = c.fy GROUP BY c.i"),
    "jacobi_3": _with(_JACOBI, f"SELECT i, {_r('v')} FROM x3"),
    "alpha_jacobi_3": _with(_JACOBI, "SELECT i, round(greatest(0.0, least(1.0, v)), 6) + 0.0 AS alpha FROM x3"),
    "fb_ml_level": _with(_LEVEL + _pass_sql("l0", "l1") + _pass_sql("l1", "l2"), f"SELECT i, {_r('f_r', 'f_g', 'f_b', 'b_r', 'b_g', 'b_b')} FROM l2"),
    "blend": _with(_PX, "SELECT i, " + ", ".join(f"round({c} * alpha + (1 - alpha) * (1 - {c}), 6) + 0.0 AS {c}" for c in "rgb") + " FROM px"),
    "stack": _with(_PX, "SELECT i, r8 AS r8_0, g8 AS g8_0, b8 AS b8_1 FROM px"),
}


def _levels_sql(pixels: str, levels: int = 8) -> str:
    """All levels: each has its size, starts from the one before, and repeats it once the full size is reached."""
    rgb = "rgb"
    fb = [f"{s}_{c}" for s in "fb" for c in rgb]
    out = pixels + """,
four AS (SELECT * FROM (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) AS o(dx, dy)),
s0 AS (SELECT img, base, w, h, least(w, CASE WHEN w < h THEN 2 ELSE ceil(2.0 * w / h)::INTEGER END) AS lw, least(h, CASE WHEN w < h THEN ceil(2.0 * h / w)::INTEGER ELSE 2 END) AS lh, false AS done FROM dims)"""
    for n in range(levels):
        if n:
            out += f", s{n} AS (SELECT img, base, w, h, least(w, 2 * lw) AS lw, least(h, 2 * lh) AS lh, lw = w AND lh = h AS done FROM s{n - 1})"
        out += f""",
p{n} AS MATERIALIZED (SELECT (x + y * lw + img * 1000000000)::BIGINT AS i, img, x, y, lw, lh, done, (least(w - 1, floor(x * w / lw::DOUBLE)) + least(h - 1, floor(y * h / lh::DOUBLE)) * w + base)::BIGINT AS src
  FROM s{n}, LATERAL (SELECT unnest(range(lw)) AS x) a, LATERAL (SELECT unnest(range(lh)) AS y) b)"""
        if n:
            carried = f"JOIN e{n - 1} o ON o.img = q.img AND o.x = least(o.lw - 1, floor(q.x * o.lw / q.lw::DOUBLE)) AND o.y = least(o.lh - 1, floor(q.y * o.lh / q.lh::DOUBLE))"
            own = ", ".join(f"o.{c}" for c in fb)
        else:
            carried, own = "", ", ".join(f"px.{c} AS {s}_{c}" for s in "fb" for c in rgb)
        out += f", b{n} AS MATERIALIZED (SELECT q.i, q.img, q.x, q.y, q.lw, q.lh, q.done, px.r, px.g, px.b, px.alpha, {own} FROM p{n} q JOIN px ON px.i = q.src {carried})"
        for old, new in ((f"b{n}", f"c{n}"), (f"c{n}", f"e{n}")):
            one = _pass_sql(old, f"x{new}").replace(f"g{'x' + new} AS (", f"gx{new} AS MATERIALIZED (").replace(f"\nx{new} AS (", f"\nx{new} AS MATERIALIZED (")
            out += one + f", {new} AS MATERIALIZED (SELECT o.i, o.img, o.x, o.y, o.lw, o.lh, o.done, o.r, o.g, o.b, o.alpha, {', '.join(f'CASE WHEN o.done THEN o.{c} ELSE u.{c} END AS {c}' for c in fb)} FROM {old} o JOIN x{new} u USING (i))"
    return out


_LOCAL = _MOMENTS + M.local(_INV.format("i").replace("1e-7", "1e-6"))
_SOLVED = "SELECT img AS image_id, i - base AS i, round(greatest(0.0, least(1.0, v)), 4) + 0.0 AS alpha FROM solved JOIN px USING (i)"
_SIDES = "b AS (SELECT i, CASE WHEN t = 1.0 THEN 100.0 ELSE 0.0 END::DOUBLE AS v FROM px)"


def _known(l: str) -> str:
    return f", a AS MATERIALIZED (SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM {l} UNION ALL SELECT i, i, 100.0 FROM px WHERE t IN (0.0, 1.0)) GROUP BY 1, 2), {_SIDES}"


def _matte_sql(ctes: str) -> str:
    return "WITH RECURSIVE " + ctes + M.conjugate_gradients("a", "b", 3000, 1e-9) + " " + _SOLVED


_GUIDED = ", ".join(["a_r", "a_g", "a_b", "a_0", "one"])
_LOW = _PX + """,
ld AS (SELECT w, h, greatest(3, floor(w * 0.125::DOUBLE))::INTEGER AS lw, greatest(3, floor(h * 0.125::DOUBLE))::INTEGER AS lh FROM dims),
low AS MATERIALIZED (SELECT q.x, q.y, q.lw AS w, q.lh AS h, r, g, b, alpha FROM (SELECT x, y, lw, lh, (least(w - 1, floor(x * w / lw::DOUBLE)) + least(h - 1, floor(y * h / lh::DOUBLE)) * w)::BIGINT AS src
  FROM ld, LATERAL (SELECT unnest(range(lw)) AS x) a, LATERAL (SELECT unnest(range(lh)) AS y) b) q JOIN px ON px.i = q.src)"""
_UP = """,
ug AS (SELECT i, lw, lh, (x + 0.5) * lw / w::DOUBLE - 0.5 AS fx, (y + 0.5) * lh / h::DOUBLE - 0.5 AS fy FROM px JOIN ld USING (w, h)),
up AS (SELECT i, {0} FROM (
  SELECT i, greatest(0, least(lw - 1, floor(fx) + dx)) AS x, greatest(0, least(lh - 1, floor(fy) + dy)) AS y,
    (CASE WHEN dx = 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END) * (CASE WHEN dy = 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END) AS k
  FROM ug, (SELECT unnest([0, 1]) AS dx) c, (SELECT unnest([0, 1]) AS dy) d) JOIN gs USING (x, y) GROUP BY i)
""".format(", ".join(f"sum(k * {c}) AS {c}" for c in ("a_r", "a_g", "a_b", "a_0", "one")))
_FILTERED = "round((a_r * r + a_g * g + a_b * b + a_0) / one, 6) + 0.0 AS v"
_CG3 = _SYS + """,
g0 AS MATERIALIZED (SELECT i, 0.0::DOUBLE AS x, v AS r, v AS p FROM b)""" + "".join(
    f""",
q{n} AS MATERIALIZED (SELECT a.i, sum(a.v * g.p) AS q FROM a JOIN g{n} g ON g.i = a.j GROUP BY a.i),
t{n} AS MATERIALIZED (SELECT rr, rr / pq AS k FROM (SELECT sum(r * r) AS rr, sum(p * q) AS pq FROM g{n} JOIN q{n} USING (i))),
u{n} AS MATERIALIZED (SELECT i, x + k * p AS x, r - k * q AS r, p, rr FROM g{n} JOIN q{n} USING (i), t{n}),
g{n + 1} AS MATERIALIZED (SELECT i, x, r, r + (SELECT sum(r * r) FROM u{n}) / rr * p AS p FROM u{n})"""
    for n in range(3)
)

ORACLES |= {
    "outer_products": _with(_PX, "SELECT i, " + ", ".join(f"round({a} * {b}, 6) + 0.0 AS p_{a}{b}" for a in "rgb" for b in "rgb") + " FROM px"),
    "quadratic_forms": _with(_PX, "SELECT i, round((r * r + g * g + b * b) * (1 + t + b), 6) + 0.0 AS v FROM px"),
    "running_sums": _with(_PX, "SELECT p.x, p.y, sum(q.r8)::BIGINT AS r, sum(q.g8)::BIGINT AS g FROM px p JOIN px q ON q.x <= p.x AND q.y <= p.y GROUP BY p.x, p.y"),
    "windows_at": _with(_PX, "SELECT p.i, (3 * (q.y - p.y + 1) + q.x - p.x + 1)::INTEGER AS off, q.i AS j, q.r8 AS v FROM px p JOIN px q ON q.x BETWEEN p.x - 1 AND p.x + 1 AND q.y BETWEEN p.y - 1 AND p.y + 1 WHERE p.r8 > 240"),
    "box_fill": _with(_PX, f"SELECT p.x, p.y, (sum(q.r8) + 7 * ({(2 * BOX_R + 1) ** 2} - count(*)))::BIGINT AS r, (sum(q.g8) + 7 * ({(2 * BOX_R + 1) ** 2} - count(*)))::BIGINT AS g FROM px p JOIN px q ON q.x BETWEEN p.x - {BOX_R} AND p.x + {BOX_R} AND q.y BETWEEN p.y - {BOX_R} AND p.y + {BOX_R} GROUP BY p.x, p.y"),
    "edge_trim": _with(_TILES + M.edge_trim(), f"SELECT img AS image_id, px.i - base AS i, {_r('et9.t')} FROM et9 JOIN px USING (i)"),
    "color_similarity": _with(_PX + M.similarity(), f"SELECT i, j, {_r('v')} FROM sim"),
    "patch_bhattacharyya": _with(_MOMENTS + M.patches(), f"SELECT i, {_r('fg', 'bg')} FROM pd"),
    "patch_trim": _with(_MOMENTS + M.patch_trim(), f"SELECT i, {_r('t')} FROM pt"),
    "local_affinity": _with(_LOCAL, f"SELECT i, j, {_r('v')} FROM local"),
    "lle_weights": _with(_PX + M.mixture(), "SELECT q AS i, j, round(v, 4) AS v FROM mix"),
    "known_unknown_mixture": _with(_PX + M.to_unknown("px"), "SELECT i, round(alpha, 4) AS alpha, round(confidence, 4) AS confidence FROM ku"),
    "ifm_system": _with(
        _LOCAL + M.mixture() + M.similarity() + M.edge_trim() + M.patch_trim() + M.to_unknown("pt") + M.flow_system(),
        "SELECT i, j, round(v, 3) + 0.0 AS v FROM (SELECT i, j, v FROM fa UNION ALL SELECT i, -1, v FROM fb)",
    ),
    "lkm_apply": _with(_PX + M.large_kernel_matrix(2), "SELECT lk.i, round(sum(lk.v * px.r), 6) + 0.0 AS v FROM lk JOIN px ON px.i = lk.j GROUP BY lk.i"),
    "lkm_diagonal": _with(_PX + M.large_kernel_matrix(2), f"SELECT i, {_r('v')} FROM lk WHERE i = j"),
    "cg_3": _with(_CG3, "SELECT i, round(x, 6) + 0.0 AS v FROM g3"),
    "fb_ml": _with(_levels_sql(_TILES), f"SELECT img AS image_id, i % 1000000000 AS i, {_r(*_FB)} FROM e7"),
    "fb_ml_sizes": _with(_levels_sql(_HEIGHTS), f"SELECT img AS image_id, i % 1000000000 AS i, {_r(*_FB)} FROM e7"),
    "guided_filter": _with(_PX + M.guided("px", 2), f"SELECT px.i, {_FILTERED} FROM gs JOIN px USING (x, y)"),
    "fast_guided_filter": _with(_LOW + M.guided("low", 1) + _UP, f"SELECT px.i, {_FILTERED} FROM up JOIN px USING (i)"),
}
_LKM = _PX + M.large_kernel_matrix(2, "1e-7") + _known("lk")
_FB_SYS = """,
fe AS (SELECT p.i, q.i AS j, 1e-5::DOUBLE + abs(p.alpha - q.alpha) AS k FROM (SELECT i, alpha, (greatest(0, least(w - 1, x + dx)) + greatest(0, least(h - 1, yl + dy)) * w + base)::BIGINT AS j
  FROM px, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) AS o(dx, dy)) p JOIN px q ON q.i = p.j WHERE p.i <> q.i),
fh AS (SELECT i, j, k FROM fe UNION ALL SELECT j, i, k FROM fe),
fm AS MATERIALIZED (SELECT i, j, sum(v) AS v FROM (
  SELECT i + o AS i, i + o AS j, k AS v FROM fh, (SELECT unnest([0, 1000000000]) AS o) UNION ALL SELECT i + o, j + o, -k FROM fh, (SELECT unnest([0, 1000000000]) AS o)
  UNION ALL SELECT i, i, alpha * alpha FROM px UNION ALL SELECT i + 1000000000, i + 1000000000, (1 - alpha) * (1 - alpha) FROM px
  UNION ALL SELECT i, i + 1000000000, alpha * (1 - alpha) FROM px UNION ALL SELECT i + 1000000000, i, alpha * (1 - alpha) FROM px) GROUP BY 1, 2)""" + "".join(f", fb_{c} AS (SELECT i, alpha * {c} AS v FROM px UNION ALL SELECT i + 1000000000, (1 - alpha) * {c} FROM px)" for c in "rgb")
_FB_CF = _TILES + _FB_SYS + "".join(M.conjugate_gradients("fm", f"fb_{c}", 6000, 1e-13, f"fs_{c}") for c in "rgb")
_HALVES = " FROM px " + " ".join(f"JOIN fs_{c} {s}_{c} ON {s}_{c}.i = px.i + {0 if s == 'f' else 1000000000}" for s in "fb" for c in "rgb")
ORACLES |= {
    "vcycle": "WITH RECURSIVE " + _SYS + M.v_cycle(4) + f" SELECT i, {_r('v')} FROM vz0",
    "gauss_seidel": _with(_SYS + M.sweep(), f"SELECT i, {_r('v')} FROM gs"),
    "lkm_cg_4": _with(_LKM + M.some_steps("cg", "a", "b", 4), f"SELECT i, round(v, 6) + 0.0 AS x FROM cg"),
    "fb_cf_5": _with(
        _PX + _FB_SYS + "".join(M.some_steps(f"fs_{c}", "fm", f"fb_{c}", 5) for c in "rgb"),
        "SELECT px.i, " + ", ".join(f"round(greatest(0.0, least(1.0, {s}_{c}.v)), 6) + 0.0 AS {s}_{c}" for s in "fb" for c in "rgb") + _HALVES,
    ),
    "least_squares_4": _with(
        _PX
        + """,
la AS MATERIALIZED (SELECT i AS k, i AS j, 1.0::DOUBLE AS v FROM px WHERE x > 0 UNION ALL SELECT i, i - 1, -1.0 FROM px WHERE x > 0 UNION ALL SELECT 1000000000 + i, i, 1.0 FROM px WHERE y > 0
  UNION ALL SELECT 1000000000 + i, i - w, -1.0 FROM px WHERE y > 0 UNION ALL SELECT 2000000000 + i, i, 0.1 FROM px),
ln AS MATERIALIZED (SELECT p.j AS i, q.j AS j, sum(p.v * q.v) AS v FROM la p JOIN la q USING (k) GROUP BY 1, 2)"""
        + "".join(f", lb_{c} AS MATERIALIZED (SELECT la.j AS i, sum(la.v * px.{c}) AS v FROM la JOIN px ON px.i = la.k % 1000000000 GROUP BY la.j)" + M.some_steps(f"ls_{c}", "ln", f"lb_{c}", 4, False) for c in "rg"),
        "SELECT i, round(p.v, 6) + 0.0 AS x_r, round(q.v, 6) + 0.0 AS x_g FROM ls_r p JOIN ls_g q USING (i)",
    ),
}
ORACLES["fb_cf"] = f"WITH RECURSIVE {_FB_CF} SELECT img AS image_id, px.i - base AS i, " + ", ".join(f"round(greatest(0.0, least(1.0, {s}_{c}.v)), 3) AS {s}_{c}" for s in "fb" for c in "rgb") + _HALVES
_KNN_LAP = _KNN + ", lap AS (SELECT i, j, sum(v) AS v FROM (SELECT i, j, -v AS v FROM graph UNION ALL SELECT i, i, sum(v) FROM graph GROUP BY i) GROUP BY 1, 2)"
for _m, _ctes in (("cf", _CF + _known("lap")), ("knn", _KNN_LAP + _known("lap")), ("lkm", _LKM)):
    ORACLES |= {f"alpha_{_m}_{p or 'none'}": _matte_sql(_ctes.replace(_PX, _TILES)) for p in matte.METHODS[_m]}
