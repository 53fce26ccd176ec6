"""Engine queries against DuckDB and dense NumPy."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenweave.operators import affinity, color, flow, grid, krylov, linalg, matte, multigrid, neighbors, tiles
from lumenweave.operators.kernels import ColumnFactor, FactorError, Multigrid, conjugate_gradients, csr, factor_with_retries, gauss_seidel, least_squares, restriction
from lumenweave.plans import lineage
from lumenweave.plans.lineage import keep
from lumenweave.plans.queries import ORACLES, QUERIES
from lumenweave.sources import pixels
from lumenweave.sources.jpeg import code_lengths, encode_jpeg
from lumenweave.sources.pixels import encode_png, load_images, part_pixels, resized, save_images

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("part", "embeddings"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=str)
    want = sorted(c.sql(f"select {', '.join(chr(34) + x + chr(34) for x in cols)} from ({ORACLES[name]})").fetchall(), key=str)
    assert got == want


def _spd(n, seed=0):
    rng = np.random.default_rng(seed)
    a = rng.random((n, n))
    a = a + a.T + n * np.eye(n)
    i, j = np.nonzero(a)
    return a, csr(i, j, a[i, j], n)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 60])
def test_factor_without_threshold_is_exact(n):
    dense, a = _spd(n)
    f = ColumnFactor(a, 0.0)
    low = np.zeros((n, n))
    low[f.i, f.j] = f.v
    assert np.allclose(low @ low.T, dense, atol=1e-10)
    b = np.arange(n) + 1.0
    assert np.allclose(f.solve(b), np.linalg.solve(dense, b), atol=1e-10)


def test_cg_and_zero_residual():
    dense, a = _spd(30)
    b = np.ones(30)
    assert np.allclose(conjugate_gradients(a, b, 1e-12, 500).x, np.linalg.solve(dense, b))
    assert conjugate_gradients(a, b * 0, 0.0, 10).steps == 0


def test_restriction_weights():
    r = restriction(6, 4)
    assert (r.n, r.m) == (6, 24) and abs((r @ np.ones(24))[5] - 1) < 1e-12


@pytest.mark.parametrize("preconditioner", ["jacobi", "vcycle", "ichol"])
def test_preconditioners_agree(spark, preconditioner):
    px = part_pixels(spark, SF)
    plain = {r.i: r.alpha for r in matte.alpha(px, "cf", None, absolute_tolerance=1e-9).collect()}
    other = {r.i: r.alpha for r in matte.alpha(px, "cf", preconditioner, absolute_tolerance=1e-9).collect()}
    assert max(abs(plain[i] - other[i]) for i in plain) < 1e-3


def test_method_table_is_enforced(spark):
    px = part_pixels(spark, SF)
    for method, p in (("lkm", "vcycle"), ("ifm", "ichol"), ("vcycle", None)):
        with pytest.raises(ValueError):
            matte.alpha(px, method, p)


def test_png_round_trip(spark, tmp_path):
    image = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    (tmp_path / "a.png").write_bytes(encode_png(image))
    rows = load_images(spark, str(tmp_path)).orderBy("i").collect()
    assert [round(r.r * 255) for r in rows] == image[:, :, 0].ravel().tolist() and rows[0].w == 4


def test_resize_on_load_and_save(spark, tmp_path):
    image = np.arange(96, dtype=np.uint8).reshape(4, 8, 3)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(encode_png(image))
    # a reduction by two with the wide triangle filter, inside the image: 1 3 3 1 over 8
    want = (image[:, 1, 0] + 3.0 * image[:, 2, 0] + 3.0 * image[:, 3, 0] + image[:, 4, 0]) / 8
    assert np.abs(resized(image, 4, 4)[:, 1, 0] - want).max() <= 0.5
    assert (resized(image, 16, 8, "NEAREST") == image.repeat(2, 0).repeat(2, 1)).all() and (resized(image, 8, 4) == image).all()
    px = load_images(spark, str(tmp_path / "in"), width=4)
    assert {(r.w, r.h) for r in px.collect()} == {(4, 2)}
    whole = load_images(spark, str(tmp_path / "in"))
    for extension in ("png", "ppm"):
        assert save_images(whole, ["r", "g", "b"], str(tmp_path / extension), extension) == 1
    (file,) = [f for f in (tmp_path / "png").iterdir() if f.suffix == ".png"]
    again = load_images(spark, str(file)).orderBy("i").collect()
    assert [round(r.g * 255) for r in again] == image[:, :, 1].ravel().tolist()
    with pytest.raises(ValueError):
        save_images(whole, ["r"], str(tmp_path), "gif")


def test_nearest_with_blocks_is_exact(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK", 40)
    monkeypatch.setattr(neighbors, "QUERIES", 16)
    rng = np.random.default_rng(2)
    v = np.round(rng.random((500, 3)), 1)  # many ties
    df = spark.createDataFrame([(i % 2, i, *map(float, x)) for i, x in enumerate(v)], "image_id long, i long, a double, b double, c double")
    got = {}
    for r in neighbors.nearest(df.filter("i % 5 < 2"), df, ["a", "b", "c"], 7).collect():
        got.setdefault(r.q, {})[r["rank"]] = r.j
    for q in [i for i in range(500) if i % 5 < 2]:
        ids = np.arange(q % 2, 500, 2)
        d = ((v[ids] - v[q]) ** 2)[:, 0] + ((v[ids] - v[q]) ** 2)[:, 1] + ((v[ids] - v[q]) ** 2)[:, 2]
        assert [got[q][k] for k in range(1, 8)] == ids[np.lexsort((ids, d))[:7]].tolist()


def test_tree_finds_all_leaves_in_reach():
    rng = np.random.default_rng(8)
    points = np.round(rng.random((3000, 4)), 2)
    tree = neighbors.Tree(points[::7], 5)
    leaf = tree.leaf(points)
    kinds = np.unique(leaf)
    tree.fit(kinds, np.array([points[leaf == k].min(0) for k in kinds]), np.array([points[leaf == k].max(0) for k in kinds]))
    q, reach = rng.random((50, 4)), rng.random(50) * 0.1
    found = set(zip(*(x.tolist() for x in tree.reached(q, reach))))
    need = {(i, int(leaf[j])) for i in range(50) for j in np.flatnonzero(((points - q[i]) ** 2).sum(1) <= reach[i])}
    assert need <= found and len(found) < 50 * 32 and set(tree.nearest(q).tolist()) <= set(kinds.tolist())


def test_nearest_among_equal_points(spark, monkeypatch):
    """A flat area: most points are the same, and ties go to the smallest ids."""
    monkeypatch.setattr(neighbors, "BLOCK", 30)
    rows = [(0, i, 0.5 if i % 10 else i / 400.0, 0.25) for i in range(400)] + [(1, i, 0.1, 0.1) for i in range(20)]
    df = spark.createDataFrame(rows, "image_id long, i long, a double, b double")
    got = {}
    for r in neighbors.nearest(df, df, ["a", "b"], 3).collect():
        got.setdefault((r.image_id, r.q), {})[r["rank"]] = r.j
    for image, q, a, _ in rows:
        own = sorted((((x - a) ** 2, j) for k, j, x, _ in rows if k == image))[:3]
        assert [got[image, q][n] for n in (1, 2, 3)] == [j for _, j in own]


def test_solving_by_tables_equals_solving_in_tasks(spark, monkeypatch):
    px = part_pixels(spark, SF)
    want = {r.i: r.alpha for r in matte.alpha(px, "cf", "jacobi").collect()}
    start = spark.createDataFrame([(0, i, a) for i, a in want.items()], "image_id long, i long, v double")
    a, b = matte.build_system(px, "cf")
    near = matte.solve(a, b, px, "jacobi", atol=0.5, x0=start).collect()
    assert max(r.steps for r in near) < 30
    monkeypatch.setattr(matte, "KERNEL_PIXELS", 16)
    got = {r.i: r.alpha for r in matte.alpha(px, "cf", "jacobi", absolute_tolerance=5.0).collect()}
    monkeypatch.setattr(matte, "KERNEL_PIXELS", 1 << 20)
    same = {r.i: r.alpha for r in matte.alpha(px, "cf", "jacobi", absolute_tolerance=5.0).collect()}
    assert max(abs(got[i] - same[i]) for i in same) < 1e-9


def test_closed_form_colours_solve_their_system(spark):
    """Against a dense solve of the normal equations."""
    px = part_pixels(spark, SF).withColumn("alpha", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (32 - F.col("x")) / 24.0)))
    got = color.estimate_closed_form(px, rtol=1e-12, max_iter=5000).orderBy("i").toPandas()
    p = px.orderBy("i").toPandas()
    n, w, h = len(p), int(p.w[0]), int(p.h[0])
    alpha, m = p.alpha.to_numpy(), np.zeros((2 * n, 2 * n))
    for i, (x, y) in enumerate(zip(p.x, p.y, strict=True)):
        for dx, dy in ((-1, 0), (1, 0), (0, -1), (0, 1)):
            j = min(max(x + dx, 0), w - 1) + min(max(y + dy, 0), h - 1) * w
            e = np.zeros(n)
            e[i] += 1
            e[j] -= 1
            k = 1e-5 + abs(alpha[i] - alpha[j])
            m[:n, :n] += k * np.outer(e, e)
            m[n:, n:] += k * np.outer(e, e)
    c = np.concatenate([np.diag(alpha), np.diag(1 - alpha)], 1)
    m += c.T @ c
    for ch in "rgb":
        s = np.clip(np.linalg.solve(m, c.T @ p[ch].to_numpy()), 0, 1)
        assert np.abs(np.concatenate([got[f"f_{ch}"], got[f"b_{ch}"]]) - s).max() < 1e-4


def test_flow_matte_leaves_a_small_residual(spark):
    px = part_pixels(spark, SF).cache()
    a, b = (x.cache() for x in matte.build_system(px, "ifm"))
    x = matte.solve(a, b, px, "jacobi").select("image_id", "i", F.col("x").alias("v"))
    left = linalg.matvec(a, x).withColumnRenamed("v", "ax").join(b, ["image_id", "i"]).agg(F.sqrt(F.sum((F.col("ax") - F.col("v")) ** 2)).alias("r")).first().r
    assert left < 0.02 * b.agg(F.sqrt(F.sum(F.col("v") ** 2))).first()[0]


def test_large_images_as_tables_equal_tasks(spark):
    px = part_pixels(spark, SF).withColumn("alpha", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (32 - F.col("x")) / 24.0))).cache()
    names = [f"{s}_{c}" for s in "fb" for c in "rgb"]
    both = [color.estimate_multilevel(px, in_tasks=k).select("i", *names).orderBy("i").toPandas() for k in (True, False)]
    assert np.abs(both[0] - both[1]).to_numpy().max() < 1e-9
    both = [affinity.trim_edges(px, 3, in_tasks=k).orderBy("i").toPandas() for k in (True, False)]
    assert both[0].equals(both[1])


def _mixed(spark):
    rng, rows = np.random.default_rng(0), []
    for image, w, h in ((1, 8, 6), (2, 5, 4), (3, 3, 9), (4, 1, 5), (5, 1, 1), (6, 20, 3)):
        v = rng.random((w * h, 4))
        rows += [(image, i, i % w, i // w, w, h, *map(float, v[i])) for i in range(w * h)]
    return spark.createDataFrame(rows, "image_id long, i long, x int, y int, w int, h int, r double, g double, b double, alpha double")


def test_colours_of_images_of_different_sizes(spark, monkeypatch):
    px, names = _mixed(spark), [f"{s}_{c}" for s in "fb" for c in "rgb"]
    frame = lambda df: df.select("image_id", "i", "w", "h", *names).toPandas().sort_values(["image_id", "i"]).reset_index(drop=True)
    tasks, tables = (frame(color.estimate_foreground_background(px, "ml", in_tasks=k)) for k in (True, False))
    assert tasks.groupby("image_id").size().to_dict() == {1: 48, 2: 20, 3: 27, 4: 5, 5: 1, 6: 60}
    assert np.abs(tasks - tables).to_numpy().max() < 1e-12
    for image in (1, 2):
        alone = frame(color.estimate_foreground_background(px.filter(F.col("image_id") == image), "ml", in_tasks=False))
        assert np.abs(alone - tables[tables.image_id == image].reset_index(drop=True)).to_numpy().max() < 1e-12
    monkeypatch.setattr(color, "KERNEL_PIXELS", 25)  # some images in tasks, some by tables
    assert np.abs(frame(color.estimate_multilevel(px, n_iter=lambda w, h: 1 + w % 2)) - frame(color.estimate_multilevel(px, n_iter=lambda w, h: 1 + w % 2, in_tasks=True))).to_numpy().max() < 1e-12
    filtered = color.fast_guided_filter(px.filter("image_id < 3"), "alpha", 2, scale=0.5)
    alone = {r.i: r.v for r in color.fast_guided_filter(px.filter("image_id = 2"), "alpha", 2, scale=0.5).collect()}
    assert filtered.count() == 68 and all(abs(r.v - alone[r.i]) < 1e-12 for r in filtered.filter("image_id = 2").collect())


def _small_system(spark):
    """Systems of two images, 40 x 3 and 40 x 2, as tables and as frames."""
    px = keep(part_pixels(spark, SF, 3))
    a, b = (keep(x) for x in matte.build_system(px, "cf"))
    return px, a, b, a.toPandas(), b.toPandas()


def test_vcycle_by_tables_equals_the_kernel(spark):
    px, a, b, fa, fb = _small_system(spark)
    levels = multigrid.Hierarchy(a, px, coarse=32)
    got = levels.cycle(b).toPandas()
    for image, h in ((0, 3), (1, 2)):
        m, side = fa[fa.image_id == image], fb[fb.image_id == image].sort_values("i").v.to_numpy()
        want = Multigrid(csr(m.i.to_numpy(), m.j.to_numpy(), m.v.to_numpy(), 40 * h), 40, h).cycle(side)
        assert np.abs(got[got.image_id == image].sort_values("i").v.to_numpy() - want).max() < 1e-9
    levels.close()


@pytest.mark.parametrize("preconditioner", [None, "jacobi", "vcycle", "ichol"])
def test_large_images_use_the_preconditioner_asked_for(spark, monkeypatch, preconditioner):
    px, a, b, fa, fb = _small_system(spark)
    monkeypatch.setattr(matte, "KERNEL_PIXELS", 100)  # one image by tables, one in a task
    monkeypatch.setattr(tiles, "SIDE", 8)
    got = matte.solve(a, b, px, preconditioner, atol=20.0).toPandas()
    steps = got.groupby("image_id").steps.max().to_dict()
    for image, h in ((0, 3), (1, 2)):
        m, side = fa[fa.image_id == image], fb[fb.image_id == image].sort_values("i").v.to_numpy()
        left = side - csr(m.i.to_numpy(), m.j.to_numpy(), m.v.to_numpy(), 40 * h) @ got[got.image_id == image].sort_values("i").x.to_numpy()
        assert np.sqrt(left @ left) < 20.001
    assert steps[0] < {None: 100, "jacobi": 60, "vcycle": 15, "ichol": 15}[preconditioner]


def test_tile_factors_are_symmetric(spark):
    px, a, *_ = _small_system(spark)
    factors = tiles.TileFactors(a, px, side=7, overlap=2)
    rng = np.random.default_rng(3)
    u, v = (spark.createDataFrame([(0, i, float(x)) for i, x in enumerate(rng.random(120))], "image_id long, i long, v double") for _ in range(2))
    sums = [linalg.dot(x, factors.solve(y)).first().v for x, y in ((u, v), (v, u))]
    assert abs(sums[0] - sums[1]) < 1e-9 * abs(sums[0]) and linalg.dot(u, factors.solve(u)).first().v > 0


def test_large_kernel_by_tables_equals_the_kernel(spark):
    """Radius 10, as the matte's default has it."""
    rng = np.random.default_rng(4)
    rows = [(0, i, i % 24, i // 24, 24, 22, *map(float, rng.random(3)), [1.0, 0.5, 0.0][min(2, i % 24 // 8)]) for i in range(24 * 22)]
    px = spark.createDataFrame(rows, "image_id long, i long, x int, y int, w int, h int, r double, g double, b double, t double")
    how = (10, 1e-7, 100.0, "jacobi", 0.0, None, 4)
    tables, task = (f(px, *how).toPandas().sort_values("i").x.to_numpy() for f in (matte.solve_large_kernel_tables, matte._solve_large_kernel))
    assert np.abs(tables - task).max() < 1e-6


def test_closed_form_colours_by_tables(spark):
    """Eight steps of all three channels at once equal eight steps of each alone."""
    px = part_pixels(spark, SF, 3).withColumn("alpha", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (32 - F.col("x")) / 24.0)))
    got = color.estimate_closed_form(px, rtol=1e-13, max_iter=8, in_tasks=False).toPandas()
    a, b = (x.toPandas() for x in color.closed_form_system(px))
    for image, n in ((0, 120), (1, 80)):
        m, side, own = a[a.image_id == image], b[b.image_id == image].sort_values("i"), got[got.image_id == image].sort_values("i")
        m = csr(m.i.to_numpy(), m.j.to_numpy(), m.v.to_numpy(), 2 * n)
        for c in "rgb":
            want = np.clip(conjugate_gradients(m, side[c].to_numpy(), 1e-13, 8, precondition=lambda r, d=m.diagonal(): r / d).x, 0, 1)
            assert np.abs(np.concatenate([own[f"f_{c}"], own[f"b_{c}"]]) - want).max() < 1e-9


def test_least_squares_against_numpy(spark):
    rng = np.random.default_rng(6)
    dense = rng.random((12, 5)) * (rng.random((12, 5)) < 0.7) + np.eye(12, 5)
    b = rng.random(12)
    want = np.linalg.lstsq(dense, b, rcond=None)[0]
    i, j = np.nonzero(dense)
    assert np.allclose(least_squares(csr(i, j, dense[i, j], 12, 5), b), want, atol=1e-8)
    a = spark.createDataFrame([(0, int(p), int(q), float(dense[p, q])) for p, q in zip(i, j)], "image_id long, i long, j long, v double")
    side = spark.createDataFrame([(0, k, float(v)) for k, v in enumerate(b)], "image_id long, i long, v double")
    got = krylov.least_squares(a, side).toPandas().sort_values("i").x_v.to_numpy()
    assert np.allclose(got, want, atol=1e-8)


def test_sweeps_by_colour_equal_plain_ones(spark):
    px, a, b, fa, fb = _small_system(spark)
    got = multigrid.gauss_seidel(a, b, multigrid.colours(px), sweeps=2).toPandas()
    m, side = fa[fa.image_id == 0], fb[fb.image_id == 0].sort_values("i").v.to_numpy()
    full = csr(m.i.to_numpy(), m.j.to_numpy(), m.v.to_numpy(), 120).dense()
    colour = [(i // 40 % 3) * 3 + i % 40 % 3 for i in range(120)]
    order, x = np.argsort(colour, kind="stable"), np.zeros(120)
    for _ in range(2):
        for i in order:
            x[i] += (side[i] - full[i] @ x) / full[i, i]
    assert np.abs(got[got.image_id == 0].sort_values("i").v.to_numpy() - x).max() < 1e-9
    # the kernel's sweep is that of the given order
    turned = csr(*np.nonzero(full[np.ix_(order, order)]), full[np.ix_(order, order)][np.nonzero(full[np.ix_(order, order)])], 120)
    assert np.abs(gauss_seidel(turned, side[order], np.zeros(120), 2) - x[order]).max() < 1e-9


def test_factor_of_the_pattern_only_and_retries():
    dense, a = _spd(12)
    dense[np.abs(np.subtract.outer(np.arange(12), np.arange(12))) % 5 > 1] = 0
    a = csr(*np.nonzero(dense), dense[np.nonzero(dense)], 12)
    f = ColumnFactor(a, 0.0, 0.0, True)
    assert set(zip(f.i.tolist(), f.j.tolist())) == {(i, j) for i, j in zip(a.i.tolist(), a.j.tolist()) if i >= j}
    assert len(ColumnFactor(a, 0.0).v) > len(f.v)
    # not positive without a shift, positive with the ladder's
    flat = csr(np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1]), np.array([1.0, 1.0, 1.0, 1.0]), 2)
    with pytest.warns(UserWarning, match="no factor"):
        assert abs(factor_with_retries(flat, 0.0).diag[1] ** 2 - 2e-4) < 1e-6
    with pytest.raises(FactorError), pytest.warns(UserWarning):
        factor_with_retries(csr(np.array([0]), np.array([0]), np.array([-1.0]), 1))


@pytest.mark.parametrize("shape", [(16, 24, 3), (13, 21, 3), (9, 5, 1), (1, 1, 3), (64, 64, 1)])
def test_jpeg_is_decoded_within_an_error(spark, tmp_path, shape):
    """Smooth images come back within a few levels, flat ones within one, noise within its quantisation."""
    h, w, c = shape
    y, x = np.mgrid[:h, :w]
    smooth = np.stack([128 + 100 * np.sin(x / 9 + k) * np.cos(y / 11) for k in range(c)], -1)
    noise = np.random.default_rng(9).integers(0, 256, shape)
    for k, (image, most) in enumerate(((smooth, 6), (np.full(shape, 77.0), 1), (noise, 40))):
        image = np.rint(image).astype(np.uint8)
        (tmp_path / f"{k}.jpg").write_bytes(encode_jpeg(image))
        rows = load_images(spark, str(tmp_path / f"{k}.jpg")).orderBy("i").toPandas()
        got = np.rint(rows[["r", "g", "b"][:c]].to_numpy() * 255).reshape(h, w, c)
        assert (rows.w[0], rows.h[0]) == (w, h) and np.abs(got - image).max() <= most


def test_jpeg_sink_and_code_lengths(spark, tmp_path):
    px = part_pixels(spark, SF, 3)
    assert save_images(px, ["r", "g", "b"], str(tmp_path), "jpg") == 2
    assert load_images(spark, str(tmp_path)).groupBy("w", "h").count().count() == 2
    fibonacci = [1, 1]
    while len(fibonacci) < 40:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    bits = code_lengths(dict(enumerate(fibonacci)))
    assert max(n for _, n in bits) <= 16 and sum(2.0**-n for _, n in bits) < 1


@pytest.mark.parametrize("kind", ["BOX", "BICUBIC", "LANCZOS"])
def test_wide_kernels(kind):
    """A constant stays, a doubling keeps a straight line inside, and rows of weights sum to one."""
    assert (resized(np.full((6, 9, 2), 93, np.uint8), 4, 5, kind) == 93).all()
    line = np.repeat(np.arange(0, 200, 10, dtype=np.uint8)[None, :, None], 4, 0)
    up = resized(line, 40, 4, kind)[0, 8:32, 0].astype(float)
    assert np.abs(up - (np.arange(8, 32) / 2 - 0.25) * 10).max() <= (2.6 if kind == "BOX" else 2)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_solver_products_are_not_broadcast(spark):
    """Small files aren't few rows: neither side of a product of a solver goes through the driver."""
    px = part_pixels(spark, SF)
    a = px.select("image_id", "i", F.col("i").alias("j"), F.lit(2.0).alias("v"))
    x = px.select("image_id", "i", "r", "g")
    assert "BroadcastHashJoin" not in _plan(krylov.product(a, ["r", "g"])(x))


def test_sparse_products_are_not_broadcast(spark):
    for name in ("matmat", "matvec", "row_sum", "inner_product"):
        assert "BroadcastHashJoin" not in _plan(QUERIES[name](spark, SF)), name


def test_stencil_entries_need_no_shuffle_inside(spark):
    """Only pixels at an edge are grouped, and narrow images, where a tap clamps from both sides, add up as before."""
    for w, h in ((40, 9), (1, 1), (2, 3), (3, 3)):
        px = spark.range(w * h).selectExpr("0L AS image_id", "id AS i", f"CAST(id % {w} AS int) AS x", f"CAST(id DIV {w} AS int) AS y", f"{w} AS w", f"{h} AS h")
        offsets, weights = [(dx, dy) for dx in (-1, 0, 2) for dy in (-1, 0, 1)] + [(0, 0)], [float(k) for k in range(10)]
        want = {}
        for x in range(w):
            for y in range(h):
                for (dx, dy), v in zip(offsets, weights):
                    at = (x + y * w, min(w - 1, max(0, x + dx)) + min(h - 1, max(0, y + dy)) * w)
                    want[at] = want.get(at, 0.0) + v
        got = grid.stencil_matrix(px, offsets, weights)
        assert {(r.i, r.j): r.v for r in got.collect()} == want and got.count() == len(want)
    plan = _plan(got)
    assert "Union" in plan


def test_many_pixels_of_a_small_file_are_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(pixels, "PART_ROWS", 30)
    px = part_pixels(spark, SF)
    assert px.select(F.spark_partition_id()).distinct().count() > 1
    per = [r["count"] for r in px.groupBy(F.spark_partition_id().alias("at")).count().collect()]
    assert sum(per) == 200 and max(per) < 60


def test_nearest_vectors_meet_in_pairs_of_blocks(spark, monkeypatch):
    """Exact, with equal vectors, far-off and non-finite values; each two blocks meet in one task."""
    monkeypatch.setattr(neighbors, "LEAST_VECTORS", 600)
    monkeypatch.setattr(neighbors, "CHUNK", 64)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 6))
    v[100:140], v[200], v[300:600] = v[7], 1e9, v[300:600] + 1e5
    for spoilt in (False, True):
        if spoilt:
            v[11, 2] = np.inf
        d = neighbors._exact(v, v, np.arange(len(v))[:, None], np.arange(len(v))[None, :])
        want = {(i, int(j)): float(d[i, j]) for i in range(len(v)) for j in np.argsort(d[i], kind="stable")[:5] if np.isfinite(d[i, j])}
        rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "i long, v array<double>")
        got = {(r.q, r.j): r.dist2 for r in neighbors.nearest_vectors(rows, 5).collect() if np.isfinite(r.dist2)}
        assert got == want


def test_few_pairs_of_vectors_are_computed_one_by_one(monkeypatch):
    """Of 4,000 candidates a query's exact distances to under 40 are computed; of equal ones k are kept."""
    rng, seen, exact = np.random.default_rng(4), [], neighbors._exact

    def counted(q, c, row, column):
        seen.append(max(row.size, column.size))
        return exact(q, c, row, column)

    monkeypatch.setattr(neighbors, "_exact", counted)
    neighbors._top(rng.normal(size=(2000, 6)), rng.normal(size=(4000, 6)), 10)
    assert sum(seen) < 2000 * 40
    row, column, d = neighbors._top(np.ones((300, 6)), np.ones((4000, 6)), 10)
    assert len(row) == 3000 and set(column) == set(range(10)) and not d.any()


def test_window_moments_need_no_join(spark):
    """A pixel goes to the centres around it; narrow images and missing pixels as by windows, which a join looks up."""
    for w, h in ((7, 5), (1, 1), (1, 4), (2, 3), (5, 1)):
        px = spark.range(w * h).filter("id != 9").selectExpr("0L AS image_id", "id AS i", f"CAST(id % {w} AS int) AS x", f"CAST(id DIV {w} AS int) AS y", f"{w} AS w", f"{h} AS h", "id * 37 % 101 AS r8", "id * id % 97 AS g8", "id * 11 % 53 AS b8")
        value = {r.i: (r.r8, r.g8, r.b8) for r in px.collect()}
        got = grid.window_moments(px)
        assert {r.i for r in got.select("i").collect()} == set(value)
        for r in got.collect():
            x, y = r.i % w, r.i // w
            taps = [min(w - 1, max(0, x + dx)) + min(h - 1, max(0, y + dy)) * w for dx, dy in grid.NINE]
            near = np.array([value[t] for t in taps if t in value])
            s = near.sum(0)
            assert [r.s_r, r.s_g, r.s_b] == s.tolist()
            assert [r.c_rr, r.c_rg, r.c_rb, r.c_gg, r.c_gb, r.c_bb] == (9 * near.T @ near - np.outer(s, s))[np.triu_indices(3)].tolist()
    assert "Join" not in _plan(got)


def test_least_of_rows():
    """Ties go to the first column, none lies beyond a row's reach, and missing values come last."""
    d = np.array([[3.0, 1, 1, 1, 2], [np.nan, 5, np.nan, np.nan, np.nan], [0, 9, 9, 9, 0]])
    row, column, rank = neighbors._least(d, 2)
    assert list(zip(row.tolist(), column.tolist(), rank.tolist())) == [(0, 1, 1), (0, 2, 2), (1, 1, 1), (1, 0, 2), (2, 0, 1), (2, 4, 2)]
    row, column, _ = neighbors._least(d, 4, np.array([1.5, 9, 0]))
    assert [(r, c) for r, c in zip(row.tolist(), column.tolist()) if r != 1] == [(0, 1), (0, 2), (0, 3), (2, 0), (2, 4)]


def test_neighbours_of_small_images_are_ranked_where_they_meet(spark):
    px = part_pixels(spark, SF, 2)
    assert "Window" not in _plan(neighbors.nearest(px, px, ["r", "g"], 3))


def test_neighbours_values_are_not_broadcast(spark):
    """Millions of pixels in a small file: what is looked up of neighbours goes by shuffles, in tasks dealt by rows."""
    px = keep(part_pixels(spark, SF))
    found = px.select("image_id", F.col("i").alias("q"), F.lit(1).alias("rank"), F.col("i").alias("j"))
    assert "BroadcastHashJoin" not in _plan(neighbors.lle_weights(found, px, ["r", "g", "b"]))
    assert "REPARTITION_BY_NUM" in _plan(affinity.patch_distances(px))


def test_small_images_are_trimmed_some_at_a_time(spark, monkeypatch):
    """Images of one task don't see each other, and are fewer groups than images."""
    px = part_pixels(spark, SF, 2)
    seen, expand = [], affinity.kernels.expand_labels

    def counted(image, t, r, threshold, tall=None):
        seen.append(len(t))
        return expand(image, t, r, threshold, tall)

    frame = px.toPandas().sort_values(["image_id", "i"])
    alone = [expand(f[["r", "g", "b"]].to_numpy().reshape(-1, 40, 3), f["t"].to_numpy().reshape(-1, 40), 3, 0.4).ravel() for _, f in frame.groupby("image_id")]
    tall = frame[frame["h"] == 2]
    both = counted(tall[["r", "g", "b"]].to_numpy().reshape(-1, 40, 3), tall["t"].to_numpy().reshape(-1, 40), 3, 0.4, 2).ravel()
    assert np.array_equal(both, np.concatenate([t for t in alone if len(t) == 80])) and seen == [4]
    got = affinity.trim_edges(px, 4, 0.4, 0.3, in_tasks=True)
    assert "groupBy" not in _plan(got) and "batch" in _plan(got) and got.count() == 200


def test_a_neighbour_graph_is_found_once(spark):
    """Both directions and the row sums read the edges from one table."""
    px = part_pixels(spark, SF)
    assert "PandasCoGroup" not in (plan := _plan(affinity.knn_laplacian(px))) and "FlatMapCoGroups" not in plan


def test_neighbours_are_looked_for_region_by_region(spark, monkeypatch):
    """Only queries near a region's walls are shuffled again, and each find of a query is in one row, by both ways."""
    monkeypatch.setattr(neighbors, "BLOCK", 20)
    monkeypatch.setattr(neighbors, "REGION_LEVELS", 2)
    monkeypatch.setattr(neighbors, "REGION_QUERIES", (50, 100))
    rng, seen, paired = np.random.default_rng(5), [], neighbors._paired

    def counted(left, right, by, *rest):
        seen.append((by, left.count(), right.select("image_id", by).distinct().count()))
        return paired(left, right, by, *rest)

    monkeypatch.setattr(neighbors, "_paired", counted)
    v = np.round(rng.random((1500, 2)), 2)
    df = spark.createDataFrame([(0, i, *map(float, x)) for i, x in enumerate(v)], "image_id long, i long, a double, b double")
    got = neighbors.nearest(df, df, ["a", "b"], 4).orderBy("q", "rank").toPandas()
    d = ((v[:, None] - v[None]) ** 2)[:, :, 0] + ((v[:, None] - v[None]) ** 2)[:, :, 1]
    want = np.argsort(d, axis=1, kind="stable")[:, :4]
    assert np.array_equal(got["j"].to_numpy().reshape(-1, 4), want) and np.array_equal(got["rank"].to_numpy().reshape(-1, 4), np.tile([1, 2, 3, 4], (1500, 1)))
    assert np.array_equal(got["dist2"].to_numpy().reshape(-1, 4), np.take_along_axis(d, want, 1))
    assert [by for by, *_ in seen] == ["region", "region"] and seen[0][1] == 1500 and seen[0][2] > 16 and 0 < seen[1][1] < 1500


def test_features_of_a_tall_image(spark):
    """The squared height of an image of over 46,340 rows is no integer of 32 bits."""
    px = part_pixels(spark, SF).withColumn("h", F.lit(180_000))
    (row,) = affinity.knn_features(px.filter("i = 41")).collect()
    assert row.fy == 2 / (np.sqrt(40.0**2 + 180_000.0**2) / 2)


def test_a_neighbour_graph_adds_up_its_diagonal_only(spark):
    """Pairs are distinct already: entries beside the diagonal are not shuffled."""
    px = part_pixels(spark, SF)
    w = affinity.knn_graph(px)
    assert "Exchange" not in _plan(w) and w.groupBy("image_id", "i", "j").count().filter("count > 1").isEmpty()
    got = affinity.knn_laplacian(px)
    assert _plan(got).count("Exchange") == 1 and {(r.i, r.j): r.v for r in got.collect()} == {(r.i, r.j): r.v for r in linalg.laplacian(w, False).collect()}


def test_a_tall_image_is_trimmed_strip_by_strip(spark, monkeypatch):
    """Strips with enough rows around give what the whole image gives, beside images that are no taller than a strip."""
    rng, rows = np.random.default_rng(4), []
    for image, w, h in ((1, 6, 95), (2, 5, 7), (3, 4, 24), (4, 4, 25)):
        v, t = np.round(rng.random((w * h, 3)), 1), rng.choice([0.0, 0.5, 0.5, 0.5, 1.0], w * h)
        rows += [(image, i, i % w, i // w, w, h, *map(float, v[i]), float(t[i])) for i in range(w * h)]
    px = keep(spark.createDataFrame(rows, "image_id long, i long, x int, y int, w int, h int, r double, g double, b double, t double"))
    values = lambda: sorted(map(tuple, affinity.trim_edges(px, 3, 0.4, 0.3, in_tasks=True).collect()))
    whole = values()
    monkeypatch.setattr(affinity, "STRIP_PIXELS", 60)
    assert "strip" in _plan(affinity.trim_edges(px, 3, 0.4, 0.3, in_tasks=True)) and values() == whole and len(whole) == len(rows)
    assert any(0.2 < t < 0.8 for *_, t in whole) and sum(t == 0.5 for *_, t in whole) < sum(r[-1] == 0.5 for r in rows)


def test_a_symmetric_product_is_made_once_for_both_sides(spark):
    rng = np.random.default_rng(6)
    m, other = (np.where(rng.random((9, 9)) < 0.4, rng.random((9, 9)), 0.0) for _ in range(2))
    table = lambda a: spark.createDataFrame([(0, int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "image_id long, i long, j long, v double")
    upper = linalg.gram(table(m))
    assert upper.filter("i > j").isEmpty()
    got = linalg.add_to_symmetric(upper, table(other)).collect()
    dense = np.zeros((9, 9))
    for r in got:
        dense[r.i, r.j] += r.v
    assert np.allclose(dense, m.T @ m + other) and len(got) == np.count_nonzero(m.T @ m + other) == len({(r.i, r.j) for r in got})


def test_information_flow_is_added_up_once_by_shuffles(spark):
    px = part_pixels(spark, SF, 2)
    a, _ = affinity.information_flow_system(px)
    plan = _plan(a)
    assert "BroadcastHashJoin" not in plan and plan.count("keys=[image_id") <= 10
    m = keep(px.select("image_id", "i", (F.col("i") % 3).alias("j"), F.col("r").alias("v")))
    assert linalg.products(linalg.transpose(m), m).count() == m.count()


def _trimaps(spark):
    """Images of several sizes: plain, without background, all known, all unknown, flat, narrow."""
    rng, rows = np.random.default_rng(1), []
    for image, w, h in ((1, 9, 7), (2, 6, 5), (3, 5, 4), (4, 7, 4), (5, 6, 6), (6, 1, 5), (7, 1, 1)):
        v = rng.integers(0, 256, (w * h, 3)) if image != 5 else np.full((w * h, 3), 90)
        t = rng.choice({2: [1.0, 0.5], 3: [1.0, 0.0], 4: [0.5, 0.4]}.get(image, [0.0, 0.5, 0.9, 1.0]), w * h)
        rows += [(image, i, i % w, i // w, w, h, *map(int, v[i]), *(float(x / 255.0) for x in v[i]), float(t[i])) for i in range(w * h)]
    return spark.createDataFrame(rows, "image_id long, i long, x int, y int, w int, h int, r8 long, g8 long, b8 long, r double, g double, b double, t double")


def test_information_flow_of_small_images_equals_tables(spark):
    px = keep(_trimaps(spark))
    a, b = (x.toPandas() for x in affinity.information_flow_system(px))
    for image, frame in px.toPandas().sort_values(["image_id", "i"]).groupby("image_id"):
        got, right = flow.system(frame, flow.trim_edges(frame))
        own = a[a["image_id"] == image].sort_values(["i", "j"])
        assert np.array_equal(own["i"], got.i) and np.array_equal(own["j"], got.j)
        assert np.abs(own["v"] - got.v).max() < 1e-9
        assert np.abs(b[b["image_id"] == image].sort_values("i")["v"].to_numpy() - right).max() < 1e-9


def test_small_information_flow_makes_no_tables_of_entries(spark, monkeypatch):
    """Small images are built where they are solved; with larger ones beside them both forms give their part."""
    px = part_pixels(spark, SF, 2)
    alphas = lambda how: {(r.image_id, r.i): r.alpha for r in matte.alpha(px, "ifm", how, relative_tolerance=1e-6).collect()}
    monkeypatch.setattr(matte, "FLOW_PIXELS", 60)
    mixed = alphas("jacobi")
    monkeypatch.setattr(matte, "FLOW_PIXELS", 80)
    monkeypatch.delattr(affinity, "information_flow_system")
    for how in matte.METHODS["ifm"]:
        got = alphas(how)
        assert len(got) == 200 and got.keys() == mixed.keys()
        assert how != "jacobi" or max(abs(got[k] - mixed[k]) for k in got) < 1e-4


def test_steps_over_tables_are_dealt_by_rows(spark, monkeypatch):
    """Entries compress well, so tasks of some bytes would grow with the image; the answer stays."""
    px = part_pixels(spark, SF).withColumn("alpha", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (32 - F.col("x")) / 24.0)))
    want = color.estimate_closed_form(px, rtol=1e-13, max_iter=2, in_tasks=False).orderBy("i").toPandas()
    monkeypatch.setattr(lineage, "TASK_ROWS", 20)
    a, b = color.closed_form_system(px)
    assert "REPARTITION_BY_NUM" in _plan(a) and _plan(krylov.product(a, list("rgb"), 400)(b)).count("REPARTITION_BY_NUM") >= 3
    got = color.estimate_closed_form(px, rtol=1e-13, max_iter=2, in_tasks=False).orderBy("i").toPandas()
    assert np.abs(got - want).to_numpy().max() < 1e-9


def test_small_images_meet_some_at_a_time(spark):
    """Groups are batches of images, none of which sees another's points."""
    px = part_pixels(spark, SF, 2)
    found = neighbors.nearest(px, px.filter("image_id < 2"), ["r", "g"], 3)
    assert "batch" in _plan(found)
    frame, got = px.toPandas(), found.toPandas().sort_values(["image_id", "q", "rank"])
    assert set(got["image_id"]) == {0, 1}
    for image, own in frame[frame["image_id"] < 2].sort_values("i").groupby("image_id"):
        v = own[["r", "g"]].to_numpy()
        want = np.argsort(((v[:, None] - v[None]) ** 2).sum(2), axis=1, kind="stable")[:, :3]
        assert np.array_equal(got[got["image_id"] == image]["j"].to_numpy().reshape(-1, 3), want)
