"""SQL for DuckDB of the larger queries; fragments are common table expressions over ``px`` and ``taps``."""

from __future__ import annotations

_RGB = "rgb"
_PAIRS = [(a, b) for k, a in enumerate(_RGB) for b in _RGB[k:]]


def cofactors(m: dict[str, str]) -> tuple[dict[str, str], str]:
    """SQL of the cofactors and the determinant of a symmetric 3x3 matrix."""
    c = {
        "rr": f"({m['gg']} * {m['bb']} - {m['gb']} * {m['gb']})",
        "rg": f"({m['rb']} * {m['gb']} - {m['rg']} * {m['bb']})",
        "rb": f"({m['rg']} * {m['gb']} - {m['rb']} * {m['gg']})",
        "gg": f"({m['rr']} * {m['bb']} - {m['rb']} * {m['rb']})",
        "gb": f"({m['rb']} * {m['rg']} - {m['rr']} * {m['gb']})",
        "bb": f"({m['rr']} * {m['gg']} - {m['rg']} * {m['rg']})",
    }
    return c, f"({m['rr']} * {c['rr']} + {m['rg']} * {c['rg']} + {m['rb']} * {c['rb']})"


def inverse(name: str, source: str, m: dict[str, str], keep: str) -> str:
    """CTE ``name``: ``keep`` and the inverse's entries k_rr .. k_bb of the matrices of ``source``."""
    c, det = cofactors(m)
    return f""",
{name} AS MATERIALIZED (SELECT {keep}, {", ".join(f"{c[p]} / det AS k_{p}" for p in c)} FROM (SELECT *, {det} AS det FROM {source}))"""


def sandwich(k: str, left: str, right: str) -> str:
    """left' K right of columns such as ``left.format(c)``."""
    at = lambda a, b: f"{k}k_{a}{b}" if _RGB.index(a) <= _RGB.index(b) else f"{k}k_{b}{a}"
    return "(" + " + ".join(f"{left.format(a)} * ({' + '.join(f'{at(a, b)} * {right.format(b)}' for b in _RGB)})" for a in _RGB) + ")"


def features(name: str, xy: str) -> str:
    return f""",
{name} AS (SELECT i, t, r, g, b, ({xy}) * (x + 1) / w AS fx, ({xy}) * (y + 1) / h AS fy FROM px)"""


def nearest(name: str, source: str, columns: list[str], k: int, queries: str = "true", candidates: str = "true") -> str:
    d = "pow(p.{0} - c.{0}, 2)".format(columns[0])
    for x in columns[1:]:
        d = f"({d} + pow(p.{x} - c.{x}, 2))"
    return f""",
{name} AS MATERIALIZED (SELECT q, j, n FROM (
  SELECT p.i AS q, c.i AS j, row_number() OVER (PARTITION BY p.i ORDER BY {d}, c.i) AS n
  FROM (SELECT * FROM {source} WHERE {queries}) p, (SELECT * FROM {source} WHERE {candidates}) c) WHERE n <= {k})"""


UNKNOWN, KNOWN, FG, BG = "NOT (t > 0.8 OR t < 0.2)", "(t > 0.8 OR t < 0.2)", "t > 0.8", "t < 0.2"
FIVE = ["r", "g", "b", "fx", "fy"]


def weights(name: str, found: str) -> str:
    """CTE ``name`` (q, j, n, v): weights that rebuild each query's colour from its neighbours ``found`` (q, j, n)."""
    sums = ", ".join(f"sum(z_{a} * z_{b}) + {'1e-10' if a == b else '0.0'} AS {a}{b}" for a, b in _PAIRS)
    at = lambda a, b: f"k_{a}{b}" if _RGB.index(a) <= _RGB.index(b) else f"k_{b}{a}"
    solved = ", ".join(f"({' + '.join(f'{at(a, b)} * s_{b}' for b in _RGB)}) AS u_{a}" for a in _RGB)
    return (
        f""",
{name}_z AS MATERIALIZED (SELECT q, j, n, {", ".join(f"c.{a} - p.{a} AS z_{a}" for a in _RGB)} FROM {found} JOIN px p ON p.i = q JOIN px c ON c.i = j),
{name}_g AS (SELECT q, {", ".join(f"sum(z_{a}) AS s_{a}" for a in _RGB)}, {sums} FROM {name}_z GROUP BY q)"""
        + inverse(f"{name}_k", f"{name}_g", {a + b: a + b for a, b in _PAIRS}, "q, s_r, s_g, s_b")
        + f""",
{name}_u AS (SELECT q, {solved} FROM {name}_k),
{name}_w AS (SELECT q, j, n, 1 - (z_r * u_r + z_g * u_g + z_b * u_b) AS v FROM {name}_z JOIN {name}_u USING (q)),
{name} AS MATERIALIZED (SELECT q, j, n, v / sum(v) OVER (PARTITION BY q) AS v FROM {name}_w)"""
    )


def mixture(k: int = 20) -> str:
    return features("mix_f", "1.0::DOUBLE") + nearest("mix_n", "mix_f", FIVE, k, UNKNOWN) + weights("mix", "mix_n")


def similarity(k: int = 5) -> str:
    return (
        features("sim_f", "0.05::DOUBLE")
        + features("sim_s", "0.05::DOUBLE / 100.0::DOUBLE")
        + nearest("sim_a", "sim_f", FIVE, k, UNKNOWN, UNKNOWN)
        + nearest("sim_b", "sim_s", FIVE, -(-k // 5), UNKNOWN, UNKNOWN)
        + f""",
sim_w AS (SELECT q AS i, j, greatest(0.0, 1 - ({" + ".join(f"abs(p.{c} - o.{c})" for c in FIVE)}) / 5.0) / 2 AS v
  FROM (SELECT q, j FROM sim_a UNION ALL SELECT q, j FROM sim_b) JOIN sim_s p ON p.i = q JOIN sim_s o ON o.i = j),
sim AS MATERIALIZED (SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM sim_w UNION ALL SELECT j, i, v FROM sim_w) GROUP BY 1, 2)"""
    )


def local(inverse_cte: str) -> str:
    """``inverse_cte``: the closed-form fragment over windows ``mi``, giving ``affi``."""
    return (
        f""",
mi AS (SELECT m.* FROM m JOIN px USING (i) WHERE x >= 1 AND x < w - 1 AND y >= 1 AND y < h - 1
  AND i IN (SELECT p.i FROM px p JOIN px q ON q.x BETWEEN p.x - 1 AND p.x + 1 AND q.y BETWEEN p.y - 1 AND p.y + 1 WHERE NOT (q.t > 0.8 OR q.t < 0.2)))"""
        + inverse_cte
        + """,
local AS MATERIALIZED (SELECT i, j, v / CASE WHEN s < 0.05 THEN 1.0 ELSE s END AS v FROM (SELECT i, j, v, sum(v) OVER (PARTITION BY i) AS s FROM affi))"""
    )


def label_pass(old: str, new: str, r: int, threshold: float) -> str:
    size = 2 * r + 1
    return f""",
{new} AS MATERIALIZED (SELECT p.i, coalesce(o.label, p.t) AS t FROM {old} p LEFT JOIN (
  SELECT i, arg_min(label, d2 * 1000 + off) AS label FROM (
    SELECT p.i, kt.t AS label, (k.x - p.x) * (k.x - p.x) + (k.y - p.y) * (k.y - p.y) AS d2, (k.y - p.y + {r}) * {size} + k.x - p.x + {r} AS off
    FROM (SELECT px.* FROM px JOIN {old} o ON o.i = px.i WHERE NOT (o.t > 0.8 OR o.t < 0.2)) p
    JOIN px k ON k.x BETWEEN p.x - {r} AND p.x + {r} AND k.y BETWEEN p.y - {r} AND p.y + {r}
    JOIN {old} kt ON kt.i = k.i AND (kt.t > 0.8 OR kt.t < 0.2)
    WHERE ((p.g - k.g) * (p.g - k.g) + ((p.r - k.r) * (p.r - k.r)) + (p.b - k.b) * (p.b - k.b)) < {threshold!r}::DOUBLE * {threshold!r}::DOUBLE) GROUP BY i) o ON o.i = p.i)"""


def edge_trim(passes: int = 9, high: float = 8.11 / 256, low: float = 1 / 256) -> str:
    out = ", et0 AS (SELECT i, t FROM px)"
    for n in range(passes):
        out += label_pass(f"et{n}", f"et{n + 1}", n + 1, high + (low - high) * n / max(1, passes - 1))
    return out


def patches(k: int = 5) -> str:
    """CTE ``pd`` (i, fg, bg)."""
    scale = "(9.0::DOUBLE * 9.0 * 255.0 * 255.0)"
    cells = ", ".join(f"c_{a}{b} / {scale} + {'1e-8::DOUBLE / 9' if a == b else '0.0'} AS v_{a}{b}" for a, b in _PAIRS)
    out = f""",
pm AS MATERIALIZED (SELECT i, px.t, {", ".join(f"s_{a} / (9.0::DOUBLE * 255.0) AS m_{a}" for a in _RGB)}, {cells} FROM m JOIN px USING (i))"""
    for side, cond in (("fg", FG), ("bg", BG)):
        c, det = cofactors({a + b: f"((p.v_{a}{b} + o.v_{a}{b}) / 2)" for a, b in _PAIRS})
        at = lambda a, b, c=c, det=det: f"{c[a + b] if a + b in c else c[b + a]} / {det}"
        gap = " + ".join(f"(p.m_{a} - o.m_{a}) * ({' + '.join(f'{at(a, b)} * (p.m_{b} - o.m_{b})' for b in _RGB)})" for a in _RGB)
        d1, d2 = (cofactors({a + b: f"{s}.v_{a}{b}" for a, b in _PAIRS})[1] for s in ("p", "o"))
        out += nearest(f"pn_{side}", "pm", ["m_r", "m_g", "m_b"], k, UNKNOWN, cond)
        out += f""",
pd_{side} AS MATERIALIZED (SELECT q AS i, min(({gap}) / 8 + 0.5 * ln({det} / sqrt({d1} * {d2}))) AS {side} FROM pn_{side} JOIN pm p ON p.i = q JOIN pm o ON o.i = j GROUP BY q)"""
    return out + ", pd AS (SELECT i, fg, bg FROM pd_fg JOIN pd_bg USING (i))"


def patch_trim() -> str:
    return patches() + ", pt AS MATERIALIZED (SELECT px.i, CASE WHEN fg < 0.25 AND bg > 0.9 THEN 1.0 WHEN bg < 0.25 AND fg > 0.9 THEN 0.0 ELSE t END::DOUBLE AS t FROM px LEFT JOIN pd ON pd.i = px.i)"


def to_unknown(trimap: str, k: int = 7) -> str:
    """CTE ``ku`` (i, alpha, confidence) from the trimap table ``trimap`` (i, t)."""
    side = lambda c, f: f"sum(CASE WHEN {'' if f else 'NOT '}is_fg THEN v * {c} ELSE 0.0 END)"
    gap = " + ".join(f"pow({side(c, True)} - {side(c, False)}, 2)" for c in _RGB)
    return (
        f""",
ku_f AS (SELECT px.i, o.t, px.r, px.g, px.b, 10.0::DOUBLE * (px.x + 1) / px.w AS fx, 10.0::DOUBLE * (px.y + 1) / px.h AS fy FROM px JOIN {trimap} o ON o.i = px.i)"""
        + nearest("ku_a", "ku_f", FIVE, k, UNKNOWN, FG)
        + nearest("ku_b", "ku_f", FIVE, k, UNKNOWN, BG)
        + f", ku_n AS (SELECT q, j, n FROM ku_a UNION ALL SELECT q, j, n + {k} FROM ku_b)"
        + weights("ku_w2", "ku_n")
        + f""",
ku AS MATERIALIZED (SELECT q AS i, sum(CASE WHEN is_fg THEN v ELSE 0.0 END) AS alpha, ({gap}) / 3 AS confidence
  FROM ku_w2 JOIN (SELECT i AS j, r, g, b, t > 0.8 AS is_fg FROM ku_f) USING (j) GROUP BY q)"""
    )


def flow_system() -> str:
    """CTEs ``fa`` (i, j, v) and ``fb`` (i, v); expects ``mix``, ``local``, ``sim``, ``et9``, ``pt`` and ``ku``."""
    return """,
mm AS MATERIALIZED (SELECT i, j, sum(v) AS v FROM (SELECT q AS i, j, -v AS v FROM mix UNION ALL SELECT q, q, sum(v) FROM mix GROUP BY q) GROUP BY 1, 2),
fw AS MATERIALIZED (SELECT px.i, CASE WHEN px.t > 0.8 OR px.t < 0.2 THEN 100.0 ELSE 0.05::DOUBLE * CASE WHEN et9.t > 0.8 OR et9.t < 0.2 OR pt.t > 0.8 OR pt.t < 0.2 THEN 1.0 ELSE coalesce(confidence, 0.0) END END::DOUBLE AS k,
  CASE WHEN et9.t > 0.8 THEN 1.0 WHEN et9.t < 0.2 THEN 0.0 WHEN pt.t > 0.8 OR pt.t < 0.2 THEN pt.t ELSE coalesce(ku.alpha, 0.0) END::DOUBLE AS guess
  FROM px JOIN et9 ON et9.i = px.i JOIN pt ON pt.i = px.i LEFT JOIN ku ON ku.i = px.i),
fa AS (SELECT i, j, sum(v) AS v FROM (
  SELECT p.j AS i, q.j AS j, p.v * q.v AS v FROM mm p JOIN mm q ON p.i = q.i
  UNION ALL SELECT i, j, -v FROM local UNION ALL SELECT i, i, greatest(sum(v), 1e-10) FROM local GROUP BY i
  UNION ALL SELECT i, j, -0.01::DOUBLE * v FROM sim UNION ALL SELECT i, i, 0.01::DOUBLE * greatest(sum(v), 1e-10) FROM sim GROUP BY i
  UNION ALL SELECT i, i, k FROM fw) GROUP BY 1, 2),
fb AS (SELECT i, k * guess AS v FROM fw)"""


def window_sums(name: str, source: str, r: int, columns: dict[str, str], inside: bool) -> str:
    """CTE ``name`` (x, y, w, h, columns): sums of SQL expressions over windows; ``inside``: of centres whose window lies inside ``source``."""
    bound = f"WHERE c.x >= {r} AND c.x < c.w - {r} AND c.y % 1000000 >= {r} AND c.y % 1000000 < c.h - {r}" if inside else ""
    return f""",
{name} AS MATERIALIZED (SELECT c.x, c.y, c.w, c.h, {", ".join(f"sum({e}) AS {n}" for n, e in columns.items())}
  FROM (SELECT DISTINCT x, y, w, h FROM {source}) c JOIN {source} n ON n.x BETWEEN c.x - {r} AND c.x + {r} AND n.y BETWEEN c.y - {r} AND c.y + {r} {bound} GROUP BY ALL)"""


def spread_sums(name: str, source: str, r: int, columns: list[str], image: str = "px") -> str:
    """CTE ``name`` (x, y, columns): at each pixel the sums over the centres of ``source`` around it; 0 without any."""
    return f""",
{name} AS MATERIALIZED (SELECT p.x, p.y, {", ".join(f"coalesce(sum(s.{c}), 0.0) AS {c}" for c in columns)}
  FROM {image} p LEFT JOIN {source} s ON s.x BETWEEN p.x - {r} AND p.x + {r} AND s.y BETWEEN p.y - {r} AND p.y + {r} GROUP BY p.x, p.y)"""


def local_inverse(r: int, eps: str) -> str:
    """CTE ``li`` (x, y, m_r .. m_b, k_rr .. k_bb) of valid windows."""
    n = float((2 * r + 1) ** 2)
    sums = {f"s_{a}": f"n.{a}" for a in _RGB} | {f"p_{a}{b}": f"n.{a} * n.{b}" for a, b in _PAIRS}
    cov = {a + b: f"(p_{a}{b} / {n}::DOUBLE - s_{a} / {n}::DOUBLE * s_{b} / {n}::DOUBLE + {eps + f'::DOUBLE / {n}' if a == b else '0.0'})" for a, b in _PAIRS}
    return window_sums("ls", "px", r, sums, True) + inverse("li", "ls", cov, ", ".join(["x", "y", *[f"s_{a} / {n}::DOUBLE AS m_{a}" for a in _RGB]]))


def large_kernel_matrix(r: int, eps: str = "1e-4") -> str:
    """CTE ``lk`` (i, j, v): the large-kernel Laplacian written out."""
    n = float((2 * r + 1) ** 2)
    return (
        local_inverse(r, eps)
        + f""",
lt AS MATERIALIZED (SELECT li.x AS cx, li.y AS cy, p.i, {", ".join(f"p.{a} - m_{a} AS d_{a}" for a in _RGB)}, {", ".join(f"k_{a}{b}" for a, b in _PAIRS)}
  FROM li JOIN px p ON p.x BETWEEN li.x - {r} AND li.x + {r} AND p.y BETWEEN li.y - {r} AND li.y + {r}),
lk AS MATERIALIZED (SELECT i, j, sum(v) AS v FROM (
  SELECT p.i, q.i AS j, -(1 + {sandwich("p.", "p.d_{}", "q.d_{}")}) / {n}::DOUBLE AS v FROM lt p JOIN lt q ON p.cx = q.cx AND p.cy = q.cy
  UNION ALL SELECT i, i, 1.0 FROM lt) GROUP BY 1, 2)"""
    )


def guided(image: str, r: int, eps: str = "1e-4") -> str:
    """CTE ``gs`` (x, y, a_r .. a_0, one): sums of the local models of column alpha around each pixel of ``image``."""
    n = f"{float((2 * r + 1) ** 2)}::DOUBLE"
    sums = {f"s_{a}": f"n.{a}" for a in _RGB} | {"s_q": "n.alpha"} | {f"p_{a}{b}": f"n.{a} * n.{b}" for a, b in _PAIRS} | {f"q_{a}": f"n.alpha * n.{a}" for a in _RGB}
    cov = {a + b: f"(p_{a}{b} / {n} - s_{a} / {n} * (s_{b} / {n}) + {eps + '::DOUBLE' if a == b else '0.0'})" for a, b in _PAIRS}
    keep = ["x", "y", f"s_q / {n} AS q", *[f"s_{a} / {n} AS m_{a}" for a in _RGB], *[f"q_{a} / {n} - s_{a} / {n} * (s_q / {n}) AS v_{a}" for a in _RGB]]
    at = lambda a, b: f"k_{a}{b}" if _RGB.index(a) <= _RGB.index(b) else f"k_{b}{a}"
    slopes = ", ".join(f"{' + '.join(f'{at(a, b)} * v_{b}' for b in _RGB)} AS a_{a}" for a in _RGB)
    return (
        window_sums("gw", image, r, sums, True)
        + inverse("gk", "gw", cov, ", ".join(keep))
        + f""",
gm AS MATERIALIZED (SELECT *, q - (a_r * m_r + a_g * m_g + a_b * m_b) AS a_0, 1.0::DOUBLE AS one FROM (SELECT *, {slopes} FROM gk))"""
        + spread_sums("gs", "gm", r, ["a_r", "a_g", "a_b", "a_0", "one"], image)
    )


def conjugate_gradients(a: str, b: str, steps: int, goal: float, name: str = "solved") -> str:
    """CTE ``name`` (i, v): at most ``steps`` steps of Jacobi-preconditioned CG on tables ``a`` (i, j, v) and ``b`` (i, v)."""
    return f""",
{name}_d AS MATERIALIZED (SELECT i, v FROM {a} WHERE i = j),
{name}_s(i, k, d, x, r, z, p, rz, size) USING KEY (i) AS (
  SELECT i, 0, d, 0.0::DOUBLE, r, z, z, sum(r * z) OVER (), sum(r * r) OVER () FROM (SELECT i, {name}_d.v AS d, {b}.v AS r, {b}.v / {name}_d.v AS z FROM {b} JOIN {name}_d USING (i))
  UNION
  SELECT i, k + 1, d, x, r, z, z + rz2 / rz * p, rz2, size FROM (
    SELECT *, sum(r * z) OVER () AS rz2, sum(r * r) OVER () AS size FROM (
      SELECT k, i, d, rz, p, x + step * p AS x, r - step * q AS r, (r - step * q) / d AS z FROM (
        SELECT s.*, ap.q, rz / sum(p * ap.q) OVER () AS step FROM {name}_s s JOIN (SELECT m.i AS ai, sum(m.v * s.p) AS q FROM {a} m JOIN {name}_s s ON s.i = m.j GROUP BY m.i) ap ON ap.ai = s.i
        WHERE k < {steps} AND size > {goal!r} * {goal!r})))),
{name} AS (SELECT i, x AS v FROM {name}_s)"""


def some_steps(name: str, a: str, b: str, steps: int, diagonal: bool = True) -> str:
    """CTE ``name`` (i, v): exactly ``steps`` steps of CG from zero on tables ``a`` (i, j, v) and ``b`` (i, v)."""
    d = f"(SELECT i, v FROM {a} WHERE i = j)" if diagonal else f"(SELECT i, 1.0::DOUBLE AS v FROM {b})"
    out = f""",
{name}_d AS MATERIALIZED {d},
{name}_0 AS MATERIALIZED (SELECT i, d.v AS d, 0.0::DOUBLE AS x, {b}.v AS r, {b}.v / d.v AS z, {b}.v / d.v AS p FROM {b} JOIN {name}_d d USING (i))"""
    for n in range(steps):
        out += f""",
{name}_q{n} AS MATERIALIZED (SELECT m.i, sum(m.v * g.p) AS q FROM {a} m JOIN {name}_{n} g ON g.i = m.j GROUP BY m.i),
{name}_t{n} AS MATERIALIZED (SELECT rz, rz / pq AS k FROM (SELECT sum(r * z) AS rz, sum(p * q) AS pq FROM {name}_{n} JOIN {name}_q{n} USING (i))),
{name}_u{n} AS MATERIALIZED (SELECT i, d, x + k * p AS x, r - k * q AS r, (r - k * q) / d AS z, p, rz FROM {name}_{n} JOIN {name}_q{n} USING (i), {name}_t{n}),
{name}_{n + 1} AS MATERIALIZED (SELECT i, d, x, r, z, z + (SELECT sum(r * z) FROM {name}_u{n}) / rz * p AS p FROM {name}_u{n})"""
    return out + f", {name} AS (SELECT i, x AS v FROM {name}_{steps})"


def sweep(colours: int = 3) -> str:
    """CTE ``gs`` (i, v): one sweep from zero over colours by row and column, for tables ``a``, ``b`` and ``dg`` of ``px``."""
    out = ", gs0 AS (SELECT i, 0.0::DOUBLE AS v FROM px)"
    for c in range(colours * colours):
        out += f""",
gs{c + 1} AS MATERIALIZED (SELECT px.i, CASE WHEN (yl % {colours}) * {colours} + x % {colours} = {c} THEN (b.v - coalesce(s.v, 0.0)) / dg.v ELSE o.v END AS v
  FROM px JOIN gs{c} o USING (i) JOIN b USING (i) JOIN dg USING (i) LEFT JOIN (SELECT a.i, sum(a.v * o.v) AS v FROM a JOIN gs{c} o ON o.i = a.j WHERE a.i <> a.j GROUP BY a.i) s ON s.i = px.i)"""
    return out + f", gs AS (SELECT i, v FROM gs{colours * colours})"


def v_cycle(levels: int, coarse: int = 256, omega: float = 0.8) -> str:
    """CTE ``vz0`` (i, v): one V-cycle for tables ``a`` and ``b`` of the image ``dims``; a level of few unknowns is solved, and those below it are empty."""
    out = ", va0 AS (SELECT i, j, v FROM a), vb0 AS (SELECT i, v FROM b), vs0 AS (SELECT w, h, w * h > %d AND least(w, h) >= 2 AS deeper FROM dims)" % coarse
    for n in range(levels):
        out += f""",
vr{n} AS MATERIALIZED (SELECT i, x + y * w AS j, k AS v FROM (SELECT c.x + c.y * (w // 2) AS i, 2 * c.x + dx AS x, 2 * c.y + dy AS y, (2 - abs(dx)) * (2 - abs(dy)) / 16.0::DOUBLE AS k, w, h
  FROM (SELECT w, h, x, y FROM vs{n}, LATERAL (SELECT unnest(range(w // 2)) AS x) a, LATERAL (SELECT unnest(range(h // 2)) AS y) b WHERE deeper) c, nine) WHERE x >= 0 AND x < w AND y >= 0 AND y < h),
vd{n} AS MATERIALIZED (SELECT i, v FROM va{n} WHERE i = j),
vx{n} AS MATERIALIZED (SELECT i, {omega} * o.v / d.v AS v FROM vb{n} o JOIN vd{n} d USING (i)),
vq{n} AS MATERIALIZED (SELECT o.i, o.v - s.v AS v FROM vb{n} o JOIN (SELECT m.i, sum(m.v * x.v) AS v FROM va{n} m JOIN vx{n} x ON x.i = m.j GROUP BY m.i) s USING (i)),
vb{n + 1} AS MATERIALIZED (SELECT r.i, sum(r.v * q.v) AS v FROM vr{n} r JOIN vq{n} q ON q.i = r.j GROUP BY r.i),
vm{n} AS MATERIALIZED (SELECT r.i, m.j, sum(r.v * m.v) AS v FROM vr{n} r JOIN va{n} m ON m.i = r.j GROUP BY 1, 2),
va{n + 1} AS MATERIALIZED (SELECT m.i, r.i AS j, sum(m.v * r.v) AS v FROM vm{n} m JOIN vr{n} r ON r.j = m.j GROUP BY 1, 2),
vs{n + 1} AS (SELECT w // 2 AS w, h // 2 AS h, (w // 2) * (h // 2) > {coarse} AND least(w // 2, h // 2) >= 2 AS deeper FROM vs{n} WHERE deeper)"""
    for n in range(levels + 1):
        out += f", ve{n} AS MATERIALIZED (SELECT m.* FROM va{n} m, vs{n} WHERE NOT deeper)" + conjugate_gradients(f"ve{n}", f"vb{n}", 3000, 1e-11, f"vf{n}")
    out += f", vz{levels} AS (SELECT i, v FROM vf{levels})"
    for n in range(levels - 1, -1, -1):
        out += f""",
vy{n} AS MATERIALIZED (SELECT i, x.v + coalesce(c.v, 0.0) AS v FROM vx{n} x LEFT JOIN (SELECT r.j AS i, sum(r.v * z.v) AS v FROM vr{n} r JOIN vz{n + 1} z ON z.i = r.i GROUP BY r.j) c USING (i)),
vz{n} AS MATERIALIZED (SELECT y.i, y.v + {omega} * (o.v - s.v) / d.v AS v FROM vy{n} y JOIN vb{n} o USING (i) JOIN vd{n} d USING (i)
  JOIN (SELECT m.i, sum(m.v * y.v) AS v FROM va{n} m JOIN vy{n} y ON y.i = m.j GROUP BY m.i) s USING (i), vs{n} WHERE deeper UNION ALL SELECT i, v FROM vf{n})"""
    return out
