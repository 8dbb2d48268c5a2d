"""SQL of the registered queries for an independent engine: plain set logic over the same tables."""

from __future__ import annotations

import math

#: Voxel sizes of the registered queries.
H, FINE = 0.1, 0.05
#: Work limits of a sweep that some frames of the tables pass: compressed cells, cells that events cover, rectangles.
FILL = 0.78  # distance of added points from boxes in hulls of shapes, in voxels
TIGHT_CELLS, TIGHT_UPDATES, TIGHT_PRISMS = 850, 130, 100


def _index(c: str, h: float) -> str:
    f = f"CAST(floor({c} / {h}) AS BIGINT)"
    return f"CASE WHEN {c} < {f} * {h}::DOUBLE THEN {f} - 1 WHEN {c} >= ({f} + 1) * {h}::DOUBLE THEN {f} + 1 ELSE {f} END"


_POINTS = """pts AS (SELECT CAST(label AS BIGINT) AS frame_id, vec_id * 21 + k AS point_id,
  CAST(embedding[3 * k + 1] AS DOUBLE) AS x, CAST(embedding[3 * k + 2] AS DOUBLE) AS y, CAST(embedding[3 * k + 3] AS DOUBLE) AS z
  FROM embeddings, (SELECT unnest(range(21)) AS k))"""
_LINES = """pts AS (SELECT CAST(year(l_shipdate) AS BIGINT) AS frame_id, l_orderkey * 8 + l_linenumber AS point_id,
  l_quantity / 50 AS x, l_discount * 10 AS y, l_extendedprice / 1e5 AS z FROM lineitem)"""


def _base(h: float, points: str = _POINTS) -> str:
    """Points, their voxels (pv) and the distinct voxels (vox)."""
    ix = ", ".join(f"{_index(c, h)} AS i{c}" for c in "xyz")
    return f"{points}, pv AS (SELECT *, {ix} FROM pts), vox AS (SELECT DISTINCT frame_id, ix, iy, iz FROM pv)"


_FACES = """sides AS (SELECT * FROM (VALUES (0,-1,-1,0,0),(0,1,1,0,0),(1,-1,0,-1,0),(1,1,0,1,0),(2,-1,0,0,-1),(2,1,0,0,1)) t(axis, sign, dx, dy, dz)),
faces AS (SELECT v.frame_id, v.ix, v.iy, v.iz, s.axis, s.sign,
  CASE s.axis WHEN 0 THEN v.ix WHEN 1 THEN v.iy ELSE v.iz END + CASE WHEN s.sign > 0 THEN 1 ELSE 0 END AS plane,
  CASE s.axis WHEN 0 THEN v.iy WHEN 1 THEN v.iz ELSE v.ix END AS u, CASE s.axis WHEN 0 THEN v.iz WHEN 1 THEN v.ix ELSE v.iy END AS v
  FROM vox v CROSS JOIN sides s
  WHERE NOT EXISTS (SELECT 1 FROM vox n WHERE n.frame_id = v.frame_id AND n.ix = v.ix + s.dx AND n.iy = v.iy + s.dy AND n.iz = v.iz + s.dz))"""

_PATCHES = """runs AS (SELECT frame_id, axis, sign, plane, v, min(u) AS u0, max(u) + 1 AS u1 FROM
    (SELECT *, u - row_number() OVER (PARTITION BY frame_id, axis, sign, plane, v ORDER BY u) AS g FROM faces) GROUP BY frame_id, axis, sign, plane, v, g),
patches AS (SELECT frame_id, axis, sign, plane, u0, u1, min(v) AS v0, max(v) + 1 AS v1, (u1 - u0) * (max(v) + 1 - min(v)) AS faces FROM
    (SELECT *, v - row_number() OVER (PARTITION BY frame_id, axis, sign, plane, u0, u1 ORDER BY v) AS g FROM runs) GROUP BY frame_id, axis, sign, plane, u0, u1, g)"""

_SUPPORTS = """planes AS (SELECT frame_id, axis, plane AS coord, bit_or(CASE WHEN sign < 0 THEN 1 ELSE 2 END) AS signs, count(*) AS faces FROM faces GROUP BY frame_id, axis, plane),
supports AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY axis, coord) - 1 AS support_id FROM planes)"""

_CELLS = """slots AS (SELECT frame_id, axis, coord AS lo, lead(coord) OVER (PARTITION BY frame_id, axis ORDER BY coord) AS hi,
    row_number() OVER (PARTITION BY frame_id, axis ORDER BY coord) AS c FROM planes),
cells AS (SELECT v.frame_id, x.c AS cx, y.c AS cy, z.c AS cz, count(*) AS voxels, any_value(x.hi - x.lo) AS wx, any_value(y.hi - y.lo) AS wy, any_value(z.hi - z.lo) AS wz
  FROM vox v JOIN slots x ON x.frame_id = v.frame_id AND x.axis = 0 AND v.ix >= x.lo AND v.ix < x.hi
  JOIN slots y ON y.frame_id = v.frame_id AND y.axis = 1 AND v.iy >= y.lo AND v.iy < y.hi
  JOIN slots z ON z.frame_id = v.frame_id AND z.axis = 2 AND v.iz >= z.lo AND v.iz < z.hi GROUP BY v.frame_id, x.c, y.c, z.c)"""

_FREE = """free AS (SELECT x.frame_id, x.c AS cx, y.c AS cy, z.c AS cz, x.lo AS lox, x.hi AS hix, y.lo AS loy, y.hi AS hiy, z.lo AS loz, z.hi AS hiz
  FROM slots x JOIN slots y ON x.frame_id = y.frame_id AND y.axis = 1 JOIN slots z ON x.frame_id = z.frame_id AND z.axis = 2
  WHERE x.axis = 0 AND x.hi IS NOT NULL AND y.hi IS NOT NULL AND z.hi IS NOT NULL AND NOT EXISTS
    (SELECT 1 FROM cells k WHERE k.frame_id = x.frame_id AND k.cx = x.c AND k.cy = y.c AND k.cz = z.c))"""

_BOUNDS = """bounds AS (SELECT frame_id, count(*) AS voxels, min(ix) AS min_ix, min(iy) AS min_iy, min(iz) AS min_iz, max(ix) AS max_ix, max(iy) AS max_iy, max(iz) AS max_iz,
  CAST(ceil(log2(greatest(max(ix) - min(ix), max(iy) - min(iy), max(iz) - min(iz)) + 1)) AS INTEGER) AS depth FROM vox GROUP BY frame_id)"""

_NODES = f"""{_BOUNDS}, lv AS (SELECT v.frame_id, CAST(l AS INTEGER) AS level, (ix - min_ix) >> CAST(l AS INTEGER) AS nx, (iy - min_iy) >> CAST(l AS INTEGER) AS ny, (iz - min_iz) >> CAST(l AS INTEGER) AS nz
  FROM vox v JOIN bounds USING (frame_id), (SELECT unnest(range(0, 30)) AS l) WHERE l <= depth),
nodes AS (SELECT frame_id, level, nx, ny, nz, count(*) AS voxels FROM lv GROUP BY ALL),
fulls AS (SELECT * FROM nodes WHERE voxels = (1::BIGINT << (3 * level))),
cut AS (SELECT f.* FROM fulls f WHERE NOT EXISTS (SELECT 1 FROM fulls p WHERE p.frame_id = f.frame_id AND p.level = f.level + 1 AND p.nx = f.nx >> 1 AND p.ny = f.ny >> 1 AND p.nz = f.nz >> 1))"""

_BOXES = """boxes AS (SELECT c.frame_id, (nx << level) + min_ix AS lox, (ny << level) + min_iy AS loy, (nz << level) + min_iz AS loz, 1::BIGINT << level AS w,
  row_number() OVER (PARTITION BY c.frame_id ORDER BY (nx << level) + min_ix, (ny << level) + min_iy, (nz << level) + min_iz) - 1 AS cell_id
  FROM cut c JOIN bounds USING (frame_id)),
bp AS (SELECT frame_id, cell_id, axis, sign, CASE axis WHEN 0 THEN lox WHEN 1 THEN loy ELSE loz END + CASE WHEN sign > 0 THEN w ELSE 0 END AS coord
  FROM boxes, (SELECT * FROM (VALUES (0), (1), (2)) a(axis), (VALUES (-1), (1)) s(sign)))"""

#: Points moved up by a voxel, and the closed boxes that hold them.
_SHIFTED = f"mv AS (SELECT frame_id, point_id, x + {H} AS x, y, z FROM pts)"
_MOVED = f"""{_SHIFTED},
mi AS (SELECT *, {", ".join(f"{_index(c, H)} AS i{c}" for c in "xyz")} FROM mv),
near AS (SELECT DISTINCT frame_id, point_id FROM mi, (SELECT unnest([0, 1]) AS dx), (SELECT unnest([0, 1]) AS dy), (SELECT unnest([0, 1]) AS dz)
  WHERE (dx = 0 OR x = ix * {H}::DOUBLE) AND (dy = 0 OR y = iy * {H}::DOUBLE) AND (dz = 0 OR z = iz * {H}::DOUBLE)
  AND EXISTS (SELECT 1 FROM vox v WHERE v.frame_id = mi.frame_id AND v.ix = mi.ix - dx AND v.iy = mi.iy - dy AND v.iz = mi.iz - dz)),
flagged AS (SELECT mv.*, near.point_id IS NOT NULL AS inside FROM mv LEFT JOIN near USING (frame_id, point_id))"""

#: Half-grid probes and how many of the voxels around each are occupied.
_HALF = """half AS (SELECT DISTINCT frame_id, 2 * ix + a AS kx, 2 * iy + b AS ky, 2 * iz + c AS kz FROM vox, (SELECT unnest([0, 1, 2]) AS a), (SELECT unnest([0, 1, 2]) AS b), (SELECT unnest([0, 1, 2]) AS c)),
around AS (SELECT half.*, (kx >> 1) - dx AS ix, (ky >> 1) - dy AS iy, (kz >> 1) - dz AS iz FROM half, (SELECT unnest([0, 1]) AS dx), (SELECT unnest([0, 1]) AS dy), (SELECT unnest([0, 1]) AS dz)
  WHERE (dx = 0 OR kx & 1 = 0) AND (dy = 0 OR ky & 1 = 0) AND (dz = 0 OR kz & 1 = 0)),
signs AS (SELECT a.frame_id, kx, ky, kz, CAST(CASE WHEN count(v.ix) = count(*) THEN 1 WHEN count(v.ix) = 0 THEN -1 ELSE 0 END AS INTEGER) AS sign, count(v.ix) AS occupied
  FROM around a LEFT JOIN vox v ON v.frame_id = a.frame_id AND v.ix = a.ix AND v.iy = a.iy AND v.iz = a.iz GROUP BY a.frame_id, kx, ky, kz)"""


def _surface(h: float = H, *more: str, points: str = _POINTS) -> str:
    return "WITH " + ", ".join([_base(h, points), _FACES, *more]) + "\n"


_SUMMARY_OF = """SELECT frame_id, max(voxels) FILTER (what = 'v') AS voxels, max(voxels) FILTER (what = 'f') AS faces,
  max(voxels) FILTER (what = 'p') AS patches, max(voxels) FILTER (what = 's') AS supports FROM (
  SELECT frame_id, 'v' AS what, count(*) AS voxels FROM vox GROUP BY ALL UNION ALL SELECT frame_id, 'f', count(*) FROM faces GROUP BY ALL
  UNION ALL SELECT frame_id, 'p', count(*) FROM patches GROUP BY ALL UNION ALL SELECT frame_id, 's', count(*) FROM planes GROUP BY ALL) GROUP BY frame_id"""

def _merge(name: str, source: str, axis: str) -> str:
    across = ", ".join(f"{e}{c}" for c in "xyz" if c != axis for e in ("lo", "hi"))
    return f"""{name}a AS (SELECT *, CASE WHEN lag(hi{axis}) OVER w = lo{axis} THEN 0 ELSE 1 END AS s FROM {source} WINDOW w AS (PARTITION BY frame_id, {across} ORDER BY lo{axis})),
{name}b AS (SELECT *, sum(s) OVER (PARTITION BY frame_id, {across} ORDER BY lo{axis}) AS g FROM {name}a),
{name} AS (SELECT frame_id, {across}, min(lo{axis}) AS lo{axis}, max(hi{axis}) AS hi{axis} FROM {name}b GROUP BY frame_id, {across}, g)"""


def _prisms(axis: int) -> tuple[str, str]:
    """Merged free prisms of a sweep along an axis, as a query over ``free`` and what stands before it."""
    s, u, v = ("xyz"[(axis + k) % 3] for k in range(3))

    def slab(row: str, col: str, name: str) -> str:
        return f"""{name}0 AS (SELECT *, c{col} - row_number() OVER (PARTITION BY frame_id, c{s}, c{row} ORDER BY c{col}) AS g FROM free),
{name}1 AS (SELECT frame_id, c{s}, c{row}, g, min(lox) AS lox, min(loy) AS loy, min(loz) AS loz, max(hix) AS hix, max(hiy) AS hiy, max(hiz) AS hiz FROM {name}0 GROUP BY frame_id, c{s}, c{row}, g),
{name}2 AS (SELECT *, c{row} - row_number() OVER (PARTITION BY frame_id, c{s}, lo{col}, hi{col} ORDER BY c{row}) AS k FROM {name}1),
{name} AS (SELECT frame_id, c{s} AS slab, min(lox) AS lox, min(loy) AS loy, min(loz) AS loz, max(hix) AS hix, max(hiy) AS hiy, max(hiz) AS hiz FROM {name}2 GROUP BY frame_id, c{s}, lo{col}, hi{col}, k)"""

    parts = [slab(u, v, f"st{axis}"), slab(v, u, f"ac{axis}")]
    parts.append(
        f"pk{axis} AS (SELECT frame_id, slab, sum(a) AS a, sum(b) AS b FROM (SELECT frame_id, slab, 1 AS a, 0 AS b FROM st{axis} UNION ALL SELECT frame_id, slab, 0, 1 FROM ac{axis}) GROUP BY ALL)"
    )
    parts.append(
        f"r{axis} AS (SELECT t.* FROM st{axis} t JOIN pk{axis} p USING (frame_id, slab) WHERE p.b >= p.a UNION ALL SELECT t.* FROM ac{axis} t JOIN pk{axis} p USING (frame_id, slab) WHERE p.b < p.a)"
    )
    last = f"r{axis}"
    for turn in range(4):
        for c in "xyz":
            parts.append(_merge(f"m{axis}{turn}{c}", last, c))
            last = f"m{axis}{turn}{c}"
    return ", ".join(parts), last


#: Fewest disjoint boxes that make up each mask of a node's eight children, by adding boxes one at a time.
_COVERS = """sp AS (SELECT * FROM (VALUES (0, 1), (0, 2), (1, 1)) t(lo, w)),
bxs AS (SELECT (SELECT bit_or(1 << (4 * i + 2 * j + k)) FROM (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j), (SELECT unnest([0, 1]) AS k)
    WHERE i >= a.lo AND i < a.lo + a.w AND j >= b.lo AND j < b.lo + b.w AND k >= c.lo AND k < c.lo + c.w) AS m FROM sp a, sp b, sp c),
cov AS (SELECT 0 AS mask, 0 AS n UNION SELECT cov.mask | m, n + 1 FROM cov, bxs WHERE cov.mask & m = 0 AND n < 8),
fewest AS (SELECT mask, min(n) AS n FROM cov GROUP BY mask)"""

_NATIONS = """bx AS (SELECT *, x0 + k % 4 + 1 AS x1, y0 + k % 2 + 1 AS y1, z0 + k % 3 + 2 AS z1 FROM
  (SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_nationkey AS BIGINT) AS frame_id, n_nationkey % 3 - 1 AS x0, n_nationkey % 5 - 2 AS y0, n_nationkey % 2 + 1 AS z0 FROM nation))"""

#: Sharpness of the functions of single boxes for an error: five nested minima of two.
_WEIGHT = 5 * math.log(2.0)


def _box_function(error: float, keys: str) -> str:
    """Relations w0 .. w5 over ``pnt`` (keys, frame_id, x, y, z): the function of a box, minima of two in the order in which
    the box is cut, with its smoothed value v and gradient dx, dy, dz."""
    b = f"{_WEIGHT / error!r}::DOUBLE"

    def step(name: str, source: str, a: str, c: str, slopes: dict[str, tuple[str, str]]) -> str:
        carried = "xa, xb, ya, yb, za, zb, q"
        grads = ", ".join(f"w * ({p}) + (1 - w) * ({r}) AS {d}" for d, (p, r) in slopes.items())
        return f"""{name} AS (SELECT {keys}, {carried}, least(a, c) + ln(1 + (1 - e) / (1 + e)) / {b} AS v, {grads} FROM (
    SELECT *, CASE WHEN a <= c THEN 1 / (1 + e) ELSE e / (1 + e) END AS w FROM (SELECT *, exp(-{b} * abs(a - c)) AS e FROM (SELECT *, {a} AS a, {c} AS c FROM {source}))))"""

    start = f"""w0 AS (SELECT {keys}, x - x0 * {H}::DOUBLE AS xa, x1 * {H}::DOUBLE - x AS xb, y - y0 * {H}::DOUBLE AS ya, y1 * {H}::DOUBLE - y AS yb, z - z0 * {H}::DOUBLE AS za, z1 * {H}::DOUBLE - z AS zb,
    least(xa, xb, ya, yb, za, zb) AS q FROM pnt JOIN bx USING (frame_id))"""
    zero = ("0.0::DOUBLE", "0.0::DOUBLE")
    return ", ".join([
        start,
        step("w1", "w0", "za", "zb", {"dx": zero, "dy": zero, "dz": ("1", "-1")}),
        step("w2", "w1", "v", "yb", {"dx": zero, "dy": ("dy", "-1"), "dz": ("dz", "0")}),
        step("w3", "w2", "ya", "v", {"dx": zero, "dy": ("1", "dy"), "dz": ("0", "dz")}),
        step("w4", "w3", "v", "xb", {"dx": ("dx", "-1"), "dy": ("dy", "0"), "dz": ("dz", "0")}),
        step("w5", "w4", "xa", "v", {"dx": ("1", "dx"), "dy": ("0", "dy"), "dz": ("0", "dz")}),
    ])


#: Ls of two boxes: the inner corner is at x1, y1.
_LS = """ls AS (SELECT *, x1 + k % 4 + 1 AS x2, y1 + k % 2 + 1 AS y2, z0 + k % 3 + 1 AS z1 FROM (SELECT *, x0 + k % 2 + 1 AS x1, y0 + k % 3 + 1 AS y1 FROM
  (SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_nationkey AS BIGINT) AS frame_id, CAST(n_nationkey % 3 - 1 AS BIGINT) AS x0, CAST(n_nationkey % 5 - 2 AS BIGINT) AS y0, CAST(n_nationkey % 2 + 1 AS BIGINT) AS z0 FROM nation)))"""

#: Their function from its innermost node outward: cut at the bounds of z and x, at the lower y, at the inner corner, at the upper y.
_L_NODES = [("n1", "MIN", "yb", "xm"), ("n2", "MAX", "n1", "ym"), ("n3", "MIN", "ya", "n2"), ("n4", "MIN", "n3", "xb"), ("n5", "MIN", "xa", "n4"), ("n6", "MIN", "n5", "zb"), ("n7", "MIN", "za", "n6")]


def _l_function(error: float, keys: str) -> str:
    """Relations m0 .. m7 over ``pnt`` (keys, frame_id, x, y, z): nodes of the function of an L, smoothed, with gradients."""
    b = f"{len(_L_NODES) * math.log(2.0) / error!r}::DOUBLE"
    sides = {"xa": "x - x0 * h", "xm": "x1 * h - x", "xb": "x2 * h - x", "ya": "y - y0 * h", "ym": "y1 * h - y", "yb": "y2 * h - y", "za": "z - z0 * h", "zb": "z1 * h - z"}
    slopes = {f"{n}_{c}": (("1.0" if n[1] == "a" else "-1.0") if n[0] == c else "0.0") + "::DOUBLE" for n in sides for c in "xyz"}
    planes = ", ".join(f"{e.replace('h', f'{H}::DOUBLE', 1)} AS {n}" for n, e in sides.items())
    flat = ", ".join(f"{v} AS {n}" for n, v in slopes.items())
    hard = "least(za, zb, xa, xb, ya, greatest(least(yb, xm), ym)) AS q"
    out = [f"m0 AS (SELECT *, {hard} FROM (SELECT {keys}, {planes}, {flat} FROM pnt JOIN ls USING (frame_id)))"]
    for i, (n, op, a, c) in enumerate(_L_NODES):
        anchor, grow, first = ("greatest", "ln(1 + e)", ">=") if op == "MAX" else ("least", "ln(1 + (1 - e) / (1 + e))", "<=")
        grads = ", ".join(f"w * {a}_{k} + (1 - w) * {c}_{k} AS {n}_{k}" for k in "xyz")
        out.append(f"""m{i + 1} AS (SELECT * EXCLUDE (e, w), {anchor}({a}, {c}) + {grow} / {b} AS {n}, {grads} FROM (
    SELECT *, CASE WHEN {a} {first} {c} THEN 1 / (1 + e) ELSE e / (1 + e) END AS w FROM (SELECT *, exp(-{b} * abs({a} - {c})) AS e FROM m{i})))""")
    return ", ".join(out)


#: Spheres of the arm: on the column as they are, on the carriage (m = 1) by their place before the lift, on the tool (t = 1) before the swing.
_POSES = """cf AS (SELECT s_suppkey AS config_id, (s_suppkey % 13) / 4.0::DOUBLE AS q1, (s_suppkey % 7) / 10.0::DOUBLE AS q2, (s_suppkey % 5) / 3.0::DOUBLE AS q3 FROM supplier),
sph AS (SELECT * FROM (VALUES (0, 0, 0, 0.0, 0.0, 0.1, 0.05, NULL, NULL), (1, 0, 0, 0.0, 0.1, 0.0, 0.04, 0, 'turn'), (2, 0, 0, 0.0, 0.3, 0.0, 0.03, 0, 'turn'), (3, 0, 0, 0.05 * cos(0.5), 0.2 + 0.05 * sin(0.5), 0.0, 0.02, 0, 'turn'),
  (4, 1, 0, 0.0, 0.2, 0.1, 0.04, 1, 'lift'), (5, 1, 1, 0.2, 0.3, 0.0, 0.03, 2, 'swing'), (6, 1, 1, 0.3, 0.3, 0.05, 0.02, 2, 'swing')) s(sphere_id, m, t, px, py, pz, radius, link_index, joint)),
u1 AS (SELECT *, CASE WHEN t = 1 THEN px * cos(q3) + pz * sin(q3) ELSE px END AS ux, CASE WHEN t = 1 THEN pz * cos(q3) - px * sin(q3) ELSE pz END AS uz,
  t * (pz * cos(q3) - px * sin(q3)) AS dux, t * (-px * cos(q3) - pz * sin(q3)) AS duz FROM cf, sph),
u2 AS (SELECT *, CASE WHEN m = 1 THEN 0.1 + cos(0.1) * ux + sin(0.1) * (uz + q2) ELSE px END AS a, py AS b, CASE WHEN m = 1 THEN cos(0.1) * (uz + q2) - sin(0.1) * ux ELSE pz END AS c,
  cos(0.1) * dux + sin(0.1) * duz AS da, cos(0.1) * duz - sin(0.1) * dux AS dc FROM u1),
poses AS (SELECT config_id, sphere_id, radius, link_index, joint, x, y, z, CASE WHEN sphere_id = 0 THEN 0 ELSE -y END AS jx0, CASE WHEN sphere_id = 0 THEN 0 ELSE x END AS jy0, 0.0::DOUBLE AS jz0,
  m * sin(0.1) * cos(q1) AS jx1, m * sin(0.1) * sin(q1) AS jy1, m * cos(0.1) AS jz1, da * cos(q1) AS jx2, da * sin(q1) AS jy2, dc AS jz2 FROM (
  SELECT *, CASE WHEN sphere_id = 0 THEN px ELSE a * cos(q1) - b * sin(q1) END AS x, CASE WHEN sphere_id = 0 THEN py ELSE a * sin(q1) + b * cos(q1) END AS y, CASE WHEN sphere_id = 0 THEN pz ELSE 0.2 + c END AS z FROM u2))"""

_AT_SPHERES = f"{_NATIONS}, {_POSES}, pnt AS (SELECT poses.*, frame_id FROM poses, bx)"
_SPHERE_KEYS = "frame_id, config_id, sphere_id, radius, link_index, joint, jx0, jy0, jz0, jx1, jy1, jz1, jx2, jy2, jz2"
_ALPHA = f"{math.log(3.0) / 1e-3!r}::DOUBLE"

#: Strata around the first compressed cell of each frame, with the signs of the frame without it and with it.
_STRATA = """firstc AS (SELECT frame_id, min((cx * 100000 + cy) * 100000 + cz) AS id FROM cells GROUP BY frame_id),
fc AS (SELECT frame_id, id // 10000000000 AS fx, id // 100000 % 100000 AS fy, id % 100000 AS fz FROM firstc),
st AS (SELECT frame_id, fx, fy, fz, 2 * fx + a AS i, 2 * fy + b AS j, 2 * fz + c AS k FROM fc, (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS b), (SELECT unnest([-1, 0, 1]) AS c)),
sa AS (SELECT st.*, (i + dx * (i & 1)) // 2 AS cx, (j + dy * (j & 1)) // 2 AS cy, (k + dz * (k & 1)) // 2 AS cz FROM st, (SELECT unnest([-1, 1]) AS dx), (SELECT unnest([-1, 1]) AS dy), (SELECT unnest([-1, 1]) AS dz)
  WHERE (i & 1 = 1 OR dx = 1) AND (j & 1 = 1 OR dy = 1) AND (k & 1 = 1 OR dz = 1)),
ss AS (SELECT s.frame_id, i, j, k, (1 - (i & 1)) + (1 - (j & 1)) + (1 - (k & 1)) AS dimension, count(*) AS n, count(c.cx) AS held, count(c.cx) FILTER (c.cx <> fx OR c.cy <> fy OR c.cz <> fz) AS less
  FROM sa s LEFT JOIN cells c ON c.frame_id = s.frame_id AND c.cx = s.cx AND c.cy = s.cy AND c.cz = s.cz GROUP BY s.frame_id, i, j, k),
sg AS (SELECT *, CASE WHEN held = n THEN 1 WHEN held = 0 THEN -1 ELSE 0 END AS "right", CASE WHEN less = n THEN 1 WHEN less = 0 THEN -1 ELSE 0 END AS got FROM ss),
wit AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY i, j, k) AS r FROM sg WHERE got <> "right")"""

_EVENT_SETS = """p AS (SELECT event_type AS sensor_id, event_id // 40 AS frame_id, event_id % 3 / 3.0 AS x, user_id % 2 / 2.0 AS y, event_id % 2 / 2.0 AS z FROM events),
      s AS (SELECT sensor_id, frame_id, list_sort(list(DISTINCT [floor(x / 0.5), floor(y / 0.5), floor(z / 0.5)])) AS key FROM p GROUP BY ALL)"""

_PRISM_SIZES = "m AS (SELECT CAST(n_nationkey AS BIGINT) AS mesh, CAST(3 + n_nationkey % 6 AS BIGINT) AS n, n_nationkey + 1.0 AS r FROM nation)"

_NORMAL = """CASE {0} WHEN 0 THEN {1} WHEN 1 THEN {2} ELSE {3} END"""


def _turned(which: str) -> list[str]:
    return [_NORMAL.format(which, *v) for v in ((0.6, 0.0, 0.8), (0.8, 0.6, 0.0), (0.0, 0.8, 0.6))]


_N, _M = _turned("(l_linenumber % 3)"), _turned("(l_orderkey % 3)")
_LINE_POINT = ["(l_quantity / 50)", "(l_discount * 10)", "(l_extendedprice / 1e5)"]
_SCALED = [f"(({x} - {c}) / {r})" for x, c, r in zip(_LINE_POINT, (0.5, 0.4, 0.6), (0.4, 0.3, 0.5), strict=True)]
_TURNED = [f"(({n}) / {r})" for n, r in zip(_N, (0.4, 0.3, 0.5), strict=True)]

_P = [_prisms(k) for k in range(3)]
_ALL_PRISMS = ", ".join(p for p, _ in _P)
#: How far each frame and axis gets under the tight limits: events of plane i (from 0) come before slab i + 1 (from 1) is closed.
_STATUS = f"""dims AS (SELECT frame_id, (count(*) FILTER (axis = 0) - 1) * (count(*) FILTER (axis = 1) - 1) * (count(*) FILTER (axis = 2) - 1) AS n FROM planes GROUP BY frame_id),
ev AS (SELECT p.frame_id, p.axis, p.plane, (SELECT count(*) FROM planes q WHERE q.frame_id = p.frame_id AND q.axis = p.axis AND q.coord < p.plane) AS i,
  (SELECT count(*) FROM planes q WHERE q.frame_id = p.frame_id AND q.axis = (p.axis + 1) % 3 AND q.coord >= p.u0 AND q.coord < p.u1)
  * (SELECT count(*) FROM planes q WHERE q.frame_id = p.frame_id AND q.axis = (p.axis + 2) % 3 AND q.coord >= p.v0 AND q.coord < p.v1) AS n FROM patches p),
eu AS (SELECT frame_id, axis, i, sum(sum(n)) OVER (PARTITION BY frame_id, axis ORDER BY i) AS n FROM ev GROUP BY frame_id, axis, i),
rc AS ({" UNION ALL ".join(f"SELECT frame_id, {k} AS axis, slab, count(*) AS n FROM r{k} GROUP BY frame_id, slab" for k in range(3))}),
rp AS (SELECT frame_id, axis, slab, sum(n) OVER (PARTITION BY frame_id, axis ORDER BY slab) AS n FROM rc),
far AS (SELECT frame_id, axis, max(n) AS updates, min(i) FILTER (n > {TIGHT_UPDATES}) AS i FROM eu GROUP BY frame_id, axis),
made AS (SELECT frame_id, axis, max(n) AS prisms, min(slab) FILTER (n > {TIGHT_PRISMS}) AS j FROM rp GROUP BY frame_id, axis),
stat AS (SELECT far.frame_id, far.axis, CASE WHEN dims.n > {TIGHT_CELLS} THEN 'compressed_cell_limit' WHEN i IS NOT NULL AND (j IS NULL OR i + 1 <= j) THEN 'event_update_limit'
  WHEN j IS NOT NULL THEN 'free_prism_limit' END AS reason, coalesce(prisms, 0) AS prisms, updates FROM far JOIN dims USING (frame_id) LEFT JOIN made USING (frame_id, axis))"""

_NEAREST = """nr AS (SELECT a.frame_id, a.point_id, b.point_id AS id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2,
  row_number() OVER (PARTITION BY a.frame_id, a.point_id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z), b.point_id) AS r FROM pts a JOIN pts b ON a.frame_id = b.frame_id)"""

ORACLE_SQL: dict[str, str] = {
    "surface_summary": _surface(FINE, _PATCHES, _SUPPORTS) + _SUMMARY_OF,
    "xyz_lines": f"WITH {_POINTS} SELECT frame_id, point_id, x, y, z FROM pts",
    "voxel_index": f"WITH {_base(H, _LINES)} SELECT frame_id, ix, iy, iz, count(*) AS points FROM pv GROUP BY ALL",
    "voxel_distinct": f"WITH {_base(FINE)} SELECT * FROM vox",
    "voxel_bounds": f"WITH {_base(FINE)}, {_BOUNDS} SELECT * FROM bounds",
    "voxel_stats": f"""WITH {_base(H)}, c AS (SELECT DISTINCT frame_id, ix + a AS cx, iy + b AS cy, iz + c AS cz FROM vox, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b), (SELECT unnest([0, 1]) AS c)),
      k AS (SELECT frame_id, count(*) AS corners FROM c GROUP BY 1), n AS (SELECT frame_id, count(*) AS points FROM pts GROUP BY 1), v AS (SELECT frame_id, count(*) AS voxels FROM vox GROUP BY 1)
      SELECT frame_id, points, voxels, corners, round(voxels * {H * H * H!r}::DOUBLE, 9) AS volume, round(points / voxels, 9) AS points_per_voxel FROM n JOIN v USING (frame_id) JOIN k USING (frame_id)""",
    "voxel_corners": f"WITH {_base(H)} SELECT DISTINCT frame_id, ix + a AS cx, iy + b AS cy, iz + c AS cz FROM vox, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b), (SELECT unnest([0, 1]) AS c)",
    "contains_closed": f"WITH {_base(H)}, {_MOVED} SELECT frame_id, point_id, inside FROM flagged",
    "outside_count": f"WITH {_base(H)}, {_MOVED} SELECT frame_id, count(*) AS points, count(*) FILTER (NOT inside) AS outside FROM flagged GROUP BY frame_id",
    "expected_sign": f"WITH {_base(H)}, {_HALF} SELECT frame_id, kx, ky, kz, sign FROM signs",
    "exposed_faces": _surface() + "SELECT frame_id, axis, sign, plane, u, v FROM faces",
    "boundary_patches": _surface(H, _PATCHES)
    + "SELECT *, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY 2 * axis + CASE WHEN sign > 0 THEN 1 ELSE 0 END, plane, v0, u0) - 1 AS INTEGER) AS patch_id FROM patches",
    "line_patches": _surface(H, _PATCHES, points=_LINES) + "SELECT * FROM patches",
    "patch_corners": _surface(H, _PATCHES)
    + f"""SELECT frame_id, axis, sign, plane, u0, v0, corner, round(CASE axis WHEN 0 THEN plane WHEN 2 THEN cu ELSE cv END * {H}::DOUBLE, 9) AS x,
      round(CASE axis WHEN 1 THEN plane WHEN 0 THEN cu ELSE cv END * {H}::DOUBLE, 9) AS y, round(CASE axis WHEN 2 THEN plane WHEN 1 THEN cu ELSE cv END * {H}::DOUBLE, 9) AS z FROM (
      SELECT p.*, corner, CASE WHEN corner = 2 OR (corner = 1 AND sign > 0) OR (corner = 3 AND sign < 0) THEN u1 ELSE u0 END AS cu,
        CASE WHEN corner = 2 OR (corner = 3 AND sign > 0) OR (corner = 1 AND sign < 0) THEN v1 ELSE v0 END AS cv FROM patches p, (SELECT unnest([0, 1, 2, 3]) AS corner))""",
    "support_planes": _surface(H, _SUPPORTS) + "SELECT * FROM supports",
    "support_patches": _surface(H, _PATCHES)
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY 2 * axis + CASE WHEN sign > 0 THEN 1 ELSE 0 END, plane, v0, u0) - 1 AS id FROM patches)
      SELECT frame_id, axis, plane AS coord, bit_or(CASE WHEN sign < 0 THEN 1 ELSE 2 END) AS signs, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS patches FROM n GROUP BY frame_id, axis, plane""",
    "registry_check": _surface(H, _SUPPORTS)
    + """SELECT frame_id, count(*) AS supports, count(*) FILTER (support_id % 5 = 2) AS misplaced, count(*) FILTER (support_id % 5 = 3) AS doubled FROM supports GROUP BY frame_id""",
    "canonical_cells": _surface(H, _SUPPORTS, _CELLS) + "SELECT *, voxels = wx * wy * wz AS full FROM cells",
    "cell_box_sums": _surface(H, _SUPPORTS, _CELLS)
    + """SELECT x.frame_id, x.cx, y.cy, z.cz, CAST((SELECT count(*) FROM cells k WHERE k.frame_id = x.frame_id AND k.cx <= x.cx AND k.cy <= y.cy AND k.cz <= z.cz) AS BIGINT) AS prefix
      FROM (SELECT DISTINCT frame_id, cx FROM cells) x JOIN (SELECT DISTINCT frame_id, cy FROM cells) y USING (frame_id) JOIN (SELECT DISTINCT frame_id, cz FROM cells) z USING (frame_id)""",
    "cell_box_counts": _surface(H, _SUPPORTS, _CELLS)
    + """SELECT x.frame_id, x.cx - 1 AS lox, x.cy - 1 AS loy, x.cz - 1 AS loz, x.cx + 2 AS hix, x.cy + 2 AS hiy, x.cz + 2 AS hiz,
      CAST((SELECT count(*) FROM cells k WHERE k.frame_id = x.frame_id AND abs(k.cx - x.cx) <= 1 AND abs(k.cy - x.cy) <= 1 AND abs(k.cz - x.cz) <= 1) AS BIGINT) AS cells FROM cells x""",
    "octree_levels": f"WITH {_base(H)}, {_NODES} SELECT * FROM nodes",
    "octree_exact_cut": f"WITH {_base(H, _LINES)}, {_NODES} SELECT * FROM cut",
    "octree_rect_cover": f"""WITH RECURSIVE {_base(H)}, {_NODES}, {_COVERS}, kids AS (SELECT frame_id, bit_or(1 << CAST(4 * (nx & 1) + 2 * (ny & 1) + (nz & 1) AS INTEGER)) AS mask FROM cut WHERE level = 0 GROUP BY frame_id, nx >> 1, ny >> 1, nz >> 1),
      n AS (SELECT frame_id, sum(f.n) AS n FROM kids JOIN fewest f USING (mask) GROUP BY 1 UNION ALL SELECT frame_id, count(*) FROM cut WHERE level > 0 GROUP BY 1), v AS (SELECT frame_id, count(*) AS voxels FROM vox GROUP BY 1)
      SELECT frame_id, CAST(sum(n) AS BIGINT) AS cells, any_value(voxels) AS voxels FROM n JOIN v USING (frame_id) GROUP BY frame_id""",
    "octree_partition_check": f"""WITH {_base(H)}, {_NODES}, {_BOXES}, k AS (SELECT *, w * w * w AS n, ((lox % 3) + 3) % 3 <> 0 AS kept FROM boxes)
      SELECT frame_id, CAST(sum(CASE WHEN kept THEN 0 ELSE n END) AS BIGINT) AS uncovered, CAST(sum(CASE WHEN kept AND ((loy % 3) + 3) % 3 = 1 THEN n ELSE 0 END) AS BIGINT) AS overlapping,
      CAST(sum(CASE WHEN kept AND ((loz % 4) + 4) % 4 = 2 THEN n ELSE 0 END) AS BIGINT) AS outside FROM k GROUP BY frame_id""",
    "octree_rect_check": f"""WITH RECURSIVE {_base(H)}, {_NODES}, {_COVERS}, kids AS (SELECT frame_id, bit_or(1 << CAST(4 * (nx & 1) + 2 * (ny & 1) + (nz & 1) AS INTEGER)) AS mask FROM cut WHERE level = 0 GROUP BY frame_id, nx >> 1, ny >> 1, nz >> 1),
      n AS (SELECT frame_id, sum(f.n) AS n FROM kids JOIN fewest f USING (mask) GROUP BY 1 UNION ALL SELECT frame_id, count(*) FROM cut WHERE level > 0 GROUP BY 1), v AS (SELECT frame_id, count(*) AS voxels FROM vox GROUP BY 1)
      SELECT frame_id, 0::BIGINT AS uncovered, 0::BIGINT AS overlapping, 0::BIGINT AS outside, CAST(sum(n) AS BIGINT) AS cells, any_value(voxels) AS covered FROM n JOIN v USING (frame_id) GROUP BY frame_id""",
    "cell_sources": f"""WITH {_base(H)}, {_NODES} SELECT v.frame_id, v.ix, v.iy, v.iz, c.level, c.nx, c.ny, c.nz FROM vox v JOIN bounds b USING (frame_id) JOIN cut c ON c.frame_id = v.frame_id
      AND c.nx = (v.ix - b.min_ix) >> c.level AND c.ny = (v.iy - b.min_iy) >> c.level AND c.nz = (v.iz - b.min_iz) >> c.level""",
    "convexity_check": f"""WITH {_base(H)}, {_NODES}, {_BOXES}, k AS (SELECT *, lox + a * w + 1 AS x, loy + b * w AS y, loz + c * w AS z FROM boxes, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b), (SELECT unnest([0, 1]) AS c)),
      far AS (SELECT frame_id, cell_id, (x > lox + w)::INT + (x < lox)::INT + (y > loy + w)::INT + (y < loy)::INT + (z > loz + w)::INT + (z < loz)::INT AS n FROM k)
      SELECT frame_id, count(DISTINCT cell_id) AS clusters, CAST(sum(n) AS BIGINT) AS beyond FROM far GROUP BY frame_id""",
    "aabb_planes": f"WITH {_base(H)}, {_NODES}, {_BOXES} SELECT frame_id, cell_id, axis, sign, coord, round(sign * (coord * {H}::DOUBLE), 9) + 0.0 AS \"offset\" FROM bp",
    "shared_leaves": f"""WITH {_base(H)}, {_NODES}, {_BOXES}, l AS (SELECT frame_id, axis, sign, coord, count(*) AS "references", min(cell_id) AS first_cell FROM bp GROUP BY ALL)
      SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY first_cell, axis, sign) - 1 AS leaf_id FROM l""",
    "tree_size": f"WITH {_base(H)}, {_NODES} SELECT frame_id, count(*) AS cells, 6 * count(*) AS planes, 7 * count(*) + CASE WHEN count(*) > 1 THEN 1 ELSE 0 END AS nodes FROM cut GROUP BY frame_id",
    "cluster_union_eval": f"""WITH {_base(H)}, {_NODES}, {_BOXES}, {_SHIFTED}
      SELECT frame_id, point_id, round(min(greatest(lox * {H}::DOUBLE - x, x - (lox + w) * {H}::DOUBLE, loy * {H}::DOUBLE - y, y - (loy + w) * {H}::DOUBLE, loz * {H}::DOUBLE - z, z - (loz + w) * {H}::DOUBLE)), 9) AS q
      FROM mv JOIN boxes USING (frame_id) GROUP BY frame_id, point_id""",
    "free_prisms": f"""WITH {_base(H)}, {_BOUNDS} SELECT frame_id, axis, (max_ix - min_ix + 1) * (max_iy - min_iy + 1) * (max_iz - min_iz + 1) - voxels AS free_voxels
      FROM bounds, (SELECT unnest([0, 1, 2]) AS axis) WHERE (max_ix - min_ix + 1) * (max_iy - min_iy + 1) * (max_iz - min_iz + 1) > voxels""",
    "sweep_rectangles": _surface(H, _SUPPORTS, _CELLS, _FREE, _ALL_PRISMS)
    + " UNION ALL ".join(f"SELECT frame_id, slab, lox, loy, loz, hix, hiy, hiz, {k} AS axis FROM r{k}" for k in range(3)),
    "sweep_status": _surface(H, _PATCHES, _SUPPORTS, _CELLS, _FREE, _ALL_PRISMS, _STATUS)
    + """SELECT frame_id, axis, coalesce(reason, '') AS reason, CASE WHEN reason IS NULL THEN prisms ELSE 0 END::BIGINT AS prisms, CASE WHEN reason IS NULL THEN updates ELSE 0 END::BIGINT AS updates FROM stat""",
    "free_adjacency": _surface(H, _SUPPORTS, _CELLS, _FREE)
    + """SELECT a.frame_id, k.axis, a.cx AS ax, a.cy AS ay, a.cz AS az,
      CASE k.axis WHEN 0 THEN (a.hiy - a.loy) * (a.hiz - a.loz) WHEN 1 THEN (a.hix - a.lox) * (a.hiz - a.loz) ELSE (a.hix - a.lox) * (a.hiy - a.loy) END AS area
      FROM free a JOIN (SELECT unnest([0, 1, 2]) AS axis) k ON true JOIN free b ON b.frame_id = a.frame_id
      AND b.cx = a.cx + CASE WHEN k.axis = 0 THEN 1 ELSE 0 END AND b.cy = a.cy + CASE WHEN k.axis = 1 THEN 1 ELSE 0 END AND b.cz = a.cz + CASE WHEN k.axis = 2 THEN 1 ELSE 0 END""",
    "prism_adjacency": _surface(H, _SUPPORTS, _CELLS, _FREE, _P[2][0])
    + f""", e AS ({" UNION ALL ".join(f"SELECT a.frame_id, {k} AS axis, " + ", ".join(f"{s}.lo{d} AS {n}{d}" for s, n in (("a", "f"), ("b", "t")) for d in "xyz") + f", (least(a.hi{u}, b.hi{u}) - greatest(a.lo{u}, b.lo{u})) * (least(a.hi{v}, b.hi{v}) - greatest(a.lo{v}, b.lo{v})) AS area FROM {_P[2][1]} a JOIN {_P[2][1]} b ON a.frame_id = b.frame_id AND a.hi{c} = b.lo{c} AND greatest(a.lo{u}, b.lo{u}) < least(a.hi{u}, b.hi{u}) AND greatest(a.lo{v}, b.lo{v}) < least(a.hi{v}, b.hi{v})" for k, (c, u, v) in enumerate((("x", "y", "z"), ("y", "x", "z"), ("z", "x", "y"))))})
      SELECT *, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY area DESC, axis, fx, fy, fz, tx, ty, tz) - 1 AS INTEGER) AS place FROM e""",
    "axis_selection": "WITH RECURSIVE "
    + _surface(H, _PATCHES, _SUPPORTS, _CELLS, _FREE, _ALL_PRISMS, _STATUS, _NODES, _COVERS).removeprefix("WITH ")
    + f""", kids AS (SELECT frame_id, bit_or(1 << CAST(4 * (nx & 1) + 2 * (ny & 1) + (nz & 1) AS INTEGER)) AS mask FROM cut WHERE level = 0 GROUP BY frame_id, nx >> 1, ny >> 1, nz >> 1),
      o AS (SELECT frame_id, sum(n) AS m FROM (SELECT frame_id, sum(f.n) AS n FROM kids JOIN fewest f USING (mask) GROUP BY 1 UNION ALL SELECT frame_id, count(*) FROM cut WHERE level > 0 GROUP BY 1) GROUP BY frame_id),
      n AS ({" UNION ALL ".join(f"SELECT frame_id, {k} AS axis, count(*) AS n FROM {last} GROUP BY frame_id" for k, (_, last) in enumerate(_P))}),
      k AS (SELECT s.frame_id, s.axis, reason IS NOT NULL AS fallback, CASE WHEN reason IS NULL THEN coalesce(n.n, 0) ELSE 0 END AS prisms,
        CASE WHEN reason IS NULL THEN 7 * coalesce(n.n, 0) + 7 ELSE 7 * m + (m > 1)::INT END AS nodes, CASE WHEN reason IS NULL THEN 6 * coalesce(n.n, 0) + 6 ELSE 6 * m END AS leaf_references
        FROM stat s JOIN o USING (frame_id) LEFT JOIN n ON n.frame_id = s.frame_id AND n.axis = s.axis)
      SELECT frame_id, axis, fallback, prisms, CAST(nodes AS BIGINT) AS nodes, CAST(leaf_references AS BIGINT) AS leaf_references
      FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY fallback, nodes, leaf_references, prisms, axis) AS r FROM k) WHERE r = 1""",
    "strict_free": _surface(H, _PATCHES, _SUPPORTS, _CELLS, _FREE, _ALL_PRISMS, _STATUS, _HALF)
    + "SELECT frame_id, axis, kx, ky, kz, occupied = 0 AS free, reason IS NOT NULL AS fallback FROM signs JOIN stat USING (frame_id)",
    "direct_sign": f"WITH {_base(H)}, {_HALF} SELECT frame_id, kx, ky, kz, sign FROM signs",
    "strata_certificate": _surface(H, _SUPPORTS)
    + """, m AS (SELECT frame_id, axis, 2 * count(*) + 1 AS n FROM planes GROUP BY ALL)
      SELECT frame_id, CAST(product(n) AS BIGINT) AS strata, 0::BIGINT AS mismatches FROM m GROUP BY frame_id""",
    "sign_diagnostics": _surface(H, _SUPPORTS, _CELLS, _STRATA)
    + """, m AS (SELECT frame_id, max(n) FILTER (axis = 0) AS a, max(n) FILTER (axis = 1) AS b, max(n) FILTER (axis = 2) AS c FROM (SELECT frame_id, axis, count(*) AS n FROM planes GROUP BY ALL) GROUP BY frame_id),
      d AS (SELECT frame_id, unnest([0, 1, 2, 3]) AS dimension, unnest([a * b * c, (a + 1) * b * c + a * (b + 1) * c + a * b * (c + 1), (a + 1) * (b + 1) * c + (a + 1) * b * (c + 1) + a * (b + 1) * (c + 1), (a + 1) * (b + 1) * (c + 1)]) AS strata FROM m)
      SELECT d.frame_id, CAST(d.dimension AS INTEGER) AS dimension, CAST(any_value(d.strata) AS BIGINT) AS strata, count(w.r) AS mismatches, count(w.r) FILTER (w.r <= 24) AS witnesses
      FROM d LEFT JOIN wit w ON w.frame_id = d.frame_id AND w.dimension = d.dimension GROUP BY d.frame_id, d.dimension""",
    "sign_witnesses": _surface(H, _SUPPORTS, _CELLS, _STRATA)
    + """SELECT frame_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(k AS INTEGER) AS k, CAST(got AS INTEGER) AS got, CAST("right" AS INTEGER) AS "right" FROM wit WHERE r <= 24""",
    "exported_sign": f"WITH {_base(H)}, {_HALF} SELECT frame_id, kx, ky, kz, sign FROM signs",
    "box_programs": f"WITH {_NATIONS} SELECT frame_id, 6::BIGINT + 5 AS nodes, 6::BIGINT + 5 AS shared, 6::BIGINT + 5 AS expanded, 5::BIGINT * 5 * 5 AS strata, 0::BIGINT AS mismatches FROM bx",
    "box_values": f"""WITH {_NATIONS}, pnt AS (SELECT s_suppkey AS point_id, frame_id, s_suppkey % 11 / 10.0::DOUBLE - 0.31 AS x, s_suppkey % 7 / 10.0::DOUBLE - 0.33 AS y, s_suppkey % 9 / 20.0::DOUBLE + 0.07 AS z FROM supplier, bx),
      {_box_function(0.02, "frame_id, point_id")}
      SELECT frame_id, point_id, round(q, 9) + 0.0 AS q, round(v, 9) + 0.0 AS q_upper, round(dx, 9) + 0.0 AS gx, round(dy, 9) + 0.0 AS gy, round(dz, 9) + 0.0 AS gz, 0.02::DOUBLE AS bound FROM w5""",
    "bent_values": f"""WITH {_LS}, pnt AS (SELECT s_suppkey AS point_id, frame_id, s_suppkey % 11 / 10.0::DOUBLE - 0.31 AS x, s_suppkey % 7 / 10.0::DOUBLE - 0.33 AS y, s_suppkey % 9 / 20.0::DOUBLE + 0.07 AS z FROM supplier, ls),
      {_l_function(0.02, "frame_id, point_id")}
      SELECT frame_id, point_id, round(q, 9) + 0.0 AS q, round(n7, 9) + 0.0 AS q_upper, round(n7_x, 9) + 0.0 AS gx, round(n7_y, 9) + 0.0 AS gy, round(n7_z, 9) + 0.0 AS gz, 0.02::DOUBLE AS bound FROM m7""",
    "bent_expressions": f"""WITH {_LS}, t AS (SELECT *, {", ".join(f"CASE WHEN {c} < 0 THEN '(' || {c} || ')' ELSE {c}::VARCHAR END AS t{c}" for c in ("x0", "x1", "x2", "y0", "y1", "y2", "z0", "z1"))} FROM ls)
      SELECT frame_id, 15::BIGINT AS expanded, 'least(z - ' || tz0 || ', least(least(x - ' || tx0 || ', least(least(y - ' || ty0 || ', greatest(least(' || ty2 || ' - y, ' || tx1 || ' - x), ' || ty1 || ' - y)), ' || tx2 || ' - x)), ' || tz1 || ' - z))' AS text,
      8::BIGINT AS splits, '2:' || z0 || ' 2:' || z1 || ' 0:' || x0 || ' 0:' || x2 || ' 1:' || y0 || ' 1:' || y1 || ' 0:' || x1 || ' 1:' || y2 AS cuts FROM t""",
    "program_provenance": _surface(H, _SUPPORTS)
    + """SELECT frame_id, count(*) AS planes, count(*) FILTER (coord % 5 = 0) AS unexplained, count(*) FILTER (coord % 7 = 0) AS unused FROM planes GROUP BY frame_id""",
    "slope_audit": _surface(H, _PATCHES, _HALF)
    + """SELECT frame_id, 'centre' AS kind, count(*) AS probes, 0::BIGINT AS differing FROM vox GROUP BY 1
      UNION ALL SELECT frame_id, 'corner', count(*), 0 FROM signs WHERE kx & 1 = 0 AND ky & 1 = 0 AND kz & 1 = 0 GROUP BY 1
      UNION ALL SELECT frame_id, 'flank', 2 * count(*), 2 * count(*) FROM patches GROUP BY 1
      UNION ALL SELECT DISTINCT frame_id, 'outer', 26::BIGINT, 0::BIGINT FROM vox""",
    "direct_bundle": _surface(H, _PATCHES, _SUPPORTS, _HALF)
    + """, n AS (SELECT frame_id, count(*) AS occupancy FROM vox GROUP BY 1), p AS (SELECT frame_id, count(*) AS patches FROM patches GROUP BY 1), r AS (SELECT frame_id, count(*) AS registry FROM planes GROUP BY 1),
      c AS (SELECT frame_id, count(*) AS corners FROM signs WHERE kx & 1 = 0 AND ky & 1 = 0 AND kz & 1 = 0 GROUP BY 1),
      m AS (SELECT frame_id, CAST(product(n) AS BIGINT) AS strata FROM (SELECT frame_id, axis, 2 * count(*) + 1 AS n FROM planes GROUP BY ALL) GROUP BY 1)
      SELECT frame_id, registry, patches, occupancy, 1::BIGINT AS json, 1::BIGINT AS expressions, 1::BIGINT AS roots, strata, 0::BIGINT AS mismatches, registry AS planes, 0::BIGINT AS unexplained, 0::BIGINT AS unused,
      occupancy + corners + 2 * patches + 26 + 64 AS samples, 0::BIGINT AS wrong, true AS ok FROM n JOIN p USING (frame_id) JOIN r USING (frame_id) JOIN c USING (frame_id) JOIN m USING (frame_id)""",
    "tet_bundle": """WITH k AS (SELECT CAST(p_partkey AS BIGINT) AS frame_id, (p_partkey // 8) % 3 + 3 AS m, (p_partkey // 8) % 2 = 1 AS bent FROM part WHERE p_partkey % 8 = 0),
      e AS (SELECT *, CASE WHEN bent THEN m - 1 ELSE m END AS a, CASE WHEN bent THEN 2 ELSE 1 END AS b FROM k), n AS (SELECT *, i * 0.8191725133961645::DOUBLE + 0.5 AS r, i * 0.6710436067037893::DOUBLE + 0.5 AS s, i * 0.5497004779019703::DOUBLE + 0.5 AS t FROM e, (SELECT unnest(range(1, 33)) AS i)),
      p AS (SELECT *, (1.5 * (r - floor(r)) - 0.25) * a AS x, (1.5 * (s - floor(s)) - 0.25) * b AS y, 1.5 * (t - floor(t)) - 0.25 AS z FROM n),
      f AS (SELECT frame_id, m, z > 0 AND z < 1 AND x > 0 AND y > 0 AND ((x < a AND y < 1) OR (bent AND x < 1 AND y < 2)) AS held FROM p)
      SELECT frame_id, CAST(6 * m AS BIGINT) AS tets, CAST(8 * m + 4 AS BIGINT) AS surface_faces, CAST(m AS DOUBLE) AS surface_volume, CAST(m AS DOUBLE) AS mesh_volume, count(*) AS samples, count(*) FILTER (held) AS bounded, 0::BIGINT AS boundary,
      count(*) FILTER (NOT held) AS unbounded, 0::BIGINT AS tets_differ, 0::BIGINT AS clusters_differ, 0::BIGINT AS added, 0::BIGINT AS missed, true AS written, true AS ok FROM f GROUP BY frame_id, m""",
    "box_spheres": f"""WITH {_AT_SPHERES}, {_box_function(1e-3, _SPHERE_KEYS)} SELECT frame_id, config_id, sphere_id, joint, round(-v - radius - 0.01, 6) AS clearance FROM w5""",
    "clearance_bundle": f"""WITH {_AT_SPHERES}, {_box_function(1e-3, _SPHERE_KEYS)},
      c AS (SELECT frame_id, config_id, count(*) AS n, count(*) FILTER (joint IS NULL) AS still, sum(-v - radius - 0.01) AS total, min(-v - radius - 0.01) FILTER (joint IS NOT NULL) AS low FROM w5 GROUP BY ALL),
      s AS (SELECT frame_id, (x1 - x0) AS a, (y1 - y0) AS b, (z1 - z0) AS c FROM bx)
      SELECT c.frame_id, CAST(config_id AS BIGINT) AS config_id, CAST(a * b * s.c AS BIGINT) AS voxels, CAST((6 * a * b * s.c - 2 * (a * b + b * s.c + a * s.c)) // 2 AS BIGINT) AS shared_faces,
      CAST(2 * (a * b + b * s.c + a * s.c) AS BIGINT) AS exposed_faces, CAST(2 * (a * b + b * s.c + a * s.c) - 6 AS BIGINT) AS merged_away, 6 AS patches, CAST(n AS INTEGER) AS spheres, CAST(still AS INTEGER) AS static,
      'column,carriage,tool' AS links, 'column,plate,carriage,tool' AS sources, round(total, 5) + 0.0 AS clearances, round(low, 6) + 0.0 AS least FROM c JOIN s USING (frame_id)""",
    "frame_audit": """SELECT CAST(n_nationkey AS BIGINT) AS frame_id, (SELECT 3 * count(*) FROM supplier) AS groups, (SELECT 3 * count(*) FROM supplier WHERE s_suppkey % 7 = 0) AS differing FROM nation""",
    "exported_audit": f"WITH {_POINTS} SELECT frame_id, least(24, count(*)) AS samples, 0::BIGINT AS differing FROM pts GROUP BY frame_id",
    "box_clearance": f"""WITH {_AT_SPHERES}, {_box_function(1e-3, _SPHERE_KEYS)},
      c AS (SELECT *, -v - radius AS clearance, {", ".join(f"-(jx{k} * dx + jy{k} * dy + jz{k} * dz) AS s{k}" for k in range(3))} FROM w5 WHERE joint IS NOT NULL),
      l AS (SELECT frame_id, config_id, joint, link_index, min(clearance) AS low, count(*) AS spheres FROM c GROUP BY ALL),
      e AS (SELECT c.*, low, spheres, exp(-{_ALPHA} * (clearance - low)) AS w FROM c JOIN l USING (frame_id, config_id, joint, link_index))
      SELECT frame_id, config_id, joint, CAST(link_index AS INTEGER) AS link_index, round(any_value(low) - ln(sum(w)) / {_ALPHA}, 6) + 0.0 AS distance, round(any_value(low), 6) + 0.0 AS hard_min,
      round(CASE WHEN any_value(spheres) > 1 THEN ln(any_value(spheres)) / {_ALPHA} ELSE 0 END, 6) + 0.0 AS bound, CAST(min(sphere_id) FILTER (clearance = low) AS INTEGER) AS nearest_sphere, any_value(spheres) AS spheres,
      {", ".join(f"round(sum(w * s{k}) / sum(w), 6) + 0.0 AS g{k}" for k in range(3))} FROM e GROUP BY frame_id, config_id, joint, link_index""",
    "arm_poses": f"""WITH {_POSES} SELECT config_id, CAST(sphere_id AS INTEGER) AS sphere_id, {", ".join(f"round({c}, 9) + 0.0 AS {c}" for c in ["x", "y", "z"])}, {", ".join(f"round(CAST(j{c}{k} AS DOUBLE), 9) + 0.0 AS j{c}{k}" for c in "xyz" for k in range(3))} FROM poses""",
    "lse_bound_audit": f"""WITH {_base(H)}, {_HALF} SELECT frame_id, {", ".join(f"count(*) FILTER (sign = {v}) AS {n}" for v, n in ((-1, "free"), (0, "zero"), (1, "filled")))},
      0::BIGINT AS below, 0::BIGINT AS beyond_bound, 0::BIGINT AS false_free, 0::BIGINT AS too_steep FROM signs GROUP BY frame_id""",
    "reference_sdf": _surface(H, _PATCHES, _MOVED)
    + f""", w AS (SELECT p.frame_id, point_id, inside, plane * {H}::DOUBLE AS pl, u0 * {H}::DOUBLE AS a, u1 * {H}::DOUBLE AS b, v0 * {H}::DOUBLE AS c, v1 * {H}::DOUBLE AS d,
      CASE axis WHEN 0 THEN x WHEN 1 THEN y ELSE z END AS s, CASE axis WHEN 0 THEN y WHEN 1 THEN z ELSE x END AS u, CASE axis WHEN 0 THEN z WHEN 1 THEN x ELSE y END AS v
      FROM flagged p JOIN patches q ON p.frame_id = q.frame_id),
      d AS (SELECT frame_id, point_id, any_value(inside) AS inside, min(sqrt((s - pl) * (s - pl) + greatest(0, a - u, u - b) * greatest(0, a - u, u - b) + greatest(0, c - v, v - d) * greatest(0, c - v, v - d))) AS d FROM w GROUP BY frame_id, point_id)
      SELECT frame_id, point_id, round(d, 9) AS distance, round(CASE WHEN inside THEN -d ELSE d END, 9) + 0.0 AS signed FROM d""",
    "sphere_poses": f"""WITH {_POSES.replace("s_suppkey % 7) / 10.0", "0) / 10.0").replace("s_suppkey % 5) / 3.0", "0) / 3.0")}
      SELECT config_id, CAST(sphere_id AS INTEGER) AS sphere_id, {", ".join(f"round({c}, 9) + 0.0 AS {c}" for c in "xyz")} FROM poses""",
    "frame_reuse": f"""WITH {_EVENT_SETS}
      SELECT sensor_id, CAST(frame_id AS BIGINT) AS frame_id, CAST(len(key) AS BIGINT) AS voxels, coalesce(key = lag(key) OVER (PARTITION BY sensor_id ORDER BY frame_id), false) AS hit FROM s""",
    "frame_reuse_of_two": f"""WITH {_EVENT_SETS}, a AS (SELECT *, lag(key) OVER (PARTITION BY sensor_id ORDER BY frame_id) AS last FROM s),
      runs AS (SELECT sensor_id, frame_id, key, lag(key, 2) OVER (PARTITION BY sensor_id ORDER BY frame_id) AS before FROM a WHERE last IS NULL OR last <> key)
      SELECT a.sensor_id, CAST(a.frame_id AS BIGINT) AS frame_id, CAST(len(a.key) AS BIGINT) AS voxels, r.frame_id IS NULL OR coalesce(r.key = r.before, false) AS hit
      FROM a LEFT JOIN runs r ON r.sensor_id = a.sensor_id AND r.frame_id = a.frame_id""",
    "frame_equality": f"""WITH {_base(0.2)}, d AS (SELECT pair, ix, iy, iz, sum(s) AS s FROM (SELECT frame_id AS pair, ix, iy, iz, 1 AS s FROM vox UNION ALL SELECT frame_id + 1, ix, iy, iz, -1 FROM vox) GROUP BY ALL)
      SELECT pair, count(*) FILTER (s <> 0) AS differing FROM d GROUP BY pair""",
    "preprocess_voxel": f"WITH {_base(H)} SELECT frame_id, ix, iy, iz, count(*) AS points, round(avg(x), 9) + 0.0 AS x, round(avg(y), 9) + 0.0 AS y, round(avg(z), 9) + 0.0 AS z FROM pv GROUP BY ALL",
    "displacement_stats": f"""WITH {_base(H)}, e AS (SELECT frame_id, sqrt({" + ".join(f"(0.25 * ((i{c} + 0.5) * {H} - {c})) * (0.25 * ((i{c} + 0.5) * {H} - {c}))" for c in "xyz")}) AS e FROM pv)
      SELECT frame_id, count(*) AS n, round(max(e), 9) AS max_error, round(avg(e), 9) AS mean_error, round(sqrt(avg(e * e)), 9) AS rmse, round(quantile_disc(e, 0.95), 9) AS p95 FROM e GROUP BY frame_id""",
    "error_summary": """WITH e AS (SELECT l_returnflag AS flag, abs(l_extendedprice / 1e5 - l_discount * 10) AS e FROM lineitem)
      SELECT flag, count(*) AS n, round(max(e), 9) AS max_error, round(avg(e), 9) AS mean_error, round(sqrt(avg(e * e)), 9) AS rmse, round(quantile_disc(e, 0.95), 9) AS p95 FROM e GROUP BY flag""",
    "confusion": f"""WITH {_base(H)}, {_MOVED}, b AS (SELECT *, (x / 0.3) * (x / 0.3) + (y / 0.25) * (y / 0.25) + (z / 0.2) * (z / 0.2) <= 1 AS ideal FROM flagged)
      SELECT frame_id, count(*) FILTER (inside AND ideal) AS tp, count(*) FILTER (inside AND NOT ideal) AS fp, count(*) FILTER (NOT inside AND ideal) AS fn, count(*) FILTER (NOT inside AND NOT ideal) AS tn FROM b GROUP BY frame_id""",
    "wilson_ci": f"""WITH {_base(H)}, {_MOVED}, c AS (SELECT frame_id, count(*) AS points, count(*) FILTER (NOT inside) AS outside FROM flagged GROUP BY frame_id), k AS (SELECT *, outside / points AS p, 1.959963984540054::DOUBLE AS z FROM c)
      SELECT frame_id, points, outside, round(greatest(0, (p + z * z / (2 * points) - z * sqrt(p * (1 - p) / points + z * z / (4 * points * points))) / (1 + z * z / points)), 9) AS low,
      round(least(1, (p + z * z / (2 * points) + z * sqrt(p * (1 - p) / points + z * z / (4 * points * points))) / (1 + z * z / points)), 9) AS high FROM k""",
    "voxel_reservoir": f"WITH {_base(0.2, _LINES)} SELECT frame_id, ix, iy, iz, least(3, count(*)) AS kept FROM pv GROUP BY ALL",
    "case_suite": """SELECT name, points, 0::BIGINT AS off_surface FROM (VALUES ('cube_surface', 2048::BIGINT), ('l_surface', 2048), ('u_surface', 2048), ('thin_wall_surface', 2048), ('staircase_surface', 2048),
      ('two_objects_surface', 2048), ('narrow_corridor_surface', 2048), ('cylinder_surface', 2048), ('torus_surface', 2048), ('hollow_box_surfaces', 1536 + 512), ('plane_patch', 1024), ('ellipsoid_sparse', 256),
      ('ellipsoid_surface', 2048), ('ellipsoid_dense', 8192), ('ellipsoid_noise_2mm', 2048), ('ellipsoid_noise_8mm', 2048), ('ellipsoid_partial', 1024), ('ellipsoid_duplicates', 3 * 2048), ('ellipsoid_outliers', 2048 + 6)) t(name, points)""",
    "mesh_volume": "SELECT CAST(n_nationkey + 1 AS DOUBLE) AS scale, round(3.0 * power(CAST(n_nationkey + 1 AS DOUBLE), 3), 6) AS volume, round(14.0 * power(CAST(n_nationkey + 1 AS DOUBLE), 2), 6) AS area FROM nation",
    "mesh_edges": f"""WITH {_PRISM_SIZES}, t AS (SELECT *, 2 * r * sin(pi() / n) AS side FROM m)
      SELECT mesh, 'convex' AS kind, 3 * n AS edges, round(2 * n * side + n, 6) AS length FROM t
      UNION ALL SELECT mesh, 'flat', 3 * n - 6, round(n * sqrt(1 + side * side) + 2 * coalesce((SELECT sum(2 * r * sin(pi() * i / n)) FROM (SELECT unnest(range(2, n - 1)) AS i)), 0), 6) FROM t""",
    "mesh_coplanar": f"""WITH {_PRISM_SIZES} SELECT n - 2 AS faces, round(n / 2.0 * r * r * sin(2 * pi() / n), 6) AS area FROM m, (SELECT unnest([0, 1]))
      UNION ALL SELECT 2, round(2 * r * sin(pi() / n), 6) FROM (SELECT n, r, unnest(range(n)) FROM m)""",
    "surface_validity": """SELECT CAST(p_partkey AS BIGINT) AS mesh, CAST(12 * (p_partkey % 4 + 1) AS BIGINT) AS faces, 0::BIGINT AS flat_faces, CAST(p_partkey % 4 + 1 AS BIGINT) AS parts,
      CAST(CASE WHEN p_partkey % 5 = 0 THEN (p_partkey % 4 + 1) // 2 ELSE 0 END AS BIGINT) AS inward_parts, p_partkey % 3 < 2 AND p_partkey % 4 > 0 AS crossed FROM part""",
    # Sides of overlapping boxes share planes across, and those along where one begins in steps of the other's width; turned boxes face the other way.
    "coplanar_regions": """WITH b AS (SELECT p_partkey AS mesh, unnest(range(0, p_partkey % 4 + 1)) AS box FROM part),
      s AS (SELECT *, box * [0.5, 1.0, 2.0][CAST(mesh % 3 + 1 AS INTEGER)] AS x, CASE WHEN mesh % 5 = 0 AND box % 2 = 1 THEN -1 ELSE 1 END AS t FROM b),
      q AS (SELECT mesh, axis, sign * t AS sign, sign * t * CASE axis WHEN 0 THEN x + (sign + 1) / 2 ELSE (sign + 1) / 2 END AS d FROM s, (SELECT unnest([0, 1, 2]) AS axis), (SELECT unnest([-1, 1]) AS sign))
      SELECT CAST(mesh AS BIGINT) AS mesh, count(*) AS regions, CAST(2 * count(*) AS BIGINT) AS faces, count(DISTINCT (axis, sign, d)) AS planes, CAST(count(*) AS DOUBLE) AS area, 0.0::DOUBLE AS slack FROM q GROUP BY mesh""",
    "mesh_validity": f"""WITH {_PRISM_SIZES}, t AS (SELECT *, CASE WHEN mesh % 3 = 0 THEN 1 ELSE 0 END AS gone, CASE WHEN mesh % 2 = 1 THEN 1 ELSE 0 END AS turned FROM m)
      SELECT mesh, 4 * n - 4 - gone AS faces, 6 * n - 6 AS edges, CAST(3 * gone AS BIGINT) AS open_edges, CAST(turned * (3 - CASE WHEN n > 3 THEN gone ELSE 0 END) AS BIGINT) AS turned_edges FROM t""",
    "points_in_tets": """WITH c AS (SELECT CAST(n_nationkey AS BIGINT) AS frame_id, (n_nationkey + 1) / 10.0::DOUBLE AS s FROM nation),
      p AS (SELECT s_suppkey AS point_id, s_suppkey % 17 / 8.0::DOUBLE + 0.0123 AS x, s_suppkey % 13 / 7.0::DOUBLE + 0.0231 AS y, s_suppkey % 7 / 5.0::DOUBLE + 0.0317 AS z FROM supplier)
      SELECT frame_id, point_id, x <= s AND y <= s AND z <= s AS inside FROM p, c""",
    "mesh_sides": """WITH c AS (SELECT CAST(n_nationkey AS BIGINT) AS frame_id, (n_nationkey + 1) / 10.0::DOUBLE AS s FROM nation),
      p AS (SELECT s_suppkey % 5 / 4.0::DOUBLE AS x, s_suppkey % 7 / 6.0::DOUBLE AS y, s_suppkey % 3 / 2.0::DOUBLE AS z FROM supplier),
      k AS (SELECT frame_id, x <= s AND y <= s AND z <= s AS closed, x > 0 AND x < s AND y > 0 AND y < s AND z > 0 AND z < s AS "open" FROM p, c)
      SELECT frame_id, count(*) FILTER ("open") AS bounded, count(*) FILTER (closed AND NOT "open") AS boundary, count(*) FILTER (NOT closed) AS unbounded,
      count(*) FILTER (closed) AS in_tets, count(*) FILTER (closed) AS in_planes, 0::BIGINT AS differing FROM k GROUP BY frame_id""",
    "reduced_planes": """WITH c AS (SELECT CAST(n_nationkey AS BIGINT) AS frame_id, (n_nationkey + 1) / 10.0::DOUBLE AS s FROM nation)
      SELECT frame_id, 6::BIGINT AS planes, 12::BIGINT AS faces, round(3 * s, 9) AS offsets, round(6 * s * s, 9) AS area FROM c""",
    "mesh_documents": f"""WITH {_PRISM_SIZES}, t AS (SELECT *, 2 * r * sin(pi() / n) AS side FROM m)
      SELECT mesh, 2 * n AS vertices, 6 * n - 6 AS edges, 4 * n - 4 AS faces, round(2 * n * side + n + n * sqrt(1 + side * side) + 2 * coalesce((SELECT sum(2 * r * sin(pi() * i / n)) FROM (SELECT unnest(range(2, n - 1)) AS i)), 0), 6) AS length FROM t""",
    "cluster_meshes": """WITH c AS (SELECT CAST(n_nationkey AS BIGINT) AS frame_id, (n_nationkey + 1) / 10.0::DOUBLE AS s FROM nation)
      SELECT frame_id, 6::BIGINT AS faces, 5::BIGINT AS planes, round(s * s * s / 3, 9) AS volume, round((2 + sqrt(2)) * s * s, 9) AS area FROM c, (SELECT unnest([1, 2, 3]))""",
    "points_in_mesh": """WITH p AS (SELECT CAST(year(l_shipdate) AS BIGINT) AS frame_id, l_quantity / 25.0 + 0.0123 AS x, l_discount * 20.0 + 0.0321 AS y, l_extendedprice / 6e4 AS z FROM lineitem)
      SELECT frame_id, count(*) AS points, count(*) FILTER (x > 0 AND y > 0 AND z > 0 AND z < 1 AND ((x < 2 AND y < 1) OR (x < 1 AND y < 2))) AS inside FROM p GROUP BY frame_id""",
    "tet_neighbours": """WITH t AS (SELECT CAST(p_partkey AS BIGINT) AS tet_id FROM part)
      SELECT a.tet_id, coalesce(n.tet_id, -1) AS n0, -1::BIGINT AS n1, -1::BIGINT AS n2, coalesce(p.tet_id, -1) AS n3
      FROM t a LEFT JOIN t n ON n.tet_id = a.tet_id + 1 LEFT JOIN t p ON p.tet_id = a.tet_id - 1""",
    "cluster_tree": f"""WITH {_base(H)}, {_NODES}, {_BOXES}, l AS (SELECT frame_id, count(DISTINCT (axis, sign, coord)) AS leaves FROM bp GROUP BY 1)
      SELECT frame_id, (SELECT count(*) FROM boxes b WHERE b.frame_id = l.frame_id) AS cells, leaves, 6 * (SELECT count(*) FROM boxes b WHERE b.frame_id = l.frame_id) AS "references" FROM l""",
    "plane_dedupe": f"WITH {_base(H)}, {_NODES}, {_BOXES} SELECT frame_id, count(*) AS planes, count(DISTINCT (axis, sign, coord)) AS leaves FROM bp GROUP BY frame_id",
    "face_contours": _surface()
    + """, c AS (SELECT frame_id, axis, sign, plane, u + a AS cu, v + b AS cv, count(*) AS k, sum(CASE WHEN a = b THEN 1 ELSE -1 END) AS d FROM faces, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b) GROUP BY ALL),
      t AS (SELECT frame_id, axis, sign, plane, sum(CASE WHEN k IN (1, 3) THEN 1 WHEN k = 2 AND abs(d) = 2 THEN 2 ELSE 0 END) AS corners FROM c GROUP BY ALL)
      SELECT f.frame_id, f.axis, f.sign, f.plane, count(*) AS faces, CAST(any_value(t.corners) AS BIGINT) AS corners FROM faces f JOIN t ON f.frame_id = t.frame_id AND f.axis = t.axis AND f.sign = t.sign AND f.plane = t.plane
      GROUP BY f.frame_id, f.axis, f.sign, f.plane""",
    "probe_audit": f"""WITH {_base(H)}, {_FACES}, {_PATCHES}, {_HALF}, {_BOUNDS}, n AS (SELECT bounds.*, i FROM bounds, (SELECT unnest(range(1, 65)) AS i)),
      rp AS (SELECT frame_id, i, {", ".join(f"(min_i{c} - 1 + (0.5 + i * {a!r}::DOUBLE - floor(0.5 + i * {a!r}::DOUBLE)) * (max_i{c} - min_i{c} + 3)) * {H}::DOUBLE AS {c}" for c, a in zip("xyz", (0.8191725133961645, 0.6710436067037893, 0.5497004779019703), strict=True))} FROM n),
      rv AS (SELECT frame_id, i, {", ".join(f"{_index(c, H)} AS i{c}" for c in "xyz")} FROM rp), rs AS (SELECT r.frame_id, v.ix IS NOT NULL AS held FROM rv r LEFT JOIN vox v ON v.frame_id = r.frame_id AND v.ix = r.ix AND v.iy = r.iy AND v.iz = r.iz)
      SELECT frame_id, 'centre' AS kind, count(*) AS probes, 0::BIGINT AS free, 0::BIGINT AS zero, count(*) AS filled FROM vox GROUP BY 1
      UNION ALL SELECT frame_id, 'corner', count(*), count(*) FILTER (sign < 0), count(*) FILTER (sign = 0), count(*) FILTER (sign > 0) FROM signs WHERE kx & 1 = 0 AND ky & 1 = 0 AND kz & 1 = 0 GROUP BY 1
      UNION ALL SELECT frame_id, 'flank', 2 * count(*), count(*), 0, count(*) FROM patches GROUP BY 1
      UNION ALL SELECT frame_id, 'outer', 26, 26, 0, 0 FROM bounds
      UNION ALL SELECT frame_id, 'random', count(*), count(*) FILTER (NOT held), 0, count(*) FILTER (held) FROM rs GROUP BY 1""",
    "zero_rays": _surface(H, _PATCHES) + "SELECT frame_id, count(*) AS good_ends, count(*) * 0.5::DOUBLE AS sum_t, count(*) AS in_order FROM patches GROUP BY frame_id",
    "patch_meshes": _surface(H, _PATCHES) + "SELECT frame_id, 4 * count(*) AS vertices, count(*) AS faces FROM patches GROUP BY frame_id",
    "xyz_round_trip": f"""WITH {_POINTS} SELECT frame_id, count(*) AS points, count(*) FILTER (point_id % 3 = 0 AND (x <> round(x, 2) OR y <> round(y, 2) OR z <> round(z, 2))) AS changed FROM pts GROUP BY frame_id""",
    "cloud_round_trip": f"""WITH {_POINTS} SELECT kind, row_number() OVER (PARTITION BY kind, frame_id ORDER BY point_id) - 1 AS n, x, y, z FROM pts, (SELECT unnest(['ply', 'off', 'xyz']) AS kind)""",
    "repeat_median": "SELECT event_type, count(value) AS n, quantile_disc(value, 0.5) AS median FROM events GROUP BY event_type",
    "plane_values": f"""WITH v AS (SELECT l_orderkey % 100 AS bucket, {" + ".join(f"({n}) * {p}" for n, p in zip(_N, _LINE_POINT, strict=True))} - l_tax AS value,
      {" + ".join(f"({n}) * ({m})" for n, m in zip(_N, _M, strict=True))} >= 1 - 1e-12 AND abs(l_tax - l_discount) <= 0.015 AS same FROM lineitem)
      SELECT bucket, count(*) AS lines, round(sum(value), 6) AS total, round(max(value), 9) AS most, count(*) FILTER (same) AS same FROM v GROUP BY bucket""",
    "ray_hits": f"""WITH v AS (SELECT l_orderkey * 8 + l_linenumber AS point_id, {" + ".join(f"{d} * {d}" for d in _TURNED)} AS a, 2 * ({" + ".join(f"{o} * {d}" for o, d in zip(_SCALED, _TURNED, strict=True))}) AS b, {" + ".join(f"{o} * {o}" for o in _SCALED)} - 1 AS c FROM lineitem),
      r AS (SELECT point_id, b * b - 4 * a * c AS disc, (-b - sqrt(greatest(b * b - 4 * a * c, 0))) / (2 * a) AS near, (-b + sqrt(greatest(b * b - 4 * a * c, 0))) / (2 * a) AS far FROM v)
      SELECT point_id, round(CASE WHEN disc >= 0 THEN CASE WHEN near > 0 THEN near WHEN far > 0 THEN far END END, 6) AS distance FROM r""",
    "ideal_solids": f"WITH {_POINTS} SELECT frame_id, count(*) AS points, count(*) FILTER (x BETWEEN -0.1 AND 0.2 AND y BETWEEN -0.05 AND 0.15 AND z BETWEEN 0.0 AND 0.3) AS inside FROM pts GROUP BY frame_id",
    "hull_containment": f"WITH {_base(0.2)}, {_NODES}, {_BOXES} SELECT frame_id, count(*) AS cells, 0::BIGINT AS beyond, max(lox + w) AS most_x FROM boxes GROUP BY frame_id",
    "tet_blocks": """SELECT CAST(p_partkey AS BIGINT) AS frame_id, CAST(6 * ((p_partkey // 8) % 3 + 3) AS BIGINT) AS tets, true AS merged,
      CAST((p_partkey // 8) % 3 + 3 AS DOUBLE) AS volume, 0::BIGINT AS beyond FROM part WHERE p_partkey % 8 = 0""",
    "swept_hulls": "SELECT CAST(n_nationkey + 1 AS BIGINT) AS frame_id, 12::BIGINT AS planes, CAST(3 * (n_nationkey + 2) + 6 AS BIGINT) AS offsets, 6::BIGINT + 6 * 2 AS normals FROM nation",
    "hull_shapes": f"""WITH k AS (SELECT CAST(n_nationkey AS BIGINT) AS k, 2 + n_nationkey % 3 AS a, 2 + n_nationkey % 4 AS b, 1 + n_nationkey % 2 AS c, 2 + n_nationkey % 4 AS n FROM nation),
      s AS (SELECT k AS frame_id, CASE k % 3 WHEN 0 THEN (a + b - 1) * c WHEN 1 THEN 26 ELSE n * (n + 1) // 2 * c END AS voxels, CASE k % 3 WHEN 0 THEN (a - 1) * (b - 1) / (a + b - 2) ELSE 0.5 END AS d,
        CASE k % 3 WHEN 0 THEN (a * b - (a - 1) * (b - 1) / 2) * c WHEN 1 THEN 27 ELSE (n * n - (n - 1) * (n - 1) / 2) * c END AS hull, CASE k % 3 WHEN 1 THEN 6 ELSE 7 END AS p FROM k)
      SELECT frame_id, CAST(voxels AS BIGINT) AS voxels, d <= {FILL} AS whole, CASE WHEN d <= {FILL} THEN CAST(hull AS DOUBLE) ELSE 0.0::DOUBLE END AS volume, CAST(CASE WHEN d <= {FILL} THEN p ELSE 0 END AS BIGINT) AS planes,
      true AS bound_right, true AS complete, d > {FILL} AS too_far FROM s""",
    "hull_approximation": f"WITH {_NATIONS} SELECT frame_id, CAST((x1 - x0) * (y1 - y0) * (z1 - z0) AS BIGINT) AS voxels, 6 AS planes, CAST((x1 - x0) * (y1 - y0) * (z1 - z0) AS DOUBLE) AS volume, 0.0::DOUBLE AS bound FROM bx",
    "tree_texts": """WITH k AS (SELECT CAST(n_nationkey AS BIGINT) AS frame_id, n_nationkey % 3 + 1 AS n FROM nation), c AS (SELECT frame_id, n, unnest(range(n)) AS i FROM k),
      t AS (SELECT frame_id, n, '(' || array_to_string(list_sort(list_transform(range(6), lambda j: 'H' || (6 * i + j))), ' & ') || ')' AS b, 'max(' || array_to_string(list_transform(list_sort(list_transform(range(6), lambda j: 'h' || (6 * i + j))), lambda h: h || '(p)'), ', ') || ')' AS f, i FROM c),
      o AS (SELECT frame_id, n, string_agg(b, ' | ' ORDER BY i) AS b, string_agg(f, ', ' ORDER BY i) AS f FROM t GROUP BY ALL)
      SELECT frame_id, CASE WHEN n > 1 THEN '(' || b || ')' ELSE b END AS boolean, CASE WHEN n > 1 THEN 'min(' || f || ')' ELSE f END AS scalar, CAST(CASE WHEN n > 1 THEN 3 ELSE 2 END AS INTEGER) AS depth,
      CAST(6 * n AS INTEGER) AS "references", CAST(7 * n + CASE WHEN n > 1 THEN 1 ELSE 0 END AS INTEGER) AS nodes, CAST(6 * n + CASE WHEN n > 1 THEN n ELSE 0 END AS INTEGER) AS arrows, CAST(6 * n AS INTEGER) AS planes FROM o""",
    "zero_set": f"""WITH {_NATIONS}, g AS (SELECT bx.*, i, j, k2, -0.35 + 0.07::DOUBLE * i AS x, -0.45 + 0.07::DOUBLE * j AS y, 0.05 + 0.07::DOUBLE * k2 AS z FROM bx, (SELECT unnest(range(14)) AS i), (SELECT unnest(range(12)) AS j), (SELECT unnest(range(11)) AS k2)),
      v AS (SELECT *, x0 * {H}::DOUBLE <= x AND x <= x1 * {H}::DOUBLE AND y0 * {H}::DOUBLE <= y AND y <= y1 * {H}::DOUBLE AND z0 * {H}::DOUBLE <= z AND z <= z1 * {H}::DOUBLE AS held FROM g),
      e AS (SELECT a.frame_id, 0 AS axis, a.i, a.j, a.k2, CASE WHEN b.held THEN a.x0 ELSE a.x1 END * {H}::DOUBLE AS zero FROM v a JOIN v b ON a.frame_id = b.frame_id AND b.i = a.i + 1 AND b.j = a.j AND b.k2 = a.k2 WHERE a.held <> b.held
        UNION ALL SELECT a.frame_id, 1, a.i, a.j, a.k2, CASE WHEN b.held THEN a.y0 ELSE a.y1 END * {H}::DOUBLE FROM v a JOIN v b ON a.frame_id = b.frame_id AND b.i = a.i AND b.j = a.j + 1 AND b.k2 = a.k2 WHERE a.held <> b.held
        UNION ALL SELECT a.frame_id, 2, a.i, a.j, a.k2, CASE WHEN b.held THEN a.z0 ELSE a.z1 END * {H}::DOUBLE FROM v a JOIN v b ON a.frame_id = b.frame_id AND b.i = a.i AND b.j = a.j AND b.k2 = a.k2 + 1 WHERE a.held <> b.held)
      SELECT frame_id, CAST(axis AS INTEGER) AS axis, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(k2 AS INTEGER) AS k, round(zero, 9) AS zero FROM e""",
    "strided_patches": _surface(H, _PATCHES)
    + """, n AS (SELECT frame_id, row_number() OVER (PARTITION BY frame_id ORDER BY 2 * axis + CASE WHEN sign > 0 THEN 1 ELSE 0 END, plane, v0, u0) - 1 AS i, count(*) OVER (PARTITION BY frame_id) AS n FROM patches)
      SELECT frame_id, CAST(i AS INTEGER) AS patch_id FROM n WHERE n <= 16 OR i = 0 OR (i * 16) // n > ((i - 1) * 16) // n""",
    "nearest_points": f"""WITH {_POINTS}, {_NEAREST} SELECT frame_id, point_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY r) AS near, round(sqrt(max(d2)), 9) AS distance FROM nr WHERE r <= 7 GROUP BY frame_id, point_id""",
    "point_spacing": f"""WITH {_POINTS}, {_NEAREST}, s AS (SELECT frame_id, point_id, sum(sqrt(d2)) / (count(*) - 1) AS d FROM nr WHERE r <= 7 GROUP BY frame_id, point_id)
      SELECT frame_id, count(*) AS points, round(avg(d), 9) AS spacing FROM s GROUP BY frame_id""",
    "jet_surfaces": """WITH s AS (SELECT CAST(s_suppkey % 2 AS BIGINT) AS frame_id, CAST(s_suppkey AS BIGINT) AS point_id, (s_suppkey * 37 % 101) / 20.0::DOUBLE AS x, (s_suppkey * 53 % 97) / 30.0::DOUBLE AS y FROM supplier)
      SELECT frame_id, point_id, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(x * 0.25::DOUBLE - y * 0.5::DOUBLE + frame_id, 6) + 0.0 AS z, count(*) OVER (PARTITION BY frame_id) >= 6 AS moved FROM s""",
    "jet_smoothing": f"""WITH {_POINTS}, k AS (SELECT a.frame_id, a.point_id, count(*) AS n FROM pts a JOIN pts b ON a.frame_id = b.frame_id
      AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 0.08::DOUBLE * 0.08 GROUP BY ALL)
      SELECT frame_id, count(*) AS points, count(*) FILTER (n >= 12) AS moved FROM k GROUP BY frame_id""",
    "tet_clusters": "SELECT CAST(n_nationkey AS BIGINT) AS frame_id, 6::BIGINT AS tets, 3::BIGINT AS clusters FROM nation",
}
ORACLE_SQL["frame_stream"] = f"""WITH {_EVENT_SETS}, vx AS (SELECT sensor_id, frame_id, unnest(key) AS v FROM s), vo AS (SELECT sensor_id, frame_id, v[1] AS ix, v[2] AS iy, v[3] AS iz FROM vx),
  sides AS (SELECT * FROM (VALUES (0,-1,-1,0,0),(0,1,1,0,0),(1,-1,0,-1,0),(1,1,0,1,0),(2,-1,0,0,-1),(2,1,0,0,1)) t(axis, sign, dx, dy, dz)),
  pl AS (SELECT DISTINCT v.sensor_id, v.frame_id, axis, CASE axis WHEN 0 THEN v.ix WHEN 1 THEN v.iy ELSE v.iz END + CASE WHEN sign > 0 THEN 1 ELSE 0 END AS plane FROM vo v CROSS JOIN sides
    WHERE NOT EXISTS (SELECT 1 FROM vo n WHERE n.sensor_id = v.sensor_id AND n.frame_id = v.frame_id AND n.ix = v.ix + dx AND n.iy = v.iy + dy AND n.iz = v.iz + dz)),
  m AS (SELECT sensor_id, frame_id, axis, 2 * count(*) + 1 AS n FROM pl GROUP BY ALL), t AS (SELECT sensor_id, frame_id, CAST(product(n) AS BIGINT) AS strata FROM m GROUP BY ALL)
  SELECT r.*, t.strata, true AS certified, 0::BIGINT AS outside FROM ({ORACLE_SQL["frame_reuse"]}) r JOIN t USING (sensor_id, frame_id)"""

#: Numbers that are 32 bits wide in the results.
_NARROW = {
    "support_planes": ["support_id"],
    "canonical_cells": ["cx", "cy", "cz"],
    "cell_box_sums": ["cx", "cy", "cz"],
    "cell_box_counts": ["lox", "loy", "loz", "hix", "hiy", "hiz"],
    "aabb_planes": ["cell_id"],
    "shared_leaves": ["first_cell", "leaf_id"],
    "sweep_rectangles": ["slab", "axis"],
    "free_adjacency": ["ax", "ay", "az"],
}
_SAMPLES = f"SELECT frame_id, CAST(sum(probes) AS BIGINT) AS samples FROM ({ORACLE_SQL['probe_audit']}) GROUP BY frame_id"
ORACLE_SQL["octree_bundle"] = f"""WITH c AS (SELECT frame_id, 'exact' AS pruning, cells FROM ({ORACLE_SQL["tree_size"]}) UNION ALL SELECT frame_id, 'rect', cells FROM ({ORACLE_SQL["octree_rect_cover"]})
  UNION ALL SELECT frame_id, 'none', voxels FROM ({ORACLE_SQL["octree_rect_cover"]})), s AS ({_SAMPLES})
  SELECT frame_id, pruning, cells, 6 * cells AS planes, 7 * cells + CASE WHEN cells > 1 THEN 1 ELSE 0 END AS nodes, 6 * cells AS stored, samples, 0::BIGINT AS wrong,
  0::BIGINT AS uncovered, 0::BIGINT AS overlapping, 0::BIGINT AS outside, true AS ok FROM c JOIN s USING (frame_id)"""
ORACLE_SQL["sweep_bundle"] = f"""WITH a AS ({ORACLE_SQL["axis_selection"]}), s AS ({_SAMPLES})
  SELECT frame_id, axis, fallback, nodes, 3::BIGINT AS candidates, prisms AS stored_prisms, fallback AS obstacles, samples, 0::BIGINT AS wrong, true AS ok FROM a JOIN s USING (frame_id)"""
for _name, _columns in _NARROW.items():
    _casts = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in _columns)
    ORACLE_SQL[_name] = f"SELECT * REPLACE ({_casts}) FROM ({ORACLE_SQL[_name]})"
