"""Event sweeps, their limits and fallback, prefix sums of sparse cells: against brute force on grids."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from clearfield.operators import boundary, sweep, voxels
from clearfield.operators.sweep import CrossSection, Limits, Sweep


def surface(spark, frames):
    """frames: frame_id -> voxel keys."""
    rows = [(f, *k) for f, keys in frames.items() for k in keys]
    v = spark.createDataFrame(rows, "frame_id long, ix long, iy long, iz long").repartition(3)
    faces = boundary.exposed_faces(v)
    coords = boundary.coordinates(boundary.supports(faces))
    return v, boundary.patches(faces), coords


def greedy(grid, n, m):
    """Free rectangles of a grid n x m (rows x columns): runs along a row joined with equal runs of the row before."""
    out, held = [], {}
    for r in range(n + 1):
        runs = set()
        c = 0
        while r < n and c < m:
            if (r, c) in grid:
                c += 1
                continue
            e = c
            while e < m and (r, e) not in grid:
                e += 1
            runs.add((c, e))
            c = e
        for run in [x for x in held if x not in runs]:
            out.append((held.pop(run), r, *run))
        for run in runs:
            held.setdefault(run, r)
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_cross_section_against_a_grid(seed):
    r = random.Random(seed)
    n, m = 9, 7
    held, state = set(), CrossSection(0, n)
    for _ in range(60):
        r0, c0 = r.randrange(n), r.randrange(m)
        r1, c1 = r.randrange(r0 + 1, n + 1), r.randrange(c0 + 1, m + 1)
        area = set(itertools.product(range(r0, r1), range(c0, c1)))
        for opens in (True, False):
            if area & held and opens or area - held and not opens:
                copy = CrossSection(0, n)
                copy.cuts, copy.edges = list(state.cuts), [list(e) for e in state.edges]
                with pytest.raises(ValueError):
                    copy.toggle(r0, r1, c0, c1, opens)
            else:
                state.toggle(r0, r1, c0, c1, opens)
                held = held | area if opens else held - area
                state.tidy()
                assert sorted(state.rectangles(0, m)) == greedy(held, n, m)
                break


def brute(keys, axis):
    """(slab, lo, hi) rectangles of every slab over compressed coordinates, as the definition has them."""
    faces = {c: set() for c in range(3)}
    held = set(keys)
    for k in keys:
        for c in range(3):
            for d in (-1, 1):
                if tuple(x + d * (i == c) for i, x in enumerate(k)) not in held:
                    faces[c].add(k[c] + (d > 0))
    p = [sorted(f) for f in faces.values()]
    u, v = (axis + 1) % 3, (axis + 2) % 3
    out = []
    for s in range(len(p[axis]) - 1):
        grid = set()
        for i, j in itertools.product(range(len(p[u]) - 1), range(len(p[v]) - 1)):
            at = [0, 0, 0]
            at[axis], at[u], at[v] = p[axis][s], p[u][i], p[v][j]
            if tuple(at) in held:
                grid.add((i, j))
        n, m = len(p[u]) - 1, len(p[v]) - 1
        one = greedy(grid, n, m)
        two = [(c0, c1, r0, r1) for r0, r1, c0, c1 in greedy({(j, i) for i, j in grid}, m, n)]
        for r0, r1, c0, c1 in two if len(two) < len(one) else one:
            lo, hi = [0, 0, 0], [0, 0, 0]
            lo[axis], hi[axis] = p[axis][s], p[axis][s + 1]
            lo[u], hi[u], lo[v], hi[v] = p[u][r0], p[u][r1], p[v][c0], p[v][c1]
            out.append((s + 1, *lo, *hi))
    return sorted(out)


@pytest.fixture(scope="module")
def shapes():
    r = random.Random(11)
    cube = list(itertools.product(range(3), repeat=3))
    frames = {
        0: [(0, 0, 0)],
        1: [k for k in cube if k != (1, 1, 1)],  # a cavity
        2: [(-4, 0, 2), (5000, 1, 2)],
        3: [(0, 0, 0), (1, 1, 1), (2, 0, 1)],  # contacts in edges and corners
        4: [(i, j, k) for i, j, k in itertools.product(range(4), repeat=3) if k <= i],
    }
    for f in range(5, 12):
        frames[f] = sorted({tuple(r.randrange(-3, 4) for _ in range(3)) for _ in range(10 * (f - 3))})
    return frames


def test_sweeps_of_all_axes_against_grids(spark, shapes):
    _, patched, coords = surface(spark, shapes)
    for axis in range(3):
        got = {}
        for r in sweep.sweep_rectangles(patched, coords, axis).collect():
            got.setdefault(r.frame_id, []).append((r.slab, r.lox, r.loy, r.loz, r.hix, r.hiy, r.hiz))
        assert {f: sorted(x) for f, x in got.items()} == {f: b for f in shapes if (b := brute(shapes[f], axis))}


def test_a_frame_of_a_thousand_planes_an_axis(spark):
    v, patched, coords = surface(spark, {7: [(2 * i, 2 * i, 2 * i) for i in range(500)]})
    limits = Limits(cells=10**9)
    with pytest.raises(ValueError, match="1 frames pass a limit of the sweep, frame 7 the compressed_cell_limit"):
        sweep.sweep_rectangles(patched, coords, 0)
    space = sweep.free_space(patched, coords, 0, limits)
    assert coords.select(F.size("px")).first()[0] == 1000
    assert space.prisms.agg(F.sum(F.expr("(hix - lox) * (hiy - loy) * (hiz - loz)"))).first()[0] == 999**3 - 500
    status = space.status.first()
    assert status.reason is None and status.updates == 1000 and status.prisms < 3000


def test_limits_and_their_order():
    def run(limits):
        s = Sweep(1, 2, [0, 1, 2], [0, 1, 2], limits)
        out = []
        for e in ((0, -1, 0, 1, 0, 1), (1, 1, 0, 1, 0, 1), (1, -1, 1, 2, 1, 2), (2, 1, 1, 2, 1, 2)):
            out += s.feed(*e)
        s.end()
        assert s.reason or len(out) == 4
        return s.reason

    assert run(Limits(8, 4, 4)) is None
    assert run(Limits(7, 4, 4)) == "compressed_cell_limit"
    assert run(Limits(8, 3, 4)) == "event_update_limit"
    assert run(Limits(8, 3, 3)) == "free_prism_limit"  # the slab is closed before the last event
    assert run(Limits(8, 2, 1)) == "free_prism_limit"
    assert run(Limits(8, 1, 1)) == "free_prism_limit"
    assert run(Limits(8, 1, 2)) == "event_update_limit"
    for bad in ((0, 1, 1), (1, 0, 1), (1, 1, 0)):
        with pytest.raises(ValueError):
            Limits(*bad)


def test_patches_that_do_not_close_are_an_error(spark):
    _, patched, coords = surface(spark, {3: [(0, 0, 0), (0, 0, 4)]})
    for damaged in (patched.where("not (axis = 2 and sign > 0 and plane = 5)"), patched.withColumn("sign", F.when((F.col("axis") == 2) & (F.col("plane") == 1), -1).otherwise(F.col("sign")))):
        with pytest.raises(Exception, match="frame 3"):
            sweep.sweep_rectangles(damaged, coords, 2).collect()


def test_fallback_has_the_signs_of_the_sweep(spark, shapes):
    v, patched, coords = surface(spark, shapes)
    h = 0.25
    p = v
    for c in "xyz":
        p = p.withColumn(f"k{c}", F.explode(F.array(*[2 * F.col(f"i{c}") + d for d in range(-1, 4)])))
    p = p.select("frame_id", *[(F.col(f"k{c}") / 2 * F.lit(h)).alias(c) for c in "xyz"]).distinct()
    want = voxels.closed_sign(p, v, h).withColumn("want", F.col("sign") < 0)
    for axis in range(3):
        space = sweep.free_space(patched, coords, axis, Limits(prisms=30, updates=40))
        reasons = {r.frame_id: r.reason for r in space.status.collect()}
        assert set(reasons) == set(shapes) and len(set(reasons.values())) >= 3
        got = sweep.strictly_free(want, space, coords, v, h).collect()
        assert len(got) == want.count() and all(r.free == r.want and r.fallback == (reasons[r.frame_id] is not None) for r in got)
    whole = [sweep.free_space(patched, coords, axis, Limits(1, 1, 1)) for axis in range(3)]
    best = {r.frame_id: r for r in sweep.best_axis(whole, v).collect()}
    assert all(r.fallback and r.axis == 0 and r.prisms == 0 for r in best.values()) and set(best) == set(shapes)
    assert (best[0].nodes, best[0].leaf_references) == (7, 6) and (best[2].nodes, best[2].leaf_references) == (15, 12)


def test_prefix_sums_and_box_counts_of_sparse_cells(spark):
    r = random.Random(2)
    frames = {0: [(i, i, i) for i in range(1, 201)], 1: sorted({tuple(r.randrange(1, 9) for _ in range(3)) for _ in range(120)}), 2: [(1, 1, 1)]}
    cells = spark.createDataFrame([(f, *c) for f, cs in frames.items() for c in cs], "frame_id long, cx int, cy int, cz int").repartition(3)
    got = {(s.frame_id, s.cx, s.cy, s.cz): s.prefix for s in boundary.box_sums(cells).collect()}
    assert got == {(f, *c): sum(all(a <= b for a, b in zip(d, c)) for d in cs) for f, cs in frames.items() for c in cs}
    assert sum(k[0] == 0 for k in got) == 200
    boxes = [(f, *lo, *[x + r.randrange(0, 6) for x in lo]) for f in (0, 1, 2, 9) for lo in [tuple(r.randrange(-2, 210 if f == 0 else 10) for _ in range(3)) for _ in range(40)]]
    df = spark.createDataFrame(boxes, "frame_id long, lox int, loy int, loz int, hix int, hiy int, hiz int")
    for b in boundary.box_counts(cells, df).collect():
        assert b.cells == sum(all(b[f"lo{a}"] <= x < b[f"hi{a}"] for a, x in zip("xyz", c)) for c in frames.get(b.frame_id, []))
    assert boundary.box_counts(cells, df).count() == len(set(boxes))
    assert {s.prefix for s in boundary.dominance_counts(cells.where("false"), cells).collect()} == {0}


def test_prefix_sums_at_every_place_of_the_grid(spark):
    r = random.Random(5)
    frames = {0: [(i, 2 * i, i) for i in range(1, 13)], 1: sorted({tuple(r.randrange(1, 7) for _ in range(3)) for _ in range(40)}), 2: [(1, 1, 1)]}
    cells = spark.createDataFrame([(f, *c) for f, cs in frames.items() for c in cs], "frame_id long, cx int, cy int, cz int").repartition(3)
    rows = boundary.grid_sums(cells).collect()
    got = {(s.frame_id, s.cx, s.cy, s.cz): s.prefix for s in rows}
    places = {f: itertools.product(*[sorted({c[k] for c in cs}) for k in range(3)]) for f, cs in frames.items()}
    assert got == {(f, *p): sum(all(a <= b for a, b in zip(d, p)) for d in frames[f]) for f, ps in places.items() for p in ps}
    assert len(rows) == len(got) and sum(k[0] == 0 for k in got) == 12**3
