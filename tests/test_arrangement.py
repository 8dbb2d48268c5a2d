import itertools
import math
import random

import numpy as np
import pytest

from clearfield.operators import arrangement as A
from clearfield.streaming.frames import snapshot

NAMED = {
    "single": [(0, 0, 0)],
    "gap": [(0, 0, 0), (2, 0, 0)],
    "edge": [(0, 0, 0), (1, 1, 0)],
    "vertex": [(0, 0, 0), (1, 1, 1)],
    "L": [(0, 0, 0), (1, 0, 0), (0, 1, 0)],
    "U": [(0, 0, 0), (1, 0, 0), (2, 0, 0), (0, 1, 0), (2, 1, 0)],
    "stairs": [(i, j, 0) for i in range(3) for j in range(3 - i)],
    "cavity": [k for k in itertools.product(range(3), repeat=3) if k != (1, 1, 1)],
    "negative": [(-5, -3, -1), (-4, -3, -1)],
    "far": [(0, 0, 0), (5000, 0, 0)],
}


def program_of(keys, h=0.04):
    data, strata, bad = snapshot(np.array(sorted(keys), dtype=np.int64), h)
    return A.Program.unpack(data), strata, bad


def closed_sign(keys, x, h):
    """1 if every box around a point is occupied, -1 if none is, 0 otherwise."""
    keys, sides = set(keys), []
    for v in map(float, x):
        i = math.floor(v / h)
        i += (v >= (i + 1) * h) - (v < i * h)
        sides.append([i - 1, i] if v == i * h else [i])
    hits = [k in keys for k in itertools.product(*sides)]
    return 1 if all(hits) else (0 if any(hits) else -1)


@pytest.mark.parametrize("name", NAMED)
def test_named_shapes_are_certified(name):
    _, strata, bad = program_of(NAMED[name])
    assert strata > 0 and bad == 0


def test_all_small_patterns():
    cube = list(itertools.product(range(2), repeat=3))
    for mask in range(1, 256):
        keys = [c for i, c in enumerate(cube) if mask >> i & 1]
        p, _, bad = program_of(keys, 1.0)
        assert bad == 0
        half = [k / 2 for k in range(-1, 6)]
        x = np.array(list(itertools.product(half, repeat=3)))
        assert np.sign(A.hard_values(p, x)).tolist() == [closed_sign(keys, v, 1.0) for v in x]


def test_random_patterns_and_ulps():
    r = random.Random(17)
    for _ in range(12):
        keys = [k for k in itertools.product(range(4), repeat=3) if r.random() < 0.25] or [(0, 0, 0)]
        p, _, bad = program_of(keys)
        assert bad == 0
        x = []
        for k in r.sample(keys, min(6, len(keys))):
            for step in itertools.product((-1, 0, 1), repeat=3):
                x.append([math.nextafter(i * 0.04, s * math.inf) if s else i * 0.04 for i, s in zip(k, step, strict=True)])
        x = np.array(x)
        assert np.sign(A.hard_values(p, x)).tolist() == [closed_sign(keys, v, 0.04) for v in x]


def test_sharing_changes_no_value_and_limits_hold():
    keys = np.array(sorted(NAMED["cavity"]))
    planes = [np.array([0, 1, 2, 3])] * 3
    grid = np.zeros((5, 5, 5), bool)
    grid[keys[:, 0] + 1, keys[:, 1] + 1, keys[:, 2] + 1] = True
    plain, interned = A.build(grid, planes, 0.1, intern=False), A.build(grid, planes, 0.1)
    shared = A.share(plain)
    x = np.random.default_rng(1).uniform(-0.1, 0.5, (500, 3))
    for p in (interned, shared):
        assert (A.hard_values(p, x) == A.hard_values(plain, x)).all()
        assert len(p.op) <= len(plain.op) and A.expanded_nodes(p) == A.expanded_nodes(plain)
    for beta in (10.0, 1000.0):
        assert (A.smooth_values(shared, x, beta)[0] == A.smooth_values(plain, x, beta)[0]).all()
    with pytest.raises(A.WorkLimit):
        A.build(grid, planes, 0.1, most_nodes=5)


def three(op):
    return A.Program([0, 0, 0, op], [0, 1, 2, -1], [(), (), (), (0, 1, 2)], [0, 1, 2], [1, 1, 1], [0, 0, 0], 1.0)


def test_ties_and_repeated_children():
    beta, x = 7.0, np.zeros((1, 3))
    value, slope = A.smooth_values(three(A.MAX), x, beta)
    assert value[0] == pytest.approx(math.log(3) / beta) and slope[0] == pytest.approx([1 / 3] * 3)
    value, slope = A.smooth_values(three(A.MIN), x, beta)
    assert value[0] == pytest.approx(0.0) and slope[0] == pytest.approx([1 / 3] * 3)
    twice = A.Program([0, A.MAX], [0, -1], [(), (0, 0)], [0], [1], [0], 1.0)
    assert A.smooth_values(twice, x + 0.5, beta)[0][0] == pytest.approx(0.5 + math.log(2) / beta)


def test_smooth_bounds_and_gradients():
    p, _, _ = program_of(NAMED["stairs"])
    beta, bound = A.smoothing(p, error=1e-3)
    assert bound <= 1e-3 * (1 + 1e-9)
    x = np.random.default_rng(2).uniform(-0.05, 0.2, (400, 3))
    q, (upper, slope) = A.hard_values(p, x), A.smooth_values(p, x, beta)
    assert (upper >= q - 1e-15).all() and (upper - q <= bound + 1e-15).all()
    soft = 40.0
    _, slope = A.smooth_values(p, x, soft)
    for k in range(3):
        d = np.zeros(3)
        d[k] = 1e-6
        numeric = (A.smooth_values(p, x + d, soft)[0] - A.smooth_values(p, x - d, soft)[0]) / 2e-6
        assert np.allclose(slope[:, k], numeric, atol=1e-6)
    for bad in ({}, {"error": 1.0, "beta": 1.0}, {"error": -1.0}, {"beta": math.inf}):
        with pytest.raises(ValueError):
            A.smoothing(p, **bad)


def test_tampering_is_found():
    p, _, _ = program_of(NAMED["L"], 1.0)
    planes = [np.array(sorted({c for a, c in zip(p.axis, p.coord, strict=True) if a == k})) for k in range(3)]
    keys = np.array(NAMED["L"])
    grid = np.zeros([len(c) + 1 for c in planes], bool)
    grid[tuple(np.searchsorted(planes[k], keys[:, k], side="right") for k in range(3))] = True
    assert A.strata_mismatches(p, grid, planes)[1] == 0
    p.sign[0] = -p.sign[0]
    assert A.strata_mismatches(p, grid, planes)[1] > 0


def test_values_go_with_their_last_use():
    """A long function holds as many nodes' values as are still to be used, not all of them, and its values are the same."""
    import tracemalloc

    n, p = 4096, A.Program([], [], [], [], [], [], 0.1)
    r = np.random.default_rng(5)
    for k in range(400):  # leaves and joins in turn: ((a min b) max c) min d ...
        p.axis.append(k % 3), p.sign.append(1 if k % 2 else -1), p.coord.append(int(r.integers(-20, 20)))
        p.op.append(A.LEAF), p.leaf.append(k), p.children.append(())
        if k:
            p.op.append(A.MIN if k % 4 < 2 else A.MAX), p.leaf.append(-1), p.children.append((len(p.op) - 3 if k > 1 else 0, len(p.op) - 2))
    x = r.uniform(-2, 2, (n, 3))
    want = None
    for k in range(400):
        leaf = p.sign[k] * x[:, p.axis[k]] - p.sign[k] * (p.coord[k] * p.h)
        want = leaf if want is None else (np.minimum if k % 4 < 2 else np.maximum)(want, leaf)
    for run in (lambda: A.hard_values(p, x), lambda: A.smooth_values(p, x, 500.0)):
        tracemalloc.start()
        got = run()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 60 * 8 * n  # all nodes' values alone are 799 * 8 * n
    assert (A.hard_values(p, x) == want).all() and np.abs(got[0] - want).max() < 0.05 and A.most_held(p) == 3
