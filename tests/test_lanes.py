"""Sign lanes of the certificate against signs of single strata, in slabs of any size, on right and damaged functions."""

import itertools
import random

import numpy as np
import pytest

from clearfield.operators import arrangement


def shape(seed, planes):
    r = random.Random(seed)
    coords = [np.array(sorted(r.sample(range(-200, 200), n))) for n in planes]
    grid = np.zeros([len(c) + 1 for c in coords], bool)
    for at in itertools.product(*(range(1, len(c)) for c in coords)):
        grid[at] = r.random() < 0.5
    return coords, grid


def sign_of(p, coords, place):
    """Sign of a stratum by one recursion a node; an odd place is a plane, an even one between planes."""
    values = []
    for op, leaf, children in zip(p.op, p.leaf, p.children, strict=True):
        if op == arrangement.LEAF:
            k = p.axis[leaf]
            at = 2 * list(coords[k]).index(p.coord[leaf]) + 1
            values.append(p.sign[leaf] * int(np.sign(place[k] - at)))
        else:
            values.append((min if op == arrangement.MIN else max)(values[c] for c in children))
    return values[-1]


def right_of(grid, place):
    around = [grid[c] for c in itertools.product(*[{n // 2, (n + 1) // 2} for n in place])]
    return 1 if all(around) else -1 if not any(around) else 0


@pytest.mark.parametrize("seed,planes", [(0, (2, 2, 2)), (1, (4, 3, 5)), (2, (2, 3, 40)), (3, (3, 2, 32)), (4, (2, 2, 66))])
def test_lanes_against_single_strata(seed, planes):
    coords, grid = shape(seed, planes)
    if not grid.any():
        grid[1, 1, 1] = True
    p = arrangement.build(grid, coords, 0.1)
    for most in (1, 5000, 1 << 28):
        assert arrangement.strata_mismatches(p, grid, coords, most) == (int(np.prod([2 * len(c) + 1 for c in coords])), 0)
    hurt = grid.copy()
    hurt[1, 1, 1] ^= True
    hurt[-2, -2, -2] ^= hurt.shape != (3, 3, 3)
    sizes = [2 * len(c) + 1 for c in coords]
    want = [(*place, a, b) for place in itertools.product(*map(range, sizes)) if (a := sign_of(p, coords, place)) != (b := right_of(hurt, place))]
    assert want
    for most in (1, 3000, 1 << 28):
        assert arrangement.strata_mismatches(p, hurt, coords, most)[1] == len(want)
    strata, wrong, first = arrangement.strata_defects(p, hurt, coords, 1000)
    assert sorted(first) == want[:1000] and sum(wrong) == len(want) and sum(strata) == np.prod(sizes)
    assert wrong == [sum(sum((n + 1) % 2 for n in w[:3]) == d for w in want) for d in range(4)]
    assert first[:24] == arrangement.strata_defects(p, hurt, coords)[2]


def test_lanes_take_an_eighth_of_a_byte_for_each_sign():
    bits = np.random.default_rng(0).random((3, 5, 200)) < 0.5
    packed = arrangement._lanes(bits)
    assert packed.shape == (3, 5, 4) and packed.nbytes * 8 == 3 * 5 * 256
    assert (np.unpackbits(packed.view(np.uint8), axis=-1, bitorder="little")[..., :200] == bits).all() and int(np.bitwise_count(packed).sum()) == bits.sum()
