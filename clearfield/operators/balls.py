"""Sums over the points within a radius of each point, and degree-2 fits from these sums.

A fit needs no neighbour by itself, only sums of products of their coordinates up to degree 4. Points are taken by
small cells: cells that lie within the radius of a whole cell are added as sums, points within the radius of all its
points once for all of these, and only those at the rim are compared one by one, whose sums are one matrix product.
"""

from __future__ import annotations

import itertools

import numpy as np

from .neighbours import fitted

#: Points of a small cell, small cells along a radius at most, and numbers that are worked on at a time.
POINTS_A_CELL, MOST_CELLS, MOST_NUMBERS = 24, 12, 1 << 18
#: Part of the radius by which rounding may be off; beyond it nothing is compared again.
SLACK = 1e-9
#: Least eigenvalue of a fit's equations, against the largest, from which their sums decide it to some ten digits.
LEAST_EIGENVALUE = 1e-5
#: Radii from the origin up to which small cells are used.
FARTHEST = 1e6

#: Exponents of the products up to degree 4, lowest first; products of two of the first ten are one of all.
POWERS = sorted((p for p in itertools.product(range(5), repeat=3) if sum(p) <= 4), key=lambda p: (sum(p), [-k for k in p]))
_FROM = [next((k, POWERS.index(tuple(e - (i == k) for i, e in enumerate(p)))) for k in range(3) if p[k]) for p in POWERS[1:]]
_PAIRS = np.array([[POWERS.index(tuple(a + b for a, b in zip(p, q, strict=True))) for q in POWERS[:10]] for p in POWERS[:10]])


def products(x: np.ndarray) -> np.ndarray:
    """Products of coordinates of points x (3, n) by their exponents: (35, n)."""
    out = np.empty((len(POWERS), x.shape[1]))
    out[0] = 1
    for i, (k, of) in enumerate(_FROM):
        np.multiply(out[of], x[k], out=out[i + 1])
    return out


def _runs(m: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of cells around one, m to a radius: first and last of those within the radius as a whole, and of those at the rim."""
    o = np.arange(-m - 1, m + 2)
    far, near = (f(np.abs(o)) for f in (lambda a: (a + 1.0) ** 2, lambda a: np.maximum(a - 1.0, 0) ** 2))
    inside = far[:, None, None] + far[:, None] + far <= m * m * (1 - SLACK)
    rim = ~inside & (near[:, None, None] + near[:, None] + near <= m * m * (1 + SLACK))
    found = []
    for held in (inside, rim):
        step = np.diff(np.pad(held.astype(np.int8), ((0, 0), (0, 0), (1, 1))), axis=2)
        for side, shift in ((1, 0), (-1, 1)):
            i, j, k = np.nonzero(step == side)
            found.append((o[i] * width + o[j]) * width + k - shift - m - 1)
    return tuple(found)


def ball_sums(x: np.ndarray, mine: np.ndarray, corner: np.ndarray, radius: float) -> np.ndarray:
    """Sums of ``products`` of the points within the radius of each point mine of a cell: (len(mine), 35).

    x: points of the cell as wide as the radius that begins at corner, and of the 26 around it; they are finite; mine ascends. Products are of
    places about the cell's middle, in radii. Whether a point is within the radius is decided in doubles of x itself.
    """
    # So far out that a cell's corner is rounded by more than the slack, nothing is told by small cells.
    m = int(np.clip(np.cbrt(len(mine) / POINTS_A_CELL), 1, MOST_CELLS)) if np.abs(corner).max() <= FARTHEST * radius else 1
    width, middle = 3 * m + 2, corner + radius / 2
    at = np.clip(np.floor((x - corner) * (m / radius)).astype(np.int64), -m, 2 * m - 1)
    at[mine] = np.clip(at[mine], 0, m - 1)
    cell = ((at + m + 1) * [width * width, width, 1]).sum(axis=1)
    order = np.argsort(cell, kind="stable")
    # By axis, as all steps go through many points at a time.
    y = np.ascontiguousarray(x[order].T)
    local = (y - middle[:, None]) / radius
    start = np.concatenate([[0], np.cumsum(np.bincount(cell, minlength=width**3))])
    ask = np.zeros(len(x), bool)
    ask[mine] = True
    ask = ask[order]
    within_lo, within_hi, rim_lo, rim_hi = _runs(m, width)
    before = None
    if len(within_lo):  # sums of all cells before each
        before, step = np.zeros((width**3 + 1, len(POWERS))), max(1, MOST_NUMBERS // len(POWERS))
        for i in range(0, len(x), step):
            own = cell[order[i : i + step]]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            before[own[first] + 1] += np.add.reduceat(products(local[:, i : i + step]), first, axis=1).T
        np.cumsum(before, axis=0, out=before)
    rank = np.searchsorted(mine, order)
    sums, squared = np.empty((len(mine), len(POWERS))), radius * radius
    for c in np.unique(cell[mine]).tolist():
        group = start[c] + np.flatnonzero(ask[start[c] : start[c + 1]])
        total = np.zeros(len(POWERS)) if before is None else (before[c + within_hi + 1] - before[c + within_lo]).sum(axis=0)
        lo, hi = start[c + rim_lo], start[c + rim_hi + 1]
        many = hi - lo
        ends = np.cumsum(many)
        rim = np.arange(ends[-1]) + np.repeat(lo - ends + many, many)
        low, high = local[:, group].min(axis=1), local[:, group].max(axis=1)
        parts = []
        for i in range(0, len(rim), MOST_NUMBERS >> 3):
            some = rim[i : i + (MOST_NUMBERS >> 3)]
            p = local.take(some, axis=1)
            closest, farthest = np.zeros(len(some)), np.zeros(len(some))
            for k in range(3):
                below, above = low[k] - p[k], p[k] - high[k]
                out = np.maximum(below, above)
                far = out + (high[k] - low[k])
                np.maximum(out, 0, out=out)
                closest += out * out
                farthest += far * far
            whole = farthest <= 1 - SLACK
            if whole.any():
                total += products(p[:, whole]).sum(axis=1)
            parts.append(some[~whole & (closest <= 1 + SLACK)])
        sums[rank[group]] = total
        open_ = np.concatenate(parts)
        block = max(1, MOST_NUMBERS // max(len(POWERS), len(group)))
        for i in range(0, len(open_), block):
            some = open_[i : i + block]
            told, q = products(local.take(some, axis=1)).T, y.take(some, axis=1)
            for j in range(0, len(group), max(1, MOST_NUMBERS // len(some))):
                part = group[j : j + max(1, MOST_NUMBERS // len(some))]
                d2 = q[0] - y[0, part, None]
                d2 *= d2
                for k in (1, 2):
                    d = q[k] - y[k, part, None]
                    d *= d
                    d2 += d
                sums[rank[part]] += (d2 <= squared).astype(np.float64) @ told
    return sums


def fits(x: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points x (n, 3) on the degree-2 surfaces that fit their neighbours, of which the sums of products are given, and whether
    the sums decide the fit. See ``neighbours.fitted``, which looks at every neighbour instead."""
    gram = sums[:, _PAIRS]
    count = gram[:, 0, 0]
    gram = gram / count[:, None, None]
    middle = gram[:, 0, 1:4]
    _, axes = np.linalg.eigh(gram[:, 1:4, 0, None] * -middle[:, None] + _squares(gram))
    axes = axes[:, :, ::-1]  # widest first, the normal last
    # Each term by the ten products of degree 2 at most.
    line = np.zeros((len(x), 3, 10))
    line[:, :, 0] = -np.einsum("nkc,nk->nc", axes, middle)
    line[:, :, 1:4] = axes.transpose(0, 2, 1)
    u, v, w = line[:, 0], line[:, 1], line[:, 2]
    one = np.zeros_like(u)
    one[:, 0] = 1
    terms = np.stack([one, u, v, _times(u, u), _times(u, v), _times(v, v)], axis=1)
    half = terms @ gram
    value, vector = np.linalg.eigh(half @ terms.transpose(0, 2, 1))
    sure = value[:, 0] > LEAST_EIGENVALUE * value[:, -1]
    right = (vector.transpose(0, 2, 1) @ (half @ w[:, :, None]))[:, :, 0]
    fit = (vector @ np.divide(right, value, out=np.zeros_like(right), where=sure[:, None])[:, :, None])[:, :, 0]
    own = np.einsum("nkc,nk->nc", axes, x - middle)
    a, b = own[:, 0], own[:, 1]
    own[:, 2] = (np.stack([np.ones_like(a), a, b, a * a, a * b, b * b], axis=1) * fit).sum(axis=1)
    return middle + (axes @ own[:, :, None])[:, :, 0], sure


_SECOND = np.array([[POWERS.index(tuple((i == k) + (j == k) for k in range(3))) for j in range(3)] for i in range(3)])


def _squares(gram: np.ndarray) -> np.ndarray:
    """Mean products of two coordinates (n, 3, 3)."""
    return gram[:, 0][:, _SECOND]


def _times(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Products of two lines, both given by the ten products."""
    out = np.zeros_like(p)
    for i, j in itertools.product(range(4), repeat=2):
        out[:, _PAIRS[i, j]] += p[:, i] * q[:, j]
    return out


def smoothed(x: np.ndarray, mine: np.ndarray, cell: np.ndarray, radius: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Points mine of x on the degree-2 surfaces that fit their neighbours within the radius, and whether they moved.

    x: points of some cells as wide as the radius, given by number (n, 3), and of all cells around those of mine. Points with fewer than
    ``least`` neighbours stay, as do those that are not finite. Where sums do not decide a fit, its neighbours are looked at.
    """
    out, moved = x[mine].copy(), np.zeros(len(mine), bool)
    finite = np.isfinite(x).all(axis=1)
    good = np.flatnonzero(finite[mine])
    cells, of = np.unique(cell[mine[good]], axis=0, return_inverse=True)
    order = np.argsort(of.ravel(), kind="stable")
    ends = np.searchsorted(of.ravel()[order], np.arange(len(cells) + 1))
    for c, a, b in zip(cells, ends[:-1], ends[1:], strict=True):
        rows = good[order[a:b]]
        held = np.flatnonzero(finite & (np.abs(cell - c) <= 1).all(axis=1))
        corner = c * radius
        sums = ball_sums(x[held], np.searchsorted(held, mine[rows]), corner, radius)
        enough = np.flatnonzero(np.rint(sums[:, 0]) >= least)
        for i in range(0, len(enough), MOST_NUMBERS >> 8):
            some = enough[i : i + (MOST_NUMBERS >> 8)]
            at, middle = mine[rows[some]], corner + radius / 2
            to, sure = fits((x[at] - middle) / radius, sums[some])
            out[rows[some]], moved[rows[some]] = to * radius + middle, True
            if not sure.all():
                out[rows[some[~sure]]] = _one_by_one(x[at[~sure]], x[held], radius)
    return out, moved


def _one_by_one(x: np.ndarray, held: np.ndarray, radius: float) -> np.ndarray:
    """``fitted`` of points x by their neighbours among the held ones; equal places are fitted once."""
    places, of = np.unique(x, axis=0, return_inverse=True)
    out = np.empty_like(places)
    for i, p in enumerate(places):
        d = held - p
        d *= d
        out[i] = fitted(p[None], held[None, d[:, 0] + d[:, 1] + d[:, 2] <= radius * radius])[0]
    return out[of.ravel()]
