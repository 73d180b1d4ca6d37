import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra.numpy import arrays

from plumeloom.kernels import fit, rings
from plumeloom.kernels.assign import assigned
from plumeloom.kernels.label import labelled
from plumeloom.kernels.meanshift import mean_shift


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 6), st.integers(0, 10**6))
def test_assignment_is_cheapest(n, m, seed):
    cost = np.random.default_rng(seed).integers(0, 9, (n, m)).astype(float)
    rows, columns = assigned(cost)
    assert len(rows) == min(n, m) == len(set(rows)) == len(set(columns))
    small, wide = (cost, False) if n <= m else (cost.T, True)
    best = min(sum(small[i, p[i]] for i in range(small.shape[0])) for p in itertools.permutations(range(small.shape[1]), small.shape[0]))
    assert math.isclose(cost[rows, columns].sum(), best), wide


@settings(max_examples=60, deadline=None)
@given(arrays(bool, (6, 7)))
def test_labels_and_outlines(mask):
    y, x = np.nonzero(mask)
    labels = labelled(y, x)
    seen, number = {}, 0
    for start in zip(y, x, strict=True):
        if start not in seen:
            number += 1
            todo = [start]
            while todo:
                r, c = todo.pop()
                if 0 <= r < 6 and 0 <= c < 7 and mask[r, c] and (r, c) not in seen:
                    seen[r, c] = number
                    todo += [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
    assert labels.tolist() == [seen[p] for p in zip(y, x, strict=True)]
    found = rings.outlines(mask)
    assert sum(map(rings.area, found)) == mask.sum()
    assert sum(rings.area(r) > 0 for r in found) == number


def square(*boxes, size=10):
    mask = np.zeros((size, size), bool)
    for y0, y1, x0, x1, value in boxes:
        mask[y0:y1, x0:x1] = value
    return mask


def area(polygons):
    return sum(rings.area(r) for p in polygons for r in p)


def test_outlines_of_known_shapes():
    assert area(rings.polygons(square((0, 10, 0, 10, 1)), False)) == 100
    two = rings.polygons(square((0, 4, 0, 4, 1), (5, 9, 5, 9, 1)), False)
    assert len(two) == 2 and area(two) == 32
    hole = square((2, 8, 2, 8, 1), (4, 6, 4, 6, 0))
    assert area(rings.polygons(hole, True)) == 32
    assert area(rings.polygons(hole, False)) == 36
    assert rings.wkt(np.zeros((3, 3), bool)) is None
    assert rings.wkt(square((0, 1, 0, 1, 1))).startswith("POLYGON ((")
    island = square((1, 9, 1, 9, 1), (2, 8, 2, 8, 0), (4, 5, 4, 5, 1))
    assert len(rings.polygons(island, True)) == 2 and len(rings.polygons(island, False)) == 1
    assert len(rings.simplified([[(0, 0), (1, 0.001), (2, 0), (2, 2), (0, 2)]], 0.1)[0]) == 4


def crossing(a, b, c, d):
    """Whether two segments meet in more than a common end."""
    turn = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    within = lambda p, q, r: min(p[0], q[0]) <= r[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= r[1] <= max(p[1], q[1])
    t = turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)
    if t[0] * t[1] < 0 and t[2] * t[3] < 0:
        return True
    touching = [(p, q, r) for (p, q, r), u in zip(((a, b, c), (a, b, d), (c, d, a), (c, d, b)), t, strict=True) if u == 0 and within(p, q, r)]
    return any(r not in (p, q) for p, q, r in touching)


def segments(found):
    return [(r[k], r[(k + 1) % len(r)]) for r in found for k in range(len(r))]


@settings(max_examples=120, deadline=None)
@given(arrays(bool, (9, 11), elements=st.sampled_from([True, True, False])), st.sampled_from([0.3, 0.75, 1.0, 1.5, 2.5, 6.0, 50.0]), st.booleans())
def test_simplified_outlines_never_cross(mask, tolerance, keep_holes):
    found = rings.polygons(mask, keep_holes)
    flat = [r for p in found for r in p]
    thin = rings.simplified(flat, tolerance)
    assert [len(r) for r in flat] == [len(r) for r in rings.simplified(flat, 0.0)]
    for ring, less in zip(flat, thin, strict=True):
        assert len(less) >= 3 and set(less) <= set(ring) and [c for c in ring if c in set(less)] == less
        assert rings.area(less) * rings.area(ring) > 0
        for c in ring:  # every corner is near what is left
            near = min(math.dist(c, (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))) for a, b in segments([less]) for t in [min(1, max(0, ((c[0] - a[0]) * (b[0] - a[0]) + (c[1] - a[1]) * (b[1] - a[1])) / (math.dist(a, b) ** 2 or 1)))])
            assert near <= tolerance + 1e-9
    lines = segments(thin)
    assert not [(x, y) for x, y in itertools.combinations(lines, 2) if crossing(*x, *y)]
    assert not any(x == y or x == y[::-1] for x, y in itertools.combinations(lines, 2))
    # holes stay in their polygon and outside the others', islands stay apart
    at = iter(thin)
    again = [[next(at) for _ in p] for p in found]
    middle = lambda r: (sum(c[0] for c in r[:3]) / 3, sum(c[1] for c in r[:3]) / 3)
    for polygon in again:
        for hole in polygon[1:]:
            if len(hole) == 3:
                assert rings.holds(polygon[0], middle(hole))


def test_simplification_keeps_what_lies_beside_it():
    rough = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 6), (2, 5), (0, 4)]
    island = [(0.4, 4.9), (0.4, 5.1), (0.6, 5.0)]
    assert len(rings.simplified([rough], 2.5)[0]) == 4  # the notch goes
    assert len(rings.simplified([rough, island], 2.5)[0]) == 5  # but not over an island that lies in it
    stairs = square(*[(k, k + 1, 0, k + 1, 1) for k in range(10)])
    assert len(rings.simplified([r for p in rings.polygons(stairs, False) for r in p], 1.0)[0]) == 3
    text = rings.wkt(stairs, lambda x, y: (100 + x / 1000, 50 - y / 1000), 1e-3)
    assert text.count(",") == 3 and len(rings.wkt(stairs, lambda x, y: (100 + x / 1000, 50 - y / 1000), 1e-5).split(",")) > 20


@pytest.mark.parametrize("planted", [0.0, 0.4, 2.5])
def test_fit_finds_a_planted_concentration(planted):
    centre = np.linspace(2100, 2440, 46)
    response, standard = [np.ones(10)] * 46, [np.full(10, 0.9)] * 46
    extra = [np.full(10, 1 - 0.2 * abs(math.sin(k))) for k in range(46)]
    gas = fit.transmittance_of(response, standard, extra)(2.0)
    assert np.allclose(gas(planted), [np.sum(r * t**2.0 * q ** (2.0 * planted)) / np.sum(r * t**2.0) for r, t, q in zip(response, standard, extra, strict=True)])
    ragged = fit.transmittance_of([np.ones(2), np.ones(1)], [np.array([0.9, 0.8]), np.array([0.7])], [np.array([0.5, 0.25]), np.array([0.1])])(1.0)
    assert np.allclose(ragged(1.0), [(0.9 * 0.5 + 0.8 * 0.25) / 1.7, 0.1])
    x = (centre - centre.mean()) / centre.std()
    seen = (1 + 0.1 * x - 0.05 * x**2) * gas(planted)
    conc, coefficients = fit.fitted(centre, seen, gas)
    assert abs(conc - planted) < 1e-4
    base = np.vander(x, 7, increasing=True) @ coefficients
    assert np.allclose(base * gas(conc), seen, atol=1e-5)
    assert fit.fitted(centre, np.full(46, np.nan), gas) is None


def test_mean_shift_separates_groups():
    rng = np.random.default_rng(1)
    points = np.vstack([rng.normal(c, 1, (20, 2)) for c in ((0, 0), (30, 0), (0, 40))])
    labels = mean_shift(points, 8.0)
    assert [len(set(labels[k : k + 20])) for k in (0, 20, 40)] == [1, 1, 1] and len(set(labels)) == 3
    assert len(mean_shift(np.empty((0, 2)))) == 0
    assert len(set(mean_shift(points))) >= 1


def test_many_spectra_are_fitted_together():
    """Rows of one call do not touch each other, paths differ, one row is not finite."""
    rng = np.random.default_rng(5)
    centre = np.linspace(2100, 2440, 46)
    gases = fit.Transmittances([np.ones(3)] * 46, [np.full(3, 0.9)] * 46, [np.full(3, 1 - 0.2 * abs(math.sin(k))) for k in range(46)])
    planted, path = rng.uniform(0, 2.5, 3000), rng.uniform(2, 3, 3000)
    planted[:100] = 0.0
    x = (centre - centre.mean()) / centre.std()
    baseline = 1 + rng.uniform(-0.1, 0.1, (3000, 1)) * x - 0.05 * x**2
    seen = baseline * gases.along(path)(planted)[0]
    seen[7, 3] = np.nan
    conc, coefficients = fit.fitted_many(centre, seen, gases.along(path))
    assert np.isnan(conc[7]) and np.isnan(coefficients[7]).all()
    others = np.arange(3000) != 7
    assert np.abs(conc - planted)[others].max() < 1e-4
    assert np.allclose(coefficients[others] @ np.vander(x, 7, increasing=True).T, baseline[others], atol=1e-5)
    noisy = seen[100:104] + rng.normal(0, 0.01, (4, 46))
    together = fit.fitted_many(centre, noisy, gases.along(path[100:104]))[0]
    alone = [fit.fitted_many(centre, noisy[k : k + 1], gases.along(path[100 + k : 101 + k]))[0][0] for k in range(4)]
    assert np.allclose(together, alone, rtol=1e-6)
