"""Filters and labels that work tile by tile, with tiles far smaller than the grid."""

import numpy as np
import pytest

from arraymill.operators import filters, images
from arraymill.operators.filters import Boundary
from arraymill.operators.grid import Grid

V = np.random.default_rng(5).integers(0, 50, (23, 31)).astype(float)


def dense(x):
    out = np.full(x.shape, np.nan)
    rows = x.df.toPandas()
    assert len(rows) == x.size
    out[rows["row"], rows["col"]] = rows["value"]
    return out


def windows(v, size, rule, constant, deep):
    half = size // 2
    wide = np.pad(v, ((half if deep else 0,) * 2, (half,) * 2), filters.PADS[rule], **({"constant_values": constant} if rule is Boundary.CONSTANT else {}))
    return np.lib.stride_tricks.sliding_window_view(wide, (size if deep else 1, size))


@pytest.mark.parametrize("rule", list(Boundary))
@pytest.mark.parametrize("tile", [8, 4096])
@pytest.mark.parametrize("deep", [True, False])
def test_sliding_order_statistics(spark, rule, tile, deep):
    x, near = Grid.local(spark, V.tolist()), windows(V, 5, rule, 9.0, deep)
    for f, want in ((filters.ranked_value(0.5), np.median), (filters.ranked_value(0.3), lambda w, axis: np.percentile(w, 30, axis=axis)), (filters.ranked_value(rank=1), lambda w, axis: np.sort(w.reshape(*w.shape[:2], -1), axis=2)[..., 1])):
        got = dense(filters.sliding(x, 5, f, rule, 9.0, two_dimensional=deep, tile=tile))
        np.testing.assert_allclose(got, want(near, axis=(2, 3)), rtol=1e-12)


def test_kernels_wider_than_the_grid_and_lines(spark):
    small = V[:3, :4]
    for rule in (Boundary.NEAREST, Boundary.CONSTANT, Boundary.REFLECT, Boundary.WRAP):
        got = dense(filters.median_filter(Grid.local(spark, small.tolist()), 9, rule=rule, constant=2.0))
        np.testing.assert_allclose(got, np.median(windows(small, 9, rule, 2.0, True), axis=(2, 3)))
    line = V.reshape(1, -1)
    got = filters.sliding(Grid.local(spark, line.tolist()), 7, filters.ranked_value(0.5), Boundary.WRAP, tile=16)
    np.testing.assert_allclose(dense(got), np.median(windows(line, 7, Boundary.WRAP, 0, False), axis=(2, 3)))
    holes = line.copy()
    holes[0, 5] = np.nan
    got = dense(filters.rank_filter(Grid.local(spark, holes.tolist()), 3, 2))
    assert np.isnan(got[0, 4:7]).all() and not np.isnan(got[0, 7:]).any()
    with pytest.raises(ValueError, match="rank"):
        filters.rank_filter(Grid.local(spark, line.tolist()), 3, 3)


def plain_labels(mask):
    label, out = 0, {}
    for r, c in zip(*np.nonzero(mask), strict=True):
        if (r, c) in out:
            continue
        stack = [(r, c)]
        while stack:
            at = stack.pop()
            if at in out or not (0 <= at[0] < mask.shape[0] and 0 <= at[1] < mask.shape[1]) or not mask[at]:
                continue
            out[at] = label
            stack += [(at[0] + a, at[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        label += 1
    return out


@pytest.mark.parametrize("tile", [4, 7, 512])
def test_labels_across_tiles(spark, tile):
    spiral = np.zeros((19, 19))
    r, c, dr, dc, steps = 0, 0, 0, 1, 18
    spiral[0, 0] = 1
    for turn in range(16):
        for _ in range(steps):
            r, c = r + dr, c + dc
            spiral[r, c] = 1
        dr, dc, steps = dc, -dr, steps - 2 * (turn % 2 == 1 and turn > 0) if turn else steps
        if steps <= 0:
            break
    for mask in (V > 33, spiral > 0, np.ones((9, 9)) > 0, V > 99):
        x = Grid.local(spark, mask.astype(float).tolist())
        got = images.cluster_pixels(x, images.apply_threshold(x, 0.5), tile=tile).collect()
        assert {(r["row"], r["col"]): r["cluster"] for r in got} == plain_labels(mask)
