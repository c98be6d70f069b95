"""Components of a mask: many blocks are labelled in one call, wherever batches end."""

import numpy as np
import pytest

from tessera.operators import raster


def by_steps(cells):
    """{cell: smallest code of its 8-connected patch} by walking."""
    out, left = {}, set(cells)
    while left:
        todo = [left.pop()]
        patch = list(todo)
        while todo:
            r, c = todo.pop()
            near = {(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            todo += near
            patch += near
        out |= dict.fromkeys(patch, min(r * (1 << 31) + c for r, c in patch))
    return out


def drawn(share, seed):
    r, c = np.nonzero(np.random.default_rng(seed).random((90, 50)) < share)
    return r, c


@pytest.mark.parametrize("share", [0.05, 0.4, 0.9])
def test_blocks_are_labelled_together(share):
    r, c = drawn(share, 1)
    _, group = np.unique((r // 16) * 10 + c // 16, return_inverse=True)
    want = {}
    for g in set(group.tolist()):
        want |= by_steps(zip(r[group == g].tolist(), c[group == g].tolist(), strict=True))
    got = raster.block_labels(group, r, c, 16)
    assert got.tolist() == [want[x] for x in zip(r.tolist(), c.tolist(), strict=True)]


def test_components_equal_those_of_walks(spark):
    """A batch ends inside blocks; two tiles and a repeated cell."""
    rows, want = [], {}
    for tile, share in (("a", 0.4), ("b", 0.45)):
        cells = [(int(r), int(c)) for r, c in zip(*drawn(share, ord(tile)), strict=True)]
        rows += [(tile, *x) for x in [*cells, cells[0]]]
        want |= {(tile, *x): k for x, k in by_steps(cells).items()}
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        out = raster.components(spark.createDataFrame(rows, "tile_id string, row long, col long"), ["tile_id"], 16).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert len(out) == len(rows) and {(x.tile_id, x.row, x.col): x.component for x in out} == want
