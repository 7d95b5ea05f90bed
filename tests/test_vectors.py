from __future__ import annotations

from belltower.operators import vectors


def test_a_cell_of_the_vector_grid_is_small():
    """Rows of 1,024 numbers, with a copy at length one, and likenesses of all queries to a part: under half a gigabyte."""
    held = 2 * vectors.SHARD * 1024 * 8 + 2 * vectors.BLOCK * vectors.PART * 8
    assert held < 500e6
