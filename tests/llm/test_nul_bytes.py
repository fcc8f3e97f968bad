"""Texts with runs of NUL bytes: padding of short rows doesn't part equal long ones."""

import numpy as np

from sonoframe.llm import suffix_dedup


def test_a_short_row_does_not_part_equal_long_ones():
    parts = [b"x" * 50 + b"\0" * 50, b"x" * 50, b"x" * 50 + b"\0" * 50, b"x" * 50 + b"\0" * 20, b"x" * 50 + b"\0" * 49 + b"y"]
    order, common = suffix_dedup.prefix_names(suffix_dedup.padded_rows(parts, 100), np.array([len(p) for p in parts]))
    assert order.tolist() == [1, 3, 0, 2, 4]
    assert common.tolist() == [-1, 50, 70, 100, 99]
