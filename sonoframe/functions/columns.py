"""Arrow columns of Python values, for functions whose workers needn't load pandas; pa.array() loads it to see whether the values are its."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa


def binaries(values: Sequence[bytes | None]) -> pa.Array:
    ends = np.cumsum([0, *(len(x or b"") for x in values)])
    if ends[-1] > np.iinfo(np.int32).max:
        raise OverflowError("a batch of values over 2 GB")
    return pa.Array.from_buffers(pa.binary(), len(values), [present(values), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(b"".join(x for x in values if x))])


def strings(values: Sequence[str | None]) -> pa.Array:
    return binaries([None if x is None else x.encode() for x in values]).cast(pa.string())


def doubles(values: Sequence[float | None]) -> pa.Array:
    return pa.Array.from_buffers(pa.float64(), len(values), [present(values), pa.py_buffer(np.array([0.0 if x is None else x for x in values], np.float64))])


def lists(values: Sequence[np.ndarray]) -> pa.Array:
    """A list of doubles for each array."""
    ends, body = np.cumsum([0, *map(len, values)]).astype(np.int32), np.concatenate([np.zeros(0), *values])
    return pa.ListArray.from_arrays(pa.Array.from_buffers(pa.int32(), len(ends), [None, pa.py_buffer(ends)]), pa.Array.from_buffers(pa.float64(), len(body), [None, pa.py_buffer(body)]))


def present(values: Sequence) -> pa.Buffer:
    """Which of the values are there, in bits."""
    return pa.py_buffer(np.packbits(np.array([x is not None for x in values], bool), bitorder="little"))
