"""Arrow functions that turn only a few rows of a batch into Python values at a time."""

from __future__ import annotations

import contextlib
import ctypes
import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType


def slices(sizes: list[int], rows: int, weight: int) -> Iterator[tuple[int, int]]:
    """Start and length of runs of at most ``rows`` rows and, but for single rows, at most ``weight`` in all."""
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and (i - start == rows or held + size > weight):
            yield start, i - start
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes) - start


def _sizes(column: pa.Array) -> list[int]:
    """Tokens or bytes of each value of a list or string column; 0 for others and null."""
    kind = column.type
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        sizes = pc.list_value_length(column)
    elif pa.types.is_string(kind) or pa.types.is_large_string(kind):
        sizes = pc.binary_length(column)
    else:
        return [0] * len(column)
    return [x or 0 for x in sizes.to_pylist()]


def values(column: pa.Array) -> list:
    """``column.to_pylist()``, which makes an object in between for every value, by whole arrays where it has lists or strings."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return column.to_numpy(zero_copy_only=False).tolist()
    if (pa.types.is_list(kind) or pa.types.is_large_list(kind)) and not column.null_count:
        flat, ends = values(column.flatten()), column.offsets.to_pylist()
        return [flat[a - ends[0] : b - ends[0]] for a, b in itertools.pairwise(ends)]
    return column.to_pylist()


def give_back() -> None:
    """Freed memory goes back to the system: a Python worker serves later tasks, too, and would keep the most that any took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def arrow_function(kernel: Callable[..., list], kind: DataType, rows: int = 500, weight: int = 1_000_000):
    """An Arrow function of ``kernel``, which takes lists of Python values, one for each argument, and returns one.

    A batch has up to 10,000 rows; of these at most ``rows`` rows, and rows with ``weight`` tokens or bytes
    in all, are Python values at a time.
    """
    out = to_arrow_type(kind)

    def run(*columns: pa.Array) -> pa.Array:
        sizes = [sum(x) for x in zip(*map(_sizes, columns))]
        parts = [pa.array(kernel(*[values(c.slice(a, n)) for c in columns]), out) for a, n in slices(sizes, rows, weight)]
        done = pa.concat_arrays(parts) if parts else pa.array([], out)
        del parts
        give_back()
        return done

    return arrow_udf(run, kind)
