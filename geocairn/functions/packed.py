"""Lines packed into bytes: steps in units of 1e-7 degrees, zigzag-coded, as variable-length numbers; whole columns at a time.

Bytes of a line: for each vertex the step in longitude, then in latitude, from the vertex before it (the first from 0, 0), 7 bits a byte, low bits first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .kernels import LINE

SCALE = 1e7


def pack(lng: np.ndarray, lat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of lines that stand one after the other, so many vertices each, and how many bytes each line has."""
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    whole = np.rint(np.stack([lng, lat], axis=1) * SCALE).astype(np.int64)
    steps = np.diff(whole, axis=0, prepend=0)
    steps[starts] = whole[starts]
    steps = steps.astype(np.int32)  # a step of more than half the range goes round
    coded = ((steps << 1) ^ (steps >> 31)).view(np.uint32).ravel()
    width = np.maximum(1, (np.frexp(coded.astype(np.float64))[1] + 6) // 7)
    ends = np.cumsum(width)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(5):
        at = np.flatnonzero(width > k)
        out[ends[at] - width[at] + k] = (coded[at] >> np.uint32(7 * k) & 127) | np.where(width[at] > k + 1, 128, 0)
    before = np.concatenate([[0], ends])
    last = 2 * np.cumsum(sizes)
    return out, before[last] - before[last - 2 * sizes]


def unpack(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longitudes, latitudes and numbers of vertices of lines whose bytes stand one after the other; what is cut off within a vertex is left out."""
    ends = np.flatnonzero(data < 128)
    bounds = np.cumsum(lengths)
    line = np.searchsorted(bounds, ends, "right")
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    starts = np.maximum(starts, (bounds - lengths)[line])
    width = ends - starts + 1
    place = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
    bits = (data[np.repeat(starts, width) + place].astype(np.uint64) & np.uint64(127)) << (7 * np.minimum(place, 9)).astype(np.uint64)
    values = (np.add.reduceat(bits, np.cumsum(width) - width) if len(width) else bits).astype(np.uint32)
    steps = (values >> np.uint32(1)).astype(np.int32) ^ -(values & np.uint32(1)).astype(np.int32)
    numbers = np.bincount(line, minlength=len(lengths))
    first = np.cumsum(numbers) - numbers
    nth = np.arange(len(steps)) - first[line]
    whole = nth < (numbers // 2 * 2)[line]
    steps, line, nth = steps[whole].astype(np.int64), line[whole], nth[whole]
    pairs, of = steps.reshape(-1, 2), line[::2]
    sums = np.cumsum(pairs, axis=0)
    counts = numbers // 2
    start = (np.cumsum(counts) - counts)[of]
    sums = (sums - np.where((start > 0)[:, None], sums[start - 1], 0)).astype(np.int32)
    return sums[:, 0] / SCALE, sums[:, 1] / SCALE, counts


@F.arrow_udf(BinaryType())
def pack_line(line: pa.Array) -> pa.Array:
    """A line's bytes; null for null."""
    sizes = np.asarray(line.value_lengths().fill_null(0), np.int64)
    flat = line.flatten()
    data, lengths = pack(flat.field("lng").to_numpy(zero_copy_only=False), flat.field("lat").to_numpy(zero_copy_only=False), sizes)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    out = pa.Array.from_buffers(pa.binary(), len(line), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return pa.array(out.to_pylist(), pa.binary(), mask=np.asarray(line.is_null())) if line.null_count else out


@F.arrow_udf(LINE)
def unpack_line(packed: pa.Array) -> pa.Array:
    """The line of the bytes; null for null."""
    lengths = np.array([0 if x is None else len(x) for x in packed.to_pylist()], np.int64)
    data = np.frombuffer(b"".join(x for x in packed.to_pylist() if x is not None), np.uint8)
    lng, lat, counts = unpack(data, lengths)
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    points = pa.StructArray.from_arrays([pa.array(lng), pa.array(lat)], names=["lng", "lat"])
    out = pa.ListArray.from_arrays(offsets, points, mask=packed.is_null()) if packed.null_count else pa.ListArray.from_arrays(offsets, points)
    return out
