"""Vectorised helpers over Arrow text batches: row runs, word and line spans, span hashes.

All work is on UTF-8 bytes. Bytes from 0x80 on belong to characters beyond ASCII, so classes and lower-casing that only name
ASCII characters can be decided byte by byte.
"""
import ctypes
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa

RUN_BYTES = 1 << 19
BATCH_ROWS = 1000

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def text_batches(df):
    """df, in a session that hands at most BATCH_ROWS rows at once to Python: texts are large rows, and both sides hold whole batches."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def freeing(work):
    """work for mapInArrow; after a task the worker, which Spark keeps, hands unused memory back to the machine."""
    def run(batches):
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return run


def byte_class(*ranges) -> np.ndarray:
    """Boolean table of 256 entries, true inside the inclusive ranges."""
    table = np.zeros(256, bool)
    for a, b in ranges:
        table[a:b + 1] = True
    return table


SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))


def text_array(column: pa.Array) -> pa.Array:
    """The column as an Arrow string array without nulls (null reads as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type not in (pa.string(), pa.large_string()):
        column = column.cast(pa.string())
    return column.fill_null("") if column.null_count else column


def runs(column: pa.Array, limit: int = RUN_BYTES):
    """Yield (first row, row count, bytes, offsets) for runs of whole rows of about limit bytes; a longer row is a run of its own."""
    column = text_array(column)
    width = np.int64 if column.type == pa.large_string() else np.int32
    n = len(column)
    if n == 0:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, width)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        last = min(last, n)
        yield row, last - row, raw[offsets[row]:offsets[last]], offsets[row:last + 1] - offsets[row]
        row = last


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
    """(starts, ends, row of each) of the maximal runs of bytes in the table; words never cross rows."""
    if len(data) == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = table[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    heads = offsets[:-1]
    before[heads[heads < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    tails = offsets[1:] - 1
    after[tails[tails >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def line_spans(data: np.ndarray, offsets: np.ndarray):
    """(starts, ends, row of each) of the lines of every row; a row with k newlines has k + 1 lines."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    per_row = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1
    return starts, ends, np.repeat(np.arange(len(offsets) - 1), per_row)


def strip_spans(data, starts, ends, space=SPACE):
    """The spans without leading and trailing bytes of the table; a span of nothing else becomes empty."""
    solid = np.flatnonzero(~space[data])
    if len(solid) == 0:
        return starts, starts
    first, last = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = last > first
    return (np.where(some, solid[np.minimum(first, len(solid) - 1)], starts),
            np.where(some, solid[np.maximum(last - 1, 0)] + 1, starts))


def code_points(data, starts, ends):
    """Number of code points in each span."""
    total = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return total[ends] - total[starts]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits."""
    x = x ^ (x >> _S)
    x = x * _M1
    x = x ^ (x >> _S)
    x = x * _M2
    return x ^ (x >> _S)


@lru_cache(maxsize=4)
def _byte_values(seed: int, lower: bool) -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(2 * seed + 0x9E3779B97F4A7C15))
    if lower:
        table = table.copy()
        table[65:91] = table[97:123]
    return table


class _Powers:
    """Powers of an odd number modulo 2^64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(0, np.uint64), np.ones(0, np.uint64)

    def upto(self, n: int):
        if len(self.up) < n:
            n = max(n, RUN_BYTES)
            for name, b in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                p = np.full(n, np.uint64(b))
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up, self.down


_POWERS = {0: _Powers(0x9E3779B97F4A7C15), 1: _Powers(0xD1342543DE82EF95)}


def span_hashes(data, starts, ends, seed: int = 0, lower: bool = True) -> np.ndarray:
    """64-bit hash of each span's bytes (A-Z as a-z when lower); seed 0 or 1 gives independent hashes."""
    up, down = _POWERS[seed].upto(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_values(seed, lower)[data] * up[:len(data)], out=total[1:])
    value = (total[ends] - total[starts]) * down[starts]
    return mix(value + (ends - starts).astype(np.uint64) * _M2)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes (length len(words) - k + 1, empty if fewer)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, m = np.full(n, np.uint64(k)), 0x2545F4914F6CDD1D
    factor = 1
    for j in range(k):
        factor = factor * m % (1 << 64)
        out = out + words[j:j + n] * np.uint64(factor)
    return mix(out)


def pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers by byte plane, compressed."""
    return zlib.compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(packed: bytes) -> np.ndarray:
    """Inverse of pack."""
    planes = np.frombuffer(zlib.decompress(packed), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def batch_rows(batch, *names):
    """Columns of a record batch by name."""
    return [batch.column(batch.schema.get_field_index(n)) for n in names]
