"""Shared plumbing: reading tables, cutting lineage, and vectorised text work.

Text kernels read Arrow string buffers as bytes.  All separators are ASCII, so
splitting UTF-8 bytes gives the same words as splitting code points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import materialised as written  # noqa: F401
from tessera.session import new_path as scratch  # noqa: F401
from tessera.session import read as table  # noqa: F401

#: A word of every contract that counts words.
WORD = r"[^\x20\x09-\x0D]+"


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bound_arrow(spark: SparkSession) -> None:
    """Bound what a Python worker gets at once, by rows and, where known, by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


# ---------------------------------------------------------------- text kernels

_RNG = np.random.default_rng(20240607)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_TABLE = (_RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[_LOWER]
_R = np.uint64(0x9E3779B97F4A7C15)
_RINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Bytes that are worked on at once, whatever the length of a text or of a run.
_PIECE = 1 << 18
_powers: dict[int, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Letters, digits and all bytes of non-ASCII characters form a term; the rest separates.
NOT_TERM = np.ones(256, bool)
NOT_TERM[48:58] = NOT_TERM[65:91] = NOT_TERM[97:123] = NOT_TERM[128:] = False


def _pow(base: np.uint64, n: int) -> np.ndarray:
    """The first powers of base, n at least; n is two pieces at most."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        a = np.full(max(n, 2 * _PIECE), base, np.uint64)
        a[0] = 1
        have = _powers[int(base)] = np.cumprod(a, dtype=np.uint64)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array without nulls, and its n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def spans(data: np.ndarray, off: np.ndarray, separates: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that do not separate, within
    each text; and for each text the index of its first run (n + 1 numbers)."""
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    filled = off[:-1] < off[1:]
    opens, closes = off[:-1][filled], off[1:][filled] - 1
    for lo in range(0, len(data), 4 * _PIECE):
        hi = min(len(data), lo + 4 * _PIECE)
        run = ~separates[data[lo:hi]]
        edge = np.ones(hi - lo, bool)
        edge[1:] = ~run[:-1]
        edge[0] = lo == 0 or separates[data[lo - 1]]
        edge[opens[np.searchsorted(opens, lo) : np.searchsorted(opens, hi)] - lo] = True
        starts.append(np.flatnonzero(run & edge) + lo)
        edge[:-1] = ~run[1:]
        edge[-1] = hi == len(data) or separates[data[hi]]
        edge[closes[np.searchsorted(closes, lo) : np.searchsorted(closes, hi)] - lo] = True
        ends.append(np.flatnonzero(run & edge) + lo + 1)
    begun = np.concatenate(starts)
    return begun, np.concatenate(ends), np.searchsorted(begun, off)


def _hash_long(data: np.ndarray, start: int, end: int) -> np.uint64:
    """The hash of one run before mixing: pieces, each times its place's power."""
    total, power, step = 0, 1, pow(int(_R), _PIECE, 1 << 64)
    for lo in range(start, end, _PIECE):
        own = _TABLE[data[lo : min(end, lo + _PIECE)]]
        total += int((own * _pow(_R, len(own))[: len(own)]).sum(dtype=np.uint64)) * power
        power = power * step % (1 << 64)
    return np.uint64(total % (1 << 64))


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes, upper-case ASCII read as lower-case.
    ``starts`` rise.  Memory is some pieces beside the result, also for long runs."""
    out = np.empty(len(starts), np.uint64)
    far = ends - starts > _PIECE
    for k in np.flatnonzero(far):
        out[k] = _hash_long(data, int(starts[k]), int(ends[k]))
    near = np.flatnonzero(~far)
    if len(near) == len(starts):
        begin, stop, dealt = starts, ends, out
    else:
        begin, stop, dealt = starts[near], ends[near], np.empty(len(near), np.uint64)
    i = 0
    while i < len(begin):
        lo = int(begin[i])
        j = int(np.searchsorted(begin, lo + _PIECE))
        hi = int(stop[i:j].max())
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_TABLE[data[lo:hi]] * _pow(_R, hi - lo)[: hi - lo], out=sums[1:])
        dealt[i:j] = (sums[stop[i:j] - lo] - sums[begin[i:j] - lo]) * _pow(_RINV, hi - lo)[begin[i:j] - lo]
        i = j
    if dealt is not out:
        out[near] = dealt
    return mix(out)


def counted(data: np.ndarray, flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flagged bytes come before each of the rising places ``at``."""
    out, before = np.empty(len(at), np.int64), 0
    for lo in range(0, len(data) + 1, _PIECE):
        i, j = np.searchsorted(at, [lo, lo + _PIECE])
        sums = np.concatenate([[0], np.cumsum(flags[data[lo : lo + _PIECE]], dtype=np.int64)])
        out[i:j] = before + sums[at[i:j] - lo]
        before += int(sums[-1])
    return out


def pieces(off: np.ndarray, most: int = 4 << 20):
    """Ranges of texts of about ``most`` bytes; a longer text is a range of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def list_array(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def n_words(text) -> F.Column:
    """Words in a text column, on the JVM; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
