"""Media columns: GIF encoding, decoding and features.

``encode`` writes 8-bit samples as an animated GIF89a with compressed LZW streams;
``composed`` reads any GIF frame by frame: it decodes the LZW code streams, undoes
interlacing, and composes timed frames by the palettes, the disposal and the
transparency rules.  ``frames`` turns a column of GIFs into one row per frame with
its time and a colour histogram.

LZW.  The width of a code follows from its number since the last clear code alone, so
widths are a table and codes are packed and unpacked by array operations.  The encoder
looks up (prefix, sample) in a dictionary; the decoder keeps no dictionary at all: the
entry that code number m has made is the output from where m began to one sample beyond
where it ended, so every code is a copy of earlier output.

The query stores the media column in the shared folder and computes the features from
what is read back; memory is a batch of GIFs and one frame.

Edge cases: null and empty inputs are encoded as one frame of 64 zero samples;
a file that is no GIF, or is cut short, raises ValueError in ``decode`` and
ends with a row of an error in ``frames``; equal inputs give equal
bytes; a null doc_id keeps its row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bound_arrow, table, text_buffer, written

WIDTH, ROWS = 64, 4096
DELAY = 10  # hundredths of a second a frame
_I = np.arange(256)
#: Red is the sample itself, so the palette loses nothing.
PALETTE = np.stack([_I, (_I * 37) & 255, 255 - _I], axis=1).astype(np.uint8)


@dataclass
class Frame:
    start_ms: int
    duration_ms: int
    left: int
    top: int
    samples: np.ndarray  # palette indices of the frame's own rectangle
    palette: np.ndarray
    canvas: np.ndarray  # height x width x 4: what is shown, RGBA; of ``composed``, until the next frame


# ------------------------------------------------------------------------ LZW


@lru_cache(maxsize=16)
def _places(bits: int) -> np.ndarray:
    """At which bit each code after a clear code begins (a table holds 4,096 entries, so
    beyond these all are 12 bits wide)."""
    held = (1 << bits) + 2 + np.maximum(np.arange(4200) - 1, 0)
    widths = np.clip(np.floor(np.log2(held)).astype(np.int64) + 1, bits + 1, 12)
    return np.concatenate([[0], np.cumsum(widths)])


def _at(bits: int, n: int) -> np.ndarray:
    """The places of the first n codes, and where the next one begins."""
    known = _places(bits)
    if n < len(known):
        return known[: n + 1]
    return np.concatenate([known, known[-1] + 12 * np.arange(1, n + 2 - len(known))])


def _lzw(samples: np.ndarray, bits: int) -> bytes:
    """Compressed codes of palette indices below 2 ** bits."""
    clear = 1 << bits
    codes, starts = [clear], [0]  # starts: where a table begins
    add, known, following = codes.append, {}, clear + 2
    get = known.get
    data = iter(samples.tolist())
    prefix = next(data, None)
    for x in data:
        key = prefix << 8 | x
        code = get(key)
        if code is None:
            add(prefix)
            if following < 4096:
                known[key] = following
                following += 1
            else:
                add(clear)
                starts.append(len(codes))
                known.clear()
                following = clear + 2
            prefix = x
        else:
            prefix = code
    if prefix is not None:
        add(prefix)
    add(clear + 1)
    # the first clear code is alone, any later one closes its table's run
    starts[0] = 1
    ends = [*starts[1:], len(codes)]
    at, base = np.empty(len(codes) + 1, np.int64), bits + 1
    at[0] = 0
    for i, j in zip(starts, ends, strict=True):
        places = base + _at(bits, j - i)
        at[i : j + 1] = places
        base = int(places[-1])
    value = np.array(codes, np.uint32) << (at[:-1] & 7).astype(np.uint32)
    byte = at[:-1] >> 3
    out = np.zeros((base + 7) // 8 + 3, np.uint8)
    # bits that share a byte differ, so their sum is their union
    for shift in (0, 8, 16):
        part = (value >> np.uint32(shift)) & np.uint32(255)
        out += np.bincount(byte + shift // 8, part, len(out)).astype(np.uint8)
    return out[: (base + 7) // 8].tobytes()


def _unlzw(stream: bytes, bits: int, n: int) -> np.ndarray:
    """The n samples of a stream of codes."""
    clear = 1 << bits
    raw = np.zeros(len(stream) + 4, np.uint32)
    raw[: len(stream)] = np.frombuffer(stream, np.uint8)
    out, base, total = bytearray(), 0, 8 * len(stream)
    take = 64
    while len(out) < n:
        # the codes up to the next clear or end code, more at a time while there is none
        took = max(0, min(take, 1 + (total - base) // (bits + 1)))
        at = base + _at(bits, took)
        took = int(np.searchsorted(at, total, "right")) - 1
        if took <= 0:
            raise ValueError("the image data end early")
        o = at[:took]
        b, width = o >> 3, (at[1 : took + 1] - o).astype(np.uint32)
        codes = ((raw[b] | raw[b + 1] << np.uint32(8) | raw[b + 2] << np.uint32(16)) >> (o & 7).astype(np.uint32)) & ((np.uint32(1) << width) - np.uint32(1))
        special = np.flatnonzero((codes == clear) | (codes == clear + 1))
        if not len(special) and at[took] + 12 <= total and took >= take:
            take *= 4
            continue
        last = int(special[0]) if len(special) else took
        entry = codes[:last].astype(np.int64) - clear - 2
        # a code can only mean an entry that is made by then, or is just being made
        wrong = np.flatnonzero((entry >= np.minimum(np.arange(last), 4094 - clear)) | ((entry < 0) & (codes[:last] >= clear)))
        _copy(entry[: wrong[0] if len(wrong) else last].tolist(), clear + 2, out, n)
        if len(out) >= n:
            break
        if len(wrong):
            raise ValueError("the image data are damaged")
        if not len(special) or codes[last] == clear + 1:
            raise ValueError("the image data end early")
        base, take = int(at[last + 1]), 4096
    return np.frombuffer(bytes(out[:n]), np.uint8)


def _copy(entries: list[int], literals: int, out: bytearray, n: int) -> None:
    """Append what the codes of one table stand for; codes below the table's entries are
    negative here."""
    p = len(out)
    pos: list[int] = []
    begins, append = pos.append, out.append
    for m in entries:
        begins(p)
        if m < 0:
            append(m + literals)
            p += 1
            continue
        a, e = pos[m], pos[m + 1] + 1
        if e <= p:
            out += out[a:e]
        else:  # the entry ends with the sample that it begins with here
            out += out[a:p]
            append(out[a])
        p += e - a
        if p >= n:
            return


# -------------------------------------------------------------------- writing


def _blocks(stream: bytes) -> bytes:
    whole = len(stream) // 255
    a = np.empty((whole, 256), np.uint8)
    a[:, 0] = 255
    a[:, 1:] = np.frombuffer(stream, np.uint8, whole * 255).reshape(whole, 255)
    rest = stream[whole * 255 :]
    return a.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def encode(payload: bytes) -> bytes:
    """A GIF whose samples, 64 in a row, are the payload's bytes; the payload must
    be a positive multiple of 64 bytes long."""
    if not payload or len(payload) % WIDTH:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    samples = np.frombuffer(payload, np.uint8)
    rows = len(samples) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, ROWS), 0xF7, 0, 0), PALETTE.tobytes()]
    for at in range(0, rows, ROWS):
        own = samples[at * WIDTH : (at + ROWS) * WIDTH]
        out.append(b"\x21\xf9\x04\x04" + struct.pack("<H", DELAY) + b"\0\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(own) // WIDTH, 0) + b"\x08")
        out.append(_blocks(_lzw(own, 8)))
    out.append(b"\x3b")
    return b"".join(out)


# -------------------------------------------------------------------- reading


def _read_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(data):
            raise ValueError("a block ends early")
        n = data[at]
        if n == 0:
            return b"".join(parts), at + 1
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n


def decode(data: bytes) -> list[Frame]:
    """All frames of a GIF, composed."""
    return [replace(f, canvas=f.canvas.copy()) for f in composed(data)]


def composed(data: bytes) -> Iterator[Frame]:
    """The frames of a GIF one by one."""
    try:
        yield from _composed(data)
    except (IndexError, struct.error) as e:
        raise ValueError("the GIF is cut short or damaged") from e


def _composed(data: bytes) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, shared = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared = np.frombuffer(data, np.uint8, n * 3, at).reshape(n, 3)
        at += n * 3
    # a pixel is one number of four bytes: red, green, blue, and 255 where it is visible
    canvas = np.zeros((height, width), "<u4")
    clock = 0
    disposal, transparent, delay = 0, -1, 0
    while at < len(data):
        kind = data[at]
        if kind == 0x3B:
            return
        if kind == 0x21:
            label, (body, at) = data[at + 1], _read_blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = (body[0] >> 2) & 7, struct.unpack_from("<H", body, 1)[0]
                transparent = body[3] if body[0] & 1 else -1
            continue
        if kind != 0x2C:
            raise ValueError("an unknown block")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        palette = shared
        if flags & 0x80:
            n = 2 << (flags & 7)
            palette = np.frombuffer(data, np.uint8, n * 3, at).reshape(n, 3)
            at += n * 3
        if palette is None:
            raise ValueError("a frame has no palette")
        bits = data[at]
        if not 1 <= bits <= 8:
            raise ValueError("a code size out of range")
        stream, at = _read_blocks(data, at + 1)
        samples = _unlzw(stream, bits, w * h).reshape(h, w)
        if flags & 0x40:  # rows are stored in four passes
            rows = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            whole = np.empty_like(samples)
            whole[rows] = samples
            samples = whole
        before = canvas.copy() if disposal == 3 else None
        y, x = min(h, max(0, height - top)), min(w, max(0, width - left))
        area = canvas[top : top + y, left : left + x]
        shown = samples[:y, :x]
        if shown.size and int(shown.max()) >= len(palette):
            raise ValueError("a sample lies outside the palette")
        colours = np.full((len(palette), 4), 255, np.uint8)
        colours[:, :3] = palette
        colours = colours.view("<u4")[:, 0]
        if transparent >= 0:
            seen = shown != transparent
            area[seen] = colours[shown[seen]]
        else:
            area[...] = colours[shown]
        yield Frame(clock, delay * 10, left, top, samples, palette, canvas.view(np.uint8).reshape(height, width, 4))
        clock += delay * 10
        if disposal == 2:
            area[...] = 0
        elif disposal == 3:
            canvas = before
        disposal, transparent, delay = 0, -1, 0
    raise ValueError("the trailer is missing")


def histogram(rgba: np.ndarray) -> np.ndarray:
    """Counts of the 64 colours of two bits a channel, over visible pixels."""
    p = np.ascontiguousarray(rgba).view("<u4").ravel()
    key = (p >> 2) & 0x30 | (p >> 12) & 0x0C | (p >> 22) & 0x03
    if not (p >> 24).all():
        key = key[p >> 24 > 0]
    return np.bincount(key, minlength=64)


# ------------------------------------------------------------------ DataFrames


def payload_of(raw: bytes) -> bytes:
    return raw + b"\0" * (WIDTH - len(raw) % WIDTH if len(raw) % WIDTH or not raw else 0)


def _encode(batches):
    for batch in batches:
        data, off = text_buffer(batch.column("text"))
        raw = data.tobytes()
        media = [encode(payload_of(raw[a:b])) for a, b in zip(off[:-1], off[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(off)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def features(media: bytes) -> tuple[int, str, int, int, str, str]:
    """payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature
    (frames : milliseconds : colour histogram over all frames) of a GIF of ``encode``."""
    sha, size, tail, hist, count, until = hashlib.sha256(), 0, b"", np.zeros(64, np.int64), 0, 0
    for f in composed(media):
        own = f.palette[:, 0][f.samples].tobytes()
        sha.update(own)
        size, tail = size + len(own), (tail + own[-WIDTH:])[-WIDTH:]
        hist += histogram(f.canvas)
        count, until = count + 1, f.start_ms + f.duration_ms
    return size, sha.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), f"{count}:{until}:" + ",".join(f"{i}={n}" for i, n in enumerate(hist) if n)


def _features(batches):
    for batch in batches:
        rows = [features(media.as_buffer().to_pybytes()) for media in batch.column("media")]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", *names])


def to_gif(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of each row of docs (doc_id, text)."""
    bound_arrow(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


def gif_features(media: DataFrame) -> DataFrame:
    """Features of the stored bytes of (doc_id, n_bytes, media)."""
    return media.mapInArrow(_features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def _frames(batches):
    schema = pa.schema([("id", pa.int64()), ("frame", pa.int32()), ("start_ms", pa.int64()), ("duration_ms", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("rgba", pa.binary()), ("histogram", pa.list_(pa.int64())), ("error", pa.string())])
    one = lambda row: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema.types, strict=True)], schema=schema)
    for batch in batches:
        for key, media in zip(batch.column("id").to_pylist(), batch.column("media"), strict=True):
            try:
                for k, f in enumerate(composed(media.as_buffer().to_pybytes() if media.is_valid else b"")):
                    yield one((key, k, f.start_ms, f.duration_ms, f.canvas.shape[1], f.canvas.shape[0], f.canvas.tobytes(), histogram(f.canvas).tolist(), None))
            except ValueError as e:
                yield one((key, None, None, None, None, None, None, None, str(e)))


def frames(media: DataFrame, id_column: str = "doc_id", media_column: str = "media") -> DataFrame:
    """One row per frame of each GIF: its time, size, pixels and colour histogram.  A GIF
    that is damaged has a row with the error after those of its whole frames."""
    bound_arrow(media.sparkSession)
    return media.select(F.col(id_column).cast("long").alias("id"), F.col(media_column).alias("media")).mapInArrow(_frames, "id long, frame int, start_ms long, duration_ms long, width int, height int, rgba binary, histogram array<long>, error string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every text as a GIF, and the features of the bytes read back."""
    return gif_features(written(to_gif(table(spark, sf_dir, "documents")), "media"))
