"""Media columns as ISO base media files (ISO/IEC 14496-12).

``wrap`` stores a payload as one uncompressed 8-bit mono track: samples of 64 bytes (64 PCM values of type
``raw ``), 256 samples to a chunk, every 32nd sample listed as a sync sample.  ``describe`` reads any such file by
walking its nested boxes and decoding the sample tables (stts, stsc, stsz, stco or co64, stss); it touches the
headers only, so the media data is never decoded.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

UNIT, PER_CHUNK, KEY_EVERY, RATE = 64, 256, 32, 8000
#: Boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, version: int, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
_FTYP = box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso2mp41")
_DREF = box(b"dinf", full(b"dref", 0, 0, struct.pack(">I", 1), full(b"url ", 0, 1)))
_STSD = full(b"stsd", 0, 0, struct.pack(">I", 1), box(b"raw ", bytes(6), struct.pack(">HIIHHHHI", 1, 0, 0, 1, 8, 0, 0, RATE << 16)))
_HDLR = full(b"hdlr", 0, 0, bytes(4), b"soun", bytes(12), b"samples\0")
_SMHD = full(b"smhd", 0, 0, bytes(4))


def padded(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of 64."""
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def wrap(payload: bytes) -> bytes:
    """An ISO media file that holds ``payload``, whose length is a positive multiple of 64."""
    n = len(payload) // UNIT
    chunks = -(-n // PER_CHUNK)
    last = n - (chunks - 1) * PER_CHUNK
    runs = [(1, PER_CHUNK)] if chunks > 1 else []
    if not runs or last != PER_CHUNK:
        runs.append((chunks, last))
    keys = range(1, n + 1, KEY_EVERY)
    ticks = n * UNIT

    def moov(first: int) -> bytes:
        far = first + len(payload) >= 1 << 32
        at = range(first, first + len(payload), PER_CHUNK * UNIT)
        stbl = box(
            b"stbl",
            _STSD,
            full(b"stts", 0, 0, struct.pack(">III", 1, n, UNIT)),
            full(b"stss", 0, 0, struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            full(b"stsc", 0, 0, struct.pack(">I", len(runs)), *(struct.pack(">III", c, k, 1) for c, k in runs)),
            full(b"stsz", 0, 0, struct.pack(">II", UNIT, n)),
            full(b"co64" if far else b"stco", 0, 0, struct.pack(f">I{chunks}{'Q' if far else 'I'}", chunks, *at)),
        )
        long = ticks >= 1 << 32
        times = struct.pack(">QQIQ" if long else ">IIII", 0, 0, RATE, ticks)
        mdia = box(b"mdia", full(b"mdhd", int(long), 0, times, struct.pack(">HH", 0x55C4, 0)), _HDLR, box(b"minf", _SMHD, _DREF, stbl))
        track = struct.pack(">QQIIQ" if long else ">IIIII", 0, 0, 1, 0, ticks)
        tkhd = full(b"tkhd", int(long), 7, track, bytes(8), struct.pack(">hhhH", 0, 0, 0x100, 0), _MATRIX, bytes(8))
        mvhd = full(b"mvhd", int(long), 0, times, struct.pack(">IH", 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = 8 if len(payload) + 8 < 1 << 32 else 16
    first = len(_FTYP) + len(moov(0)) + head
    if first + len(payload) >= 1 << 32:
        first = len(_FTYP) + len(moov(first)) + head
    return _FTYP + moov(first) + box(b"mdat", payload)


def boxes(data: memoryview, start: int, end: int, path: tuple = ()) -> Iterator[tuple[tuple, int, int]]:
    """(path, body start, body end) of every box between start and end, containers before what they hold."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind!r} at {start} doesn't fit its parent")
        yield (*path, kind), body, start + size
        if kind in CONTAINERS:
            yield from boxes(data, body, start + size, (*path, kind))
        start += size


def tracks(media: bytes) -> list[dict]:
    """Per track: codec, timescale, duration, stored sample sizes and offsets, sync samples (all, if none are listed)."""
    data, found = memoryview(media), []
    for path, at, end in boxes(data, 0, len(media)):
        kind = path[-1]
        if kind == b"trak":
            found.append({"sync": None})
        elif not found:
            continue
        t = found[-1]
        if kind == b"mdhd":
            t["timescale"], t["duration"] = struct.unpack_from(">IQ", data, at + 20) if data[at] else struct.unpack_from(">II", data, at + 12)
        elif kind == b"stsd":
            t["codec"] = bytes(data[at + 12 : at + 16]).decode("latin-1")
        elif kind == b"stsz":
            fixed, n = struct.unpack_from(">II", data, at + 4)
            t["sizes"] = [fixed] * n if fixed else list(struct.unpack_from(f">{n}I", data, at + 12))
        elif kind in (b"stco", b"co64"):
            (n,) = struct.unpack_from(">I", data, at + 4)
            t["chunks"] = struct.unpack_from(f">{n}{'Q' if kind == b'co64' else 'I'}", data, at + 8)
        elif kind == b"stsc":
            (n,) = struct.unpack_from(">I", data, at + 4)
            t["runs"] = list(struct.iter_unpack(">III", data[at + 8 : at + 8 + 12 * n]))
        elif kind == b"stts":
            (n,) = struct.unpack_from(">I", data, at + 4)
            t["deltas"] = list(struct.iter_unpack(">II", data[at + 8 : at + 8 + 8 * n]))
        elif kind == b"stss":
            (n,) = struct.unpack_from(">I", data, at + 4)
            t["sync"] = struct.unpack_from(f">{n}I", data, at + 8)
    return [t for t in found if "sizes" in t]


def sample_offsets(t: dict) -> list[int]:
    """File offset of each sample, from the chunk offsets and the samples-per-chunk runs."""
    out: list[int] = []
    runs, k = t["runs"], 0
    for c, at in enumerate(t["chunks"], 1):
        while k + 1 < len(runs) and runs[k + 1][0] <= c:
            k += 1
        for _ in range(runs[k][1]):
            out.append(at)
            at += t["sizes"][len(out) - 1]
    return out


def describe(media: bytes) -> str:
    """codec, timescale, duration in ticks, samples and the byte range of every sync sample, of each track."""
    said = []
    for t in tracks(media):
        at = sample_offsets(t)
        keys = range(1, len(at) + 1) if t["sync"] is None else t["sync"]
        ranges = ",".join(f"{at[k - 1]}-{at[k - 1] + t['sizes'][k - 1]}" for k in keys)
        length = sum(n * d for n, d in t["deltas"])
        said.append(f"codec={t['codec'].strip()};timescale={t['timescale']};duration={length};samples={len(at)};keyframes={ranges}")
    return "|".join(said)


def unwrap(media: bytes) -> bytes:
    """The first track's samples, in order, read by its tables."""
    (t, *_), view = tracks(media), memoryview(media)
    at, sizes, out, k = sample_offsets(t), t["sizes"], [], 0
    while k < len(at):
        begin, end = at[k], at[k] + sizes[k]
        while k + 1 < len(at) and at[k + 1] == end:
            k += 1
            end += sizes[k]
        out.append(view[begin:end])
        k += 1
    return b"".join(out)


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _rows(batches: Iterator[pa.RecordBatch], keep_media: bool) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")] + ["media"] * keep_media
    step = 512
    for whole in batches:
        for lo in range(0, whole.num_rows, step):
            batch = whole.slice(lo, step)
            cols: dict[str, list] = {n: [] for n in names}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                media = wrap(padded(data))
                back = unwrap(media)
                row = (doc_id, len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), describe(media), media)
                for n, v in zip(names, row):
                    cols[n].append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[n], t) for n, t in zip(names, types)], names=names)


def media_columns(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): the text's bytes stored as an ISO media file and read back.

    A null text counts as empty (64 zero bytes are stored).  Equal texts give equal values; a null id stays null;
    other columns are not read.  With ``keep_media`` the file itself is in the binary column ``media``.
    """
    schema = SCHEMA + (", media binary" if keep_media else "")
    return docs.select("doc_id", "text").mapInArrow(lambda it: _rows(it, keep_media), schema)
