"""Media columns: payloads in ISO media containers, indexed by walking boxes and sample tables.

``build`` stores a payload losslessly as a track of uncompressed 8-bit grey frames (16 x 12, 192 bytes a
frame), ``index`` walks the nested boxes of any such container, decodes the sample tables (stts, stsc,
stsz, stco or co64, stss) and the runs of fragments (tfhd, trun), and gives codec, duration and the byte range
of every keyframe; no payload byte is decoded for it. ``read`` follows the same tables to fetch stored bytes back.

Damaged containers don't crash the index: a box that leaves its parent ends the walk there; a table that is cut
off counts as far as its entries are whole; a header that is too short is as if it were not there; samples
without a place in a chunk, and those that reach beyond the container's length where that is given, are left
out, as are keyframes that name none; the walk keeps its own stack, so nesting of any depth is walked. Where no
length is given (a head without its payload), a table of equal sizes counts for ``UNKNOWN`` samples at most, or
for as many as the bytes given can hold.

Null text: an empty payload, so one frame of blanks. Null doc_id is kept, repeated rows are rows of their
own, other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .util import map_arrow, texts_of

FRAME, WIDTH, HEIGHT = 192, 16, 12
#: Frames a second, frames from one keyframe to the next, frames of a chunk.
RATE, GOP, CHUNK = 25, 12, 64
_NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def build(payload: bytes) -> bytes:
    """A container whose one video track holds the payload, a positive multiple of 192 bytes."""
    frames = len(payload) // FRAME
    if not frames or len(payload) % FRAME:
        raise ValueError("the payload must be a positive multiple of 192 bytes")
    chunks = -(-frames // CHUNK)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", WIDTH, HEIGHT, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 8, -1))
    runs = [(1, min(frames, CHUNK))] + ([(chunks, frames - CHUNK * (chunks - 1))] if chunks > 1 and frames % CHUNK else [])
    keys = np.arange(1, frames + 1, GOP, dtype=">u4")

    def head(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=np.int64) * CHUNK * FRAME
        wide = first + len(payload) >= 1 << 32
        tables = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, frames, 1)),
            _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", c, n, 1) for c, n in runs)),
            _full(b"stsz", struct.pack(">II", FRAME, frames)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        minf = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), tables)
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, frames, 0x55C4, 0)), _full(b"hdlr", bytes(4), b"vide", bytes(12), b"frames\0"), minf)
        tkhd = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, frames), bytes(16), _MATRIX, struct.pack(">II", WIDTH << 16, HEIGHT << 16), flags=3)
        mvhd = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, frames, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
        return ftyp + _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    large = len(payload) + 8 >= 1 << 32
    mdat = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) if large else struct.pack(">I4s", 8 + len(payload), b"mdat")
    size = len(head(0))
    if size + len(mdat) + len(payload) >= 1 << 32:
        size = len(head(1 << 32))
    return head(size + len(mdat)) + mdat + payload


@dataclass
class Track:
    codec: str = ""
    handler: str = ""
    timescale: int = 0
    duration: int = 0
    durations: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def boxes(data: memoryview, start: int, end: int):
    """(kind, body start, body end) of the boxes in a range; a box that leaves the range ends the walk."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if start + 16 > end:
                return
            size, body = struct.unpack_from(">Q", data, start + 8)[0], start + 16
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            return
        yield kind, body, start + size
        start += size


#: Samples of equal size believed of a container of unknown length.
UNKNOWN = 1 << 24
#: The numbers of an entry of a sample table.
_TABLES = {b"stts": 2, b"stsc": 3, b"stss": 1, b"stco": 1, b"co64": 1}
#: Optional fields of a run's samples: duration, size, flags, time offset.
_RUN_FIELDS = (0x100, 0x200, 0x400, 0x800)
_NOT_SYNC = 0x10000


def _ints(view: memoryview, kind: str, at: int, end: int, n: int, wide: int = 1) -> np.ndarray:
    """Up to n rows of whole entries that lie before the end."""
    n = max(0, min(n, (end - at) // (np.dtype(kind).itemsize * wide)))
    return np.frombuffer(view, kind, n * wide, at).astype(np.int64).reshape(n, wide)


def index(data: bytes, length: int | None = None) -> list[Track]:
    """The tracks of a container (or of its head) of so many bytes, from its boxes and sample tables alone."""
    view = memoryview(data)
    tracks: list[dict] = []
    defaults: dict[int, dict] = {}
    fragments: list[tuple[int, dict]] = []
    number = lambda kind, at, end: struct.unpack_from(kind, view, at)[0] if at + struct.calcsize(kind) <= end else None

    stack: list[tuple] = [(boxes(view, 0, len(data)), {}, 0)]
    while stack:
        found, t, base = stack[-1]
        box = next(found, None)
        if box is None:
            stack.pop()
            continue
        kind, a, b = box
        if kind == b"trak":
            tracks.append({})
            stack.append((boxes(view, a, b), tracks[-1], base))
        elif kind == b"moof":
            stack.append((boxes(view, a, b), {}, a - 8))
        elif kind == b"traf":
            stack.append((boxes(view, a, b), {"moof": base}, base))
        elif kind in _NESTED:
            stack.append((boxes(view, a, b), t, base))
        elif kind == b"tkhd" and b > a:
            t["id"] = number(">I", a + (20 if view[a] else 12), b)
        elif kind == b"mdhd" and b > a:
            at, how = (a + 20, ">IQ") if view[a] else (a + 12, ">II")
            if at + struct.calcsize(how) <= b:
                t["time"] = struct.unpack_from(how, view, at)
        elif kind == b"hdlr":
            t["handler"] = bytes(view[a + 8 : min(a + 12, b)])
        elif kind == b"stsd":
            first = next(boxes(view, min(a + 8, b), b), None)
            t["codec"] = first[0] if first else b""
        elif kind == b"stsz" and b - a >= 12:
            size, n = struct.unpack_from(">II", view, a + 4)
            t["sizes"] = (size, n) if size else _ints(view, ">u4", a + 12, b, n)[:, 0]
        elif kind in _TABLES and b - a >= 8:
            t[kind] = _ints(view, ">u8" if kind == b"co64" else ">u4", a + 8, b, number(">I", a + 4, b), _TABLES[kind])
        elif kind == b"trex" and b - a >= 24:
            track, _, duration, size, flags = struct.unpack_from(">5I", view, a + 4)
            defaults[track] = {"duration": duration, "size": size, "flags": flags}
        elif kind == b"tfhd" and b - a >= 8:
            t |= _fragment_head(view, a, b)
        elif kind == b"trun" and b - a >= 8 and "track" in t:
            fragments.append((t["track"], _run(view, a, b, t, defaults.get(t["track"], {}))))
    end = 2**62 if length is None else length
    out = [_track(t, end, max(len(data), 0 if length is None else length)) for t in tracks]
    for track, run in fragments:
        of = [x for x, t in zip(out, tracks, strict=True) if t.get("id") == track]
        if of:
            _extend(of[0], run, end)
    return out


def _fragment_head(view: memoryview, a: int, b: int) -> dict:
    flags, track = struct.unpack_from(">II", view, a)
    flags &= 0xFFFFFF
    got: dict = {"track": track}
    at = a + 8
    for bit, name, kind in ((1, "base", ">Q"), (2, "", ">I"), (8, "duration", ">I"), (16, "size", ">I"), (32, "flags", ">I")):
        if flags & bit:
            if at + struct.calcsize(kind) > b:
                break
            if name:
                got[name] = struct.unpack_from(kind, view, at)[0]
            at += struct.calcsize(kind)
    return got


def _run(view: memoryview, a: int, b: int, head: dict, default: dict) -> dict:
    """Offsets, sizes, durations and sync marks of a fragment's run. A run without an offset goes on where the one before ended."""
    flags, n = struct.unpack_from(">II", view, a)
    flags &= 0xFFFFFF
    at, start, first = a + 8, head.get("next"), None
    if flags & 1 and at + 4 <= b:
        start = head.get("base", head["moof"]) + struct.unpack_from(">i", view, at)[0]
        at += 4
    if start is None:
        start = head.get("base", head["moof"])
    if flags & 4 and at + 4 <= b:
        first = struct.unpack_from(">I", view, at)[0]
        at += 4
    there = [f for f in _RUN_FIELDS if flags & f]
    fields = _ints(view, ">u4", at, b, n, len(there)) if there else np.zeros((min(n, max(UNKNOWN, len(view))), 0), np.int64)
    n = len(fields)
    value = lambda bit, name: fields[:, there.index(bit)] if bit in there else np.full(n, head.get(name, default.get(name, 0)), np.int64)
    durations, sizes, marks = value(0x100, "duration"), value(0x200, "size"), value(0x400, "flags").copy()
    if first is not None and n:
        marks[0] = first
    ends = start + np.cumsum(sizes)
    head["next"] = int(ends[-1]) if n else start
    return {"offsets": ends - sizes, "sizes": sizes, "durations": durations, "sync": (marks & _NOT_SYNC) == 0}


def _extend(track: Track, run: dict, end: int) -> None:
    whole = (run["offsets"] >= 0) & (run["offsets"] + run["sizes"] <= end)
    keys = len(track.sizes) + np.flatnonzero(run["sync"][whole])
    track.keys = np.concatenate((track.keys, keys))
    for name in ("offsets", "sizes", "durations"):
        setattr(track, name, np.concatenate((getattr(track, name), run[name][whole])))


def _track(t: dict, end: int, held: int) -> Track:
    chunk = t.get(b"co64", t.get(b"stco", np.zeros((0, 1), np.int64)))[:, 0]
    runs = t.get(b"stsc", np.zeros((0, 3), np.int64))
    sizes = t.get("sizes", np.zeros(0, np.int64))
    if isinstance(sizes, tuple):  # one size for all; no more of them than bytes can hold
        sizes = np.full(min(sizes[1], max(held // sizes[0], UNKNOWN if end > held else 0)), sizes[0], np.int64)
    starts = np.clip(np.append(runs[:, 0], len(chunk) + 1), 1, len(chunk) + 1)
    stretch = np.maximum(np.diff(starts), 0)
    per = np.repeat(np.minimum(runs[:, 1], len(sizes)), stretch)[: len(chunk)]
    # As many chunks as the samples need, so that absurd counts cost nothing.
    need = int(np.searchsorted(np.cumsum(per), len(sizes))) + 1
    per = per[:need]
    of = np.repeat(np.arange(len(per)), per)[: len(sizes)]
    before = np.concatenate(([0], np.cumsum(sizes)))[: len(of)]
    first = np.searchsorted(of, np.arange(len(per)))
    offsets = chunk[of] + before - (before[first[of]] if len(of) else before)
    sizes = sizes[: len(offsets)]
    whole = (offsets >= 0) & (offsets + sizes <= end)
    place = np.cumsum(whole) - 1  # where a sample stands among those that are there
    keys = t[b"stss"][:, 0] - 1 if b"stss" in t else np.arange(len(sizes))
    keys = keys[(keys >= 0) & (keys < len(sizes))]
    keys = place[keys[whole[keys]]]
    times = t.get(b"stts", np.zeros((0, 2), np.int64))
    durations = np.repeat(times[:, 1], np.minimum(times[:, 0], len(sizes)))[: len(sizes)]
    durations = np.concatenate((durations, np.zeros(len(sizes) - len(durations), np.int64)))
    scale, duration = t.get("time", (0, 0))
    return Track(t.get("codec", b"").decode("latin-1").strip(), t.get("handler", b"").decode("latin-1"), scale, duration, durations[whole], sizes[whole], offsets[whole], keys)


def read(data: bytes, track: Track) -> bytes:
    """The stored bytes of a track: its samples in order, neighbours in one slice."""
    if not len(track.offsets):
        return b""
    ends = track.offsets + track.sizes
    breaks = np.flatnonzero(track.offsets[1:] != ends[:-1]) + 1
    starts = track.offsets[np.concatenate(([0], breaks))]
    stops = ends[np.concatenate((breaks - 1, [len(ends) - 1]))]
    return b"".join(data[a:b] for a, b in zip(starts, stops, strict=True))


SCHEMA = "n_bytes long, media binary, codec string, timescale int, duration long, n_samples long, keyframes array<struct<sample:long,start:long,size:long>>"


def store(docs: DataFrame) -> DataFrame:
    """doc_id and the media column of every whole text with its index: codec, duration, keyframe byte ranges."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            rows = []
            for text in texts_of(batch.column(1)):
                raw = text.encode()
                media = build(padded(raw))
                t = index(media, len(media))[0]
                rows.append((len(raw), media, t.codec, t.timescale, t.duration, len(t.sizes), [{"sample": int(k), "start": int(t.offsets[k]), "size": int(t.sizes[k])} for k in t.keys]))
            names = ("n_bytes", "media", "codec", "timescale", "duration", "n_samples", "keyframes")
            return {"doc_id": batch.column(0)} | dict(zip(names, zip(*rows, strict=True), strict=True))

        return step

    return map_arrow(docs.select("doc_id", "text"), make, f"doc_id {kind}, {SCHEMA}")


def padded(raw: bytes) -> bytes:
    return raw + b" " * (FRAME - len(raw) % FRAME if len(raw) % FRAME or not raw else 0)


def digest(docs: DataFrame) -> DataFrame:
    """What the stored form of every text gives when read back, with digests in place of bytes and ranges.

    feature: codec, timescale, duration, samples, keyframes and the CRC-32 of the keyframe ranges.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            rows = []
            for text in texts_of(batch.column(1)):
                raw = text.encode()
                media = build(padded(raw))
                t = index(media, len(media))[0]
                got = read(media, t)
                ranges = np.stack((t.offsets[t.keys], t.sizes[t.keys])).astype("<i8").tobytes()
                feature = f"{t.codec}|{t.timescale}|{t.duration}|{len(t.sizes)}|{len(t.keys)}|{zlib.crc32(ranges):08x}"
                rows.append((len(raw), len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
            return {"doc_id": batch.column(0)} | dict(zip(names, zip(*rows, strict=True), strict=True))

        return step

    return map_arrow(docs.select("doc_id", "text"), make, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
