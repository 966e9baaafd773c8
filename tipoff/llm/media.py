"""Media columns: ISO base media files are indexed without decoding any payload.

`index(data)` walks the nested boxes, decodes the sample tables (stts, stsc, stsz, stco/co64, stss) and gives for each track
its codec, time scale, duration and the byte ranges of its keyframes. `mux(payload)` writes a payload as such a file: a track of
uncompressed 8-bit grey frames of FRAME bytes, GROUP frames a chunk, the first frame of each chunk marked as a keyframe.

Null media give null columns; bytes that hold no valid movie box give codec null, no ranges and the reason in `error`.
Boxes with a size of 0 reach to the end; truncated boxes and tables that point outside the file are errors, not crashes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tipoff.llm.common import map_batches

SIDE, GROUP, RATE = 24, 12, 25
FRAME = SIDE * SIDE
#: Boxes whose content is boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}


class Malformed(ValueError):
    pass


# --- reading ------------------------------------------------------------------------------------------------------------


def boxes(data, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(type, first byte of the content, end) of the boxes side by side in data[start:end]."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise Malformed("truncated box header")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise Malformed("truncated box header")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        stop = end if size == 0 else start + size
        if stop < body or stop > end:
            raise Malformed(f"box {kind.decode('latin1')} does not fit")
        yield kind, body, stop
        start = stop


def walk(data, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """Every box with its path, parents first."""
    for kind, body, stop in boxes(data, start, end):
        yield (*path, kind), body, stop
        if kind in CONTAINERS:
            yield from walk(data, body, stop, (*path, kind))


def _table(data, body: int, stop: int, width: int, skip: int = 0) -> list[tuple[int, ...]]:
    """Rows of `width` big-endian 32-bit numbers after the version, the flags, `skip` bytes and the count."""
    if stop - body < 8 + skip:
        raise Malformed("truncated table")
    (n,) = struct.unpack_from(">I", data, body + 4 + skip)
    at = body + 8 + skip
    if at + 4 * width * n > stop:
        raise Malformed("table longer than its box")
    flat = struct.unpack_from(f">{width * n}I", data, at)
    return [flat[i : i + width] for i in range(0, width * n, width)]


class Track:
    """Codec, times and the sample tables of one trak box."""

    def __init__(self, data, body: int, stop: int):
        self.codec, self.timescale, self.duration = None, 0, 0
        self.times, self.chunks, self.offsets, self.sizes, self.sync = [], [], [], [], None
        for path, b, e in walk(data, body, stop):
            kind = path[-1]
            if kind == b"mdhd":
                long = data[b] == 1
                self.timescale, self.duration = struct.unpack_from(">IQ" if long else ">II", data, b + (20 if long else 12))
            elif kind == b"stsd":
                self.codec = bytes(data[b + 12 : b + 16]).decode("latin1") if struct.unpack_from(">I", data, b + 4)[0] else None
            elif kind == b"stts":
                self.times = _table(data, b, e, 2)
            elif kind == b"stsc":
                self.chunks = _table(data, b, e, 3)
            elif kind == b"stco":
                self.offsets = [x for (x,) in _table(data, b, e, 1)]
            elif kind == b"co64":
                self.offsets = [hi << 32 | lo for hi, lo in _table(data, b, e, 2)]
            elif kind == b"stsz":
                fixed, n = struct.unpack_from(">II", data, b + 4)
                if not fixed and b + 12 + 4 * n > e or fixed and n > len(data):
                    raise Malformed("table longer than its box")
                self.sizes = [fixed] * n if fixed else list(struct.unpack_from(f">{n}I", data, b + 12))
            elif kind == b"stss":
                self.sync = [x for (x,) in _table(data, b, e, 1)]
        self.end = len(data)

    def samples(self) -> list[tuple[int, int]]:
        """(first byte, size) of each sample in order."""
        out, k = [], 0
        for i, (first, per_chunk, _) in enumerate(self.chunks):
            last = self.chunks[i + 1][0] if i + 1 < len(self.chunks) else len(self.offsets) + 1
            for at in self.offsets[first - 1 : last - 1]:
                for size in self.sizes[k : k + per_chunk]:
                    if at + size > self.end:
                        raise Malformed("a sample lies outside the file")
                    out.append((at, size))
                    at += size
                k += per_chunk
        if len(out) != len(self.sizes):
            raise Malformed("chunks and samples disagree")
        return out

    def keyframes(self, samples: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """(first byte, end) of each sync sample; without a sync table every sample is one."""
        if self.sync is None:
            return [(a, a + n) for a, n in samples]
        if any(not 1 <= i <= len(samples) for i in self.sync):
            raise Malformed("the sync table points outside the samples")
        return [(samples[i - 1][0], samples[i - 1][0] + samples[i - 1][1]) for i in self.sync]


def tracks(data) -> list[Track]:
    """The tracks of the movie box."""
    try:
        found = [Track(data, b, e) for path, b, e in walk(data) if path == (b"moov", b"trak")]
    except (struct.error, IndexError) as e:
        raise Malformed(f"truncated box: {e}") from e
    if not found:
        raise Malformed("no track")
    return found


# --- writing ------------------------------------------------------------------------------------------------------------


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body if len(body) < 2**32 - 8 else struct.pack(">I4sQ", 1, kind, 16 + len(body)) + body


def _full(kind: bytes, fmt: str = "", *values, more: bytes = b"") -> bytes:
    return _box(kind, struct.pack(">I" + fmt, 0, *values), more)


def mux(payload: bytes) -> bytes:
    """One video track of uncompressed grey frames; len(payload) is a positive multiple of FRAME."""
    if not payload or len(payload) % FRAME:
        raise ValueError(f"the payload must be a positive multiple of {FRAME} bytes")
    n = len(payload) // FRAME
    n_chunks, rest = -(-n // GROUP), n % GROUP
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    brand = _box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso2")
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
    runs = [(1, GROUP, 1)] * (n >= GROUP) + [(n_chunks, rest, 1)] * bool(rest)
    wide = len(payload) > 2**32 - 2**20
    head = 16 if wide else 8

    def movie(first: int) -> bytes:
        offsets = range(first, first + n_chunks * GROUP * FRAME, GROUP * FRAME)
        table = _box(
            b"stbl",
            _full(b"stsd", "I", 1, more=entry),
            _full(b"stts", "III", 1, n, 1),
            _full(b"stsc", "I", len(runs), more=b"".join(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", "II", FRAME, n),
            _full(b"co64" if wide else b"stco", "I", n_chunks, more=struct.pack(f">{n_chunks}{'Q' if wide else 'I'}", *offsets)),
            _full(b"stss", "I", n_chunks, more=struct.pack(f">{n_chunks}I", *range(1, n + 1, GROUP))),
        )
        info = _box(b"minf", _full(b"vmhd", "HHHH", 0, 0, 0, 0), _box(b"dinf", _full(b"dref", "I", 1, more=_full(b"url "))), table)
        media = _box(b"mdia", _full(b"mdhd", "IIIIHH", 0, 0, RATE, n, 0x55C4, 0), _full(b"hdlr", "I4s", 0, b"vide", more=bytes(13)), info)
        track = _box(b"trak", _full(b"tkhd", "IIIIIQHHHH", 0, 0, 1, 0, n, 0, 0, 0, 0, 0, more=matrix + struct.pack(">II", SIDE << 16, SIDE << 16)), media)
        return _box(b"moov", _full(b"mvhd", "IIIIIHHQ", 0, 0, RATE, n, 0x10000, 0x100, 0, 0, more=matrix + bytes(24) + struct.pack(">I", 2)), track)

    moov = movie(0)
    moov = movie(len(brand) + len(moov) + head)
    size = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) if wide else struct.pack(">I4s", 8 + len(payload), b"mdat")
    return b"".join((brand, moov, size, payload))


# --- operators ----------------------------------------------------------------------------------------------------------

INDEX = "codec string, timescale long, duration double, n_samples long, keyframes array<struct<start:long,end:long>>, error string"
_KEYFRAMES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def index(data: bytes | None) -> tuple:
    """codec, timescale, duration in seconds, n_samples, keyframe byte ranges, error: of the first track with samples."""
    if data is None:
        return None, None, None, None, None, None
    try:
        t = max(tracks(data), key=lambda t: bool(t.sizes))
        ranges = t.keyframes(t.samples())
        return t.codec, t.timescale, t.duration / t.timescale if t.timescale else None, len(t.sizes), [{"start": a, "end": b} for a, b in ranges], None
    except Malformed as e:
        return None, None, None, None, [], str(e)


def media_index(rows: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """Per row of binary media: id and the INDEX columns. Payloads are never decoded."""

    def make():
        def step(batch):
            cols = list(zip(*map(index, batch.column(1).to_pylist()), strict=True))
            kinds = [pa.string(), pa.int64(), pa.float64(), pa.int64(), _KEYFRAMES, pa.string()]
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [id_col, "codec", "timescale", "duration", "n_samples", "keyframes", "error"])

        return step

    return map_batches(rows.select(id_col, media_col), make, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, {INDEX}")


def stored_text(text: str | None) -> tuple:
    """Store a text as media, read it back through its sample tables, and describe it."""
    raw = (text or "").encode()
    payload = raw + b"\xff" * (FRAME - len(raw) % FRAME if not raw or len(raw) % FRAME else 0)
    media = mux(payload)
    track = tracks(media)[0]
    samples = track.samples()
    back = b"".join(media[a : a + n] for a, n in samples)
    ranges = track.keyframes(samples)
    marks = zlib.crc32(b"".join(struct.pack(">QQ", *r) for r in ranges))
    feature = f"codec={track.codec.strip()};timescale={track.timescale};duration={track.duration};samples={len(samples)};keyframes={len(ranges)};ranges_crc32={marks}"
    return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature. Null text: empty."""
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def make():
        def step(batch):
            cols = list(zip(*map(stored_text, batch.column(1).to_pylist()), strict=True))
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [id_col, *names])

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), make, f"{id_col} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
