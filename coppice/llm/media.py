"""ISO base media containers: nested boxes, sample tables, and payloads in 8-bit frames.

``probe`` walks the boxes of a container (32-bit, 64-bit and to-the-end sizes), decodes the
sample tables of every track (stsd, mdhd, stts, stsz/stz2, stsc, stco/co64, stss) and gives
codec, duration and the byte range of each keyframe. It reads box headers and tables only
and never decodes a payload. ``wrap`` stores bytes losslessly as one video track of raw
8-bit greyscale frames of 8 x 8 samples, so that ``probe`` and ``payload`` can be checked
by an exact round trip.

Defined results: bytes that are no container, and truncated or contradictory ones, give no
tracks and an error text instead of an exception; null bytes are empty bytes. A track
without stss has only keyframes, as the format defines.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.session import ship

#: Fixed values of the format: boxes that only hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex"}

FRAME = 64  # bytes of a stored frame: 8 x 8 samples of 8 bits
FRAMES_PER_CHUNK = 16
KEYFRAME_EVERY = 16
TIMESCALE = 25
CODEC = b"raw "


class BadContainer(ValueError):
    """The bytes are not a container that can be walked."""


@dataclass
class Track:
    """What the sample tables of a track say."""

    codec: str = ""
    handler: str = ""
    timescale: int = 0
    duration: int = 0
    sizes: list[int] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    sync: list[int] = field(default_factory=list)

    @property
    def keyframes(self) -> list[tuple[int, int]]:
        """(first byte, byte after the last) of each keyframe, in sample order."""
        return [(self.offsets[i], self.offsets[i] + self.sizes[i]) for i in self.sync]


def boxes(data: bytes | memoryview, start: int = 0, stop: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """Type, first payload byte and end of each box between two positions."""
    stop = len(data) if stop is None else stop
    while start < stop:
        if stop - start < 8:
            raise BadContainer("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if stop - start < 16:
                raise BadContainer("a 64-bit box size is cut off")
            (size,) = struct.unpack_from(">Q", data, start + 8)
            head = 16
        elif size == 0:
            size = stop - start
        if kind == b"uuid":
            head += 16
        if size < head or start + size > stop:
            raise BadContainer(f"box {kind!r} does not fit its parent")
        yield bytes(kind), start + head, start + size
        start += size


def _table(data: bytes, at: int, end: int, form: str, count: int) -> list[tuple[int, ...]]:
    width = struct.calcsize(form)
    if count * width > end - at:
        raise BadContainer("a table is longer than its box")
    return list(struct.iter_unpack(form, bytes(data[at : at + count * width])))


def _sample_table(data: bytes, found: dict[bytes, tuple[int, int]], track: Track) -> None:
    def head(kind: bytes) -> tuple[int, int]:
        if kind not in found:
            raise BadContainer(f"no {kind.decode()} box")
        return found[kind]

    at, end = head(b"stsd")
    if struct.unpack_from(">I", data, at + 4)[0]:
        track.codec = bytes(data[at + 12 : at + 16]).decode("latin-1")
    if b"stsz" in found:
        at, end = found[b"stsz"]
        fixed, count = struct.unpack_from(">II", data, at + 4)
        if fixed and count > len(data) // fixed:
            raise BadContainer("more samples than bytes")
        track.sizes = [fixed] * count if fixed else [x for (x,) in _table(data, at + 12, end, ">I", count)]
    else:
        at, end = head(b"stz2")
        bits, count = struct.unpack_from(">3xBI", data, at + 4)
        if bits == 4:
            raw = bytes(data[at + 12 : at + 12 + (count + 1) // 2])
            track.sizes = [x for b in raw for x in (b >> 4, b & 15)][:count]
        else:
            track.sizes = [x for (x,) in _table(data, at + 12, end, {8: ">B", 16: ">H"}.get(bits, ">I"), count)]
    wide = b"co64" in found
    at, end = head(b"co64" if wide else b"stco")
    chunks = [x for (x,) in _table(data, at + 8, end, ">Q" if wide else ">I", struct.unpack_from(">I", data, at + 4)[0])]
    at, end = head(b"stsc")
    runs = _table(data, at + 8, end, ">III", struct.unpack_from(">I", data, at + 4)[0])
    sample, total = 0, len(track.sizes)
    for k, (first, per, _) in enumerate(runs):
        last = runs[k + 1][0] if k + 1 < len(runs) else len(chunks) + 1
        for c in range(first - 1, last - 1):
            if not 0 <= c < len(chunks):
                raise BadContainer("a sample-to-chunk entry names no chunk")
            position = chunks[c]
            for _ in range(min(per, total - sample)):
                track.offsets.append(position)
                position += track.sizes[sample]
                sample += 1
    if sample < total:
        raise BadContainer("samples without a chunk")
    if b"stts" in found:
        at, end = found[b"stts"]
        spans = _table(data, at + 8, end, ">II", struct.unpack_from(">I", data, at + 4)[0])
        track.duration = track.duration or sum(n * d for n, d in spans)
    if b"stss" in found:
        at, end = found[b"stss"]
        track.sync = [x - 1 for (x,) in _table(data, at + 8, end, ">I", struct.unpack_from(">I", data, at + 4)[0])]
        if any(not 0 <= x < total for x in track.sync):
            raise BadContainer("a keyframe that is no sample")
    else:
        track.sync = list(range(total))


def probe(data: bytes) -> list[Track]:
    """The tracks of a container; raises ``BadContainer``."""
    tracks: list[Track] = []

    def walk(start: int, stop: int, track: Track | None, found: dict[bytes, tuple[int, int]], depth: int) -> None:
        if depth > 16:
            raise BadContainer("boxes are nested too deep")
        for kind, at, end in boxes(data, start, stop):
            if kind == b"trak":
                own, tables = Track(), {}
                walk(at, end, own, tables, depth + 1)
                _sample_table(data, tables, own)
                tracks.append(own)
            elif kind in CONTAINERS:
                walk(at, end, track, found, depth + 1)
            elif kind == b"mdhd" and track is not None:
                wide = data[at] == 1
                track.timescale, track.duration = struct.unpack_from(">IQ" if wide else ">II", data, at + (20 if wide else 12))
            elif kind == b"hdlr" and track is not None:
                track.handler = bytes(data[at + 8 : at + 12]).decode("latin-1")
            elif track is not None:
                found[kind] = (at, end)

    try:
        walk(0, len(data), None, {}, 0)
    except (struct.error, IndexError) as error:
        raise BadContainer(str(error)) from error
    return tracks


def payload(data: bytes, track: Track) -> bytes:
    """The stored bytes of a track, by its sample table."""
    view, out, i = memoryview(data), [], 0
    while i < len(track.sizes):  # neighbouring samples in one slice
        first = track.offsets[i]
        end = first
        while i < len(track.sizes) and track.offsets[i] == end:
            end += track.sizes[i]
            i += 1
        out.append(view[first:end])
    return b"".join(out)


def _box(kind: bytes, *parts: bytes) -> bytes:
    return struct.pack(">I4s", 8 + sum(map(len, parts)), kind) + b"".join(parts)


def padded(text: bytes) -> bytes:
    """The text with bytes 0 up to a positive multiple of a frame."""
    return text + bytes(-len(text) % FRAME or (0 if text else FRAME))


def wrap(stored: bytes) -> bytes:
    """A container with ``stored`` (a positive multiple of ``FRAME`` bytes) as 8-bit frames."""
    frames, rest = divmod(len(stored), FRAME)
    if rest or not frames:
        raise ValueError("only a positive number of whole frames can be stored")
    chunks = -(-frames // FRAMES_PER_CHUNK)
    full, tail = divmod(frames, FRAMES_PER_CHUNK)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    ftyp = _box(b"ftyp", b"qt  ", struct.pack(">I", 0), b"qt  ")
    wide = len(stored) + 4096 > 0xFFFFFFFF
    header = struct.pack(">I4sQ", 1, b"mdat", 16 + len(stored)) if wide else struct.pack(">I4s", 8 + len(stored), b"mdat")
    first = len(ftyp) + len(header)
    entry = struct.pack(">6xHHH3I2H2IIH32sHh", 1, 0, 0, 0, 0, 0, 8, 8, 0x480000, 0x480000, 0, 1, b"", 40, -1)
    runs = [(1, FRAMES_PER_CHUNK, 1)] * bool(full) + [(full + 1, tail, 1)] * bool(tail)
    keys = range(1, frames + 1, KEYFRAME_EVERY)
    stbl = _box(
        b"stbl",
        _box(b"stsd", struct.pack(">II", 0, 1), _box(CODEC, entry)),
        _box(b"stts", struct.pack(">IIII", 0, 1, frames, 1)),
        _box(b"stss", struct.pack(f">II{len(keys)}I", 0, len(keys), *keys)),
        _box(b"stsc", struct.pack(">II", 0, len(runs)), *(struct.pack(">III", *r) for r in runs)),
        _box(b"stsz", struct.pack(">III", 0, FRAME, frames)),
        _box(b"co64" if wide else b"stco", struct.pack(f">II{chunks}{'Q' if wide else 'I'}", 0, chunks, *range(first, first + len(stored), FRAME * FRAMES_PER_CHUNK))),
    )
    minf = _box(b"minf", _box(b"vmhd", struct.pack(">IHHHH", 1, 0, 0, 0, 0)), _box(b"dinf", _box(b"dref", struct.pack(">II", 0, 1), _box(b"url ", struct.pack(">I", 1)))), stbl)
    mdia = _box(b"mdia", _box(b"mdhd", struct.pack(">IIIIIHH", 0, 0, 0, TIMESCALE, frames, 0, 0)), _box(b"hdlr", struct.pack(">II4s12xB", 0, 0, b"vide", 0)), minf)
    tkhd = _box(b"tkhd", struct.pack(">IIIIII8xHHHH", 7, 0, 0, 1, 0, frames, 0, 0, 0, 0), matrix, struct.pack(">II", 8 << 16, 8 << 16))
    mvhd = _box(b"mvhd", struct.pack(">IIIIIIH10x", 0, 0, 0, TIMESCALE, frames, 0x10000, 0x100), matrix, bytes(24), struct.pack(">I", 2))
    return b"".join((ftyp, header, stored, _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))))


def describe(track: Track) -> str:
    """Codec, duration and keyframes of a track in one line; the ranges as a digest where there are many."""
    ranges = ",".join(f"{a}-{b}" for a, b in track.keyframes)
    shown = ranges if len(ranges) <= 96 else "md5:" + hashlib.md5(ranges.encode()).hexdigest()
    return f"{track.handler}/{track.codec.strip()} {track.duration}/{track.timescale} samples={len(track.sizes)} keyframes={len(track.sync)} {shown}"


def store_texts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, n_bytes and ``media``: every whole text in a container of its own (null: empty text)."""
    ship(docs.sparkSession)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _small(batch):
                raw = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in piece.column(1)]
                yield pa.record_batch([piece.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array([wrap(padded(r)) for r in raw], pa.binary())], names=["k", "n_bytes", "media"])

    kind = docs.select(F.col(key)).dtypes[0][1]
    out = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(store, f"k {kind}, n_bytes long, media binary")
    return out.withColumnRenamed("k", key)


def _small(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for i in range(0, max(1, batch.num_rows), rows):
        yield batch.slice(i, rows)


TRACKS = "array<struct<codec:string,handler:string,timescale:long,duration:long,n_samples:long,keyframes:array<struct<start:long,stop:long>>>>"


def media_columns(table: DataFrame, media: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` with ``tracks`` (codec, duration and keyframe byte ranges) and ``error``."""
    ship(table.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _small(batch):
                tracks, errors = [], []
                for m in piece.column(piece.num_columns - 1):
                    try:
                        found = probe(m.as_py() or b"")
                        errors.append(None if found else "no tracks")
                    except BadContainer as e:
                        found = []
                        errors.append(str(e))
                    tracks.append([{"codec": t.codec, "handler": t.handler, "timescale": t.timescale, "duration": t.duration, "n_samples": len(t.sizes), "keyframes": [{"start": a, "stop": b} for a, b in t.keyframes]} for t in found])
                yield pa.record_batch([*piece.columns[:-1], pa.array(tracks, schema_type), pa.array(errors, pa.string())], names=names)

    names = [*keep, "tracks", "error"]
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
    schema_type = pa.list_(pa.struct([("codec", pa.string()), ("handler", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("n_samples", pa.int64()), ("keyframes", pa.list_(span))]))
    kept = table.select(*[F.col(c) for c in keep], F.col(media).alias("_media"))
    schema = ", ".join([*(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep), f"tracks {TRACKS}", "error string"])
    return kept.mapInArrow(read, schema)


def media_digests(stored: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """Digests of what is read back from the containers of ``store_texts``."""
    ship(stored.sparkSession)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, m in zip(batch.column(1), batch.column(2)):
                data = m.as_py()
                (track,) = probe(data)
                back = payload(data, track)
                rows.append((n.as_py(), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-FRAME:]), len(data), hashlib.sha256(data).hexdigest(), describe(track)))
            columns = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=["k", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = stored.select(F.col(key)).dtypes[0][1]
    out = stored.select(F.col(key).alias("k"), "n_bytes", F.col(media).alias("m")).mapInArrow(digest, f"k {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return out.withColumnRenamed("k", key)
