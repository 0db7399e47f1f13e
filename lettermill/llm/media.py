"""Media columns: ISO base media containers.

pack() stores bytes as the samples of a video track of raw 8 x 8 RGB frames: 192 bytes of 8-bit
samples each. probe() walks the nested boxes of any such container, decodes the sample tables and
gives codec, duration and the byte range of each keyframe. It never looks into the payload;
read_samples() does.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from itertools import repeat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import table, with_columns

FRAME = 192
GROUP = 8  # frames in a chunk; the first of each is a keyframe
SCALE = 25
#: Fixed values of the format: boxes that hold boxes.
DEEPEST = 32
HOLDERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"}
UNITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)

RANGE = T.StructType([T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())])
INFO = T.StructType([
    T.StructField("codec", T.StringType()),
    T.StructField("timescale", T.LongType()),
    T.StructField("duration", T.LongType()),
    T.StructField("samples", T.LongType()),
    T.StructField("keyframes", T.ArrayType(RANGE)),
])


def box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    if size >> 32:
        return struct.pack(">I4sQ", 1, kind, size + 8) + b"".join(parts)
    return struct.pack(">I4s", size, kind) + b"".join(parts)


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def pad(payload: bytes) -> bytes:
    """With spaces up to a positive multiple of a frame."""
    return payload.ljust(max(1, -(-len(payload) // FRAME)) * FRAME, b" ")


def pack(payload: bytes) -> bytes:
    """A container of a payload whose length is a positive multiple of a frame."""
    n = len(payload) // FRAME
    chunks = -(-n // GROUP)
    last = n - GROUP * (chunks - 1)
    runs = [(1, GROUP, 1)] if last == GROUP else [(1, last, 1)] if chunks == 1 else [(1, GROUP, 1), (chunks, last, 1)]
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHII", 8, 8, 72 << 16, 72 << 16), bytes(4), struct.pack(">H", 1), bytes(32), struct.pack(">Hh", 24, -1))
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")

    def moov(first: int) -> bytes:
        wide = first + len(payload) >> 32
        offsets = struct.pack(f">{chunks}{'Q' if wide else 'I'}", *range(first, first + len(payload), GROUP * FRAME))
        tables = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, 1)),
            full(b"stss", struct.pack(f">{chunks + 1}I", chunks, *range(1, n + 1, GROUP))),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *run) for run in runs)),
            full(b"stsz", struct.pack(">II", FRAME, n)),
            full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets),
        )
        data = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
        minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), data, tables)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, SCALE, n, 0x55C4, 0)), full(b"hdlr", bytes(4), b"vide", bytes(12), b"frames\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(16), UNITY, struct.pack(">II", 8 << 16, 8 << 16), flags=7)
        mvhd = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, SCALE, n, 0x10000, 0x100), bytes(10), UNITY, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    lead = len(head) + len(moov(0)) + (16 if len(payload) + 8 >> 32 else 8)
    return b"".join((head, moov(lead), box(b"mdat", payload)))


def boxes(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, end) of the content of each box between two places."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        content = start + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, content)
            content += 8
        stop = end if size == 0 else start + size
        if not content <= stop <= end:
            raise ValueError(f"a box of {size} bytes at {start}")
        yield kind, content, stop
        start = stop


def walk(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[tuple, int, int]]:
    """(path, start, end) of each box and of those inside it, in order. Boxes nested deeper than
    DEEPEST, which no format asks for, are an error."""
    levels = [((), boxes(data, start, end))]
    while levels:
        path, own = levels[-1]
        found = next(own, None)
        if found is None:
            levels.pop()
            continue
        kind, a, b = found
        yield (*path, kind), a, b
        if kind in HOLDERS:
            if len(levels) == DEEPEST:
                raise ValueError(f"boxes are nested deeper than {DEEPEST}")
            levels.append(((*path, kind), boxes(data, a, b)))


def _numbers(data: bytes, at: int, end: int, width: str, columns: int = 1) -> list:
    (n,) = struct.unpack_from(">I", data, at)
    size = struct.calcsize(width)
    if at + 4 + n * columns * size > end:
        raise ValueError("a table is longer than its box")
    flat = struct.unpack_from(f">{n * columns}{width}", data, at + 4)
    return list(flat) if columns == 1 else [flat[i : i + columns] for i in range(0, len(flat), columns)]


class Track:
    """The sample tables of one track, decoded from its boxes."""

    def __init__(self, data: bytes, start: int, end: int):
        self.codec, self.kind, self.scale, self.duration = "", "", 0, 0
        self.durations: list = []
        self.keys: list[int] | None = None
        self.runs: list = []
        self.sizes: list[int] = []
        self.chunks: list[int] = []
        for path, a, b in walk(data, start, end):
            kind, at = path[-1], a + 4
            if kind == b"mdhd":
                self.scale, self.duration = struct.unpack_from(">IQ" if data[a] == 1 else ">II", data, a + (20 if data[a] == 1 else 12))
            elif kind == b"hdlr":
                self.kind = data[a + 8 : a + 12].decode("latin-1")
            elif kind == b"stsd":
                self.codec = data[a + 12 : a + 16].decode("latin-1")
            elif kind == b"stts":
                self.durations = _numbers(data, at, b, "I", 2)
            elif kind == b"stss":
                self.keys = _numbers(data, at, b, "I")
            elif kind == b"stsc":
                self.runs = _numbers(data, at, b, "I", 3)
            elif kind == b"stsz":
                (one, n) = struct.unpack_from(">II", data, at)
                if one * n > len(data):
                    raise ValueError("there are more samples than bytes")
                self.sizes = list(repeat(one, n)) if one else _numbers(data, at + 4, b, "I")
            elif kind in (b"stco", b"co64"):
                self.chunks = _numbers(data, at, b, "I" if kind == b"stco" else "Q")

    def ranges(self) -> list[tuple[int, int]]:
        """(offset, length) of each sample."""
        out: list[tuple[int, int]] = []
        sample = 0
        for k, (first, per, _) in enumerate(self.runs):
            until = self.runs[k + 1][0] if k + 1 < len(self.runs) else len(self.chunks) + 1
            if not 0 < first <= until <= len(self.chunks) + 1:
                raise ValueError(f"a run of chunks from {first} to {until}")
            for chunk in range(first, until):
                at = self.chunks[chunk - 1]
                for size in self.sizes[sample : sample + per]:
                    out.append((at, size))
                    at += size
                sample += per
        return out

    def keyframes(self) -> list[tuple[int, int]]:
        """Without a table of them, every sample is one."""
        ranges = self.ranges()
        return ranges if self.keys is None else [ranges[i - 1] for i in self.keys if 0 < i <= len(ranges)]


def tracks(data: bytes) -> list[Track]:
    return [Track(data, a, b) for path, a, b in walk(data) if path == (b"moov", b"trak")]


def info(data: bytes | None) -> dict | None:
    """None if data is null, or isn't a container with a track."""
    try:
        found = tracks(data) if data else []
        if not found:
            return None
        track = shown(found)
        keys = [{"offset": a, "length": n} for a, n in track.keyframes()]
    except (ValueError, struct.error, IndexError):
        return None
    return {"codec": track.codec, "timescale": track.scale, "duration": sum(n * each for n, each in track.durations), "samples": len(track.sizes), "keyframes": keys}


def shown(found: list[Track]) -> Track:
    """The track that is described and read: the first video track, else the first."""
    return next((t for t in found if t.kind == "vide"), found[0])


def read_samples(data: bytes | None) -> bytes | None:
    """The samples of the track that `info` describes, joined. None if data is null or no container with a
    track, if a table can't be read, or if a sample lies outside the file: never a part of the samples."""
    try:
        found = tracks(data) if data else []
        ranges = shown(found).ranges() if found else None
        if ranges is None or any(a + n > len(data) for a, n in ranges) or len(ranges) != len(shown(found).sizes):
            return None
    except (ValueError, struct.error, IndexError):
        return None
    return b"".join(data[a : a + n] for a, n in ranges)


def pack_column(df: DataFrame, payload: str = "payload", out: str = "media") -> DataFrame:
    """df with the container of each row's bytes, padded with spaces to whole frames.

    Null payloads count as empty: one frame of spaces. Equal payloads give equal containers. A
    column named like `out` is replaced; others, and repeated rows, stay.
    """
    field = T.StructType([T.StructField(out, T.BinaryType())])
    return with_columns(df, [payload], field, lambda: lambda rows: {out: [pack(pad(x or b"")) for x in rows[payload]]})


def probe_column(df: DataFrame, media: str = "media", out: str = "media_info") -> DataFrame:
    """df with codec, timescale, duration (in units of 1/timescale s), samples and keyframes'
    byte ranges of each container; null where there is none or it can't be parsed."""
    field = T.StructType([T.StructField(out, INFO)])
    return with_columns(df, [media], field, lambda: lambda rows: {out: [info(x) for x in rows[media]]})


def unpack_column(df: DataFrame, media: str = "media", out: str = "payload") -> DataFrame:
    """df with the samples' bytes, found through the sample tables.

    Null for null and empty media, for what isn't a container with a track, for one that is cut or has
    damaged tables, and where samples lie outside the file. A column named like `out` is replaced;
    others, and repeated rows, stay; an empty table gives no rows.
    """
    field = T.StructType([T.StructField(out, T.BinaryType())])
    return with_columns(df, [media], field, lambda: lambda rows: {out: [read_samples(x) for x in rows[media]]})


DIGESTS = T.StructType([
    T.StructField("n_bytes", T.LongType()),
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()),
    T.StructField("media_sha256", T.StringType()),
    T.StructField("feature", T.StringType()),
])


def digest(raw: bytes) -> tuple:
    """Of a payload that is stored as a container, probed, and read back from it."""
    stored = pack(pad(raw))
    found, back = info(stored), read_samples(stored)
    keys = ",".join(f"{k['offset']}+{k['length']}" for k in found["keyframes"])
    feature = f"{found['codec'].strip()};{found['duration']}/{found['timescale']};keyframes={len(found['keyframes'])};ranges={hashlib.md5(keys.encode()).hexdigest()}"
    return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and digests of each row's text as media, in one pass through Python: containers don't
    go through the JVM. Null and empty texts are one frame of spaces."""

    def step(rows):
        found = [digest((text or "").encode()) for text in rows["text"]]
        return {name: [row[i] for row in found] for i, name in enumerate(DIGESTS.names)}

    return with_columns(docs.select("doc_id", "text"), ["text"], DIGESTS, lambda: step, without=["text"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


def brute(text: str | None) -> tuple:
    """What the query gives for a text, without a container's tables: for tests."""
    raw = (text or "").encode()
    payload = raw + b" " * (-len(raw) % FRAME if raw else FRAME)
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])
