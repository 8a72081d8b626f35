"""Media columns: Matroska files as bytes, written from 8-bit samples and parsed into packet tables.

write() muxes one track of unsigned 8-bit PCM: EBML header, Segment, Info, Tracks, Clusters of SimpleBlocks, Cues. parse()
reads any file of this kind: element ids and sizes of variable length (unknown sizes too), simple and grouped blocks, all
four kinds of lacing (none, Xiph, fixed-size, EBML) and cue points. Each frame becomes a packet: track, timestamp, byte
range in the file, key flag and whether a cue points at its cluster.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table, text_of

# Element ids of the EBML and Matroska formats (RFC 8794, RFC 9559).
EBML, VERSION, READ_VERSION, MAX_ID, MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, SCALE, MUXING_APP, WRITING_APP, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741, 0x4489
TRACKS, TRACK, NUMBER, UID, TYPE, LACING, CODEC = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
AUDIO, RATE, CHANNELS, DEPTH, FRAME_NS = 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, GROUP, BLOCK, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, POINT, CUE_TIME, POSITIONS, CUE_TRACK, CUE_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
_MASTERS = {SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, GROUP, CUES, POINT, POSITIONS, EBML}
#: Where an element of unknown size ends: at any element that can't be inside it.
_ENDS = {CLUSTER: {CLUSTER, CUES, INFO, TRACKS, SEGMENT, EBML}, SEGMENT: {SEGMENT, EBML}}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

#: A frame is 192 samples, a block eight frames at most, a cluster 64 blocks; 19,200 samples a second make a frame 10 ms.
FRAME, LACED, CLUSTER_BLOCKS, SAMPLE_RATE, FRAME_MS = 192, 8, 64, 19_200, 10


def _size(n: int, width: int = 0) -> bytes:
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return ((1 << 7 * width) | n).to_bytes(width, "big")


def _element(ident: int, payload: bytes | int | str, width: int = 0) -> bytes:
    if isinstance(payload, int):
        payload = payload.to_bytes(max(1, (payload.bit_length() + 7) // 8), "big")
    elif isinstance(payload, str):
        payload = payload.encode()
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + _size(len(payload), width) + payload


def lace(frames: list[bytes], kind: int) -> bytes:
    """Frames with the lacing header of their kind; one frame and no lacing: the frame itself."""
    if kind == NO_LACING:
        return frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if kind == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == EBML_LACING and len(frames) > 1:
        head += _size(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
            head += _size(b - a + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def write(payload: bytes, lacing: tuple[int, ...] = (FIXED, EBML_LACING, XIPH, NO_LACING)) -> bytes:
    """A Matroska file of the payload's samples, a multiple of FRAME; blocks take the kinds of lacing in turn."""
    if not payload or len(payload) % FRAME:
        raise ValueError(f"the payload must be a positive multiple of {FRAME} bytes")
    head = _element(EBML, b"".join((_element(VERSION, 1), _element(READ_VERSION, 1), _element(MAX_ID, 4), _element(MAX_SIZE, 8), _element(DOC_TYPE, "matroska"), _element(DOC_VERSION, 4), _element(DOC_READ, 2))))
    audio = _element(AUDIO, _element(RATE, np.array(SAMPLE_RATE, ">f4").tobytes()) + _element(CHANNELS, 1) + _element(DEPTH, 8))
    track = _element(TRACK, _element(NUMBER, 1) + _element(UID, 1) + _element(TYPE, 2) + _element(LACING, 1) + _element(FRAME_NS, FRAME_MS * 1_000_000) + _element(CODEC, "A_PCM/INT/LIT") + audio)
    frames = [payload[a : a + FRAME] for a in range(0, len(payload), FRAME)]
    info = _element(INFO, _element(SCALE, 1_000_000) + _element(MUXING_APP, "tandem") + _element(WRITING_APP, "tandem") + _element(DURATION, np.array(len(frames) * FRAME_MS, ">f8").tobytes()))
    body, cues, at, n_block = [info, _element(TRACKS, track)], [], 0, 0
    position = sum(map(len, body))
    while at < len(frames):
        time, blocks, first = at * FRAME_MS, [], at
        while at < len(frames) and len(blocks) < CLUSTER_BLOCKS and (at - first) * FRAME_MS < 32_000:
            kind = lacing[n_block % len(lacing)]
            some = frames[at : at + (LACED if kind else 1)]
            flags = 0x80 | kind << 1
            blocks.append(_element(SIMPLE_BLOCK, b"\x81" + ((at - first) * FRAME_MS).to_bytes(2, "big", signed=True) + bytes([flags]) + lace(some, kind)))
            at, n_block = at + len(some), n_block + 1
        cluster = _element(CLUSTER, _element(TIMESTAMP, time) + b"".join(blocks))
        cues.append(_element(POINT, _element(CUE_TIME, time) + _element(POSITIONS, _element(CUE_TRACK, 1) + _element(CUE_POSITION, position))))
        body.append(cluster)
        position += len(cluster)
    return head + _element(SEGMENT, b"".join([*body, _element(CUES, b"".join(cues))]), 8)


def vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """A number of variable length and where it ends; None: all ones, an unknown size."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no number of variable length at {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"cut off at {at}")
    value = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return value, at + width
    value &= (1 << 7 * width) - 1
    return (None if value == (1 << 7 * width) - 1 else value), at + width


def elements(data: bytes, at: int, end: int, inside: int = 0):
    """(id, start of payload, end of payload, start of element) of the elements from at to end."""
    while at < end:
        start = at
        ident, at = vint(data, at, True)
        if ident in _ENDS.get(inside, ()):
            return
        size, at = vint(data, at)
        if size is None:
            stop = end
            if ident in _ENDS:
                stop = at
                for _, _, stop, _ in elements(data, at, end, ident):
                    pass
        else:
            stop = at + size
            if stop > end:
                raise ValueError(f"the element at {start} goes beyond its parent")
        yield ident, at, stop, start
        at = stop


def unlace(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames."""
    if kind == NO_LACING:
        return [(at, end)]
    n, at = data[at] + 1, at + 1
    if kind == FIXED:
        size, odd = divmod(end - at, n)
        if odd:
            raise ValueError("fixed-size lacing with a remainder")
        sizes = [size] * n
    else:
        sizes = []
        for i in range(n - 1):
            if kind == XIPH:
                size = 0
                while data[at] == 255:
                    size, at = size + 255, at + 1
                size, at = size + data[at], at + 1
            else:
                before = at
                value, at = vint(data, at)
                size = value if not i else sizes[-1] + value - (1 << 7 * (at - before) - 1) + 1
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
        if min(sizes) < 0:
            raise ValueError("laced frames go beyond their block")
    ends = np.cumsum([at, *sizes]).tolist()
    return list(zip(ends[:-1], ends[1:]))


@dataclass
class Media:
    """tracks: number -> codec; packets: (track, timestamp in ns, start, end, key, cued); clusters: their count."""

    tracks: dict[int, str]
    packets: list[tuple[int, int, int, int, bool, bool]]
    clusters: int
    cues: int


def parse(data: bytes) -> Media:
    """The packet table of a file. Raises ValueError where it isn't well-formed."""
    number = lambda a, b: int.from_bytes(data[a:b], "big")
    tracks, pace, blocks, cued, clusters, scale = {}, {}, [], set(), 0, 1_000_000
    top = list(elements(data, 0, len(data)))
    if not top or top[0][0] != EBML:
        raise ValueError("no EBML header")
    for ident, seg, seg_end, _ in top:
        if ident != SEGMENT:
            continue
        for ident, a, b, start in elements(data, seg, seg_end, SEGMENT):
            if ident == INFO:
                for child, x, y, _ in elements(data, a, b):
                    scale = number(x, y) if child == SCALE else scale
            elif ident == TRACKS:
                for _, x, y, _ in (e for e in elements(data, a, b) if e[0] == TRACK):
                    fields = {child: (p, q) for child, p, q, _ in elements(data, x, y)}
                    tracks[number(*fields[NUMBER])] = data[slice(*fields[CODEC])].decode() if CODEC in fields else ""
                    pace[number(*fields[NUMBER])] = number(*fields[FRAME_NS]) if FRAME_NS in fields else 0
            elif ident == CUES:
                for _, x, y, _ in (e for e in elements(data, a, b) if e[0] == POINT):
                    for _, p, q, _ in (e for e in elements(data, x, y) if e[0] == POSITIONS):
                        cued |= {number(u, v) + seg for child, u, v, _ in elements(data, p, q) if child == CUE_POSITION}
            elif ident == CLUSTER:
                clusters, time = clusters + 1, 0
                for child, x, y, _ in elements(data, a, b, CLUSTER):
                    if child == TIMESTAMP:
                        time = number(x, y)
                    elif child == SIMPLE_BLOCK:
                        blocks.append((start, time, x, y, None))
                    elif child == GROUP:
                        inner = {c: (p, q) for c, p, q, _ in elements(data, x, y)}
                        if BLOCK in inner:
                            blocks.append((start, time, *inner[BLOCK], REFERENCE not in inner))
    packets = []
    for start, time, x, y, key in blocks:
        track, x = vint(data, x)
        offset, flags = int.from_bytes(data[x : x + 2], "big", signed=True), data[x + 2]
        key = bool(flags & 0x80) if key is None else key
        laced = enumerate(unlace(data, x + 3, y, flags >> 1 & 3))  # a block's later frames follow at the track's frame duration
        packets += [(track, (time + offset) * scale + i * pace.get(track, 0), a, b, key, start in cued) for i, (a, b) in laced]
    return Media(tracks, packets, clusters, len(cued))


def samples(data: bytes, media: Media | None = None, track: int = 1) -> bytes:
    """A track's frames in file order, joined."""
    media = media or parse(data)
    return b"".join([data[p[2] : p[3]] for p in media.packets if p[0] == track])


def payload_of(text: str | None) -> bytes:
    """UTF-8, filled with spaces up to a positive multiple of FRAME."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (max(FRAME, -(-len(raw) // FRAME) * FRAME) - len(raw))


def media_column(docs: DataFrame, column: str = "media") -> DataFrame:
    """docs with a binary column of Matroska files of their texts. A column of that name is replaced, others pass through.

    Null and empty texts give a payload of blanks, rows that repeat a text the same file each, very long texts many
    clusters; a file is held whole in memory, once as samples and once as bytes. Empty in, empty out.
    """
    docs = docs.drop(column)
    names = docs.columns
    schema = docs.select(*names, F.lit(b"").alias(column)).schema

    def batches(it):
        for b in it:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([write(payload_of(t)) for t in part.column("text").to_pylist()], pa.binary())], names=[*names, column])

    return docs.mapInArrow(batches, schema)


def packet_table(files: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """A row per packet of the files in column: key, track, packet, timestamp_ns, start, end, is_key, cued. Null files have none."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = files.select(F.col(key).alias("key")).schema.add("track", "integer").add("packet", "long").add("timestamp_ns", "long").add("start", "long").add("end", "long").add("is_key", "boolean").add("cued", "boolean")

    def batches(it):
        for b in it:
            for k, data in zip(b.column("key").to_pylist(), b.column("data").to_pylist()):
                rows = [(k, p[0], i, *p[1:]) for i, p in enumerate(parse(data).packets)] if data is not None else []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], names=schema.names)

    arrow = list(to_arrow_schema(schema))
    return files.select(F.col(key).alias("key"), F.col(column).alias("data")).mapInArrow(batches, schema).withColumnRenamed("key", key)


def feature(media: Media, payload: bytes) -> str:
    """Packets, clusters, cues, duration and simple statistics of the samples, read from a packet table and its bytes."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    frames = x[: len(x) // FRAME * FRAME].reshape(-1, FRAME)
    energy = (frames - 128) ** 2
    last = max(p[1] for p in media.packets) // 1_000_000 + FRAME_MS
    parts = {
        "packets": len(media.packets), "clusters": media.clusters, "cues": media.cues, "ms": last, "sum": int(x.sum()), "peak": int(x.max()),
        "loud": int(energy.sum(1).argmax()), "turns": int(np.count_nonzero(np.diff(x >= 128))), "step": int(np.abs(np.diff(x)).sum()),
    }
    return ";".join(f"{k}={v}" for k, v in parts.items())


_READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _read_back(it):
    for b in it:
        rows = []
        for doc, n, data in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media"))):
            media = parse(data)
            payload = samples(data, media)
            rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(media, payload)))
        if rows:
            doc, n, m, sha, crc, size, media_sha, text = zip(*rows)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (doc, n, m)), pa.array(sha), pa.array(crc, pa.int64()), pa.array(size, pa.int64()), pa.array(media_sha), pa.array(text)], names=[f.split()[0] for f in _READ.split(", ")])


def op8_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.octet_length(text_of()).cast("long").alias("n_bytes"))
    return media_column(docs).drop("text").mapInArrow(_read_back, _READ)
