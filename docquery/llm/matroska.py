"""Matroska media columns: bytes to packet tables and back.

A file is a tree of EBML elements, each with a variable-length id and size.
`packet_table` walks Segment, Cluster, SimpleBlock and BlockGroup, undoes Xiph,
fixed and EBML lacing, and gives one row per frame with its track, timestamp,
duration (of raw sound, else 0) and byte range, so that samples can later be read by range.  `cue_table` gives the
index entries with the absolute place of their cluster.  `mux` stores raw 8-bit
samples as a PCM track in clusters of laced blocks with cues.  `stored_texts` writes and reads
back in one pass and hands rows on in batches of a few MB, however long the texts are.

Defined cases: null and empty media have no rows in the tables; null text is the empty one, stored as one unit
of blanks; broken or cut files keep the packets before the break and report it in
`error`; elements of unknown size end where a sibling or parent ends; repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Element ids of the format (fixed values).
EBML, SEGMENT, INFO, TRACKS, TRACK, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, AUDIO = 0x2AD7B1, 0xD7, 0x73C5, 0x83, 0x86, 0xE1
FREQUENCY, CHANNELS, BIT_DEPTH, DEFAULT_DURATION = 0xB5, 0x9F, 0x6264, 0x23E383
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ, MUXER, WRITER = 0x4282, 0x4287, 0x4285, 0x4D80, 0x5741
#: Elements that end one of unknown size: those of its own or a higher level.
_LEVELS = {SEGMENT: 0, EBML: 0, CLUSTER: 1, CUES: 1, INFO: 1, TRACKS: 1}

UNIT = 192
RATE = 8000
#: Frame sizes of the blocks in turn, with the lacing flag: none, Xiph, fixed, EBML.
BLOCKS = ((0, (192,)), (1, (64, 128, 192)), (2, (96, 96, 96, 96)), (3, (160, 32, 192)))
BLOCKS_PER_CLUSTER = 64


# -- writing ---------------------------------------------------------------------------------------


def vint(n: int, width: int = 0) -> bytes:
    """A size or number with its length marker; all ones is kept for unknown sizes."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(sizes: tuple[int, ...], lacing: int) -> bytes:
    """The size table of a laced block."""
    head = bytes([len(sizes) - 1])
    if lacing == 1:
        return head + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    if lacing == 3:
        steps = [b - a for a, b in zip(sizes, sizes[1:-1])]
        wide = [next(w for w in range(1, 9) if abs(d) < 1 << 7 * w - 1) for d in steps]
        return head + vint(sizes[0]) + b"".join(vint(d + (1 << 7 * w - 1) - 1, w) for d, w in zip(steps, wide))
    return head if lacing else b""


@lru_cache(maxsize=1)
def _opening() -> bytes:
    audio = element(FREQUENCY, struct.pack(">d", float(RATE))) + number(CHANNELS, 1) + number(BIT_DEPTH, 8)
    track = number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + element(AUDIO, audio)
    info = number(TIMESTAMP_SCALE, 1_000_000) + element(MUXER, b"docquery") + element(WRITER, b"docquery")
    return element(INFO, info) + element(TRACKS, element(TRACK, track))


_HEAD = element(EBML, element(DOC_TYPE, b"matroska") + number(DOC_TYPE_VERSION, 4) + number(DOC_TYPE_READ, 2))
_LACES = {lacing: lace(sizes, lacing) for lacing, sizes in BLOCKS}


def mux(payload: bytes) -> bytes:
    """8-bit samples as a Matroska file of one PCM track; the length is a multiple of 192."""
    parts, cues, at, place, turn = [_opening()], [], 0, len(_opening()), 0
    while at < len(payload):
        begin = at * 1000 // RATE
        blocks = [number(TIMESTAMP, begin)]
        for _ in range(BLOCKS_PER_CLUSTER):
            lacing, sizes = BLOCKS[turn % len(BLOCKS)]
            if len(payload) - at < sum(sizes):
                lacing, sizes = BLOCKS[0]
            end = at + sum(sizes)
            relative = at * 1000 // RATE - begin
            blocks.append(element(SIMPLE_BLOCK, struct.pack(">BhB", 0x81, relative, 0x80 | lacing << 1) + _LACES[lacing] + payload[at:end]))
            at, turn = end, turn + 1
            if at == len(payload):
                break
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, number(CUE_TIME, begin) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, place))))
        parts.append(cluster)
        place += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return _HEAD + element(SEGMENT, b"".join(parts))


# -- reading ---------------------------------------------------------------------------------------


class Broken(ValueError):
    """The bytes are not a whole element."""


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, int]:
    """(value, place behind it, width)."""
    if at >= len(data) or not data[at]:
        raise Broken(f"no length marker at {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise Broken(f"cut number at {at}")
    value = int.from_bytes(data[at : at + width], "big")
    return value if keep_marker else value & (1 << 7 * width) - 1, at + width, width


def elements(data: bytes, at: int, end: int, level: int = -1) -> Iterator[tuple[int, int, int]]:
    """(id, first byte, last byte + 1) of the bodies between two places."""
    while at < end:
        kind, body, _ = read_vint(data, at, keep_marker=True)
        size, body, width = read_vint(data, body)
        if size == (1 << 7 * width) - 1:  # unknown: up to what can't be inside
            stop = body
            while stop < end:
                inner, begin, _ = read_vint(data, stop, keep_marker=True)
                if _LEVELS.get(inner, 9) <= _LEVELS.get(kind, 0):
                    break
                n, begin, w = read_vint(data, begin)
                stop = end if n == (1 << 7 * w) - 1 else begin + n
            size = min(stop, end) - body
        if body + size > end:
            yield kind, body, end
            raise Broken(f"element at {at} is cut")
        yield kind, body, body + size
        at = body + size


def frames(data: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """(track, relative time, flags, byte ranges) of a block."""
    track, at, _ = read_vint(data, at)
    if at + 3 > end:
        raise Broken(f"cut block at {at}")
    relative, flags = struct.unpack_from(">hB", data, at)
    at += 3
    lacing = flags >> 1 & 3
    if not lacing:
        return track, relative, flags, [(at, end - at)]
    count, at, sizes = data[at] + 1, at + 1, []
    if lacing == 1:
        for _ in range(count - 1):
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            sizes.append(n + data[at])
            at += 1
    elif lacing == 3:
        for k in range(count - 1):
            n, at, width = read_vint(data, at)
            sizes.append(n if not k else sizes[-1] + n - (1 << 7 * width - 1) + 1)
    else:
        sizes = [(end - at) // count] * (count - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Broken(f"lacing at {at} exceeds its block")
    out = []
    for n in sizes:
        out.append((at, n))
        at += n
    return track, relative, flags, out


def demux(data: bytes) -> tuple[list[tuple], list[tuple], str | None]:
    """Packets (track, timestamp in ms, start, length, lacing, keyframe, cluster, ms long), cues (ms, track, cluster), what broke off."""
    packets: list[tuple] = []
    cues: list[tuple] = []
    rates: dict[int, float] = {}  # bytes per ms of raw audio tracks
    whole = lambda a, b: int.from_bytes(data[a:b], "big")
    try:
        for kind, body, end in elements(data, 0, len(data)):
            if kind != SEGMENT:
                continue
            origin, scale = body, 1_000_000
            for kind, a, b in elements(data, body, end):
                if kind == INFO:
                    scale = next((whole(x, y) for k, x, y in elements(data, a, b) if k == TIMESTAMP_SCALE), scale)
                elif kind == TRACKS:
                    for _, x, y in elements(data, a, b):
                        has = {k: (p, q) for k, p, q in elements(data, x, y)}
                        sound = {k: (p, q) for k, p, q in elements(data, *has[AUDIO])} if AUDIO in has else {}
                        if data[slice(*has.get(CODEC_ID, (0, 0)))].startswith(b"A_PCM") and {FREQUENCY, BIT_DEPTH} <= sound.keys():
                            p, q = sound[FREQUENCY]
                            hertz = struct.unpack(">d" if q - p == 8 else ">f", data[p:q])[0]
                            wide = whole(*sound[BIT_DEPTH]) // 8 * (whole(*sound[CHANNELS]) if CHANNELS in sound else 1)
                            rates[whole(*has[TRACK_NUMBER])] = hertz * wide / 1000
                elif kind == CLUSTER:
                    base = 0
                    for k, x, y in elements(data, a, b):
                        if k == TIMESTAMP:
                            base = whole(x, y)
                            continue
                        key = None
                        if k == BLOCK_GROUP:
                            inner = {i: (p, q) for i, p, q in elements(data, x, y)}
                            key = REFERENCE not in inner
                            k, (x, y) = (BLOCK, inner[BLOCK]) if BLOCK in inner else (0, (x, y))
                        if k in (SIMPLE_BLOCK, BLOCK):
                            track, relative, flags, ranges = frames(data, x, y)
                            ms, done, rate = (base + relative) * scale / 1e6, 0, rates.get(track)
                            for start, n in ranges:
                                time = round(ms + (done / rate if rate else 0))
                                packets.append((track, time, start, n, flags >> 1 & 3, bool(flags & 0x80) if key is None else key, a, n / rate if rate else 0.0))
                                done += n
                elif kind == CUES:
                    for _, x, y in elements(data, a, b):
                        has = {k: (p, q) for k, p, q in elements(data, x, y)}
                        spot = {k: (p, q) for k, p, q in elements(data, *has[CUE_POSITIONS])}
                        cues.append((whole(*has[CUE_TIME]) * scale // 1_000_000, whole(*spot[CUE_TRACK]), origin + whole(*spot[CUE_CLUSTER])))
    except (Broken, IndexError, KeyError, struct.error) as e:
        return packets, cues, str(e) or "broken"
    return packets, cues, None


# -- Spark -----------------------------------------------------------------------------------------


def store(payload: Column) -> Column:
    """Matroska bytes of each payload of 8-bit samples; null stays null."""

    @F.pandas_udf("binary")
    def stored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for payloads in batches:
            yield pd.Series([None if x is None else mux(bytes(x)) for x in payloads], dtype=object)

    return stored(payload)


PACKETS = "array<struct<track:int,timestamp_ms:long,start:long,length:long,lacing:int,keyframe:boolean,cluster:long,duration_ms:double>>"
CUE_ROWS = "array<struct<timestamp_ms:long,track:int,cluster:long>>"


def read(media: Column) -> Column:
    """struct(packets, cues, error) of each file."""

    @F.pandas_udf(f"packets {PACKETS}, cues {CUE_ROWS}, error string")
    def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = ("track", "timestamp_ms", "start", "length", "lacing", "keyframe", "cluster", "duration_ms")
        for files in batches:
            rows = [demux(bytes(x)) if x else ([], [], None) for x in files]
            yield pd.DataFrame(
                {
                    "packets": [[dict(zip(names, p)) for p in r[0]] for r in rows],
                    "cues": [[dict(zip(("timestamp_ms", "track", "cluster"), c)) for c in r[1]] for r in rows],
                    "error": [r[2] for r in rows],
                }
            )

    return parsed(media)


def packet_table(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per packet: id, packet (from 0), track, timestamp_ms, start, length, lacing, keyframe, cluster, duration_ms."""
    rows = media.select(F.col(id_col).alias("id"), read(F.col(media_col)).alias("r"))
    return rows.select("id", F.posexplode("r.packets").alias("packet", "p")).select("id", "packet", "p.*")


def cue_table(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per cue: id, timestamp_ms, track, cluster (place of the cluster's element)."""
    rows = media.select(F.col(id_col).alias("id"), read(F.col(media_col)).alias("r"))
    return rows.select("id", F.explode("r.cues").alias("c")).select("id", "c.*")


#: What is read back: the payload that the packets' byte ranges hold, counts, sums over its samples; seekable: every cue points at a cluster.
_BACK = pa.struct(
    [("payload", pa.binary()), ("packets", pa.int64()), ("clusters", pa.int64()), ("cues", pa.int64()), ("seekable", pa.bool_()), ("laced", pa.int64()),
     ("duration_ms", pa.int64()), ("total", pa.int64()), ("energy", pa.int64()), ("error", pa.string())]
)
_BACK_DDL = "struct<payload:binary,packets:long,clusters:long,cues:long,seekable:boolean,laced:long,duration_ms:long,total:long,energy:long,error:string>"
#: Bytes of media that are handed on at a time.
BATCH_BYTES = 4 << 20


def _summary(data: bytes) -> tuple:
    packets, cues, error = demux(data)
    payload = b"".join([data[p[2] : p[2] + p[3]] for p in packets])
    samples = np.frombuffer(payload, np.uint8).astype(np.int64)
    first: dict[int, int] = {}
    for p in packets:
        first.setdefault(p[6], p[1])
    # a cue names the cluster's element, a packet its body: the head between has at most 12 bytes
    heads = {body - k for body in first for k in range(5, 13) if data[body - k : body - k + 4] == CLUSTER.to_bytes(4, "big")}
    seekable = all(c[2] in heads for c in cues)
    last = int(packets[-1][1] + packets[-1][7]) if packets else 0
    laced = sum(p[4] > 0 for p in packets)
    return payload, len(packets), len(first), len(cues), seekable, laced, last, int(samples.sum()), int((samples * samples).sum()), error


def as_payload(text: str | None, unit: int = UNIT) -> bytes:
    """UTF-8 bytes, filled with blanks up to a positive multiple of the unit."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % unit or (0 if raw else unit))


def stored_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (each text's bytes as a Matroska file) and what reading that back gives as `r`."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, first, sizes, media, back, held = batch.column(0), 0, [], [], [], 0
            for n, text in enumerate(batch.column(1)):
                raw = text.as_py()
                file = mux(as_payload(raw))
                sizes.append(len((raw or "").encode("utf-8", "surrogatepass")))
                media.append(file)
                back.append(dict(zip(_BACK.names, _summary(file))))
                held += len(file)
                if held >= BATCH_BYTES or n == len(batch) - 1:
                    columns = [ids.slice(first, n + 1 - first), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array(back, _BACK)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "media", "r"])
                    first, sizes, media, back, held = n + 1, [], [], [], 0

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(stored, f"doc_id {kind}, n_bytes long, media binary, r {_BACK_DDL}")
