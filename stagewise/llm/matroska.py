"""Matroska media columns: a muxer, and a parser from EBML elements to packet tables.

The parser reads variable-length element ids and sizes (unknown sizes too), walks
segments and clusters, undoes Xiph, EBML and fixed lacing, and returns each packet's
track, timestamp, byte range and flags, with the cues. Damaged media gives the packets
before the damage and ``status`` "damaged"; null or empty media gives no packets and
"empty".

``text_media`` stores texts as 8-bit PCM packets: null text is empty, equal texts give
equal media, repeated rows give a row each, other columns are ignored, an empty table
gives no rows.
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

from stagewise.llm.common import column, documents_of, ship, stored

# Fixed values of the format: element ids.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
VERSION, READ_VERSION, MAX_ID, MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SCALE, DURATION, MUXER, WRITER = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
ENTRY, NUMBER, UID, KIND, CODEC, AUDIO, RATE, CHANNELS, DEPTH, SPACING = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
PARENTS = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_POSITIONS, EBML}
LACINGS = ("none", "xiph", "fixed", "ebml")

#: Bytes of a packet, packets of a block and of a cluster, samples a second.
PACKET, LACED, CLUSTERED, HERTZ = 576, 8, 64, 8000
PAD = 255


def _size(n: int, width: int = 0) -> bytes:
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return ((1 << 7 * width) | n).to_bytes(width, "big")


def _element(name: int, body: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _number(name: int, n: int) -> bytes:
    return _element(name, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _laced(packets: list[bytes], lacing: int) -> bytes:
    if lacing == 1:
        sizes = b"".join(b"\xff" * (len(p) // 255) + bytes([len(p) % 255]) for p in packets[:-1])
    elif lacing == 3:
        sizes = _size(len(packets[0]))
        for a, b in zip(packets, packets[1:-1], strict=False):
            width = next(w for w in range(1, 9) if abs(len(b) - len(a)) < (1 << 7 * w - 1) - 1)
            sizes += _size(len(b) - len(a) + (1 << 7 * width - 1) - 1, width)
    else:
        sizes = b""
    return bytes([len(packets) - 1]) + sizes + b"".join(packets)


def mux(payload: bytes, packet: int = PACKET) -> bytes:
    """A Matroska file with one 8-bit PCM track; blocks take the three lacings in turn."""
    packets = [payload[i : i + packet] for i in range(0, len(payload), packet)]
    at = lambda k: k * packet * 1000 // HERTZ
    head = _element(EBML, _number(VERSION, 1) + _number(READ_VERSION, 1) + _number(MAX_ID, 4) + _number(MAX_SIZE, 8) + _element(DOC_TYPE, b"matroska") + _number(DOC_VERSION, 4) + _number(DOC_READ_VERSION, 2))
    info = _element(INFO, _number(SCALE, 1_000_000) + _element(DURATION, struct.pack(">d", at(len(packets)))) + _element(MUXER, b"stagewise") + _element(WRITER, b"stagewise"))
    audio = _element(AUDIO, _element(RATE, struct.pack(">d", HERTZ)) + _number(CHANNELS, 1) + _number(DEPTH, 8))
    body = info + _element(TRACKS, _element(ENTRY, _number(NUMBER, 1) + _number(UID, 1) + _number(KIND, 2) + _number(SPACING, packet * 1_000_000_000 // HERTZ) + _element(CODEC, b"A_PCM/INT/LIT") + audio))
    parts, cues, length = [body], b"", len(body)
    for c in range(0, len(packets), CLUSTERED):
        blocks = []
        for b in range(c, min(c + CLUSTERED, len(packets)), LACED):
            group = packets[b : b + LACED]
            lacing = 1 + b // LACED % 3 if len(group) > 1 else 0
            if lacing == 2 and len({*map(len, group)}) > 1:
                lacing = 1
            data = _laced(group, lacing) if lacing else group[0]
            blocks.append(_element(SIMPLE_BLOCK, _size(1) + struct.pack(">hB", at(b) - at(c), 0x80 | lacing << 1) + data))
        cues += _element(CUE_POINT, _number(CUE_TIME, at(c)) + _element(CUE_POSITIONS, _number(CUE_TRACK, 1) + _number(CUE_CLUSTER, length)))
        parts.append(_element(CLUSTER, _number(TIME, at(c)) + b"".join(blocks)))
        length += len(parts[-1])
    return head + _element(SEGMENT, b"".join([*parts, _element(CUES, cues)]))


@dataclass
class Media:
    """What a file holds: packets are (track, timestamp in ns, offset, size, keyframe, lacing)."""

    packets: list[tuple[int, int, int, int, bool, int]] = field(default_factory=list)
    tracks: list[dict] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    blocks: int = 0
    scale: int = 1_000_000
    status: str = "ok"


def _vint(data: bytes, at: int, keep: bool) -> tuple[int, int, bool]:
    """Value, next place, and whether all value bits are set (an unknown size)."""
    lead = data[at]
    width = 9 - lead.bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError("bad length")
    raw = int.from_bytes(data[at : at + width], "big")
    mask = (1 << 7 * width) - 1
    return raw if keep else raw & mask, at + width, raw & mask == mask


def _frames(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    if not lacing:
        return [(at, end - at)]
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == 1:
        while len(sizes) < count - 1:
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            sizes.append(n + data[at])
            at += 1
    elif lacing == 3 and count > 1:
        n, at, _ = _vint(data, at, False)
        sizes.append(n)
        while len(sizes) < count - 1:
            raw, to, _ = _vint(data, at, False)
            sizes.append(sizes[-1] + raw - ((1 << 7 * (to - at) - 1) - 1))
            at = to
    elif lacing == 2:
        if (end - at) % count:
            raise ValueError("unequal fixed lacing")
        sizes = [(end - at) // count] * (count - 1)
    sizes.append(end - at - sum(sizes))
    out = []
    for n in sizes:
        if n < 0 or at + n > end:
            raise ValueError("lacing beyond its block")
        out.append((at, n))
        at += n
    return out


def demux(data: bytes | None) -> Media:
    """Parse a whole file; see the module for damaged and empty media."""
    media = Media()
    if not data:
        media.status = "empty"
        return media
    state = {"time": 0, "segment": 0, "cue": 0, "key": True, "group": None}

    def block(at: int, end: int, simple: bool) -> None:
        track, at, _ = _vint(data, at, False)
        if at + 3 > end:
            raise ValueError("short block")
        shift, flags = struct.unpack_from(">hB", data, at)
        media.blocks += 1
        key = bool(flags & 0x80) if simple else state["key"]
        found = _frames(data, at + 3, end, flags >> 1 & 3)
        stamp = (state["time"] + shift) * media.scale
        step = next((t.get("spacing", 0) for t in media.tracks if t.get("track") == track), 0)
        media.packets += [(track, stamp + i * step, a, n, key, flags >> 1 & 3) for i, (a, n) in enumerate(found)]

    def walk(at: int, end: int, parent: int) -> int:
        while at < end:
            begin = at
            name, at, _ = _vint(data, at, True)
            size, at, unknown = _vint(data, at, False)
            if parent == CLUSTER and name in (CLUSTER, CUES, TRACKS, INFO):
                return begin  # ends a cluster of unknown size
            to = end if unknown else at + size
            if to > end:
                raise ValueError("element beyond its parent")
            if name in PARENTS:
                if name == SEGMENT:
                    state["segment"] = at
                elif name == CLUSTER:
                    media.clusters.append(begin - state["segment"])
                    state["time"] = 0
                elif name == ENTRY:
                    media.tracks.append({})
                elif name == BLOCK_GROUP:
                    state["key"] = True
                at = walk(at, to, name)
                continue
            body = data[at:to] if size <= 8 or name == CODEC else b""
            value = int.from_bytes(body, "big")
            if name == SIMPLE_BLOCK or name == BLOCK:
                block(at, to, name == SIMPLE_BLOCK)
            elif name == TIME:
                state["time"] = value
            elif name == SCALE:
                media.scale = value
            elif name == CUE_TIME:
                state["cue"] = value
            elif name == CUE_TRACK:
                media.cues.append((state["cue"] * media.scale, value, -1))
            elif name == CUE_CLUSTER and media.cues:
                media.cues[-1] = (*media.cues[-1][:2], value)
            elif name == REFERENCE:
                state["key"] = False
            elif media.tracks and name in (NUMBER, KIND, CHANNELS, DEPTH, SPACING):
                media.tracks[-1][{NUMBER: "track", KIND: "kind", CHANNELS: "channels", DEPTH: "depth", SPACING: "spacing"}[name]] = value
            elif media.tracks and name == CODEC:
                media.tracks[-1]["codec"] = body.decode("ascii", "replace")
            elif media.tracks and name == RATE:
                media.tracks[-1]["hertz"] = struct.unpack(">d" if size == 8 else ">f", body)[0]
            at = to
        return at

    try:
        walk(0, len(data), 0)
    except (ValueError, IndexError, struct.error, RecursionError):
        media.status = "damaged"
    return media


def packet_table(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """One row per packet of a binary column: key, number, track, nanoseconds, byte range, flags."""
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    schema = f"media_key {kind}, packet long, track int, time_ns long, byte_start long, byte_size long, keyframe boolean, lacing string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(k, i, t, ns, a, n, key_, LACINGS[lace]) for i, (t, ns, a, n, key_, lace) in enumerate(demux(data.as_py()).packets)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [batch.column(0).type, pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()], strict=True)], ["media_key", "packet", "track", "time_ns", "byte_start", "byte_size", "keyframe", "lacing"])

    return df.select(F.col(key).alias("media_key"), F.col(media).cast("binary").alias("media")).mapInArrow(run, schema)


def padded(raw: bytes) -> bytes:
    return raw + bytes([PAD]) * (-len(raw) % PACKET or PACKET * (not raw))


def describe(data: bytes) -> tuple[bytes, str]:
    """The stored payload and a line of features, both from a file's bytes alone."""
    media = demux(data)
    laced = [0] * 4
    for p in media.packets:
        laced[p[5]] += 1
    hits = sum(place in set(media.clusters) for _, _, place in media.cues)
    track = media.tracks[0] if media.tracks else {}
    feature = (
        f"status={media.status};codec={track.get('codec')};hertz={track.get('hertz', 0):.0f};depth={track.get('depth')};tracks={len(media.tracks)};clusters={len(media.clusters)}"
        f";blocks={media.blocks};packets={len(media.packets)};{';'.join(f'{n}={c}' for n, c in zip(LACINGS, laced, strict=True))}"
        f";keyframes={sum(p[4] for p in media.packets)};cues={len(media.cues)};cues_at_clusters={hits};last_ns={media.packets[-1][1] if media.packets else 0}"
    )
    return b"".join(data[a : a + n] for _, _, a, n, _, _ in media.packets), feature


def text_media(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the Matroska file of every whole text."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                raws = [(t.as_py() or "").encode() for t in column(part, "text")]
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(map(len, raws), pa.int64()), pa.array([mux(padded(r)) for r in raws], pa.binary())], ["doc_id", "n_bytes", "media"])

    return documents_of(df).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Read stored media back: payload hash, tail checksum and features per row."""
    ship(media.sparkSession)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in column(batch, "media"):
                data = data.as_py()
                payload, feature = describe(data)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            if rows:
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "n_bytes"), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def stored_text_media(df: DataFrame) -> DataFrame:
    """Texts to media in the shared folder and back to features."""
    return media_features(stored(text_media(df), "media", parquet__block__size=16 << 20))
