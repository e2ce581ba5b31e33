"""Media columns: MPEG audio streams. Frame headers are resynchronised, ID3 tags and Xing/Info/VBRI tables parsed, CRC-16
checksums verified, and exact durations and frame seek offsets stored.

`write_audio` stores any payload losslessly as a silent MPEG-1 Layer III stream (mono, 32 kHz, 48 kbit/s): every frame of
216 bytes holds a header, its CRC, 17 bytes of empty side information and 192 payload bytes as ancillary data, which
decoders skip. An Info frame with the table of contents comes first, an ID3v2 tag before and an ID3v1 tag behind.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

UNIT = 192
#: Fixed values of the format: kbit/s by (MPEG-1?, layer), sample rates by version bits, samples a frame.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
HEADER = b"\xff\xfa\x38\xc0"  # MPEG-1 Layer III, with CRC, 48 kbit/s, 32 kHz, mono
FRAME, SIDE = 216, 17


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1) ^ 0x8005 if c & 0x8000 else c << 1
        out.append(c & 0xFFFF)
    return out


CRC_TABLE = _crc_table()
_CRC_SEEN: dict[bytes, int] = {}


def crc16(data: bytes) -> int:
    """CRC-16 of MPEG audio (polynomial 0x8005, start 0xFFFF) over whole bytes; repeated inputs are looked up."""
    if (c := _CRC_SEEN.get(data)) is None:
        c = 0xFFFF
        for b in data:
            c = ((c << 8) & 0xFFFF) ^ CRC_TABLE[(c >> 8) ^ b]
        if len(_CRC_SEEN) < 10_000:
            _CRC_SEEN[data] = c
    return c


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    protected: bool
    kbps: int
    rate: int
    padding: int
    mono: bool
    size: int
    samples: int


_HEADERS: dict[bytes, Header | None] = {}


def read_header(b: bytes) -> Header | None:
    """The frame header in four bytes, None if they are none (free-format streams are not supported)."""
    if b in _HEADERS:
        return _HEADERS[b]
    h = None
    if len(b) == 4 and b[0] == 0xFF and b[1] & 0xE0 == 0xE0:
        version, layer = b[1] >> 3 & 3, 4 - (b[1] >> 1 & 3)
        at, rate = b[2] >> 4, b[2] >> 2 & 3
        if version != 1 and layer != 4 and 0 < at < 15 and rate < 3 and b[3] & 3 != 2:
            one = version == 3
            kbps, hz, pad = BITRATES[one, layer][at], RATES[version][rate], b[2] >> 1 & 1
            if layer == 1:
                size, samples = (12 * kbps * 1000 // hz + pad) * 4, 384
            else:
                samples = 576 if layer == 3 and not one else 1152
                size = samples // 8 * kbps * 1000 // hz + pad
            h = Header(version, layer, not b[1] & 1, kbps, hz, pad, b[3] >> 6 == 3, size, samples)
    if len(_HEADERS) < 10_000:
        _HEADERS[b] = h
    return h


def side_size(h: Header) -> int:
    return (17 if h.mono else 32) if h.version == 3 else (9 if h.mono else 17)


@dataclass
class Audio:
    """What is known of a stream after reading it."""

    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    seconds: Fraction = Fraction(0)
    crc_ok: int = 0
    crc_bad: int = 0
    skipped: int = 0  # bytes that belong to no frame and no tag
    tags: dict[str, str] = field(default_factory=dict)
    vbr: dict = field(default_factory=dict)

    def seek(self, seconds: Fraction | float) -> int:
        """Offset of the frame that plays at a time (the last one behind the end); -1 without frames."""
        if not self.offsets or not self.seconds:
            return -1
        return self.offsets[max(0, min(len(self.offsets) - 1, int(Fraction(seconds) * len(self.offsets) / self.seconds)))]


def _tags(data: bytes) -> tuple[int, int, dict[str, str]]:
    """Start and end of the frames, and the tags' texts."""
    begin, end, tags = 0, len(data), {}
    while data[begin : begin + 3] == b"ID3" and len(data) >= begin + 10:
        version, flags, sz = data[begin + 3], data[begin + 5], data[begin + 6 : begin + 10]
        size = sz[0] << 21 | sz[1] << 14 | sz[2] << 7 | sz[3]
        body, at = data[begin + 10 : begin + 10 + size], 0
        while version in (3, 4) and at + 10 <= len(body) and body[at : at + 1].isalnum():
            key, raw = body[at : at + 4].decode("latin-1"), body[at + 4 : at + 8]
            n = int.from_bytes(raw, "big") if version == 3 else raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]
            value = body[at + 10 : at + 10 + n]
            if key.startswith("T") and value:
                code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(value[0], "latin-1")
                tags[key] = value[1:].decode(code, "replace").rstrip("\0")
            at += 10 + n
        begin += 10 + size + (10 if flags & 0x10 else 0)
    if end - begin >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        tags.setdefault("TIT2", data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1"))
    return min(begin, end), end, tags


def _vbr(frame: bytes, h: Header) -> dict:
    """A Xing, Info or VBRI table in a first frame."""
    at = 4 + 2 * h.protected + side_size(h)
    for where in (at, 4 + side_size(h)):
        if (kind := frame[where : where + 4]) in (b"Xing", b"Info") and len(frame) >= where + 8:
            flags, p, out = int.from_bytes(frame[where + 4 : where + 8], "big"), where + 8, {"kind": kind.decode()}
            for bit, name, n in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
                if flags & bit:
                    out[name] = list(frame[p : p + n]) if name == "toc" else int.from_bytes(frame[p : p + n], "big")
                    p += n
            return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, count, scale, width, per = struct.unpack(">IIHHHH", frame[46:62])
        table_ = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(count)]
        return {"kind": "VBRI", "bytes": size, "frames": frames, "toc": table_, "frames_per_entry": per}
    return {}


def read_audio(data: bytes) -> Audio:
    """Reads a stream. A header counts if the frame ends the stream or another header of the same version, layer and rate
    follows; otherwise the search goes on at the next 0xFF. An empty or foreign stream has no frames."""
    begin, end, tags = _tags(data)
    out, p, samples, rate = Audio(tags=tags), begin, 0, 0
    while p + 4 <= end:
        h = read_header(data[p : p + 4])
        if h is None or p + h.size > end:
            follow = False
        else:
            nxt = read_header(data[p + h.size : p + h.size + 4]) if p + h.size + 4 <= end else h
            follow = nxt is not None and (nxt.version, nxt.layer, nxt.rate) == (h.version, h.layer, h.rate)
        if not follow:
            q = data.find(b"\xff", p + 1, end)
            q = q if q >= 0 else end
            out.skipped += q - p
            p = q
            continue
        if h.protected and h.layer == 3:
            n = side_size(h)
            good = crc16(data[p + 2 : p + 4] + data[p + 6 : p + 6 + n]) == data[p + 4] << 8 | data[p + 5]
            out.crc_ok += good
            out.crc_bad += not good
        table_ = _vbr(data[p : p + h.size], h) if not out.offsets and not out.vbr and h.layer == 3 else {}
        if table_:
            out.vbr = table_ | {"offset": p}
        else:
            out.offsets.append(p)
            out.sizes.append(h.size)
            samples += h.samples
            rate = h.rate
        p += h.size
    out.skipped += end - p if p < end else 0
    out.seconds = Fraction(samples, rate) if rate else Fraction(0)
    return out


def _frame(side: bytes, body: bytes) -> bytes:
    return HEADER + crc16(HEADER[2:] + side).to_bytes(2, "big") + side + body.ljust(FRAME - 6 - SIDE, b"\0")


EMPTY_SIDE = bytes(SIDE)
DATA_HEAD = _frame(EMPTY_SIDE, b"")[: 6 + SIDE]


def pad_payload(raw: bytes) -> bytes:
    """Bytes 32 appended up to a positive multiple of 192."""
    return raw + b" " * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def write_audio(payload: bytes) -> bytes:
    """A stream that holds the payload, whose length must be a positive multiple of 192."""
    if not payload or len(payload) % UNIT:
        raise ValueError("the payload must be a positive multiple of 192 bytes")
    n = len(payload) // UNIT
    toc = bytes(min(255, i * 256 // 100) for i in range(100))
    info = b"Info" + struct.pack(">III", 7, n, (n + 1) * FRAME) + toc
    ms = str(n * 36).encode()
    frame = b"TLEN" + struct.pack(">IH", len(ms) + 1, 0) + b"\0" + ms
    size = len(frame)
    tag2 = b"ID3\x03\0\0" + bytes((size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127)) + frame
    tail = b"\0"
    body = b"".join([DATA_HEAD + payload[i : i + UNIT] + tail for i in range(0, len(payload), UNIT)])
    return tag2 + _frame(EMPTY_SIDE, info) + body + b"TAG" + b"text".ljust(124, b"\0") + b"\xff"


def read_payload(data: bytes, audio: Audio) -> bytes:
    """The payload of a stream made by write_audio, by its frame offsets."""
    head = 6 + SIDE
    return b"".join([data[o + head : o + head + UNIT] for o in audio.offsets])


SCHEMA = (
    "id {id}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "feature string, n_frames long, duration_ms double, crc_ok long, crc_bad long, frame_offsets array<long>, media binary"
)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """Stores every whole text as MPEG audio, reads the stream back and returns what the reading finds.

    Map-only: no shuffle, one document at a time in memory. Null or empty text: one frame of spaces. Null ids and repeated
    rows are kept row by row; equal texts give equal values. keep_media=False leaves media and frame_offsets null.
    """
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "duration_ms", "crc_ok", "crc_bad", "frame_offsets", "media"]
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))

    def one(raw: bytes):
        payload = pad_payload(raw)
        media = write_audio(payload)
        audio = read_audio(media)
        back = read_payload(media, audio)
        toc = audio.vbr.get("toc", [])
        feature = (
            f"frames={len(audio.offsets)};ms={audio.seconds * 1000};crc={audio.crc_ok}/{audio.crc_ok + audio.crc_bad};skipped={audio.skipped};"
            f"table={audio.vbr.get('kind', '-')}:{audio.vbr.get('frames', 0)}:{sum(toc)};tlen={audio.tags.get('TLEN', '')};"
            f"first={audio.offsets[0]};middle={audio.seek(audio.seconds / 2)};last={audio.offsets[-1]}"
        )
        return (
            len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature,
            len(audio.offsets), float(audio.seconds * 1000), audio.crc_ok, audio.crc_bad, audio.offsets if keep_media else None, media if keep_media else None,
        )

    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]

    def run(batches):
        for b in batches:
            ids, texts = b.column("id"), b.column("text").cast(pa.binary())
            for lo in range(0, len(texts), 256):
                cols = list(zip(*[one(t) for t in texts.slice(lo, 256).to_pylist()], strict=True))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, 256), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)

    return rows.mapInArrow(run, SCHEMA.format(id=id_type)).withColumnRenamed("id", id_col)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media_columns(table(spark, sf_dir, "documents"), keep_media=False)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "duration_ms")
