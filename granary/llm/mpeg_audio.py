"""MPEG audio as a media column: frames, tags, VBR tables, checksums, durations and seek offsets."""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import map_batches

# Fixed values of the MPEG audio standard: kbit/s by (version 1?, layer), Hz by version, for the header's indices.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {"1": (44100, 48000, 32000), "2": (22050, 24000, 16000), "2.5": (11025, 12000, 8000)}
VERSIONS = {3: "1", 2: "2", 0: "2.5"}

#: Stored streams: MPEG-1 layer III, 32 kHz, mono, protected; each frame's bytes behind its side information carry payload.
RATE, SAMPLES, OVERHEAD = 32000, 1152, 4 + 2 + 17
_SIDE = bytes(17)


@dataclass
class Header:
    version: str
    layer: int
    protected: bool
    kbps: int
    rate: int
    padding: int
    mode: int
    size: int
    samples: int

    @property
    def side_bytes(self) -> int:
        if self.layer != 3:
            return 0
        return (17 if self.mode == 3 else 32) if self.version == "1" else (9 if self.mode == 3 else 17)


@dataclass
class Stream:
    version: str = ""
    layer: int = 0
    rate: int = 0
    samples: int = 0
    kbps: list[int] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    payload_at: list[int] = field(default_factory=list)
    crc_good: int = 0
    crc_bad: int = 0
    crc_unknown: int = 0
    skipped: int = 0
    tags: dict[str, bytes] = field(default_factory=dict)
    vbr: dict[str, object] = field(default_factory=dict)


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        r = byte << 8
        for _ in range(8):
            r = (r << 1) ^ (0x8005 if r & 0x8000 else 0)
        out.append(r & 0xFFFF)
    return out


_CRC = _crc_table()


@lru_cache(4096)
def crc16(data: bytes) -> int:
    """CRC-16 of the standard: polynomial 0x8005, start 0xFFFF."""
    r = 0xFFFF
    for b in data:
        r = ((r << 8) & 0xFFFF) ^ _CRC[(r >> 8) ^ b]
    return r


@lru_cache(4096)
def parse_header(word: bytes) -> Header | None:
    """A frame header of 4 bytes, or None where no valid one stands."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer = VERSIONS.get((word[1] >> 3) & 3), 4 - ((word[1] >> 1) & 3)
    bitrate, rate = word[2] >> 4, (word[2] >> 2) & 3
    if version is None or layer == 4 or bitrate in (0, 15) or rate == 3:
        return None
    kbps, hz, pad = BITRATES[version == "1", layer][bitrate], RATES[version][rate], (word[2] >> 1) & 1
    if layer == 1:
        size, samples = (12 * kbps * 1000 // hz + pad) * 4, 384
    elif layer == 2 or version == "1":
        size, samples = 144 * kbps * 1000 // hz + pad, 1152
    else:
        size, samples = 72 * kbps * 1000 // hz + pad, 576
    return Header(version, layer, not word[1] & 1, kbps, hz, pad, word[3] >> 6, size, samples)


def _syncsafe(b: bytes) -> int:
    return (b[0] & 127) << 21 | (b[1] & 127) << 14 | (b[2] & 127) << 7 | (b[3] & 127)


def _put_syncsafe(n: int) -> bytes:
    return bytes(((n >> 21) & 127, (n >> 14) & 127, (n >> 7) & 127, n & 127))


def parse_id3v2(data: bytes, at: int, tags: dict[str, bytes]) -> int:
    """The offset behind an ID3v2 tag at ``at``; its frames go to tags."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10:
        return at
    major, flags, size = data[at + 3], data[at + 5], _syncsafe(data[at + 6 : at + 10])
    p, end = at + 10, min(len(data), at + 10 + size)
    while major >= 3 and p + 10 <= end and data[p] != 0:
        n = _syncsafe(data[p + 4 : p + 8]) if major == 4 else int.from_bytes(data[p + 4 : p + 8], "big")
        if p + 10 + n > end:
            break
        tags.setdefault(data[p : p + 4].decode("latin-1"), bytes(data[p + 10 : p + 10 + n]))
        p += 10 + n
    return at + 10 + size + (10 if flags & 0x10 else 0)


def parse_vbr(frame: bytes, h: Header) -> dict[str, object]:
    """A Xing, Info or VBRI table in a stream's first frame, or an empty dict."""
    at = 4 + 2 * h.protected + h.side_bytes
    for p in {at, 4 + h.side_bytes}:
        kind = frame[p : p + 4]
        if kind in (b"Xing", b"Info") and len(frame) >= p + 8:
            flags, q, out = int.from_bytes(frame[p + 4 : p + 8], "big"), p + 8, {"kind": kind.decode()}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name] = int.from_bytes(frame[q : q + 4], "big")
                    q += 4
            if flags & 4:
                out["toc"] = list(frame[q : q + 100])
            return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames = struct.unpack(">II", frame[46:54])
        return {"kind": "VBRI", "frames": frames, "bytes": size}
    return {}


def parse_stream(data: bytes) -> Stream:
    """All frames of an MPEG audio stream.

    Bytes that belong to no frame or tag are skipped until a valid header stands
    whose successor is a valid header of the same kind, or the stream's end.
    Frames win over tags: the last 128 bytes are an ID3v1 tag only where no frame covers their beginning.
    Durations are exact: samples over rate.  Empty input gives no frames.
    """
    s = Stream()
    end = len(data)
    tag = end - 128 if end >= 128 and data[end - 128 : end - 125] == b"TAG" else end
    p = parse_id3v2(data, 0, s.tags)
    kind = None
    first = sought = True
    while p + 4 <= end:
        if p == tag:
            s.tags["TAG"] = bytes(data[tag:])
            p = end
            break
        h = parse_header(data[p : p + 4])
        good = h is not None and p + h.size <= end and (kind is None or (h.version, h.layer, h.rate) == kind)
        if good and sought and p + h.size != tag and p + h.size + 4 <= end:
            after = parse_header(data[p + h.size : p + h.size + 4])
            good = after is not None and (after.version, after.layer, after.rate) == (h.version, h.layer, h.rate)
        if not good:  # resynchronise
            sought = True
            q = data.find(b"\xff", p + 1, end)
            q = end if q < 0 else q
            q = tag if p < tag < q else q
            s.skipped += q - p
            p = q
            continue
        kind, sought = (h.version, h.layer, h.rate), False
        if h.protected:
            if h.layer == 3 or h.layer == 1:
                covered = h.side_bytes if h.layer == 3 else 16 * (1 if h.mode == 3 else 2)
                if h.layer == 1 and h.mode == 1:  # joint stereo: shared allocation above the bound
                    bound = 4 * (((data[p + 3] >> 4) & 3) + 1)
                    covered = (bound * 8 + (32 - bound) * 4) // 8
                stored = int.from_bytes(data[p + 4 : p + 6], "big")
                if crc16(bytes(data[p + 2 : p + 4]) + bytes(data[p + 6 : p + 6 + covered])) == stored:
                    s.crc_good += 1
                else:
                    s.crc_bad += 1
            else:
                s.crc_unknown += 1
        if first:
            first = False
            s.version, s.layer, s.rate = kind
            s.vbr = parse_vbr(data[p : p + h.size], h)
            if s.vbr:
                p += h.size
                continue
        s.offsets.append(p)
        s.sizes.append(h.size)
        s.kbps.append(h.kbps)
        s.payload_at.append(p + 4 + 2 * h.protected + h.side_bytes)
        s.samples += h.samples
        p += h.size
    s.skipped += max(0, end - p)
    return s


@lru_cache(64)
def _frame_head(index: int) -> tuple[bytes, int]:
    """Header, checksum and side information of a stored frame by bitrate index; payload bytes it holds."""
    word = bytes((0xFF, 0xFA, index << 4 | 2 << 2, 3 << 6))
    h = parse_header(word)
    return word + crc16(word[2:] + _SIDE).to_bytes(2, "big") + _SIDE, h.size - OVERHEAD


def store_payload(payload: bytes) -> bytes:
    """A stream that holds payload: ID3v2 tag with its length, a Xing table, then variable-bitrate frames."""
    head, room = _frame_head(14)
    frames = []
    for at in range(0, len(payload), room):
        part = payload[at : at + room]
        if len(part) == room:
            frames.append(head + part)
        else:
            h, n = next(x for x in map(_frame_head, range(1, 15)) if x[1] >= len(part))
            frames.append(h + part + bytes(n - len(part)))
    sizes = [len(f) for f in frames]
    h, n = _frame_head(4)
    total = sum(sizes) + len(h) + n
    toc, seen, k = [], len(h) + n, 0
    for percent in range(100):
        while k < len(sizes) and k * 100 < percent * len(sizes):
            seen += sizes[k]
            k += 1
        toc.append(min(255, seen * 256 // total))
    xing = (b"Xing" + struct.pack(">III", 7, len(frames), total) + bytes(toc)).ljust(n, b"\0")
    private = b"payload\0" + struct.pack(">Q", len(payload))
    tag = b"PRIV" + _put_syncsafe(len(private)) + b"\0\0" + private
    return b"ID3\4\0\0" + _put_syncsafe(len(tag)) + tag + h + xing + b"".join(frames)


def read_payload(data: bytes, s: Stream) -> bytes:
    """The payload of a stream made by store_payload."""
    body = b"".join([data[a : o + n] for a, o, n in zip(s.payload_at, s.offsets, s.sizes, strict=True)])
    owner, _, length = s.tags.get("PRIV", b"\0" * 16).partition(b"\0")
    return body[: struct.unpack(">Q", length)[0]] if owner == b"payload" else body


SCHEMA = (
    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "n_frames long, n_samples long, sample_rate int, crc_good long, crc_bad long, skipped_bytes long, seek_offsets array<long>"
)


def describe(s: Stream) -> str:
    low, high = (min(s.kbps), max(s.kbps)) if s.kbps else (0, 0)
    told = s.vbr.get("frames", "-")
    return f"mpeg{s.version}-layer{s.layer};{s.rate}Hz;{low}-{high}kbps;frames={len(s.offsets)}/{told};duration={s.samples}/{s.rate or 1};crc={s.crc_good}/{s.crc_good + s.crc_bad};tags={'+'.join(sorted(s.tags))}"


def media_features(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), media: bool = False) -> DataFrame:
    """Store each text as an MPEG audio stream, read it back and describe it.

    The payload is the text's UTF-8 bytes (null: empty) and zeros up to a positive multiple of 64 bytes.
    One row per input row, repeated ones too; columns beside ``keep`` are ignored; an empty table gives no rows.
    media adds the stored form itself.  Work is row by row: nothing is shuffled and a task holds one batch.
    """

    def batch(b):
        rows = []
        for value in b.column(0):
            raw = (value.as_py() or "").encode("utf-8", "surrogatepass")
            stored = store_payload(raw + bytes((-len(raw)) % 64 or (64 if not raw else 0)))
            s = parse_stream(stored)
            back = read_payload(stored, s)
            rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), describe(s), len(s.offsets), s.samples, s.rate, s.crc_good, s.crc_bad, s.skipped, s.offsets) + ((stored,) if media else ()))
        names = [x.split()[0] for x in SCHEMA.split(", ")] + ["media"] * media
        yield {f"k{i}": b.column(i + 1) for i in range(len(keep))} | dict(zip(names, zip(*rows, strict=True), strict=True))

    kinds = dict(df.dtypes)
    schema = ", ".join(f"k{i} {kinds[k]}" for i, k in enumerate(keep)) + ", " + SCHEMA + ", media binary" * media
    out = map_batches(df, schema, batch, F.col(text).alias("t"), *(F.col(k).alias(f"k{i}") for i, k in enumerate(keep)))
    return out.withColumnsRenamed({f"k{i}": k for i, k in enumerate(keep)})
