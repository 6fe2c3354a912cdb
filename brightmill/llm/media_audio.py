"""Media columns of MPEG audio: a lossless byte carrier and a reader of frames, tags and seek tables.

The stored form is a valid MPEG-1 layer III stream, mono, 48 kHz, with CRC protection:

    ID3v2.3 tag (TXXX `payload-bytes`) | Xing frame with frame count, byte count and TOC | audio frames | ID3v1 tag

An audio frame has a header, the CRC-16, 17 bytes of side information that codes silence, and then only
ancillary data, which players skip: these bytes carry the payload, so it comes back bit by bit. Frame
sizes vary: all frames have the largest bitrate but the last, which takes the smallest that fits.

The reader assumes none of this. It parses ID3v2 and ID3v1 tags and Xing/Info and VBRI headers, finds
frames by their sync words, and after damage looks for the next header that another header (or the end)
follows at its frame length. It checks each protected frame's CRC, and gives the exact duration as
samples and sample rate and the byte offset of every frame.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightmill.llm.common import lean

# Fixed values of the MPEG audio standard (ISO/IEC 11172-3, 13818-3).
BITRATES = {  # kbit/s by (MPEG-1?, layer), index 1..14
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}  # by version bits
CRC_POLYNOMIAL, CRC_START = 0x8005, 0xFFFF
#: Layer II: (number of subbands, bits of their allocation) in order, by table.
ALLOCATION = {
    "a": ((11, 4), (12, 3), (4, 2)), "b": ((11, 4), (12, 3), (7, 2)), "c": ((2, 4), (6, 3)), "d": ((2, 4), (10, 3)),
    "low": ((4, 4), (7, 3), (19, 2)),
}

HEADER, CRC, SIDE = 4, 2, 17
RATE, SAMPLES = 48000, 1152
KBITS = BITRATES[True, 3]
FULL = 3 * KBITS[-1]  # 144 * bitrate / 48000 = 3 bytes for each kbit/s
ROOM = FULL - HEADER - CRC - SIDE
UNIT = 64


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        table = np.where(table & 0x8000, (table << 1) ^ CRC_POLYNOMIAL, table << 1) & 0xFFFF
    return table


CRC_TABLE = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """The CRC-16 of each row of bytes."""
    crc = np.full(len(rows), CRC_START, np.uint32)
    for column in rows.T:
        crc = ((crc << 8) & 0xFFFF) ^ CRC_TABLE[(crc >> 8) ^ column]
    return crc


def crc16_bits(data: bytes, bits: int) -> int:
    """The CRC-16 of the first `bits` bits."""
    crc = int(crc16(np.frombuffer(data, np.uint8, bits // 8)[None, :])[0])
    for i in range(bits & ~7, bits):
        top = (crc >> 15) ^ (data[i >> 3] >> (7 - (i & 7)) & 1)
        crc = (crc << 1 & 0xFFFF) ^ (CRC_POLYNOMIAL if top else 0)
    return crc


def protected_bits(word: int, body: bytes) -> int:
    """How many bits behind the checksum of a layer I or II frame it covers: the allocation of bits to subbands, and in
    layer II the scale factor selection of those that have any."""
    version, layer, mode = (word >> 19) & 3, 4 - ((word >> 17) & 3), (word >> 6) & 3
    channels = 1 if mode == 3 else 2
    bound = 4 * (((word >> 4) & 3) + 1) if mode == 1 else 32  # from there on joint stereo codes both channels as one
    if layer == 1:
        return 4 * (32 if channels == 1 else bound + 32)
    kbits, hertz = BITRATES[version == 3, 2][((word >> 12) & 15) - 1] // channels, SAMPLE_RATES[version][(word >> 10) & 3]
    if version != 3:
        table = "low"
    elif kbits < 56:
        table = "d" if hertz == 32000 else "c"
    else:
        table = "b" if kbits >= 96 and hertz != 48000 else "a"
    at = chosen = band = 0
    number = int.from_bytes(body[:64].ljust(64, b"\x00"), "big")
    for n, width in ALLOCATION[table]:
        for _ in range(n):
            coded = channels if band < bound else 1
            for _ in range(coded):
                chosen += bool(number >> (512 - at - width) & ((1 << width) - 1)) * (channels if coded < channels else 1)
                at += width
            band += 1
    return at + 2 * chosen


def _header(index: int) -> bytes:
    """MPEG-1 layer III, protected, bitrate index 1..14, 48 kHz, mono."""
    return bytes((0xFF, 0xFA, (index << 4) | 0x04, 0xC0))


def _syncsafe(n: int) -> bytes:
    return bytes((n >> s) & 0x7F for s in (21, 14, 7, 0))


@lru_cache
def _lead(index: int) -> np.ndarray:
    """Header and checksum of a frame with silent side information."""
    header = np.frombuffer(_header(index), np.uint8)
    crc = int(crc16(np.concatenate((header[2:], np.zeros(SIDE, np.uint8)))[None, :])[0])
    return np.concatenate((header, np.array((crc >> 8, crc & 0xFF), np.uint8)))


def _frames(index: int, bodies: np.ndarray) -> np.ndarray:
    """Whole frames from their ancillary bytes, one row a frame."""
    out = np.zeros((len(bodies), 3 * KBITS[index - 1]), np.uint8)
    out[:, : HEADER + CRC] = _lead(index)
    out[:, HEADER + CRC + SIDE : HEADER + CRC + SIDE + bodies.shape[1]] = bodies
    return out


def pad_payload(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % UNIT if data else UNIT)


def encode(payload: bytes) -> bytes:
    """The payload as an MPEG audio stream."""
    whole = len(payload) // ROOM
    rest = len(payload) - whole * ROOM
    parts = [_frames(14, np.frombuffer(payload, np.uint8, whole * ROOM).reshape(whole, ROOM)).tobytes()] if whole else []
    if rest:
        index = next(i for i, k in enumerate(KBITS, 1) if 3 * k - HEADER - CRC - SIDE >= rest)
        parts.append(_frames(index, np.frombuffer(payload, np.uint8, rest, whole * ROOM)[None, :]).tobytes())
    frames, size = whole + bool(rest), sum(map(len, parts))
    info_index = KBITS.index(64) + 1
    info_size = 3 * 64
    toc = bytes(min(255, 256 * (info_size + min(frames * i // 100, max(frames - 1, 0)) * FULL) // (info_size + size)) for i in range(100))
    xing = b"Xing" + (7).to_bytes(4, "big") + frames.to_bytes(4, "big") + (info_size + size).to_bytes(4, "big") + toc
    info = _frames(info_index, np.frombuffer(xing, np.uint8)[None, :]).tobytes()
    text = b"\x00payload-bytes\x00%d" % len(payload)
    frame = b"TXXX" + len(text).to_bytes(4, "big") + b"\x00\x00" + text
    return b"ID3\x03\x00\x00" + _syncsafe(len(frame)) + frame + info + b"".join(parts) + (b"TAGcarrier").ljust(128, b"\x00")


@dataclass
class Audio:
    """What the reader finds in a stream."""

    sample_rate: int = 0
    samples: int = 0
    offsets: list[int] = field(default_factory=list)  # of the audio frames
    sizes: list[int] = field(default_factory=list)
    checked: int = 0  # frames that carry a CRC
    crc_errors: int = 0
    resyncs: int = 0
    skipped: int = 0  # bytes outside frames and tags
    table: str = ""  # Xing, Info, VBRI or empty
    table_frames: int = -1
    table_bytes: int = -1
    seek: list[int] = field(default_factory=list)  # the variable-bitrate table's own seek points
    tags: dict[str, str] = field(default_factory=dict)
    body_starts: list[int] = field(default_factory=list)


def _frame_of(word: int) -> tuple[int, int, int, int, bool] | None:
    """(frame length, samples, sample rate, side information length, protected) of a header word, or None."""
    if word >> 21 != 0x7FF:
        return None
    version, layer = (word >> 19) & 3, 4 - ((word >> 17) & 3)
    rate, index = (word >> 10) & 3, (word >> 12) & 15
    if version == 1 or layer == 4 or rate == 3 or index in (0, 15):
        return None
    first = version == 3
    hertz, kbits, padding = SAMPLE_RATES[version][rate], BITRATES[first, layer][index - 1], (word >> 9) & 1
    mono = (word >> 6) & 3 == 3
    if layer == 1:
        return (12000 * kbits // hertz + padding) * 4, 384, hertz, 0, not (word >> 16) & 1
    samples = 576 if layer == 3 and not first else 1152
    side = 0 if layer == 2 else (17 if mono else 32) if first else (9 if mono else 17)
    return samples // 8 * 1000 * kbits // hertz + padding, samples, hertz, side, not (word >> 16) & 1


def _tags(data: bytes, out: Audio) -> tuple[int, int]:
    """Reads ID3v2 and ID3v1; returns where the audio begins and ends."""
    start, end = 0, len(data)
    while data[start : start + 3] == b"ID3" and start + 10 <= end:
        size = sum((b & 0x7F) << s for b, s in zip(data[start + 6 : start + 10], (21, 14, 7, 0), strict=True))
        at, stop = start + 10, min(start + 10 + size, end)
        while data[start + 3] >= 3 and at + 10 <= stop and data[at : at + 4].isalnum():
            raw = data[at + 4 : at + 8]
            length = int.from_bytes(raw, "big") if data[start + 3] == 3 else sum((b & 0x7F) << s for b, s in zip(raw, (21, 14, 7, 0), strict=True))
            name, body = data[at : at + 4].decode("ascii"), data[at + 11 : at + 10 + length].decode("latin-1")
            key, _, value = body.partition("\x00") if name == "TXXX" else (name, "", body)
            out.tags[f"TXXX:{key}" if name == "TXXX" else name] = value
            at += 10 + length
        start = stop + (10 if data[start + 5] & 0x10 else 0)
    if end - start >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        out.tags["ID3v1:title"] = data[end + 3 : end + 33].rstrip(b"\x00 ").decode("latin-1")
    return start, end


def _table(data: bytes, at: int, size: int, side: int, out: Audio) -> bool:
    """Parses a Xing/Info or VBRI header in the frame at `at`."""
    for skip in (HEADER + side, HEADER + CRC + side):
        name = data[at + skip : at + skip + 4]
        if name in (b"Xing", b"Info"):
            p, flags = at + skip + 8, int.from_bytes(data[at + skip + 4 : at + skip + 8], "big")
            out.table = name.decode()
            if flags & 1:
                out.table_frames, p = int.from_bytes(data[p : p + 4], "big"), p + 4
            if flags & 2:
                out.table_bytes, p = int.from_bytes(data[p : p + 4], "big"), p + 4
            if flags & 4:
                out.seek = [at + x * max(out.table_bytes, 0) // 256 for x in data[p : p + 100]]
            return True
    p = at + HEADER + 32
    if data[p : p + 4] == b"VBRI" and size > 62:
        number = lambda i, n: int.from_bytes(data[p + i : p + i + n], "big")
        out.table, out.table_bytes, out.table_frames = "VBRI", number(10, 4), number(14, 4)
        entries, scale, width = number(18, 2), number(20, 2), number(22, 2)
        where = at + size
        for i in range(min(entries, max(0, (at + size - p - 26) // max(width, 1)))):
            where += number(26 + i * width, width) * scale
            out.seek.append(where)
        return True
    return False


def parse(data: bytes) -> Audio:
    """Frames, tags and tables of a stream; never fails, whatever the bytes."""
    out = Audio()
    at, end = _tags(data, out)
    lost, known = False, {}
    protected: dict[int, list[int]] = {}
    first = True
    while at + HEADER <= end:
        word = int.from_bytes(data[at : at + 4], "big")
        if word not in known:
            known[word] = _frame_of(word)
        frame = known[word]
        good = frame is not None and at + frame[0] <= end
        if good and (lost or first):  # a sync word alone may be chance: the next header must stand where this frame ends
            after = at + frame[0]
            good = after + HEADER > end or _frame_of(int.from_bytes(data[after : after + 4], "big")) is not None
        if not good:
            out.resyncs += not lost
            lost = True
            step = data.find(b"\xff", at + 1, end)
            step = end if step < 0 else step
            out.skipped += step - at
            at = step
            continue
        size, samples, hertz, side, has_crc = frame
        lost = False
        if first and _table(data, at, size, side, out):
            first = False
            at += size
            continue
        first = False
        out.sample_rate = out.sample_rate or hertz
        out.samples += samples
        out.offsets.append(at)
        out.sizes.append(size)
        out.body_starts.append(at + HEADER + CRC * has_crc + side)
        if has_crc and side:
            protected.setdefault(side, []).append(at)
        elif has_crc:
            body = data[at + HEADER + CRC : at + size]
            bits = protected_bits(word, body)
            out.checked += 1
            out.crc_errors += crc16_bits(data[at + 2 : at + HEADER] + body.ljust(64, b"\x00"), 16 + bits) != int.from_bytes(data[at + HEADER : at + HEADER + CRC], "big")
        at += size
    out.skipped += max(0, end - at) if at < end else 0
    raw = np.frombuffer(data, np.uint8)
    for side, starts in protected.items():
        rows = np.asarray(starts)[:, None]
        covered = raw[rows + np.concatenate(([2, 3], np.arange(HEADER + CRC, HEADER + CRC + side)))]
        stored = raw[rows + np.array([HEADER, HEADER + 1])].astype(np.uint32)
        out.checked += len(starts)
        out.crc_errors += int((crc16(covered) != (stored[:, 0] << 8 | stored[:, 1])).sum())
    return out


def read_payload(data: bytes, audio: Audio | None = None) -> bytes:
    """The bytes that `encode` stored, from the frames' ancillary data."""
    audio = audio or parse(data)
    view = memoryview(data)
    body = b"".join(view[b : o + s] for b, o, s in zip(audio.body_starts, audio.offsets, audio.sizes, strict=True))
    return body[: int(audio.tags.get("TXXX:payload-bytes", len(body)))]


def encode_column(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Adds `n_bytes` (of the UTF-8 text, null as empty) and the binary column `media` with its padded
    payload as MPEG audio. Columns of these names are replaced. Repeated rows have equal results; texts may have any length,
    one is coded in one task; an empty table gives an empty one."""

    def store(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([encode(pad_payload(x or b"")) for x in batch.to_pylist()], pa.binary())

    data = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    return df.withColumns({"n_bytes": F.octet_length(data).cast("long"), media: F.arrow_udf(lean(store), "binary")(data)})


FEATURES = (
    "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "duration_samples long, sample_rate int, n_frames int, crc_checked int, crc_errors int, resyncs int, seek_offsets array<long>"
)
_TYPE = pa.struct([
    ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
    ("duration_samples", pa.int64()), ("sample_rate", pa.int32()), ("n_frames", pa.int32()), ("crc_checked", pa.int32()), ("crc_errors", pa.int32()), ("resyncs", pa.int32()), ("seek_offsets", pa.list_(pa.int64())),
])


def measure(data: bytes) -> dict:
    """The features of one stored stream."""
    audio = parse(data)
    payload = read_payload(data, audio)
    loud = np.bincount(np.frombuffer(payload, np.uint8) >> 4, minlength=16) if payload else np.zeros(16, int)
    return {
        "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-UNIT:]),
        "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(),
        "feature": f"{audio.samples}/{audio.sample_rate}:{','.join(map(str, loud.tolist()))}",
        "duration_samples": audio.samples, "sample_rate": audio.sample_rate, "n_frames": len(audio.offsets), "crc_checked": audio.checked,
        "crc_errors": audio.crc_errors, "resyncs": audio.resyncs, "seek_offsets": audio.offsets,
    }


def measure_column(df: DataFrame, media: str = "media") -> DataFrame:
    """Adds the struct `audio` with what the reader finds in each stored stream: payload digests, exact
    duration (duration_samples / sample_rate seconds), CRC results and the seek offset of every frame; a column `audio` is
    replaced. A null stream counts as an empty one."""

    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([measure(x or b"") for x in batch.to_pylist()], _TYPE)

    return df.withColumn("audio", F.arrow_udf(lean(read), f"struct<{', '.join(p.strip().replace(' ', ':', 1) for p in FEATURES.split(', '))}>")(F.col(media)))
