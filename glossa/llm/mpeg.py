"""Media columns: MPEG audio.

``encode`` stores bytes losslessly as an MPEG-1 Layer III stream: an ID3v2
tag, a first frame with the variable-bitrate table (frame and byte counts and
100 seek points), then frames at 48 kHz with CRC-16. Each frame declares no
Huffman data, so its whole body after the side information is ancillary data,
which carries the bytes: 768 of them in a 320 kbit/s frame, and the last 192,
384 or 576 in a smaller one. A decoder plays silence.

``parse`` reads any byte string of MPEG-1, 2 and 2.5 audio of Layers I to III:
it reads ID3v1 tags and ID3v2 tags of all three versions, finds frame headers by
their sync bits, accepts one only if a header of the same kind follows where it
says (or a tag, or the data ends there), searches on byte by byte after damage,
reads variable-bitrate tables of either kind by the fields that they say they
have, and verifies the checksums of Layers I and III (those of Layer II cover a
part whose length its allocation tables give, and are counted as unchecked).
Durations are exact, as samples over the sample rate, and each frame's offset is
a seek point. Frames of free bit rate are skipped like damage.

Defined cases: a null text is an empty one; an empty payload is padded to one
unit; repeated texts give equal streams; text of any length is streamed in
one pass over its frames; bytes that hold no frame give no frame, duration 0;
``decode`` raises ``ValueError`` for frames that ``encode`` does not write;
``parsed`` gives a row for null and for any bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from fractions import Fraction
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm import text as tx

UNIT = 192
#: Bit rates (kbit/s) by index, of MPEG-1 by layer and of MPEG-2 and 2.5 by layer; sample rates of MPEG-1 by index.
RATES_1 = {
    1: (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    2: (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    3: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
}
RATES_2 = {
    1: (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    3: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
BITRATES = RATES_1[3]
RATES = (44100, 48000, 32000)
SAMPLES = 1152
#: Units of payload in a frame -> index of the bit rate that holds them.
FITS = {1: 6, 2: 10, 3: 12, 4: 14}
SIDE = 32
BODY = 4 + 2 + SIDE
POINTS = 100


def crc16(data: bytes, crc: int = 0xFFFF) -> int:
    """CRC-16 of the audio standard: polynomial 0x8005, most significant bit first."""
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1) ^ 0x8005 if crc & 0x8000 else crc << 1
        crc &= 0xFFFF
    return crc


def _header(bitrate: int) -> bytes:
    """MPEG-1 Layer III with checksum, 48 kHz, stereo."""
    return bytes((0xFF, 0xFA, bitrate << 4 | 1 << 2, 0))


_FRONT = {}


def _front(units: int) -> bytes:
    if units not in _FRONT:
        head = _header(FITS[units])
        _FRONT[units] = head + crc16(head[2:] + bytes(SIDE)).to_bytes(2, "big") + bytes(SIDE)
    return _FRONT[units]


def frame_length(bitrate: int, rate: int, padding: int) -> int:
    return 144 * BITRATES[bitrate] * 1000 // RATES[rate] + padding


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def _tag(fields: dict[str, str]) -> bytes:
    body = b""
    for name, value in fields.items():
        content = b"\x00" + name.encode("latin-1") + b"\x00" + value.encode("latin-1")
        body += b"TXXX" + len(content).to_bytes(4, "big") + b"\x00\x00" + content
    return b"ID3\x03\x00\x00" + _syncsafe(len(body)) + body


def pad(data: bytes) -> bytes:
    return data + b"\x20" * (UNIT - len(data) if not data else -len(data) % UNIT)


def encode(data: bytes) -> bytes:
    """The stream that stores ``pad(data)``, with the unpadded length in its tag."""
    payload = np.frombuffer(pad(data), np.uint8)
    big, rest = divmod(len(payload) // UNIT, 4)
    size = frame_length(FITS[4], 1, 0)
    body = np.zeros((big, size), np.uint8)
    body[:, :BODY] = np.frombuffer(_front(4), np.uint8)
    body[:, BODY : BODY + 4 * UNIT] = payload[: big * 4 * UNIT].reshape(big, 4 * UNIT)
    parts = [body.tobytes()]
    if rest:
        parts.append((_front(rest) + payload[big * 4 * UNIT :].tobytes()).ljust(frame_length(FITS[rest], 1, 0), b"\0"))
    frames, first = big + bool(rest) + 1, frame_length(FITS[1], 1, 0)
    total = first + sum(map(len, parts))
    ends = [0, *(first + size * np.arange(big, dtype=np.int64)).tolist(), *([first + size * big] if rest else [])]
    toc = bytes(min(255, ends[p * frames // POINTS] * 256 // total) for p in range(POINTS))
    vbr = b"Xing" + (7).to_bytes(4, "big") + frames.to_bytes(4, "big") + total.to_bytes(4, "big") + toc
    return _tag({"payload_bytes": str(len(data))}) + (_front(1) + vbr).ljust(first, b"\0") + b"".join(parts)


class Frame(NamedTuple):
    """What a header says."""

    length: int
    rate: int
    samples: int
    layer: int
    side: int
    kind: int


#: Headers are few: what each says, by its second to fourth byte.
_HEADERS: dict[bytes, Frame | None] = {}


def _header_says(head: bytes) -> Frame | None:
    version, layer = head[0] >> 3 & 3, 4 - (head[0] >> 1 & 3)
    bitrate, rate, padding, mono = head[1] >> 4, head[1] >> 2 & 3, head[1] >> 1 & 1, head[2] >> 6 == 3
    if head[0] >> 5 != 7 or version == 1 or layer == 4 or not 0 < bitrate < 15 or rate == 3 or head[2] & 3 == 2:
        return None
    first = version == 3
    hertz = RATES[rate] >> (0 if first else 1 if version == 2 else 2)
    bits = (RATES_1 if first else RATES_2)[layer][bitrate] * 1000
    samples = 384 if layer == 1 else 1152 if first or layer == 2 else 576
    length = (12 * bits // hertz + padding) * 4 if layer == 1 else samples // 8 * bits // hertz + padding
    side = ((17 if mono else 32) if first else 9 if mono else 17) if layer == 3 else 0
    return Frame(length, hertz, samples, layer, side, head[0] & 0xFE | rate)


def _frame_at(data: bytes, at: int) -> Frame | None:
    """The frame whose header is at ``at``, if there is one."""
    if at + 4 > len(data) or data[at] != 0xFF:
        return None
    head = data[at + 1 : at + 4]
    if head not in _HEADERS:
        if len(_HEADERS) > 4096:
            _HEADERS.clear()
        _HEADERS[head] = _header_says(head)
    return _HEADERS[head]


def _covered(data: bytes, at: int, frame: Frame) -> bytes | None:
    """The bytes after the checksum that it covers; None where their number is not told."""
    if frame.layer == 3:
        return data[at + 6 : at + 6 + frame.side]
    if frame.layer == 1:  # four bits for each subband and channel; joint ones share theirs
        mode = data[at + 3] >> 6
        joint = 32 - 4 * ((data[at + 3] >> 4 & 3) + 1) if mode == 1 else 0
        return data[at + 6 : at + 6 + (16 if mode == 3 else 32 - joint // 2)]
    return None


def _syncsafe_at(data: bytes, at: int) -> int:
    return sum((b & 127) << s for b, s in zip(data[at : at + 4], (21, 14, 7, 0), strict=True))


def _text(raw: bytes) -> list[str]:
    """The strings of a text field, by the encoding that its first byte names."""
    kind = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(raw[0] if raw else 9)
    return raw[1:].decode(kind, "replace").rstrip("\0").split("\0") if kind else []


def _read_tag(data: bytes, at: int) -> tuple[dict, int]:
    """Text fields of an ID3v2 tag, and where the tag ends."""
    major, flags, size = data[at + 3], data[at + 5], _syncsafe_at(data, at + 6)
    end = at + 10 + size + (10 if major == 4 and flags & 16 else 0)
    body = data[at + 10 : at + 10 + size]
    if flags & 128 and major < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    p = 0
    if flags & 64 and major > 2 and len(body) >= 4:
        p = _syncsafe_at(body, 0) if major == 4 else 4 + int.from_bytes(body[:4], "big")
    fields, width = {}, 3 if major == 2 else 4
    while p + 2 * width + (2 if width == 4 else 0) <= len(body) and body[p : p + width].isalnum():
        name, head = body[p : p + width].decode("latin-1"), 6 if width == 3 else 10
        n = _syncsafe_at(body, p + 4) if major == 4 else int.from_bytes(body[p + width : p + 2 * width], "big")
        content = body[p + head : p + head + n]
        if major == 4 and body[p + 9] & 2:
            content = content.replace(b"\xff\x00", b"\xff")
        strings = _text(content) if name.startswith("T") else []
        if name in ("TXXX", "TXX") and len(strings) > 1:
            fields[strings[0]] = strings[1]
        elif strings:
            fields[name] = "/".join(strings)
        p += head + n
    return fields, end


def _read_old_tag(data: bytes) -> dict:
    """Fields of the 128 bytes of an ID3v1 tag."""
    text = lambda a, b: data[a:b].split(b"\0")[0].decode("latin-1").rstrip()
    fields = {"TIT2": text(3, 33), "TPE1": text(33, 63), "TALB": text(63, 93), "TYER": text(93, 97), "COMM": text(97, 127)}
    if data[125] == 0 and data[126]:
        fields["TRCK"] = str(data[126])
    return {k: v for k, v in fields.items() if v}


def _read_table(data: bytes, at: int, frame: Frame) -> dict | None:
    """The variable-bitrate table in a first frame: frames, bytes and seek points (byte offsets from the frame), as far as it has them."""
    x = at + 4 + (0 if data[at + 1] & 1 else 2) + frame.side
    if data[x : x + 4] in (b"Xing", b"Info"):
        flags, p, out = int.from_bytes(data[x + 4 : x + 8], "big"), x + 8, {"frames": None, "bytes": None, "toc": (), "offset": at}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name], p = int.from_bytes(data[p : p + 4], "big"), p + 4
        return out | {"toc": tuple(data[p : p + POINTS])} if flags & 4 else out
    x = at + 36
    if data[x : x + 4] == b"VBRI":
        number = lambda p, n: int.from_bytes(data[x + p : x + p + n], "big")
        count, scale, width = number(18, 2), number(20, 2), number(22, 2)
        points = [int.from_bytes(data[x + 26 + k * width : x + 26 + (k + 1) * width], "big") * scale for k in range(count)]
        return {"frames": number(14, 4), "bytes": number(10, 4), "toc": tuple(accumulate(points)), "offset": at}
    return None


def _tag_at(data: bytes, at: int) -> bool:
    return data[at : at + 3] == b"ID3" or (data[at : at + 3] == b"TAG" and at + 128 == len(data))


def parse(data: bytes) -> dict:
    """Tags, variable-bitrate table, frames and checks of an MPEG audio stream."""
    tags, offsets, lengths, samples = {}, [], [], Counter()
    vbr, skipped, bad, unchecked, sums, at = None, 0, 0, 0, {}, 0
    tag, old = data.find(b"ID3"), len(data) - 128 if data[-128:-125] == b"TAG" else -1
    while at < len(data):
        if data[at : at + 3] == b"ID3" and at + 10 <= len(data):
            more, at = _read_tag(data, at)
            tags |= more
            continue
        if data[at : at + 3] == b"TAG" and at + 128 == len(data):
            tags, at = _read_old_tag(data[at:]) | tags, at + 128
            continue
        frame = _frame_at(data, at)
        end = at + frame.length if frame else 0
        if frame and end < len(data) and not _tag_at(data, end):
            after = _frame_at(data, end)
            frame = frame if after and after.kind == frame.kind else None
        if not frame or end > len(data):
            if 0 <= tag <= at:
                tag = data.find(b"ID3", at + 1)
            step = min(x for x in (data.find(b"\xff", at + 1), tag, old if old > at else -1, len(data)) if x >= 0)
            skipped, at = skipped + step - at, step
            continue
        if not data[at + 1] & 1:
            covered = _covered(data, at, frame)
            if covered is None:
                unchecked += 1
            else:
                covered = data[at + 2 : at + 4] + covered
                if covered not in sums:
                    sums[covered] = crc16(covered)
                bad += sums[covered] != int.from_bytes(data[at + 4 : at + 6], "big")
        table = _read_table(data, at, frame) if not offsets and vbr is None and frame.layer == 3 else None
        if table:
            vbr = table
        else:
            offsets.append(at)
            lengths.append(frame.length)
            samples[frame.rate] += frame.samples
        at = end
    duration = sum((Fraction(n, rate) for rate, n in samples.items()), Fraction())
    return {"tags": tags, "vbr": vbr, "offsets": offsets, "lengths": lengths, "skipped": skipped, "bad_checksums": bad, "unchecked": unchecked, "sample_rate": max(samples, default=RATES[1] if vbr else 0), "samples": sum(samples.values()), "duration": duration}


_UNITS = {frame_length(b, 1, 0): u for u, b in FITS.items()}


def decode(data: bytes) -> tuple[bytes, dict]:
    """The stored payload, padding included, and what ``parse`` found."""
    found = parse(data)
    if not set(found["lengths"]) <= set(_UNITS):
        raise ValueError("frames that hold no payload")
    view = memoryview(data)
    return b"".join(view[o + BODY : o + BODY + UNIT * _UNITS[n]] for o, n in zip(found["offsets"], found["lengths"], strict=True)), found


def _columns(batches):
    for batch in batches:
        rows = []
        for t in tx.texts(batch.column(1)):
            raw = t.encode()
            media = encode(raw)
            payload, found = decode(media)
            seeks = np.array(found["offsets"], "<i8")
            feature = f"mp3:{found['sample_rate']}:{found['samples']}:{len(seeks)}:{found['skipped']}:{found['bad_checksums']}:{found['vbr']['frames']}:{hashlib.sha256(seeks.tobytes()).hexdigest()[:16]}"
            rows.append((int(found["tags"]["payload_bytes"]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, found["samples"], found["sample_rate"], found["offsets"]))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 10
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], NAMES)


NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "duration_samples", "sample_rate", "frame_offsets"]


def media_features(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Store each text as an MPEG stream, read it back, and return what was read and its features."""
    kind = docs.schema[key].dataType.simpleString()
    return tx.arrow_map(
        docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), _columns, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_samples long, sample_rate long, frame_offsets array<long>"
    )


def media_streams(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The streams themselves: ``doc_id`` and ``media`` (binary)."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode(t.encode()) for t in tx.texts(batch.column(1))], pa.binary())], ["doc_id", "media"])

    return tx.arrow_map(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), run, f"doc_id {docs.schema[key].dataType.simpleString()}, media binary")


def parsed(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """What ``parse`` finds in each row's bytes: frames, exact duration, tags, table and damage; null bytes have none of it."""
    kinds = {"frames": pa.int64(), "duration_samples": pa.int64(), "sample_rate": pa.int64(), "duration": pa.string(), "frame_offsets": pa.list_(pa.int64()), "skipped_bytes": pa.int64(), "bad_checksums": pa.int64(), "unchecked": pa.int64(), "table_frames": pa.int64(), "table_bytes": pa.int64(), "tags": pa.map_(pa.string(), pa.string())}

    def run(batches):
        for batch in batches:
            rows = []
            for data in batch.column(1).to_pylist():
                found = parse(data or b"")
                table = found["vbr"] or {"frames": None, "bytes": None}
                rows.append((len(found["offsets"]), found["samples"], found["sample_rate"], str(found["duration"]), found["offsets"], found["skipped"], found["bad_checksums"], found["unchecked"], table["frames"], table["bytes"], sorted(found["tags"].items())))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds.values(), strict=True))], ["doc_id", *kinds])

    schema = "frames long, duration_samples long, sample_rate long, duration string, frame_offsets array<long>, skipped_bytes long, bad_checksums long, unchecked long, table_frames long, table_bytes long, tags map<string,string>"
    return tx.arrow_map(media.select(F.col(key).alias("doc_id"), F.col(column).cast("binary").alias("media")), run, f"doc_id {media.schema[key].dataType.simpleString()}, {schema}")
