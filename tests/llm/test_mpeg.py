"""Streams that other writers would write: versions, layers, tables, tags and damage, made by hand here."""

from __future__ import annotations

import binascii
import random
from fractions import Fraction

import pytest

from glossa.llm import mpeg

#: (version bits, layer bits, bit rate index, rate index, mode) -> (bytes of a frame, samples, rate), worked out by hand.
KNOWN = {
    (3, 1, 9, 0, 0): (417, 1152, 44100),  # MPEG-1 III, 128 kbit/s
    (3, 1, 14, 1, 3): (960, 1152, 48000),  # MPEG-1 III, 320 kbit/s
    (3, 2, 8, 2, 0): (576, 1152, 32000),  # MPEG-1 II, 128 kbit/s
    (3, 3, 4, 0, 0): (136, 384, 44100),  # MPEG-1 I, 128 kbit/s
    (2, 1, 8, 0, 0): (208, 576, 22050),  # MPEG-2 III, 64 kbit/s
    (2, 2, 8, 1, 3): (384, 1152, 24000),  # MPEG-2 II, 64 kbit/s
    (0, 1, 4, 2, 3): (288, 576, 8000),  # MPEG-2.5 III, 32 kbit/s
    (2, 3, 1, 0, 3): (68, 384, 22050),  # MPEG-2 I, 32 kbit/s
}


def header(version, layer, bitrate, rate, mode, crc=False, padding=0):
    return bytes([0xFF, 0xE0 | version << 3 | layer << 1 | (not crc), bitrate << 4 | rate << 2 | padding << 1, mode << 6])


def frame(spec, fill=b"\x11", crc=False):
    return (header(*spec, crc) + fill * KNOWN[spec][0])[: KNOWN[spec][0]]


@pytest.mark.parametrize("spec", KNOWN)
def test_frames_of_every_version_and_layer(spec):
    size, samples, rate = KNOWN[spec]
    found = mpeg.parse(frame(spec) * 7)
    assert found["offsets"] == [k * size for k in range(7)] and found["lengths"] == [size] * 7
    assert (found["samples"], found["sample_rate"], found["skipped"]) == (7 * samples, rate, 0)
    assert found["duration"] == Fraction(7 * samples, rate)


def crc(data):
    """The checksum by polynomial division of the whole bit string."""
    bits = "".join(f"{b:08b}" for b in data)
    register = 0xFFFF
    for bit in bits:
        top = (register >> 15) ^ int(bit)
        register = (register << 1) & 0xFFFF
        if top:
            register ^= 0x8005
    return register


@pytest.mark.parametrize(("spec", "covered"), [((3, 1, 9, 0, 0), 32), ((3, 1, 14, 1, 3), 17), ((2, 1, 8, 0, 0), 17), ((0, 1, 4, 2, 3), 9), ((3, 3, 4, 0, 0), 32), ((2, 3, 1, 0, 3), 16)])
def test_checksums_cover_what_the_layer_says(spec, covered):
    rng = random.Random(3)
    size, body = KNOWN[spec][0], rng.randbytes(covered).replace(b"\xff", b"\x00")
    head = header(*spec, crc=True)
    good = (head + crc(head[2:] + body).to_bytes(2, "big") + body + b"\x22" * size)[:size]
    assert mpeg.parse(good * 3)["bad_checksums"] == 0
    for at, bad in ((6, 1), (5 + covered, 1), (6 + covered, 0)):
        broken = bytearray(good)
        broken[at] ^= 1
        assert mpeg.parse(bytes(broken) + good * 2)["bad_checksums"] == bad
    assert mpeg.parse(frame((3, 2, 8, 2, 0), crc=True) * 3)["unchecked"] == 3
    assert binascii.crc_hqx(b"", 0) == 0 and mpeg.crc16(b"abc") == crc(b"abc")


@pytest.mark.parametrize("flags", range(16))
def test_tables_have_the_fields_that_their_flags_name(flags):
    spec = (3, 1, 9, 0, 0)
    fields = b"".join(v for bit, v in ((1, (5).to_bytes(4, "big")), (2, (2085).to_bytes(4, "big")), (4, bytes(range(100))), (8, (77).to_bytes(4, "big"))) if flags & bit)
    first = (header(*spec) + bytes(32) + b"Xing" + flags.to_bytes(4, "big") + fields).ljust(417, b"\0")
    vbr = mpeg.parse(first + frame(spec) * 4)["vbr"]
    assert vbr == {"frames": 5 if flags & 1 else None, "bytes": 2085 if flags & 2 else None, "toc": tuple(range(100)) if flags & 4 else (), "offset": 0}


def test_the_other_table():
    spec = (3, 1, 9, 0, 0)
    body = b"VBRI" + b"\0\1" + b"\0\0" + b"\0\x50" + (2085).to_bytes(4, "big") + (4).to_bytes(4, "big") + b"\0\4" + b"\0\2" + b"\0\2" + b"\0\1" + b"".join(n.to_bytes(2, "big") for n in (208, 209, 208, 209))
    first = (header(*spec) + bytes(32) + body).ljust(417, b"\0")
    found = mpeg.parse(first + frame(spec) * 4)
    assert found["vbr"] == {"frames": 4, "bytes": 2085, "toc": (416, 834, 1250, 1668), "offset": 0} and len(found["offsets"]) == 4


def syncsafe(n):
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def test_tags_of_all_versions():
    spec = (3, 1, 9, 0, 0)
    long = "é" * 200
    v22 = b"TT2" + (4).to_bytes(3, "big") + b"\0abc"
    v23 = b"TIT2" + (201).to_bytes(4, "big") + b"\0\0" + b"\0" + long.encode("latin-1") + b"TXXX" + (8).to_bytes(4, "big") + b"\0\0" + b"\0key\0val"
    v24 = b"TPE1" + syncsafe(401) + b"\0\0" + b"\3" + long.encode() + b"TALB" + syncsafe(9) + b"\0\0" + b"\1" + "álb".encode("utf-16")[:8]
    tag = lambda major, body, flags=0, tail=b"": b"ID3" + bytes([major, 0, flags]) + syncsafe(len(body)) + body + tail
    old = (b"TAG" + b"Title".ljust(30, b"\0") + b"Artist".ljust(30) + b"".ljust(30, b"\0") + b"1999" + b"c".ljust(28, b"\0") + b"\0\7" + b"\1")
    assert len(old) == 128
    found = mpeg.parse(tag(2, v22) + tag(3, v23 + bytes(50)) + tag(4, v24, 16, b"3DI" + bytes([4, 0, 16]) + syncsafe(len(v24))) + frame(spec) * 3 + old)
    assert found["tags"] == {"TT2": "abc", "TIT2": long, "key": "val", "TPE1": long, "TALB": "álb", "TYER": "1999", "COMM": "c", "TRCK": "7"}
    assert len(found["offsets"]) == 3 and found["skipped"] == 0
    unsync = b"TIT2" + (4).to_bytes(4, "big") + b"\0\0" + b"\0\xff\x00ab"
    assert mpeg.parse(tag(3, unsync, 128) + frame(spec) * 2)["tags"] == {"TIT2": "ÿab"}


def test_damage_is_skipped_and_counted():
    spec, rng = (3, 1, 9, 0, 0), random.Random(9)
    one = frame(spec)
    found = mpeg.parse(b"\xff\xfb\x90\x00 no frame here" + one * 5 + b"\xff\xe0garbage\xff" + one * 5 + one[:100])
    assert len(found["offsets"]) in (9, 10) and found["samples"] == 1152 * len(found["offsets"])
    for _ in range(300):
        junk = rng.randbytes(rng.randrange(400))
        found = mpeg.parse(junk)
        assert found["skipped"] + sum(found["lengths"]) <= len(junk) + 600 and all(o < len(junk) or not junk for o in found["offsets"])
    assert mpeg.parse(header(3, 1, 0, 0, 0) * 50)["offsets"] == []


def test_foreign_streams_as_a_table(spark):
    one = frame((2, 1, 8, 0, 0))
    rows = [(1, bytearray(one * 4)), (2, None), (3, bytearray()), (4, bytearray(b"text")), (5, bytearray(mpeg.encode(b"abc")))]
    got = {r.doc_id: r for r in mpeg.parsed(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert (got[1].frames, got[1].duration, got[1].table_frames) == (4, str(Fraction(4 * 576, 22050)), None)
    assert [got[i].frames for i in (2, 3, 4)] == [0, 0, 0] and got[4].skipped_bytes == 4 and got[5].tags == {"payload_bytes": "3"}
    with pytest.raises(ValueError):
        mpeg.decode(one * 4)
