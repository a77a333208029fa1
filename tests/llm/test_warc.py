"""Archives through a reader of their own: the Zstandard stream and the header lines, without the module's parser."""

from __future__ import annotations

import glob
import hashlib
import io
import re
import struct
import time

import pytest
import zstandard

from glossa.llm import warc


def plain(data: bytes) -> list[tuple[dict, bytes]]:
    """Headers and block of each record of an archive, by decompressing the whole stream."""
    magic, n = struct.unpack_from("<II", data)
    assert magic & 0xFFFFFFF0 == 0x184D2A50
    words = zstandard.decompress(data[8 : 8 + n]) if n else b""
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)
    raw = d.stream_reader(io.BytesIO(data[8 + n :]), read_across_frames=True).read()
    out = []
    while raw:
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        assert rest[size : size + 4] == b"\r\n\r\n"
        out.append((fields, rest[:size]))
        raw = rest[size + 4 :]
    return out


def test_archives_are_valid_and_rolled_by_size(spark, tmp_path):
    same = "<b>" + "y" * 1500
    rows = [(i, f"http://x/{i}", f"<p>page {i} " + "text of it " * 100) for i in range(200)] + [(1000 + i, None, same) for i in range(50)] + [(7, "u", same), (7, "u", same), (None, "a b", same), (3000, "e", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    warc.write(pages, str(tmp_path / "w"), size=40_000)
    files = sorted(glob.glob(f"{tmp_path}/w/part-*.warc.zst"))
    assert len(files) > 4 and not [f for f in glob.glob(f"{tmp_path}/w/*") if "_writing" in f]
    ids, responses, got = set(), {}, []
    for f in files:
        records = plain(open(f, "rb").read())
        assert records[0][0]["WARC-Type"] == "warcinfo" and sum(h["WARC-Type"] == "warcinfo" for h, _ in records) == 1
        for h, block in records:
            assert h["WARC-Record-ID"] not in ids and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", h["WARC-Date"])
            ids.add(h["WARC-Record-ID"])
            if h["WARC-Type"] == "warcinfo":
                continue
            page = int(h["WARC-Page-ID"]) if "WARC-Page-ID" in h else None
            http, _, payload = block.partition(b"\r\n\r\n")
            got.append((page, h["WARC-Type"]))
            if h["WARC-Type"] == "response":
                responses[page] = payload
                assert hashlib.sha1(payload).hexdigest() == h["WARC-Payload-Digest"][5:]
            else:
                assert not payload and h["WARC-Refers-To-Page-ID"] == "1049" and "WARC-Refers-To-Target-URI" in h
    assert sorted(got, key=str) == sorted([(i, "revisit" if h == same and i != 1049 else "response") for i, _, h in rows], key=str)
    assert responses[1049] == same.encode() and responses[3000] == b""
    back = {(r.page_id, r.url) for r in warc.read(spark, str(tmp_path / "w")).collect()}
    assert back == {(i, u) for i, u, _ in rows}


def test_reading_is_linear_and_checks_frames():
    def timed(n):
        data = warc.pack([warc.record(i, f"http://x/{i}", b"<p>words %d" % (i * 7919) * 20, "0", 1, "http://x/1") for i in range(n)])
        t = time.process_time()
        assert sum(1 for _ in warc.records(data)) == n
        return time.process_time() - t

    timed(500)
    assert timed(16_000) < 24 * max(timed(2_000), 0.01)
    data = warc.pack([warc.info("a"), warc.record(1, None, b"", hashlib.sha1(b"").hexdigest(), None)])
    assert [warc.parse(x) and warc.parse(x)["url"] for _, x in warc.records(data)] == [None, None]
    with pytest.raises(ValueError):
        list(warc.records(data[:-40]))


def test_long_frames_of_every_block_kind():
    import random

    rng = random.Random(1)
    parts = [b"\0" * 500_000, rng.randbytes(300_000), b"abc " * 100_000, b""]
    held = [warc.record(i, "u", p, hashlib.sha1(p).hexdigest(), None) for i, p in enumerate(parts)]
    assert [x for _, x in warc.records(warc.pack(held))] == held
