import gzip
import hashlib
import os
import random

import pytest

from rillflow.llm import common, warc

PAGES = "page_id long, url string, html string, digest int"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], PAGES)


def brute(rows):
    large = {}
    for p, _, h in rows:
        if len((h or "").encode()) >= 1000:
            large.setdefault(h, []).append(p)
    out = []
    for p, _, h in rows:
        data = (h or "").encode()
        ids = [x for x in large.get(h, []) if x is not None]
        target = max(ids) if len(large.get(h, [])) > 1 and ids else p
        out.append((p, len(data), hashlib.sha1(data).hexdigest(), "response" if target == p else "revisit", None if target == p else target))
    return sorted(out, key=repr)


def sample():
    rng = random.Random(1)
    noise = "".join(rng.choice("abcdefé<>\n\x1f\x8b\x08") for _ in range(5000))
    rows = [(i, f"http://h/{i}", rng.choice([f"<p>{i}</p>" * rng.randrange(1, 400), "same " * 300, "tiny", "x" * 999, "x" * 1000, noise])) for i in range(150)]
    return [*rows, (1000, None, None), (1001, "u\r\nX: y", ""), (None, "n", "nul page"), (None, "n", "same " * 300), rows[0], (1002, "big", "long text " * 100_000), (1003, "b", noise + str(rng.random()))]


def test_round_trip(spark):
    rows = sample()
    got = warc.round_trip(pages_of(spark, rows)).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == brute(rows)


@pytest.mark.parametrize("split", [64, 1000, 4096, 1 << 22])
def test_each_record_is_read_once_at_any_split(spark, split):
    rows = sample()[:40] + sample()[-2:]
    folder = f"{common.shared_dir(spark)}/warc-test-{split}"
    manifest, _ = common.materialize(warc.write(warc.marked(pages_of(spark, rows)).repartition(3), folder), "m")
    got = warc.read(manifest, payloads=True, split=split).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == brute(rows)
    html = {p: h for p, _, h in rows}
    assert all(r.payload.decode() == (html[r.page_id] or "") for r in got if r.record_type == "response" and r.page_id is not None)
    for f in manifest.collect():  # each file is plain concatenated gzip
        with gzip.open(f.path.removeprefix("file://")) as file:
            assert file.read().count(b"WARC/1.1\r\n") >= f.records
        assert os.path.getsize(f.path.removeprefix("file://")) == f.bytes


def test_chance_magic_is_no_record(tmp_path):
    member = warc._member(warc._record(7, "u", b"p" * 3000, hashlib.sha1(b"p" * 3000).hexdigest(), None))
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"\x1f\x8b\x08junk" + gzip.compress(b"no warc") + member + member)
    size = path.stat().st_size
    assert [r[0] for r in warc.records(str(path), 0, size, size)] == [7, 7]
    cut = size - len(member)
    assert [r[0] for r in warc.records(str(path), 0, cut, size)] == [7]
    assert [r[0] for r in warc.records(str(path), cut, size, size)] == [7]


def test_empty(spark):
    assert warc.round_trip(pages_of(spark, [])).count() == 0


def test_long_gzip_header(tmp_path):
    """A member whose gzip header alone passes some thousand bytes is found from the start of a range."""
    import struct
    import zlib

    record = warc._record(7, "u", b"p" * 3000, hashlib.sha1(b"p" * 3000).hexdigest(), None)
    raw = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = raw.compress(record) + raw.flush()
    for size in (10, 5000, 600_000):
        member = b"\x1f\x8b\x08\x08" + bytes(6) + b"n" * size + b"\0" + body + struct.pack("<II", zlib.crc32(record), len(record))
        path = tmp_path / f"{size}.warc.gz"
        path.write_bytes(b"noise" + member + warc._member(record))
        assert [r[0] for r in warc.records(str(path), 0, path.stat().st_size, path.stat().st_size)] == [7, 7]
