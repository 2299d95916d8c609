import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from medlake.llm import warc
from medlake.session import scratch_path

ROWS = [(1, "http://a/\n1", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://a/3", None), (4, "http://a/4", ""), (5, "u", "x" * 300000),
        (5, "u", "x" * 300000), (6, "u", "only\r\n\r\nonce"), (None, "n", "<p>é</p>"), (None, "n", "lonely null")]


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def frame(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    return df.withColumns({c: F.lit("x") for c in ("rk", "digest", "last", "again", "payload", "n")})


def brute(rows):
    out = []
    for i, _, h in rows:
        same = [r[0] for r in rows if (r[2] or "") == (h or "") and r[0] is not None]
        last = max(same) if same else None
        new = i == last
        out.append((i, len((h or "").encode()), b32(h), "response" if new else "revisit", None if new else last))
    return out


def key(t):
    return tuple((x is not None, str(x)) for x in t)


def test_round_trip(spark):
    got = [tuple(r) for r in warc.warc_report(frame(spark, ROWS)).collect()]
    assert sorted(got, key=key) == sorted(brute(ROWS), key=key)


def test_empty_table(spark):
    assert warc.warc_report(frame(spark, [])).count() == 0


@pytest.fixture(scope="module")
def archive(spark):
    path = scratch_path(spark, "test-warc")
    warc.archive_pages(frame(spark, ROWS), path)
    return path


def test_filters_are_pushed_and_right(spark, archive):
    df = spark.read.format("warc").load(archive)
    assert df.filter("record_type = 'revisit'").count() == 3
    one = df.filter(F.col("record_id").isin("<urn:x-page:6>", "<urn:x-page:77>"))
    assert one.select("payload").first()["payload"] == bytearray(b"only\r\n\r\nonce")
    reader = warc.WarcReader({"path": archive})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In
    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), In(("record_id",), ("a", "b")), GreaterThan(("date",), "2")]))
    assert len(left) == 1 and len(reader.tests) == 2
    assert spark.read.format("warc").option("payload", "false").load(archive).filter("payload is not null").count() == 0


def test_members_are_plain_gzip_and_skippable():
    a = warc.record_bytes({"WARC-Type": "response", "WARC-Record-ID": "1", "Content-Type": "text/plain"}, b"first" * 9000)
    b = warc.record_bytes({"WARC-Type": "metadata", "WARC-Record-ID": "2"}, b"second")
    both = warc.gzip_member(a) + warc.gzip_member(b)
    assert gzip.decompress(both) == a + b
    plain = gzip.compress(a) + gzip.compress(b)
    for raw, zipped in ((both, True), (plain, True), (a + b, False)):
        all_ = list(warc.records(io.BytesIO(raw), zipped, lambda h: True, True))
        assert [x for _, x in all_] == [b"first" * 9000, b"second"]
        only = list(warc.records(io.BytesIO(raw), zipped, lambda h: h["WARC-Type"] == "metadata", True))
        assert [(h["WARC-Record-ID"], x) for h, x in only] == [("2", b"second")]
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(both[:-9]), True, lambda h: True, True))


def test_commit_leaves_no_work_folder(archive):
    from pyarrow import fs
    found = fs.LocalFileSystem().get_file_info(fs.FileSelector(archive, recursive=True))
    assert found and all("/." not in f.path[len(archive):] for f in found)


class Counting(io.BytesIO):
    """Counts the bytes that are really read."""
    n = 0

    def read(self, size=-1):
        got = super().read(size)
        self.n += len(got)
        return got


def test_unwanted_payloads_of_foreign_members_are_not_kept():
    import tracemalloc
    big = warc.record_bytes({"WARC-Type": "request", "WARC-Record-ID": "big"}, b"ab" * (40 << 20))
    small = warc.record_bytes({"WARC-Type": "response", "WARC-Record-ID": "small"}, b"kept")
    raw = gzip.compress(big, 1) + gzip.compress(small)
    del big
    tracemalloc.start()
    got = list(warc.records(io.BytesIO(raw), True, lambda h: h.get("WARC-Type") == "response", True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(h["WARC-Record-ID"], x) for h, x in got] == [("small", b"kept")]
    assert peak < 4 << 20
    heads = list(warc.records(io.BytesIO(raw), True, lambda h: True, False))
    assert [(h["WARC-Record-ID"], x) for h, x in heads] == [("big", None), ("small", None)]


def test_unwanted_own_members_are_passed_over_unread():
    import random
    noise = random.Random(1).randbytes(5 << 20)
    raw = b"".join(warc.gzip_member(warc.record_bytes({"WARC-Type": t, "WARC-Record-ID": t + "1"}, noise)) for t in ("request", "response"))
    stream = Counting(raw)
    got = list(warc.records(stream, True, lambda h: h["WARC-Type"] == "response", True))
    assert [x for _, x in got] == [noise] and stream.n < len(raw) - (4 << 20)
    assert [x for _, x in warc.records(io.BytesIO(raw), True, lambda h: True, True)] == [noise, noise]
    stream = Counting(raw)
    assert len(list(warc.records(stream, True, lambda h: True, False))) == 2 and stream.n < 1 << 20
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(raw[:-9]), True, lambda h: h["WARC-Type"] == "request", True))


def test_long_headers_and_odd_members():
    long = {"WARC-Type": "response", "WARC-Record-ID": "x" * 300_000}
    block = bytes(range(256)) * 2000
    for pack in (gzip.compress, warc.gzip_member):
        raw = pack(warc.record_bytes(long, block)) + pack(warc.record_bytes({"WARC-Type": "a"}, b""))
        assert [(len(h["WARC-Record-ID"]), x) for h, x in warc.records(io.BytesIO(raw), True, lambda h: "WARC-Record-ID" in h, True)] == [(300_000, block)]
    # a member that holds no whole head counts as one without headers
    assert list(warc.records(io.BytesIO(gzip.compress(b"")), True, lambda h: True, True)) == [({}, b"")]
