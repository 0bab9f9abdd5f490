import base64
import gzip
import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from auditloom.llm import warc
from tests.llm.fixtures import folder

SF = "/root/testdata/sf0.001"
HTML = ["<p>a</p>", None, "", "<p>a</p>", "WARC/1.1\r\nWARC-Type: response\r\n\r\nContent-Length: 7\r\n\r\n", "é日本🙂\r\n\r\n", "x" * 200_000, "<p>a</p>", "\n", "tail\r\n\r\n"]


def pages(spark, html):
    rows = [(k, None if k == 2 else f"http://h.example/{k}\r\nX: y" if k == 3 else f"http://h.example/{k}", h) for k, h in enumerate(html)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "page_id AS digest", "page_id AS refers_to")


def check(spark, path):
    bodies = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{path}/pages.parquet").collect()}
    best = defaultdict(int)
    for k, b in bodies.items():
        best[b] = max(best[b], k)
    rows = warc.op10_warc(spark, path).collect()
    assert len(rows) == len(bodies)
    for r in rows:
        b = bodies[r.page_id]
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        win = best[b] == r.page_id
        assert tuple(r) == (r.page_id, len(b), digest, "response" if win else "revisit", None if win else best[b])


def test_warc_round_trip(spark, tmp_path):
    check(spark, folder(pages(spark, HTML), tmp_path / "odd", "pages"))
    check(spark, folder(pages(spark, []), tmp_path / "none", "pages"))
    check(spark, SF)


def test_blocks_and_assembly(spark, tmp_path):
    df = pages(spark, HTML)
    warc.write_archives(df, f"{tmp_path}/archives", min_bytes=8)
    rows = warc.assemble(warc.read_archives(spark, f"{tmp_path}/archives")).collect()
    assert len(rows) == len(HTML)
    for r in rows:
        html = (HTML[int(r.metadata.fields["page-id"])] or "").encode()
        assert bytes(r.response.block) == (b"" if r.response.type == "revisit" else html)
        assert r.request.type == "request"
    assert sum(r.response.type == "revisit" for r in rows) == 2  # the two smaller ids of "<p>a</p>"; shorter payloads are all responses


def test_records_without_capture(spark):
    rows = [("<r>", "response", None), ("<q>", "request", "<r>"), ("<m>", "metadata", "<q>"), ("<lost>", "metadata", "<gone>"), ("<alone>", "response", None)]
    df = spark.createDataFrame([(a, b, c, None, None, None, 0, None, None) for a, b, c in rows], warc.RECORD)
    found = {r.capture: r for r in warc.assemble(df).collect()}
    assert set(found) == {"<r>", "<alone>"}
    assert (found["<r>"].request.record_id, found["<r>"].metadata.record_id, found["<alone>"].request) == ("<q>", "<m>", None)


def test_repeated_rows_are_captures_of_their_own(spark, tmp_path):
    one = pages(spark, ["<p>a</p>", "<p>b</p>"])
    df = one.unionByName(one).unionByName(one.withColumn("html", F.lit("other"))).unionByName(one.withColumn("page_id", F.lit(None).cast("long")))
    found = sorted(repr((r.page_id, r.payload_bytes, r.record_type, r.refers_to)) for r in warc.op10_warc(spark, folder(df, tmp_path, "pages")).collect())
    want = [(0, 8, "response", None), (1, 8, "response", None), (0, 8, "revisit", 0), (1, 8, "revisit", 1), (1, 5, "response", None), (0, 5, "revisit", 1), (None, 8, "revisit", 0), (None, 8, "revisit", 1)]
    assert found == sorted(map(repr, want))


def test_long_chains_and_further_records(spark):
    rows = [("<r>", "response", None), ("<q0>", "request", "<r>"), *[(f"<q{k}>", "request", f"<q{k - 1}>") for k in range(1, 12)], ("<m>", "metadata", "<q11>"), ("<c>", "conversion", "<m>"), ("<x>", "metadata", "<y>"), ("<y>", "metadata", "<x>")]
    df = spark.createDataFrame([(a, b, c, None, None, None, 0, None, None) for a, b, c in rows], warc.RECORD)
    (r,) = warc.assemble(df).collect()
    assert (r.capture, r.request.record_id, r.metadata.record_id) == ("<r>", "<q0>", "<m>")
    assert [o.record_id for o in r.others] == ["<c>", *sorted(f"<q{k}>" for k in range(1, 12))]


@pytest.mark.parametrize("piece", [1, 7, 64, 1 << 20])
def test_archives_in_pieces(monkeypatch, piece):
    monkeypatch.setattr(warc, "PIECE", piece)
    blocks = [b"", b"\r\n\r\n", b"WARC/1.1\r\n\r\n", b"x" * 1000]
    records = [b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(b), b) for b in blocks]
    for data in (b"".join(records), gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))):
        assert [b for _, b in warc.parse(warc.inflate(memoryview(data)))] == blocks
    with pytest.raises(ValueError):
        list(warc.parse(warc.inflate(memoryview(b"".join(records)[:-9]))))


def test_frequent_payloads(spark, tmp_path):
    df = pages(spark, ["hot"] * 400 + [f"<p>{k // 2}</p>" for k in range(300)])
    check(spark, folder(df, tmp_path, "pages"))
