"""WARC archives: writing with identical-payload revisits, reading, and transaction assembly.

Each capture is three records: a response (or a revisit of an earlier equal payload), the request, and metadata; the last two name the
first in WARC-Concurrent-To.  Rows are dealt by the digest of their payload, in which order the first of equal payloads is the response; revisits of
digests that the frequent-item summary names are found against a broadcast table of its size at most, so a payload that a third of all rows share is dealt
once.  Archives are written by Spark's text writer with the record separator as line end, so they may lie in any
store.  They hold about ``FILE_BYTES``, less where that gives fewer files than shuffle partitions; they are inflated and parsed by Content-Length piece by
piece.  Assembly follows concurrent-to identifiers, however many lie between, to the capture's first record and emits one nested row for each capture.

Defined cases: a null payload counts as empty; of equal payloads of at least ``min_bytes`` the one with the largest id (a null id is the smallest) is the
response and the others revisit it; rows that repeat an id, or are wholly equal, are captures of their own; a record whose capture is
missing, or whose identifiers run in a circle, yields no row; a capture without request or metadata has null fields, and what it has beyond one of each
is in ``others``; an empty table yields no rows; other columns pass by.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.support import discard, materialize, shared_path

FILE_BYTES = 256 << 20  # of records in one archive, about, before compression
LEAST_BYTES = 4 << 20
SUPPORT = 0.001  # of the frequent-item summary: at most 1,000 counters
DATE = "2020-01-01T00:00:00Z"
RECORD = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, payload_digest string, content_length long, fields map<string,string>, block binary"
PIECE = 1 << 20  # bytes inflated at a time


def payload_digest(payload: Column) -> Column:
    """The bare base32 SHA-1 of a binary column: five hexadecimal digits are four letters of five bits."""
    groups = [F.lpad(F.conv(F.substring(F.sha1(payload), 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def captures_of(pages: DataFrame, id_col: str = "page_id", uri: str = "url", payload: str = "html") -> DataFrame:
    """(page_id, uri, body, digest, payload_bytes) of each row."""
    own = pages.select(pages[id_col].alias("page_id"), F.regexp_replace(F.coalesce(F.col(uri), F.lit("")), r"[\r\n]", "").alias("uri"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("body"))
    data = F.col("body").cast("binary")
    return own.withColumn("digest", payload_digest(data)).withColumn("payload_bytes", F.octet_length("body").cast("long"))


def roles(captures: DataFrame, min_bytes: int = 0, files: int = 1) -> DataFrame:
    """``captures`` with revisit and refers_to (the page_id of the response), dealt to ``files`` partitions; revisits have an empty body."""
    sized = F.col("payload_bytes") >= min_bytes
    frequent = captures.where(sized).select("digest").freqItems(["digest"], SUPPORT).select(F.explode("digest_freqItems").alias("digest"))
    counted = captures.where(sized).select("digest", "page_id").join(F.broadcast(frequent), "digest", "left_semi").groupBy("digest")
    winners = materialize(counted.agg(F.max("page_id").alias("winner")), "winners")  # as many rows as counters at most
    rows = captures.join(F.broadcast(winners), "digest", "left").withColumn("copy", F.coalesce(sized & F.col("winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner")), F.lit(False)))
    copies = rows.where("copy").select("page_id", "uri", F.lit("").alias("body"), "digest", "payload_bytes", F.lit(True).alias("revisit"), F.col("winner").alias("refers_to"))
    # All others go by their digest; payloads below the least size go by their rows, as each is its own response.
    rest = rows.where("not copy").withColumn("own", F.when(~sized, F.monotonically_increasing_id()))
    equal = Window.partitionBy("digest", "own").orderBy(F.desc_nulls_last("page_id"))
    placed = rest.repartition(files, "digest", "own").withColumn("nth", F.row_number().over(equal)).withColumn("first", F.first("page_id").over(equal))
    again = F.col("nth") > 1
    decided = placed.select("page_id", "uri", F.when(again, "").otherwise(F.col("body")).alias("body"), "digest", "payload_bytes", again.alias("revisit"), F.when(again, F.col("first")).alias("refers_to"))
    return decided.unionByName(copies)


def _id(kind: str, key: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), key.cast("string"), F.lit(f":{kind}>"))


def _record(headers: list[tuple[str, Column | str]], block: Column) -> Column:
    """One record without the separator after it; headers whose value is null are left out."""
    lines = [F.concat(F.lit(f"{k}: "), v if isinstance(v, Column) else F.lit(v)) for k, v in headers]
    return F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *lines, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))), F.lit("\r\n\r\n"), block)


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", uri: str = "url", payload: str = "html") -> None:
    """Write three records for each row of ``pages``."""
    captures = captures_of(pages, id_col, uri, payload)
    total = (captures.agg(F.sum(F.col("payload_bytes") + 1000)).first()[0] or 0) + 1
    wide = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = roles(captures, min_bytes, -(-total // max(LEAST_BYTES, min(FILE_BYTES, total // wide))))
    revisit, sized = F.col("revisit"), F.col("payload_bytes") >= min_bytes
    # A response that others may name is known by its page and digest; other records by their place in this write.
    rows = rows.withColumn("key", F.coalesce(F.col("page_id").cast("string"), F.lit(""))).withColumn("place", F.monotonically_increasing_id().cast("string"))
    key, body = F.concat_ws(":", "key", "place"), F.col("body")
    named = lambda page: _id("response", F.concat_ws(":", page, "digest"))
    first = F.when(revisit, _id("revisit", key)).when(sized, named(F.col("key"))).otherwise(_id("response", key))
    refers = F.when(revisit, named(F.coalesce(F.col("refers_to").cast("string"), F.lit(""))))
    main = _record(
        [
            ("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))), ("WARC-Record-ID", first), ("WARC-Date", DATE), ("WARC-Target-URI", F.col("uri")),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), ("WARC-Refers-To", refers),
            ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))), ("Content-Type", "text/html"),
        ],
        body,
    )
    request = _record(
        [("WARC-Type", "request"), ("WARC-Record-ID", _id("request", key)), ("WARC-Date", DATE), ("WARC-Target-URI", F.col("uri")), ("WARC-Concurrent-To", first), ("Content-Type", "application/http; msgtype=request")],
        F.concat(F.lit("GET "), F.col("uri"), F.lit(" HTTP/1.1\r\n\r\n")),
    )
    # The metadata record names the request, which names the capture: identifiers are followed over two steps.
    metadata = _record(
        [("WARC-Type", "metadata"), ("WARC-Record-ID", _id("metadata", key)), ("WARC-Date", DATE), ("WARC-Concurrent-To", _id("request", key)), ("Content-Type", "application/warc-fields")],
        F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit("")), F.lit("payload-bytes: "), F.col("payload_bytes").cast("string"), F.lit("\r\n")),
    )
    records = rows.select(F.explode(F.array(main, request, metadata)).alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def inflate(data: memoryview) -> Iterator[bytes]:
    """An archive's bytes, piece by piece, whether or not it is compressed; several gzip members may follow one another."""
    if bytes(data[:2]) != b"\x1f\x8b":
        yield from (bytes(data[k : k + PIECE]) for k in range(0, len(data), PIECE))
        return
    while len(data):
        member, at = zlib.decompressobj(31), 0
        while not member.eof:
            given = member.unconsumed_tail or data[at : at + PIECE]
            if not member.unconsumed_tail:
                if not len(given):
                    raise ValueError("archive ends inside a gzip member")
                at += len(given)
            if out := member.decompress(given, PIECE):
                yield out
        data = data[at - len(member.unused_data) :]


class Pieces:
    """Bytes that arrive in pieces, read by number or up to a mark."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.at = pieces, bytearray(), 0

    def _more(self) -> bool:
        if self.at:
            del self.held[: self.at]
            self.at = 0
        piece = next(self.pieces, None)
        if piece is not None:
            self.held += piece
        return piece is not None

    def take(self, size: int) -> bytes:
        while len(self.held) - self.at < size and self._more():
            pass
        if len(self.held) - self.at < size:
            raise ValueError("archive ends inside a record")
        self.at += size
        return bytes(memoryview(self.held)[self.at - size : self.at])

    def until(self, mark: bytes) -> bytes | None:
        """The bytes before ``mark``, which is passed over; None at the end."""
        begin = self.at
        while (end := self.held.find(mark, begin)) < 0:
            done = len(self.held) - self.at
            if not self._more():
                if done:
                    raise ValueError("record header has no end")
                return None
            begin = self.at + max(0, done - len(mark) + 1)
        return self.take(end - self.at + len(mark))[: -len(mark)]


def parse(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive."""
    source = Pieces(pieces)
    while (head := source.until(b"\r\n\r\n")) is not None:
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no record where one should begin")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        yield headers, source.take(int(headers["content-length"]))
        source.take(4)


def read_archives(spark, path: str, blocks: bool = True) -> DataFrame:
    """One row for each record of the archives in ``path``; without ``blocks`` the blocks of responses are not returned."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    kinds = [pa.string()] * 6 + [pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
    names = [c.split()[0] for c in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for h, block in parse(inflate(memoryview(content.as_buffer()))):
                    fields = None
                    if h.get("content-type") == "application/warc-fields":
                        fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in block.decode().split("\r\n") if x)]
                    digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    if digest and h["warc-type"] == "response" and base64.b32encode(hashlib.sha1(block).digest()).decode() != digest:
                        raise ValueError(f"payload of {h['warc-record-id']} does not have its digest")
                    rows.append((
                        h["warc-record-id"], h["warc-type"], h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), digest, len(block), fields,
                        block if blocks else None,
                    ))
                    held += len(block) if blocks else 0
                    if len(rows) == 1000 or held > 8 * PIECE:
                        yield _batch(rows, kinds, names)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, kinds, names)

    return files.mapInArrow(run, RECORD)


def _batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: its response or revisit, request, metadata, and others (further records, by type and identifier).

    A record's capture is found by following concurrent-to identifiers until nothing changes; each round doubles how far they are followed.
    ``records`` is read several times, so it should be a written table.
    """
    head = F.col("type").isin("response", "revisit")
    links = materialize(records.where(~head & F.col("record_id").isNotNull()).groupBy("record_id").agg(F.min("concurrent_to").alias("capture")).where("capture is not null"), "links")
    changed, rounds = True, max(links.count(), 1).bit_length() + 1  # a longer chain would be a circle
    while changed and rounds:
        far = links.select(F.col("record_id").alias("capture"), F.col("capture").alias("further"))
        moved = materialize(links.join(far, "capture", "left").select("record_id", F.coalesce("further", "capture").alias("capture"), F.col("further").isNotNull().alias("moved")), "links")
        changed, rounds = not moved.where("moved").isEmpty(), rounds - 1
        discard(links)
        links = moved.drop("moved")
    nested = F.struct(*[F.col(c) for c in ("record_id", "type", "refers_to", "target_uri", "payload_digest", "content_length", "fields", "block")]).alias("record")
    others = records.where(~head).join(links, "record_id").select("capture", nested)
    every = records.where(head).select(F.col("record_id").alias("capture"), nested).unionByName(others)
    mine = every.groupBy("capture").agg(F.collect_list("record").alias("records"))  # one capture's
    # by type and identifier; a map has no order, so equal records of one identifier keep theirs
    less = lambda a, b: F.when(F.struct(a["type"], a["record_id"]) < F.struct(b["type"], b["record_id"]), -1).when(F.struct(a["type"], a["record_id"]) > F.struct(b["type"], b["record_id"]), 1).otherwise(0)
    mine = mine.withColumn("records", F.when(F.size("records") > 1, F.array_sort("records", less)).otherwise(F.col("records")))
    of = lambda *types: F.filter("records", lambda r: r["type"].isin(*types))
    rest = F.concat(F.filter("records", lambda r: ~F.coalesce(r["type"], F.lit("")).isin("response", "revisit", "request", "metadata")), *[F.slice(of(t), 2, 1 << 30) for t in ("metadata", "request")])
    out = mine.select("capture", F.get(of("response", "revisit"), 0).alias("response"), F.get(of("request"), 0).alias("request"), F.get(of("metadata"), 0).alias("metadata"), rest.alias("others"))
    return out.where("response is not null")


def op10_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = shared_path(spark, "archives")
    write_archives(pages, path)
    captures = assemble(materialize(read_archives(spark, path, blocks=False), "records"))
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+):", 1).try_cast("long")
    return captures.select(
        F.col("metadata.fields")["page-id"].cast("long").alias("page_id"), F.col("metadata.fields")["payload-bytes"].cast("long").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), F.col("response.type").alias("record_type"), number(F.col("response.refers_to")).alias("refers_to"),
    )


#: Equal payloads by their text; a digest is 32 letters of five bits.
ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, upper(sha1(html)) AS hex, max(page_id) OVER (PARTITION BY html) AS newest, row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST) AS nth FROM p)
SELECT page_id, cast(payload_bytes AS bigint) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           cast(((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::bigint >> (15 - 5 * (i % 4))) & 31) + 1 AS int), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN nth > 1 THEN newest END AS refers_to
FROM d
"""
