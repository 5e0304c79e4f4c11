"""WARC archives with revisit resolution.

Pages are written as archives of response records, a record per page.  Reading them back yields
headers and payloads; the headers alone are shuffled by payload digest, the least record of each
digest answers for the others, and deduplicated archives are written in which the others are revisit
records with fresh headers and no payload.

Archives are text files whose line separator is the blank line that ends a record, so Spark's own
writer and reader move them in any store they can reach; they are gzip-compressed as a whole.  Reading is
a stream: the pieces between blank lines are joined again until a record has the length its header states,
so a task holds one record, however large the archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from urllib.parse import unquote_plus

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segspark.ship import ensure

from . import sketch
from .common import Scratch, same

CRLF = "\r\n"
END = b"\r\n\r\n"
#: Pages carry no time of capture.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "
#: Records in one archive file: so many share a task when they are read.
FILE_RECORDS = 2000
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def digest32(hex_digest: Column) -> Column:
    """Upper-case base32 of a 160-bit hex digest: five hex digits are four of base 32."""
    parts = [F.lpad(F.conv(F.substring(hex_digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _header(lines: list[tuple[str, Column]]) -> Column:
    """Header block; a line whose value is null is left out."""
    rows = [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")) for name, value in lines]
    return F.concat(F.lit(f"WARC/1.1{CRLF}"), *rows, F.lit(CRLF))


def _urn(page: Column, digest: Column, stage: str) -> Column:
    """A record's name: page, payload and, as every archive has records of its own, the archive's stage."""
    return F.concat(F.lit("<urn:page:"), F.url_encode(page.cast("string")), F.lit(":"), digest, F.lit(f":{stage}>"))


def _clean(url: Column) -> Column:
    return F.regexp_replace(url, r"[\x00-\x20\x7F]+", "")


def _block(body: Column) -> Column:
    """What a response record holds: an HTTP response with the payload."""
    return F.concat(F.lit(HTTP), F.octet_length(body).cast("string"), F.lit(CRLF * 2), body)


def response_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """One column ``value``: a response record per row, without the blank line that ends it."""
    body = F.coalesce(F.col(body_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), _clean(F.col(url_col)).alias("url"), digest32(F.sha1(body)).alias("digest"), _block(body).alias("block"))
    head = _header([
        ("WARC-Type", F.lit("response")),
        ("WARC-Record-ID", _urn(F.col("page_id"), F.col("digest"), "captured")),
        ("WARC-Date", F.lit(DATE)),
        ("WARC-Target-URI", F.col("url")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length("block").cast("string")),
    ])
    return rows.select(F.concat(head, "block").alias("value"))


def write_archive(records: DataFrame, path: str, file_records: int = FILE_RECORDS) -> None:
    records.write.mode("overwrite").option("lineSep", CRLF * 2).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", file_records).text(path)


def parse(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(headers, block)`` of each record of archives that come as what stands between their blank lines.

    Blocks are taken by length, whatever they hold; a record that does not begin or end as it should raises.
    """
    data, at, head, need = bytearray(), 0, None, 0
    for piece in pieces:
        data += piece
        data += END
        while True:
            if head is None:
                stop = data.find(END, at)
                if stop < 0:
                    break
                lines = data[at:stop].decode("utf-8").split(CRLF)
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"no record here: {lines[0][:40]!r}")
                head = dict(line.split(": ", 1) for line in lines[1:])
                at, need = stop + 4, int(head["Content-Length"])
            if len(data) - at < need + 4:
                break
            if data[at + need : at + need + 4] != END:
                raise ValueError(f"{head.get('WARC-Record-ID')} does not end with a blank line")
            yield head, bytes(data[at : at + need])
            at, head = at + need + 4, None
        if at > 1 << 16 or at == len(data):
            del data[:at]
            at = 0
    if head is not None or at < len(data):
        raise ValueError("an archive ends within a record")


READ = "page_id string, url string, kind string, digest string, octets long, refers string, refers_url string, payload string, mark long"
FIELDS = tuple(x.split()[0] for x in READ.split(", "))
ROWS = 512
ROW_BYTES = 8 << 20


def read_archive(spark, path: str, payloads: bool = True, shared=None, among: bool = True, id_type: str = "bigint") -> DataFrame:
    """Records of the archives under ``path``, each payload checked against its stated digest.

    ``octets`` is the full payload's size, also for a revisit; ``mark`` is the digest's first 64 bits.
    With a broadcast ``shared`` (which cells hold a mark) only records in those cells are read, or, if not
    ``among``, only the others.  Ids stand in the record names as escaped texts, and are read as ``id_type``.
    """

    def named(urn: str | None):
        m = re.match(r"<urn:page:([^:>]*):", urn or "")
        return unquote_plus(m[1]) if m else None

    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(FIELDS))

    def run(batches):
        wanted = shared.value if shared else None
        pieces = (x.as_py() for batch in batches for x in batch.column("value").cast(pa.binary()))
        rows: list[tuple] = []
        held = 0
        for head, block in parse(pieces):
            digest = head.get("WARC-Payload-Digest", "").removeprefix("sha1:")
            revisit = head["WARC-Type"] == "revisit"
            mark = int.from_bytes(base64.b32decode(digest)[:8], "big", signed=True)
            if wanted is not None and wanted[sketch.cells(np.array([mark], np.int64).view(np.uint64))[0]] != among:
                continue
            body = block if revisit else block[block.index(END) + 4 :]
            if not revisit and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                raise ValueError(f"payload of {head.get('WARC-Record-ID')} does not have its digest")
            rows.append((named(head.get("WARC-Record-ID")), head.get("WARC-Target-URI"), head["WARC-Type"], digest, int(head.get("X-Payload-Length", len(body))), named(head.get("WARC-Refers-To")), head.get("WARC-Refers-To-Target-URI"), body.decode("utf-8") if payloads else None, mark))
            held += len(body) if payloads else 0
            if len(rows) == ROWS or held > ROW_BYTES:
                yield batch_of(rows)
                rows, held = [], 0
        if rows:
            yield batch_of(rows)

    ensure(spark)
    # a compressed file is never split, so every record is whole within a task
    pieces = spark.read.option("lineSep", CRLF * 2).option("pathGlobFilter", "*.gz").schema("value string").text(path)
    return pieces.mapInArrow(run, READ).withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers")})


def resolve(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, octets, digest, kind, refers, refers_url`` from ``page_id, url, octets, digest``.

    Of records with equal payloads of at least ``least_bytes``, the one with the least id is the
    response.  Only headers move; minima are combined before the shuffle, and the join sides are plain
    exchanges, so a digest that a third of all records share is split at run time.
    """
    firsts = headers.where(F.col("octets") >= least_bytes).groupBy("digest", "octets").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = firsts.where("n > 1").select("digest", "octets", F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url"))
    firsts = Scratch(headers.sparkSession, "warc-firsts").save(firsts, "firsts")
    out = headers.join(firsts, ["digest", "octets"], "left")
    again = F.col("first").isNotNull() & ~same("first", "page_id")
    return out.select("page_id", "octets", "digest", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first")).alias("refers"), F.when(again, F.col("first_url")).alias("refers_url"))


def final_records(rows: DataFrame) -> DataFrame:
    """Records of ``page_id, url, payload, octets, digest, kind, refers, refers_url``: payloads of responses, fresh headers for all."""
    revisit = F.col("kind") == "revisit"
    rows = rows.withColumn("block", F.when(revisit, F.lit("")).otherwise(_block(F.col("payload"))))
    head = _header([
        ("WARC-Type", F.col("kind")),
        ("WARC-Record-ID", _urn(F.col("page_id"), F.col("digest"), "resolved")),
        ("WARC-Date", F.lit(DATE)),
        ("WARC-Target-URI", F.col("url")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        ("WARC-Refers-To", F.when(revisit, _urn(F.col("refers"), F.col("digest"), "resolved"))),
        ("WARC-Refers-To-Target-URI", F.when(revisit, F.col("refers_url"))),
        ("WARC-Refers-To-Date", F.when(revisit, F.lit(DATE))),
        ("X-Payload-Length", F.when(revisit, F.col("octets").cast("string"))),
        ("Content-Type", F.when(~revisit, F.lit("application/http; msgtype=response"))),
        ("Content-Length", F.octet_length("block").cast("string")),
    ])
    return rows.select(F.concat(head, "block").alias("value"))


def deduplicated_records(spark, path: str, decided: DataFrame, shared: np.ndarray, id_type: str = "bigint") -> DataFrame:
    """Records of the deduplicated archives from those under ``path``.

    Payloads whose digest nobody shares are responses as they come; only the others meet their decision
    in a join.  ``shared`` has 1 MB whatever the input, and an entry too many costs a row in the join.
    """
    cells = spark.sparkContext.broadcast(shared)
    kept = ["page_id", "url", "payload", "octets", "digest", "kind", "refers", "refers_url"]
    alone = read_archive(spark, path, True, cells, False, id_type).select(*kept)
    body = read_archive(spark, path, True, cells, id_type=id_type).select(F.col("page_id").alias("pid"), F.col("digest").alias("sum"), "url", "payload")
    both = body.join(decided.hint("shuffle_hash"), same("pid", "page_id") & (F.col("sum") == F.col("digest")))
    return final_records(alone.unionByName(both.select(*kept)))


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least_bytes: int = 0) -> tuple[DataFrame, str]:
    """Writes, reads back and deduplicates; returns a row per page and the path of the new archives.

    Null payloads are empty; a null url leaves out its header line; null ids count as greater than any
    other when responses are chosen, and repeated rows with the response's id are responses too.  Extra
    columns are ignored; an empty table gives no rows.  A damaged archive raises.  Ids may be of any type that
    Spark casts to text and back; they are compared as that type.
    """
    spark = pages.sparkSession
    scratch, id_type = Scratch(spark, "warc"), dict(pages.dtypes)[id_col]
    write_archive(response_records(pages, id_col, url_col, body_col), scratch.path("raw"))
    headers = scratch.save(read_archive(spark, scratch.path("raw"), False, id_type=id_type).select("page_id", "url", "octets", "digest", "mark"), "headers")
    decided = scratch.save(resolve(headers, least_bytes), "decided")
    once = decided.dropDuplicates(["page_id", "digest"])
    twice = headers.groupBy("digest").agg(F.first("mark").alias("mark"), F.count(F.lit(1)).alias("n")).where("n > 1")
    write_archive(deduplicated_records(spark, scratch.path("raw"), once, sketch.key_filter(twice, "mark"), id_type), scratch.path("dedup"))
    return decided, scratch.path("dedup")


ORACLE = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS n, sha1(b) AS h FROM p),
b AS (SELECT DISTINCT h, array_to_string(list_transform(range(0, 8), lambda i:
        array_to_string(list_transform([15, 10, 5, 0], lambda s:
          substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (1 + 5 * i)::BIGINT, 5))::BIGINT >> s) & 31) + 1, 1)), '')), '') AS d32 FROM d)
SELECT page_id, n AS payload_bytes, d32 AS payload_digest,
       CASE WHEN page_id = min(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> min(page_id) OVER w THEN min(page_id) OVER w END AS refers_to
FROM d JOIN b USING (h) WINDOW w AS (PARTITION BY h, n)
"""


def query(spark, sf_dir: str) -> DataFrame:
    """From the deduplicated archives, read back: every column is what the archive says."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    _, path = archive(pages)
    out = read_archive(spark, path, False, id_type=dict(pages.dtypes)["page_id"])
    return out.select("page_id", F.col("octets").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("refers").alias("refers_to"))
