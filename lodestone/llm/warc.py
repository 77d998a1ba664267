"""WARC archives: one gzip member per record, indexed first, read by coalesced byte ranges.

Writing: each task writes its records to archives of about ARCHIVE_BYTES bytes
at most, every record a gzip member of its own, under a temporary name that a
rename makes final.

Reading: an index is made first, a row per record (file, offset, length, URL,
digest and the other headers), by walking each file from member to member.
Selected records are then fetched by byte ranges: sorted by file and offset,
ranges with small gaps between them are fetched in one read.

Of records with equal payloads of at least LEAST_BYTES bytes the one with the
largest identifier holds the payload; the others are revisit records.

Defined cases: a null payload counts as empty, a null URL as an empty one; line
ends in a URL are escaped; equal payloads below LEAST_BYTES are all responses;
of repeated rows (same identifier, same payload) the one with the largest URL,
or one of identical rows, is the response; a null identifier ranks below all
others and is written as "-"; an empty table writes no archive and reads as no
rows.  A payload or URL of any length is written and read whole; other columns
are left out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh_path, quoted, read_table, stored
from .files import read_range, store, write_whole

LEAST_BYTES = 1000
#: A group of equal payloads is matched to its response in salts of this many records.
SALT_ROWS = 2_000
#: Ranges this close are fetched together, up to READ_BYTES.
GAP_BYTES = 64 << 10
READ_BYTES = 4 << 20
_WALK_BYTES = 1 << 17
#: An archive is closed and the next one begun when it has this many bytes.
ARCHIVE_BYTES = 1 << 30
_DATE = "2020-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "file string, offset long, length long, record_type string, url string, payload_digest string, page string, refers_to string"


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """A row per page: page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to."""
    rows = pages.select(quoted(id_col).cast("long").alias("page_id"), F.coalesce(quoted(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(quoted(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    light = rows.select("page_id", "url", "payload_bytes", "payload_digest")
    # pages that share their payload, with the page that holds it
    shared = light.where(F.col("payload_bytes") >= LEAST_BYTES).groupBy("payload_digest", "page_id", "url").agg(F.count("*").alias("same"))
    groups = shared.groupBy("payload_digest").agg(F.max(F.struct("page_id", "url")).alias("first"), F.sum("same").alias("n")).where("n > 1")
    shared = shared.join(groups, "payload_digest").select(F.col("payload_digest").alias("d"), F.col("page_id").alias("p"), F.col("url").alias("u"), "first", "same")
    match = (F.col("payload_digest") == F.col("d")) & F.col("page_id").eqNullSafe(F.col("p")) & (F.col("url") == F.col("u"))
    is_first = F.col("page_id").eqNullSafe(F.col("first.page_id")) & (F.col("url") == F.col("first.url"))
    marked = rows.join(shared, match, "left").withColumn("holds", F.col("d").isNull() | is_first)
    again = shared.where(F.col("p").eqNullSafe(F.col("first.page_id")) & (F.col("u") == F.col("first.url")) & (F.col("same") > 1))
    if not again.isEmpty():  # identical rows: one of them holds the payload
        several = F.coalesce(is_first & (F.col("same") > 1), F.lit(False))
        number = F.row_number().over(W.partitionBy("payload_digest", "page_id", "url").orderBy(F.lit(1)))
        marked = marked.where(~several).unionByName(marked.where(several).withColumn("holds", number == 1))
    return marked.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(F.col("holds"), "response").otherwise("revisit").alias("record_type"), F.when(~F.col("holds"), F.col("first.page_id")).alias("refers_to"))


def _member(row: dict) -> bytes:
    """One record as a gzip member."""
    name = lambda v: f"<urn:page:{'-' if v is None else v}>"
    held = row["record_type"] == "response"
    payload = row["payload"].encode("utf-8") if held else b""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode() + payload
    url = row["url"].replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {name(row['page_id'])}", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{row['payload_digest']}", "Content-Type: application/http; msgtype=response"]
    head += [] if held else [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {name(row['refers_to'])}"]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode("utf-8") + block + b"\r\n\r\n") + pack.flush()


def write(pages: DataFrame, out_dir: str, **columns: str) -> int:
    """Writes the archives; returns the number of records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = (row for batch in batches for lo in range(0, len(batch), 64) for row in batch.slice(lo, 64).to_pylist())
        n = 0

        def members(row: dict | None) -> Iterator[bytes]:
            """One archive's records, beginning with row."""
            nonlocal n
            held = 0
            while row is not None:
                n += 1
                member = _member(row)
                held += len(member)
                yield member
                row = next(rows, None) if held < ARCHIVE_BYTES else None

        for k, first in enumerate(iter(lambda: next(rows, None), None)):
            write_whole(f"{out_dir}/records-{TaskContext.get().partitionId():06d}-{k:04d}.warc.gz", members(first))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    # in a fixed order, so that a repeated task fills its archives with the same records
    ordered = records(pages, **columns).sortWithinPartitions("page_id", "url", "payload_digest", "record_type")
    return ordered.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _walk(f, size: int) -> Iterator[tuple[int, int, bytes]]:
    """All members of one open file: offset, length, the record up to the blank line behind its headers (and a little more)."""
    begin, at = 0, 0
    unpack, head = zlib.decompressobj(31), bytearray()
    raw = b""
    while at < size or raw:
        if not raw:
            raw = f.read_at(min(_WALK_BYTES, size - at), at)
            at += len(raw)
        out = unpack.decompress(raw)
        if head.find(b"\r\n\r\n") < 0:
            head += out
        raw = b""
        if unpack.eof:
            end = at - len(unpack.unused_data)
            yield begin, end - begin, bytes(head)
            raw, begin = unpack.unused_data, end
            unpack, head = zlib.decompressobj(31), bytearray()
    if begin != size:
        raise ValueError("the archive ends inside a record")


def _headers(head: bytes) -> dict[str, str]:
    end = head.find(b"\r\n\r\n")
    if end < 0 or not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in head[:end].decode("utf-8").split("\r\n")[1:])}


def payload_of(member: bytes) -> bytes:
    """The HTTP payload of a response record."""
    record = zlib.decompress(member, 31)
    skip = record.find(b"\r\n\r\n") + 4
    block = record[skip : skip + int(_headers(record)["content-length"])]
    return block[block.find(b"\r\n\r\n") + 4 :]


def build_index(spark: SparkSession, out_dir: str) -> DataFrame:
    """The index, a row per record, from the archives alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in INDEX.split(", ")]
        kinds = [pa.int64() if c.endswith("long") else pa.string() for c in INDEX.split(", ")]
        name = lambda v: None if v is None else v.removeprefix("<urn:page:").removesuffix(">")
        for batch in batches:
            for uri, size in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
                system, path = store(uri)
                with system.open_input_file(path) as f:
                    rows: list[tuple] = []
                    for at, length, head in _walk(f, size):
                        h = _headers(head)
                        rows.append((uri, at, length, h["warc-type"], h.get("warc-target-uri", ""), h.get("warc-payload-digest", "").removeprefix("sha1:"), name(h["warc-record-id"]), name(h.get("warc-refers-to"))))
                        if len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(out_dir).select("path", "length")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return stored(files.repartition(tasks, "path").mapInArrow(run, INDEX), "index")


def fetch(selected: DataFrame) -> DataFrame:
    """Payloads of the selected index rows that hold one: the index columns, then payload (binary).

    A span is READ_BYTES of a file; spans are dealt over tasks, each reads its
    records in order of their offset, neighbours in one read.
    """
    spark = selected.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = selected.withColumn("span", F.floor(F.col("offset") / READ_BYTES)).repartition(tasks, "file", "span").sortWithinPartitions("file", "offset").select(*[c.split()[0] for c in INDEX.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            i = 0
            while i < len(rows):
                j, begin, end = i, rows[i]["offset"], rows[i]["offset"] + rows[i]["length"]
                while j + 1 < len(rows) and rows[j + 1]["file"] == rows[i]["file"] and rows[j + 1]["offset"] - end <= GAP_BYTES and rows[j + 1]["offset"] + rows[j + 1]["length"] - begin <= READ_BYTES:
                    j += 1
                    end = rows[j]["offset"] + rows[j]["length"]
                raw = read_range(rows[i]["file"], begin, end - begin)
                own = [payload_of(raw[r["offset"] - begin : r["offset"] - begin + r["length"]]) for r in rows[i : j + 1]]
                part = batch.slice(i, j + 1 - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own, pa.binary())], names=[*part.schema.names, "payload"])
                i = j + 1

    return dealt.mapInArrow(run, f"{INDEX}, payload binary")


def checked(index: DataFrame) -> DataFrame:
    """Reads all payloads back and resolves revisits; a digest that doesn't fit its payload is an error.

    One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, url.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = batch.column("payload").to_pylist()
            found = [hashlib.sha1(p).hexdigest() for p in payloads]
            yield pa.RecordBatch.from_arrays([batch.column("page"), batch.column("url"), batch.column("payload_digest"), pa.array(found), pa.array([len(p) for p in payloads], pa.int64())], names=["page", "url", "told", "found", "bytes"])

    held = fetch(index.where("record_type = 'response'")).mapInArrow(digests, "page string, url string, told string, found string, bytes long")
    right = F.when(F.col("told") == F.col("found"), F.col("found")).otherwise(F.raise_error(F.concat(F.lit("wrong digest of page "), F.col("page"))))
    held = stored(held.select("page", "url", right.alias("payload_digest"), F.col("bytes").alias("payload_bytes")), "payloads")
    own = held.select(F.expr("try_cast(page as long)").alias("page_id"), "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "url")

    # revisits take bytes and digest from the record that they refer to; a large group is dealt over salts
    seen = index.where("record_type = 'revisit'").select("page", "url", "refers_to", "payload_digest")
    sizes = seen.groupBy("refers_to", "payload_digest").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"))
    targets = held.select(F.col("page").alias("refers_to"), "payload_digest", "payload_bytes").join(sizes, ["refers_to", "payload_digest"]).dropDuplicates(["refers_to", "payload_digest"])
    salted = targets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    visits = seen.join(sizes, ["refers_to", "payload_digest"]).withColumn("salt", F.pmod(F.xxhash64("page", "url"), F.col("salts")).cast("int"))
    resolved = visits.join(salted.drop("salts"), ["refers_to", "payload_digest", "salt"], "left")
    bytes_ = F.when(F.col("payload_bytes").isNotNull(), F.col("payload_bytes")).otherwise(F.raise_error(F.concat(F.lit("no response for the revisit of "), F.col("page"))).cast("long"))
    revisits = resolved.select(F.expr("try_cast(page as long)").alias("page_id"), bytes_.alias("payload_bytes"), "payload_digest", F.lit("revisit").alias("record_type"), F.expr("try_cast(refers_to as long)").alias("refers_to"), "url")
    return own.unionByName(revisits)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    out_dir = fresh_path(spark, "warc")
    if not write(read_table(spark, sf_dir, "pages"), out_dir):
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return checked(build_index(spark, out_dir)).drop("url")


OP6_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS first_id, count(*) AS n FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN g.n > 1 AND p.page_id <> g.first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.n > 1 AND p.page_id <> g.first_id THEN g.first_id END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND p.payload_bytes >= 1000
"""
