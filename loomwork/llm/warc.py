"""WARC: records streamed as (record, chunk number) rows, written as archives by Spark's own writers and read back."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cleaned, discard, discard_path, shared_dir, shuffle_partitions, spill

CHUNKS = "uid long, record_id long, url string, chunk_no int, last boolean, chunk string, digest string, total long, payload string"
BREAK = "\r\nWARC/1.0\r\n"


def cut(text: str, most: int) -> Iterator[str]:
    """Pieces of at most `most` characters. Neither a piece nor its place between a header and the record's end
    shows BREAK, so that BREAK can delimit records: a payload that holds it is cut inside the version mark."""
    at, n = 0, len(text)
    while True:
        to = min(at + most, n)
        hit = f"\r\n{text[at:to]}\r\n".find(BREAK)
        if hit >= 0:
            to = at + hit + 4
        yield text[at:to]
        if to >= n:
            return
        at = to


def chunk_rows(most: int):
    """Of (uid, record_id, url, html): a row for each chunk, with the SHA-1 and the bytes of the payload up to its end
    (digest, total) and of the payload as a whole (payload)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for uid, rid, url, html in zip(
                *(batch.column(c) for c in ("uid", "record_id", "url", "html")), strict=True
            ):
                text, whole = html.as_py() or "", hashlib.sha1()
                for piece in cut(text, most):
                    whole.update(piece.encode())
                sha, total, done = hashlib.sha1(), 0, 0
                for no, piece in enumerate(cut(text, most)):
                    data = piece.encode()
                    sha.update(data)
                    total += len(data)
                    held += len(data)
                    done += len(piece)
                    rows.append(
                        (
                            uid.as_py(),
                            rid.as_py(),
                            url.as_py(),
                            no,
                            done == len(text),
                            piece,
                            sha.hexdigest(),
                            total,
                            whole.hexdigest(),
                        ),
                    )
                    if held > 1 << 22:
                        yield table(rows)
                        rows, held = [], 0
            if rows:
                yield table(rows)

    def table(rows):
        kinds = [
            pa.int64(),
            pa.int64(),
            pa.string(),
            pa.int32(),
            pa.bool_(),
            pa.string(),
            pa.string(),
            pa.int64(),
            pa.string(),
        ]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
            ["uid", "record_id", "url", "chunk_no", "last", "chunk", "digest", "total", "payload"],
        )

    return run


def chunk_table(pages: DataFrame, chunk_chars: int = 1 << 20) -> DataFrame:
    """pages as a written table of chunk rows. A null html is an empty payload (one empty chunk). Each row of pages has a
    uid of its own, given while the table is written, so that rows that repeat a page_id or have none stay apart."""
    columns = (
        F.col("page_id").cast("long").alias("record_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    )
    some = pages.select(F.monotonically_increasing_id().alias("uid"), *columns)
    return spill(some.mapInArrow(chunk_rows(chunk_chars), CHUNKS), "chunks")


def write_archives(pages: DataFrame, path: str, dedup_bytes: int = 1000, chunk_chars: int = 1 << 20) -> None:
    """One WARC/1.0 record per page; a payload of several chunks becomes a record and its continuations.

    Among equal payloads of at least dedup_bytes the largest page_id is the response and the others are revisit
    records without a block. Spark's text writer lays the bytes down, so the folder may be in any store it reaches:
    each row is followed by CRLF, and every part is one gzip member. Pages that repeat a page_id are one record each,
    and so are pages without one, which revisit nothing and are not revisited.
    """
    chunks = chunk_table(pages, chunk_chars)
    ends = chunks.where("last and record_id is not null").select("uid", "record_id", "payload", "total")
    first = ends.where(F.col("total") >= dedup_bytes).groupBy("payload", "total").agg(
        F.max("record_id").alias("first"), F.min("record_id").alias("low")
    ).where("low < first").drop("low")
    plan = ends.join(first, ["payload", "total"]).where(F.col("record_id") < F.col("first")).select("uid", "first")
    rows = chunks.join(plan, "uid", "left")
    revisit = F.col("first").isNotNull()
    kept = rows.where(~revisit | F.col("last"))
    clean = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20")
    stamp = F.when(revisit, "revisit").when(F.col("chunk_no") > 0, "continuation").otherwise("response")
    number = F.when(revisit, 0).otherwise(F.col("chunk_no"))
    block = F.when(stamp == "revisit", "").otherwise(F.col("chunk"))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
    name = lambda c, uid, no: F.concat_ws(
        ":",
        F.lit("<urn:page"),
        F.coalesce(c.cast("string"), F.lit("none")),
        uid.cast("string"),
        F.concat(no.cast("string"), F.lit(">")),
    )
    rid = lambda no: name(F.col("record_id"), F.col("uid"), no)
    several = ~F.col("last") | (F.col("chunk_no") > 0)
    head = F.concat(
        F.lit("WARC/1.0\r\n"), field("WARC-Type", stamp), field("WARC-Record-ID", rid(number)), field(
            "WARC-Date", F.lit("1970-01-01T00:00:00Z")
        ), field("WARC-Target-URI", clean),
        F.when(several & (stamp != "revisit"), field("WARC-Segment-Number", F.col("chunk_no") + 1)).otherwise(""),
        F.when(stamp == "continuation", field("WARC-Segment-Origin-ID", rid(F.lit(0)))).otherwise(""),
        F.when(
            F.col("last"),
            F.concat(
                field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
                field("WARC-Payload-Length", F.col("total")),
            ),
        ).otherwise(""),
        F.when(
            stamp == "revisit",
            F.concat(
                field("WARC-Refers-To", name(F.col("first"), F.lit(""), F.lit(0))),
                F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\n"),
            ),
        ).otherwise(""),
        F.lit("Content-Type: text/html\r\n"), field("Content-Length", F.octet_length(block)),
    )
    record = F.concat(head, F.lit("\r\n"), block, F.lit("\r\n"))
    kept.select(record.alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)
    discard(chunks)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of archives made by write_archives: header fields and block, one row per record or continuation."""
    raw = spark.read.option("lineSep", BREAK).text(path).where("length(value) > 0")
    text = F.when(F.col("value").startswith("WARC/1.0\r\n"), F.expr("substr(value, 11)")).otherwise(F.col("value"))
    get = lambda name: F.regexp_extract("head", rf"(?:^|\r\n){name}: ([^\r]*)", 1)
    parts = raw.select(text.alias("text")).select(
        F.expr("left(text, locate('\r\n\r\n', text) - 1)").alias("head"),
        F.expr("substr(text, locate('\r\n\r\n', text) + 4)").alias("rest"),
    )
    num = lambda c: F.expr(f"try_cast({c} as long)")
    fields = parts.select(
        get("WARC-Type").alias("type"),
        get("WARC-Record-ID").alias("id"),
        get("WARC-Target-URI").alias("url"),
        get("WARC-Refers-To").alias("to"),
        get("WARC-Payload-Digest").alias("payload"),
        get("WARC-Payload-Length").alias("length"),
        get("Content-Length").alias("size"),
        "rest",
    )
    block = F.col("rest").cast("binary").substr(F.lit(1), F.col("size").cast("int"))
    part = lambda c, i: num(
        f"nullif(regexp_extract({c}, '<urn:page:([^:]*):([^:]*):([0-9]+)>', {i}), '')"
    )
    own = (part("id", 1).alias("page_id"), part("id", 2).alias("uid"), part("id", 3).cast("int").alias("chunk_no"))
    stated = F.expr("nullif(regexp_replace(payload, '^sha1:', ''), '')")
    return fields.select(
        "type",
        *own,
        "url",
        part("to", 1).alias("refers_to"),
        stated.alias("stated"),
        num("nullif(length, '')").alias("stated_bytes"),
        block.alias("block"),
    )


RECORDS = "file string, record_id string, type string, uri string, headers map<string,string>, chunk_no int, last boolean, chunk binary, digest string, total long"


def parsed(most: int):
    """Of the lines of archives in order (file, start, line): the chunk rows of their records, found by Content-Length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, now = [], 0, None
        head, left = None, None  # header fields that are open, bytes of the payload that are to come
        sha, total, number, buffer = hashlib.sha1(), 0, 0, bytearray()

        def emit(last: bool) -> None:
            nonlocal number, total, held
            sha.update(buffer)
            total += len(buffer)
            held += len(buffer)
            rows.append(
                (
                    now,
                    head.get("warc-record-id"),
                    head.get("warc-type"),
                    head.get("warc-target-uri"),
                    list(head.items()) if not number else None,
                    number,
                    last,
                    bytes(buffer),
                    sha.hexdigest(),
                    total,
                ),
            )
            number += 1
            buffer.clear()

        def table() -> pa.RecordBatch:
            text = pa.string()
            kinds = (text, text, text, text, pa.map_(text, text), pa.int32(), pa.bool_(), pa.binary(), text, pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                [c.split()[0] for c in RECORDS.replace("map<string,string>", "map").split(", ")],
            )

        for batch in batches:
            for file, start, line in zip(*(batch.column(c) for c in ("file", "start", "line")), strict=True):
                if start.as_py():
                    raise ValueError(
                        f"{file.as_py()} is split within: compress it, or raise spark.sql.files.maxPartitionBytes"
                    )
                if file.as_py() != now:
                    if left is not None or head is not None:
                        raise ValueError(f"{now} ends within a record")
                    now = file.as_py()
                data = line.as_py()
                if left is not None:
                    data += b"\n"
                    take = data[:left]
                    left -= len(take)
                    for at in range(0, len(take), most):
                        piece = take[at : at + most]
                        if len(buffer) + len(piece) > most:
                            emit(False)
                        buffer += piece
                elif head is None:
                    if data.startswith(b"WARC/"):
                        head = {}
                    elif data.strip():
                        raise ValueError(f"{now} has no record where one should begin")
                elif data.strip():
                    name, _, value = data.decode("utf-8", "replace").partition(":")
                    head[name.strip().lower()] = value.strip()
                else:
                    left = int(head["content-length"])
                    sha, total, number = hashlib.sha1(), 0, 0
                if left == 0:
                    emit(True)
                    head = left = None
                if held > 1 << 22:
                    yield table()
                    rows, held = [], 0
        if left is not None or head is not None:
            raise ValueError(f"{now} ends within a record")
        if rows:
            yield table()

    return run


def read_warc(spark: SparkSession, path: str, chunk_bytes: int = 1 << 20) -> DataFrame:
    """Any WARC archives below path (gzip or plain) as chunk rows: file, record_id, type, uri, headers (names in lower
    case, on the first chunk), chunk_no, last, chunk, and the SHA-1 and number of the record's bytes up to there.

    Lines stream through a parser that finds blocks by their Content-Length, whatever bytes they hold, so a task holds
    a chunk and a line. A file is read by one task: gzip files are, a plain one must fit one split, else it is an error,
    as is one that ends within a record.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(path)
    lines = lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("line"),
    )
    return lines.mapInArrow(parsed(chunk_bytes), RECORDS)


def digest_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks of segmented payloads, one running digest for each record: (page_id, bytes, digest)."""
    now, page, sha, total, out = None, None, None, 0, []

    def table():
        kinds = (pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)],
            ["page_id", "payload_bytes", "payload_digest"],
        )

    for batch in batches:
        for uid, own, block in zip(batch.column("uid"), batch.column("page_id"), batch.column("block"), strict=True):
            uid, data = uid.as_py(), block.as_py()
            if uid != now:
                if now is not None:
                    out.append((page, total, sha.hexdigest()))
                now, page, sha, total = uid, own.as_py(), hashlib.sha1(), 0
            sha.update(data)
            total += len(data)
    if now is not None:
        out.append((page, total, sha.hexdigest()))
    if out:
        yield table()


def page_records(records: DataFrame) -> DataFrame:
    """One row per page from its records; digests of whole blocks are taken anew, of segments chunk after chunk.

    The stated digest stands only for revisit records, which have no block.
    """
    again = F.col("type") == "revisit"
    size = F.when(again, F.col("stated_bytes")).otherwise(F.octet_length("block")).cast("long")
    digest = F.when(again, F.col("stated")).otherwise(F.sha1("block"))
    heads = records.where("chunk_no = 0 and (type = 'revisit' or stated is not null)")
    whole = heads.select(
        "page_id",
        size.alias("payload_bytes"),
        digest.alias("payload_digest"),
        F.col("type").alias("record_type"),
        "refers_to",
    )
    parts = records.where(
        "type = 'continuation' or (type = 'response' and stated is null)"
    ).select("uid", "page_id", "chunk_no", "block")
    joined = parts.repartition(
        shuffle_partitions(records.sparkSession), "uid"
    ).sortWithinPartitions("uid", "chunk_no").mapInArrow(digest_runs, "page_id long, payload_bytes long, payload_digest string")
    return whole.unionByName(
        joined.select("*", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    )


def round_trip(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every row of pages, from archives written into
    the shared folder and read back.

    A null html is an empty payload, a null url an empty one. Rows without a page_id have records of their own, always
    responses. Rows that repeat a page_id have one each, whether their payloads are equal or not. Payloads longer than
    a chunk are cut into continuations. Other columns are not read.
    """
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    with cleaned(spark):
        write_archives(pages, path, **options)
    out = spill(page_records(read_archives(spark, path)), "pages")
    discard_path(spark, path)
    return out
