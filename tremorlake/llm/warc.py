"""WARC archives: a deterministic sharded writer, and a reader of what was committed.

Records are range-sorted by page_id (and digest) into shards of near equal bytes, a shard's file is closed when its
compressed size passes a limit, and each file is written under a temporary name and renamed when it is whole. A
manifest of the renamed files is committed last; readers take only files of the manifest. Headers and digests are
made anew from the payloads.

Payloads are shuffled once, to their shards. Which record is the response of its digest is decided on narrow rows,
and the marks of revisits meet the payloads in the sort inside a shard.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremorlake.llm.common import let, materialised, salted_join, shared_folder

#: Payload bytes that a shard is meant to hold, and compressed bytes after which its file is closed.
SHARD_BYTES = 32 << 20
FILE_BYTES = 8 << 20
#: The shards' bounds are a literal of the plan, so there are at most so many; beyond that shards hold more bytes.
MAX_SHARDS = 50_000
#: Payloads below this size are never revisits.
MIN_REVISIT_BYTES = 0
#: Bytes of headers that a record is counted with.
HEADER_BYTES = 512
#: Archives must not differ between runs, so all records bear one date.
DATE = "2024-01-01T00:00:00Z"
LEVEL = 4
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INFO = b"software: tremorlake\r\nformat: WARC File Format 1.1\r\n"
#: Bytes that are handed to the unpacker at a time.
CHUNK = 1 << 15


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id} {digest}')}>"


def sha1_base32(*parts: bytes) -> str:
    digest = hashlib.sha1()
    for part in parts:
        digest.update(part)
    return base64.b32encode(digest.digest()).decode()


def header(fields: list[tuple[str, object]]) -> bytes:
    """A WARC header; line breaks in values would end a field, so they are dropped."""
    lines = "".join(f"{k}: {str(v).replace(chr(13), '').replace(chr(10), '')}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode()


def packed(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(header([*fields, ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("Content-Length", len(block))])) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def info(name: str) -> bytes:
    """The warcinfo record that begins the file ``name``."""
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, name)), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
    return packed(fields, INFO)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: tuple[int] | None) -> bytes:
    """A response, or with ``refers_to`` a revisit, whose block is the response's HTTP header without its payload."""
    digest = sha1_base32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Refers-To", record_id(refers_to[0], digest) if revisit else None),
        ("WARC-Refers-To-Date", DATE if revisit else None),
        ("WARC-Profile", PROFILE if revisit else None),
        ("Page-Id", page_id),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return packed(fields, http if revisit else http + payload)


def members(file, size: int = CHUNK) -> Iterator[bytes]:
    """The unpacked gzip members of a binary file, one after another, in time linear in its bytes."""
    left = b""
    while left or (left := file.read(size)):
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            if not left and not (left := file.read(size)):
                raise ValueError("an archive ends inside a record")
            parts.append(unpacker.decompress(left))
            left = unpacker.unused_data
        yield b"".join(parts)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _keyed(pages: DataFrame) -> DataFrame:
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8")
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    # Null page_ids sort first.
    return full.withColumns({"sha": F.sha1("payload"), "key": F.coalesce("page_id", F.lit(-(2**63)))})


def revisits(records: DataFrame, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, key, sha, last of the revisits: of equal payloads the largest page_id is the response.

    ``records``: page_id, key, sha, bytes, without payloads. One row per digest meets the records; hot digests spread.
    """
    last = records.where(F.col("bytes") >= least).groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 AND last IS NOT NULL").drop("n")
    once = records.groupBy("page_id", "key", "sha").agg(F.first("bytes").alias("bytes"))
    return salted_join(once, last, ["sha"], F.col("page_id"), salts=8).where("page_id IS NULL OR page_id <> last").select("page_id", "key", "sha", "last")


def bounds(records: DataFrame, shard_bytes: int = SHARD_BYTES) -> list[tuple[int, str]]:
    """The smallest (key, sha) of each shard but the first, ascending: shards are equal steps of the running sum of
    bytes in order of key and sha. A record that covers several steps bounds as many shards.

    The sum runs in sorted parts, so no task sees all records; the driver gets the bounds alone, MAX_SHARDS at most.
    """
    per = records.groupBy("key", "sha").agg(F.sum(F.col("bytes") + HEADER_BYTES).alias("bytes"))
    total = per.agg(F.sum("bytes")).first()[0] or 0
    step = max(shard_bytes, -(-total // MAX_SHARDS))
    if total <= step:
        return []
    dealt = materialised(per.repartitionByRange("key", "sha").withColumn("part", F.spark_partition_id()), "warc-keys")
    # A row for each part; there are as many as shuffle partitions.
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("part").agg(F.sum("bytes").alias("n")).select("part", F.coalesce(F.sum("n").over(every), F.lit(0)).alias("before"))
    upto = F.sum("bytes").over(Window.partitionBy("part").orderBy("key", "sha").rowsBetween(Window.unboundedPreceding, 0))
    ends = dealt.join(F.broadcast(before), "part").select("key", "sha", "bytes", (upto + F.col("before")).alias("end"))
    # Shard k begins with the first record that goes beyond k steps.
    crossed = F.floor((F.col("end") - 1) / step) - F.floor((F.col("end") - F.col("bytes") - 1) / step)
    found = ends.withColumn("times", crossed.cast("int")).where("times > 0 AND end > bytes").select("key", "sha", "times").collect()
    return [(k, s) for k, s, times in sorted(found) for _ in range(times)]


def shard_of(key: Column, sha: Column, edges: list[tuple[int, str]], row: Column) -> Column:
    """Number of the shard of (key, sha): how many ``edges`` are at or below it, found by halving.

    Where an edge repeats, one (key, sha) fills several shards and its rows are dealt to them by ``row``.
    """
    if not edges:
        return F.lit(0)
    known = F.from_json(F.lit(json.dumps([{"k": k, "s": s} for k, s in edges])), "array<struct<k:bigint,s:string>>")
    steps = F.sequence(F.lit(1), F.lit(len(edges).bit_length() + 1))

    def below(value: Column, inclusive: bool) -> Column:
        def halve(a: Column, _: Column) -> Column:
            mid = F.floor((a["low"] + a["high"]) / 2).cast("int")
            at = F.get(known, mid)
            under = at <= value if inclusive else at < value
            go_on = a["low"] < a["high"]
            return F.struct(F.when(go_on & under, mid + 1).otherwise(a["low"]).alias("low"), F.when(go_on & ~under, mid).otherwise(a["high"]).alias("high"))

        return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(len(edges)).alias("high")), halve, lambda a: a["low"])

    value = F.struct(key.alias("k"), sha.alias("s"))
    if len(set(edges)) == len(edges):
        return below(value, True)
    # From the shard that the rows of (key, sha) begin in to the last one that they bound.
    return let(F.struct(below(value, False).alias("a"), below(value, True).alias("b")), lambda x: x["a"] + F.pmod(row, x["b"] - x["a"] + 1).cast("int"))


def _store(folder: str):
    """The file system and the path in it of a folder; Hadoop's names of object stores are S3 to Arrow."""
    from pyarrow import fs

    scheme, colon, rest = folder.partition("://")
    return fs.FileSystem.from_uri(f"s3://{rest}" if colon and scheme in ("s3a", "s3n") else folder)


def _writer(folder: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = _store(folder)
        done: list[tuple] = []
        shard, roll, out, n, mark = None, 0, io.BytesIO(), 0, None

        def close() -> None:
            nonlocal out, n, roll
            if n:
                name, data = f"shard-{shard:06d}-{roll:05d}.warc.gz", out.getvalue()
                temporary = f"{root}/_temporary-{uuid.uuid4().hex}"
                with store.open_output_stream(temporary, compression=None) as f:
                    f.write(data)
                store.move(temporary, f"{root}/{name}")
                done.append((name, n, len(data), hashlib.sha1(data).hexdigest()))
                roll, out, n = roll + 1, io.BytesIO(), 0

        for batch in batches:
            columns = [batch.column(c) for c in ("shard", "page_id", "sha", "url", "payload", "last")]
            for row in zip(*columns, strict=True):
                number, page_id, sha, url, payload, last = (x.as_py() for x in row)
                if payload is None:
                    # The mark of revisits comes before the records that it is about.
                    mark = (number, page_id, sha, last)
                    continue
                if number != shard:
                    close()
                    shard, roll = number, 0
                if not n:
                    out.write(info(f"shard-{shard:06d}-{roll:05d}.warc.gz"))
                out.write(record(page_id, url, payload, (mark[3],) if mark and mark[:3] == (number, page_id, sha) else None))
                n += 1
                if out.tell() >= file_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["name", "records", "bytes", "sha1"])

    return run


MANIFEST = "name string, records long, bytes long, sha1 string"


def write(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes ``pages`` (page_id, url, html; others are ignored) below ``folder``; returns the committed manifest.

    A record per row, repeated rows too: rows with one page_id and payload are all responses, or all revisits. A null
    html is an empty payload; a null page_id gives a record without that header, which is a revisit where a page with
    an id has its payload, else a response. An empty table gives an empty manifest. A payload of any length is one
    row's work. The same rows give the same files, however they are partitioned and whatever attempts failed; only
    where rows with one page_id and payload fill several shards, which of them lies where depends on partitions.
    """
    from pyarrow import fs

    spark: SparkSession = pages.sparkSession
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    full = _keyed(pages)
    narrow = materialised(full.select("page_id", "key", "sha", F.octet_length("payload").cast("long").alias("bytes")), "warc-records")
    edges = bounds(narrow, shard_bytes)
    n = len(edges) + 1
    records = full.select("page_id", "key", "sha", "url", "payload", F.lit(None).cast("long").alias("last")).withColumn("shard", shard_of(F.col("key"), F.col("sha"), edges, F.monotonically_increasing_id()))
    marks = revisits(narrow)
    if len(set(edges)) < len(edges):
        # One (key, sha) may lie in several shards, each of which gets its mark.
        copies = F.explode(F.sequence(F.lit(0), F.lit(max(edges.count(e) for e in set(edges)))).cast("array<long>"))
        marks = marks.withColumn("row", copies)
    else:
        marks = marks.withColumn("row", F.lit(0).cast("long"))
    marks = marks.select("page_id", "key", "sha", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "last", shard_of(F.col("key"), F.col("sha"), edges, F.col("row")).alias("shard")).distinct()
    order = ["shard", "key", "sha", F.col("page_id").asc_nulls_first(), F.col("payload").isNotNull(), "url"]
    dealt = records.unionByName(marks).repartitionById(n, F.col("shard").cast("int")).sortWithinPartitions(*order)
    written = dealt.select("shard", "page_id", "sha", "url", "payload", "last").mapInArrow(_writer(folder, file_bytes), MANIFEST)
    written.write.mode("overwrite").json(f"{folder}/_manifest")
    return spark.read.schema(MANIFEST).json(f"{folder}/_manifest")


ROW = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to_id", pa.string())])
RECORDS = "record_id string, page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to_id string"


class _Hashed:
    """A file whose bytes are hashed as they are read."""

    def __init__(self, file):
        self.file, self.digest = file, hashlib.sha1()

    def read(self, n: int) -> bytes:
        data = self.file.read(n)
        self.digest.update(data)
        return data


def _row(f: dict[str, str], block: bytes, payloads: bool) -> tuple:
    if sha1_base32(block) != f["WARC-Block-Digest"].removeprefix("sha1:"):
        raise ValueError(f"the block of page {f.get('Page-Id')} differs from its digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest, kind = f["WARC-Payload-Digest"].removeprefix("sha1:"), f["WARC-Type"]
    if kind == "response" and sha1_base32(payload) != digest:
        raise ValueError(f"the payload of page {f.get('Page-Id')} differs from its digest")
    length = int(http.rpartition(b"Content-Length: ")[2])
    page_id = int(f["Page-Id"]) if "Page-Id" in f else None
    return f["WARC-Record-ID"], page_id, f.get("WARC-Target-URI"), payload if payloads and kind == "response" else None, length, digest, kind, f.get("WARC-Refers-To")


def _reader(folder: str, payloads: bool, most_rows: int = 1000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = _store(folder)

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(ROW.types)], schema=ROW)

        for batch in batches:
            for name, expected in zip(batch.column("name").to_pylist(), batch.column("sha1").to_pylist(), strict=True):
                with store.open_input_stream(f"{root}/{name}", compression=None) as f:
                    rows, held, file = [], 0, _Hashed(f)
                    for raw in members(file):
                        fields, block = parse(raw)
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        rows.append(_row(fields, block, payloads))
                        held += len(block) if payloads else 0
                        if len(rows) >= most_rows or held >= 4 << 20:
                            yield made(rows)
                            rows, held = [], 0
                    if file.digest.hexdigest() != expected:
                        raise ValueError(f"{name} differs from its manifest")
                    yield made(rows)

    return run


def records_of(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the manifest's files. Each task opens its files by name; bytes and digests are checked."""
    manifest = spark.read.schema(MANIFEST).json(f"{folder}/_manifest").select("name", "sha1")
    files = manifest.count()
    order = Window.orderBy("name")
    # The manifest is one narrow row a file; numbers deal files out evenly.
    dealt = manifest.withColumn("k", (F.row_number().over(order) - 1) % max(1, files)).repartitionById(max(1, files), F.col("k").cast("int"))
    return dealt.select("name", "sha1").mapInArrow(_reader(folder, payloads), RECORDS)


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to of the committed records.

    Revisits have no payload of their own; their WARC-Refers-To names the record whose page_id is refers_to.
    """
    found = records_of(spark, folder, payloads)
    ids = records_of(spark, folder, False).where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")).distinct()
    return salted_join(found, ids, ["refers_to_id"], F.col("record_id"), salts=8, how="left").select("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` to a new folder among the shared ones and reads page_id, sizes, digests and types back.

    Nulls, repeated rows and empty tables are as ``write`` says.
    """
    spark: SparkSession = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, folder)
    found = materialised(records_of(spark, folder, payloads=False).drop("payload", "url"), "warc-read")
    ids = found.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")).distinct()
    joined = salted_join(found, ids, ["refers_to_id"], F.col("record_id"), salts=8, how="left")
    return joined.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b, unhex(sha1(coalesce(html, ''))) AS raw, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages),
bits AS (SELECT page_id, octet_length(b) AS n, raw, last, CAST(raw AS BIT)::VARCHAR AS s FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(s, 5 * i + 1, 1)::INT + 8 * substr(s, 5 * i + 2, 1)::INT + 4 * substr(s, 5 * i + 3, 1)::INT + 2 * substr(s, 5 * i + 4, 1)::INT + substr(s, 5 * i + 5, 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM bits
"""
