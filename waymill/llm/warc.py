"""WARC archives: a deterministic sharded writer that commits through manifests, and the reader.

Shards are ranges of page_ids, cut where the sum of stored bytes passes a multiple of the shard's size, so that neither the number of partitions nor retries change what a file holds. A task writes a
shard's files, each record a gzip member of its own, and rolls to the next file when the compressed size is
reached. Files are written under names of the attempt; their list is a table that only finished attempts get into; listed
files are renamed, and the manifest, itself renamed when complete, names what readers take.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymill.llm.common import shared_dir, written

#: Stored bytes of a shard: the table's in SHARDS parts, within these bounds.
SHARD_BYTES, SHARDS = (1 << 20, 512 << 20), 256
#: Shards at most, so that their bounds are half a megabyte; beyond 32 TB shards grow.
MAX_SHARDS = 1 << 16
#: Compressed bytes at which a file is full.
ROLL_BYTES = 256 << 20
#: Bytes that a record takes besides its payload.
HEADERS = 600
#: Payloads that make up more than this part of all records are few, and are sent to all tasks.
HOT = 1000
DATE = "1970-01-01T00:00:00Z"
CRLF = b"\r\n"
ROW_BITS = 33
FILES = "shard long, number int, temporary string, name string, records long, bytes long, sha256 string"
RECORDS = "file string, offset long, record_type string, record_id string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary"


# --- formats --------------------------------------------------------------------------------------


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or a plain path, and the path in it."""
    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, url: str | None, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, repr((page_id, url, digest, copy)))}>"


def member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as one gzip member; null fields are left out."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode()
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + head + b"Content-Length: %d\r\n\r\n" % len(block) + block + CRLF + CRLF) + packer.flush()


def record(page_id: int | None, url: str | None, digest: str, size: int, payload: bytes | None, copy: int, refers_to: tuple | None) -> bytes:
    """A response with its payload, or a revisit (``refers_to``: the other record's page_id, url and copy) with its headers alone."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = head + (payload or b"")
    more: list[tuple[str, str]] = []
    if refers_to is not None:
        there, its_url, its_copy = refers_to
        more = [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(there, its_url, digest, its_copy)),
            ("WARC-Refers-To-Target-URI", its_url and quote(its_url, safe=":/?#[]@!$&'()*+,;=%")),
            ("WARC-Refers-To-Date", DATE),
            ("X-Refers-To-Page-Id", None if there is None else str(there)),
        ]
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, url, digest, copy)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else quote(url, safe=":/?#[]@!$&'()*+,;=%")),
        ("X-Page-Id", None if page_id is None else str(page_id)),
        ("X-Page-Url", None if url is None else quote(url, safe="")),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + digest),
        ("WARC-Block-Digest", sha1(block)),
        *more,
    ]
    return member(fields, block)


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """(named fields, block) of a record. Raises ValueError where lengths or the block's digest are wrong."""
    head, _, rest = data.partition(CRLF + CRLF)
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    if version != "WARC/1.1" or rest[size:] != CRLF + CRLF:
        raise ValueError("not a whole WARC record")
    block = rest[:size]
    if "WARC-Block-Digest" in fields and fields["WARC-Block-Digest"] != sha1(block):
        raise ValueError(f"the block of {fields['WARC-Record-ID']} isn't what was written")
    return fields, block


def members(stream, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member of a stream."""
    data, offset = b"", 0
    while True:
        opened, parts, used = zlib.decompressobj(31), [], 0
        while not opened.eof:
            data = data or stream.read(chunk)
            if not data:
                if used:
                    raise ValueError("the archive ends within a record")
                return
            used += len(data)
            parts.append(opened.decompress(data))
            data = opened.unused_data
            used -= len(data)
        yield offset, b"".join(parts)
        offset += used


# --- which record is which ------------------------------------------------------------------------


def payloads(pages: DataFrame) -> DataFrame:
    """(page_id, url, digest, size, payload) of pages (page_id, url, html); ``digest`` in hex, a null html is empty."""
    payload = F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary")
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), payload.alias("payload"))
    return rows.select("page_id", "url", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("size"), "payload")


def decided(records: DataFrame, least: int) -> DataFrame:
    """Distinct records (page_id, url, digest, size, copies) with ``first``: of those with an equal payload of at
    least ``least`` bytes the one with the largest page_id (then url), null if that is the record itself or the payload is
    smaller. Records are a written table.

    Payloads that make up more than a thousandth of the records are at most a thousand and are sent to all tasks; all
    other groups are joined.
    """
    total = records.agg(F.sum("copies")).first()[0] or 0
    rank = F.struct(F.col("page_id").isNotNull(), "page_id", F.col("url").isNotNull(), "url")
    groups = records.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max(rank).alias("w"), F.sum("copies").alias("_m"), F.count("*").alias("_d"))
    groups = written(groups.where("_d > 1").select("digest", "size", "_m", F.struct("w.page_id", "w.url").alias("first")), "warc-groups")
    many = F.col("_m") > total / HOT
    hot = groups.where(many).select("digest", "size", F.col("first").alias("_hot"))
    out = records.join(F.broadcast(hot), ["digest", "size"], "left")
    # Rows that are settled join by a key of their own that nothing equals, so that they stay spread.
    key = F.when(F.col("_hot").isNull(), F.concat(F.lit("="), "digest", F.lit("-"), "size")).otherwise(F.concat(F.lit("h"), F.xxhash64("page_id", "url").cast("string")))
    cold = groups.where(~many).select(F.concat(F.lit("="), "digest", F.lit("-"), "size").alias("_key"), F.col("first").alias("_cold"))
    out = out.withColumn("_key", key).join(cold, "_key", "left").withColumn("first", F.coalesce("_hot", "_cold")).drop("_key", "_hot", "_cold")
    itself = F.col("first.page_id").eqNullSafe(F.col("page_id")) & F.col("first.url").eqNullSafe(F.col("url"))
    return out.withColumn("first", F.when(~itself, F.col("first")))


def bounds(records: DataFrame, least: int, shard_bytes: int | None) -> list[int]:
    """The page_ids at which new shards begin, at most MAX_SHARDS: where the sum of stored bytes of decided records, in the
    order of (page_id, url, digest), passes a multiple of the shard's size."""
    order = ["page_id", "url", "digest"]
    # A record takes its headers, and its payload unless another one holds it; of copies that are alike one holds it.
    stored = F.when(F.col("first").isNotNull(), 0).when(F.col("size") >= least, F.col("size")).otherwise(F.col("size") * F.col("copies")) + HEADERS * F.col("copies")
    ranged = records.select(*order, stored.alias("_b")).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = written(ranged.select("page_id", "_b", F.monotonically_increasing_id().alias("_at")), "warc-ranged")
    part = F.shiftright("_at", ROW_BITS)
    sums = ranged.groupBy(part.alias("_part")).agg(F.sum("_b").alias("_s"))
    # One row a partition: the sums before each are a window over as many rows as there are partitions.
    sums = sums.select("_part", F.coalesce(F.sum("_s").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    whole = ranged.agg(F.sum("_b")).first()[0] or 0
    size = min(max(whole // SHARDS, SHARD_BYTES[0]), SHARD_BYTES[1]) if shard_bytes is None else shard_bytes
    size = max(size, -(-whole // MAX_SHARDS))
    inside = F.sum("_b").over(W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, -1))
    placed = ranged.withColumn("_part", part).join(F.broadcast(sums), "_part").withColumn("_sum", F.col("_before") + F.coalesce(inside, F.lit(0)))
    begins = placed.groupBy(F.expr(f"_sum div {size}").alias("_n")).agg(F.min("page_id").alias("page_id")).select("page_id").distinct()
    return sorted(r.page_id for r in begins.collect() if r.page_id is not None)


def shard_of(page_id, begins: list[int]):
    """How many shards begin up to a page_id, none for null: of blocks of bounds first, and inside one block then."""
    step = max(1, int(len(begins) ** 0.5))
    blocks = [begins[i : i + step] for i in range(0, len(begins), step)]
    up_to = lambda values: F.size(F.filter(values, lambda b: b <= page_id))
    longs = lambda values: F.array(*[F.lit(v).cast("long") for v in values]).cast("array<long>")
    block = up_to(longs([b[0] for b in blocks]))
    inner = F.get(F.array(*[longs(b) for b in blocks]), block - 1)
    return F.when(page_id.isNull() | (block == 0), 0).otherwise((block - 1) * step + up_to(inner)).cast("long") if blocks else F.lit(0).cast("long")


# --- writing --------------------------------------------------------------------------------------


def _files(place: str, least: int, roll: int):
    """The writer of a task's records, sorted by shard: one row for each finished file.

    Before the rows of a record (kind 1) comes what was decided about it (kind 0).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = filesystem(place)
        system.create_dir(f"{root}/_temporary", recursive=True)
        shard = number = stream = temporary = None
        records = size = 0
        content = hashlib.sha256()
        done: list[tuple] = []

        def close() -> None:
            nonlocal stream
            if stream is not None:
                stream.close()
                done.append((shard, number, temporary, f"part-{shard:08d}-{number:05d}.warc.gz", records, size, content.hexdigest()))
                stream = None

        last, copy, first = None, 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    first = row["first"]
                    continue
                if row["shard"] != shard or size >= roll:
                    close()
                    number = 0 if row["shard"] != shard else number + 1
                    shard, records, size, content = row["shard"], 0, 0, hashlib.sha256()
                    temporary = f"_temporary/{shard:08d}-{number:05d}-{uuid.uuid4().hex}"
                    stream = system.open_output_stream(f"{root}/{temporary}", compression=None)
                digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
                same = (row["page_id"], row["url"], digest)
                copy, last = (copy + 1 if same == last else 0), same
                refers = None if first is None else (first["page_id"], first["url"], 0)
                if refers is None and copy and row["size"] >= least:
                    refers = (row["page_id"], row["url"], 0)
                data = record(row["page_id"], row["url"], digest, row["size"], row["payload"] if refers is None else None, copy, refers)
                stream.write(data)
                content.update(data)
                records, size = records + 1, size + len(data)
            if done:
                yield listed(done)
                done.clear()
        close()
        if done:
            yield listed(done)

    def listed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in FILES.split(", ")])

    return run


def _committed(place: str):
    """Gives listed files their names. A task that runs again finds them renamed and goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = filesystem(place)
        for batch in batches:
            for temporary, name, size in zip(*(batch.column(c).to_pylist() for c in ("temporary", "name", "bytes"))):
                there, final = system.get_file_info([f"{root}/{temporary}", f"{root}/{name}"])
                if there.type == fs.FileType.File:
                    system.move(there.path, final.path)
                elif final.type != fs.FileType.File or final.size != size:
                    raise OSError(f"{temporary} is neither there nor renamed to {name}")
            yield batch

    return run


def write_warc(pages: DataFrame, place: str, least: int = 0, shard_bytes: int | None = None, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) as WARC files to a new folder, and returns the manifest
    (shard, number, name, records, bytes, sha256) of its files.

    Of records with equal payloads of at least ``least`` bytes the one with the largest page_id (null last, then the largest
    url) is the response, the others are revisits of it; smaller payloads are all responses. Of rows that are alike in
    all three columns the first written is the one that counts as that record. The same rows give the same files, byte for
    byte, however they are partitioned. An empty table gives an empty manifest; extra columns are left out. The folder
    must be one that executors share.
    """
    spark = pages.sparkSession
    rows = payloads(pages)
    records = written(rows.groupBy("page_id", "url", "digest", "size").agg(F.count("*").alias("copies")), "warc-records")
    chosen = written(decided(records, least), "warc-decided")
    begins = bounds(chosen, least, shard_bytes)
    # Payloads are shuffled once, to the tasks of their shards, and meet there what was decided about them.
    key, more = ["page_id", "url", "digest"], chosen.schema["first"].dataType
    about = chosen.select(*key, F.lit(0).alias("kind"), "size", "first", F.lit(None).cast("binary").alias("payload"))
    both = about.unionByName(rows.select(*key, F.lit(1).alias("kind"), "size", F.lit(None).cast(more).alias("first"), "payload"))
    shards = len(begins) + 1
    tasks = min(shards, max(spark.sparkContext.defaultParallelism * 4, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = both.withColumn("shard", shard_of(F.col("page_id"), begins)).repartition(tasks, "shard").sortWithinPartitions("shard", *key, "kind")
    listed = written(dealt.mapInArrow(_files(place, least, roll_bytes), FILES), "warc-files")
    renamed = listed.repartition(max(1, min(tasks, spark.sparkContext.defaultParallelism)), "name").mapInArrow(_committed(place), FILES).drop("temporary")
    renamed.write.mode("overwrite").parquet(f"{place}/_manifest.tmp")
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(place).getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.rename(path(f"{place}/_manifest.tmp"), path(f"{place}/_manifest")):
        raise OSError(f"the manifest of {place} couldn't be published")
    system.delete(path(f"{place}/_temporary"), True)
    return manifest(spark, place)


def manifest(spark: SparkSession, place: str) -> DataFrame:
    """The files of a published archive; fails for a folder whose manifest isn't there."""
    return spark.read.parquet(f"{place}/_manifest")


# --- reading --------------------------------------------------------------------------------------


def read_warc(spark: SparkSession, place: str, contents: bool = True) -> DataFrame:
    """(file, offset, record_type, record_id, page_id, url, payload_bytes, payload_digest, refers_to, payload) of the records in the manifest's files.

    Block digests are checked, and payload digests of responses are computed again and compared; a damaged or unfinished
    file is an error. A revisit's payload is null, and without ``contents`` every one.
    """
    names = [c.split()[0] for c in RECORDS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def rows(name: str, stream) -> Iterator[tuple]:
        from urllib.parse import unquote

        for offset, data in members(stream):
            fields, block = parsed(data)
            head, _, body = block.partition(CRLF + CRLF)
            size = next(int(line[16:]) for line in head.split(CRLF) if line.startswith(b"Content-Length: "))
            digest = fields["WARC-Payload-Digest"]
            response = fields["WARC-Type"] == "response"
            if response and (len(body) != size or sha1(body) != digest):
                raise ValueError(f"the payload of {fields['WARC-Record-ID']} isn't what was written")
            number = lambda f: int(fields[f]) if f in fields else None
            url = unquote(fields["X-Page-Url"]) if "X-Page-Url" in fields else None
            yield name, offset, fields["WARC-Type"], fields["WARC-Record-ID"], number("X-Page-Id"), url, size, digest.removeprefix("sha1:"), number("X-Refers-To-Page-Id"), body if response and contents else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = filesystem(place)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with system.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    some, held = [], 0
                    for row in rows(name, stream):
                        some.append(row)
                        held += len(row[-1] or b"") + 200
                        if held > 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*some), kinds)], names)
                            some, held = [], 0
                    if some:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*some), kinds)], names)

    files = manifest(spark, place).select("name")
    tasks = max(1, min(files.count(), max(spark.sparkContext.defaultParallelism * 4, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    return files.repartition(tasks, "name").mapInArrow(run, RECORDS)


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, written to an archive in the shared
    folder and read back from it. See ``write_warc`` and ``read_warc``."""
    place = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, place, least)
    return read_warc(pages.sparkSession, place, contents=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 of a digest's 40 hex digits: of each five bits the two digits that hold them.
_BASE32 = "array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + (((((strpos('0123456789abcdef', h[i * 5 // 4 + 1]) - 1) * 16 + greatest(strpos('0123456789abcdef', h[i * 5 // 4 + 2]) - 1, 0)) >> (3 - i * 5 % 4)) & 31))::BIGINT]), '')"

ORACLE_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) || '0' AS h FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM q
"""
