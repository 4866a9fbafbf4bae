"""WARC archives: range-sorted records, files rolled by compressed size, committed by rename and manifest.

Pages are sorted by id and cut into ranges at every ``range_rows``-th id, by exact rank, so ranges depend on the
ids alone and not on samples or input splits. A task writes each of its ranges to files named after the range,
first under a temporary name, then renamed. The same input gives the same bytes (fixed date, ids and gzip headers
made from the page), so a task that runs again after a lost executor replaces a file by its equal. A file counts
only if the manifest lists it with its size and digest: a folder named ``manifest`` beside the files, which Spark writes
last under a temporary name, and which is then renamed, so whoever has the archive has it whole or not at all. Temporary
files are then removed.
Each record is its own gzip member; headers and digests are made anew on writing. Reading verifies files against the
manifest, records against their digests, and revisits against the response that they refer to. Of equal payloads of at least ``LEAST_BYTES``, that of the largest page id is a response and
the others are revisits that refer to it; they leave the payload out.

Defined cases: null html is an empty payload; null urls get a URN; rows with equal id and payload are
all responses where that id is the largest; rows with null ids refer to the largest id, or are responses
if there is none; empty tables write no file; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import math
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.stage import fresh_dir, staged

LEAST_BYTES = 1000
#: Compressed bytes after which a file is closed and the next one begins.
ROLL_BYTES = 64 << 20
#: Ids of a range: a 64th of all, within these bounds.
LEAST_ROWS, MOST_ROWS = 1 << 12, 1 << 17
DATE = "2000-01-01T00:00:00Z"
END = b"\r\n\r\n"
MANIFEST = "file string, records bigint, bytes bigint, sha256 string"


def sha1_32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as its own gzip member."""
    digest = hashlib.sha1(payload).hexdigest()
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + (b"" if revisit else payload)
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": DATE,
        "WARC-Target-URI": quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else f"urn:page:{page_id}",
        "WARC-Payload-Digest": sha1_32(payload),
        "WARC-Block-Digest": sha1_32(block),
        "X-Page-Id": "" if page_id is None else str(page_id),
    }
    if revisit:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(refers_to, digest), "X-Refers-To-Page": str(refers_to)}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    return gzip.compress(text.encode() + block + END, 6, mtime=0)


class Roller:
    """Appends members to a file under a temporary name, and renames it when it is full or done."""

    def __init__(self, uri: str, stem: str, most: int):
        self.store, self.root = fs.FileSystem.from_uri(uri)
        self.stem, self.most, self.number, self.out, self.done = stem, most, 0, None, []

    def add(self, member: bytes) -> None:
        if self.out is None:
            self.temporary = f"{self.root}/_temporary-{uuid.uuid4().hex}"
            self.out, self.size, self.records, self.hash = self.store.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()
        self.out.write(member)
        self.hash.update(member)
        self.size, self.records = self.size + len(member), self.records + 1
        if self.size >= self.most:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            name = f"{self.stem}-{self.number:05d}.warc.gz"
            self.store.move(self.temporary, f"{self.root}/{name}")
            self.done.append({"file": name, "records": self.records, "bytes": self.size, "sha256": self.hash.hexdigest()})
            self.number, self.out = self.number + 1, None


def revisits(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """``page_id, digest, refers_to`` of the rows that become revisits; no html travels."""
    html = F.coalesce("html", F.lit(""))
    rows = staged(pages.filter(F.octet_length(html) >= least).select("page_id", F.sha1(html.cast("binary")).alias("digest")), "warc-digests")
    last = staged(rows.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1"), "warc-owners").drop("n")
    return rows.join(last, "digest").filter("refers_to is not null and (page_id is null or page_id < refers_to)").distinct().select("page_id", "digest", "refers_to")


def range_starts(pages: DataFrame, rows: int | None = None) -> list[float]:
    """The first id of each range but the first, by exact rank. The sorted ids are written once, so that their places
    within a partition, and with the partitions' counts their ranks, stay the same; one id in ``rows`` is collected."""
    ids = pages.filter("page_id is not null").select("page_id").distinct()
    placed = staged(ids.repartitionByRange("page_id").sortWithinPartitions("page_id").withColumn("at", F.monotonically_increasing_id()), "warc-ids")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = counts.select(F.col("part").alias("of"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each partition
    total = placed.count()
    rows = rows or min(MOST_ROWS, max(LEAST_ROWS, 1 << math.ceil(math.log2(max(1, total / 64)))))
    first = placed.join(F.broadcast(before), part == F.col("of")).filter((place + F.col("before")) % rows == 0)
    return sorted({float(r["page_id"]) for r in first.select("page_id").collect()})[1:]


def write(pages: DataFrame, uri: str | None = None, roll: int = ROLL_BYTES, range_rows: int | None = None) -> tuple[str, DataFrame]:
    """Write the archives and their manifest under ``uri`` (by default a new shared folder); the folder and the manifest.
    A manifest that is there already stays until the new one is whole, then is replaced by it."""
    uri = uri or fresh_dir(pages.sparkSession, "warc")
    store, root = fs.FileSystem.from_uri(uri)
    store.create_dir(root, recursive=True)
    # A row that marks a revisit sorts just before the page it is about, so html is shuffled once only.
    html = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("html"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("bigint").alias("refers_to"))
    marks = revisits(pages).select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("html"), "digest", F.col("refers_to").cast("bigint").alias("refers_to"))
    starts = range_starts(pages, range_rows)
    ranges = Bucketizer(splits=[-math.inf, *(starts or [0.0]), math.inf], inputCol="place", outputCol="range", handleInvalid="keep")
    rows = ranges.transform(html.unionByName(marks).withColumn("place", F.coalesce(F.col("page_id").cast("double"), F.lit(-math.inf)))).drop("place")
    rows = rows.withColumn("range", F.col("range").cast("int")).repartitionByRange(len(starts) + 1, "range").sortWithinPartitions("range", "page_id", F.col("digest").desc_nulls_last(), F.sha1("html"), "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, page, marked = None, None, (), {}
        done: list[dict] = []
        for batch in batches:
            for i in range(batch.num_rows):
                of, page_id, url, payload, digest, refers_to = (batch.column(c)[i].as_py() for c in ("range", "page_id", "url", "html", "digest", "refers_to"))
                if of != now:
                    if out is not None:
                        out.close()
                        done += out.done
                    out, now = Roller(uri, f"part-{of:06d}", roll), of
                if page != (page_id,):
                    page, marked = (page_id,), {}
                if payload is None:
                    marked[digest] = refers_to
                else:
                    out.add(record(page_id, url, payload, marked.get(hashlib.sha1(payload).hexdigest()) if marked else None))
        if out is not None:
            out.close()
            done += out.done
        if done:
            yield pa.RecordBatch.from_pylist(done)

    made = f"_temporary-manifest-{uuid.uuid4().hex}"
    rows.mapInArrow(run, MANIFEST).write.parquet(f"{uri}/{made}")
    if store.get_file_info(f"{root}/manifest").type == fs.FileType.Directory:
        store.move(f"{root}/manifest", f"{root}/_temporary-old-{uuid.uuid4().hex}")
    store.move(f"{root}/{made}", f"{root}/manifest")
    for left in store.get_file_info(fs.FileSelector(root)):
        if left.base_name.startswith("_temporary-"):
            (store.delete_dir if left.type == fs.FileType.Directory else store.delete_file)(left.path)
    return uri, manifest_of(pages.sparkSession, uri)


def manifest_of(spark, uri: str) -> DataFrame:
    """``file, records, bytes, sha256`` of an archive's files. One that was not written to its end has none: an error."""
    return spark.read.schema(MANIFEST).parquet(f"{uri}/manifest")


class Hashed(io.RawIOBase):
    """A stream that keeps the size and digest of what was read."""

    def __init__(self, raw):
        self.raw, self.size, self.hash = raw, 0, hashlib.sha256()

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self.raw.read(len(into))
        into[: len(data)] = data
        self.size += len(data)
        self.hash.update(data)
        return len(data)


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an unzipped archive, one at a time."""
    while line := stream.readline():
        if line.rstrip() != b"WARC/1.1":
            raise ValueError("no record starts here")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            head[name] = value
        block = stream.read(int(head["Content-Length"]))
        if stream.read(4) != END or sha1_32(block) != head["WARC-Block-Digest"]:
            raise ValueError(f"broken record {head['WARC-Record-ID']}")
        yield head, block


def read(spark, uri: str, manifest: DataFrame | None = None) -> DataFrame:
    """One row per record of the files that the manifest (by default the archive's own) lists: ``page_id, payload_bytes, payload_digest,
    record_type, refers_to, url``. A missing or changed file or record, a wrong count, or a revisit without its
    response is an error."""
    manifest = manifest_of(spark, uri) if manifest is None else manifest
    tasks = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for item in batch.to_pylist():
                rows, count = [], 0
                with store.open_input_stream(f"{root}/{item['file']}", compression=None) as raw:
                    hashed = Hashed(raw)
                    for head, block in records(gzip.GzipFile(fileobj=io.BufferedReader(hashed, 1 << 20))):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size, revisit = int(http.rpartition(b": ")[2]), head["WARC-Type"] == "revisit"
                        if not revisit and (len(payload) != size or sha1_32(payload) != head["WARC-Payload-Digest"]):
                            raise ValueError(f"broken payload {head['WARC-Record-ID']}")
                        digest = base64.b32decode(head["WARC-Payload-Digest"].partition(":")[2]).hex()
                        rows.append((int(head["X-Page-Id"]) if head["X-Page-Id"] else None, size, digest, head["WARC-Type"], int(head["X-Refers-To-Page"]) if revisit else None, head["WARC-Target-URI"]))
                        count += 1
                        if len(rows) == 10_000:
                            yield table(rows)
                            rows = []
                if (count, hashed.size, hashed.hash.hexdigest()) != (item["records"], item["bytes"], item["sha256"]):
                    raise ValueError(f"{item['file']} is not the file that the manifest lists")
                if rows:
                    yield table(rows)

    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string"
    found = staged(manifest.repartition(tasks, "file").mapInArrow(run, schema), "warc-records")
    responses = found.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes")
    if lost := found.filter("record_type = 'revisit'").join(responses, ["refers_to", "payload_digest", "payload_bytes"], "left_anti").limit(1).collect():
        raise ValueError(f"the response of a revisit is missing: {lost}")
    return found
