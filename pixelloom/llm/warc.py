"""WARC archives: a writer that turns repeated payloads into revisit records, and a Python data source that reads them.

The source plans partitions of whole files up to a stated size, takes filters on record type and header columns, parses a
record's header before anything else, steps over the payload of records that a filter rejects and of all records when the
payload is not asked for. Files are plain WARC 1.1 with a gzip-coded HTTP entity, so that a step over a payload is a seek.

Defined cases: a null html is an empty payload; of records with equal payloads of at least min_bytes bytes, all rows with
the largest page_id are responses (a repeated row repeats the record), others revisit it; null page_ids count as smaller
than all others, and payloads that only such rows hold are all responses; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, IsNotNull

from pixelloom.llm.common import file_system, scratch

SCHEMA = "record_type string, record_id string, target_uri string, page_id string, refers_to string, payload_digest string, payload_bytes long, payload string"
#: Column of the source by header of the record.
HEADERS = {
    "WARC-Type": "record_type",
    "WARC-Record-ID": "record_id",
    "WARC-Target-URI": "target_uri",
    "WARC-Page-ID": "page_id",
    "WARC-Refers-To": "refers_to",
    "WARC-Payload-Digest": "payload_digest",
    "WARC-Payload-Bytes": "payload_bytes",
}
DATE = "2020-01-01T00:00:00Z"


def _clean(value) -> str:
    return str(value).replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record. A revisit has the HTTP header and no entity; both give digest and size of the full payload."""
    head = {"WARC-Type": "response" if refers_to is None else "revisit"}
    if page_id is not None:
        head |= {"WARC-Record-ID": f"<urn:page:{page_id}>", "WARC-Page-ID": page_id}
    if url is not None:
        head["WARC-Target-URI"] = _clean(url)
    head |= {"WARC-Date": DATE, "WARC-Payload-Digest": f"sha1:{digest}", "WARC-Payload-Bytes": len(payload)}
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is None:
        block = http + b"Content-Encoding: gzip\r\n\r\n" + gzip.compress(payload, 1, mtime=0)
    else:
        head |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
        block = http + b"\r\n"
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head.items()), "\r\n"]).encode() + block + b"\r\n\r\n"


def _head(f) -> dict | None:
    """The next record's header; None at the end of the file."""
    line = f.readline()
    while line in (b"\r\n", b"\n"):
        line = f.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record where one should begin: {line[:60]!r}")
    head = {}
    while (line := f.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        head[name.strip()] = value.strip()
    return head


def _entity(block: bytes) -> bytes:
    http, _, entity = block.partition(b"\r\n\r\n")
    return zlib.decompress(entity, 31) if b"content-encoding: gzip" in http.lower() else entity


def _value(column: str, text: str | None):
    if text is None:
        return None
    if column == "payload_bytes":
        return int(text)
    if column == "payload_digest":
        return text.removeprefix("sha1:")
    if column == "refers_to":
        return text.removeprefix("<urn:page:").removesuffix(">")
    return text


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("maxPartitionBytes", 16 << 20))
        self.payload = options.get("payload", "true").lower() == "true"
        self.equal: list[tuple[str, object]] = []
        self.present: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and presence of header columns are answered here; the rest goes back to Spark."""
        for f in filters:
            column = getattr(f, "attribute", (None,))[0]
            if column in HEADERS.values() and isinstance(f, EqualTo):
                self.equal.append((column, f.value))
            elif column in HEADERS.values() and isinstance(f, IsNotNull):
                self.present.append(column)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow.fs import FileSelector

        fs, path = file_system(self.path)
        files = sorted((x.path, x.size) for x in fs.get_file_info(FileSelector(path, allow_not_found=True)) if x.path.endswith((".warc", ".warc.gz")))
        plan, room = [], 0
        for name, size in files:
            if size > room or not plan:
                plan.append([])
                room = self.most
            plan[-1].append(name)
            room -= size
        return [_Files(x) for x in plan]

    def read(self, partition: _Files) -> Iterator[tuple]:
        fs, _ = file_system(self.path)
        for name in partition.paths if partition else []:  # a plan without partitions is read once, with none
            with fs.open_input_file(name) as raw:
                packed = name.endswith(".gz")
                f = gzip.GzipFile(fileobj=raw) if packed else raw
                if not packed:
                    f = io.BufferedReader(raw, 1 << 18) if hasattr(raw, "readinto") else raw
                while (head := _head(f)) is not None:
                    row = {c: _value(c, head.get(h)) for h, c in HEADERS.items()}
                    size = int(head["Content-Length"])
                    wanted = all(row[c] == v for c, v in self.equal) and all(row[c] is not None for c in self.present)
                    if wanted and self.payload and row["record_type"] != "revisit":
                        text = _entity(f.read(size)).decode("utf-8", "replace")
                    else:
                        f.seek(size, 1)
                        text = None
                    if wanted:
                        yield (*row.values(), text)


class WarcSource(DataSource):
    """format("warc").load(folder); options payload ("false": payloads are stepped over) and maxPartitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def with_revisits(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """pages (page_id, url, html) with refers_to: the page whose record a repeated payload points to, else null.

    Digests are taken where the pages are read. Only ids and digests of repeated payloads are shuffled, first to find the
    largest id of each, with partial maxima, then to send it to the pages; the html moves once, by page_id.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    small = pages.select(F.col("page_id").alias("__page"), F.sha1(F.encode("html", "UTF-8")).alias("__digest"), F.octet_length("html").alias("__size")).where(F.col("__size") >= min_bytes)
    groups = small.groupBy("__digest", "__size").agg(F.max("__page").alias("__first"), F.count("*").alias("__n")).where("__n > 1 and __first is not null").drop("__n")
    revisits = small.join(groups, ["__digest", "__size"]).where(~F.col("__page").eqNullSafe(F.col("__first"))).groupBy("__page", "__digest").agg(F.max("__first").alias("refers_to"))
    keyed = pages.withColumn("__d", F.sha1(F.encode("html", "UTF-8")))
    joined = keyed.join(revisits, keyed["page_id"].eqNullSafe(F.col("__page")) & (F.col("__d") == F.col("__digest")), "left")
    return joined.select("page_id", "url", "html", F.col("__d").alias("digest"), "refers_to")


def write_warc(pages: DataFrame, path: str, min_bytes: int = 1000) -> None:
    """A file per task under path. A file gets its name when it is complete; a task that runs again writes the same name."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, folder = file_system(path)
        fs.create_dir(folder, recursive=True)
        final, part, n = f"{folder}/part-{task.partitionId():06d}.warc", f"{folder}/.part-{task.partitionId():06d}-{task.taskAttemptId()}", 0
        with fs.open_output_stream(part) as out:
            for batch in batches:
                for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    out.write(record_bytes(page_id, url, html.encode(), digest, refers_to))
                    n += 1
        if n:
            fs.move(part, final)
        else:
            fs.delete_file(part)
        yield pa.RecordBatch.from_pydict({"file": [final], "records": pa.array([n], pa.int64())})

    with_revisits(pages, min_bytes).mapInArrow(write, "file string, records long").agg(F.sum("records")).collect()


def warc_report(spark: SparkSession, pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Writes the archives and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The digest and size of responses are taken from the payload that was read, of revisits from their header.
    """
    path = scratch(spark, "warc")
    write_warc(pages, path, min_bytes)
    rows = read_warc(spark, path)
    revisit = F.col("record_type") == "revisit"
    return rows.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.when(revisit, F.col("payload_bytes")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.col("payload_digest")).otherwise(F.sha1(F.encode("payload", "UTF-8"))).alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def sha1_hex(data: bytes) -> str:
    return hashlib.sha1(data).hexdigest()
