"""WARC (operator 5): a deterministic sharded writer with range-sorted records, rolled files, and a two-phase commit."""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from titleforge.llm.common import cut, file_system, shared_dir, ship

_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_INDEX = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("temporary", T.StringType())])
_NEVER = 2**63 - 1


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(headers: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", level, mtime=0)


def response_record(page_id: int | None, url: str | None, html: str | None, ordinal: int, date: str, level: int) -> tuple[bytes, str]:
    """A gzip member with a response record, its headers and digests made anew; and the payload's digest."""
    payload = (html or "").encode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    target = "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in url) if url else f"urn:page:{page_id}"
    own = digest(payload)
    name = uuid.uuid5(_SPACE, json.dumps([url, page_id, own, ordinal]))
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", date), ("WARC-Target-URI", target), ("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", own), ("Content-Length", str(len(block)))]
    return _member(headers, block, level), own


def info_record(name: str, date: str, level: int) -> bytes:
    block = b"software: titleforge\r\nformat: WARC File Format 1.1\r\n"
    return _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))], block, level)


def _boundaries(pages: DataFrame, shard_bytes: int, per_shard: int) -> list[tuple[bytes, int]]:
    """Keys (url, page_id) that part the table into ranges of about shard_bytes, from a sample by hash: the same keys on every run and cluster."""
    weight = F.coalesce(F.octet_length("html"), F.lit(0)) + F.coalesce(F.octet_length("url"), F.lit(0)) + 400
    n, total = pages.agg(F.count(F.lit(1)), F.sum(weight)).first()
    shards = -(-(total or 0) // shard_bytes)
    if shards <= 1:
        return []
    share = min(1.0, per_shard * shards / n)
    h = F.pmod(F.xxhash64("url", "page_id", F.lit(5)), F.lit(1 << 30))
    key = F.struct(F.encode(F.coalesce("url", F.lit("")), "utf-8").alias("u"), F.coalesce(F.col("page_id").cast("long"), F.lit(_NEVER)).alias("i"))
    sample = pages.filter(h < F.lit(int(share * (1 << 30)))).select(key.alias("key"), weight.alias("w")).groupBy("key").agg(F.sum("w").alias("w"))
    ordered = cut(sample.orderBy("key").withColumn("part", F.spark_partition_id()))
    sums = sorted((r[0], r[1]) for r in ordered.groupBy("part").agg(F.sum("w")).collect())
    before, done = {}, 0
    for part, w in sums:
        before[part], done = done, done + w
    step = done / shards
    parts = pages.sparkSession.createDataFrame([(p, float(w)) for p, w in before.items()], "p int, before double")
    upto = F.sum("w").over(Window.partitionBy("part").orderBy("key").rowsBetween(Window.unboundedPreceding, -1))
    at = ordered.join(F.broadcast(parts), F.col("part") == F.col("p")).withColumn("upto", F.col("before") + F.coalesce(upto, F.lit(0)))
    # The first key at or beyond each multiple of the step begins a range.
    first = at.withColumn("slot", F.floor(F.col("upto") / F.lit(step))).filter("slot > 0").groupBy("slot").agg(F.min("key").alias("key"))
    return sorted((bytes(r["key"]["u"]), r["key"]["i"]) for r in first.collect())


def write_warc(pages: DataFrame, out_dir: str, max_file_bytes: int = 64 << 20, shard_bytes: int = 256 << 20, per_shard: int = 30, level: int = 6, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """Write all pages as WARC files below out_dir; (page_id, url, file, offset, length, digest) of every record, in no order.

    The table is parted into ranges of (url, page_id) at keys that depend on the data alone, each range is sorted, and
    its records go to files shard-NNNNNN-NNNNN.warc.gz, a gzip member each; a file is closed when the next record
    would bring it over max_file_bytes compressed (one record is never split). So names and bytes are the same on
    every run, however many tasks there are or fail. A task writes to names of its own below _temporary; when all have
    ended, the files of those that ended well are renamed by tasks, and manifest.json (files with sizes, counts and SHA-256 of
    their record digests) is put in place last, by renaming: without it the output isn't complete. A folder that has an
    older output loses its manifest first and its other files before the new manifest, so a reader never sees a manifest
    that doesn't fit. The ranges come from a sample of per_shard keys a shard, which is sorted and summed up in Spark; the
    driver gets one key a shard.

    Defined cases: a null url becomes urn:page:ID and sorts as ''; null html is an empty payload; a null page_id sorts
    last and is 'None' in the URN; of equal rows each is written, with ids of their own; extra columns are ignored; an
    empty table gives a manifest without files.
    """
    ship(pages.sparkSession)
    system, root = file_system(out_dir)
    system.create_dir(root, recursive=True)
    for name in ("manifest.json", "_manifest.tmp"):
        if system.get_file_info(f"{root}/{name}").type != pafs.FileType.NotFound:
            system.delete_file(f"{root}/{name}")
    if system.get_file_info(f"{root}/_temporary").type != pafs.FileType.NotFound:
        system.delete_dir(f"{root}/_temporary")
    bounds = _boundaries(pages, shard_bytes, per_shard)
    shared = pages.sparkSession.sparkContext.broadcast(bounds)

    @F.arrow_udf(T.IntegerType())
    def shard_of(url: pa.Array, page_id: pa.Array) -> pa.Array:
        return pa.array([bisect.bisect_right(shared.value, ((u or "").encode(), _NEVER if i is None else i)) for u, i in zip(url.to_pylist(), page_id.to_pylist())], pa.int32())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(out_dir)
        attempt = f"{root}/_temporary/{uuid.uuid4().hex}"
        stream, name, size, shard, seq, last, ordinal = None, "", 0, None, 0, None, 0
        for b in batches:
            rows: list[tuple] = []
            for s, page_id, url, html in zip(*(c.to_pylist() for c in b.columns)):
                same = (page_id, url, html)
                ordinal = ordinal + 1 if same == last else 0
                last = same
                record, own = response_record(page_id, url, html, ordinal, date, level)
                if s != shard or size + len(record) > max_file_bytes:
                    seq = 0 if s != shard else seq + 1
                    shard = s
                    if stream:
                        stream.close()
                    name = f"shard-{s:06d}-{seq:05d}.warc.gz"
                    system.create_dir(attempt, recursive=True)
                    stream = system.open_output_stream(f"{attempt}/{name}", compression=None)
                    info = info_record(name, date, level)
                    stream.write(info)
                    size = len(info)
                stream.write(record)
                rows.append((page_id, url, name, size, len(record), own, f"{attempt}/{name}"))
                size += len(record)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], _INDEX.names)
        if stream:
            stream.close()

    keyed = pages.select(shard_of("url", "page_id").alias("shard"), F.col("page_id").cast("long").alias("page_id"), "url", "html")
    order = ["shard", F.coalesce("url", F.lit("")), F.coalesce("page_id", F.lit(_NEVER)), F.xxhash64("html"), F.col("url").isNull()]
    index = cut(keyed.repartition("shard").sortWithinPartitions(*order).mapInArrow(write, _INDEX))
    files = index.groupBy("file", "temporary").agg(F.count(F.lit(1)).alias("records"), F.max(F.col("offset") + F.col("length")).alias("bytes"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("offset", "digest"))), lambda x: x["digest"]), "\n"), 256).alias("digests")).orderBy("file").collect()
    system, root = file_system(out_dir)

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = file_system(out_dir)
        for b in batches:
            for f, temporary in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if own.get_file_info(temporary).type != pafs.FileType.NotFound:  # else an attempt before this one has moved it
                    own.move(temporary, f"{at}/{f}")
            yield b.select(["file"])

    moves = pages.sparkSession.createDataFrame([(r["file"], r["temporary"]) for r in files], "file string, temporary string")
    moves.repartition(max(1, min(len(files), 200))).mapInArrow(rename, "file string").count()
    new = {r["file"] for r in files}
    for f in system.get_file_info(pafs.FileSelector(root)):
        if f.base_name.startswith("shard-") and f.base_name not in new:
            system.delete_file(f.path)
    manifest = json.dumps([{"file": r["file"], "records": r["records"], "bytes": r["bytes"], "sha256_of_digests": r["digests"]} for r in files], indent=1)
    with system.open_output_stream(f"{root}/_manifest.tmp", compression=None) as f:
        f.write(manifest.encode())
    system.move(f"{root}/_manifest.tmp", f"{root}/manifest.json")
    if system.get_file_info(f"{root}/_temporary").type != pafs.FileType.NotFound:
        system.delete_dir(f"{root}/_temporary")
    return index.drop("temporary")


def written(pages: DataFrame) -> DataFrame:
    """The index of all pages, written to a new folder in the shared folder."""
    return write_warc(pages, f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}")
