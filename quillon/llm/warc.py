"""Deterministic sharded WARC writer and reader.

Pages are range-sorted into shards of about `shard_bytes` of payload, whose bounds depend on the data alone; a binary search
over the bounds names each row's shard, and the shard names its partition, so none is sampled. A task streams its shards into gzip members, one per record, and rolls to a new file when the compressed size passes `roll_bytes`. Headers
and digests are made anew. Files are written under names of the attempt, and only attempts whose manifest rows arrived are
renamed to their final names, before the manifest itself is committed; a lost executor leaves unnamed files, no doubles.

Of records with equal payloads of at least `least` bytes, the one with the largest page_id is a response, the others
revisit it. Who revisits is found from digests alone, and joins the pages as marker rows that sort just before them, so the
payload is shuffled once.

Defined results: a null html is an empty payload; a null url is an empty target; rows that repeat page_id and payload give
one response and revisits to the same page_id; a null page_id is written, never revisited, and comes back null; an empty
table gives no files; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.runtime import Scratch, running_sum

_DATE = "1970-01-01T00:00:00Z"
#: Bounds are sent to all tasks: 16 MB at most. Beyond 64 TB of payload shards grow; they are streamed, so memory does not.
MOST_SHARDS = 1 << 20
#: Tasks that write or read; a task takes several shards or files beyond that.
MOST_TASKS = 1 << 14
_MANIFEST = "shard int, seq int, temp string, records long, bytes long, sha256 string"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP headers and the digest and length of the whole payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    target = "".join(c for c in url or "" if c.isprintable())
    name = lambda i: f"<urn:x-page:{'' if i is None else i}>"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: {_sha1(payload)}",
        f"WARC-Block-Digest: {_sha1(block)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of one record; digests of the block, and of a response's payload, are checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != _sha1(block) or len(rest) != len(block) + 4:
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.decode().rpartition("Content-Length: ")[2])
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or _sha1(payload) != fields["WARC-Payload-Digest"]):
        raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
    number = lambda s: int(s[len("<urn:x-page:") : -1]) if len(s) > len("<urn:x-page:>") else None
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"],
        "payload_bytes": size,
        "payload_digest": base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex(),
        "record_type": kind,
        "refers_to": number(fields["WARC-Refers-To"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


def _place(page_id: Column, html: Column) -> list[Column]:
    """The key that rows are sorted and parted by: page_id, nulls first, then a hash of the payload, so that many payloads
    under one page_id part as well."""
    return [F.coalesce(page_id.cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(F.coalesce(html, F.lit(""))).alias("hash")]


def shard_bounds(pages: DataFrame, shard_bytes: int) -> np.ndarray:
    """First keys (id, hash) of all shards but the first, ascending: a shard holds about `shard_bytes` of payload.

    Sizes are summed by key, and running sums over ranges of keys tell each key's shard: the same for the same rows,
    whatever their number and order. Only a row per shard comes to the driver, of MOST_SHARDS at most.
    """
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("long")
    keys = pages.select(*_place(F.col("page_id"), F.col("html")), size.alias("n")).groupBy("id", "hash").agg(F.sum("n").alias("n"))
    placed = Scratch(pages.sparkSession, "warc").table(running_sum(keys, ["id", "hash"], F.col("n"), "before"), "placed")
    total = placed.agg(F.coalesce(F.max(F.col("before") + F.col("n")), F.lit(0))).first()[0]
    width = max(shard_bytes, -(-total // MOST_SHARDS))
    firsts = placed.groupBy(F.floor(F.col("before") / width).alias("shard")).agg(F.min(F.struct("id", "hash")).alias("first"))
    table = firsts.filter("shard > 0").select("first.id", "first.hash").toArrow()
    bounds = np.column_stack([table.column("id").to_numpy(), table.column("hash").to_numpy()]).reshape(-1, 2)
    return bounds[np.lexsort((bounds[:, 1], bounds[:, 0]))]


def shards_of(bounds: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The shard of each key, by binary search: how many bounds are not above it."""
    shard = np.searchsorted(bounds[:, 0], ids, side="left")
    last = np.searchsorted(bounds[:, 0], ids, side="right")
    for i in np.unique(ids[last > shard]):
        mine = np.flatnonzero(ids == i)
        low, high = shard[mine[0]], last[mine[0]]
        shard[mine] = low + np.searchsorted(bounds[low:high, 1], hashes[mine], side="right")
    return shard.astype(np.int32)


def revisits(pages: DataFrame, least: int) -> DataFrame:
    """(page_id, id, hash, digest, refers_to, first) of the payloads that occur more than once; first: this page holds the response.

    The responses are written before the join, so the engine can split a digest that many pages share.
    """
    bare = pages.select("page_id", *_place(F.col("page_id"), F.col("html")), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    large = bare.filter(F.col("page_id").isNotNull() & (F.octet_length("payload") >= least))
    meta = large.select("page_id", "id", "hash", F.sha2("payload", 256).alias("digest"))
    kept = meta.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    kept = Scratch(pages.sparkSession, "warc").table(kept.select("digest", "refers_to"), "responses")
    marks = meta.join(kept, "digest")
    return marks.select("page_id", "id", "hash", "digest", "refers_to", (F.col("page_id") == F.col("refers_to")).alias("first"))


def write(
    pages: DataFrame,
    path: str,
    shard_bytes: int = 64 << 20,
    roll_bytes: int = 16 << 20,
    least: int = 1000,
) -> list[dict]:
    """Write pages (page_id, url, html) below path; returns the manifest that is also written there.

    Only the manifest, a row per file, comes to the driver.
    """
    spark = pages.sparkSession
    kind = pages.schema["page_id"].dataType.simpleString()
    bounds = spark.sparkContext.broadcast(shard_bounds(pages, shard_bytes))
    tasks = min(len(bounds.value) + 1, MOST_TASKS)

    @F.pandas_udf("int")
    def shard(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(shards_of(bounds.value, ids.to_numpy(), hashes.to_numpy()))

    none = lambda kind: F.lit(None).cast(kind)
    full = pages.select(
        "page_id", *_place(F.col("page_id"), F.col("html")), "url", "html", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("digest"),
        F.lit(1).alias("kind"), none(kind).alias("refers_to"), none("boolean").alias("first"),
    )
    marks = revisits(pages, least).select(
        "page_id", "id", "hash", none("string").alias("url"), none("string").alias("html"), "digest", F.lit(0).alias("kind"), "refers_to", "first"
    )
    rows = full.unionByName(marks).withColumn("shard", shard("id", "hash"))
    placed = rows.repartitionById(tasks, F.pmod("shard", F.lit(tasks))).sortWithinPartitions("shard", "id", "hash", "digest", "kind", "url")
    temp = f"{path}/_temporary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(temp)
        fs.create_dir(folder, recursive=True)
        attempt = uuid.uuid4().hex
        done: list[tuple] = []
        out = None
        state = {"shard": None, "seq": 0, "records": 0, "bytes": 0}
        digest = hashlib.sha256()

        def close() -> None:
            nonlocal out, digest
            if out is not None:
                out.close()
                done.append((state["shard"], state["seq"], name, state["records"], state["bytes"], digest.hexdigest()))
                state.update(seq=state["seq"] + 1, records=0, bytes=0)
                out, digest = None, hashlib.sha256()

        mark = None
        for batch in batches:
            cols = [batch.column(c) for c in ("shard", "page_id", "digest", "kind", "url", "html", "refers_to", "first")]
            for i in range(batch.num_rows):
                at, page_id, key, row_kind, url, html, refers_to, first = (c[i].as_py() for c in cols)
                if row_kind == 0:
                    if mark is None or mark[:2] != (page_id, key):
                        mark = (page_id, key, refers_to, first)
                    continue
                target = None
                if mark is not None and mark[:2] == (page_id, key):
                    target = None if mark[3] else mark[2]
                    mark = (page_id, key, mark[2], False)
                if at != state["shard"]:
                    close()
                    state.update(shard=at, seq=0)
                if out is None:
                    name = f"{attempt}-{at:06d}-{state['seq']:05d}"
                    out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(record(page_id, url, (html or "").encode(), target)) + packer.flush()
                out.write(member)
                digest.update(member)
                state["records"] += 1
                state["bytes"] += len(member)
                if state["bytes"] >= roll_bytes:
                    close()
        close()
        columns = list(zip(*done, strict=True)) or [[]] * 6
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["shard", "seq", "temp", "records", "bytes", "sha256"])

    files = [r.asDict() for r in placed.mapInArrow(run, _MANIFEST).collect()]
    return _commit(spark, path, temp, sorted(files, key=lambda f: (f["shard"], f["seq"])))


def _commit(spark: SparkSession, path: str, temp: str, files: list[dict]) -> list[dict]:
    """Give files their final names, then write the manifest under a temporary name and rename it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at(path))

    def rename(f: dict) -> None:
        f["name"] = f"part-{f['shard']:06d}-{f['seq']:05d}.warc.gz"
        if not fs.rename(at(f"{temp}/{f['temp']}"), at(f"{path}/{f['name']}")):
            raise OSError(f"cannot rename {f['temp']} to {f['name']}")

    with ThreadPoolExecutor(16) as pool:
        list(pool.map(rename, files))
    manifest = [{k: f[k] for k in ("name", "records", "bytes", "sha256")} for f in files]
    stream = fs.create(at(f"{path}/_manifest.tmp"), True)
    stream.write(bytearray(json.dumps(manifest, indent=1).encode()))
    stream.close()
    if not fs.rename(at(f"{path}/_manifest.tmp"), at(f"{path}/manifest.json")):
        raise OSError("cannot commit the manifest")
    fs.delete(at(temp), True)
    return manifest


def read(spark: SparkSession, path: str, manifest: list[dict], payload: bool = False) -> DataFrame:
    """Records of the files of a manifest, checked against its digests, streamed member by member."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payload
    schema += ", payload binary" * payload
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, sha in zip(batch.column("name").to_pylist(), batch.column("sha256").to_pylist(), strict=True):
                rows: list[dict] = []
                held = 0
                for data in _members(f"{path}/{name}", sha):
                    rows.append(parse(data))
                    held += len(data) * payload + 200
                    if held > 8_000_000:
                        yield _batch(rows, names, kinds)
                        rows, held = [], 0
                yield _batch(rows, names, kinds)

    if not manifest:
        return spark.createDataFrame([], schema)
    tasks = min(len(manifest), MOST_TASKS)
    listed = spark.createDataFrame([(f["name"], f["sha256"], i % tasks) for i, f in enumerate(manifest)], "name string, sha256 string, task int")
    return listed.repartitionById(tasks, "task").mapInArrow(run, schema)


def _batch(rows: list[dict], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=False)], names)


def _members(uri: str, sha: str) -> Iterator[bytes]:
    fs, name = pafs.FileSystem.from_uri(uri)
    digest = hashlib.sha256()
    unpack, parts = zlib.decompressobj(31), []
    with fs.open_input_stream(name, compression=None) as stream:
        while data := stream.read(1 << 20):
            digest.update(data)
            while data:
                parts.append(unpack.decompress(data))
                data = unpack.unused_data
                if unpack.eof:
                    yield b"".join(parts)
                    unpack, parts = zlib.decompressobj(31), []
    if digest.hexdigest() != sha:
        raise ValueError(f"{uri} does not match the manifest")


def archive(pages: DataFrame) -> DataFrame:
    """Write pages to the shared folder and read the records back."""
    path = Scratch(pages.sparkSession, "warc").path("archive")
    return read(pages.sparkSession, path, write(pages, path))
