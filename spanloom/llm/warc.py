"""A deterministic, sharded WARC writer and its reader.

Records are dealt to shards by ranges of their id, an integer or a string, and within an id by their digest. The ranges are cut at
ids of the data itself, chosen by their hash (CUTS or so, wherever the ids lie), and put together by an exact histogram of
payload bytes between them, so they depend on the data alone, not on the cluster. Each
shard is sorted and written as files that roll at a compressed size; every record is a gzip member of its own.
Headers, record ids and digests are made anew from the record. A file is written under a temporary
name and renamed when complete; since files are the same whoever writes them, a repeated task changes nothing.
The manifest, written last, lists the files that count.

Of records with equal payloads of at least min_payload bytes the one with the smallest id is a response and the
others are revisits without a payload that refer to it.

Defined results: a null payload is empty; a null or unusable URL becomes urn:page:<id>; a record with a null
id is always a response, and such records are dealt by digest; of repeated rows with the same id and payload one is the response or,
if a smaller id has it, none; the others are revisits. An empty table makes no file.
"""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import uuid
import zlib
from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .common import join_groups, staged, staged_path

#: Cuts, in the mean, between the ranges of the histogram; and classes of digests for records without an id.
CUTS, NULL_CLASSES = 20_000, 1024
#: Small inputs are still dealt to so many shards, unless these would fall under LEAST_SHARD bytes.
USUAL_SHARDS = 256
LEAST_SHARD, MOST_SHARD = 1 << 16, 1 << 28
ROLL_BYTES = 1 << 26
#: Compressed bytes that one task reads, at most a few of them at a time in memory.
READ_BYTES = 1 << 25
WHEN = "2024-01-01T00:00:00Z"
MANIFEST = "path string, shard int, seq int, n_records long, n_bytes long, sha256 string"


def _filesystem(uri: str):
    from pyarrow import fs

    for name in ("s3a://", "s3n://"):  # names of Hadoop's own for the same store
        uri = uri.replace(name, "s3://", 1) if uri.startswith(name) else uri
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _target(url: str | None, key) -> str:
    if not url:
        return f"urn:page:{key}"
    return urllib.parse.quote(url, safe="".join(map(chr, range(33, 127))))


def record_id(key, digest: str, number: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{key}:{digest}:{number}')}>"


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{name}: {value}\r\n" for name, value in [*headers, ("Content-Length", str(len(block)))])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)  # gzip, without a time
    return packer.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def make_record(key, url: str | None, payload: bytes, digest: str, refers_to, number: int = 0) -> bytes:
    """A response, or a revisit if refers_to (a tuple with the id) is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    headers = [
        ("WARC-Type", "revisit" if refers_to else "response"),
        ("WARC-Record-ID", record_id(key, digest, number)),
        ("WARC-Date", WHEN),
        ("WARC-Target-URI", _target(url, key)),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if key is not None:
        headers.append(("X-Page-ID", urllib.parse.quote(str(key))))
    if refers_to:
        headers += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(refers_to[0], digest)),
            ("X-Refers-To-Page", urllib.parse.quote(str(refers_to[0]))),
        ]
    return _member(headers, block)


class RollingFile:
    """The files of one shard."""

    def __init__(self, filesystem, root: str, shard: int, roll: int):
        self.filesystem, self.root, self.shard, self.roll = filesystem, root, shard, roll
        self.seq, self.stream, self.done = 0, None, []

    def write(self, member: bytes) -> None:
        if self.stream is None:
            self.name = f"pages-{self.shard:06d}-{self.seq:05d}.warc.gz"
            self.temporary = f"{self.root}/_temporary/{self.name}.{uuid.uuid4().hex}"
            self.stream = self.filesystem.open_output_stream(self.temporary, compression=None)
            self.bytes, self.records, self.hash = 0, 0, hashlib.sha256()
            info = f"software: spanloom\r\nformat: WARC File Format 1.1\r\nshard: {self.shard}\r\n".encode()
            self._put(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(self.name, "")), ("WARC-Date", WHEN), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info))
        self._put(member)
        self.records += 1
        if self.bytes >= self.roll:
            self.close()

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.hash.update(data)
        self.bytes += len(data)

    def close(self) -> None:
        if self.stream is None:
            return
        self.stream.close()
        self.stream = None
        final = f"{self.root}/{self.name}"
        if self.filesystem.get_file_info(final).is_file:  # from another attempt, with the same bytes
            self.filesystem.delete_file(self.temporary)
        else:
            self.filesystem.move(self.temporary, final)
        self.done.append((self.name, self.shard, self.seq, self.records, self.bytes, self.hash.hexdigest()))
        self.seq += 1


def _writer(root_uri: str, roll: int):
    def run(batches):
        import pyarrow as pa

        filesystem, root = _filesystem(root_uri)
        filesystem.create_dir(f"{root}/_temporary", recursive=True)
        file, at, marks, seen, done = None, object(), {}, {}, []
        for batch in batches:
            for shard, key, kind, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file is None or file.shard != shard:
                    if file is not None:
                        file.close()
                        done += file.done
                    file, at = RollingFile(filesystem, root, shard, roll), object()
                if key != at:
                    at, marks, seen = key, {}, {}
                if kind == 0:
                    marks[bytes(digest)] = refers_to
                    continue
                payload = (html or "").encode()
                sha = hashlib.sha1(payload).digest()
                first = marks.get(sha)
                if first is not None and key is not None and (first != key or sha in seen):
                    refers = (first,)
                else:
                    refers = None
                number = seen[sha] = seen.get(sha, -1) + 1
                file.write(make_record(key, url, payload, base64.b32encode(sha).decode(), refers, number))
        if file is not None:
            file.close()
            done += file.done
        columns = list(zip(*done, strict=True)) or [[]] * 6
        types = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=["path", "shard", "seq", "n_records", "n_bytes", "sha256"])

    return run


def write_warc(pages: DataFrame, root: str, id_col: str = "page_id", url: str = "url", payload: str = "html", min_payload: int = 0, roll: int = ROLL_BYTES) -> DataFrame:
    """Writes pages as archives below root, commits their manifest and returns it."""
    kind = pages.schema[id_col].dataType
    if not isinstance(kind, T.IntegralType | T.StringType):
        raise TypeError(f"{id_col} must be an integer or a string")
    digest = F.unhex(F.sha1(F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")))
    n_bytes = F.octet_length(F.coalesce(F.col(payload), F.lit(""))).cast("long")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), F.col(payload).alias("html"), F.xxhash64(digest).alias("place"))
    keys = staged(pages.select(F.col(id_col).alias("id"), digest.alias("digest"), n_bytes.alias("n_bytes")).withColumn("place", F.xxhash64("digest")), "warc-keys")
    total, size = keys.agg(F.count("*"), F.sum(F.col("n_bytes") + 512)).first()
    size = size or 0

    # shards: an exact histogram over ranges between cuts, put together where enough bytes have come together
    target = min(max(size // USUAL_SHARDS, LEAST_SHARD), MOST_SHARD)
    drawn = keys.where("id is not null").where(F.pmod(F.xxhash64("id", "place"), F.lit(max(1, total // CUTS))) == 0).select("id", "place").distinct()
    cuts = sorted(map(tuple, drawn.collect()))  # CUTS or so of them
    none = F.lit(0 if isinstance(kind, T.IntegralType) else "").cast(kind)
    after = F.pandas_udf(lambda ids, places: ids.__class__([bisect_right(cuts, (i, p)) for i, p in zip(ids.tolist(), places.tolist(), strict=True)], dtype="int64"), "long")
    bucket = F.when(F.col("id").isNull(), -1 - F.pmod("place", F.lit(NULL_CLASSES))).otherwise(after(F.coalesce("id", none), F.col("place")))
    heights = dict(keys.groupBy(bucket.alias("b")).agg(F.sum(F.col("n_bytes") + 512)).collect())  # a row a range
    shards, before = [], 0
    for b in sorted(heights):
        shards.append((b, before // target))
        before += heights[b]
    count = shards[-1][1] + 1 if shards else 1

    # revisits: the digests alone meet, not the payloads
    firsts = keys.where((F.col("n_bytes") >= min_payload) & F.col("id").isNotNull()).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    marks = join_groups(keys.select("id", "digest", "place"), firsts, ["digest"], "n", total, F.col("id")).where("first is not null").select("id", "digest", "place", F.col("first").alias("refers_to"))
    events = rows.select("id", "place", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("binary").alias("digest"), F.lit(None).cast(kind).alias("refers_to")).unionByName(
        marks.select("id", "place", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "refers_to")
    )
    places = pages.sparkSession.createDataFrame(shards, "b long, shard int")
    dealt = events.withColumn("b", bucket).join(F.broadcast(places), "b").select(F.col("shard").cast("int").alias("shard"), "id", "kind", "url", "html", "digest", "refers_to")
    order = ("shard", "id", "kind", "url", F.xxhash64("html"))
    dealt = dealt.repartitionById(count, "shard").sortWithinPartitions(*order)  # shards are ranges: no sampling of the rows is needed
    made = dealt.mapInArrow(_writer(root, roll), MANIFEST)
    made.write.mode("overwrite").json(f"{root}/manifest")  # the commit
    return read_manifest(pages.sparkSession, root)


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{root}/manifest")


def parse_members(stream, chunk: int = 1 << 20):
    """(headers, block) of each record of a file of gzip members, one in memory at a time."""
    data, unpacker, out = b"", zlib.decompressobj(31), []
    while True:
        if not data and not (data := stream.read(chunk)):
            break
        out.append(unpacker.decompress(data))
        data = unpacker.unused_data
        if unpacker.eof:
            head, _, rest = b"".join(out).partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            headers = dict(line.split(": ", 1) for line in lines[1:])
            size = int(headers["Content-Length"])
            if not lines[0].startswith("WARC/") or rest[size:] != b"\r\n\r\n":
                raise ValueError("not a WARC record")
            yield headers, rest[:size]
            unpacker, out = zlib.decompressobj(31), []
    if out:
        raise ValueError("the file breaks off")


READ = "page_id {kind}, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to {kind}"


def read_warc(spark: SparkSession, root: str, with_payload: bool = True, kind: str = "long") -> DataFrame:
    """The records of the committed archives below root, with ids of the given type. Digests of responses are computed again and must agree with the headers; a revisit's are its response's."""
    schema = READ.format(kind=kind) if with_payload else READ.format(kind=kind).replace(" payload binary,", "")
    target = to_arrow_schema(_parse_datatype_string(schema))

    def id_of(text):
        if text is None:
            return None
        return urllib.parse.unquote(text) if kind == "string" else int(text)

    def run(batches):
        import pyarrow as pa

        filesystem, base = _filesystem(root)
        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, type=field.type) for c, field in zip(zip(*rows, strict=True), target, strict=True)], schema=target)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with filesystem.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for headers, block in parse_members(stream):
                        record = headers["WARC-Type"]
                        if record not in ("response", "revisit"):
                            continue
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        size = int(headers["X-Payload-Length"])
                        payload = block.partition(b"\r\n\r\n")[2] if record == "response" else None
                        if payload is not None and (len(payload) != size or base32_sha1(payload) != digest):
                            raise ValueError(f"digest of {headers['WARC-Record-ID']} in {name}")
                        key, refers = id_of(headers.get("X-Page-ID")), id_of(headers.get("X-Refers-To-Page"))
                        rows.append((key, headers["WARC-Target-URI"], *([payload] if with_payload else []), size, digest, record, refers))
                        held += len(payload or b"") if with_payload else 0
                        if len(rows) >= 5000 or held > 1 << 24:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = read_manifest(spark, root).select("path")
    n_files, n_bytes = read_manifest(spark, root).agg(F.count("*"), F.sum("n_bytes")).first()
    tasks = min(n_files, max(2 * spark.sparkContext.defaultParallelism, (n_bytes or 0) // READ_BYTES))  # small files share a task
    return files.repartition(max(1, tasks), "path").select("path").mapInArrow(run, schema)


def round_trip(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html", min_payload: int = 0) -> DataFrame:
    """Writes pages to a new place in the shared folder and reads the archives back."""
    root = staged_path(pages.sparkSession, "warc")
    write_warc(pages, root, id_col, url, payload, min_payload)
    return read_warc(pages.sparkSession, root, with_payload=False, kind=pages.schema[id_col].dataType.simpleString())
