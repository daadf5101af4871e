"""Sharded WARC archives, the same for the same rows, and reading them back.

Records are dealt by ranges of their key and sorted within; a task writes the
records of its ranges, each as a gzip member, and begins a new file where the
compressed size would pass a limit.  Files get names of their own attempt, and a
manifest lists those of the attempts that count; only these are renamed, and the
archive is there once its manifest is.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import HOT_KEYS, attach, save, scratch_root

#: Payloads below this many bytes are written out however often they come.
LEAST_REVISIT = 100
#: Payload bytes of a range, ranges at least, and compressed bytes of a file.
RANGE_BYTES, RANGES, FILE_BYTES = 1 << 30, 64, 256 << 20
#: Sampled keys for each range from which the bounds are drawn.
SAMPLED = 16
#: Bytes read at once, and bytes of payloads handed on at once.
CHUNK = 1 << 20
_LAST = np.iinfo(np.int64).max

# Fixed values of the WARC format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def record_id(page_id: int | None, url: str | None, digest: str, copy: int) -> str:
    """A name that only the record's own content decides."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps([page_id, url, digest, copy]))}>"


def _header_value(x: str) -> str:
    """Control characters would end a header: they and % are written as %XX."""
    return "".join(f"%{ord(ch):02X}" if ch < " " or ch in "\x7f%" else ch for ch in x)


def _plain_value(x: str) -> str:
    parts = x.split("%")
    return parts[0] + "".join(chr(int(p[:2], 16)) + p[2:] for p in parts[1:])


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, copy: int, refers_to: str | None, date: str) -> bytes:
    """One record, before compression; with ``refers_to`` a revisit without payload."""
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is None:
        block = f"{http}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    else:
        block = f"{http}\r\n".encode()
    head = [VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, url, digest, copy)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header_value(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {refers_to}"]
    head += [
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode("utf-8", "surrogateescape") + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Shards:
    """Files of one range after the other; a file ends before it would pass ``limit``."""

    def __init__(self, folder: str, limit: int):
        self.store, self.folder = _opened(folder)
        self.attempt, self.limit, self.out, self.done = uuid.uuid4().hex, limit, None, []
        self.range, self.turn = -1, 0

    def add(self, at: int, data: bytes) -> None:
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = pack.compress(data) + pack.flush()
        if at != self.range:
            self.close()
            self.range, self.turn = at, 0
        elif self.out is not None and self.size + len(member) > self.limit:
            self.close()
        if self.out is None:
            self.name = f"part-{at:06d}-{self.turn:04d}.warc.gz"
            self.store.create_dir(self.folder, recursive=True)
            self.path = posixpath.join(self.folder, f"{self.attempt}-{self.name}")
            self.out, self.size, self.records, self.sha = self.store.open_output_stream(self.path, compression=None), 0, 0, hashlib.sha256()
            self.turn += 1
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.records += 1

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.name, posixpath.basename(self.path), self.records, self.size, self.sha.hexdigest()))
            self.out = None


_MANIFEST = "file string, attempt string, records long, bytes long, sha256 string"


def _write(folder: str, limit: int, date: str):
    """Rows of a partition, sorted; the role of a key, where it has one, precedes its rows."""

    def run(batches):
        shards = _Shards(folder, limit)
        key, role, copy = None, None, 0
        for batch in batches:
            for r in batch.to_pylist():
                own = (r["range"], r["page_id"], r["url"], r["digest"])
                if own != key:
                    key, role, copy = own, None, 0
                if r["role"] is not None:
                    role = r["role"]
                    continue
                first = role
                if first is None and copy and r["n_bytes"] >= LEAST_REVISIT:
                    first = {"page_id": r["page_id"], "url": r["url"]}
                refers_to = None if first is None else record_id(first["page_id"], first["url"], r["digest"], 0)
                digest = r["digest"] if refers_to else hashlib.sha256(r["payload"]).hexdigest()
                shards.add(r["range"], record(r["page_id"], r["url"], r["payload"], digest, copy, refers_to, date))
                copy += 1
        shards.close()
        files = list(zip(*shards.done)) or [()] * 5
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(files, kinds)], ["file", "attempt", "records", "bytes", "sha256"])

    return run


def _commit(path: str, folder: str):
    """Written files get their names; done twice it does nothing the second time."""

    def run(batches):
        store, target = _opened(path)
        _, source = _opened(folder)
        for batch in batches:
            for file, attempt, size in zip(*(batch.column(c).to_pylist() for c in ("file", "attempt", "bytes"))):
                there = store.get_file_info(posixpath.join(source, attempt))
                if there.type != fs.FileType.NotFound:
                    store.move(there.path, posixpath.join(target, file))
                elif store.get_file_info(posixpath.join(target, file)).size != size:
                    raise OSError(f"{file}: neither written nor committed")
            yield batch

    return run


def _bounds(keys: DataFrame, ranges: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys that cut the order into ``ranges``: of a sample by hash, so the rows alone decide."""
    share = min(1.0, SAMPLED * ranges / max(total, 1))
    drawn = keys.filter(F.shiftrightunsigned(F.xxhash64("place", "tie", F.lit(7)), 2) < F.lit(int(share * 2**62)))
    table = drawn.select("place", "tie").toArrow()
    place, tie = (table.column(c).to_numpy() for c in ("place", "tie"))
    order = np.lexsort((tie, place))
    cut = order[np.arange(1, ranges) * len(order) // ranges] if len(order) else order
    return place[cut], tie[cut]


def _ranges(shared):
    """The range of each key: how many bounds are not above it."""

    def run(place: pa.Array, tie: pa.Array) -> pa.Array:
        places, ties = shared.value
        place, tie = place.to_numpy(zero_copy_only=False), tie.to_numpy(zero_copy_only=False)
        low, high = np.searchsorted(places, place, "left"), np.searchsorted(places, place, "right")
        for x in np.unique(place[low < high]):
            own = place == x
            a, b = low[own][0], high[own][0]
            low[own] = a + np.searchsorted(ties[a:b], tie[own], "right")
        return pa.array(low, pa.int32())

    return F.arrow_udf(run, "int")


def write_warc(
    pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", range_bytes: int = RANGE_BYTES, ranges: int = RANGES, file_bytes: int = FILE_BYTES
) -> DataFrame:
    """Write a record for each row of ``pages(page_id, url, html)`` to the folder ``path``; returns the manifest.

    The manifest, ``file, attempt, records, bytes, sha256``, is also the table
    ``path/manifest``.  Files and their bytes depend on the rows and parameters only,
    not on how the rows are partitioned.  ``path`` must not exist, and must be a
    place that pyarrow can write to from every executor.

    Payload: ``html`` in UTF-8, null is empty.  Of rows with equal payloads of at
    least LEAST_REVISIT bytes that with the smallest page_id (then url; null last)
    is a response, the others are revisits of it without payload.  Repeated rows
    are records each, the first of them the response.  They stay in one range:
    beside the limit on files a range is as large as its most frequent row makes it,
    but revisits are small.  A null url has no header, a null page_id neither; control
    characters and % of a url are written as %XX.  Other columns, whatever their
    names, are not written.  An empty table is an archive without files.
    """
    spark = pages.sparkSession
    store, target = _opened(path)
    if store.get_file_info(target).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    # Keys in the order of page_id, null last; equal ones by a hash of the rest.
    rows = rows.withColumn("place", F.coalesce("page_id", F.lit(int(_LAST)))).withColumn("tie", F.xxhash64("url", "digest"))
    keys = save(rows.drop("payload"), "warc-keys")
    size = keys.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("bytes")).first()
    n = max(ranges, -(-size.bytes // range_bytes))
    at = _ranges(spark.sparkContext.broadcast(_bounds(keys, n, size.n)))
    who = F.struct("place", F.col("url").isNull().alias("no_url"), "page_id", "url")
    shared = keys.filter(F.col("n_bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.min(who).alias("who"), F.count("*").alias("n")).filter("n > 1")
    shared = save(shared.select("digest", F.struct("who.page_id", "who.url").alias("role"), "n"), "warc-copies")
    # Revisits: whose digest another row is the response of.
    roles = attach(keys.filter(F.col("n_bytes") >= LEAST_REVISIT), shared, ["digest"], size.n)
    other = ~(F.col("page_id").eqNullSafe(F.col("role.page_id")) & F.col("url").eqNullSafe(F.col("role.url")))
    roles = roles.filter(other).drop("n_bytes").distinct().withColumn("payload", F.lit(None).cast("binary")).withColumn("n_bytes", F.lit(None).cast("long"))
    # What frequent digests have is not moved but for their response.
    often = F.broadcast(shared.filter(F.col("n") > max(1, size.n // HOT_KEYS)).select("digest", F.col("role").alias("own")))
    rows = rows.join(often, "digest", "left")
    rows = rows.withColumn("payload", F.when(F.col("own").isNull() | F.col("own").eqNullSafe(F.struct("page_id", "url")), F.col("payload")))
    rows = rows.drop("own").withColumn("role", F.lit(None).cast("struct<page_id: long, url: string>"))
    dealt = rows.unionByName(roles).withColumn("range", at("place", "tie")).repartitionByRange(int(n), "range")
    ordered = dealt.sortWithinPartitions("range", "place", "tie", "page_id", "url", "digest", F.col("role").isNull())
    folder = f"{path}/_temporary"
    written = save(ordered.select("range", "page_id", "url", "digest", "n_bytes", "payload", "role").mapInArrow(_write(folder, file_bytes, date), _MANIFEST), "warc-written")
    store.create_dir(target, recursive=True)
    written.mapInArrow(_commit(path, folder), _MANIFEST).write.parquet(f"{path}/manifest")
    if store.get_file_info(posixpath.join(target, "_temporary")).type != fs.FileType.NotFound:
        store.delete_dir(posixpath.join(target, "_temporary"))  # what attempts left that do not count
    return manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")


def members(source) -> Iterator[bytes]:
    """The gzip members of a stream, unpacked, one at a time."""
    rest, unpack, parts = b"", zlib.decompressobj(31), []
    while True:
        data = rest or source.read(CHUNK)
        if not data:
            if parts:
                raise ValueError("the last record is cut off")
            return
        parts.append(unpack.decompress(data))
        rest = unpack.unused_data
        if unpack.eof:
            yield b"".join(parts)
            unpack, parts = zlib.decompressobj(31), []


def parsed(data: bytes) -> dict:
    """A record's headers, payload and digests; what does not hold is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogateescape").split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    if version != VERSION:
        raise ValueError(f"not a {VERSION} record: {version[:20]}")
    n = int(headers["Content-Length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n" or headers["WARC-Block-Digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
        raise ValueError(f"{headers['WARC-Record-ID']}: its block is damaged")
    payload = None
    if headers["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if headers["WARC-Payload-Digest"] != "sha256:" + hashlib.sha256(payload).hexdigest():
            raise ValueError(f"{headers['WARC-Record-ID']}: its payload is damaged")
    url = headers.get("WARC-Target-URI")
    return {
        "record_id": headers["WARC-Record-ID"], "record_type": headers["WARC-Type"], "page_id": int(headers["X-Page-ID"]) if "X-Page-ID" in headers else None,
        "url": None if url is None else _plain_value(url), "payload_digest": headers["WARC-Payload-Digest"].removeprefix("sha256:"), "refers_to_id": headers.get("WARC-Refers-To"), "payload": payload,
    }


_RECORD = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("refers_to_id", pa.string()), ("payload", pa.binary())])
_RECORD_DDL = "record_id string, record_type string, page_id long, url string, payload_digest string, refers_to_id string, payload binary"


def _read(path: str):
    def run(batches):
        store, folder = _opened(path)
        for batch in batches:
            for file, records in zip(batch.column("file").to_pylist(), batch.column("records").to_pylist()):
                with store.open_input_stream(posixpath.join(folder, file), compression=None) as source:
                    rows, held, seen = [], 0, 0
                    for data in members(source):
                        rows.append(parsed(data))
                        held, seen = held + len(data), seen + 1
                        if held >= CHUNK:
                            yield pa.RecordBatch.from_pylist(rows, _RECORD)
                            rows, held = [], 0
                    if seen != records:
                        raise ValueError(f"{file}: {seen} records, not {records}")
                    yield pa.RecordBatch.from_pylist(rows, _RECORD)

    return run


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive: ``record_id, record_type, page_id, url, payload_digest,
    refers_to_id, payload``; a revisit has no payload.  Files are read as streams, each by
    one task; digests, lengths and counts are checked against headers and manifest."""
    files = manifest(spark, path).select("file", "records")
    n = files.count()
    return files.repartitionByRange(max(1, n), "file").mapInArrow(_read(path), _RECORD_DDL)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every record:
    those of a revisit are its response's, found by the record that it refers to."""
    size = F.octet_length("payload").cast("long")
    records = save(read_warc(spark, path).select("record_id", "record_type", "page_id", "payload_digest", "refers_to_id", size.alias("payload_bytes")), "warc-records")
    revisits = records.filter("record_type = 'revisit'").select("page_id", "refers_to_id")
    asked = revisits.groupBy("refers_to_id").agg(F.count("*").alias("n"))
    of = records.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
    named = attach(revisits, save(of.join(asked, "refers_to_id"), "warc-responses"), ["refers_to_id"], records.count())
    own = records.filter("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return own.unionByName(named.select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to"))


def round_trip(pages: DataFrame) -> DataFrame:
    """``read_pages`` of an archive of ``pages`` in the scratch folder."""
    path = f"{scratch_root(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path)
    return read_pages(pages.sparkSession, path)
