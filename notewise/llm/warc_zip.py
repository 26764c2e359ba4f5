"""WARC records in ZIP packages: writing them, and reading them back by ranges without extraction.

A package holds one stored (not compressed) member with the records, each its own gzip member, and one stored member
with an index line for each record.  A reader looks at the directory at the package's end (ZIP64 where sizes or counts ask
for it), finds where the stored members begin, reads the index and then the byte ranges of single records.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewise.llm.frames import picked, shared_folder, text_of
from notewise.session import checkpointed

RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
#: Records of fewer bytes are never replaced by a revisit.
LEAST_REVISIT = 1000
PACKAGE_BYTES = 64 << 20
#: Index entries handed to one read task at a time.
RANGE_ENTRIES = 2000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# --- fixed values of the ZIP format (signatures, record layouts) ---
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\3\4", b"PK\1\2", b"PK\5\6", b"PK\6\6", b"PK\6\7"
LOCAL_LAYOUT, CENTRAL_LAYOUT = struct.Struct("<4s5H3I2H"), struct.Struct("<4s6H3I5H2I")
END_LAYOUT, END64_LAYOUT, LOCATOR_LAYOUT = struct.Struct("<4s4H2IH"), struct.Struct("<4sQ2H2I4Q"), struct.Struct("<4sIQI")
FULL16, FULL32, ZIP64_FIELD, STORED, UTF8_NAMES = 0xFFFF, 0xFFFFFFFF, 1, 0, 0x800


class Package:
    """Writes stored members one after another to a binary stream; a member's size is known when it is closed.

    The local header of a member stands before its data, so it is written with a ZIP64 field reserved and members
    are spooled by the caller.
    """

    def __init__(self, out, zip64: bool = False):
        self.out, self.at, self.entries, self.zip64 = out, 0, [], zip64

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def member(self, name: str, parts: Iterable[bytes], size: int, crc: int) -> None:
        start, raw = self.at, name.encode()
        wide = self.zip64 or size >= FULL32
        extra = struct.pack("<HHQQ", ZIP64_FIELD, 16, size, size) if wide else b""
        shown = FULL32 if wide else size
        self._put(LOCAL_LAYOUT.pack(LOCAL, 45 if wide else 20, UTF8_NAMES, STORED, 0, 0x21, crc, shown, shown, len(raw), len(extra)))
        self._put(raw + extra)
        for part in parts:
            self._put(part)
        self.entries.append((raw, size, crc, start))

    def close(self) -> None:
        directory = self.at
        for raw, size, crc, start in self.entries:
            wide = self.zip64 or size >= FULL32 or start >= FULL32
            extra = struct.pack("<HHQQQ", ZIP64_FIELD, 24, size, size, start) if wide else b""
            big, place = (FULL32, FULL32) if wide else (size, start)
            self._put(CENTRAL_LAYOUT.pack(CENTRAL, 45 if wide else 20, 45 if wide else 20, UTF8_NAMES, STORED, 0, 0x21, crc, big, big,
                                          len(raw), len(extra), 0, 0, 0, 0, place))
            self._put(raw + extra)
        length, count = self.at - directory, len(self.entries)
        if self.zip64 or directory >= FULL32 or count >= FULL16:
            end64 = self.at
            self._put(END64_LAYOUT.pack(END64, END64_LAYOUT.size - 12, 45, 45, 0, 0, count, count, length, directory))
            self._put(LOCATOR_LAYOUT.pack(LOCATOR64, 0, end64, 1))
            count, length, directory = FULL16, FULL32, FULL32
        self._put(END_LAYOUT.pack(END, 0, 0, count, count, length, directory, 0))


def read_directory(file, size: int) -> dict[str, tuple[int, int, int]]:
    """name -> (where its data begins, its size, its CRC) of the stored members of a package.

    ``file`` offers ``read_at(length, offset)``.  Raises ValueError for anything that is no such package.
    """
    tail_at = max(0, size - END_LAYOUT.size - FULL16)
    tail = file.read_at(size - tail_at, tail_at)
    at = tail.rfind(END)
    if at < 0 or at + END_LAYOUT.size > len(tail):
        raise ValueError("no end of central directory")
    _, _, _, _, count, length, directory, _ = END_LAYOUT.unpack_from(tail, at)
    if count == FULL16 or length == FULL32 or directory == FULL32:
        signature, _, end64, _ = LOCATOR_LAYOUT.unpack(file.read_at(LOCATOR_LAYOUT.size, tail_at + at - LOCATOR_LAYOUT.size))
        if signature != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        signature, _, _, _, _, _, _, count, length, directory = END64_LAYOUT.unpack(file.read_at(END64_LAYOUT.size, end64))
        if signature != END64:
            raise ValueError("no ZIP64 end of central directory")
    raw, at, found = file.read_at(length, directory), 0, {}
    for _ in range(count):
        (signature, _, _, _, method, _, _, crc, packed, plain, n_name, n_extra, n_note, _, _, _, start) = CENTRAL_LAYOUT.unpack_from(raw, at)
        if signature != CENTRAL:
            raise ValueError("broken central directory")
        at += CENTRAL_LAYOUT.size
        name, extra = raw[at:at + n_name].decode(), raw[at + n_name:at + n_name + n_extra]
        at += n_name + n_extra + n_note
        while len(extra) >= 4:
            field, n = struct.unpack_from("<HH", extra)
            if field == ZIP64_FIELD:
                wide = iter(struct.unpack(f"<{n // 8}Q", extra[4:4 + n // 8 * 8]))
                plain = next(wide) if plain == FULL32 else plain
                packed = next(wide) if packed == FULL32 else packed
                start = next(wide) if start == FULL32 else start
            extra = extra[4 + n:]
        if method != STORED:
            continue
        head = LOCAL_LAYOUT.unpack(file.read_at(LOCAL_LAYOUT.size, start))
        if head[0] != LOCAL:
            raise ValueError("broken local header")
        found[name] = (start + LOCAL_LAYOUT.size + head[-2] + head[-1], packed, crc)
    return found


def record_bytes(key: object, uri: str | None, payload: bytes, digest: str, refers_to: object, date: str) -> bytes:
    """One gzip member with a response record, or a revisit that keeps the headers only."""
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:piece:{key}>",
        "WARC-Target-URI": None if uri is None else quote(uri, safe="!#$%&'()*+,/:;=?@[]~"),
        "WARC-Date": date,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
    }
    if refers_to is None:
        block += payload
    else:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:piece:{refers_to}>"}
    fields["Content-Length"] = str(len(block))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None) + "\r\n"
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of one record."""
    data = gzip.decompress(raw)

    def fields(text: bytes) -> dict[str, str]:
        return dict(line.split(": ", 1) for line in text.decode().split("\r\n")[1:] if ": " in line)

    head, _, rest = data.partition(b"\r\n\r\n")
    warc = fields(head)
    block = rest[:int(warc["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http), payload


def _package(path: str, spool: bytearray, index: list[dict]) -> None:
    """Written beside and moved, so that a lost or repeated task never leaves half a package under the name."""
    from pyarrow import fs

    where, inner = fs.FileSystem.from_uri(path)
    lines = "".join(json.dumps(x) + "\n" for x in index).encode()
    draft = f"{inner}.{uuid.uuid4().hex}.part"
    with where.open_output_stream(draft) as out:
        package = Package(out)
        package.member(RECORDS, [memoryview(spool)], len(spool), zlib.crc32(spool))
        package.member(INDEX, [lines], len(lines), zlib.crc32(lines))
        package.close()
    where.move(draft, inner)


def revisits(scores: DataFrame, piece: str, payload: str) -> DataFrame:
    """(piece, digest, refers_to): equal payloads of LEAST_REVISIT bytes and more refer to the largest key among them."""
    slim = scores.select(F.col(piece).alias("piece"), F.sha1(F.col(payload)).alias("digest"), F.length(payload).alias("size"))
    many = slim.where(f"size >= {LEAST_REVISIT}").groupBy("digest").agg(F.max("piece").alias("kept"), F.count("*").alias("n")).where("n > 1")
    return many.select("digest", "kept")


def write_packages(scores: DataFrame, folder: str, piece: str = "piece", uri: str = "source_file", score: str = "score") -> DataFrame:
    """Write one record for each score into packages below ``folder``; returns (path, size, first, entries) of index ranges.

    ``scores`` holds one score file per row: its ``piece`` key, where it came from and its text (null: empty).  Of scores with
    equal payloads of LEAST_REVISIT bytes or more, that with the largest key becomes a response, the others revisit it; smaller
    ones are all responses.  Equal rows with the same largest key: every one of them is a response.  Null keys are never
    referred to unless all are null, and then nothing refers.  A package closes at about PACKAGE_BYTES, so memory holds one.
    """
    src = picked(scores, piece=piece, uri=uri, score=score).select(
        "piece", F.col("uri").cast("string").alias("uri"), text_of("score").cast("binary").alias("payload"))
    # a table of its own, so that a payload with very many copies can be split in the join
    many = checkpointed(revisits(src, "piece", "payload"))
    marked = src.withColumn("digest", F.sha1("payload")).join(many, "digest", "left").select(
        "piece", "uri", "payload", "digest", F.when(~F.col("kept").eqNullSafe(F.col("piece")), F.col("kept")).alias("refers_to"))
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spool, index = bytearray(), []

        def closed() -> pa.RecordBatch:
            name = uuid.uuid4().hex
            path = posixpath.join(folder, f"{name}.wacz")
            _package(path, spool, index)
            firsts = list(range(0, len(index), RANGE_ENTRIES))
            n = len(firsts)
            return pa.RecordBatch.from_arrays(
                [pa.array([path] * n), pa.array(firsts, pa.int64()), pa.array([min(RANGE_ENTRIES, len(index) - f) for f in firsts], pa.int64())],
                ["path", "first", "entries"])

        for batch in batches:
            columns = [batch.column(c) for c in ("piece", "uri", "payload", "digest", "refers_to")]
            for k in range(batch.num_rows):
                key, where, payload, digest, refers = (c[k].as_py() for c in columns)
                raw = record_bytes(key, where, payload, digest, refers, date)
                index.append({"piece": None if key is None else str(key), "offset": len(spool), "length": len(raw), "digest": digest})
                spool += raw
                if len(spool) >= PACKAGE_BYTES:
                    yield closed()
                    spool, index = bytearray(), []
        if index:
            yield closed()

    return marked.mapInArrow(run, "path string, first bigint, entries bigint")


READ = "payload_bytes bigint, payload_digest string, record_type string, source_file string"


def read_packages(ranges: DataFrame, piece_type: str = "bigint") -> DataFrame:
    """Read the records of index ranges (path, first, entries) by byte ranges; one row for each record.

    Columns: ``piece``, ``payload_bytes`` and ``payload_digest`` (SHA-1, hex; computed from the payload for responses, taken
    from the record for revisits), ``record_type``, ``refers_to``, ``source_file``.  A payload whose digest is not the
    record's raises.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path, first, entries in zip(*(batch.column(c).to_pylist() for c in ("path", "first", "entries"))):
                where, inner = fs.FileSystem.from_uri(path)
                with where.open_input_file(inner) as file:
                    members = read_directory(file, file.size())
                    at, size, crc = members[INDEX]
                    index = file.read_at(size, at)
                    if zlib.crc32(index) != crc:
                        raise ValueError(f"broken index in {path}")
                    base = members[RECORDS][0]
                    rows = []
                    for line in io.BytesIO(index).readlines()[first:first + entries]:
                        entry = json.loads(line)
                        warc, http, payload = parse_record(file.read_at(entry["length"], base + entry["offset"]))
                        digest = warc["WARC-Payload-Digest"].removeprefix("sha1:")
                        if warc["WARC-Type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(http["Content-Length"])):
                            raise ValueError(f"broken payload in {path}")
                        uri = warc.get("WARC-Target-URI")
                        refers = warc.get("WARC-Refers-To")
                        rows.append((entry["piece"], int(http["Content-Length"]), digest, warc["WARC-Type"],
                                     None if uri is None else unquote(uri), refers and refers[len("<urn:piece:"):-1]))
                    columns = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), *[pa.array(c, pa.string()) for c in columns[2:]]],
                        ["piece", "payload_bytes", "payload_digest", "record_type", "source_file", "refers_to"])

    read = ranges.mapInArrow(run, f"piece string, {READ}, refers_to string")
    return read.select(F.col("piece").cast(piece_type).alias("piece"), "payload_bytes", "payload_digest", "record_type",
                       F.col("refers_to").cast(piece_type).alias("refers_to"), "source_file")


def archived(spark: SparkSession, scores: DataFrame, piece: str = "piece", uri: str = "source_file", score: str = "score",
             folder: str | None = None) -> DataFrame:
    """Write all scores as packages and read them back: the columns of ``read_packages``.

    ``folder`` defaults to a new one below the folder that executors share.  The list of index ranges is kept as a table
    there, so that a lost executor never has packages written twice under other names.
    """
    from pyarrow import fs

    folder = folder or posixpath.join(shared_folder(spark), f"packages-{uuid.uuid4().hex}")
    where, inner = fs.FileSystem.from_uri(folder)
    where.create_dir(inner)
    listing = posixpath.join(folder, "ranges")
    write_packages(scores, folder, piece, uri, score).write.parquet(listing)
    kind = scores.schema[piece].dataType.simpleString()
    ranges = spark.read.parquet(listing)
    tasks = max(1, spark.sparkContext.defaultParallelism * 2)
    return read_packages(ranges.repartition(tasks), kind).withColumnRenamed("piece", piece)
