"""WARC archives compressed record by record with a dictionary that travels inside the file."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfreight.llm.common import stored
from wayfreight.session import shared_dir

#: Magic number of the leading skippable frame that holds the dictionary.
DICTIONARY_FRAME = 0x184D2A5D
ARCHIVE_BYTES = 24 << 20  # of records before compression, held in memory until the archive is written
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 3 << 20  # of the archive's own records that its dictionary is trained on
READ_BYTES = 128 << 20  # of records that a task reads back, if there are more than all cores are busy with
LEVEL = 3
RECORD_NAME = "urn:page:"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One response, or a revisit that leaves the payload out and names the response."""
    http = (
        b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    )
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    head.append(f"WARC-Record-ID: <{RECORD_NAME}{'' if page_id is None else page_id}>")
    head.append("WARC-Date: 1970-01-01T00:00:00Z")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}")
    if refers_to is not None:
        head.append(f"WARC-Refers-To: <{RECORD_NAME}{refers_to}>")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    block = http if refers_to is not None else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def make_dictionary(records: list[bytes]) -> bytes:
    """A Zstandard dictionary from records of one archive, spread over all of them.

    Too few or too short records to train on give a dictionary of their plain bytes, which Zstandard
    takes as content that was seen before.
    """
    import zstandard

    total = sum(map(len, records))
    step = max(1, total // SAMPLE_BYTES)
    samples = [piece for r in records[::step] for piece in (r[k : k + 65536] for k in range(0, len(r), 65536))]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        # Records begin with their version, never with the mark of a trained dictionary.
        share = max(1, DICTIONARY_BYTES // len(samples))
        return b"".join(piece[:share] for piece in samples)[:DICTIONARY_BYTES]


def pack_archive(records: list[bytes]) -> bytes:
    """The dictionary in a skippable frame, then a frame for each record; nothing for no records."""
    import zstandard

    if not records:
        return b""
    raw = make_dictionary(records)
    trained = zstandard.ZstdCompressionDict(raw)
    trained.precompute_compress(level=LEVEL)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True)
    held = zstandard.ZstdCompressor(level=LEVEL).compress(raw)
    lead = struct.pack("<II", DICTIONARY_FRAME, len(held)) + held
    return lead + b"".join(packer.compress(r) for r in records)


def _frames(stream, unpacker) -> Iterator[bytes]:
    """Records of the frames that follow, with one piece of the file in memory besides the record."""
    rest, current, out = b"", None, []
    while True:
        if not rest:
            rest = stream.read(1 << 20)
            if not rest:
                if current is not None:
                    raise ValueError("the archive ends inside a record")
                return
        if current is None:
            current, out = unpacker.decompressobj(), []
        out.append(current.decompress(rest))
        rest = b""
        if current.eof:
            rest = current.unused_data
            yield b"".join(out)
            current = None


class _Rest:
    """A stream that gives back some bytes that were read ahead."""

    def __init__(self, first: bytes, stream):
        self.first, self.stream = first, stream

    def read(self, n: int) -> bytes:
        out, self.first = self.first, b""
        return out or self.stream.read(n)


def read_archive(stream) -> Iterator[bytes]:
    """All records of an archive; its dictionary, plain or compressed, is read from the leading frame."""
    import zstandard

    head = stream.read(8)
    unpacker = zstandard.ZstdDecompressor()
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_FRAME:
        raw = stream.read(struct.unpack("<I", head[4:])[0])
        if raw[:4] == b"\x28\xb5\x2f\xfd":
            raw = zstandard.ZstdDecompressor().decompress(raw)
        unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        head = b""
    yield from _frames(_Rest(head, stream), unpacker)


def parse_record(record: bytes) -> dict:
    """Header fields by lower-case name, type, page id, payload, and what the payload's HTTP head says."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode().split("\r\n")[1:]:
        name, _, value = line.partition(": ")
        fields[name.lower()] = value
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is not what its header says")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x[16:]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))

    def named(value: str | None) -> int | None:
        number = (value or "")[len(RECORD_NAME) + 1 : -1]
        return int(number) if number else None

    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or base32_sha1(payload) != digest):
        raise ValueError("a payload is not what its header says")
    return {
        "page_id": named(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri"),
        "record_type": kind,
        "payload": payload if kind == "response" else None,
        "payload_bytes": length,
        "payload_digest": digest,
        "refers_to": named(fields.get("warc-refers-to")),
    }


def _file_system(folder: str):
    from pyarrow import fs

    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


def _write_batches(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        files, base = _file_system(folder)
        files.create_dir(base, recursive=True)

        def flush(records: list[bytes]) -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.warc.zst"
            packed = pack_archive(records)
            with files.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(packed)
            values = [name], [len(records)], [sum(map(len, records))], [len(packed)]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(values, (pa.string(), pa.int64(), pa.int64(), pa.int64()))],
                names=["archive", "records", "record_bytes", "archive_bytes"],
            )

        records, held = [], 0
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "refers_to")]
            for k in range(batch.num_rows):
                page_id, url, html, refers_to = (c[k].as_py() for c in columns)
                record = make_record(page_id, url, (html or "").encode(), refers_to)
                records.append(record)
                held += len(record)
                if held >= ARCHIVE_BYTES:
                    yield flush(records)
                    records, held = [], 0
        if records:
            yield flush(records)

    return run


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id and refers_to of every page whose payload an earlier page has too.

    Narrow rows only: digests and smallest ids combine map-side, and the groups are stored so that
    adaptive execution can split a payload that a third of all pages share.
    """
    payload = F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary")
    ids = stored(
        pages.select(pages["page_id"].cast("bigint").alias("page_id"), F.sha2(payload, 256).alias("same"), F.length(payload).alias("size"))
        .filter(F.col("size") >= least_bytes).drop("size"),
        "warc-digests",
    )
    groups = ids.groupBy("same").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = stored(groups.filter("n > 1 AND first IS NOT NULL").drop("n"), "warc-groups").withColumnRenamed("same", "group_same")
    return (
        ids.join(groups.hint("merge"), F.col("same") == F.col("group_same"))
        .filter("page_id > first")
        .select(F.col("page_id").alias("revisit_id"), F.col("first").alias("refers_to"))
        .distinct()
    )


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write a record per page into archives below ``folder``; gives the list of archives.

    ``folder`` is on a file system that all executors share. An archive has a name of its own and
    counts only when the returned list, which is stored, names it: what a lost or repeated task leaves
    behind is never read.

    Defined cases: a null html is an empty payload; a null url has no target field; of equal payloads
    the smallest page_id is the response, and rows that repeat that id are responses too; a page
    without an id is always a response. An empty table has no archives. Other columns are not looked at.
    """
    again = revisits(pages, least_bytes)
    rows = pages.select(
        pages["page_id"].cast("bigint").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html")
    )
    rows = rows.join(again, F.col("page_id") == F.col("revisit_id"), "left").select("page_id", "url", "html", "refers_to")
    schema = "archive string, records bigint, record_bytes bigint, archive_bytes bigint"
    return stored(rows.mapInArrow(_write_batches(folder), schema), "warc-list")


def _read_batches(folder: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _file_system(folder)
        kinds = {
            "page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(),
            "payload_digest": pa.string(), "refers_to": pa.int64(), **({"payload": pa.binary()} if with_payload else {}),
        }

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in kinds.items()], names=list(kinds))

        for batch in batches:
            for name in batch.column("archive").to_pylist():
                with files.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    rows = []
                    for record in read_archive(stream):
                        rows.append(parse_record(record))
                        if not with_payload:
                            rows[-1].pop("payload")
                        if len(rows) >= (64 if with_payload else 4096):
                            yield made(rows)
                            rows = []
                    if rows:
                        yield made(rows)

    return run


def read_archives(archives: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of the listed archives, one row each, streamed; lengths and digests are verified.

    Tasks are as many as the records' bytes ask for, at least one for each core as long as there are archives:
    the bytes of the archives' names say nothing about the work. A record is held whole in memory.
    """
    schema = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint"
    if with_payload:
        schema += ", payload binary"
    many, size = archives.agg(F.count("archive"), F.coalesce(F.sum("record_bytes"), F.lit(0))).first()
    cores = archives.sparkSession.sparkContext.defaultParallelism
    dealt = archives.select("archive").repartition(max(1, min(many, cores), -(-size // READ_BYTES)))
    return dealt.mapInArrow(_read_batches(folder, with_payload), schema)


def write_and_read(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Per page what its record says once it is read back from the archives."""
    folder = shared_dir(spark, "warc")
    archives = write_archives(pages, folder)
    return read_archives(archives, folder, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
