"""Operator 1, WARC archives: index first, then coalesced byte-range reads.

Writing: each task writes archives of at most ``roll_bytes`` to the shared folder, one gzip member per record, and emits the index: file, offset, length, url, digest and identity per record. A
payload of ``min_revisit`` bytes or more that several pages share is stored once, in the response of the largest page_id; the others become revisit records that refer to it.
Files of failed attempts are never indexed, so a lost executor leaves garbage but no wrong record.

Reading: the selected index rows are dealt to tasks by file and sorted by offset; neighbouring ranges are merged while the gap is at most ``gap`` bytes and the read
at most ``read_bytes``, so a scan of everything is sequential and a sparse selection reads little more than its records. Each record is verified against its digest. A revisit's payload is its response's.

Skew: the payload shared most is one key of the digest join, which Spark splits; only its largest page_id is aggregated.

Defined results: null html is an empty payload; rows of a null page_id sort below all others; of repeated rows with the largest page_id all are responses and each row has a
record; further columns are ignored; an empty table has no archives.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import cut, shared_folder, with_workers

INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string, refers_to long, payload_bytes long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes after which a reading task passes on what it has: its memory follows this and the longest read, not the number of records.
BATCH_BYTES = 16 << 20
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record, uncompressed."""
    body = b"" if revisit else _HTTP.format(len(payload)).encode() + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {' '.join((url or 'urn:none').split())}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and payload of an uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *fields = head.decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    named = {k.strip().lower(): v.strip() for k, _, v in (f.partition(":") for f in fields)}
    body = rest[: int(named["content-length"])]
    return named, body.partition(b"\r\n\r\n")[2]


def pack(raw: bytes, level: int) -> bytes:
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(raw) + squeeze.flush()


def _write(folder: str, roll_bytes: int, level: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base)
        sink, name, offset = None, "", 0
        try:
            for batch in batches:
                columns = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("page_id", "url", "digest", "refers_to", "revisit")}
                texts = batch.column(batch.schema.get_field_index("html"))
                files, offsets, lengths, sizes = [], [], [], []
                for k, (page, url, digest, refers, revisit) in enumerate(zip(*columns.values(), strict=True)):
                    payload = (texts[k].as_py() or "").encode()  # one page at a time
                    if sink is None or offset >= roll_bytes:
                        if sink:
                            sink.close()
                        name, offset = f"{base}/{uuid.uuid4().hex}.warc.gz", 0
                        sink = store.open_output_stream(name, compression=None)  # members are compressed one by one
                    member = pack(record(page, url, payload, digest, refers, revisit, date), level)
                    sink.write(member)
                    files.append(name)
                    offsets.append(offset)
                    lengths.append(len(member))
                    sizes.append(len(payload))
                    offset += len(member)
                kind = ["revisit" if x else "response" for x in columns["revisit"]]
                cells = [files, offsets, lengths, columns["page_id"], columns["url"], columns["digest"], kind, columns["refers_to"], sizes]
                types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cells, types, strict=True)], names=["file", "offset", "length", "page_id", "url", "digest", "record_type", "refers_to", "payload_bytes"])
        finally:
            if sink:
                sink.close()

    return run


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = 1000, roll_bytes: int = 64 << 20, level: int = 2, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row below ``folder`` (a URI); the index as a table (see ``INDEX``)."""
    with_workers(pages.sparkSession)
    html = F.coalesce(pages[html_col].cast("string"), F.lit(""))
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    shared = rows.where(F.octet_length("html") >= min_revisit).select("digest", "page_id").groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", F.col("first"), F.lit(True).alias("shared"))
    planned = rows.join(shared, "digest", "left")
    revisit = F.coalesce(F.col("shared"), F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first"))
    planned = planned.select("page_id", "url", "html", "digest", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))
    return cut(planned.mapInArrow(_write(folder, roll_bytes, level, date), INDEX), "warc-index")


def _read(folder: str, gap: int, read_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        source, opened = None, None
        try:
            for batch in batches:
                rows = list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("file", "offset", "length")), strict=True))
                ids, refers = (batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "refers_to"))
                i, done, held = 0, 0, 0
                out: list[tuple] = []

                def gathered(done: int, out: list[tuple], ids: pa.Array = ids, refers: pa.Array = refers) -> pa.RecordBatch:
                    kinds, payloads, digests, urls = zip(*out, strict=True)
                    return pa.RecordBatch.from_arrays([ids.slice(done, len(out)), pa.array(urls, pa.string()), pa.array(kinds, pa.string()), refers.slice(done, len(out)), pa.array(digests, pa.string()), pa.array(payloads, pa.binary())], names=["page_id", "url", "record_type", "refers_to", "digest", "payload"])

                while i < len(rows):
                    name, start, length = rows[i]
                    j, stop = i + 1, start + length
                    while j < len(rows) and rows[j][0] == name and rows[j][1] - stop <= gap and rows[j][1] + rows[j][2] - start <= read_bytes:
                        stop = max(stop, rows[j][1] + rows[j][2])
                        j += 1
                    if name != opened:
                        if source:
                            source.close()
                        source, opened = store.open_input_file(name), name
                    chunk = source.read_at(stop - start, start)
                    for _, at, size in rows[i:j]:
                        fields, payload = parse(zlib.decompress(chunk[at - start : at - start + size], 31))
                        digest = fields["warc-payload-digest"].partition(":")[2]
                        if fields["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"payload of {fields['warc-record-id']} doesn't match its digest")
                        out.append((fields["warc-type"], payload, digest, fields.get("warc-target-uri")))
                        held += len(payload)
                        if held >= BATCH_BYTES:
                            yield gathered(done, out)
                            done, held, out = done + len(out), 0, []
                    i = j
                if out:
                    yield gathered(done, out)
        finally:
            if source:
                source.close()

    return run


def read_records(spark: SparkSession, selected: DataFrame, folder: str, gap: int = 64 << 10, read_bytes: int = 8 << 20) -> DataFrame:
    """The records of the index rows ``selected``: page_id, url, record_type, refers_to, digest, payload (of revisits: empty)."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = selected.select("file", "offset", "length", "page_id", "refers_to").repartition(n, "file").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(_read(folder, gap, read_bytes), "page_id long, url string, record_type string, refers_to long, digest string, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, read all archives: page_id, payload_bytes, payload_digest, record_type, refers_to. A revisit's size is that of the response it refers to."""
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    index = write(pages, folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    found = read_records(spark, index, folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    light = cut(found.select("page_id", F.octet_length("payload").cast("long").alias("own"), "digest", "record_type", "refers_to"), "warc-read")
    answers = light.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "digest").agg(F.max("own").alias("stored"))
    whole = light.join(answers, ["refers_to", "digest"], "left")
    size = F.when(F.col("record_type") == "response", F.col("own")).otherwise(F.col("stored"))
    return whole.select("page_id", size.alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
