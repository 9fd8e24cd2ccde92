"""WARC archives: writing, and normalising archives that are one gzip stream.

Pages become WARC/1.0 records. Of records with equal payloads of at least LEAST bytes, the one with the largest page_id is
the response and the others revisit it. Each task writes its records as one gzip stream, which readers cannot enter
in the middle. The normaliser inflates such a stream once, rewrites every record as a gzip member of its own and
writes a sidecar index of (offset, length) beside the archive; records are then read back one member at a time.

Files are written in the shared folder under names made from the task's partition, first under
a name of the attempt and then moved, so a task that runs again replaces its own files and nothing else.

Defined results: null html is the empty payload; a null url has no target header. Rows that repeat both page_id
and payload are all responses. A row with a null page_id revisits its group's response if another has an id, and is a response
otherwise. Small payloads are all responses. Extra columns are ignored. An empty table makes no record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_dir

LEAST = 1000
BLOCK = 1 << 20
#: Payload bytes after which a task starts another archive.
ARCHIVE_BYTES = 256 << 20
LEVEL = 5
NEWLINE = b"\r\n"
#: The field names of the format, and our own that carry table keys.
PAGE, REFERS, SIZE = "X-Page-Id", "X-Refers-To-Page-Id", "X-Payload-Length"
#: Our own field for a url that is no well-formed URI, percent-encoded throughout; marks that stand in URIs as they are.
URL, URI_MARKS = "X-Url", "!#$%&'()*+,/:;=?@[]~"
#: Parts into which the rows of one digest are dealt.
SALTS = 16
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, revisit: bool, refers_to: int | None) -> bytes:
    """One record with its header and block; the payload is left out of a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", "2020-01-01T00:00:00Z")]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, URI_MARKS)))
        if quote(url, URI_MARKS) != url:
            fields.append((URL, quote(url, "")))
    fields += [("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), (REFERS, str(refers_to))]
    if page_id is not None:
        fields.append((PAGE, str(page_id)))
    fields += [(SIZE, str(len(payload))), ("Content-Length", str(len(block)))]
    head = b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + NEWLINE
    return head + block + NEWLINE + NEWLINE


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return dict(line.split(": ", 1) for line in lines[1:] if ": " in line)


def inflate(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Inflated bytes of a gzip file, whether it is one stream or many members, in parts of at most BLOCK bytes.

    Zero bytes after a member are padding; a stream that is cut off raises ValueError.
    """
    machine = None
    for chunk in chunks:
        while chunk:
            if machine is None:
                chunk = chunk.lstrip(b"\0")
                if not chunk:
                    break
                machine = zlib.decompressobj(31)
            if part := machine.decompress(chunk, BLOCK):
                yield part
            chunk = machine.unconsumed_tail
            if machine.eof:
                chunk, machine = machine.unused_data, None
    while machine is not None and not machine.eof:  # what is inflated may still be held back by BLOCK
        part = machine.decompress(b"", BLOCK)
        if not part:
            raise ValueError("the gzip stream is cut off")
        yield part


def split_records(parts: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records, from inflated bytes in parts of any size; holds one record and one part at most."""
    held = bytearray()
    need, body = 0, -1  # bytes the record needs; where its block begins, -1 while its header is open
    for part in parts:
        held += part
        while True:
            if body < 0:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                body = end + 4
                need = body + int(parse_head(bytes(held[:end]))["Content-Length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            body = -1
    if held.strip():
        raise ValueError("the archive ends within a record")


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def put(store: fs.FileSystem, scratch: str, path: str) -> None:
    """Give a finished file its name, in place of the same file of an earlier attempt."""
    if store.get_file_info(path).type != fs.FileType.NotFound:
        store.delete_file(path)
    store.move(scratch, path)


def read_blocks(store: fs.FileSystem, path: str) -> Iterator[bytes]:
    with store.open_input_stream(path, compression=None) as f:
        while block := f.read(BLOCK):
            yield block


def mark_duplicates(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html, digest and refers_to (null for responses).

    Only digests that occur more than once are joined back, each in SALTS copies, so that a hot digest's rows are dealt to as many tasks.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    large = rows.where(F.octet_length("html") >= least)
    last = large.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("digest", "last")
    last = materialize(last, "warc-duplicates").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
    return salted.join(last, ["digest", "salt"], "left").select("page_id", "url", "html", "digest", F.when(~F.col("last").eqNullSafe(F.col("page_id")), F.col("last")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Write each task's records as whole-file gzip streams; (name, records) of each archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_folder(folder)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        done: list[tuple[str, int]] = []
        out = machine = None
        size = count = 0
        scratch = f"{base}/_attempt-{task.partitionId()}-{task.taskAttemptId()}"

        def close() -> None:
            nonlocal out
            out.write(machine.flush())
            out.close()
            name = f"part-{task.partitionId():06d}-{len(done):04d}.warc.gz"
            put(store, scratch, f"{base}/{name}")
            done.append((name, count))
            out = None

        for batch in batches:
            for page_id, url, html, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out, machine, size, count = store.open_output_stream(scratch, compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0, 0
                payload = html.encode()
                record = make_record(page_id, url, payload, digest, refers is not None, refers)
                out.write(machine.compress(record))
                size, count = size + len(payload), count + 1
                if size >= limit:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["name", "records"])

    return mark_duplicates(pages, least).mapInArrow(run, "name string, records long")


def normalise(archives: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrite each archive with a member for each record; (name, records) of each, with a sidecar index in `target`.

    The index is text: offset, compressed length, type, page id and target of a record on each line.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (store, base), (into, folder) = open_folder(source), open_folder(target)
        into.create_dir(folder, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            counts = []
            for name in batch.column("name").to_pylist():
                offset, lines = 0, []
                scratch = f"{folder}/_attempt-{attempt}-{name}"
                with into.open_output_stream(scratch, compression=None) as out:
                    for record in split_records(inflate(read_blocks(store, f"{base}/{name}"))):
                        head = parse_head(record[: record.index(b"\r\n\r\n")])
                        machine = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = machine.compress(record) + machine.flush()
                        out.write(member)
                        lines.append(f"{offset} {len(member)} {head['WARC-Type']} {head.get(PAGE, '-')} {head.get('WARC-Target-URI', '-')}\n")
                        offset += len(member)
                with into.open_output_stream(scratch + ".idx", compression=None) as out:
                    out.write("".join(lines).encode())
                put(into, scratch, f"{folder}/{name}")
                put(into, scratch + ".idx", f"{folder}/{name}.idx")
                counts.append(len(lines))
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(counts, pa.int64())], ["name", "records"])

    return archives.select("name").mapInArrow(run, "name string, records long")


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_record(member: bytes) -> tuple:
    """The row of one gzip member; a response's size and digest are those of the payload that stands there."""
    data = zlib.decompress(member, 31)
    split = data.index(b"\r\n\r\n") + 4
    head = parse_head(data[: split - 4])
    size, digest = int(head[SIZE]), base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if head["WARC-Type"] == "response":
        payload = data[data.index(b"\r\n\r\n", split) + 4 : split + int(head["Content-Length"])]
        if (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
            raise ValueError(f"payload differs from its header: {head['WARC-Record-ID']}")
    number = lambda key: int(head[key]) if key in head else None
    url = unquote(head[URL]) if URL in head else head.get("WARC-Target-URI")
    return number(PAGE), url, size, digest, head["WARC-Type"], number(REFERS)


def read_archives(archives: DataFrame, folder: str, rows: int = 2000) -> DataFrame:
    """Every record of normalised archives, each read through the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_folder(folder)
        names = [c.split()[0] for c in RECORD.split(", ")]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for name in batch.column("name").to_pylist():
                with store.open_input_stream(f"{base}/{name}.idx", compression=None) as f:
                    index = [tuple(map(int, line.split(b" ", 2)[:2])) for line in f.read().splitlines()]
                with store.open_input_file(f"{base}/{name}") as f:
                    for k in range(0, len(index), rows):
                        got = [read_record(f.read_at(length, offset)) for offset, length in index[k : k + rows]]
                        yield pa.RecordBatch.from_arrays([pa.array([g[c] for g in got], t) for c, t in enumerate(types)], names)

    return archives.select("name").mapInArrow(run, RECORD)


def archive_round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write `pages` as archives, normalise them and read the records back."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    if "://" not in folder and not folder.startswith("file:"):
        folder = "file://" + folder
    spread = lambda df: df.repartition(max(1, df.count()), "name")  # noqa: E731  an archive for each task
    written = spread(materialize(write_archives(pages, f"{folder}/streams", least), "warc-written"))
    made = spread(materialize(normalise(written, f"{folder}/streams", f"{folder}/members"), "warc-members"))
    return read_archives(made, f"{folder}/members")
