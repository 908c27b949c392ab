"""Web archives of crawled pages: writing, normalising and reading gzipped WARC files.

A crawler may hand over a gzip file as one single stream, which can only be read from
its start. The normaliser inflates such a stream once, writes every record again as a
gzip member of its own and keeps a table of offsets, after which any record is one
seek away.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.guards import cut_lineage, scratch_folder
from .blocks import bounded_side

CHUNK = 1 << 20
READ_BYTES = 16 << 20  # of an archive that one task reads
MOST_TASKS = 20_000
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "archive string, record string, offset long, length long, kind string, digest string, refers string, payload_bytes long"


def _open_folder(folder: str) -> tuple[pafs.FileSystem, str]:
    where = re.sub(r"^file:/+", "/", folder)
    return pafs.FileSystem.from_uri(where if "://" in where else f"file://{where}")


def _store(folder: str, name: str, pieces: Iterator[bytes]) -> str:
    """Write a file under a name of its own attempt, then move it to its place."""
    files, path = _open_folder(folder)
    files.create_dir(path, recursive=True)
    draft = f"{path}/.{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(draft, compression=None) as out:
        for piece in pieces:
            out.write(piece)
    files.move(draft, f"{path}/{name}")
    return f"{folder}/{name}"


def _record(record: str, url: str | None, html: str | None, kind: str, digest: str, refers: str | None) -> bytes:
    payload = b"" if kind == "revisit" else (html or "").encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{record}>", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]", " ", url))
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers}>", f"WARC-Profile: {REVISIT}"]
    head += ["WARC-Date: 2024-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _write_monoliths(folder: str, file_bytes: int):
    """Records of a partition as gzip files that are one stream each, of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        state = {"left": next(rows, None), "file": 0}

        def stream() -> Iterator[bytes]:
            pack, size = zlib.compressobj(6, zlib.DEFLATED, 31), 0
            while state["left"] is not None and size < file_bytes:
                r = state["left"]
                raw = _record(r["record"], r["url"], r["html"], r["kind"], r["digest"], r["refers"])
                size += len(raw)
                yield pack.compress(raw)
                state["left"] = next(rows, None)
            yield pack.flush()

        while state["left"] is not None:
            name = f"pages-{TaskContext.get().partitionId():06d}-{state['file']:04d}.warc.gz"
            path = _store(folder, name, stream())
            state["file"] += 1
            yield pa.RecordBatch.from_pydict({"path": [path]})

    return run


def write_archives(pages: DataFrame, folder: str, file_bytes: int = 64 << 20, share_from: int = 1000) -> DataFrame:
    """Write ``pages`` (page, url, html) to ``folder`` as single-stream gzip WARC files.

    Of pages with equal payloads of at least ``share_from`` bytes the one with the
    largest key is the response, the others are revisit records that refer to it.
    Returns (path), the files written. A task that runs again writes its files anew
    under the same names, whole or not at all.

    ``folder`` is a path or URI that pyarrow can write (file, hdfs, s3, gs).
    """
    html = F.coalesce("html", F.lit(""))
    texts = pages.select("page", "url", html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("digest"))
    large = F.octet_length("html") >= share_from
    shared = cut_lineage(
        texts.where(large).groupBy("digest").agg(F.max("page").alias("owner"), F.count("*").alias("n"))
        .where("n > 1").select("digest", "owner")
    )
    joined = texts.join(bounded_side(shared), "digest", "left")
    again = large & F.col("owner").isNotNull() & ~F.col("page").eqNullSafe(F.col("owner"))
    records = joined.select(
        _key(F.col("page")).alias("record"), "url", "html", F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("kind"),
        "digest", F.when(again, _key(F.col("owner"))).alias("refers"),
    )
    return cut_lineage(records.mapInArrow(_write_monoliths(folder, file_bytes), "path string"))


def _key(page: Column) -> Column:
    return F.coalesce(page.cast("string"), F.lit("null"))


class RecordReader:
    """WARC records out of a stream of inflated bytes, one at a time."""

    def __init__(self, pieces: Iterator[bytes]) -> None:
        self.pieces, self.held = pieces, bytearray()

    def _until(self, n: int) -> bool:
        while len(self.held) < n:
            piece = next(self.pieces, None)
            if piece is None:
                return False
            self.held += piece
        return True

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        while True:
            while (end := self.held.find(b"\r\n\r\n")) < 0:
                if not self._until(len(self.held) + 1):
                    if self.held.strip():
                        raise ValueError("the archive ends inside a record")
                    return
            lines = self.held[:end].decode().split("\r\n")
            head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            stop = end + 4 + int(head["content-length"]) + 4
            if not self._until(stop):
                raise ValueError("the archive ends inside a record")
            yield head, bytes(self.held[:stop])
            del self.held[:stop]


def inflated(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of a gzip file, of one member or many, in pieces of bounded size."""
    pack = zlib.decompressobj(31)
    for piece in pieces:
        while piece:
            yield pack.decompress(piece, CHUNK)
            piece = pack.unconsumed_tail or pack.unused_data
            if pack.eof:
                pack = zlib.decompressobj(31)


def _chunks_of(path: str) -> Iterator[bytes]:
    folder, _, name = path.rpartition("/")
    files, at = _open_folder(folder)
    with files.open_input_stream(f"{at}/{name}", compression=None) as src:
        while piece := src.read(CHUNK):
            yield piece


def _ident(value: str | None) -> str | None:
    return None if value is None else re.sub(r"^<urn:page:|>$", "", value)


def _payload(raw: bytes) -> bytes:
    start = raw.index(b"\r\n\r\n") + 4
    return raw[raw.index(b"\r\n\r\n", start) + 4 : -4]


def _normalise(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for b in batches for p in b.column(0).to_pylist()):
            name = path.rpartition("/")[2]
            index: list[tuple] = []

            def members(path=path, index=index, name=name) -> Iterator[bytes]:
                offset = 0
                for head, raw in RecordReader(inflated(_chunks_of(path))):
                    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = pack.compress(raw) + pack.flush()
                    index.append((
                        f"{folder}/{name}", _ident(head["warc-record-id"]), offset, len(member), head["warc-type"],
                        head["warc-payload-digest"].removeprefix("sha1:"), _ident(head.get("warc-refers-to")), len(_payload(raw)),
                    ))
                    offset += len(member)
                    yield member

            _store(folder, name, members())
            for at in range(0, len(index), 10_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*index[at : at + 10_000], strict=True), _TYPES, strict=True)], names=_NAMES
                )

    return run


_NAMES = [x.split()[0] for x in INDEX.split(", ")]
_TYPES = [pa.string() if x.endswith("string") else pa.int64() for x in INDEX.split(", ")]


def normalise_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite ``archives`` (path) into ``folder`` with one gzip member per record.

    Each file is inflated once, piece by piece, by one task: a single gzip stream cannot
    be entered in its middle. Returns the sidecar index, a written table: (archive,
    record, offset, length, kind, digest, refers, payload_bytes), one row per record.
    """
    paths = archives.select("path")
    # as many tasks as files: their rows are too small for Spark to keep them apart by itself
    paths = paths.repartition(min(max(paths.count(), 1), MOST_TASKS))
    return cut_lineage(paths.mapInArrow(_normalise(folder), INDEX))


def _read_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Seek to each record of the index, inflate its member alone and digest its payload."""
    held: tuple[str, object] | None = None
    for batch in batches:
        rows = batch.to_pylist()
        out = []
        for r in rows:
            if held is None or held[0] != r["archive"]:
                folder, _, name = r["archive"].rpartition("/")
                files, at = _open_folder(folder)
                held = (r["archive"], files.open_input_file(f"{at}/{name}"))
            held[1].seek(r["offset"])
            raw = zlib.decompress(held[1].read(r["length"]), 31)
            head, _ = next(iter(RecordReader(iter([raw]))))
            payload = _payload(raw)
            kind = head["warc-type"]
            digest = hashlib.sha1(payload).hexdigest() if kind == "response" else head["warc-payload-digest"].removeprefix("sha1:")
            out.append((_ident(head["warc-record-id"]), kind, digest, len(payload), _ident(head.get("warc-refers-to"))))
        if out:
            names = ["record", "kind", "digest", "n", "refers"]
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def read_archives(index: DataFrame) -> DataFrame:
    """(record, kind, digest, payload_bytes, refers) read back from the archives by ``index``.

    Responses are digested from their payload. A revisit has no payload of its own: its
    digest is its header's and its size that of the response it refers to.
    """
    part = F.floor(F.col("offset") / READ_BYTES)
    parts = index.select("archive", part.alias("p")).distinct().count()
    wanted = index.select("archive", "offset", "length").repartition(min(max(parts, 1), MOST_TASKS), "archive", part)
    read = cut_lineage(
        wanted.sortWithinPartitions("archive", "offset")
        .mapInArrow(_read_members, "record string, kind string, digest string, n long, refers string")
    )
    targets = cut_lineage(read.where("refers IS NOT NULL").select(F.col("refers").alias("r"), F.col("digest").alias("d")).distinct())
    responses = read.where("kind = 'response'").select("record", F.col("digest").alias("own"), F.col("n").alias("full"))
    sizes = cut_lineage(
        responses.join(bounded_side(targets), (F.col("record") == F.col("r")) & (F.col("own") == F.col("d")))
        .groupBy("r", "d").agg(F.max("full").alias("full"))
    )
    return read.join(bounded_side(sizes), (F.col("refers") == F.col("r")) & (F.col("digest") == F.col("d")), "left").select(
        "record", "kind", "digest", F.coalesce("full", "n").alias("payload_bytes"), "refers"
    )


def archive_pages(pages: DataFrame, folder: str | None = None, file_bytes: int = 64 << 20) -> DataFrame:
    """Write the crawled ``pages``, normalise the archives, and read every record back.

    ``pages`` is (page, url, html), the crawl behind the genre reference; further columns
    are ignored. ``folder`` is where the archives go, by default one of its own in the
    shared folder. Returns (record, kind, digest, payload_bytes, refers), one row per page.

    * Null html is an empty payload, a null url has no target header.
    * Pages that repeat a key are records of their own; all rows of the key that owns a
      shared payload are responses. A null key is written as ``null``.
    * No pages make no archives and no rows. A payload of any length is one record.
    """
    folder = folder or f"{scratch_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    streams = write_archives(pages, f"{folder}/streams", file_bytes)
    return read_archives(normalise_archives(streams, f"{folder}/members"))
