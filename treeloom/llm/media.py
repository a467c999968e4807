"""Media columns: archives of images written by tasks, and a Spark data source that reads them by byte ranges.

``write_archives`` stores payloads as 8-bit grey PNG images (192 samples a row, lossless) in ZIP archives under a
folder that all executors share.  ``MediaArchiveSource`` (format "media_archive") lists the folder's archives, plans
partitions of byte ranges, and each task takes the members whose header starts in its range, found in the archive's
own directory at its end.  Members come as Arrow batches of bounded size.  A member that can't be read or decoded is
tried again on a fresh handle, at its own offset; after ``attempts`` it comes out with its error and no media, and the
others are not touched.

Null and empty texts have a payload of 192 spaces.  Rows of a repeated doc_id are members of their own; a null doc_id
comes back null.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from treeloom.llm.common import at_exit, fresh_path, prepare, stash, tidy

WIDTH = 192
#: Bytes of media from which a task starts a new archive, bytes of one planned range, bytes of one Arrow batch.
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES = 64 << 20, 8 << 20, 4 << 20


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 text padded with spaces to a positive multiple of 192, and its length before."""
    raw = (text or "").encode()
    want = max(1, -(-len(raw) // WIDTH)) * WIDTH
    return raw.ljust(want, b" "), len(raw)


def encode_png(samples: bytes, level: int = 4) -> bytes:
    """8-bit grey image of WIDTH columns."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter byte 0: none
    lines[:, 1:] = rows
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + chunk(b"IEND", b"")


def decode_png(media: bytes) -> np.ndarray:
    """Samples (rows, columns) of an 8-bit grey image without row filters; checks every chunk's sum."""
    if media[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG image")
    at, data, size = 8, [], None
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + n]
        if struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, interlace) != (8, 0, 0):
                raise ValueError("only 8-bit grey images without interlacing")
            size = (height, width)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[0], size[1] + 1)
    if lines[:, 0].any():
        raise ValueError("row filters are not supported")
    return lines[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Size, mean, and a 64-bit average hash over an 8 x 8 grid, as text."""
    rows, columns = samples.shape
    y = np.minimum(np.arange(8) * rows // 8, rows - 1)
    x = np.arange(8) * columns // 8
    sums = np.add.reduceat(np.add.reduceat(samples.astype(np.int64), np.unique(y), 0), x, 1)
    grid = sums[np.searchsorted(np.unique(y), y)]
    bits = (grid > np.median(grid)).ravel()
    return f"{columns}x{rows}:{int(samples.sum()) * 1000 // samples.size}:{np.packbits(bits).tobytes().hex()}"


def _open(uri: str):
    """File system and path of a URI; a bare path is a local one."""
    return pa.fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "") if uri.startswith("file:/") else uri)


def write_archives(docs: DataFrame, folder: str) -> DataFrame:
    """Writes the payloads of docs (doc_id, text) under folder; returns (archive, members, bytes), already computed.

    Archives of failed attempts may lie in the folder too: read only those that the result lists.
    """

    def run(batches):
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        out, archive, name, members = None, None, "", 0

        def close():
            nonlocal archive
            archive.close()
            size = out.tell()
            out.close()
            archive = None
            return pa.RecordBatch.from_pydict({"archive": [name], "members": [members], "bytes": [size]}, schema=pa.schema([("archive", pa.string()), ("members", pa.int64()), ("bytes", pa.int64())]))

        for batch in batches:
            for k in range(batch.num_rows):
                if archive is None:
                    name, members = f"{uuid.uuid4().hex}.zip", 0
                    out = fs.open_output_stream(f"{base}/{name}")
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
                doc = batch.column(0)[k].as_py()
                samples, n = payload(batch.column(1)[k].as_py())
                archive.writestr(f"{members}/{'null' if doc is None else doc}/{n}.png", encode_png(samples))
                members += 1
                if out.tell() >= ARCHIVE_BYTES:
                    yield close()
        if archive is not None:
            yield close()

    return stash(docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(tidy(run), "archive string, members long, bytes long"), "archives")


class _Range(InputPartition):
    def __init__(self, archive: str, start: int, stop: int):
        self.archive, self.start, self.stop = archive, start, stop


MEMBER_SCHEMA = "doc_id long, n_bytes long, archive string, offset long, media binary, error string"


class MediaArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.only = set(filter(None, options.get("archives", "").split(",")))
        self.range = int(options.get("rangebytes", RANGE_BYTES))
        self.attempts = int(options.get("attempts", 3))

    def partitions(self):
        fs, base = _open(self.folder)
        files = [f for f in fs.get_file_info(pa.fs.FileSelector(base, allow_not_found=True)) if f.extension == "zip" and (not self.only or f.base_name in self.only)]
        return [_Range(f.base_name, at, min(at + self.range, f.size)) for f in sorted(files, key=lambda f: f.base_name) for at in range(0, f.size, self.range)] or [_Range("", 0, 0)]

    def _members(self, fs, path: str, start: int, stop: int):
        with fs.open_input_file(path) as f, zipfile.ZipFile(f) as z:
            return [(i.header_offset, i.filename, i.file_size) for i in z.infolist() if start <= i.header_offset < stop]

    def _fetch(self, fs, path: str, handle, offset: int, size: int) -> bytes:
        """The stored bytes of the member at an offset: local header, then data."""
        handle.seek(offset)
        head = handle.read(30)
        if head[:4] != b"PK\3\4":
            raise ValueError("no member here")
        name, extra = struct.unpack("<HH", head[26:30])
        crc = struct.unpack("<I", head[14:18])[0]
        body = handle.read(name + extra + size)[name + extra :]
        if len(body) != size or crc and zlib.crc32(body) != crc:
            raise ValueError("damaged member")
        decode_png(body)
        return body

    def read(self, part):
        if not part.archive:
            return
        fs, base = _open(self.folder)
        path = f"{base}/{part.archive}"
        rows, held = [], 0
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("media", pa.binary()), ("error", pa.string())])
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
        handle = fs.open_input_file(path)
        for offset, name, size in self._members(fs, path, part.start, part.stop):
            _, doc, n = name.removesuffix(".png").split("/")
            media, error = None, None
            for _ in range(self.attempts):
                try:
                    media, error = self._fetch(fs, path, handle, offset, size), None
                    break
                except (OSError, ValueError, zlib.error, struct.error) as e:
                    error = f"{type(e).__name__}: {e}"
                    handle.close()
                    handle = fs.open_input_file(path)
            rows.append((None if doc == "null" else int(doc), int(n), part.archive, offset, media, error))
            held += size
            if held >= BATCH_BYTES:
                yield batch()
                rows, held = [], 0
        handle.close()
        if rows:
            yield batch()


class MediaArchiveSource(DataSource):
    """spark.read.format("media_archive").load(folder); options: archives (names, by comma), rangebytes, attempts."""

    @classmethod
    def name(cls):
        return "media_archive"

    def schema(self):
        return MEMBER_SCHEMA

    def reader(self, schema):
        return MediaArchiveReader(self.options)


def read_archives(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(MediaArchiveSource)
    return spark.read.format("media_archive").options(**options).load(folder)


def media_features(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, error): through the archives."""
    spark = docs.sparkSession
    prepare(spark)
    folder = fresh_path(spark, "media")
    listed = write_archives(docs, folder)
    for path in (folder, listed._stash_path):  # the result reads them
        at_exit(spark, path)
    # attempts that failed leave archives that no result lists; a folder of this run's own holds few of them
    members = read_archives(spark, folder).join(listed.select("archive"), "archive", "left_semi")

    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error")}
            for doc, n, media, error in zip(*(batch.column(k).to_pylist() for k in range(4))):
                samples = decode_png(media) if media is not None else None
                raw = samples.tobytes() if samples is not None else None
                values = (doc, n, *((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)) if raw is not None else (None,) * 6), error)
                for k, v in zip(out, values):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("error", pa.string())]))

    return members.select("doc_id", "n_bytes", "media", "error").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")
