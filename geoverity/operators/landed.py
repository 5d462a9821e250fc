"""Landed payload files (S3-S6): format detection, decompression, recency.

Landed files are rows ``(file_id, path, payload[, content_type, mtime])`` --
e.g. from ``spark.read.format("binaryFile")`` or a table of fetched pages.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def detect_payload_format(content) -> Column:
    """S3 on raw bytes: parses as JSON -> json; valid UTF-8 -> csv; else json."""
    b = _c(content)
    parses = F.try_parse_json(F.try_validate_utf8(b.cast("string"))).isNotNull()
    utf8 = F.is_valid_utf8(b.cast("string"))
    return F.when(parses, F.lit("json")).when(utf8, F.lit("csv")).otherwise(F.lit("json"))


def classify_landed_file(content, content_type=None) -> Column:
    """Content-type substrings (json; csv / text/comma-separated; html;
    zip; gzip -- so ``application/gzip`` reads as zip), then magic bytes (PK
    header, gzip header; needs >= 4 bytes), then JSON text that parses, then
    ``<html`` / ``<!doctype`` in the first 4096 bytes, then CSV (more than one
    line and a comma in the first), else unknown."""
    b = _c(content)
    ct = F.lower(F.coalesce(_c(content_type), F.lit(""))) if content_type is not None else F.lit("")
    head4 = F.hex(F.substring(b, 1, 4))
    sample = F.make_valid_utf8(F.substring(b, 1, 4096).cast("string"))
    sample_s = F.trim(sample)
    sample_l = F.lower(sample)
    lines = F.split(sample, "\n")
    json_like = (sample_s.startswith("{") | sample_s.startswith("[")) & \
        F.try_parse_json(F.try_validate_utf8(b.cast("string"))).isNotNull()
    return (F.when(ct.contains("json"), F.lit("json"))
             .when(ct.contains("csv") | ct.contains("text/comma-separated"), F.lit("csv"))
             .when(ct.contains("html"), F.lit("html"))
             .when(ct.contains("zip"), F.lit("zip"))
             .when(ct.contains("gzip") | ct.contains("x-gzip"), F.lit("gzip"))
             .when((F.length(b) >= 4) & (head4 == "504B0304"), F.lit("zip"))
             .when((F.length(b) >= 4) & head4.startswith("1F8B"), F.lit("gzip"))
             .when(json_like, F.lit("json"))
             .when(sample_l.contains("<html") | sample_l.contains("<!doctype"), F.lit("html"))
             .when((F.size(lines) > 1) & F.element_at(lines, 1).contains(","), F.lit("csv"))
             .otherwise(F.lit("unknown")))


#: Bytes of a part of an inflated payload.
PART_BYTES = 1 << 20


def _gunzipped(payload: bytes, size: int) -> Iterator[bytes]:
    """The content of a gzip file, of all its members, in parts of at most ``size`` bytes."""
    rest = payload
    while rest:
        stream = zlib.decompressobj(31)
        while not stream.eof:
            part = stream.decompress(rest, size)
            rest = stream.unconsumed_tail
            if part:
                yield part
            elif not rest and not stream.eof:
                raise EOFError("the file ends within a member")
        rest = stream.unused_data.lstrip(b"\0")  # zeros may pad a file


def _members(payload: bytes | None, fmt: str | None, size: int) -> Iterator[tuple[str | None, Iterator[bytes]]]:
    """(name, parts) of the files in a payload; one without a name if it is no archive."""
    if payload is not None and fmt == "gzip":
        yield None, _gunzipped(payload, size)
    elif payload is not None and fmt == "zip":
        with zipfile.ZipFile(io.BytesIO(payload)) as archive:
            infos = [i for i in archive.infolist() if not i.is_dir()]
            for info in infos:
                with archive.open(info) as member:
                    yield info.filename, iter(lambda m=member: m.read(size), b"")
            if not infos:
                yield None, iter([payload])  # an empty archive passes through
    elif payload is not None:
        yield None, (payload[at:at + size] for at in range(0, len(payload), size))


def inflated(files: DataFrame, key: str = "file_id", size: int = PART_BYTES) -> DataFrame:
    """(key, member, name, part, data, error) -- every member of zip archives (read by their central directory) and
    gzip files, other payloads as they are, in parts of at most ``size`` bytes. A task inflates as a stream and holds
    one part, however large the content is. An archive that can't be read gives what came before and a row with the
    error; an empty member a part without bytes; a null payload nothing."""
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                member, part, name = 0, 0, None

                def out(data: bytes | None, error: str | None = None) -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays(
                        [row.column(0), pa.array([member], pa.int32()), pa.array([name], pa.string()), pa.array([part], pa.int64()),
                         pa.array([data], pa.binary()), pa.array([error], pa.string())],
                        [key, "member", "name", "part", "data", "error"])

                try:
                    for member, (name, parts) in enumerate(_members(row.column(1)[0].as_py(), row.column(2)[0].as_py(), size)):
                        part = 0
                        for data in parts:
                            yield out(data)
                            part += 1
                        if not part:
                            yield out(b"")
                except (OSError, EOFError, zlib.error, zipfile.BadZipFile, NotImplementedError, RuntimeError) as e:
                    yield out(None, f"{type(e).__name__}: {e}")

    schema = f"`{key}` {kind}, member int, name string, part bigint, data binary, error string"
    return files.select(key, "payload", "format").mapInArrow(run, schema)


def decompress_payloads(files: DataFrame, key: str | None = None) -> DataFrame:
    """S5, one row for each file: gunzipped, or the first member of a zip archive; other payloads pass through. An
    archive that can't be read has a null payload. ``inflated`` is the form for contents that no row can hold. ``key``: a
    unique column (the first)."""
    key = key or files.columns[0]
    parts = inflated(files, key).where("member = 0")
    whole = F.array_sort(F.collect_list(F.struct("part", "data")))
    joined = F.aggregate(whole["data"], F.unhex(F.lit("")), lambda a, b: F.concat(a, b))
    content = parts.groupBy(key).agg(F.when(F.max("error").isNull(), joined).alias("_content"))
    return files.drop("payload").join(content, key, "left").withColumnRenamed("_content", "payload").select(*files.columns)


def latest_landed_file(files: DataFrame, order: str = "mtime") -> DataFrame:
    """The most recent file (a global ``max_by`` -- combined map-side)."""
    cols = [c for c in files.columns if c != "payload"]
    return files.agg(F.max_by(F.struct(*cols), F.col(order)).alias("_f")).select("_f.*")


def list_landed_files(files: DataFrame, order: str = "mtime") -> DataFrame:
    """S6 list: newest first (a range-partitioned sort)."""
    return files.drop("payload").orderBy(F.col(order).desc())
