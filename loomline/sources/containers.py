"""Rows out of containers: entries of ZIP files and records of event streams."""

import io
import re
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_END = re.compile(r"\r\n|\r|\n")


def zip_entries(spark: SparkSession, path: str, most_bytes: int = 64 << 20) -> DataFrame:
    """(archive, name, bytes, content, refused) of every file in the ZIP files of a path.

    Refused entries keep no content: ``path`` (absolute, or steps upwards), ``method`` (neither
    stored nor deflated), ``size`` (over the bound an entry may take) and ``checksum``. A file
    that is no ZIP gives one row refused as ``archive``.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive, content in zip(frame["path"], frame["content"]):
                for row in entries(content, most_bytes):
                    yield pd.DataFrame([(archive, *row)], columns=["archive", "name", "bytes", "content", "refused"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "archive string, name string, bytes long, content binary, refused string")


def entries(archive: bytes, most_bytes: int) -> Iterator[tuple]:
    try:
        found = zipfile.ZipFile(io.BytesIO(archive))
    except zipfile.BadZipFile:
        yield None, None, None, "archive"
        return
    for info in found.infolist():
        if info.is_dir():
            continue
        name = info.filename
        if name.startswith("/") or "\\" in name or ":" in name or ".." in name.split("/"):
            yield name, info.file_size, None, "path"
        elif info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            yield name, info.file_size, None, "method"
        elif info.file_size > most_bytes:
            yield name, info.file_size, None, "size"
        else:
            try:
                yield name, info.file_size, found.read(info), None
            except (zipfile.BadZipFile, zlib.error):
                yield name, info.file_size, None, "checksum"


def stream_records(body: Column) -> Column:
    """Array of (event, data, id) records of a whole event stream; an unfinished last record is left out."""

    @F.pandas_udf("array<struct<event: string, data: string, id: string>>")
    def decode(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: [dict(zip(("event", "data", "id"), r)) for r in records(b or "")])

    return decode(body)


def records(body: str) -> Iterator[tuple[str, str, str | None]]:
    event, data, ident = "message", [], None
    for line in LINE_END.split(body)[:-1]:  # what follows the last line end is unfinished
        if not line:
            if data:
                yield event, "\n".join(data), ident
            event, data, ident = "message", [], None
            continue
        field, _, value = line.partition(":")
        value = value.removeprefix(" ")
        if field == "data":
            data.append(value)
        elif field == "event":
            event = value
        elif field == "id" and "\0" not in value:
            ident = value
