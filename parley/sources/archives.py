"""ZIP archives as tables: the central directory first, then members apart from each other, by any number of tasks."""

from __future__ import annotations

import struct
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import opened

ENTRIES = "archive string, name string, method int, packed long, size long, crc long, at long, error string"
#: Members of more bytes than this are not read into a row.
MOST = 1 << 30


def unsafe(name: str) -> bool:
    """Whether a member's name leads, or may lead, out of the folder that it is put into."""
    parts = name.replace("\\", "/").split("/")
    return not name or "\0" in name or parts[0] == "" or ".." in parts or (len(parts[0]) > 1 and parts[0][1] == ":")


def entries(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """paths(archive) -> ENTRIES: the members that the central directories name, folders left out; of each archive only its
    end is read. error: unreadable (the archive, with null for a name), unsafe_name, encrypted, method, too_large."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive in batch["archive"]:
                rows = []
                try:
                    with opened(archive) as file, zipfile.ZipFile(file) as listed:
                        for x in listed.infolist():
                            if x.is_dir() and not unsafe(x.filename.rstrip("/") or "/"):
                                continue
                            # What the directory holds, not what the module makes of it.
                            name = x.orig_filename
                            error = "unsafe_name" if unsafe(name) else "encrypted" if x.flag_bits & 1 else "method" if x.compress_type not in (0, 8) else "too_large" if x.file_size > MOST else None
                            rows.append((archive, name, x.compress_type, x.compress_size, x.file_size, x.CRC, x.header_offset, error))
                except (OSError, ValueError, zipfile.BadZipFile, EOFError, struct.error):
                    rows = [(archive, None, None, None, None, None, None, "unreadable")]
                frame = pd.DataFrame(rows, columns=["archive", "name", "method", "packed", "size", "crc", "at", "error"], dtype=object)
                yield frame.astype({"method": "Int32", "packed": "Int64", "size": "Int64", "crc": "Int64", "at": "Int64"})

    return paths.select("archive").where("archive is not null").distinct().mapInPandas(each, ENTRIES)


def read_members(listed: DataFrame) -> DataFrame:
    """entries() -> archive, name, size, content, error; content is null where there is an error. Members are dealt by bytes,
    so one archive is read by many tasks, each of which seeks to its members. error adds damaged: a member cut off, of
    another size or with another checksum than the directory says."""

    def one(file, row) -> bytes | None:
        # Beside members without figures, whole numbers come as floats.
        at, size, length = int(row.at), int(row.packed), int(row.size)
        head = file.read_at(30, at)
        if len(head) < 30 or head[:4] != b"PK\x03\x04":
            return None
        skip = sum(struct.unpack("<HH", head[26:30]))
        packed = file.read_at(size, at + 30 + skip)
        try:
            data = packed if row.method == 0 else _inflated(packed, length)
        except zlib.error:
            return None
        return data if len(data) == length and zlib.crc32(data) == int(row.crc) else None

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, file = None, None
        for batch in batches:
            contents, errors = [], []
            for row in batch.itertuples(index=False):
                content = None
                if row.error is None:
                    if row.archive != name:
                        name, file = row.archive, opened(row.archive)
                    content = one(file, row)
                contents.append(content)
                errors.append(row.error if row.error is not None else "damaged" if content is None else None)
            yield pd.DataFrame({"archive": batch["archive"], "name": batch["name"], "size": batch["size"].astype("Int64"), "content": contents, "error": errors})

    dealt = listed.repartitionByRange("archive", "at").sortWithinPartitions("archive", "at")
    return dealt.mapInPandas(each, "archive string, name string, size long, content binary, error string")


def _inflated(packed: bytes, size: int) -> bytes:
    """No more than one byte beyond `size`, whatever a hostile member would grow to."""
    return zlib.decompressobj(-15).decompress(packed, size + 1)


def import_rows(members: DataFrame, manifest: DataFrame) -> DataFrame:
    """manifest(audio, ...) with content and error: missing if the archives hold no such member. A name that several
    archives hold is taken from the first of them."""
    first = members.groupBy("name").agg(F.min("archive").alias("archive"))
    held = members.join(first, ["name", "archive"]).dropDuplicates(["name"]).select(F.col("name").alias("audio"), "content", F.col("error").alias("_error"), F.lit(True).alias("_held"))
    met = manifest.join(held, "audio", "left")
    return met.withColumn("error", F.when(F.col("_held").isNull(), "missing").otherwise(F.col("_error"))).drop("_held", "_error")
