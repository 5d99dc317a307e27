"""What is stored of recordings: upload checks, sealed chunks with range reads, byte ranges, cached results of stages."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import opened

#: Accepted extensions, and limits of size and duration.
EXTENSIONS = ["mp3", "wav", "m4a", "aac", "flac", "ogg"]
MOST_BYTES, MOST_SECONDS = 4 * 1024**3, 12 * 3600
CHUNK = 1 << 20
#: Bytes that are hashed at a time.
PIECE = 8 << 20


def upload_error(name: Column, size: Column, seconds: Column | None = None) -> Column:
    """Why an upload is refused, null if it is not: its extension, its size (none or too much), its duration."""
    extension = F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))
    error = F.when(F.coalesce(~extension.isin(EXTENSIONS), F.lit(True)), "extension").when(size > MOST_BYTES, "too_large").when(F.coalesce(size, F.lit(0)) == 0, "empty")
    return error if seconds is None else error.when(seconds.isNull(), "not_audio").when(seconds > MOST_SECONDS, "too_long")


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """path, size, file_hash (SHA-256) and error of each file below path; refused ones have no hash, files that can't be
    read have the error unreadable. Files are hashed piece by piece where they lie, so none has to fit a row. Files
    without a byte are skipped by the file source; upload_error() is for those whose size is known otherwise."""

    def hashed(name: str) -> tuple[str | None, str | None]:
        digest = hashlib.sha256()
        try:
            with opened(name) as file:
                while piece := file.read(PIECE):
                    digest.update(piece)
        except (OSError, ValueError):
            return None, "unreadable"
        return digest.hexdigest(), None

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [hashed(p) if e is None else (None, e) for p, e in zip(batch["path"], batch["error"], strict=True)]
            yield pd.DataFrame({"path": batch["path"], "size": batch["size"], "file_hash": [f[0] for f in found], "error": [f[1] for f in found]}, dtype=object).astype({"size": "int64"})

    # Without its content a file's row is small; the files themselves are read in the tasks.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    listed = files.select("path", F.col("length").alias("size"), upload_error(F.col("path"), F.col("length")).alias("error"))
    return listed.mapInPandas(each, "path string, size long, file_hash string, error string")


def _key(secret: str | Column) -> Column:
    """The key of a secret; as a column, the secret is no part of the plan."""
    return F.unhex(F.sha2(F.encode(F.concat(F.lit("parley-at-rest:"), F.lit(secret)), "UTF-8"), 256))


def seal(files: DataFrame, id_: str, content: str, secret: str | Column, chunk: int = CHUNK) -> DataFrame:
    """files(id, content) -> (id, part, sealed): each chunk encrypted by AES-256-GCM with a nonce of its own, bound to its
    file and place. An empty file has one empty chunk, a null one none."""
    parts = F.sequence(F.lit(0), F.greatest(F.ceil(F.octet_length(content) / chunk).cast("int") - 1, F.lit(0)))
    each = files.where(F.col(content).isNotNull()).select(F.col(id_), F.col(content).cast("binary").alias("_content"), F.explode(parts).alias("part"))
    piece = F.substring("_content", F.col("part") * chunk + 1, F.lit(chunk))
    return each.select(id_, "part", F.aes_encrypt(piece, _key(secret), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b"").cast("binary"), _place(id_)).alias("sealed"))


def _place(id_: str) -> Column:
    return F.concat_ws(":", F.col(id_).cast("string"), F.col("part").cast("string"))


def read_range(sealed: DataFrame, id_: str, start: int, length: int, secret: str | Column, chunk: int = CHUNK) -> DataFrame:
    """(id, content): bytes start to start + length of each file; only the chunks that hold them are decrypted. Files
    that end before have what they have."""
    first, last = start // chunk, (start + length - 1) // chunk
    opened = sealed.where(F.col("part").between(first, last)).select(id_, "part", F.aes_decrypt("sealed", _key(secret), F.lit("GCM"), F.lit("DEFAULT"), _place(id_)).alias("piece"))
    joined = opened.groupBy(id_).agg(F.array_sort(F.collect_list(F.struct("part", "piece"))).alias("pieces"))
    whole = F.unhex(F.array_join(F.transform("pieces", lambda x: F.hex(x["piece"])), ""))
    return joined.select(id_, F.substring(whole, start - first * chunk + 1, length).alias("content"))


def byte_range(header: Column, size: Column) -> Column:
    """Struct of status, first and last of a Range header: 206 with the bytes to send, 416 if there are none, 200 and all
    bytes for a header that is missing or not of the form bytes=a-b, bytes=a- or bytes=-n."""
    a, b = (F.nullif(F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", i), F.lit("")).try_cast("long") for i in (1, 2))
    first = F.when(a.isNull(), F.greatest(size - b, F.lit(0))).otherwise(a)
    last = F.when(a.isNull() | b.isNull(), size - 1).otherwise(F.least(b, size - 1))
    ranged = F.coalesce(a, b).isNotNull()
    fits = F.coalesce((first < size) & (first <= last), F.lit(False))
    return F.struct(
        F.when(~ranged, 200).when(fits, 206).otherwise(416).alias("status"),
        F.when(~ranged, F.lit(0).cast("long")).when(fits, first).alias("first"),
        F.when(~ranged, size - 1).when(fits, last).alias("last"),
    )


def config_hash(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the parts as a JSON list; nulls are kept."""
    return F.substring(F.sha2(F.to_json(F.array(*(F.coalesce(F.to_json(F.struct(p.alias("v"))), F.lit("{}")) for p in parts))), 256), 1, 16)


CACHE_KEY = ["org_id", "file_hash", "stage", "config_hash"]


def cache_put(rows: DataFrame, path: str) -> None:
    """Add rows(org_id, file_hash, stage, config_hash, value); a later value of the same key replaces an earlier one.
    Rows without a file_hash are left out. Files are kept apart by organisation and the hash's first two digits."""
    kept = rows.where("file_hash is not null").select(*CACHE_KEY, F.col("value").cast("string"), F.current_timestamp().alias("put_at"), F.substring("file_hash", 1, 2).alias("prefix"), F.lit(False).alias("purged"))
    kept.write.mode("append").partitionBy("org_id", "prefix").parquet(path)


def cache_purge(gone: DataFrame, path: str) -> None:
    """Forget all results of gone(org_id, file_hash): a mark is added that hides what was put before."""
    marks = gone.where("file_hash is not null").select("org_id", "file_hash", F.lit(None).cast("string").alias("stage"), F.lit(None).cast("string").alias("config_hash"), F.lit(None).cast("string").alias("value"), F.current_timestamp().alias("put_at"), F.substring("file_hash", 1, 2).alias("prefix"), F.lit(True).alias("purged"))
    marks.write.mode("append").partitionBy("org_id", "prefix").parquet(path)


def cache_get(asked: DataFrame, path: str) -> DataFrame:
    """asked(org_id, file_hash, stage, config_hash, ...) with value, null where nothing is stored for the key."""
    # Only partitions and files' rows that are asked for are grouped.
    wanted = asked.where("file_hash is not null").select("org_id", F.substring("file_hash", 1, 2).alias("prefix"), "file_hash").distinct()
    stored = asked.sparkSession.read.parquet(path).join(wanted, ["org_id", "prefix", "file_hash"], "left_semi")
    one = stored.where("not purged").groupBy(*CACHE_KEY).agg(F.max(F.struct("put_at", "value")).alias("_newest"))
    purged = stored.where("purged").groupBy("org_id", "file_hash").agg(F.max("put_at").alias("_purged"))
    live = one.join(purged, ["org_id", "file_hash"], "left").where("_purged is null or _newest.put_at > _purged")
    return asked.join(live.select(*CACHE_KEY, F.col("_newest.value").alias("value")), CACHE_KEY, "left")
