"""What the operators of this subpackage have in common: lineage cuts, text normalisation, train/held-out split."""

from __future__ import annotations

import gc
import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of the alphanumeric word rule: every ASCII character that is no digit and no letter.
_ASCII_BREAKS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; a folder of our own only where none is set."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and context.master.startswith("local") and "cluster" not in context.master:
            named = tempfile.mkdtemp(prefix="parley-checkpoint-")
        context.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    # Constraints kept with a checkpoint can name columns it doesn't have, and then a join with itself can't be planned.
    name = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(name, "true")
    spark.conf.set(name, "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """df as Parquet in the shared checkpoint folder: columns that are not asked for later are not read again."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.option("parquet.enable.dictionary", "false").option("compression", compression).option("parquet.compression.codec.zstd.level", "1").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete the files of a table that `stored` wrote and that nothing reads any more."""
    spark = table.sparkSession
    for folder in {path.rpartition("/")[0] for path in table.inputFiles()}:
        if folder.rpartition("/")[2].startswith("table-"):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(df: DataFrame) -> None:
    """Let the cluster drop shuffle files and checkpoints of steps that nothing refers to any more; it does so when the
    driver collects garbage."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def hash_sample(docs: DataFrame, most_rows: int) -> list:
    """(h, text, lang if there is one) of the most_rows rows with the smallest hash of doc_id, or those of them that have a
    text, in a fixed order. The cutoff comes from ids alone, so that only texts of the sample travel."""
    h = unused("h", docs)
    marked = docs.withColumn(h, F.xxhash64("doc_id"))
    last = marked.select(h).orderBy(h).limit(most_rows).agg(F.max(h)).first()[0]
    if last is None:
        return []
    columns = [F.col(h).alias("h"), *(F.col(c).cast("string").alias(c) for c in ("text", "lang") if c in docs.columns)]
    # Rows that share the last hash are more than asked for only if a doc_id is repeated.
    rows = marked.where((F.col(h) <= F.lit(last)) & F.col("text").isNotNull()).select(*columns).limit(2 * most_rows).toLocalIterator()
    return sorted(rows, key=tuple)[:most_rows]


def unused(name: str, *tables: DataFrame) -> str:
    """A column name like `name` that none of the tables has."""
    taken = {c.lower() for table in tables for c in table.columns}
    while name in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of whole texts may weigh in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def alnum_words(text: Column) -> Column:
    """Lower-cased words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text, in order; a null text has none."""
    spaced = F.translate(text, string.ascii_uppercase + _ASCII_BREAKS, string.ascii_lowercase + " " * len(_ASCII_BREAKS))
    return F.coalesce(F.array_remove(F.split(spaced, " "), ""), F.array().cast("array<string>"))


def remainder(doc_id: Column | str) -> Column:
    """crc32(doc_id as text) mod 3; 1 marks the held-out rows, which never teach a label."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 3, F.lit(1))


def held_out(doc_id: Column | str) -> Column:
    return remainder(doc_id) == 1


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
