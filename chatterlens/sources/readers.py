"""Readers and writers (S01-S13) on Spark's own data sources.

Everything is a ``spark.read`` / ``df.write`` with an explicit schema; no
file is parsed on the driver.
"""

from __future__ import annotations

import uuid
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timeparts import utc_date

# --- fixed values: the stored-submission schema -------------------------------
POSTS_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("subreddit", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("selftext", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("created_utc", T.LongType()),
    T.StructField("ups", T.LongType()),
    T.StructField("upvote_ratio", T.DoubleType()),
    T.StructField("num_comments", T.LongType()),
    T.StructField("is_self", T.BooleanType()),
    T.StructField("removed_by_category", T.StringType()),
    T.StructField("award_name", T.StringType()),
    T.StructField("award_count", T.IntegerType()),
])
AWARDS_TYPE = "array<struct<name:string,count:int>>"
# ------------------------------------------------------------------------------


def read_posts_csv(spark: SparkSession, path: str, schema: T.StructType = POSTS_SCHEMA) -> DataFrame:
    """Stored posts as CSV with quoted multi-line text, explicit schema; an
    empty field is null, a quoted empty one the empty text."""
    return (spark.read.schema(schema).option("header", True).option("multiLine", True).option("nullValue", "\u0001")
            .option("escape", '"').option("quote", '"').csv(path))


def write_posts_csv(df: DataFrame, path: str) -> None:
    (df.write.mode("overwrite").option("header", True).option("escape", '"').option("quote", '"')
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def read_with_source(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Every file of a directory, with the file it came from."""
    return spark.read.format(fmt).load(path).withColumn("source_file", F.col("_metadata.file_path"))


def write_partitioned(df: DataFrame, path: str, cols=("subreddit", "date")) -> None:
    """Partitioned parquet (partition pruning on later reads)."""
    d = df if "date" in df.columns or "date" not in cols else df.withColumn("date", utc_date("created_utc"))
    d.write.mode("overwrite").partitionBy(*cols).parquet(path)


def compute_once(spark: SparkSession, path: str, build) -> DataFrame:
    """Materialise ``build()`` to ``path`` unless it already exists."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_vector_text(df: DataFrame, path: str, key: str = "word", vec: str = "vector") -> None:
    """``key v1 v2 ...`` lines (latin-1 safe text)."""
    line = F.concat_ws(" ", F.col(key), F.array_join(F.transform(vec, lambda x: x.cast("string")), " "))
    df.select(line.alias("value")).write.mode("overwrite").option("encoding", "ISO-8859-1").text(path)


def read_vector_text(spark: SparkSession, path: str) -> DataFrame:
    """A word-vector text file (word then floats, space separated, latin-1)."""
    raw = (spark.read.option("encoding", "ISO-8859-1").option("sep", "\u0001").option("quote", "")
           .schema("value string").csv(path))
    parts = F.split(F.col("value"), " ")
    return raw.select(parts[0].alias("word"),
                      F.slice(parts, 2, F.size(parts) - 1).cast("array<double>").alias("vector"))


def parse_printed_vector(c) -> F.Column:
    """S08/N06: '[ 1.5  2.  -3.1e-01]' style printed arrays -> array<double>."""
    x = F.regexp_replace(F.trim(F.col(c) if isinstance(c, str) else c), r"^\[\s*|\s*\]$", "")
    x = F.regexp_replace(x, r"\s+", ",")
    x = F.regexp_replace(x, r"(?<=[0-9])\.(?=,|$)", ".0")
    return F.from_json(F.concat(F.lit("["), x, F.lit("]")), "array<double>")


def day_windows(df: DataFrame, start_epoch: int, end_epoch: int, drop_last: bool = True) -> DataFrame:
    """Rows in half-open daily windows ``[d, d+1)`` from start to end;
    upstream's loop condition ``right < end`` drops the last day (kept as an
    option)."""
    n_days = (end_epoch - start_epoch) // 86400
    last = start_epoch + (n_days - (1 if drop_last else 0)) * 86400
    if not drop_last and (end_epoch - start_epoch) % 86400:
        last = end_epoch
    d = df.filter((F.col("created_utc") >= start_epoch) & (F.col("created_utc") < last))
    return d.withColumn("window_start", F.lit(start_epoch) + F.floor((F.col("created_utc") - start_epoch) / 86400) * 86400)


def read_labelled_dir(spark: SparkSession, path: str) -> DataFrame:
    """One text file per example under ``.../label=<pos|neg>/...``; label 1/0."""
    t = spark.read.text(path, wholetext=True)
    fp = F.col("_metadata.file_path")
    return t.select(F.regexp_extract(fp, r"doc=([0-9]+)", 1).cast("bigint").alias("doc_id"),
                    F.when(F.regexp_extract(fp, r"label=(pos|neg)", 1) == "pos", 1).otherwise(0).alias("label"),
                    F.col("value").alias("text"))


#: Folders of a label, so that none holds all of its files and their listing is dealt to tasks.
FOLDERS = 64


def _write_texts(root: str):
    """Writes sorted ``(folder, name, text)`` rows, a file for all rows of a name.  A file
    is moved to its name when whole, so a task that runs twice leaves the same files."""
    def write(batches):
        files, base = fs.FileSystem.from_uri(root)
        made, n = set(), 0
        rows = (row for x in batches for row in zip(*(c.to_pylist() for c in x.columns)))
        for (folder, name), texts in groupby(rows, key=itemgetter(0, 1)):
            at = f"{base}/{folder}"
            if at not in made:
                files.create_dir(at, recursive=True)
                made.add(at)
            own = f"{at}/.{name}-{uuid.uuid4().hex[:12]}"
            with files.open_output_stream(own) as out:
                for _, _, text in texts:
                    out.write((text or "").encode() + b"\n")
            files.move(own, f"{at}/{name}.txt")
            n += 1
        yield pa.record_batch([pa.array([n], pa.int64())], ["files"])
    return write


def write_labelled_dir(df: DataFrame, path: str) -> None:
    """Stage ``(doc_id, label, text)`` as one text file per document.  In a folder of the
    machines' own file system the tasks write the files themselves: Spark's writer makes
    a folder for each document, whose files the driver then moves one by one."""
    d = df.select(F.when(F.col("label") == 1, "pos").otherwise("neg").alias("label"),
                  F.col("doc_id").alias("doc"), "text")
    hpath = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = hpath.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
    if store.getUri().getScheme() != "file":
        d.repartition("doc").write.mode("overwrite").partitionBy("label", "doc").text(path)
        return
    root = store.makeQualified(hpath).toUri().getPath()
    files, base = fs.FileSystem.from_uri(root)
    files.create_dir(base, recursive=True)
    files.delete_dir_contents(base)
    name = F.concat(F.lit("doc="), F.coalesce(F.col("doc").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")))
    folder = F.concat(F.lit("label="), "label", F.lit("/part="), F.pmod(F.xxhash64("doc"), F.lit(FOLDERS)).cast("string"))
    rows = d.repartition("doc").select(folder.alias("folder"), name.alias("name"), "text").sortWithinPartitions("folder", "name")
    rows.mapInArrow(_write_texts(root), "files long").agg(F.sum("files")).collect()


def write_partitioned(df: DataFrame, path: str, by: list[str], spread: str, parts: int | None = None) -> None:
    """Parquet folders by the values of ``by``.  Rows are range-partitioned by ``by``
    and ``spread`` together, so a small folder is one file or two, and a hot one is
    written by many tasks, each a file."""
    order = [*by, spread]
    parted = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    parted.sortWithinPartitions(*by).write.partitionBy(*by).parquet(path)
