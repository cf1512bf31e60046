"""What the corpus operators share: tables, words, the shared folder, guarded broadcasts."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: A side is broadcast only if it was measured and has no more rows and bytes than this.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where the session names none, a local one (tests) gets a temporary folder; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there and lost executors lose none of it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the files of a table made by written()."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def unused(df: DataFrame, name: str) -> str:
    """name, or name with underscores after it, such that no column of df is called so in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spread_join(rows: DataFrame, lookup: DataFrame, key: str, how: str = "inner", least: int = 1000, keys: int = 100_000) -> DataFrame:
    """rows.join(lookup, key, how), without a task that takes all rows of a frequent key; lookup has one row a key.

    A key is frequent if it has over `least` rows and over one `keys`-th of all, so there are never more than `keys` of
    them, and their part of lookup is broadcast.
    """
    n = rows.count()
    hot = written(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max(least, n // keys)).select(key), "hot")
    if hot.isEmpty():
        return rows.join(lookup, key, how)
    of_hot = F.broadcast(written(lookup.join(F.broadcast(hot), key, "left_semi"), "hot-lookup"))
    some = rows.join(F.broadcast(hot), key, "left_semi").join(of_hot, key, how)
    return some.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(lookup, key, how))


def release(spark: SparkSession) -> None:
    """Have Spark drop the shuffle files of finished jobs now; it does so when the driver collects garbage, at times its own cleaner sets."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def short_batches(spark: SparkSession, rows: int = 1000):
    """Within it, Arrow batches hold fewer rows: long texts then take little memory at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes; arrays count 16 for each element."""
    size = F.lit(0)
    for f in df.schema.fields:
        kind, own = f.dataType.typeName(), F.col(f"`{f.name}`")
        size = size + F.lit(8) + (F.coalesce(F.octet_length(own), F.lit(0)) if kind in ("string", "binary") else 16 * F.greatest(F.size(own), F.lit(0)) if kind == "array" else F.lit(16))
    return size


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcasting if it was measured to have at most `rows` rows and `size` bytes; else as it is."""
    n, held = df.agg(F.count(F.lit(1)), F.sum(_row_bytes(df))).first()
    return F.broadcast(df) if n <= rows and (held or 0) <= size else df
