"""Session helpers shared by every operator: spreading small inputs and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset and the session is local
    (tests, a laptop) a folder of this machine is made, kept for the life of the session.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that every machine of the cluster can reach")
        named = "file://" + tempfile.mkdtemp(prefix="gleaner-scratch-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: Spark's setting by which the shuffle files of a query are removed as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, clean: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written.

    Cuts the lineage, survives lost executors, and computes each partition once (an eager
    ``checkpoint()`` of an uncached plan would run its last stage twice). ``clean`` removes its shuffle
    files at once instead of whenever the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/gleaner/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true" if clean else before)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def still_there(df: DataFrame) -> bool:
    """Whether the files of a scan still exist (someone may have emptied the shared folder)."""
    spark = df.sparkSession
    files = df.inputFiles()
    if not files:
        return False
    path = spark._jvm.org.apache.hadoop.fs.Path(files[0])
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to ``path`` to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def drop(spark: SparkSession, path: str) -> None:
    """Remove a table, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def kept(path: str, make) -> DataFrame:
    """The table at ``path``; ``make()`` is written there if it isn't complete."""
    spark = SparkSession.active()
    if not written(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def parallelism(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, 1)


def spread(df: DataFrame) -> DataFrame:
    """Repartition only when a scan has fewer splits than the cluster has cores.

    A single small file is one split, which would run a heavy per-row stage in one task; a
    large input has splits enough and is left alone (no shuffle of the texts).
    """
    cores = parallelism(df.sparkSession)
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session (they may not have it installed)."""
    sc = spark.sparkContext
    if getattr(sc, "_gleaner_shipped", False):
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="gleaner-code-")) / "gleaner.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, Path(here.name) / p.relative_to(here))
    sc.addPyFile(str(target))
    sc._gleaner_shipped = True


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``df.mapInArrow`` with the package at hand on every worker."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


#: Rows, and bytes of their strings, up to which a side may be broadcast by hint; beyond it Spark plans the join itself.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 64_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting that ``df`` has no more than ``rows`` rows and few enough bytes (once for the same object)."""
    known = df.__dict__.setdefault("_gleaner_small", {})
    if rows not in known:
        texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
        texts += [F.coalesce(F.octet_length(F.array_join(c, "")), F.lit(0)) for c, kind in df.dtypes if kind == "array<string>"]
        n, size = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(sum(texts, F.lit(0))), F.lit(0))).first()
        known[rows] = n <= rows and size <= BROADCAST_BYTES
    return F.broadcast(df) if known[rows] else df
