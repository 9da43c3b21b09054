"""Session helpers: table loading, shared-folder materialisation, size checks."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

import kgweave

# Functions of this package are sent to the workers by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(kgweave)

#: Largest side that is broadcast by an explicit hint, in bytes of its data.
BROADCAST_BYTES = 64 << 20

_own: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a local one where that is unset and the session runs
    on one machine (tests). On a cluster without one this raises: executors would write to disks of their own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        where = _own.get(app) or _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="kgweave-"))
    return where.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """A folder of its own in the shared one, deleted at exit."""
    path = f"{shared_dir(spark)}/kgweave/{re.sub(r'[^a-z0-9]', '', what)}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, what: str = "t") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and survives the loss of executors."""
    path = new_folder(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_counted(df: DataFrame, counted: Column, what: str = "t") -> tuple[DataFrame, int]:
    """As materialize, with how many rows meet a condition, counted as they are written: no job of its own. Tasks that
    run again may count their rows again; a count of 0 is exact."""
    seen = Observation()
    written = materialize(df.observe(seen, F.count_if(counted).alias("n")), what)
    return written, seen.get["n"]


#: Rows of one key from which it is joined on its own.
HEAVY_ROWS = 1_000_000


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str = "inner", heavy_rows: int | None = None) -> DataFrame:
    """left joined with right, unique by key, where a key may hold any share of left's rows. how: inner or left.

    Keys with heavy_rows rows or more are few by construction (rows of left / heavy_rows); their rows of right are
    broadcast, so left's stay where they are. All other keys take a shuffled join. left is read more than once, so it is
    best a written table."""
    least = HEAVY_ROWS if heavy_rows is None else heavy_rows
    heavy = left.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select(key)
    hot = F.broadcast(right.join(F.broadcast(heavy), key, "left_semi").withColumn("__hot", F.lit(True)))
    met = left.join(hot, key, "left")
    cold = met.where("__hot is null").select(*left.columns).join(right, key, how)
    return met.where("__hot").drop("__hot").unionByName(cold.select(*[c for c in met.columns if c != "__hot"]))


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def discard(*frames: DataFrame) -> None:
    """Delete materialised tables that no later plan reads."""
    for df in frames:
        for f in df.inputFiles()[:1]:
            for spark, path in list(_written):
                if path.rpartition("/")[2] in f:
                    _delete(spark, path)
                    _written.remove((spark, path))


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:
            pass


def small_enough(df: DataFrame, bytes_a_row: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most limit bytes at bytes_a_row each; stops counting just beyond the bound."""
    most = limit // bytes_a_row
    return df.limit(most + 1).count() <= most


def lanes(spark: SparkSession) -> int:
    """Partitions worth having: the session's shuffle partitions, at least the cores."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
