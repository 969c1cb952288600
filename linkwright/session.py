"""Session settings, the shared folder, and size-checked joins."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its counted rows stay at or below this.
BROADCAST_ROWS = 100_000


def session(app: str = "linkwright", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine is tuned for."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder driver and executors share: spark.checkpoint.dir, or for local runs without it a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="linkwright-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return spark.sparkContext.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/linkwright/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.__dict__["_stored"] = path
    return table


def release(*tables: DataFrame) -> None:
    """Deletes materialised tables that nothing will read again, and lets the driver collect what finished shuffles it holds.

    Call it only once what was made from them is itself materialised: a lost
    executor's work is then redone from the successors.
    """
    for df in tables:
        path = df.__dict__.pop("_stored", None)
        if path:
            remove(df.sparkSession, path)
    gc.collect()
    spark = SparkSession.getActiveSession()
    if spark:
        spark._jvm.System.gc()


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system of a path, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def opens_shared(spark: SparkSession) -> bool:
    """Whether Python can open the shared folder by itself, so that tasks can read blocks of a table from there."""
    try:
        filesystem(shared_dir(spark))
    except (pa.ArrowException, OSError):
        return False
    return True


def dealt(df: DataFrame, name: str, block: str, n: int) -> str:
    """Path of a table in the shared folder with a folder for each of the n blocks (0 to n - 1), which ``read_block`` reads: a block may be read by many tasks, but is there once."""
    path = new_path(df.sparkSession, name)
    df.repartition(max(1, min(n, 1_000)), block).write.partitionBy(block).parquet(path)
    return path


def read_block(path: str, block: str, i: int, schema: pa.Schema) -> pa.Table:
    """A block of a table that ``dealt`` wrote; empty if no row was dealt to it."""
    system, root = filesystem(f"{path}/{block}={i}")
    if system.get_file_info(root).type == fs.FileType.NotFound:
        return schema.empty_table()
    return ds.dataset(root, schema=schema, filesystem=system, format="parquet").to_table(use_threads=False).combine_chunks()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def join_small(big: DataFrame, small: DataFrame, on: Column, how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``small`` if it has at most ``limit`` rows (counted), else leave a shuffled, skew-split join to AQE.

    Give a ``small`` that is cheap to count, such as a materialised table.
    """
    return big.join(F.broadcast(small) if is_small(small, limit) else small.hint("merge"), on, how)


def is_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether a table has at most ``limit`` rows; counting stops there."""
    return df.limit(limit + 1).count() <= limit


def unused(taken: list[str], *names: str) -> list[str]:
    """The names, lengthened until none of them is among those taken (as Spark compares names, in any case)."""
    out, seen = [], {t.lower() for t in taken}
    for name in names:
        while name.lower() in seen:
            name += "_"
        seen.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


