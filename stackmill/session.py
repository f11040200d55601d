"""Session building and lineage cutting."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "stackmill", cpus: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings their own."""
    return (
        SparkSession.builder.master(f"local[{cpus or os.environ.get('BENCH_CPUS', '8')}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("STACKMILL_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point the context at the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``. Only where the session names none and runs in
    one machine's memory (``local``) a temporary folder is used; a cluster without the setting is
    an error, as a machine-local folder would be lost with its executor.
    """
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return
    folder = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="stackmill-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a compressed table into the shared checkpoint folder and go on from there.

    Unlike a checkpoint, the table is columnar: what follows reads only the columns it needs. The
    folder belongs to the session's application and is removed when the application ends.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    if not _FOLDERS:
        atexit.register(_clean, spark)
    _FOLDERS.append(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out.cut_folder = folder
    return out


def discard(table: DataFrame) -> None:
    """Remove a table made by ``cut`` that nothing reads any more, as the rounds of a loop leave them behind."""
    folder = getattr(table, "cut_folder", None)
    if folder in _FOLDERS:
        _delete(table.sparkSession, folder)
        _FOLDERS.remove(folder)


def _delete(spark: SparkSession, folder: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


_FOLDERS: list[str] = []


def _clean(spark: SparkSession) -> None:
    """Remove the tables of this application; a stopped session leaves them to the folder's owner."""
    try:
        for folder in _FOLDERS:
            _delete(spark, folder)
    except Exception:  # noqa: BLE001 - the gateway may be gone when the interpreter ends
        return
