"""Session helpers: sessions for local use, table access and tables that cut lineage."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = "*", app: str = "quillspark", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_quillspark_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():
        target = Path(tempfile.mkdtemp(prefix="quillspark-zip-")) / "quillspark_package.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for file in sorted(root.rglob("*.py")):
                archive.write(file, f"quillspark/{file.relative_to(root)}")
        context.addPyFile(str(target))
        atexit.register(shutil.rmtree, target.parent, ignore_errors=True)
    context._quillspark_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables below ``sf_dir`` (a file or a folder of files)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext._conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
        atexit.register(drop_path, spark, found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, also after its session has stopped."""
    here = re.sub("^file:/*", "/", path)
    if path.startswith("file:") or (path.startswith("/") and os.path.isdir(here)):
        shutil.rmtree(here, ignore_errors=True)
        return
    try:
        jvm = SparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(target, True)
    except Exception:  # the JVM may be gone already
        pass


def _new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def write(df: DataFrame, path: str, *by: str) -> None:
    """Write ``df`` as files below ``path``, in folders of ``by``; the shuffle files that takes go when it ends.

    Else they lie on the executors' disks until the driver happens to collect its garbage.
    """
    conf = df.sparkSession.conf
    was = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(path)
    finally:
        conf.unset(_CLEANUP) if was is None else conf.set(_CLEANUP, was)


def materialize(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: what follows reads files that outlive any executor. The files go when the process ends.
    """
    spark = df.sparkSession
    path = _new_path(spark, name)
    write(df, path)
    atexit.register(drop_path, spark, path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Materializes tables that one step needs; all of them go when the block ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            drop_path(self.spark, path)

    def __call__(self, df: DataFrame, name: str = "cut") -> DataFrame:
        path = _new_path(self.spark, name)
        self.paths.append(path)
        write(df, path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of this block that no later plan reads."""
        for table in tables:
            names = {f.rsplit("/", 2)[-2] for f in table.inputFiles()}
            for path in [p for p in self.paths if p.rsplit("/", 1)[1] in names]:
                self.paths.remove(path)
                drop_path(self.spark, path)


def partitions_for(rows: int, rows_each: int, spark: SparkSession) -> int:
    """Partitions so that each holds about ``rows_each`` rows, and the cores have work."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // max(1, rows_each)))


def spread(df: DataFrame) -> DataFrame:
    """``df`` on as many tasks as there are cores, where its few files would leave cores idle under heavy work."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def tokenizer_dir() -> str:
    """Where the public vocabulary files lie; ``QUILLSPARK_TOKENIZERS`` overrides it."""
    return os.environ.get("QUILLSPARK_TOKENIZERS", "/opt/tokenizers")
