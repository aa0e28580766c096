"""Session helpers: a local session for tests, the shared folder for cut lineage, written stage tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g", shared: str | None = None) -> SparkSession:
    """A session for tests and local benchmarks; a cluster brings its own. shared is the folder for stage tables, one of
    its own for the session if it is not given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("threadloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", shared or "file://" + tempfile.mkdtemp(prefix="threadloom-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by spark.checkpoint.dir.

    Only a single-JVM session (master local or local[n]) may fall back to a temporary folder of the machine;
    on a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
        base = getattr(sc, "_threadloom_dir", None)
        if base is None:
            base = sc._threadloom_dir = "file://" + tempfile.mkdtemp(prefix="threadloom-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


class StageTables:
    """Tables written to the shared folder to cut lineage; they survive the loss of an executor.

    drop() removes one early; whatever is left goes when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop_all)

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may have ended
            pass

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        self._delete(f"{self.root}/{name}")

    def drop_all(self) -> None:
        self._delete(self.root)
