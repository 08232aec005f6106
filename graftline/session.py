"""Session helpers and lineage cuts that survive the loss of executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: Spark's setting by which the shuffle files of an execution are removed when it ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of unpacked rows beyond which a weighed table is never broadcast.
UNPACKED = 32 << 20


def get_spark(app: str = "graftline", master: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A session for local work; on a cluster the submitted configuration wins."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    return (
        b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``). Where the setting is missing, a local one serves a session in
    one process (``local[...]``); on a cluster the call fails, as executors share no local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="graftline-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Intermediate tables in the shared folder.

    ``cut`` writes a frame as Parquet and returns a frame that reads it back: the lineage ends there, what was
    computed survives lost executors, and the planner knows the table's true size. ``keep`` limits how many of the
    latest tables of one name stay, so an iteration doesn't fill the disk. ``lean``: the shuffle files that a table was
    made of go once it is written, not when the driver happens to collect its garbage. All is deleted when the session ends.

    Files of alike rows are packed to a fiftieth and less, but the planner takes their size for that of the rows and broadcasts
    millions of them. ``weigh`` counts the rows as they are written: joins with what is large unpacked are merge joins.
    """

    def __init__(self, spark: SparkSession, label: str, lean: bool = False):
        self.spark = spark
        self.lean = lean
        self.root = f"{shared_dir(spark)}/graftline-{label}-{uuid.uuid4().hex}"
        self._made: dict[str, list[str]] = {}
        self._n = 0
        atexit.register(self._at_exit)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{name}-{self._n}"

    def cut(self, df: DataFrame, name: str, keep: int = 0, weigh: bool = False) -> DataFrame:
        path, seen = self.path(name), Observation()
        before = self.spark.conf.get(SHUFFLES_GO, "false")
        try:
            self.spark.conf.set(SHUFFLES_GO, "true" if self.lean else before)
            (df.observe(seen, F.count(F.lit(1)).alias("rows")) if weigh else df).write.parquet(path)
        finally:
            self.spark.conf.set(SHUFFLES_GO, before)
        made = self._made.setdefault(name, [])
        made.append(path)
        while keep and len(made) > keep:
            drop_path(self.spark, made.pop(0))
        back = self.spark.read.schema(df.schema).parquet(path)
        return back.hint("merge") if weigh and seen.get["rows"] * (8 + back._jdf.schema().defaultSize()) > UNPACKED else back

    def grow(self, df: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
        """Write a frame beside what ``folder`` (a ``path`` of this scratch) holds; returns it alone, and all of the folder.

        However many rounds an iteration takes, what it has found stays one scan."""
        self._n += 1
        df.write.parquet(f"{folder}/{self._n}")
        alone = self.spark.read.schema(df.schema).parquet(f"{folder}/{self._n}")
        return alone, self.spark.read.schema(df.schema).option("recursiveFileLookup", "true").parquet(folder)

    def drop(self, name: str) -> None:
        for p in self._made.pop(name, []):
            drop_path(self.spark, p)

    def _at_exit(self) -> None:
        try:
            drop_path(self.spark, self.root)
        except Exception:
            pass
