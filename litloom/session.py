"""Sessions, tables and the cutting of lineage."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int = 8, partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("litloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once an application: their Python workers import it."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        _SHIPPED.add(app)
        folder = tempfile.mkdtemp(prefix="litloom-")
        atexit.register(shutil.rmtree, folder, True)
        here = Path(__file__).resolve().parent
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/litloom", "zip", here.parent, here.name))


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{directory}/{name}.parquet")


_OWN_FOLDER: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, and only where that is unset (tests on
    one machine) a folder made here and removed at exit."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not _OWN_FOLDER:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN_FOLDER.append(tempfile.mkdtemp(prefix="litloom-"))
        atexit.register(shutil.rmtree, _OWN_FOLDER[0], True)
    return f"file://{_OWN_FOLDER[0]}"


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Over all cores, for small tables whose rows take long: the advisory size of a partition would
    put them into one task."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, *keys)


def parallel(rows: DataFrame) -> DataFrame:
    """A scan with too few partitions for the cores (one small file) over all of them; any other as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows._jdf.queryExecution().toRdd().getNumPartitions() * 2 <= cores else rows


def small(rows: DataFrame, most: int = 200_000) -> DataFrame:
    """Narrow rows to be broadcast if there are at most ``most`` of them, counted; else as they are, to be
    joined by a shuffle."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


class Scratch:
    """Written tables that cut the lineage of iterative plans.

    ``keep`` writes a frame to the shared folder and reads it back, so that a lost executor costs no
    recomputation of earlier rounds.  ``drop`` removes a table that no later plan reads, ``clear`` all but
    those that later plans read.  Tables still there are removed when the Python process ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}
        self._there: set[str] = set()
        atexit.register(self._remove, self.root)

    def keep(self, frame: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        frame.write.option("compression", "zstd").parquet(path)
        # the schema is given, so reading starts no job and keeps the column types
        kept = self.spark.read.schema(frame.schema).parquet(path)
        self._paths[id(kept)] = path
        self._there.add(path)
        return kept

    def keep_counted(self, frame: DataFrame) -> tuple[DataFrame, int]:
        """``keep``, and the number of rows written, counted while writing."""
        seen = Observation()
        kept = self.keep(frame.observe(seen, F.count(F.lit(1)).alias("n")))
        return kept, seen.get["n"]

    def drop(self, kept: DataFrame) -> None:
        path = self._paths.pop(id(kept), None)
        if path:
            self._there.discard(path)
            self._remove(path)

    def clear(self, *but: DataFrame) -> None:
        """Removes all tables except ``but``, and collects the driver's garbage: the shuffles, broadcasts and
        plans of frames that are no longer held stay with Spark until then, and the driver's heap grows
        with them."""
        held = {self._paths[id(x)] for x in but if id(x) in self._paths}
        for path in self._there - held:
            self._remove(path)
        self._paths = {k: p for k, p in self._paths.items() if p in held}
        self._there &= held
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended; the folder's owner clears it
            pass
