"""Written tables that cut lineage, in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_DIR = "spark.checkpoint.dir"
#: While a table is written: shuffle files go when the write ends, not when the driver next collects garbage;
#: and what a task reads and hands to Python at once is bounded, in the JVM and in the worker.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.parquet.columnarReaderBatchSize": "1024"}


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; where none is set, a local one, and only for a local master."""
    found = spark.sparkContext.getConf().get(_DIR) or spark.conf.get(_DIR, None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{_DIR} must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lagwise-")
        spark.conf.set(_DIR, found)
    return found.rstrip("/")


class Scratch:
    """A folder of Parquet tables under the shared folder.

    Tables are plain files, so a lost executor costs a retry of one task and never a
    recomputation of what came before. Frames read them when an action runs, which may be long after
    the operator has returned, so they go on drop(), on sweep(), or with the session's context, at
    the end of the process at the latest; a driver that is killed leaves them in a folder that has
    the application's id.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        sc = spark.sparkContext
        self.root = f"{shared_dir(spark)}/lagwise-{sc.applicationId}/{label}-{uuid.uuid4().hex}"
        self._paths: list[str] = []
        weakref.finalize(sc, _delete, weakref.ref(sc), self.root)

    def save(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        path = self.path(name)
        conf = self.spark.conf
        before = {k: conf.get(k, None) for k in _WRITING}
        for k, v in _WRITING.items():
            conf.set(k, v)
        try:
            df.write.option("compression", compression).parquet(path)
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(path)

    def path(self, name: str) -> str:
        self._paths.append(f"{self.root}/{len(self._paths)}-{name}")
        return self._paths[-1]

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for df in frames:
            for f in df.inputFiles()[:1]:
                _delete(lambda: self.spark.sparkContext, f.rsplit("/", 1)[0])

    def sweep(self, last: DataFrame) -> None:
        """Deletes all tables of this folder but those that the frame reads."""
        read = {f.rsplit("/", 2)[-2] for f in last.inputFiles()}
        for path in self._paths:
            if path.rsplit("/", 1)[1] not in read:
                _delete(lambda: self.spark.sparkContext, path)


def _delete(context: Callable[[], SparkContext | None], path: str) -> None:
    sc = context() or SparkContext._active_spark_context
    if sc is None or sc._jsc is None or sc._jsc.sc().isStopped():
        return
    try:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the gateway may be gone while the interpreter ends
        if not sc._jsc.sc().isStopped():
            raise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
