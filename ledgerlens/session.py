"""Session defaults and the shared folder for tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from itertools import count

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "ledgerlens", **conf: str) -> SparkSession:
    """A session with the settings the engine expects; a cluster's own settings win over these only if given in ``conf``."""
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def at_once(*jobs: Callable[[], DataFrame]) -> list[DataFrame]:
    """Results of independent jobs, submitted side by side so that small stages of one fill the cores another leaves idle."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(j) for j in jobs]]


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a local folder where it is unset and all work is local too (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.getCheckpointDir() and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerlens-"))
    return spark.sparkContext.getCheckpointDir()


class Staging:
    """Writes a level of an iteration to the shared folder and reads it back: lineage is cut and survives lost executors."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.written: list[DataFrame] = []
        self.spark, self.at, self.n = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}", count(1)

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.at}/{next(self.n)}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._staged_at = path
        self.written = [*self.written, back]
        return back

    def keep(self, result: DataFrame) -> DataFrame:
        """The result as a table, all tables written before deleted."""
        before, out = self.written, self.write(result)
        self.written = [out]
        self.drop(*before)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later plan reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._staged_at)
            path.getFileSystem(conf).delete(path, True)
