"""Written tables on the shared folder, shipping code to executors, and joins with a small table whose size is checked."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch, unless the session says otherwise: what a task holds of its input on either side.
BATCH_BYTES = 4 << 20
#: Rows of a narrow table up to which it is broadcast, and copies of it when it is larger and the keys of the other side may be hot.
BROADCAST_ROWS, SALT = 20_000, 64


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which every executor sees; set only where it is unset (tests)."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file:///tmp/checkpoints/locusmill"
        sc.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Written tables that cut lineage.  They survive the loss of executors, as they lie in the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as Parquet and read it back."""
        schema = df.schema
        df.write.option("compression", "zstd").parquet(self.path(name))
        self.names.add(name)
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Remove these tables, or all."""
        for name in names or ("",):
            self.names.discard(name)
            where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors, so that Python workers can import it wherever they run, and bound Arrow batches."""
    sc = spark.sparkContext
    if "spark.sql.execution.arrow.maxBytesPerBatch" not in spark.conf.getAll:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if getattr(sc, "_locusmill_shipped", False):
        return
    top = Path(__file__).resolve().parent
    folder = os.path.realpath(tempfile.mkdtemp(prefix="locusmill-"))  # the driver serves the file as long as it lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, f"locusmill-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    sc.addPyFile(target)
    sc._locusmill_shipped = True


def beside(rows: DataFrame, small: DataFrame, key: str, how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """rows joined by `key` with `small`, a written table with a row per key.  Up to `limit` rows it is broadcast; beyond, it is
    copied SALT times and rows are dealt out by key and salt, so that no key's rows meet in one task.  Both give the same rows."""
    if small.limit(limit + 1).count() <= limit:
        return rows.join(F.broadcast(small), key, how)
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("__salt", F.floor(F.rand(7) * SALT).cast("int")).join(copies, [key, "__salt"], how).drop("__salt")
