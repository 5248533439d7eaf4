"""Session helpers: the shared scratch folder, written tables, slices of Arrow batches."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import threading
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Bytes of an Arrow batch: long texts do not meet in one, and the JVM's buffers stay small.
ARROW_KEY, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4_000_000


def build(app: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators expect: UTC, AQE, no console noise."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for k, v in base.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is read from ``spark.checkpoint.dir``; only where that is unset (tests, a local shell) a
    folder of this process is made and remembered in the session. On a cluster it has to be set.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not root:
        if re.match(r"local(\[|$)", spark.sparkContext.master) is None:
            raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set(CHECKPOINT_KEY, root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class Scratch:
    """Tables written below the shared folder, so that they outlive any executor; drop() removes them."""

    #: Those that this thread has opened since swept() began.
    opened = threading.local()

    def __init__(self, spark: SparkSession):
        self.spark = spark
        getattr(self.opened, "since", []).append(self)
        self.root = f"{shared_root(spark)}/tessera/{uuid.uuid4().hex}"
        self.made: list[str] = []
        self.count = 0

    def path(self, name: str) -> str:
        p = f"{self.root}/{self.count:04d}-{name}"
        self.count += 1
        self.made.append(p)
        return p

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back: its lineage ends there."""
        p = self.path(name)
        df.write.parquet(p)
        return self.spark.read.schema(df.schema).parquet(p)

    def drop(self, keep: int = 0) -> None:
        """Delete all tables but the last ``keep``."""
        while len(self.made) > keep:
            self._delete(self.made.pop(0))

    def _delete(self, p: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def gathered(batches, column: int, most: int = 8_000_000):
    """Arrow batches put together, or cut, so that the texts of a column have about ``most`` bytes together."""
    import pyarrow as pa

    held, size = [], 0
    for b in slices(batches, column, most):
        if held and size + b.column(column).nbytes > most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        if b.num_rows:
            held.append(b)
            size += b.column(column).nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


@contextmanager
def swept():
    """Drop at the end all scratch tables that this thread makes inside, so what they led to has to be written elsewhere by then."""
    before = getattr(Scratch.opened, "since", None)
    Scratch.opened.since = []
    try:
        yield
    finally:
        made = Scratch.opened.since
        if before is None:
            del Scratch.opened.since
        else:
            Scratch.opened.since = before
        for s in made:
            s.drop()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: by PYTHONPATH where the driver has it, else as a zip file.

    Also bounds Arrow batches by bytes (ARROW_BYTES) where the session says nothing about that: Spark
    reads this setting when a plan runs, so it can't be given to one operator alone.
    """
    if spark.conf.get(ARROW_KEY, None) is None:
        spark.conf.set(ARROW_KEY, str(ARROW_BYTES))
    root = Path(__file__).resolve().parent
    sc = spark.sparkContext
    if str(root.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_tessera_shipped", False):
        return
    made = shutil.make_archive(f"{tempfile.mkdtemp(prefix='tessera-')}/tessera", "zip", root.parent, root.name)
    sc.addPyFile(made)
    sc._tessera_shipped = True


def released() -> None:
    """Give back what an operator before this one left free in a worker, which Spark uses again and again."""
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()


def slices(batches, column: int, most: int = 8_000_000):
    """Arrow batches cut so that the texts of a column have at most ``most`` bytes together; a longer text is by itself.

    Spark bounds its batches by rows and bytes (spark.sql.execution.arrow.maxBytesPerBatch); these
    bound what an operator makes of a batch.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    for b in batches:
        if b.column(column).nbytes <= most or b.num_rows < 2:
            yield b
            continue
        size = pc.fill_null(pc.binary_length(b.column(column).cast(pa.large_binary())), 0).to_pylist()
        begin = held = 0
        for k, n in enumerate(size):
            if held + n > most and k > begin:
                yield b.slice(begin, k - begin)
                begin, held = k, 0
            held += n
        yield b.slice(begin)


def shuffled(df: DataFrame) -> DataFrame:
    """df, to be joined by shuffle and sort. Files of written tables are compressed, so that the planner takes tables that grow with the input for small and sends them through the driver."""
    return df.hint("merge")


def dealt(df: DataFrame, keys: list[str], rows: int = 500_000) -> DataFrame:
    """df in as many partitions by its keys as hold some ``rows`` each, at least one per shuffle partition; they are not put together again, so that tasks stay of one size."""
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(most, -(-df.count() // rows)), *keys)


def join_checked(spark: SparkSession, left: DataFrame, right: DataFrame, on: list[str], how: str, most: int = 1_000_000) -> DataFrame:
    """Join with a written table; it is broadcast only if it has at most ``most`` rows, else shuffled."""
    from pyspark.sql import functions as F

    small = right.limit(most + 1).count() <= most
    return left.join(F.broadcast(right) if small else right, on, how)
