"""Session helpers: shared folder for intermediate tables, table reading."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F



def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach.

    It is the one named by ``spark.checkpoint.dir`` (or already set on the
    context). Only where neither is set, as in local tests, a temporary folder
    of this machine is made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    set_before = spark.sparkContext.getCheckpointDir()
    if set_before:
        return set_before
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="fieldtrace-")
    atexit.register(shutil.rmtree, own, True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once per application.

    Needed where the workers' path doesn't hold it already.
    """
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    _SHIPPED.add(application)
    folder = tempfile.mkdtemp(prefix="fieldtrace-zip-")
    atexit.register(shutil.rmtree, folder, True)
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(folder, "fieldtrace.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for at, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    whole = os.path.join(at, name)
                    z.write(whole, os.path.join("fieldtrace", os.path.relpath(whole, here)))
    spark.sparkContext.addPyFile(archive)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session may already be gone
        pass


_SCOPES: list[list[str]] = []


@contextlib.contextmanager
def released(spark: SparkSession):
    """Removes on leaving all intermediate tables made within: for sessions of many queries.

    Results that are still read must be written or collected inside.
    """
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
        for path in made:
            _drop(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    A written Parquet table survives the loss of executors, is compressed and
    lets later readers prune columns. The table is removed when the driver ends,
    or at the end of the ``released`` block it was made in.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/fieldtrace/{uuid.uuid4().hex}"
    df.write.parquet(path)
    for made in _SCOPES:
        made.append(path)
    if path.startswith("file:"):
        atexit.register(shutil.rmtree, path.removeprefix("file://").removeprefix("file:"), True)
    else:
        atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(scan: DataFrame) -> DataFrame:
    """A plain table scan with at least as many partitions as there are cores.

    Small files would leave cores idle under heavy row work; a scan that has
    enough partitions, as every large one has, is returned as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def beside(*frames: DataFrame) -> DataFrame:
    """One-row frames with different columns as one row."""
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f, allowMissingColumns=True)
    return whole.agg(*[F.max(c).alias(c) for c in whole.columns])
