"""Session helpers shared by all operators: the shared folder and written intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can reach, as named by ``spark.checkpoint.dir``.

    Only where the setting is absent and the master is local, as in tests, a folder of this process is used; on a cluster
    it would be another folder on every machine, so the setting must be there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session is gone; the folder is the cluster's to clean
        pass


def _remove_all(down_to: int = 0) -> None:
    while len(_WRITTEN) > down_to:
        _remove(*_WRITTEN.pop())


atexit.register(_remove_all)


@contextlib.contextmanager
def scope():
    """Intermediate tables written inside are removed at its end; results must have been written or collected by then."""
    before = len(_WRITTEN)
    try:
        yield
    finally:
        _remove_all(before)


def materialize(df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor costs nothing.

    The table is removed at the end of the ``scope`` around the call, else when the driver's process ends.
    """
    spark = df.sparkSession
    path = own_folder(spark)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def own_folder(spark: SparkSession) -> str:
    """The path of a new folder in the shared one, removed like the tables of ``materialize``."""
    path = f"{shared_dir(spark)}/quill-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the input folder, with only the columns named."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def small(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; reads no more than it must to know."""
    return df.limit(max_rows + 1).count() <= max_rows


MOST_BYTES = 256 << 20
"""Texts in a broadcast table have at most so many bytes in all."""


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast of ``df`` if its rows and the bytes of its strings, which are measured, are within the bounds; a shuffled
    join otherwise."""
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)).cast("long") for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    if not texts:
        return F.broadcast(df) if small(df, max_rows) else df
    size = F.lit(0).cast("long")
    for t in texts:
        size = size + t
    m = df.limit(max_rows + 1).agg(F.count("*").alias("n"), F.sum(size).alias("size")).first()
    return F.broadcast(df) if m.n <= max_rows and (m.size or 0) <= MOST_BYTES else df
