"""Spark session helpers.

Nothing here changes how queries are planned; it only builds a local session
for tests and benchmarks and resolves the shared checkpoint folder.
"""

from __future__ import annotations

import os
import posixpath
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tagwright") -> SparkSession:
    """A local session configured like a small cluster: AQE on, UI off."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    On a cluster the folder is configured by the operator and is shared
    storage, and an unset one is an error.  Only a local session, whose driver
    and executors are one process, gets a folder of its own here.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if conf_dir:
        if current is None:
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    if current:
        return current
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="tagwright-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", local)
    sc.setCheckpointDir(local)
    return local


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a parquet table under the shared checkpoint folder and
    read it back.

    Used by iterative operators so that a lost executor only recomputes from
    the last written round, never from the start of the lineage.  A written
    table (rather than ``Dataset.checkpoint``) also gives the re-read plan
    fresh attributes, so the next round can join it with itself safely.
    """
    base = ensure_checkpoint_dir(df.sparkSession)
    path = posixpath.join(base, "tables", uuid.uuid4().hex)
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.parquet(path)
    # keep the frame itself so its id cannot be reused while registered
    _WRITTEN[id(out)] = (path, out)
    return out


_WRITTEN: dict[int, tuple[str, DataFrame]] = {}


def release(df: DataFrame | None) -> None:
    """Delete the table behind a frame returned by :func:`cut_lineage` once a
    later round has been written (the later round reads only its own files,
    so nothing depends on the old one any more)."""
    if df is None:
        return
    entry = _WRITTEN.get(id(df))
    if entry is None or entry[1] is not df:
        return
    path = _WRITTEN.pop(id(df))[0]
    jvm = df.sparkSession.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tagwright`` importable in the Python workers of this context.

    Pandas UDFs and ``mapInPandas``/``applyInPandas`` functions live in this
    package, and Python workers do not see the driver's ``sys.path``; the
    package is zipped once per SparkContext and added with ``addPyFile``,
    which Spark distributes to every executor.
    """
    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    pkg = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tagwright-pkg-")
    zpath = os.path.join(folder, "tagwright.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(pkg.rglob("*.py")):
            z.write(f, f.relative_to(pkg.parent).as_posix())
    sc.addPyFile(zpath)
    _SHIPPED.add(key)
