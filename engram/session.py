"""Session helpers: a local session for tests/bench, and the checkpoint folder.

Library operators never create a session; they take the caller's.  On a
cluster the checkpoint folder comes from ``spark.checkpoint.dir`` (a shared
file system path); only a local-mode session without one gets a scratch
folder, which is what tests and the bench use.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "engram", **extra) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(extra.pop("shuffle_partitions", 8)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
    )
    for k, v in extra.items():
        builder = builder.config(k.replace("__", "."), v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make sure reliable checkpoints have a home and return it.

    Order: an already-set checkpoint dir, then ``spark.checkpoint.dir`` from
    the session conf, then (local mode only) a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "set spark.checkpoint.dir to a shared folder; iterative operators "
            "cut lineage with reliable checkpoints"
        )
    scratch = tempfile.mkdtemp(prefix="engram-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(scratch)
    return scratch


_OPEN = threading.local()  # paths of the open ``passing`` blocks


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage through a Parquet table of its own below the checkpoint
    folder.  Unlike a checkpoint, what comes back has a known size (so small
    tables are broadcast without a shuffle) and no leftovers of the old plan."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    for block in getattr(_OPEN, "blocks", []):
        block.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables stored within the block are deleted at its end, but for those that the function it
    gives has stored: nothing that is used later may be left to read the others."""
    block, kept = [], set()
    _OPEN.blocks = [*getattr(_OPEN, "blocks", []), block]

    def keep(df: DataFrame) -> DataFrame:
        at = len(block)
        out = stored(df)
        kept.add(block[at])
        return out

    try:
        yield keep
    finally:
        _OPEN.blocks = _OPEN.blocks[:-1]
        for path in block:
            if path not in kept:
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``engram`` importable in Python workers (the ``--py-files``
    mechanism): zip the package once per driver process and add it to the
    context.  Operators that run Python (the store fold, the stateful rate
    limit stream, caller models) call this before building their plan."""
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = Path(__file__).resolve().parent
    fd, path = tempfile.mkstemp(prefix="engram-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in pkg.rglob("*.py"):
            z.write(f, Path("engram") / f.relative_to(pkg))
    sc.addPyFile(path)
    _SHIPPED.add(key)
