"""Session factory and the shared folder that intermediate tables go to."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast


def get_session(app: str = "nimboscale", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, ANSI mode and adaptive execution; ``conf`` keys use ``_`` for ``.``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors where their Python would not find it on its path."""
    context = spark.sparkContext
    root = Path(__file__).resolve().parent.parent
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if getattr(context, "_nimboscale_shipped", False) or str(root) in (os.path.realpath(p) for p in known if p):
        return
    folder = tempfile.mkdtemp(prefix="nimboscale-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/nimboscale.zip", "w") as out:
        for file in [*root.glob("nimboscale/**/*.py"), *root.glob("corpus_pipeline.py")]:
            out.write(file, file.relative_to(root))
    context.addPyFile(f"{folder}/nimboscale.zip")
    context._nimboscale_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor can reach.

    It is ``spark.checkpoint.dir`` of the session. Where that is unset, a local
    session gets a folder of its own, removed at exit; a cluster session is
    refused, because executors would write to disks that nobody else can read.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    own = getattr(context, "_nimboscale_dir", None)
    if own is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="nimboscale-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        context._nimboscale_dir = own
        context.setCheckpointDir(own)
    return own


def new_shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/nimboscale/{tag}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries inside remove their shuffle files as they end, rather than when the driver next collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stored(df: DataFrame, tag: str, release: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage like a checkpoint, survives lost executors, and leaves
    columnar files that later reads can prune. With ``release`` the shuffle files of the
    write are removed at once: for plans that no other query shares.
    """
    spark = df.sparkSession
    path = new_shared_path(spark, tag)
    with released_shuffles(spark) if release else contextlib.nullcontext():
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._nimboscale_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the files of what ``stored`` returned, once tables written later hold all that is needed of them."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._nimboscale_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def gathered(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """``df``, marked for broadcast if it has at most ``rows`` rows; a larger one is left to a shuffled join. For narrow, stored tables."""
    return broadcast(df) if df.limit(rows + 1).count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_path(uri: str) -> str | None:
    """Path of a ``file:`` URI or plain path; None for other stores."""
    if "://" not in uri and not uri.startswith("file:"):
        return uri
    if uri.startswith("file:"):
        return "/" + uri[len("file:"):].lstrip("/")
    return None


def ensure_parent(path: str) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
