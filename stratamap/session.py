"""Session helpers: a tuned builder, table access, lineage cuts on shared storage and size checks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "stratamap", cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings this library expects (UTC, AQE, Arrow). Clusters bring their own."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LEFT: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``, as all executors share it.

    Only a local session without that setting gets a temporary folder, which is removed at its end.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if named is None:
        if not _LEFT:
            _LEFT.append(tempfile.mkdtemp(prefix="stratamap-shared-"))
            atexit.register(shutil.rmtree, _LEFT[0], True)
        return _LEFT[0]
    return named


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name for an intermediate table in the shared folder; what stands there is removed when the driver ends."""
    from stratamap.sources.files import Folder

    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(Folder.remove, path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder. Losing an executor later costs nothing."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def input_rows(df: DataFrame) -> int:
    """Row count of a stored table; Spark answers it from the Parquet footers."""
    return df.count()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that workers can import it anywhere."""
    import os
    import zipfile

    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="stratamap-"), "stratamap_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("stratamap", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


#: Bytes of a table that is spread at most.
SPREAD_BYTES = 2 << 30


def spread(df: DataFrame) -> DataFrame:
    """Spread a small table over all cores where its files give fewer partitions than there are cores.

    For work that is heavy per row and otherwise map-only. A table of more than ``SPREAD_BYTES`` by Spark's estimate, or of
    enough files or row groups, is left as it is, so nothing large is ever shuffled by this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES:
        return df
    return df.repartition(cores)
