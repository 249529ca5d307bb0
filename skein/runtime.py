"""Sessions, table access and staged tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings the engine is developed under."""
    builder = (
        SparkSession.builder.master(master)
        .appName("skein")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once for an application.

    Their functions are pickled by name, and a worker need not have the
    driver's search path.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    home = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(home):  # itself run from an archive that was shipped
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="skein-ship-"), "skein.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(home):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(home)))
    spark.sparkContext.addPyFile(archive)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where the setting is missing, a local session gets a temporary folder of
    this machine; a cluster has to name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            root = tempfile.mkdtemp(prefix="skein-")
            spark.sparkContext.setCheckpointDir(root)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Fs:
    """The Hadoop file system of a path, from the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def mkdirs(self, path: str) -> None:
        self._fs.mkdirs(self._path(path))

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def names(self, path: str) -> list[str]:
        if not self.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path)))

    def ages(self, path: str) -> list[tuple[str, float]]:
        """(name, seconds since the epoch of its last change) of what a folder holds."""
        if not self.exists(path):
            return []
        return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in self._fs.listStatus(self._path(path))]

    def read_text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish_text(self, path: str, text: str) -> bool:
        """Write beside ``path`` and rename onto it, refusing to replace.

        The rename is the commit: readers see the whole text or none, and of
        two writers of the same path one gets False.
        """
        if self.exists(path):
            return False
        parent, _, name = path.rpartition("/")
        draft = f"{parent}/_draft-{name}-{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(draft), False)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        if self._fs.rename(self._path(draft), self._path(path)):
            return True
        self._fs.delete(self._path(draft), False)
        return False


_LEFT: list[tuple[SparkSession, str]] = []


@atexit.register
def _sweep() -> None:
    for spark, path in _LEFT:
        try:
            Fs(spark, path).delete(path)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            return


class Stage:
    """Tables written once into the shared folder, which cuts lineage.

    Lost executors cost nothing that was staged. ``put`` returns the table as
    read back; ``drop`` removes one that later steps no longer read. What a
    result still needs stays until the process ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/skein-{label}-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}
        self._n = 0
        _LEFT.append((spark, self.root))

    def put(self, df: DataFrame, name: str = "t", partition_by: str | None = None) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:04d}-{name}"
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(back)] = path
        back._skein_path = path
        return back

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_skein_path", None)
        if path:
            Fs(self.spark, path).delete(path)


def digest(*cols) -> "F.Column":
    """16 bytes that stand for a string key in shuffles.

    Equal keys have equal digests; two different keys share one with a chance
    of 2^-128 for each pair.
    """
    return F.unhex(F.md5(*cols))


def spread(df: DataFrame, *by: str) -> DataFrame:
    """The same rows over at least as many partitions as there are cores.

    For maps that are heavy on each row: a table in fewer files than cores is
    hashed apart by ``by``; any larger one stays as it is read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(2 * cores, F.xxhash64(*by))
