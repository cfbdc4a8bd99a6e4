"""Lineage cuts and versioned stores on whatever file system Spark uses."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
PACKED = "zstd"  # cuts are read once or twice, and stand beside each other
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"  # the JVM never compiles a method of more than 8,000 bytes, so such steps go in smaller ones


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a local master gets a folder of its own and a cluster is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="triweave-")
    return _own[app]


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """What is written inside frees its shuffle files once it stands: nothing reads them again, and a job of many cuts
    holds those of one at a time."""
    settings = {SHUFFLE_CLEANUP: "true", METHOD_LIMIT: "8000"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame) -> DataFrame:
    """Write and read back: iterations keep short plans, and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    with freed(df.sparkSession):
        df.write.option("compression", PACKED).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A scan dealt to all cores by key, before costly columns are computed; to more parts where it has more splits.

    Splits say nothing about where the rows are: a file with one row group is cut into many, and all but one are empty.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(2 * cores, df.rdd.getNumPartitions()), *keys)


def files(spark: SparkSession, path: str):
    """The file system of a path, and the path as that system names it."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file that is not there yet; false if it is.

    Hadoop's local file system first looks and then creates, so two writers could both succeed; the system's own call cannot.
    """
    fs, place = files(spark, path)
    if fs.getUri().getScheme() == "file":
        local = place.toUri().getPath()
        os.makedirs(os.path.dirname(local), exist_ok=True)
        try:
            with open(local, "x", encoding="utf-8") as out:
                out.write(text)
        except FileExistsError:
            return False
        return True
    try:
        out = fs.create(place, False)
    except Exception as e:
        if "FileAlreadyExists" in str(e) or "already exists" in str(e):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def read_text(spark: SparkSession, path: str) -> str:
    fs, place = files(spark, path)
    stream = fs.open(place)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names(spark: SparkSession, path: str) -> list[str]:
    fs, place = files(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(place)) if fs.exists(place) else []


class Cuts:
    """Cuts of an iteration, deleted once a later step has been written and nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._made: list[tuple[DataFrame, str]] = []

    def cut(self, df: DataFrame) -> DataFrame:
        return self.cut_all([df])

    def cut_all(self, parts: Iterable[DataFrame]) -> DataFrame:
        """One table of frames of one schema, written one after the other: the disks hold the shuffle files of one at a time."""
        path = f"{shared_dir(self.spark)}/cut-{uuid.uuid4().hex}"
        with freed(self.spark):
            for df in parts:
                df.write.option("compression", PACKED).mode("append").parquet(path)
        self._made.append((self.spark.read.schema(df.schema).parquet(path), path))
        return self._made[-1][0]

    def cut_by(self, frames: DataFrame | Iterable[DataFrame], part: str, parts: int) -> list[DataFrame]:
        """A frame for each number below ``parts`` in the column ``part``, written in one job (or one for each of several frames), and deleted one by one."""
        path = f"{shared_dir(self.spark)}/cut-{uuid.uuid4().hex}"
        with freed(self.spark):
            for df in [frames] if isinstance(frames, DataFrame) else frames:
                df.write.option("compression", PACKED).partitionBy(part).mode("append").parquet(path)
        out = []
        for n in range(parts):
            fs, place = files(self.spark, f"{path}/{part}={n}")
            fs.mkdirs(place)  # no record may be in it
            out.append(self.spark.read.schema(df.drop(part).schema).parquet(f"{path}/{part}={n}"))
            self._made.append((out[-1], f"{path}/{part}={n}"))
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            for made, path in self._made:
                if made is df:
                    fs, place = files(self.spark, path)
                    fs.delete(place, True)
                    whole = path.rsplit("/", 1)[0]
                    if "/cut-" in whole and not any(p != path and p.startswith(f"{whole}/") for _, p in self._made):
                        fs.delete(place.getParent(), True)  # the last part of a cut
            self._made = [(made, path) for made, path in self._made if made is not df]

    def drop_but(self, *frames: DataFrame) -> None:
        """Delete all but these."""
        self.drop(*[made for made, _ in self._made if not any(made is f for f in frames)])
