"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a session on this machine alone gets a new local folder; on a cluster that is an error, as its
    executors would not see one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="factlens-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; the session removes it at its end."""
    path = f"{shared_dir(spark).rstrip('/')}/factlens-{name}-{uuid.uuid4().hex}"
    files, where = _place(spark, path)
    files.deleteOnExit(where)
    return path


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Remove what was written to a scratch path and isn't needed any more."""
    files, where = _place(spark, path)
    files.delete(where, True)


def there(spark: SparkSession, path: str) -> bool:
    files, where = _place(spark, path)
    return files.exists(where)


def move_scratch(spark: SparkSession, path: str, target: str) -> None:
    """Rename a folder to a place where nothing is yet."""
    files, where = _place(spark, path)
    if not files.rename(where, _place(spark, target)[1]):
        raise OSError(f"{path} can't be moved to {target}")


#: Whether shuffle files go at the end of what wrote them (Spark 4.1; earlier versions ignore it).
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Writes within leave no shuffle files: else these stay until the driver happens to collect its garbage, and a job of many steps holds those of all."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def written(df: DataFrame, path: str, **options: str) -> DataFrame:
    """Write ``df`` to ``path`` and read it back."""
    with shuffles_freed(df.sparkSession):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: what is used several times is computed once, and lost executors cost nothing."""
    return written(df, scratch_path(df.sparkSession, name), **options)


def tasks_for(rows: DataFrame, most: int) -> int:
    """Tasks that ``rows`` are dealt to so that each gets about ``most`` at most, and no core is idle.

    Dealt to a number that is named, rows are not put together again by their compressed size, which says little of what a task
    holds in memory. Counting is cheap for rows that are written.
    """
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // most))


def modified(spark: SparkSession, folder: str) -> int:
    """When the latest file of a folder of tables was written, in milliseconds."""
    files, where = _place(spark, folder)
    found, latest = files.listFiles(where, True), 0
    while found.hasNext():
        latest = max(latest, found.next().getModificationTime())
    return latest


class Folders:
    """A table in folders by an integer column, of which a write replaces some and leaves the others' files alone.

    Each write is a version that holds the folders it wrote; a list of the version in which each folder lies is written
    last, and readers go by the latest complete list. So a write takes effect at once or not at all, readers keep what they
    began with, and of two writers that start from the same version one fails.
    """

    VERSION = "__version"

    def __init__(self, spark: SparkSession, path: str, column: str):
        self.spark, self.path, self.column = spark, path.rstrip("/"), column

    def version(self) -> int:
        """The latest complete version, 0 before the first."""
        files, where = _place(self.spark, f"{self.path}/lists")
        if not files.exists(where):
            return 0
        done = [int(x.getPath().getName()) for x in files.listStatus(where) if files.exists(_place(self.spark, f"{x.getPath()}/_SUCCESS")[1])]
        return max(done, default=0)

    def places(self) -> dict[int, int]:
        """The version in which each folder lies."""
        latest = self.version()
        return {r.folder: r.version for r in self.spark.read.parquet(f"{self.path}/lists/{latest}").collect()} if latest else {}

    def read(self, only: set[int] | None = None) -> DataFrame | None:
        """The rows of all folders, or of some, with the column and __version; None if there are none."""
        found = [f"{self.path}/{self.VERSION}={v}/{self.column}={k}" for k, v in sorted(self.places().items()) if only is None or k in only]
        return self.spark.read.option("basePath", self.path).parquet(*found) if found else None

    def write(self, rows: DataFrame, only: set[int] | None = None, check: Callable[[DataFrame], None] | None = None) -> dict[int, int]:
        """Replace the folders named, or all, by ``rows``, whose column names each row's folder; one that gets no rows is gone.

        What ``check`` raises of the rows written leaves the table as it was. No rows into an empty table are no version.
        """
        before, version = self.places(), self.version() + 1
        if only is not None:
            rows = rows.filter(F.col(self.column).isin(sorted(only)))
        target = f"{self.path}/{self.VERSION}={version}"
        with shuffles_freed(self.spark):
            rows.write.partitionBy(self.column).parquet(target)
        files, where = _place(self.spark, target)
        names = [x.getPath().getName() for x in files.listStatus(where)]
        new = {int(x.split("=")[1]): version for x in names if x.startswith(f"{self.column}=")}
        if not new and not before:
            drop_scratch(self.spark, target)
            return before
        if check:
            try:
                check(self.spark.read.schema(rows.schema).parquet(target))
            except Exception:
                drop_scratch(self.spark, target)
                raise
        after = ({} if only is None else {k: v for k, v in before.items() if k not in only}) | new
        listed = self.spark.createDataFrame(sorted(after.items()), "folder int, version int")
        listed.coalesce(1).write.parquet(f"{self.path}/lists/{version}")
        return after
