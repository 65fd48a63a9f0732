"""Where intermediate tables go, how lineage is cut, and how they are cleared away."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that `written` made: the last list belongs to the innermost open `Scratch`, the first to none.
_made: list[list[str]] = [[]]


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in spark.checkpoint.dir.

    Where the setting is unset, a folder of this machine serves a local master, as in tests; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        if not hasattr(shared_dir, "own"):
            shared_dir.own = tempfile.mkdtemp(prefix="shared-")
        folder = f"file://{shared_dir.own}"
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again: lineage ends here, and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _made[-1].append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's file system layer."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """What `written` makes inside a `with` block goes at its end, but for the tables given to `keep`.

    A block may only return kept tables, or what is derived from them: Spark reads the others when a result is asked for.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.kept: set[str] = set()

    def __enter__(self) -> Scratch:
        _made.append([])
        return self

    def keep(self, table: DataFrame) -> DataFrame:
        self.kept.add(table._written_at)
        return table

    def drop(self, table: DataFrame) -> None:
        """Deletes a table before the end, as nothing reads it any more."""
        if table._written_at in _made[-1]:
            _made[-1].remove(table._written_at)
            removed(self.spark, table._written_at)

    def __exit__(self, kind: object, *_: object) -> None:
        for path in _made.pop():
            if path in self.kept:
                _made[-1].append(path)
            elif kind is None:
                removed(self.spark, path)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that `written` made and that stayed for results: call it when no result is needed any more."""
    for made in _made:
        while made:
            removed(spark, made.pop())
