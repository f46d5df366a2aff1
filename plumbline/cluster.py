"""What the operators need of the cluster: the shared folder, and how finely to deal work."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a mapped function gets at a time.
AT_ONCE = 1024
PART_BYTES = 128 << 20
HELD = 1_000_000


def partitions(spark: SparkSession) -> int:
    """Parts into which keys and documents are dealt: the session's shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts(docs: DataFrame, text: str) -> int:
    """Parts into which whole documents are dealt: the shuffle partitions, or more if a part would hold over ``PART_BYTES`` of text."""
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`"))).alias("n")).first()["n"] or 0
    return max(partitions(docs.sparkSession), -(-size // PART_BYTES))


def if_few(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast where its rows (some numbers each) are at most ``HELD``, else as it is; rows are counted by a query unless ``cut`` has."""
    n = getattr(table, "_plumbline_rows", None)
    return F.broadcast(table) if (table.limit(HELD + 1).count() if n is None else n) <= HELD else table


def is_empty(table: DataFrame) -> bool:
    """Whether a written table has no rows."""
    n = getattr(table, "_plumbline_rows", None)
    return table.isEmpty() if n is None else n == 0


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; a temporary one only in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


class Scratch:
    """Tables written in the shared folder to cut lineage.

    ``cut`` writes and rereads a DataFrame, so that a lost executor costs the
    tasks it held and no earlier job.  It counts the rows as it writes them, for
    ``if_few`` and ``is_empty``.  Before it writes, if the last table took over a
    second, Spark deletes the shuffle files of earlier jobs, which nothing refers to by
    then.  ``drop`` deletes a table
    no longer read; what is left goes when the application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"
        self.n, self.took = 0, 0.0
        path, files = self._file(self.root)
        files.mkdirs(path)
        files.deleteOnExit(path)

    def cut(self, df: DataFrame, row_group: int | None = None) -> DataFrame:
        if self.took > 1:
            self.release()
        self.n += 1
        path, began, seen = f"{self.root}/{self.n}", time.monotonic(), Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.options(compression="zstd", **({"parquet.block.size": row_group} if row_group else {})).parquet(path)
        self.took = max(self.took if self.took <= 1 else 0.0, time.monotonic() - began)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._plumbline_path, out._plumbline_rows = path, seen.get["n"]
        return out

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def drop(self, df: DataFrame) -> None:
        for name in getattr(df, "_plumbline_paths", None) or [df._plumbline_path]:
            path, files = self._file(name)
            files.delete(path, True)

    def cut_all(self, dfs: list[DataFrame]) -> DataFrame:
        """The union of tables written one after another, so that their shuffles are not held at once."""
        return self.together([self.cut(df) for df in dfs])

    def together(self, tables: list[DataFrame]) -> DataFrame:
        """The union of written tables."""
        out = self.spark.read.schema(tables[0].schema).parquet(*[t._plumbline_path for t in tables])
        out._plumbline_paths, out._plumbline_rows = [t._plumbline_path for t in tables], sum(t._plumbline_rows for t in tables)
        return out

    def only(self, df: DataFrame) -> None:
        """Delete all tables but this one; nothing that is still to be read may rest on the others."""
        last = df._plumbline_path.rpartition("/")[2]
        for k in range(1, self.n + 1):
            if str(k) != last:
                path, files = self._file(f"{self.root}/{k}")
                files.delete(path, True)

    def release(self, collected: bool = False) -> None:
        """Let Spark delete the shuffle files of finished jobs; the session refers to the last one until it runs another.

        A DataFrame whose rows were ``collected`` holds its shuffles itself, and py4j lets
        go of those that Python has dropped once a second.
        """
        self.spark.range(1).count()
        gc.collect()
        if collected:
            time.sleep(1.2)
        self.spark._jvm.System.gc()


def map_texts(df: DataFrame, text: str, make, fields: list[T.StructField], keep: list[str] | None = None) -> DataFrame:
    """Add columns computed from a text column, batch by batch, in Python.

    ``make()`` runs once in each task and returns a function from the Arrow text
    column (and the batch) to one Arrow array a field.  It gets ``AT_ONCE`` rows at
    a time, so that what it makes of them stays small.  ``keep`` are the input
    columns that stay, all by default.
    """
    names = df.columns if keep is None else keep
    wanted = list(dict.fromkeys([*names, text]))
    source = df.select(*[F.col(f"`{c}`") for c in wanted])
    schema = T.StructType([source.schema[c] for c in names] + fields)
    at, kept = wanted.index(text), [wanted.index(c) for c in names]

    def run(batches):
        work = make()
        for batch in batches:
            for begin in range(0, batch.num_rows, AT_ONCE):
                rows = batch.slice(begin, AT_ONCE)
                made = work(rows.column(at), rows)
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in kept), *made], names=[f.name for f in schema])

    return source.mapInArrow(run, schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that the table does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        made = f"__{name}"
        while made.lower() in taken:
            made += "_"
        out.append(made)
    return out


def others(names: list[str], *made: str) -> list:
    """The named columns without those that a made column of the same name replaces."""
    gone = {m.lower() for m in made}
    return [F.col(f"`{c}`") for c in names if c.lower() not in gone]
