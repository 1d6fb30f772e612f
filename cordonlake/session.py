"""Session helpers: reading tables, cutting lineage through the shared folder, bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unique_rows(df: DataFrame, key: str, order: list[str] | None = None, broadcast_rows: int = 1_000_000) -> DataFrame:
    """``df`` with one row per ``key``: the first by ``order`` (nulls first), then by place; rows with a null key are left out.

    Read from files, the rows to leave out are named by their file and row number, so only keys and ``order`` are shuffled
    and not whole rows; they are broadcast while there are at most ``broadcast_rows`` of them (counted here, by a job).
    """
    order = order or []
    kept = df.where(F.col(key).isNotNull())
    try:
        placed = kept.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:  # not from files
        if not order:
            return kept.dropDuplicates([key])
        rest = [c for c in df.columns if c not in (key, *order)]
        first = kept.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_first"))
        return first.select(key, "_first.*").select(df.columns)
    at = F.struct(*order, "_file", "_row")
    repeated = placed.groupBy(key).agg(F.count("*").alias("_n"), F.min(at).alias("_first")).where("_n > 1").drop("_n")
    surplus = placed.select(key, at.alias("_at")).join(repeated, key).where("_at <> _first").select("_at._file", "_at._row")
    if surplus.limit(broadcast_rows + 1).count() <= broadcast_rows:
        surplus = F.broadcast(surplus)
    return placed.join(surplus, ["_file", "_row"], "left_anti").drop("_file", "_row")


def stacked(*frames: DataFrame, allow_missing: bool = False) -> DataFrame:
    """The rows of all frames, columns by name.

    Spark 4.1 takes a union of frames that are partitioned on a key as partitioned on it, and leaves out the shuffle before a
    grouping; when adaptive execution has merged partitions of one of them, a key's rows stay apart and groups come out twice.
    The setting is switched off for the session.
    """
    frames[0].sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=allow_missing)
    return out


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor reaches, from ``spark.checkpoint.dir``.

    Only a local master may do without the setting; it then gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="cordonlake-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table into the shared folder and reads it back.

    Cuts the lineage, so that later stages survive lost executors without recomputing what lies before, and
    freezes values such as generated ids.
    """
    path = f"{shared_dir(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_order(df: DataFrame, name: str, key: str) -> list[str]:
    """Writes ``df`` in order of ``key`` into the shared folder: the addresses of its files, in that order."""
    # written first: the bounds of a sort are drawn by a pass of its own, which would compute ``df`` twice
    return sorted(materialize(materialize(df, name).orderBy(key), f"{name}-ordered").inputFiles())


def read_batches(files: list[str], columns: list[str], rows: int) -> Iterator:
    """Arrow batches of at most ``rows`` rows of the files of :func:`in_order`, one after the other; for use within tasks."""
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSystem

    for address in files:
        system, path = FileSystem.from_uri(address)
        with system.open_input_file(path) as source:
            yield from pq.ParquetFile(source).iter_batches(rows, columns=columns, use_threads=False)


def names_at(files: list[str], column: str, places):
    """The values of ``column`` in the rows ``places`` (distinct, in order), counted through all files, as one Arrow array."""
    import numpy as np
    import pyarrow as pa

    found, base = [pa.array([], pa.string())], 0
    for batch in read_batches(files, [column], 50_000):
        a, b = np.searchsorted(places, [base, base + batch.num_rows])
        found.append(batch.column(0).take(pa.array(places[a:b] - base)).cast(pa.string()))
        base += batch.num_rows
    return pa.concat_arrays(found)


def giving_back(run):
    """``run``, a function from batches to batches, after whose end the worker returns what it freed.

    Spark keeps workers for later tasks, those that wait beside those at work, and what one has freed stays in its allocators.
    """

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return whole


def give_back() -> None:
    """Returns freed memory of this process to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # other C libraries than glibc have none
        trim(0)


def drop_materialized(spark: SparkSession) -> None:
    """Deletes every table that ``materialize`` wrote; call it once their readers are done."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tables")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded_pandas(df: DataFrame, limit: int, what: str):
    """``df`` on the driver, refused beyond ``limit`` rows: for lookup tables whose size is part of the contract."""
    rows = df.limit(limit + 1).toPandas()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows")
    return rows
