"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of an Arrow batch.
BATCH_ROWS = 1000
#: Bytes of one slice of an Arrow batch; bounds what a Python operator holds beside its batch.
SLICE_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per context; they need not have it installed.

    Arrow batches of texts are limited to BATCH_ROWS rows where the session has Spark's default
    of ten thousand, as a batch of long texts would be held by the JVM and by Python at once.
    """
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if getattr(sc, "_evidentia_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp()  # the driver serves the file from here until the session ends
    atexit.register(shutil.rmtree, folder, True)
    path = f"{folder}/evidentia.zip"
    with zipfile.ZipFile(path, "w") as packed:
        for file in sorted(top.rglob("*.py")):
            packed.write(file, file.relative_to(top.parent))
    sc.addPyFile(path)
    sc._evidentia_shipped = True


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into row slices of about ``most`` bytes, one row at least."""
    rows = batch.num_rows
    step = max(1, rows * most // max(1, batch.nbytes))
    for at in range(0, rows, step):
        yield batch.slice(at, step)


def release() -> None:
    """Gives back to the system what a task held: a worker process stays for the next tasks, also those of other operators."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the C library of GNU has it
        ctypes.CDLL(None).malloc_trim(0)


def add_columns(
    df: DataFrame,
    inputs: Sequence[str],
    fields: Sequence[T.StructField],
    make: Callable[[], Callable[..., Sequence[pa.Array]]],
    drop: Sequence[str] = (),
) -> DataFrame:
    """``df`` with ``fields`` appended, computed batch by batch in Arrow.

    ``make`` runs once per task and returns a function from the input arrays to the
    arrays of ``fields``. A column of ``df`` that has the name of a new field is replaced; those
    in ``drop`` are not returned.
    """
    new = {f.name for f in fields} | set(drop)
    keep = [f for f in df.schema.fields if f.name not in new]
    schema = T.StructType([*keep, *fields])
    arrow = to_arrow_schema(schema)
    kept = [f.name for f in keep]
    inputs = list(inputs)

    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for part in slices(batch):
                got = fn(*(part.column(part.schema.get_field_index(c)) for c in inputs))
                cols = [part.column(part.schema.get_field_index(c)) for c in kept] + list(got)
                cols = [c if c.type == f.type else c.cast(f.type) for c, f in zip(cols, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from worked(batches)
        release()

    return df.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened where ``df`` has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, as in tests, the warehouse of a session that is one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return spark.conf.get("spark.sql.warehouse.dir")


def cut_lineage(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """``df`` written as a table in the shared folder and read again; it goes when the session ends.

    The table of ``instead_of``, an earlier result that nothing else reads any more, is deleted.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/evidentia/{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    files = lambda p: (where := jvm.org.apache.hadoop.fs.Path(p), where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()))
    where, system = files(path)
    system.deleteOnExit(where)
    if instead_of is not None and hasattr(instead_of, "_evidentia_path"):
        where, system = files(instead_of._evidentia_path)
        system.delete(where, True)
    out = spark.read.schema(df.schema).parquet(path)
    out._evidentia_path = path
    return out


#: Keys that are broadcast at most, as each has more than this share of the rows; and rows of a key that no task minds.
FREQUENT, FEW = 10_000, 1000


def join_counted(left: DataFrame, right: DataFrame, key: str, n: str) -> DataFrame:
    """``left`` joined with ``right`` on ``key``, without a task that gathers a frequent key.

    ``right`` has one row for each key of ``left``, and how many rows of ``left`` have it in ``n``,
    which is dropped. Both are read more than once and should be written tables. Keys with more
    than one in FREQUENT of all rows (so fewer keys than that) are broadcast, the others shuffled.
    """
    total, most = right.agg(F.sum(n), F.max(n)).first()
    bound = max(FEW, (total or 0) // FREQUENT)
    if (most or 0) <= bound:
        return left.join(right.drop(n), key)
    hot, rest = right.filter(F.col(n) > bound).drop(n), right.filter(F.col(n) <= bound).drop(n)
    seldom = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key)
    return left.join(F.broadcast(hot), key).unionByName(seldom)


def running(df: DataFrame, out: str, value: str, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before each row in ``order``, within each group of the columns ``by``, which hold no nulls.

    Rows are dealt by ranges and written; a range adds what the ranges before it hold, so a
    group of any size is many tasks' work. ``df`` is read twice, for the ranges first. Rows alike
    in ``by`` and ``order`` are one task's.
    """
    part, own, ahead = fresh(df, "part", "own", "ahead")
    dealt = cut_lineage(df.repartitionByRange(*by, *order).withColumn(part, F.spark_partition_id()))
    sums = dealt.groupBy(part, *by).agg(F.sum(value).alias(own))
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range and group
    offsets = sums.select(part, *by, F.coalesce(F.sum(own).over(before), F.lit(0)).alias(ahead))
    within = Window.partitionBy(part, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn(out, F.coalesce(F.sum(value).over(within), F.lit(0)))
    return summed.join(offsets, [part, *by]).withColumn(out, F.col(out) + F.col(ahead)).drop(part, ahead)
