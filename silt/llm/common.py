"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from silt.ship import ship

#: A word is a run of anything but the six ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"


#: What Catalyst says of data that it knows nothing about is above this.
UNKNOWN_BYTES = 1 << 55


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the input: file sizes for a file scan; text bytes, counted, where it has none.

    It only picks how finely work is cut; no result depends on it.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < UNKNOWN_BYTES:
        return size
    texts = [F.octet_length(f"`{c}`") for c, kind in df.dtypes if kind in ("string", "binary")]
    size = df.agg(*[F.sum(t) for t in texts]).first() if texts else [0]
    return sum(x or 0 for x in size)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts, counted."""
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one is set only where that is unset and the master is local."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="silt-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared checkpoint folder and read back: its lineage ends there.

    Executors that are lost take nothing with them. The files go when the driver's JVM ends.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path not used before in the shared folder, deleted when the driver's JVM ends, or see step()."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where, fs = _hadoop(spark, path)
    fs.deleteOnExit(where)
    if _made is not None:
        _made.append(path)
    return path


_made: list[str] | None = None
_steps: list[tuple[weakref.ref, list[str]]] = []


def step(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For steps of a pipeline, whose results are written before they are let go: the tables that a step has cut go when
    another starts and nothing holds the step's result any more."""

    @functools.wraps(fn)
    def run(spark: SparkSession, *args) -> DataFrame:
        global _made
        for held in [x for x in _steps if x[0]() is None]:
            _steps.remove(held)
            for path in held[1]:
                where, fs = _hadoop(spark, path)
                fs.delete(where, True)
        _made = []
        try:
            out = fn(ship(spark), *args)
            _steps.append((weakref.ref(out), _made))
        finally:
            _made = None
        return out

    return run


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def without(df: DataFrame, names) -> DataFrame:
    """df less the columns that an operator is about to add (names are compared as Spark does, ignoring case)."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def add_arrow_columns(
    df: DataFrame, uses: list[str], fields: list[StructField], fn: Callable[..., list]
) -> DataFrame:
    """df with columns computed batch by batch in Python; fn takes the arrays of `uses`, returns one list per field.

    A column of df that has the name of a new one is replaced.
    """
    kept = [f for f in df.schema.fields if f.name.lower() not in {x.name.lower() for x in fields}]
    schema = StructType(kept + list(fields))
    kept_names = [f.name for f in kept]
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [(f.name, to_arrow_type(f.dataType)) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in slices(batch, uses):
                new = fn(*[at.column(at.schema.names.index(c)) for c in uses])
                cols = [at.column(at.schema.names.index(c)) for c in kept_names]
                cols += [x if isinstance(x, pa.Array) else pa.array(x, t) for x, (_, t) in zip(new, arrow)]
                yield pa.RecordBatch.from_arrays(cols, names=kept_names + [n for n, _ in arrow])

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, uses: list[str], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose used columns hold about `limit` bytes; a larger row stands alone."""
    n = batch.num_rows
    size = sum(batch.column(batch.schema.names.index(c)).nbytes for c in uses) if n else 0
    step = max(1, min(n, int(n * limit / max(1, size))))
    for i in range(0, n, step) if n else ():
        part = batch.slice(i, step)
        if step > 1 and sum(part.column(part.schema.names.index(c)).nbytes for c in uses) > 4 * limit:
            yield from (part.slice(j, 1) for j in range(part.num_rows))
        else:
            yield part


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null: empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
