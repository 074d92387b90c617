"""What the training-data operators share.

Conventions, valid for every operator of the subpackage unless its docstring says otherwise:

* a null text is an empty text;
* a null ``doc_id`` is a value like any other (it is carried through);
* rows that repeat are rows of their own;
* only the named columns are read, so further columns, whatever their names, have no effect;
* an empty table gives an empty result with the same schema.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def doc_text(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """``doc_id`` and the text, null replaced by empty."""
    return [
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    ]


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column without a round trip through ``str``."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function, after which a worker hands free memory back to the system: workers outlive their tasks."""

    def wrapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim is not None:
                trim(0)

    return wrapped


#: Bytes of a batch that are worked on at a time.
PORTION = 4_000_000


def portions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in the same order, in slices of about ``PORTION`` bytes (a row at least): what is made of a slice is small."""
    for batch in batches:
        step = max(1, batch.num_rows * PORTION // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def map_arrow(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """Map batches one to one; ``make`` runs once in each task and may keep state there."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield step(batch)

    return df.mapInArrow(lean(run), schema)


def replace_text(df: DataFrame, make: Callable[[], Callable[[list[str | None]], list[str | None]]], text_col: str = "text") -> DataFrame:
    """Rewrite one text column and leave every other column as it is."""
    schema = df.schema
    place = schema.fieldNames().index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in portions(batches):
            if batch.num_rows:
                columns = list(batch.columns)
                columns[place] = pa.array(step(columns[place].to_pylist()), pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(lean(run), schema)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts lineage, survives executors."""
    return Scratch(df, name).table


class Scratch:
    """A table in the shared folder that can be dropped when nothing reads it any more."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = scratch(self.spark, name)
        df.write.parquet(self.path)
        self.table = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def tasks_for(rows: int, per_task: int = 500_000) -> int:
    """Into how many parts a slim table of so many rows is written: few files for few rows."""
    return max(1, -(-rows // per_task))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have (names are compared as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fold_case(text: bytes) -> bytes:
    """Lower-case A-Z only."""
    return text.lower()


def id_crc(id_col: str = "doc_id") -> Column:
    """crc32 of the id written as text; null stays null."""
    return F.crc32(F.col(id_col).cast("string").cast("binary"))
