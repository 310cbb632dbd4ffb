"""Helpers of the training-data operators: table access and cutting of lineage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..scratch import written
from ..shipping import ship

__all__ = ["BLOCK_CHARS", "absent", "add_by_block", "columns", "drop_held", "hold", "hot_keys", "release", "ship", "slices", "small_batches", "spread_join", "table", "written"]

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of text that an operator on blocks takes at once; a longer document makes a block of its own.
BLOCK_CHARS = 1_000_000


#: Setting and bytes of the Arrow batches in which Spark hands rows to a Python worker. With Spark's own 64 MB an executor of
#: two tasks on whole texts held 1,200 MB more than with this, in and outside its heap.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4_194_304


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session's Python steps, unless the session has a bound of its own; a longer row is a batch by itself."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def absent(df: DataFrame, *names: str) -> list[str]:
    """For each name one like it that df has no column of, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def columns(df: DataFrame) -> list[Column]:
    """All columns of df, dots and back-ticks in their names or not."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


#: A key is hot if it holds more than 1/HOT_SHARES of the rows, so at most HOT_SHARES keys are.
HOT_SHARES = 1024


def hot_keys(counts: DataFrame, keys: list[str], n: str, total: int, shares: int = HOT_SHARES) -> DataFrame:
    """(keys, _salts) of the ``shares`` most frequent keys of counts (keys, n), all hot ones among them; total: the sum of n.

    A key that is not hot has one salt. The list has a row wherever counts has one, so plans look alike with and without hot keys.
    """
    return counts.orderBy(F.desc(n)).limit(shares).select(*keys, F.ceil(F.col(n) * shares / F.lit(max(total, 1))).cast("int").alias("_salts"))


def spread_join(rows: DataFrame, few: DataFrame, keys: list[str], hot: DataFrame, by: Column, how: str = "inner") -> DataFrame:
    """rows joined with few, which has one row for each key; the rows of a hot key are dealt over its salts by the hash ``by``.

    ``hot`` comes from hot_keys and is bounded, so it is broadcast; at most twice its bound in copies of few's rows are made.
    """
    salts = F.coalesce("_salts", F.lit(1))
    left = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(by, salts).cast("int")).drop("_salts")
    right = few.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def release() -> None:
    """Gives memory that a Python worker no longer uses back to the system, as it lives on for other stages."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


_HELD: dict[str, Callable[[], None]] = {}


def hold(name: str, clear: Callable[[], None]) -> None:
    """Notes that a Python worker keeps tables of this name between tasks, and how to drop them."""
    _HELD[name] = clear


def drop_held(but: str | None = None) -> None:
    """Drops what other operators keep in this worker, before it starts on a partition."""
    for name in [n for n in _HELD if n != but]:
        _HELD.pop(name)()


def slices(column: pa.Array, block_chars: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of a text column of at most so many bytes; a longer text makes a range of its own."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start = 0
    while start < len(lengths):
        end, held = start, 0
        while end < len(lengths) and (end == start or held + lengths[end] <= block_chars):
            held += lengths[end]
            end += 1
        yield start, end
        start = end


def add_by_block(df: DataFrame, text: str, into: str, schema: str, judge: Callable[[list[str]], list], block_chars: int = BLOCK_CHARS, holds: str | None = None) -> DataFrame:
    """df with a struct column ``into`` of the given schema, made from the column ``text`` block by block.

    judge: takes whole texts (null as the empty text) and gives a list of columns in the order of schema.
    All other columns pass through as Arrow data, untouched; a column that is already named ``into`` is
    replaced. holds: the name of the tables that judge keeps in a worker between tasks.
    """
    ship(df.sparkSession)
    small_batches(df.sparkSession)
    kept = df.select(*[c for c, name in zip(columns(df), df.columns, strict=True) if name.lower() != into.lower()])
    at, plain = kept.columns.index(text), [f"c{k}" for k in range(len(kept.columns))]  # Spark hands columns over by plain names only
    numbered = kept.toDF(*plain)
    struct = T._parse_datatype_string(schema)
    types = [to_arrow_type(f.dataType) for f in struct.fields]
    names = struct.fieldNames()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held(holds)
        for batch in batches:
            column = batch.column(at)
            for start, end in slices(column, block_chars):
                texts = ["" if t is None else t for t in column.slice(start, end - start).to_pylist()]
                made = [pa.array(c, t, from_pandas=True) for c, t in zip(judge(texts), types, strict=True)]
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.StructArray.from_arrays(made, names)], [*plain, "made"])
            release()

    return numbered.mapInArrow(blocks, T.StructType([*numbered.schema.fields, T.StructField("made", struct)])).toDF(*kept.columns, into)
