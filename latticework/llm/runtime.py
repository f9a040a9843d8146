"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from latticework.plans.store import Store  # noqa: F401
from latticework.plans.workers import prepare

#: Bytes of one pandas frame that a worker makes of an Arrow batch (one row may be larger); Spark bounds the batch itself.
FRAME_BYTES = 2 << 20


def _frame(batch: pa.RecordBatch) -> pd.DataFrame:
    whole = {pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype()}
    made = {}
    for name, col in zip(batch.schema.names, batch.columns):
        made[name] = col.to_pandas(types_mapper=whole.get) if col.null_count and col.type in whole else col.to_pandas()
    return pd.DataFrame(made)


def _frames(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        step = max(1, min(rows, int(batch.num_rows * FRAME_BYTES / max(1, batch.nbytes))))
        for lo in range(0, batch.num_rows, step):
            yield _frame(batch.slice(lo, step))


def map_frames(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, rows: int = 2000) -> DataFrame:
    """mapInPandas over frames bounded in rows and bytes, without a session setting; whole numbers stay exact beside nulls."""
    prepare(df.sparkSession)
    target = to_arrow_schema(StructType.fromDDL(schema))

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(_frames(batches, rows)):
            yield pa.RecordBatch.from_pandas(out, schema=target, preserve_index=False)

    return df.mapInArrow(over, schema)


_HELD: dict = {}


def held(key: tuple, make: Callable):
    """make(), kept while a worker goes on asking for the same: one heavy model at a time, as workers live on between stages."""
    if key not in _HELD:
        _HELD.clear()
        release()
        _HELD[key] = make()
    return _HELD[key]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, **more: Column) -> DataFrame:
    """All columns as one struct `row`, beside the named ones, so that no name of the table meets one of an operator's."""
    return df.select(F.struct(*[quoted(c) for c in df.columns]).alias("row"), *[c.alias(n) for n, c in more.items()])


def unpacked(df: DataFrame, names: list[str], **new: Column) -> DataFrame:
    """The columns of `row`; a new column takes the place of one with the same name (in any case), else comes last."""
    left = {n.lower(): (n, c) for n, c in new.items()}
    out = [left.pop(c.lower())[1].alias(c) if c.lower() in left else F.col("row").getField(c).alias(c) for c in names]
    return df.select(*out, *[c.alias(n) for n, c in left.values()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan, without running it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def release() -> None:
    """Hand memory that a worker has freed back to the machine, as workers live on between stages."""
    import ctypes

    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
