"""Structure files as they arrive: every micro-batch of files goes through the same per-molecule operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.schema import ATOM, columns, frame
from latticework.sources.structures import PARSERS


def stream_atoms(spark: SparkSession, folder: str, fmt: str = "pdb", **options) -> DataFrame:
    """A streaming relation of atoms from whole files that appear in a folder. Files are independent: no state is kept."""
    files = spark.readStream.schema("value string").option("wholetext", "true").text(folder).select(F.input_file_name().alias("system_id"), "value")
    parse, names = PARSERS[fmt], columns(ATOM)

    def run(batches):
        for pdf in batches:
            for system, text in zip(pdf["system_id"], pdf["value"]):
                yield frame([a | {"system_id": system, "node": i, "ord": i} for i, a in enumerate(parse(text, **options)["atoms"])], names)

    return files.mapInPandas(run, ATOM)


def run_stream(atoms: DataFrame, op: Callable[[DataFrame], DataFrame], target: str, checkpoint: str):
    """Applies an operator to each micro-batch and appends its rows; a batch that is run again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        op(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return atoms.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
