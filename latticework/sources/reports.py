"""Reports of other programs: secondary structure and contact maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """system_id, number (from 0), line of whole text files."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("system_id"), "value")
    return files.select("system_id", F.posexplode(F.split("value", "\r?\n", -1)).alias("number", "line"))


def read_secondary_structure(spark: SparkSession, path: str) -> DataFrame:
    """system_id, res_id, letter: column 17 of the lines after the '#' header; blank is coil; lines with '!' are breaks."""
    lines = _numbered(spark, path)
    head = lines.where(F.trim("line").startswith("#")).groupBy("system_id").agg(F.min("number").alias("__h"))
    body = lines.join(head, "system_id").where((F.col("number") > F.col("__h")) & (F.trim("line") != "") & ~F.contains("line", F.lit("!")))
    raw = F.substring("line", 17, 1)
    bad = F.raise_error(F.concat(F.lit("unknown or missing structure in line: "), F.col("line")))
    letter = F.when(F.char_length("line") < 17, bad).when(~raw.rlike("^[HBEGITS ]$"), bad).when(raw == " ", "C").otherwise(raw)
    return body.select("system_id", (F.row_number().over(W.partitionBy("system_id").orderBy("number")) - 1).alias("res_id"), letter.alias("letter"))


def read_contacts(spark: SparkSession, path: str) -> DataFrame:
    """Contacts of 18-token lines that begin with R: overlap contacts, or residue contacts without overlap."""
    t = _numbered(spark, path).select("system_id", F.split(F.trim("line"), r"\s+").alias("t")).where((F.size("t") == 18) & (F.get("t", F.lit(0)) == "R"))
    g = lambda i: F.get("t", F.lit(i))
    kept = t.where((g(11) == "1") | ((g(11) == "0") & (g(14) == "1")))
    return kept.select("system_id", g(5).cast("int").alias("resid_a"), g(4).alias("chain_a"), g(9).cast("int").alias("resid_b"), g(8).alias("chain_b"))


def contact_lines(contacts: DataFrame) -> DataFrame:
    """system_id, line_no, line of contacts (ia, ib, resname_, chain_, resid_ of a and b, distance, over, stab, dest, rcsu, count)."""
    n = F.row_number().over(W.partitionBy("system_id").orderBy("ia", "ib"))
    line = F.format_string("R %6d %5d  %-3s %1s %4d    %5d  %-3s %1s %4d    %9.4f     %d %d %d %d%6d  %6d     0", n, F.col("ia"), F.col("resname_a"), F.col("chain_a"), F.col("resid_a"), F.col("ib"), F.col("resname_b"), F.col("chain_b"), F.col("resid_b"), F.col("distance") * 10, F.col("over"), (F.col("count") != 0).cast("int"), (F.col("stab") != 0).cast("int"), (F.col("rcsu") > 0).cast("int"), F.col("rcsu"), F.col("count"))
    return contacts.select("system_id", n.alias("line_no"), line.alias("line"))
