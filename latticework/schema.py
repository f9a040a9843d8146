"""The relations that molecules are held in, and a bundle of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

ATOM = (
    "system_id string, mol_id bigint, node bigint, ord bigint, atomid bigint, atomname string, altloc string, resname string, chain string, resid int, "
    "insertion_code string, element string, charge double, mass double, atype string, charge_group bigint, x double, y double, z double, "
    "vx double, vy double, vz double, occupancy double, temp_factor double, model int"
)
EDGE = "system_id string, mol_id bigint, u bigint, v bigint, distance double"
INTERACTION = "system_id string, mol_id bigint, itype string, seq bigint, atoms array<bigint>, params array<string>, version int, grp string, ifdef string, ifndef string, comment string"
MOLECULE = "system_id string, mol_id bigint, moltype string, nrexcl int, ff string, meta map<string,string>, box array<double>"
CONTACT = "system_id string, resid_a int, chain_a string, resid_b int, chain_b string"
MESSAGE = "system_id string, level string, type string, text string"
RELATIONS = {"atom": ATOM, "edge": EDGE, "interaction": INTERACTION, "molecule": MOLECULE, "contact": CONTACT, "message": MESSAGE}


def columns(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


@dataclass(frozen=True)
class Bundle:
    """DataFrames that share system_id and mol_id. Operators take a bundle and return a new one."""

    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def with_tables(self, **new: DataFrame) -> Bundle:
        return Bundle(self.tables | new)

    def then(self, *ops: Callable[[Bundle], Bundle]) -> Bundle:
        out = self
        for op in ops:
            out = op(out)
        return out

    @staticmethod
    def empty(spark: SparkSession) -> Bundle:
        return Bundle({n: spark.createDataFrame([], T._parse_datatype_string(d)) for n, d in RELATIONS.items()})


def frame(rows: list, names: list[str]):
    """Rows (dicts or tuples) as a pandas frame of plain objects, so that missing values of any type stay missing."""
    import pandas as pd

    if rows and isinstance(rows[0], dict):
        rows = [tuple(r.get(c) for c in names) for r in rows]
    cols = list(zip(*rows)) if rows else [()] * len(names)
    return pd.DataFrame({c: pd.Series(list(v), dtype=object) for c, v in zip(names, cols)})
