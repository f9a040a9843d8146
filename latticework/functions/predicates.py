"""Template predicates as Column expressions: what a rule says about an attribute, evaluated inside Catalyst."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Residue names taken as protein, and backbone atom names.
PROTEIN_RESIDUES = ("ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE", "LEU", "LYS", "MET", "PHE", "PRO", "SER", "THR", "TRP", "TYR", "VAL")
ABSENT = "<ABSENT>"


@dataclass(frozen=True)
class Predicate:
    """Base: compiles to a Boolean column that is never null. has: whether the key exists (defaults to not null)."""

    value: object

    def column(self, c: Column, has: Column | None = None) -> Column:
        return c.eqNullSafe(F.lit(self.value))


class Choice(Predicate):
    """One of several values; None among them stands for a missing one."""

    def column(self, c: Column, has: Column | None = None) -> Column:
        given = [v for v in self.value if v is not None]
        hit = F.coalesce(c.isin(*given), F.lit(False)) if given else F.lit(False)
        return hit | c.isNull() if None in self.value else hit


class FullRegex(Predicate):
    """A pattern that must match the whole value; a missing value reads as a marker text."""

    def column(self, c: Column, has: Column | None = None) -> Column:
        return F.coalesce(c, F.lit(ABSENT)).rlike(rf"^(?:{self.value})\z")


class NotDefinedOrNot(Predicate):
    """The key is absent, or its value is another one; a present null counts as a value."""

    def column(self, c: Column, has: Column | None = None) -> Column:
        has = c.isNotNull() if has is None else has
        return ~has | ~c.eqNullSafe(F.lit(self.value))


def as_predicate(value) -> Predicate:
    return value if isinstance(value, Predicate) else Predicate(value)


def matches(template: dict, get=F.col, ignore: tuple[str, ...] = (), has=None) -> Column:
    """All attributes of a template hold; get(name) gives the column, has(name) whether the key is present."""
    parts = [as_predicate(v).column(get(k), has(k) if has else None) for k, v in template.items() if k not in ignore]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def any_matches(templates: list[dict], get=F.col, ignore: tuple[str, ...] = ()) -> Column:
    return reduce(lambda a, b: a | b, [matches(t, get, ignore) for t in templates], F.lit(False))


def in_regions(resid: Column, regions: list[tuple[int, int]]) -> Column:
    """Within any of the regions; the limits of each may stand in either order."""
    return reduce(lambda a, b: a | b, [resid.between(min(r), max(r)) for r in regions], F.lit(False))


def in_chain_regions(chain: Column, resid: Column, regions: list[tuple[str | None, int, int]]) -> Column:
    """As in_regions; a region's chain None stands for every chain."""
    return reduce(lambda a, b: a | b, [(F.lit(True) if c is None else chain.eqNullSafe(F.lit(c))) & resid.between(min(lo, hi), max(lo, hi)) for c, lo, hi in regions], F.lit(False))


def has_position(x: str = "x", y: str = "y", z: str = "z") -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in (x, y, z)])


def is_backbone(atomname: str = "atomname") -> Column:
    return F.col(atomname).eqNullSafe(F.lit("BB"))


def attribute_in(column: str, values: list) -> Column:
    return Choice(tuple(values)).column(F.col(column))


def ptm_nodes_match(a: str, b: str) -> Column:
    """Modification atoms: equal flags, then the element of two new atoms or else the atom name."""
    pa, pb = F.coalesce(F.col(f"{a}.ptm_atom"), F.lit(False)), F.coalesce(F.col(f"{b}.ptm_atom"), F.lit(False))
    return (pa == pb) & F.when(pa, F.col(f"{a}.element").eqNullSafe(F.col(f"{b}.element"))).otherwise(F.col(f"{a}.atomname").eqNullSafe(F.col(f"{b}.atomname")))


def modifications_match(have: Column, want: list | None) -> Column:
    """A link's modification list: absent or empty asks for none, else the same set in any order."""
    have = F.coalesce(have, F.array().cast("array<string>"))
    return F.size(have) == 0 if not want else F.sort_array(have) == F.sort_array(F.array(*[F.lit(x) for x in want]))


def nearly_equal(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Numbers up to a tolerance; two NaN and two nulls are equal."""
    close = (F.abs(a - b) <= atol + rtol * F.abs(b)) | (F.isnan(a) & F.isnan(b))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(close)
