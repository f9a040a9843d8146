"""Scalar functions of the molecular operators, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Masses by element (others weigh 30).
MASSES = {"H": 1, "C": 12, "N": 14, "O": 16, "S": 32, "P": 31}
OTHER_MASS = 30
#: Secondary structure letters and the coarse letter of each.
COARSE = {"1": "H", "2": "H", "3": "H", "H": "H", "G": "H", "I": "H", "B": "E", "E": "E", "T": "T", "S": "S", "C": "C"}


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def mass(element: Column) -> Column:
    return F.coalesce(_map(MASSES)[element], F.lit(OTHER_MASS)).cast("double")


def first_letter(name: Column) -> Column:
    """The element guessed from an atom name: its first ASCII letter; an error if there is none."""
    got = F.regexp_extract(name, "[A-Za-z]", 0)
    return F.when(got == "", F.raise_error(F.concat(F.lit("no letter in "), F.coalesce(name, F.lit("null"))))).otherwise(got)


def atom_label(atomid: Column, chain: Column, resname: Column, resid: Column, atomname: Column) -> Column:
    return F.format_string("%d%s-%s%d:%s", atomid.cast("bigint"), F.coalesce(chain, F.lit("")), resname, resid.cast("bigint"), atomname)


def truncate_right(text: Column, width: int) -> Column:
    """Left-aligned and cut at the right end: how text columns are written."""
    return F.rpad(text, width, " ")


def truncate_left(number: Column, width: int) -> Column:
    """Right-aligned and cut at the left end: how numbers are written."""
    s = number.cast("string")
    return F.lpad(F.when(F.char_length(s) > width, F.substring(s, -width, width)).otherwise(s), width, " ")


def bead_size(atype: Column) -> Column:
    return F.when(atype.startswith("S"), "small").when(atype.startswith("T"), "tiny").otherwise("regular")


def charge(text: Column) -> Column:
    """'2-' and '-2' are both minus two, empty is zero."""
    t = F.trim(text)
    return F.when(t == "", F.lit(0.0)).otherwise(F.coalesce(t.try_cast("double"), F.reverse(t).try_cast("double")))


def helix_letters(sequence: Column) -> Column:
    """Coarse secondary structure with helix ends marked, for a string of letters.

    Runs of H (after mapping to coarse letters) of length n become, from both ends:
    n <= 3: all 3; 4: 3333; 5: 13332; 6: 113322; 7: 1113222; longer: 1111 H.. 2222.
    """
    coarse = F.translate(sequence, "".join(COARSE), "".join(COARSE.values()))
    runs = F.regexp_extract_all(coarse, F.lit("H+|[^H]"), F.lit(0))

    def run(x: Column) -> Column:
        n = F.char_length(x)
        short = F.when(n <= 4, F.repeat(F.lit("3"), n)).when(n == 5, F.lit("13332")).when(n == 6, F.lit("113322")).when(n == 7, F.lit("1113222"))
        long = F.concat(F.lit("1111"), F.repeat(F.lit("H"), n - 8), F.lit("2222"))
        return F.when(~x.startswith("H"), x).otherwise(F.coalesce(short, long))

    return F.array_join(F.transform(runs, run), "")


def phase_wrap(angle: Column) -> Column:
    import math

    return F.when(angle > math.pi, angle - 2 * math.pi).when(angle < -math.pi, angle + 2 * math.pi).otherwise(angle)
