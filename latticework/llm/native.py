"""Column expressions over arrays that stay linear in the array's size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items of a running sum's block, and code points of a text's chunk.
BLOCK, CHUNK = 512, 1024


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once."""
    return F.transform(F.array(value), f)[0]


def _scan(items: Column, first: Column, step: Callable[[Column, Column], Column], after: bool) -> Column:
    """The state before (or after) each item: scans inside blocks, then over blocks, so that no long array is grown item by item."""

    def inner(at: Column, block: Column) -> Column:
        start = F.struct(at.alias("at"), F.array().cast("array<bigint>").alias("out"))

        def one(a: Column, n: Column) -> Column:
            new = step(a["at"], n)
            return F.struct(new.alias("at"), F.concat(a["out"], F.array(new if after else a["at"])).alias("out"))

        return F.aggregate(block, start, one)

    def outer(s: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(s) - 1, F.lit(0)), F.lit(BLOCK)), lambda b: F.slice(s, b + 1, BLOCK))
        start = F.struct(first.alias("at"), F.array().cast("array<array<bigint>>").alias("out"))
        return F.flatten(F.aggregate(blocks, start, lambda a, b: let(inner(a["at"], b), lambda r: F.struct(r["at"].alias("at"), F.concat(a["out"], F.array(r["out"])).alias("out"))), lambda a: a["out"]))

    return let(F.transform(items, lambda n: n.cast("bigint")), outer)


def running(sizes: Column) -> Column:
    """The sum of the items before each item."""
    return _scan(sizes, F.lit(0).cast("bigint"), lambda at, n: at + n, False)


def furthest(ends: Column) -> Column:
    """The largest item up to each item."""
    return _scan(ends, F.lit(0).cast("bigint"), F.greatest, True)


def chunks(text: Column) -> Column:
    """A text in pieces of CHUNK code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def between(parts: Column, a: Column, b: Column) -> Column:
    """The code points from a (0-based) to b of a text given by its chunks, reading only the chunks that hold them."""
    k = F.lit(CHUNK)
    first, last = F.floor(a / k).cast("int"), F.floor((b - 1) / k).cast("int")

    def piece(c: Column, i: Column) -> Column:
        low = F.when(i == 0, a - first * k).otherwise(F.lit(0).cast("bigint"))
        high = F.when(i == last - first, b - last * k).otherwise(k.cast("bigint"))
        return F.substring(c, (low + 1).cast("int"), (high - low).cast("int"))

    return F.when(b > a, F.array_join(F.transform(F.slice(parts, first + 1, last - first + 1), piece), "")).otherwise("")


def replace_spans(text: Column, spans: Column, n_chars: Column) -> Column:
    """text with spans (start, end, kind; sorted by start) replaced by their kind in brackets; overlapping ones become one, named after the first."""
    def merged_spans(held: Column) -> Column:
        """Heads of overlapping runs, each with the furthest end before the next head."""
        reach = furthest(F.transform(held, lambda s: s["end"]))

        def runs(r: Column) -> Column:
            head = F.filter(F.transform(held, lambda s, i: F.struct(i.alias("i"), s["start"].alias("start"), s["kind"].alias("kind"))), lambda h: (h["i"] == 0) | (h["start"] >= F.get(r, h["i"] - 1)))
            return let(head, lambda hs: F.transform(hs, lambda h, j: F.struct(h["start"].alias("start"), F.get(r, F.coalesce(F.get(hs, j + 1)["i"], F.size(r)) - 1).alias("end"), h["kind"].alias("kind"))))

        return let(reach, runs)

    def written(merged: Column, parts: Column) -> Column:
        out = F.transform(merged, lambda s, i: F.concat(between(parts, F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get(merged, i - 1)["end"]), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.concat(F.array_join(out, ""), between(parts, F.element_at(merged, -1)["end"], n_chars))

    return let(spans, lambda held: let(merged_spans(held), lambda merged: let(chunks(text), lambda parts: written(merged, parts))))
