"""Site-relative line dedup with DataFrame expressions only.

A line is boilerplate on a host when it stands on more than `ratio` of the
host's pages, and on at least `min_pages` of them. Pages of a host with the
same text count as one page, in both numbers, so that copies of a page do not
turn its prose into boilerplate. Lines are compared without outer spaces;
empty lines are never dropped.

With `near`, near copies count once too. Of the pages that hold a line over the
ratio, those whose text stands on other such pages of the host to `COPIED` or
more are copies: all of them together count as one page, in both numbers, so a
line that only copies share stays in all of them and none is emptied. Text is
compared by the `SKETCH` smallest hashes of a page's five-word shingles.

Counting shuffles hashes of lines only, pre-aggregated by page. A host has at
most (lines a page / ratio) boilerplate lines, so they travel as one array a
host: broadcast while all of them together are below a checked size, else
joined with the host's pages dealt over salts.

Defined cases: rows with a null host or text are left as they are; an empty
text stays empty; a page whose lines are all dropped keeps an empty text;
repeated rows are treated alike; other columns are carried along, whatever
their names, and the counts take the place of columns named like them; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.llm.runtime import Store, packed, quoted, unpacked

#: Boilerplate lines that may be broadcast, 8 bytes each.
BROADCAST_LINES, SALTS = 200_000, 64
#: Words of a shingle, shingle hashes that stand for a page, and their share on other pages from which a page is a copy.
WORDS, SKETCH, COPIED = 5, 32, 2 / 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _pages(docs: DataFrame, host: str, text: str) -> DataFrame:
    return docs.select(quoted(host).alias("__host"), F.xxhash64(quoted(text)).alias("__page"), quoted(text).alias("__text")).where("__host is not null and __text is not null")


def boilerplate(page: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """__host and __drop, the hashes of the host's boilerplate lines."""
    total = page.groupBy("__host").agg(F.count_distinct("__page").alias("__total"))
    line = page.select("__host", "__page", F.explode(F.array_distinct(F.transform(_lines(F.col("__text")), lambda x: F.when(F.trim(x) != "", F.xxhash64(F.trim(x)))))).alias("__line"))
    seen = line.where(F.col("__line").isNotNull()).groupBy("__host", "__line").agg(F.count_distinct("__page").alias("__n")).where(F.col("__n") >= min_pages)
    return seen.join(total, "__host").where(F.col("__n") > ratio * F.col("__total")).groupBy("__host").agg(F.collect_list("__line").alias("__drop"))


def _with_drop(docs: DataFrame, drop: DataFrame, host: str, text: str) -> DataFrame:
    size = drop.agg(F.coalesce(F.sum(F.size("__drop") + 8), F.lit(0))).first()[0]
    drop = drop.withColumnRenamed("__host", "__of")
    if size <= BROADCAST_LINES:
        return docs.join(F.broadcast(drop), F.col(host) == F.col("__of"), "left").drop("__of")
    dealt = drop.withColumn("__salt", F.explode(F.array([F.lit(i) for i in range(SALTS)])))
    salted = docs.withColumn("__s", F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int"))
    return salted.join(dealt, (F.col(host) == F.col("__of")) & (F.col("__s") == F.col("__salt")), "left").drop("__s", "__salt", "__of")


def _hit(text: str) -> Column:
    return F.coalesce(F.arrays_overlap(F.transform(_lines(F.col(text)), lambda x: F.xxhash64(F.trim(x))), F.col("__drop")), F.lit(False))


def copied_pages(page: DataFrame, drop: DataFrame, store: Store) -> DataFrame:
    """__host and __page of the pages with lines of drop whose text stands mostly on other such pages of the host."""
    w = F.filter(F.split(F.lower("__text"), r"\s+"), lambda x: x != "")
    held = _with_drop(page, drop, "__host", "__text").where(_hit("__text")).select("__host", "__page", w.alias("__w"))
    shingles = F.transform(F.sequence(F.lit(1), F.greatest(F.size("__w") - (WORDS - 1), F.lit(1))), lambda i: F.xxhash64(F.slice("__w", i, WORDS)))
    some = F.slice(F.array_sort(F.array_distinct(shingles)), 1, SKETCH)
    sketch = store.put("line_sketch", held.select("__host", "__page", F.explode(some).alias("__v")).distinct())
    often = sketch.groupBy("__host", "__v").count().where("count > 1").select("__host", "__v", F.lit(1).alias("__often"))
    often = store.put("line_often", often)
    share = sketch.join(often, ["__host", "__v"], "left").groupBy("__host", "__page").agg(F.count("__often").alias("__k"), F.count(F.lit(1)).alias("__n"))
    return store.put("line_copies", share.where(F.col("__k") >= COPIED * F.col("__n")).select("__host", "__page"))


def line_dedup(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.05, min_pages: int = 5, lines: str = "n_lines", removed: str = "n_removed", near: bool = False) -> DataFrame:
    """All columns of docs, text without boilerplate lines, and the counts of lines before and of lines removed."""
    store = Store(docs.sparkSession)
    page = _pages(docs, host, text)
    drop = store.put("boilerplate", boilerplate(page, ratio, min_pages))
    if near:
        copies = copied_pages(page, drop, store).withColumn("__copy", F.lit(True))
        counted = page.join(copies, ["__host", "__page"], "left").withColumn("__page", F.when(F.col("__copy"), F.lit(0).cast("bigint")).otherwise(F.col("__page")))
        drop = store.put("boilerplate_near", boilerplate(counted, ratio, min_pages))
    whole = packed(docs, __host=quoted(host), __text=quoted(text))
    held = _with_drop(whole, drop, "__host", "__text")
    every = _lines(F.col("__text"))
    kept = F.filter(every, lambda x: ~((F.trim(x) != "") & F.array_contains(F.col("__drop"), F.xxhash64(F.trim(x)))))
    out = held.withColumn("__kept", F.when(_hit("__text"), kept))
    n = F.coalesce(F.when(F.col("__text").isNotNull(), F.size(every)), F.lit(0)).cast("bigint")
    gone = F.when(F.col("__kept").isNull(), F.lit(0)).otherwise(F.size(every) - F.size("__kept")).cast("bigint")
    new = F.when(F.col("__kept").isNull(), F.col("__text")).otherwise(F.array_join("__kept", "\n"))
    return unpacked(out, docs.columns, **{text: new, lines: n, removed: gone})


SQL = r"""
WITH d AS (SELECT DISTINCT source, text FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
tot AS (SELECT source, count(*) AS n FROM d GROUP BY source),
l AS (SELECT source, text, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: trim(x)))) AS line FROM d),
f AS (SELECT source, line, count(*) AS c FROM l WHERE line <> '' GROUP BY source, line),
b AS (SELECT f.source, f.line FROM f JOIN tot ON tot.source = f.source WHERE f.c >= 5 AND f.c > 0.05 * tot.n),
s AS (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, source, unnest(ls) AS raw, unnest(range(len(ls))) AS pos FROM s),
k AS (SELECT e.doc_id, e.raw, e.pos, b.line FROM e LEFT JOIN b ON b.source = e.source AND b.line = trim(e.raw))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(line) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(CASE WHEN line IS NULL THEN raw END, chr(10) ORDER BY pos), '')) AS text_sha256
FROM k GROUP BY doc_id
"""
