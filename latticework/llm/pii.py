"""Personal data by candidate generation and boosted trees, with DataFrame expressions only on the main path.

Base rules find e-mail addresses, IP addresses, card and phone numbers; their
valid matches are always spans. High-recall generators propose further,
overlapping candidates (written-out addresses, plain or grouped telephone
numbers, keys and tokens, card-like numbers). Each candidate gets format and
context features, the gradient-boosted trees of its kind (compiled to one
column expression) score it, and a threshold for each kind, calibrated on rows
the trees did not see, selects it.

The trees are fitted on the whole table; equal texts count once. The corpus has
no labels of personal data, so examples are labelled by how they were made, not
by what the trees look at: values drawn from hashes (`planted`) are written in
the wider forms (written-out addresses, national and card groupings, keys of
random digits) into a context from every text, as are near misses (a wrong
check digit, a number that goes on or is too short, figures and words around
the marks of an address, names after `key =`); all matches of the base patterns
in all texts count by whether they are valid. Examples are counted by feature
vector, features rounded up to exact quantiles of the whole, and each level of
the trees is chosen from sums over that table. Beyond `IN_MEMORY` rows of it the
driver gets only those sums, whose number does not depend on the rows; as they
are whole numbers the trees do not depend on the partitions. A third of the examples is kept from the
trees: thresholds are the least scores at which that whole third reaches
`precision`, and `PiiModel.report` holds what each kind then has of precision
and recall. A kind that never reaches it adds no spans.
Candidates inside a base span add nothing and are left out.

The patterns use no repeated groups without bound: long inputs neither
backtrack without end nor exhaust the stack. Possessive runs with a look
behind keep the leftmost, non-overlapping matches of the plain patterns.

Defined cases: null text is the empty text and has no spans; repeated rows
are treated alike; other columns are carried along, whatever their names, and
`spans` takes the place of a column named so; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.llm.native import between, chunks, let, replace_spans, running
from latticework.llm.runtime import Store, packed, quoted, unpacked

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
_L = "A-Za-z0-9._%+-"
#: Leftmost, non-overlapping matches of the base patterns.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_L}]))[{_L}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without this cannot match, so the pattern need not run.
NEEDS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
#: Further candidates: kind -> pattern.
MORE = {
    "email": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++ ?[\[(] ?(?:at|AT) ?[\])] ?[A-Za-z0-9-]++(?: ?[\[(] ?(?:dot|DOT) ?[\])] ?[A-Za-z0-9-]++){1,4}+",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{4}[ .-]){3}[0-9]{1,7}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9])(?:token|key|secret|password)[ \"']{0,3}[=:][ \"']{0,3}[A-Za-z0-9_+/.-]{16,}+",
}
MORE_NEEDS = {"email": r"[\[(] ?(?:at|AT) ?[\])]", "card": r"[0-9]{4}[ .-][0-9]{4}[ .-]", "phone": r"[0-9](?:[ .-]|\) ?)[0-9]{3,4}[ .-][0-9]{3}", "secret": r"[=:][ \"']{0,3}[A-Za-z0-9_+/.-]{16}"}
#: rank orders kinds as listed; base marks the valid matches of the base rules.
_SPAN = "array<struct<rank:int,start:bigint,end:bigint,kind:string,value:string,base:boolean>>"


def _located(text: Column, pattern: str, needs: str, kind: str, base: bool) -> Column:
    """All matches of a pattern with code point positions: from the matches and the text between them."""
    none = F.array().cast(_SPAN)

    def spans(pairs: Column) -> Column:
        starts = running(F.transform(pairs, lambda p: F.char_length(p["gap"]) + F.char_length(p["hit"])))

        def one(p: Column, i: Column, at: Column) -> Column:
            a = F.get(at, i) + F.char_length(p["gap"])
            return F.struct(F.lit(ALL_KINDS.index(kind)).alias("rank"), a.alias("start"), (a + F.char_length(p["hit"])).alias("end"), F.lit(kind).alias("kind"), p["hit"].alias("value"), (_valid(kind, p["hit"]) if base else F.lit(False)).alias("base"))

        return let(starts, lambda at: F.transform(pairs, lambda p, i: one(p, i, at)))

    def paired(hits: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(hits))
        return let(F.arrays_zip(hits.alias("hit"), gaps.alias("gap")), spans)

    return F.when(text.rlike(needs), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), paired).cast(_SPAN)).otherwise(none)


def _digit_sum(value: Column) -> Column:
    """The sum of digits that cards are checked by."""
    d = F.transform(F.split(F.reverse(F.regexp_replace(value, "[^0-9]", "")), ""), lambda x: x.try_cast("int"))
    part = F.transform(F.filter(d, lambda x: x.isNotNull()), lambda x, i: F.when(i % 2 == 0, x).otherwise(F.when(x > 4, x * 2 - 9).otherwise(x * 2)))
    return F.aggregate(part, F.lit(0), lambda a, x: a + x)


def _luhn(value: Column) -> Column:
    return _digit_sum(value) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?"
        one = f"(?=[0-9]){part}"
        return value.rlike(f"^{one}\\.{one}\\.{one}\\.{one}$")
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.char_length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _wide(text: Column) -> list[Column]:
    return [_located(text, MORE[k], MORE_NEEDS[k], k, False) for k in MORE]


def candidates(text: Column) -> Column:
    """What the generators propose: matches of the base patterns, valid or not, and of the wider ones."""
    return F.concat(*[_located(text, PATTERNS[k], NEEDS[k], k, True) for k in KINDS], *_wide(text))


_BEFORE = "substring(t, cast(greatest(s.start - 23, 1) AS int), cast(least(s.start, 24) AS int))"
_AFTER = "substring(t, cast(s.end + 1 AS int), 2)"


def _count(kept: str) -> str:
    return f"cast(char_length(s.value) - char_length(regexp_replace(s.value, '{kept}', '')) AS double)"


_LUHN = (
    "aggregate(transform(filter(split(reverse(regexp_replace(s.value, '[^0-9]', '')), ''), d -> d <> ''), (d, i) -> CASE WHEN i % 2 = 0 THEN int(d) WHEN int(d) > 4 THEN int(d) * 2 - 9 ELSE int(d) * 2 END), 0, (a, d) -> a + d) % 10 = 0"
)
#: Format and context of a candidate s in a text t, as SQL.
FEATURES = {
    "chars": "cast(char_length(s.value) AS double)", "digits": _count("[0-9]"), "letters": _count("[A-Za-z]"), "separators": _count("[ ()\\\\[\\\\]-]"), "dots": _count("[.]"),
    "groups": "cast(size(split(s.value, '[^0-9A-Za-z]+')) AS double)", "distinct": "cast(size(array_distinct(split(s.value, ''))) AS double)",
    "left_digit": f"double({_BEFORE} rlike '[0-9]$')", "right_digit": f"double({_AFTER} rlike '^[0-9]')",
    "left_space": f"double({_BEFORE} rlike '(^|\\\\s)$')", "right_space": f"double({_AFTER} rlike '^(\\\\s|$)')",
    "colon_before": f"double({_BEFORE} rlike '[:=] ?$')", "cue": f"double(lower({_BEFORE}) rlike '(mail|tel|phone|call|fax|card|visa|addr|ip|token|key|secret|password)')",
    "luhn": f"double({_count('[0-9]')} BETWEEN 13 AND 19 AND {_LUHN})", "goes_on": f"double({_BEFORE} rlike '[0-9][ .-]$' OR {_AFTER} rlike '^[ .-][0-9]')",
}
FEATURE_VECTOR = f"array({', '.join(FEATURES.values())})"


#: Rows of (value, examples, gradient, curvature) by value, one array a feature, of the examples in a node.
Sums = list[np.ndarray]
#: Counted examples, distinct after rounding, that are summed in memory; more are summed over the cluster.
IN_MEMORY = 1 << 15
#: Gradients are summed as whole multiples of 1 / UNIT, so that their order does not matter.
UNIT = 1 << 30


class Boosted:
    """Boosted trees of depth two on logistic loss: grown from sums over the examples, scored as a column expression."""

    def __init__(self, rounds: int = 12, rate: float = 0.4, cuts: int = 12):
        self.rounds, self.rate, self.cuts = rounds, rate, cuts
        self.base, self.trees = 0.0, []

    def start(self, n: int, positive: float) -> Boosted:
        p = min(max(positive / n, 1e-3), 1 - 1e-3) if n else 0.5
        self.base, self.trees = float(np.log(p / (1 - p))), []
        return self

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """The same trees from rows in memory."""
        self.start(len(y), y.sum())
        if not len(y) or y.min() == y.max():
            return self
        at = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.cuts + 2)[1:-1])) for j in range(x.shape[1])]
        x = np.stack([np.append(t, np.inf)[np.searchsorted(t, x[:, j])] for j, t in enumerate(at)], axis=1)
        self.grow_from(x, y, np.ones(len(y), dtype=np.int64))
        return self

    def grow_from(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> None:
        """Grow from counted examples in memory."""

        def sums(roots: dict) -> dict[tuple[str, int], Sums]:
            q = self.predict(x)
            rows = np.stack([n, *(np.rint(c * UNIT).astype(np.int64) * n for c in (y - q, np.maximum(q * (1 - q), 1e-6)))], axis=1)
            node = x[:, roots[""][0]] > roots[""][1] if roots else np.zeros(len(y), dtype=bool)
            out = {}
            for i in np.unique(node):
                out["", int(i)] = held = []
                for j in range(x.shape[1]):
                    v, of = np.unique(x[node == i, j], return_inverse=True)
                    total = np.zeros((len(v), 3), dtype=np.int64)
                    np.add.at(total, of, rows[node == i])
                    held.append(np.column_stack([v, total / [1, UNIT, UNIT]]))
            return out

        grow({"": self}, sums)

    def _leaf(self, g: float, h: float) -> float:
        return float(self.rate * g / (h + 1.0))

    def _best(self, held: Sums) -> tuple[int, float] | None:
        """The feature and its value that part a node best."""
        best, at = 1e-6, None
        for j, rows in enumerate(held):
            n, g, h = rows[:, 1:].sum(axis=0)
            if n <= 4 or len(rows) < 2:
                continue
            low = np.cumsum(rows[:-1, 2:], axis=0)
            gain = low[:, 0] ** 2 / (low[:, 1] + 1.0) + (g - low[:, 0]) ** 2 / (h - low[:, 1] + 1.0) - g**2 / (h + 1.0)
            i = int(gain.argmax())
            if gain[i] > best:
                best, at = gain[i], (j, float(rows[i, 0]))
        return at

    def _side(self, held: Sums) -> tuple[int, float, float, float]:
        best = self._best(held)
        g, h = held[0][:, 2:].sum(axis=0)
        if best is None:
            v = self._leaf(g, h)
            return 0, float("inf"), v, v
        k, u = best
        lg, lh = held[k][held[k][:, 0] <= u, 2:].sum(axis=0)
        return k, u, self._leaf(lg, lh), self._leaf(g - lg, h - lh)

    def predict(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for j, t, low, high in self.trees:
            for side, (k, u, a, b) in ((x[:, j] <= t, low), (x[:, j] > t, high)):
                f += np.where(side, np.where(x[:, k] <= u, a, b), 0.0)
        return 1 / (1 + np.exp(-f))

    def sql(self, x: str) -> str:
        """The probability of a feature array named x, as SQL."""

        def leaf(node) -> str:
            k, u, a, b = node
            return f"({a!r}D)" if u == float("inf") else f"(CASE WHEN {x}[{k}] <= {u!r}D THEN {a!r}D ELSE {b!r}D END)"

        trees = [f"(CASE WHEN {x}[{j}] <= {t!r}D THEN {leaf(low)} ELSE {leaf(high)} END)" for j, t, low, high in self.trees]
        return f"(1 / (1 + exp(-({' + '.join([f'({self.base!r}D)', *trees])}))))"


def grow(models: dict[str, Boosted], sums: Callable[[dict[str, tuple[int, float]]], dict[tuple[str, int], Sums]]) -> None:
    """Add a tree to each model in each round. sums(roots): by kind and side of its root (0 without roots), sums under the models as they are."""
    for _ in range(max((m.rounds for m in models.values()), default=0)):
        whole = sums({})
        roots = {k: root for k, m in models.items() if len(m.trees) < m.rounds and (k, 0) in whole and (root := m._best(whole[k, 0])) is not None}
        if not roots:
            return
        parted = sums(roots)
        for k, (j, t) in roots.items():
            models[k].trees.append((j, t, models[k]._side(parted[k, 0]), models[k]._side(parted[k, 1])))


class PiiModel:
    """Trees and thresholds by kind; report: kind -> (examples kept from the trees, precision, recall)."""

    def __init__(self, trees: dict[str, Boosted], thresholds: dict[str, float], report: dict[str, tuple[int, float, float]] | None = None):
        self.trees, self.thresholds, self.report = trees, thresholds, report or {}


def planted() -> Column:
    """Texts with one value each, drawn from a hash h, in a context (before, after): array of (kind, text, start, end, y); y tells values from near misses."""

    def number(salt: int, digits: int) -> str:
        return f"lpad(cast(pmod(xxhash64({salt}, h), {10**digits}) AS string), {digits}, '0')"

    def dealt(salt: int, *of: str) -> str:
        return f"element_at(array({', '.join(map(repr, of))}), cast(pmod(xxhash64({salt}, h), {len(of)}) + 1 AS int))"

    def groups(d: str, cuts: tuple[int, ...], sep: str) -> str:
        return f"concat_ws({sep}, {', '.join(f'substring({d}, {sum(cuts[:i]) + 1}, {n})' for i, n in enumerate(cuts))})"

    digits = "aggregate(transform(filter(split(reverse({}), ''), d -> d <> ''), (d, i) -> CASE WHEN i % 2 = 0 THEN int(d) WHEN int(d) > 4 THEN int(d) * 2 - 9 ELSE int(d) * 2 END), 0, (a, d) -> a + d)"
    # drawn once a text: fields of d and e
    payload, hexes, line, form = "d.payload", "d.hexes", "d.line", "pmod(xxhash64(1, h), 4)"
    check = f"pmod(10 - {digits.format(f'concat({payload}, 0)')} % 10, 10)"
    good, bad = "e.good", "e.bad"
    key = f"CASE WHEN {form} = 0 THEN substring({hexes}, 1, 40) WHEN {form} = 1 THEN {hexes} WHEN {form} = 2 THEN upper(substring({hexes}, 3, 32)) ELSE replace(substring(base64(unhex({hexes})), 1, 32), '=', 'a') END"
    cue = f"concat({dealt(2, 'token', 'key', 'secret', 'password')}, {dealt(3, ' = ', '=', ': ', ':')})"
    named = f"concat_ws({dealt(4, '_', '.', '-')}, {dealt(5, 'some', 'default', 'primary', 'user')}, {dealt(6, 'long', 'public', 'shared', 'current')}, {dealt(7, 'identifier', 'configuration', 'directory', 'element')})"
    national = f"CASE WHEN pmod(xxhash64(12, h), 4) = 0 THEN concat('(', substring({line}, 1, 3), ') ', substring({line}, 4, 3), '-', substring({line}, 7, 4)) ELSE {groups(line, (3, 3, 4), dealt(10, '.', ' ', '-'))} END"
    goes_on = f"CASE WHEN pmod(xxhash64(22, h), 2) = 0 THEN concat({number(23, 3)}, '-', {groups(line, (3, 3, 4), repr('-'))}) ELSE concat({groups(line, (3, 3, 4), repr('-'))}, '-', {number(24, 3)}) END"
    at, dot = dealt(13, " [at] ", "[at]", " (at) ", "(at)"), dealt(14, " [dot] ", "[dot]", " (dot) ", "(dot)")
    who = f"concat({dealt(15, 'jo', 'maria', 'lee.k', 'info', 'office')}, {dealt(16, '', '7', '_x', '.23', '20714')})"
    fours = (4, 4, 4, 4)
    rows = [
        ("email", f"concat({who}, {at}, {dealt(17, 'mail', 'example', 'web-host', 'post3', 'mx4051')}, {dot}, {dealt(18, 'com', 'org', 'de', 'net')})", 1),
        ("email", f"concat({number(19, 2)}, {at}, {number(20, 1)}, {dot}, {number(21, 2)})", 0),
        ("card", groups(good, fours, dealt(10, ".", " ", "-")), 1), ("card", groups(bad, fours, dealt(10, ".", " ", "-")), 0), ("card", f"concat({groups(good, fours, repr('.'))}, '.', {number(25, 4)})", 0),
        ("phone", national, 1), ("phone", groups(line, (2, 3, 3), repr("-")), 0), ("phone", goes_on, 0),
        ("secret", f"concat({cue}, {key})", 1), ("secret", f"concat({cue}, {named})", 0), ("secret", f"concat({cue}, repeat({number(26, 1)}, 20))", 0),
    ]
    made = ", ".join(f"named_struct('kind', '{k}', 'value', {v}, 'y', {y}.0D)" for k, v, y in rows)
    texts = f"transform(array({made}), v -> named_struct('kind', v.kind, 'text', concat(before, ' ', v.value, ' ', after), 'start', char_length(before) + 1, 'end', char_length(before) + 1 + char_length(v.value), 'y', v.y))"
    cards = f"transform(array({check}), c -> named_struct('good', concat({payload}, c), 'bad', concat({payload}, pmod(c + 1 + pmod(xxhash64(9, h), 8), 10))))"
    drawn = f"array(named_struct('payload', {number(8, 15)}, 'hexes', sha2(concat('k', string(h)), 256), 'line', concat('2', {number(11, 9)})))"
    return F.expr(f"flatten(flatten(transform({drawn}, d -> transform({cards}, e -> {texts}))))")


def examples(docs: DataFrame, text: str) -> DataFrame:
    """kind, x, y, apart, n: the base matches of all texts and the candidates planted in a context of every text, counted; equal texts once. apart: kept from the trees."""
    t, s, p = F.col("t"), F.col("s"), F.col("p")
    rows = docs.select(quoted(text).alias("t")).where(t.isNotNull()).withColumn("h", F.xxhash64(F.lit(7), t))
    at = F.pmod(F.xxhash64(F.lit(8), "h"), F.greatest(F.char_length(t) - 48, F.lit(1))).cast("int")

    def moved(s: Column, by: Column) -> Column:
        return s.withField("start", s["start"] - by).withField("end", s["end"] - by)

    def near_by(spans: Column) -> Column:
        """Each span with the text that its features see, so that a text with many is not read anew for each."""

        def one(s: Column, parts: Column) -> Column:
            return let(F.greatest(s["start"] - 24, F.lit(0).cast("bigint")), lambda a: F.struct(between(parts, a, F.least(s["end"] + 2, F.char_length(t).cast("bigint"))).alias("t"), moved(s, a).alias("s")))

        return F.when(F.size(spans) > 0, let(chunks(t), lambda parts: F.transform(spans, lambda s: one(s, parts))))

    base = let(F.concat(*[_located(t, PATTERNS[k], NEEDS[k], k, True) for k in KINDS]), near_by)
    texts = rows.select("h", F.substring(t, at + 1, F.lit(24)).alias("before"), F.substring(t, at + 25, F.lit(24)).alias("after"), base.alias("base")).distinct()
    seen = texts.select("h", F.posexplode("base").alias("i", "b")).select("h", "i", F.col("b.t").alias("t"), F.col("b.s").alias("s")).withColumn("y", s["base"].cast("double"))
    made = texts.select("h", F.posexplode(planted()).alias("i", "p"))
    own = F.coalesce(*[F.when(p["kind"] == k, _located(p["text"], MORE[k], MORE_NEEDS[k], k, False)) for k in MORE])
    near = made.select("h", "i", p["text"].alias("t"), "p", F.explode(own).alias("s")).where((s["start"] < p["end"]) & (s["end"] > p["start"]))
    near = near.where((p["y"] == 0.0) | ((s["start"] == p["start"]) & (s["end"] == p["end"]))).select("h", "i", "t", "s", p["y"].alias("y"))

    def counted(of: DataFrame, salt: int) -> DataFrame:
        apart = F.pmod(F.xxhash64(F.lit(salt), "h", "i"), F.lit(3)) == 0
        return of.select(s["kind"].alias("kind"), F.expr(FEATURE_VECTOR).alias("x"), "y", apart.alias("apart"))

    return counted(seen, 27).union(counted(near, 28)).groupBy("kind", "x", "y", "apart").agg(F.count(F.lit(1)).alias("n"))


def _by_kind(of: dict[str, str]) -> str:
    return f"CASE kind {' '.join(f'WHEN {k!r} THEN {v}' for k, v in of.items())} END"


def _rounded(seen: DataFrame, cuts: int) -> DataFrame:
    """kind, x, y, n with each feature rounded up to quantiles of its values and of the examples; infinite above them."""
    at = F.array(*[F.lit(i / (cuts + 1)) for i in range(1, cuts + 1)])
    values = seen.select("kind", "n", F.posexplode("x").alias("j", "v")).groupBy("kind", "j", "v").agg(F.sum("n").alias("n"))
    cut: dict[str, dict[int, list[float]]] = defaultdict(dict)
    for r in values.groupBy("kind", "j").agg(F.concat(F.percentile("v", at), F.percentile("v", at, F.col("n"))).alias("of")).collect():
        # features are whole numbers
        cut[r["kind"]][r["j"]] = sorted({float(np.floor(v)) for v in r["of"]})
    if not cut:
        return seen.select("kind", "x", "y", "n")
    of = _by_kind({k: f"array({', '.join('array(' + ', '.join(f'{v!r}D' for v in js[j]) + ')' for j in sorted(js))})" for k, js in cut.items()})
    up = F.expr("transform(x, (v, j) -> coalesce(array_min(filter(cut[j], u -> u >= v)), double('Infinity')))")
    return seen.withColumn("cut", F.expr(of)).select("kind", up.alias("x"), "y", "n").groupBy("kind", "x", "y").agg(F.sum("n").alias("n"))


def _sums(seen: DataFrame, models: dict[str, Boosted], roots: dict[str, tuple[int, float]]) -> dict[tuple[str, int], Sums]:
    q = F.expr(_by_kind({k: m.sql("x") for k, m in models.items()}))
    node = F.expr(_by_kind({k: f"int(x[{j}] > {t!r}D)" for k, (j, t) in roots.items()})) if roots else F.lit(0)

    def whole(c: Column) -> Column:
        return F.round(c * UNIT).cast("bigint") * F.col("n")

    told = seen.where(F.col("kind").isin(list(roots or models))).select("kind", "x", "y", "n", q.alias("q"), node.alias("node"))
    told = told.select("kind", "node", "n", whole(F.col("y") - F.col("q")).alias("g"), whole(F.greatest(F.col("q") * (1 - F.col("q")), F.lit(1e-6))).alias("h"), F.posexplode("x").alias("j", "v"))
    out: dict[tuple[str, int], dict[int, list]] = defaultdict(lambda: defaultdict(list))
    for r in told.groupBy("kind", "node", "j", "v").agg(F.sum("n").alias("n"), F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
        out[r["kind"], r["node"]][r["j"]].append((r["v"], r["n"], r["g"] / UNIT, r["h"] / UNIT))
    return {k: [np.array(sorted(js[j])) for j in sorted(js)] for k, js in out.items()}


def learn(docs: DataFrame, precision: float = 0.98, text: str = "text") -> PiiModel:
    """Fit the trees of each kind on two thirds of the examples of the whole table and calibrate its threshold on the rest."""
    store = Store(docs.sparkSession)
    every = store.put("examples", examples(docs, text))
    score, y, n = F.col("score"), F.col("y"), F.col("n")
    total = {(r["kind"], r["apart"]): (r["n"], r["y"]) for r in every.groupBy("kind", "apart").agg(F.sum("n").alias("n"), F.sum(y * n).alias("y")).collect()}
    trees = {k: Boosted().start(*total.get((k, False), (0, 0.0))) for k in ALL_KINDS if (k, False) in total or (k, True) in total}
    seen = store.put("seen", _rounded(every.where("NOT apart"), Boosted().cuts))
    told = {k: m for k, m in trees.items() if 0 < total.get((k, False), (0, 0.0))[1] < total.get((k, False), (0, 0.0))[0]}
    if seen.count() > IN_MEMORY:
        grow(told, lambda roots: _sums(seen, told, roots))
    else:
        rows = seen.collect()
        for k, m in told.items():
            of = [r for r in rows if r["kind"] == k]
            m.grow_from(np.array([r["x"] for r in of]), np.array([r["y"] for r in of]), np.array([r["n"] for r in of]))
    thresholds, report = {}, {}
    if trees:
        scored = every.where("apart").select("kind", F.expr(_by_kind({k: m.sql("x") for k, m in trees.items()})).alias("score"), "y", "n").groupBy("kind", "score").agg(F.sum("n").alias("n"), F.sum(y * n).alias("y"))
        over = Window.partitionBy("kind").orderBy(score.desc()).rowsBetween(Window.unboundedPreceding, 0)
        good = scored.select("kind", "score", F.sum("n").over(over).alias("n"), F.sum("y").over(over).alias("y")).where((score > 0.5) & (y / n >= precision))
        for r in good.groupBy("kind").agg(F.min(F.struct("score", "n", "y")).alias("at")).collect():
            k, at = r["kind"], r["at"]
            count, positive = np.sum([total[k, a] for a in (False, True) if (k, a) in total], axis=0)
            if 0 < positive < count:
                thresholds[k] = float(at["score"])
                report[k] = (total[k, True][0], at["y"] / at["n"], at["y"] / total[k, True][1] if total[k, True][1] else 0.0)
    store.drop("examples")
    store.drop("seen")
    return PiiModel(trees, thresholds, report)


def _with_found(held: DataFrame, model: PiiModel) -> DataFrame:
    """held: row, t (not null). Adds found, the spans of t: valid base matches, and wider candidates that the trees select, sorted."""
    t = F.col("t")
    held = held.withColumn("own", F.filter(F.concat(*[_located(t, PATTERNS[k], NEEDS[k], k, True) for k in KINDS]), lambda s: s["base"]))
    if not model.thresholds:
        return held.select("row", "t", F.array_sort(F.array_distinct("own")).alias("found"))
    free = "filter(wide, s -> NOT exists(own, o -> o.start <= s.start AND o.end >= s.end))"
    held = held.withColumn("wide", F.concat(*_wide(t))).withColumn("scored", F.expr(f"transform({free}, s -> named_struct('span', s, 'x', {FEATURE_VECTOR}))"))
    over = " OR ".join(f"(r.span.kind = '{k}' AND {model.trees[k].sql('r.x')} >= {u - 1e-12!r}D)" for k, u in model.thresholds.items())
    found = F.expr(f"array_sort(array_distinct(concat(own, transform(filter(scored, r -> {over}), r -> r.span))))")
    return held.select("row", "t", found.alias("found"))


def find(docs: DataFrame, model: PiiModel, text: str = "text", spans: str = "spans") -> DataFrame:
    """All columns of docs and an array of spans (rank, start, end, kind, value, base), sorted by kind as listed and start."""
    return unpacked(_with_found(packed(docs, t=F.coalesce(quoted(text), F.lit(""))), model), docs.columns, **{spans: F.col("found")})


def digests(found: DataFrame, spans: str = "spans") -> DataFrame:
    base = F.filter(spans, lambda s: s["base"])

    def text_of(a: Column) -> Column:
        return F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text_of(base), 256).alias("base_sha256"), text_of(F.col(spans)).alias("spans"))


def redact(docs: DataFrame, model: PiiModel, text: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets; overlapping spans become one replacement."""
    held = _with_found(packed(docs, t=F.coalesce(quoted(text), F.lit(""))), model)
    by_start = F.array_sort(F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    new = replace_spans(F.col("t"), by_start, F.char_length("t").cast("bigint"))
    return unpacked(held, docs.columns, **{text: F.when(F.size("found") > 0, new).otherwise(F.col("row").getField(text))})
