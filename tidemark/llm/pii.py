"""Personal data: rule-based base spans plus candidates that boosted trees accept. DataFrame and SQL functions only.

Base spans follow four fixed patterns (e-mail, IPv4, card, phone), leftmost and non-overlapping per kind, and always
stay. High-recall generators then propose further, overlapping spans of the same kinds: e-mail addresses in brackets or
spoken (name at host dot org), IPv6 whole or shortened, cards with unusual separators or in groups of 4, 6 and 5,
national phone numbers. They are bounded: a name has up to 64 characters, a part of a domain up to 63, a domain up to
seven parts, as addresses have. Gradient-boosted trees score each candidate from its
format (digits, separators, Luhn sum, parts) and its context (words before it, neighbouring characters); per kind, a
calibrated threshold selects. A candidate that overlaps a base span is dropped.

The trees are learnt on the driver from examples that a rule makes up, whose features the same SQL computes; on the
main path they are CASE expressions, so whole texts never leave the JVM. Patterns use possessive repetition and fixed
starts, so very long runs neither recurse nor go quadratic.

Defined results: a null or empty text has no spans. Positions count code points, ends are exclusive. Repeated rows give
equal results; extra columns are ignored.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
#: Equivalent to the fixed patterns; the start conditions only skip places where no match can begin.
BASE = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain before the pattern is tried.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
IPV4 = rf"^{BYTE}(?:\.{BYTE}){{3}}$"
AT, DOT = r"\x20?(?:\(at\)|\[at\]|\{at\})\x20?", r"\x20?(?:\(dot\)|\[dot\]|\{dot\}|\.)\x20?"
CANDIDATES = {
    "email": rf"(?<![{LOCAL}])[{LOCAL}]{{1,64}}+(?:{AT}[A-Za-z0-9-]{{1,63}}+(?:{DOT}[A-Za-z0-9-]{{1,63}}+){{1,6}}|\x20at\x20[A-Za-z0-9-]{{1,63}}+(?:\x20dot\x20[A-Za-z0-9-]{{1,63}}+){{1,6}})",
    "ip": r"(?<![0-9A-Za-z:])(?:(?:[0-9A-Fa-f]{1,4}+:){7}[0-9A-Fa-f]{1,4}+|(?:[0-9A-Fa-f]{1,4}+:){1,6}+(?::[0-9A-Fa-f]{1,4}+){1,6}+)(?![0-9A-Za-z:])",
    "card": r"(?<![0-9][./])(?<![0-9])[0-9]{4}[./\x20_-]{1,2}(?:[0-9]{4}[./\x20_-]{1,2}[0-9]{4}[./\x20_-]{1,2}[0-9]{1,7}|[0-9]{6}[./\x20_-]{1,2}[0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9+])(?:00[0-9]{1,3}[\x20.-])?\(?[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{3}[\x20.-][0-9]{3,4}(?![0-9])",
}
WORDS = {
    "email": r"(?i)(?:mail|contact|write|reach)",
    "ip": r"(?i)(?:\bip\b|host|addr|server|client)",
    "card": r"(?i)(?:card|visa|credit|debit|account|payment)",
    "phone": r"(?i)(?:tel|phone|call|mobile|fax|cell)",
}
FEATURES = ("kind", "length", "digits", "distinct", "luhn", "separators", "parts", "word_before", "letter_before", "letter_after", "digit_before", "disguised", "zeros", "domain")
AROUND = 24
TREES, DEPTH, RATE = 24, 3, 0.3
#: Of made-up examples that the trees didn't see, this share of what is accepted must be right.
PRECISION = 0.98


def spans_of(text: Column, pattern: str, needs: str | None = None) -> Column:
    """Array of (start, end, found): leftmost non-overlapping matches with their places in code points.

    The text is cut in pieces of a gap and a match; lengths of what came before add up to the start.
    """
    whole = rf"(?s)(.*?)(?:({pattern})|\z)"
    gaps = F.regexp_extract_all(text, F.lit(whole), F.lit(1))
    hits = F.regexp_extract_all(text, F.lit(whole), F.lit(2))
    pieces = F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("size"), h.alias("found")))
    kind = "array<struct<start:int,end:int,found:string>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(state: Column, p: Column) -> Column:
        start = state["at"] + p["gap"]
        one = F.struct(start.alias("start"), (start + p["size"]).alias("end"), p["found"].alias("found"))
        return F.struct((start + p["size"]).alias("at"), F.when(p["size"] > 0, F.concat(state["out"], F.array(one))).otherwise(state["out"]).alias("out"))

    found = F.aggregate(pieces, zero, step, lambda s: s["out"])
    test = text.rlike(pattern)
    if needs:
        test = text.contains(needs) & test
    return F.when(test, found).otherwise(F.array().cast(kind))


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the sum of digits, every second one from the right doubled (less 9 above 9), ends in 0."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda x, i: _doubled(F.coalesce(x.try_cast("int"), F.lit(0)), i))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _doubled(x: Column, i: Column) -> Column:
    v = x * (1 + i % 2)
    return v - F.when(v > 9, 9).otherwise(0)


def base_spans(text: Column) -> dict[str, Column]:
    out = {}
    for kind in KINDS:
        found = spans_of(text, BASE[kind], NEEDS.get(kind))
        if kind == "ip":
            found = F.filter(found, lambda s: s["found"].rlike(IPV4))
        elif kind == "card":
            found = F.filter(found, lambda s: (F.length(digits_of(s["found"])) <= 19) & luhn(digits_of(s["found"])))
        elif kind == "phone":
            found = F.filter(found, lambda s: F.length(digits_of(s["found"])).between(9, 15))
        out[kind] = found
    return out


def features_of(text: Column, kind: str, s: Column) -> dict[str, Column]:
    """Format and context of a candidate, each as a number."""
    found = s["found"]
    digits = digits_of(found)
    before = F.substring(text, F.greatest(s["start"] - AROUND, F.lit(0)) + 1, F.least(s["start"], F.lit(AROUND)))
    last, after = F.right(before, F.lit(1)), F.substring(text, s["end"] + 1, F.lit(1))
    yes = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return {
        "kind": F.lit(float(KINDS.index(kind))),
        "length": F.length(found).cast("double"),
        "digits": F.length(digits).cast("double"),
        "distinct": F.size(F.array_distinct(F.split(digits, ""))).cast("double"),
        "luhn": yes((F.length(digits) >= 12) & luhn(digits)),
        "separators": F.length(F.regexp_replace(found, r"[0-9A-Za-z]", "")).cast("double"),
        "parts": F.size(F.split(found, r"[^0-9A-Za-z]+")).cast("double"),
        "word_before": yes(before.rlike(WORDS[kind])),
        "letter_before": yes(last.rlike("[A-Za-z]")),
        "letter_after": yes(after.rlike("[A-Za-z]")),
        "digit_before": yes(before.rlike(r"[0-9][^A-Za-z]{0,2}$")),
        "disguised": yes(found.rlike(r"[(\[{](?:at|dot)[)\]}]")),
        "zeros": yes(digits.rlike("0000")),
        "domain": yes(found.rlike(r"(?i)[^a-z](?:com|org|net|edu|gov|info|io|co|eu|uk|de|fr|es|it|nl|at|ch)$")),
    }


@dataclass
class Tree:
    feature: int = -1
    cut: float = 0.0
    low: Tree | None = None
    high: Tree | None = None
    value: float = 0.0

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.low is None:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] < self.cut, self.low.predict(x), self.high.predict(x))

    def column(self, of: dict[str, Column]) -> Column:
        if self.low is None:
            return F.lit(float(self.value))
        return F.when(of[FEATURES[self.feature]] < F.lit(float(self.cut)), self.low.column(of)).otherwise(self.high.column(of))


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: float = 4.0, ridge: float = 1.0) -> Tree:
    """A regression tree for second-order boosting: cuts where squared gradient sums gain most."""
    leaf = Tree(value=float(-g.sum() / (h.sum() + ridge)))
    if not depth:
        return leaf
    best, gain = None, 1e-6
    whole = g.sum() ** 2 / (h.sum() + ridge)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, gs, hs = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
        at = np.flatnonzero(v[1:] > v[:-1])
        if not len(at):
            continue
        left = gs[at] ** 2 / (hs[at] + ridge)
        right = (gs[-1] - gs[at]) ** 2 / (hs[-1] - hs[at] + ridge)
        won = np.where((at + 1 >= least) & (len(v) - at - 1 >= least), left + right - whole, -1)
        k = int(np.argmax(won))
        if won[k] > gain:
            gain, best = won[k], (f, (v[at[k]] + v[at[k] + 1]) / 2)
    if best is None:
        return leaf
    low = x[:, best[0]] < best[1]
    return Tree(best[0], float(best[1]), grow(x[low], g[low], h[low], depth - 1), grow(x[~low], g[~low], h[~low], depth - 1))


@dataclass
class Forest:
    trees: list[Tree] = field(default_factory=list)
    start: float = 0.0
    cuts: dict[str, float] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> np.ndarray:
        v = self.start + RATE * sum((t.predict(x) for t in self.trees), np.zeros(len(x)))
        return 1 / (1 + np.exp(-v))

    def accepts(self, kind: str, of: dict[str, Column]) -> Column:
        """Whether the logit reaches the kind's threshold."""
        total = reduce(lambda a, b: a + b, [t.column(of) for t in self.trees], F.lit(0.0)) * RATE + self.start
        p = min(max(self.cuts[kind], 1e-6), 1 - 1e-6)
        return total >= float(np.log(p / (1 - p)))


def made_up(rng: random.Random, n: int = 900) -> list[tuple[str, str, int]]:
    """(text, kind, label): for every kind, things of that format that are personal and things that only look so."""
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9)))
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    out = []
    for _ in range(n):
        a, b, c, d = word(), word(), word(), word()
        at, dot = rng.choice(["(at)", "[at]", " [at] ", " (at) ", "{at}"]), rng.choice(["(dot)", "[dot]", ".", " [dot] ", " (dot) "])
        lead = rng.choice(["mail", "contact", "write to", a, b])
        out.append((f"{a} {lead} {b}.{num(1)}{at}{c}{dot}{rng.choice(['com', 'org', 'net', 'de'])} {d}", "email", 1))
        out.append((f"{a} {b}(at){num(2)}.{num(1)} {c}", "email", 0))
        out.append((f"{a} {lead} {b} at {c} dot {rng.choice(['com', 'org', 'net', 'de', 'fr', 'co dot uk'])} {d}", "email", 1))
        out.append((f"{a} {b} at {c} dot {rng.choice([d, word()])} {word()}", "email", 0))
        hexes = ":".join("%x" % rng.getrandbits(rng.choice((4, 8, 16))) for _ in range(8))
        out.append((f"{a} {rng.choice(['host', 'ip', b])} {hexes} {c}", "ip", 1))
        out.append((f"{a} {':'.join(num(2) for _ in range(8))} {c}", "ip", 0))
        left, right = (["%x" % rng.getrandbits(rng.choice((4, 8, 16))) for _ in range(rng.randint(1, 3))] for _ in range(2))
        left = [rng.choice(["fe80", "2001", "2a02", left[0]]), *left[1:]]
        out.append((f"{a} {rng.choice(['host', 'ip', 'addr', 'server', b])} {':'.join(left)}::{':'.join(right)} {c}", "ip", int(any(x.isdigit() for x in "".join(left + right)))))
        out.append((f"{a} {''.join(rng.choice('abcdef') for _ in range(rng.randint(1, 4)))}::{''.join(rng.choice('abcdef') for _ in range(rng.randint(1, 4)))} {c}", "ip", 0))
        sep = rng.choice([".", "/", "_", "  "])
        card = [rng.randint(0, 9) for _ in range(15)]
        odd = sum(v * 2 - 9 * (v * 2 > 9) if i % 2 == 0 else v for i, v in enumerate(card))
        good = "".join(map(str, card)) + str(-odd % 10)
        group = lambda s: sep.join(s[i : i + 4] for i in range(0, 16, 4))  # noqa: B023, E731
        out.append((f"{a} {rng.choice(['card', 'visa', b, c])} {group(good)} {d}", "card", 1))
        out.append((f"{a} {b} {group(good[:-1] + str((int(good[-1]) + rng.randint(1, 9)) % 10))} {d}", "card", 0))
        short = [3, rng.choice((4, 7)), *(rng.randint(0, 9) for _ in range(12))]
        tail = -sum(v * 2 - 9 * (v * 2 > 9) if i % 2 else v for i, v in enumerate(short)) % 10
        amex = "".join(map(str, short))
        shape = lambda s: f"{s[:4]}{sep}{s[4:10]}{sep}{s[10:]}"  # noqa: B023, E731
        out.append((f"{a} {rng.choice(['card', 'amex', b, c])} {shape(amex + str(tail))} {d}", "card", 1))
        out.append((f"{a} {b} {shape(amex + str((tail + rng.randint(1, 9)) % 10))} {d}", "card", 0))
        phone = rng.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}"]).format(num(3), num(3), num(4))
        out.append((f"{a} {rng.choice(['tel', 'phone', 'call', 'mobile:'])} {phone} {b}", "phone", 1))
        out.append((f"{a} {rng.choice([num(3) + ' ', num(2) + '-', b + ' '])}{num(3)} {num(3)} {num(3)} {c}", "phone", 0))
        out.append((f"{a} {rng.choice(['version', 'no', b])} {num(2)}.{num(3)}.{num(3)} {c}", "phone", 0))
    return out


@lru_cache(maxsize=1)
def _learnt(features: tuple[tuple[float, ...], ...], labels: tuple[int, ...]) -> Forest:
    x, y = np.array(features), np.array(labels, float)
    seen = np.arange(len(y)) % 3 > 0
    forest = Forest(start=float(np.log(y[seen].mean() / (1 - y[seen].mean()))))
    for _ in range(TREES):
        p = forest.predict(x[seen])
        forest.trees.append(grow(x[seen], p - y[seen], p * (1 - p), DEPTH))
    p, truth, kinds = forest.predict(x[~seen]), y[~seen], x[~seen, 0]
    for k, kind in enumerate(KINDS):
        q, t = p[kinds == k], truth[kinds == k]
        order = np.argsort(-q)
        right = np.cumsum(t[order]) / np.arange(1, len(q) + 1)
        last = np.append(q[order][1:] < q[order][:-1], True)  # equal scores are accepted together
        fine = np.flatnonzero((right >= PRECISION) & last)
        forest.cuts[kind] = max(0.5, float(q[order][fine[-1]])) if len(fine) else 1.0
    return forest


def learn(spark: SparkSession) -> Forest:
    """Trees from made-up examples; their features come from the SQL that the main path uses."""
    rows = made_up(random.Random(11))
    made = spark.createDataFrame(rows, "text string, kind string, label int")
    parts = []
    for kind in KINDS:
        mine = made.where(F.col("kind") == kind).withColumn("s", F.explode(spans_of(F.col("text"), CANDIDATES[kind])))
        parts.append(mine.select("text", "label", *(v.cast("double").alias(k) for k, v in features_of(F.col("text"), kind, F.col("s")).items())))
    got = sorted(tuple(r) for r in reduce(DataFrame.unionAll, parts).collect())
    return _learnt(tuple(r[2:] for r in got), tuple(r[1] for r in got))


def overlaps(s: Column, others: Column) -> Column:
    return F.exists(others, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))


def find_spans(docs: DataFrame, forest: Forest | None = None, text_col: str = "text", base_col: str = "base", spans_col: str = "spans") -> DataFrame:
    """``docs`` plus arrays of (start, rank, end, kind): the base spans and all spans, each in order."""
    forest = forest or learn(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = base_spans(text)

    def ranked(found: Column, kind: str) -> Column:
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    out = docs.withColumn(base_col, F.array_sort(F.concat(*(ranked(base[k], k) for k in KINDS))))

    def selected(kind: str) -> Column:
        """Features are computed once a candidate; the trees then read them by name."""
        seen = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), *(v.alias(k) for k, v in features_of(text, kind, s).items()))
        accepted = lambda s: ~overlaps(s, F.col(base_col)) & forest.accepts(kind, {k: s[k] for k in FEATURES})
        return ranked(F.filter(F.transform(spans_of(text, CANDIDATES[kind]), seen), accepted), kind)

    more = [selected(kind) for kind in KINDS]
    return out.withColumn(spans_col, F.array_sort(F.concat(F.col(base_col), *more)))


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest_documents(docs: DataFrame, forest: Forest | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    found = find_spans(docs.select(F.col(id_col), F.col(text_col)), forest, text_col, "_base", "_spans")
    number = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long")
    counts = [number(k).alias(f"n_{k}") for k in KINDS]
    return found.select(F.col(id_col), *counts, F.sha2(written(F.col("_base")), 256).alias("base_sha256"), written(F.col("_spans")).alias("spans"))


def redact(docs: DataFrame, forest: Forest | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets; overlapping spans become one."""
    names = docs.columns
    found = find_spans(docs, forest, text_col, "_pii_base", "_pii_spans")
    text = F.col(text_col)
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        mark = F.when(s["start"] >= state["at"], F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], gap, mark).alias("out"))

    rest = lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text)))
    clean = F.when(F.size("_pii_spans") > 0, F.aggregate(F.col("_pii_spans"), zero, step, rest)).otherwise(text)
    return found.withColumn(text_col, clean).select(*names)
