"""The base rules against a plain regular-expression version, positions in code points, and the trees' choices."""

import hashlib
import random
import re

from tidemark.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        t += v - 9 * (v > 9)
    return t % 10 == 0


def fits(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 9 <= len(d) <= 15


def brute(text):
    out = []
    for k, kind in enumerate(PLAIN):
        out += [(m.start(), k, m.end(), kind) for m in re.finditer(PLAIN[kind], text or "") if fits(kind, m.group())]
    return sorted(out)


def texts():
    rng = random.Random(5)
    bits = ["a@b.co", "x@y", "@", "+1 (017) 555-7713", "+12", "4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0255.1.1.1", " ", " ", "-", ".", "é", "𝐀", "\n", "77", "5", "+", "(", ")", "a.b%x@y.z-w.q", "_", "0000", "123456789012345678901", "9 9 9 9 9 9 9 9 9 9 9 9 9"]
    return [None, "", "a" * 50_000 + "@", "1 " * 20_000, "1" * 30_000, "+" * 3000, "a@b.c@d.e", "a@b.c%x@y.z.w"] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(1500)]


def test_base_spans_are_those_of_the_plain_patterns(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in pii.digest_documents(docs).collect()}
    for i, t in enumerate(texts()):
        want = brute(t)
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in want).encode()).hexdigest()
        assert got[i]["base_sha256"] == digest, (t or "")[:80]
        assert [got[i][f"n_{k}"] for k in PLAIN] == [sum(s[3] == k for s in want) for k in PLAIN]
        assert {f"{k}:{a}:{b}" for a, _, b, k in want} <= set(got[i]["spans"].split(","))


def test_trees_add_disguised_addresses_and_leave_look_alikes(spark):
    rows = [(1, "please mail jane.doe [at] example [dot] org today"), (2, "the version 10.123.456 was fine"), (3, "call 212 555 0199 now"), (4, "nothing here at all"), (5, "host fe80:1:2:3:4:5:6:7 is up")]
    got = {r["doc_id"]: r["spans"] for r in pii.digest_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == "email:12:43"
    assert got[2] == got[4] == ""
    assert got[3] == "phone:5:17"
    assert got[5] == "ip:5:23"


def test_redaction_and_odd_tables(spark):
    docs = spark.createDataFrame([(1, "é a@b.co, 1.2.3.4!", "k"), (1, None, "k"), (None, "+49 170 1234567", "k")], "doc_id long, text string, spans string")
    got = sorted((r["doc_id"] or 0, r["text"] or "", r["spans"]) for r in pii.redact(docs).collect())
    assert got == [(0, "[phone]", "k"), (1, "", "k"), (1, "é [email], [ip]!", "k")]
    assert pii.digest_documents(docs.limit(0)).count() == 0


def test_trees_on_examples_of_another_seed(spark):
    """What they add is right and most of what there is to add, kind by kind."""
    rows = [(k, *row) for k, row in enumerate(pii.made_up(random.Random(99), 60))]
    found = {r["doc_id"]: r["spans"] for r in pii.digest_documents(spark.createDataFrame([(k, text) for k, text, _, _ in rows], "doc_id long, text string")).collect()}
    for kind in pii.KINDS:
        hits = [(f"{kind}:" in found[k], label) for k, _, of, label in rows if of == kind]
        accepted = [label for hit, label in hits if hit]
        assert sum(accepted) >= 0.95 * len(accepted), kind
        assert sum(accepted) >= 0.8 * sum(label for _, label in hits), kind


def test_trees_in_sql_are_the_trees(spark):
    forest = pii.learn(spark)
    docs = spark.createDataFrame([(t, kind) for t, kind, _ in pii.made_up(random.Random(4), 20)], "text string, kind string")
    import numpy as np
    from pyspark.sql import functions as F

    for kind in pii.KINDS:
        mine = docs.where(F.col("kind") == kind).withColumn("s", F.explode(pii.spans_of(F.col("text"), pii.CANDIDATES[kind])))
        of = pii.features_of(F.col("text"), kind, F.col("s"))
        got = mine.select(forest.accepts(kind, of).alias("yes"), *(c.alias(k) for k, c in of.items())).collect()
        p = forest.predict(np.array([[float(r[k]) for k in pii.FEATURES] for r in got]))
        assert [r["yes"] for r in got] == [bool(x >= forest.cuts[kind]) for x in p]


def test_further_generators(spark):
    rows = [(1, "write to jane at example dot org today"), (2, "look at this dot here"), (3, "card 3782 822463 10005 ok"), (4, "host fe80::1:22 is up"), (5, "use std::vector and add::bad")]
    got = {r["doc_id"]: r["spans"] for r in pii.digest_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == "email:9:32" and got[2] == "" and got[3] == "card:5:22" and got[4] == "ip:5:15" and got[5] == ""
