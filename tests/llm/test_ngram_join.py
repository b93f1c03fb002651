"""Classes of linked copies against comparing every pair, with short lists and long ones."""

import random
import re

from tidemark.llm import ngram_join as nj


def brute(rows, size=3, percent=90):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(k, least.get(find(i), k))
    return sorted((k, len(sets[i]), least[find(i)]) for i, (k, _) in enumerate(rows))


def corpus(n=260, seed=3):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz") + str(rng.randint(0, 30))
    hot = [word() for _ in range(90)]
    rows = []
    for k in range(n):
        if k % 3:
            w = list(hot)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
                w[rng.randrange(len(w))] = word()
        else:
            w = [word() for _ in range(rng.randint(0, 60))]
        rows.append((k, " ".join(w)))
    rows += [(n, None), (n + 1, ""), (n + 2, "\t \n"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "one two"), (n + 6, rows[0][1].upper()), (n + 7, "é É"), (n + 8, " ".join(["w"] * 5000)), (n + 8, rows[1][1])]
    return rows


def test_classes_are_those_of_all_pairs(spark, monkeypatch):
    """With lists above 64 entries as shipped, and blocks of 16, so that every way is taken."""
    assert nj.LIST == 64
    monkeypatch.setattr(nj, "BLOCK", 16)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, nj.near_copies(docs).collect()))
    assert got == brute(rows)


def test_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (None, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"] or -1), r["n_shingles"], r["component_id"]) for r in nj.near_copies(docs).collect())
    assert got == [(-1, 0, None), (-1, 2, None), (4, 2, 4)]
    assert nj.near_copies(docs.limit(0)).count() == 0


def test_links_at_the_threshold_in_long_lists(spark):
    """Pivot 1 and node 3 are each exactly a tenth from 2, and two tenths from each other."""
    whole = list(range(100))
    nodes = {1: whole[10:], 2: whole, 3: whole[:90]}
    long = spark.createDataFrame([(k, 50, 9 if k == 1 else 5) for k in nodes], "sig long, token long, count int")
    sets = spark.createDataFrame(list(nodes.items()), "sig long, tokens array<long>")
    got = {tuple(sorted(r)) for r in nj.group_links(long, sets, 90).collect()}
    assert got == {(1, 2), (2, 3)}


def test_components_with_hot_nodes(spark, monkeypatch):
    from tidemark.llm import components

    monkeypatch.setattr(components, "HOT", 3)
    star = [(5, k) for k in range(10, 40)]
    chain = [(k, k + 1) for k in range(100, 130)]
    edges = spark.createDataFrame([*star, *chain, (39, 5), (7, 7), (40, 39)], "a long, b long")
    got = dict(map(tuple, components.connected(edges).collect()))
    assert got == {5: 5} | {k: 5 for k in range(10, 41)} | {k: 100 for k in range(100, 131)}
    assert components.connected(edges.limit(0)).count() == 0


def test_a_crowded_group_is_not_dealt_to_all_its_blocks(spark, monkeypatch):
    """300 sets as far from their head as one another, in families: each goes through shuffles a few times only."""
    from .test_near_vectors import shuffled

    monkeypatch.setattr(nj, "BLOCK", 8)
    rng = random.Random(4)
    base = [rng.getrandbits(62) for _ in range(200)]
    nodes = {0: base}
    for family in range(10):
        other = base[18:] + [rng.getrandbits(62) for _ in range(18)]
        for k in range(30):
            nodes[len(nodes)] = other[: 200 - k % 4] + [rng.getrandbits(62) for _ in range(k % 4)]
    long = spark.createDataFrame([(k, 50, 9 if k == 0 else 5) for k in nodes], "sig long, token long, count int")
    sets = spark.createDataFrame(list(nodes.items()), "sig long, tokens array<long>").localCheckpoint()
    began = shuffled(spark, "shuffleWriteRecords")
    edges = nj.group_links(long, sets, 90).collect()
    assert shuffled(spark, "shuffleWriteRecords") - began <= 15 * len(nodes)
    forest = nj.Forest()
    for a, b in edges:
        x, y = set(nodes[a]), set(nodes[b])
        assert len(x & y) * 100 >= len(x | y) * 90
        forest.add(a, b)
    assert [forest.find(k) for k in nodes] == [0] + [1 + 30 * f for f in range(10) for _ in range(30)]
