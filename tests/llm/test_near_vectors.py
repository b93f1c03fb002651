"""Links of vectors against all pairs, with a cell large enough to be cut."""

import numpy as np

from tidemark.llm import near_vectors as nv


def brute(rows, cosine=0.95):
    ok = [i for i, (_, v) in enumerate(rows) if nv.usable(v)]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ok:
        for j in ok:
            if j < i and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                    n[i] += 1
                    n[j] += 1
                    root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(k, least.get(find(i), k))
    return sorted((k, n[i], least[find(i)], k == least[find(i)]) for i, (k, _) in enumerate(rows))


def test_links_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(nv, "CELL", 40)
    rng = np.random.default_rng(2)
    f = lambda v: [float(x) for x in np.asarray(v, np.float32)]
    hot = rng.standard_normal(32)
    rows = [(k, f(rng.standard_normal(32))) for k in range(60)]
    rows += [(100 + k, f(hot + rng.standard_normal(32) * rng.choice([0.05, 0.2, 0.35]))) for k in range(140)]
    rows += [(300, None), (301, []), (302, [0.0] * 32), (303, [float("nan")] * 32), (304, [None] * 32), (305, [1.0, 2.0]), (306, [2.0, 4.0]), (307, rows[0][1]), (307, rows[0][1]), (308, f(np.array(rows[1][1]) * 1e-30))]
    got = sorted(map(tuple, nv.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)).collect()))
    assert got == brute(rows)


def test_null_ids_and_empty_tables(spark):
    t = spark.createDataFrame([(None, [1.0, 0.0]), (5, [1.0, 0.1])], "vec_id long, embedding array<float>")
    got = sorted(((r["vec_id"] or -1), r["n_links"], r["component_id"], r["kept"]) for r in nv.near_vectors(t).collect())
    assert got == [(-1, 1, None, False), (5, 1, 5, True)]
    assert nv.near_vectors(t.limit(0)).count() == 0


def test_copies_are_one_node(spark):
    """Equal vectors meet as one row, so their links are counted without pairs."""
    rows = [(k, [1.0, 0.5, 0.0]) for k in range(300)] + [(500 + k, [1.0, 0.55, 0.0]) for k in range(20)] + [(900, [0.0, 0.0, 1.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nv.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)).collect()}
    assert got[0] == got[299] == (319, 0) and got[510] == (319, 0) and got[900] == (0, 900)


def shuffled(spark, what="shuffleWriteBytes"):
    """Bytes, or records, that all stages so far wrote to shuffles."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(getattr(stages.apply(i), what)() for i in range(stages.size()))


def test_a_vector_is_dealt_a_few_times_only(spark, monkeypatch):
    """What goes through shuffles is a small multiple of the vectors, with as many links as all pairs have."""
    monkeypatch.setattr(nv, "CELL", 30)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 64))
    x[:200] = x[0] + rng.standard_normal((200, 64)) * rng.choice([0.05, 0.15, 0.25], (200, 1))
    x = x.astype(np.float32)
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(5).localCheckpoint()
    began = shuffled(spark)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nv.near_vectors(table).collect()}
    assert shuffled(spark) - began <= 4 * x.nbytes
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = y @ y.T >= 0.95
    assert [got[k][0] for k in range(1500)] == (near.sum(1) - 1).tolist() and near.sum() > 3000
    assert all(got[k][1] == k for k in range(200, 1500))
