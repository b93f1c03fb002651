"""Matches against aligning all pairs, the recall of the candidate search, and odd audio."""

import numpy as np

from tidemark.llm import chroma


def test_alignment_finds_offsets():
    rng = np.random.default_rng(1)
    whole = np.concatenate([chroma.tones()[k] for k in rng.integers(0, 36, 24)])
    a, b = (chroma.fingerprint(chroma.to_wav(x, 4000)) for x in (whole, whole[chroma.HOP * 40 :]))
    offset, errors = chroma.align(a, b)
    assert offset == 40 and errors < 0.02
    other = np.concatenate([chroma.tones()[k] for k in rng.integers(0, 36, 24)])
    got = chroma.align(a, chroma.fingerprint(chroma.to_wav(other, 4000)))
    assert got is None or got[1] > chroma.MOST_ERRORS


def test_search_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(150):
        v = rng.standard_normal(64) if k % 3 else rng.standard_normal(64) * 0.05 + np.sin(np.arange(64) * (1 + k % 2))
        rows.append((k, [float(x) for x in v]))
    rows += [(150, rows[0][1]), (200, None), (250, []), (250, rows[50][1])]
    media = chroma.render(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    prints = [(r["vec_id"], chroma.fingerprint(r["audio"])) for r in media]
    got = chroma.search(spark.createDataFrame(media, "vec_id long, audio binary"), "id % 50 = 0", "vec_id").collect()
    assert len(got) == sum(k % 50 == 0 for k, _ in rows)
    want = found = 0
    for k, f in prints:
        if k % 50 == 0 and f is not None:
            n = -1
            for _, g in prints:
                x = chroma.align(f, g) if g is not None else None
                n += bool(x and x[1] <= chroma.MOST_ERRORS)
            mine = [r for r in got if r["vec_id"] == k and r["n_frames"] == len(f)][0]
            want, found = want + n, found + mine["n_matches"]
            assert mine["n_matches"] <= n
            assert (mine["match_id"] is None) == (mine["n_matches"] == 0)
    assert found >= 0.9 * want > 0
    assert [r["n_matches"] for r in got if r["vec_id"] == 200] == [0]


def test_odd_audio():
    for data in (None, b"", b"RIFFxxxx", chroma.to_wav(np.zeros(9000), 4000), chroma.to_wav(np.ones(20), 4000)):
        assert chroma.fingerprint(data) is None


def test_noisy_clips_of_long_recordings(spark):
    """Every partial overlap that aligning all pairs finds is found; no exact twins are among these."""
    rng = np.random.default_rng(11)
    songs = [np.concatenate([chroma.tones()[k] for k in rng.integers(0, 36, 900)]) for _ in range(3)]
    rows = [(1000 + k, bytearray(chroma.to_wav(x, 4000))) for k, x in enumerate(songs)]
    for k in range(24):
        at = int(rng.integers(0, len(songs[0]) - 40_000))
        clip = songs[k % 3][at : at + (40_000 if k % 2 else 6_000)]
        rows.append((k, bytearray(chroma.to_wav(clip + rng.standard_normal(len(clip)) * 0.004, 4000))))
    prints = {k: chroma.fingerprint(bytes(x)) for k, x in rows}
    want = {}
    for k in range(24):
        met = {m: x for m, g in prints.items() if m != k and (x := chroma.align(prints[k], g)) and x[1] <= chroma.MOST_ERRORS}
        want[k] = (len(met), min(((x[1], m, x[0]) for m, x in met.items()), default=(None, None, None)))
    assert sum(n > 0 and best[1] >= 1000 for n, best in want.values()) >= 15
    got = chroma.search(spark.createDataFrame(rows, "id long, audio binary"), "id < 1000").collect()
    assert {r["id"]: (r["n_matches"], (r["bit_errors"], r["match_id"], r["offset"])) for r in got} == want


def test_index_aligns_as_pairs_do(monkeypatch):
    rng = np.random.default_rng(12)
    whole = rng.integers(-40, 40, 3000).astype(np.int32)
    prints = [whole[a : a + n] for a, n in ((0, 400), (300, 2000), (50, 21), (9, 3), (2500, 500))] + [np.full(300, 7, np.int32)]
    want = {(k, j): x for j, b in enumerate(prints) for k, a in enumerate(prints) if (x := chroma.align(a, b)) and x[1] <= chroma.MOST_ERRORS}
    for votes in (1 << 21, 100):
        monkeypatch.setattr(chroma, "VOTES", votes)
        index = chroma.Index(prints)
        assert {(k, j): (o, e) for j, b in enumerate(prints) for k, o, e in zip(*(x.tolist() for x in index.meet(b)))} == want
