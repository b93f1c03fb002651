"""Encoding against the tokenizers library, packing against its rules and a lower bound, WARC and classifiers on odd input."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe, packing, quality, toxicity, warc

WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
LETTERS = [*"abcdeiou tnrsTH'İßſΣςéàÉ日本́̈​\x1c\x85\t\n0123½²!?.,-#<|>", "<|endoftext|>", "<|startoftext|>", "the", "'re", " ", "  ", "ǅ", "𝐀", "ﬁ", "\x00"]


def texts(n=4000, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["", "a" * 30_000, "the " * 5000, "\n \nx", "a   b", "x \n y ", " x"]


def test_words_are_the_librarys():
    lib, mine = Tokenizer.from_file(WORD), bpe.SpeculativeBpe(WORD)
    for t, (n, ids, back) in zip(texts(), mine.texts(texts())):
        want = lib.encode(t, add_special_tokens=False).ids
        assert (n, ids, back) == (len(want), " ".join(map(str, want)), lib.decode(want, skip_special_tokens=False))


def test_bytes_are_the_librarys():
    lib, mine = Tokenizer.from_file(BYTE), packing.CachedTokenizer(BYTE)
    for t, got in zip(texts(), mine.texts(texts())):
        assert got == np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_digests_of_rows(spark):
    rows = [(1, "Hello world"), (1, "Hello world"), (2, None), (None, "")]
    got = Counter(tuple(r) for r in bpe.digest_documents(spark.createDataFrame(rows, "doc_id long, text string"), WORD).collect())
    nothing = hashlib.sha256(b"").hexdigest()
    assert got[(2, 0, nothing, nothing)] == 1 and got[(None, 0, nothing, nothing)] == 1 and max(got.values()) == 2


@pytest.mark.parametrize("seed", range(4))
def test_plans_hold_every_piece(seed):
    rng = random.Random(seed)
    h = Counter(rng.choice([rng.randint(1, 2048), rng.randint(1, 200), 2048, 700]) for _ in range(rng.choice([1, 50, 3000, 20_000])))
    runs = packing.plan_runs(h)
    got = Counter()
    for r in runs:
        assert sum(a * b for a, b in r.items) + r.gap == 2048 and r.gap >= 0
        for a, b in r.items:
            got[a] += b * r.n
    assert got == h
    plain: list[packing.Run] = []
    packing.best_fit(plain, dict(h), 2048)  # best-fit decreasing over single pieces
    assert sum(r.n for r in runs) <= sum(r.n for r in plain) * 1.005 + 2
    assert packing.plan_runs({}) == []


def test_packed_rows(spark):
    rows = [(k, "word " * (k * 40)) for k in range(80)] + [(5, None), (None, ""), (7, "x"), (7, "x")]
    lib = Tokenizer.from_file(BYTE)
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), BYTE).collect()
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    pieces = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got)
    want = Counter()
    for k, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(min(first, len(ids)), len(ids) + 1, 2048)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(k, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert pieces == want
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), BYTE).count() == 0


def test_warc_round_trip(spark):
    long = "é" * 40_000
    rows = [(1, "u\nv", "a" * 1000), (3, None, "a" * 1000), (2, "u", "a" * 1000), (3, None, "a" * 1000), (4, "w", long), (4, "w", long), (5, "w", "a" * 999), (6, "w", "a" * 999), (7, "w", None), (None, "w", long)]
    got = sorted(((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.page_digests(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()), key=str)
    want = []
    best = {"a" * 1000: 3, long: 4}
    for k, _, h in rows:
        raw = (h or "").encode()
        other = best.get(h) if len(raw) >= 1000 and k != best.get(h) else None
        want.append((k or 0, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if other else "response", other))
    assert got == sorted(want, key=str)


def test_broken_records_are_told():
    for body in (b"", b"5\r\nab", b"zz\r\n", b"1\r\nabc\r\n0\r\n\r\n", b"-1\r\n"):
        with pytest.raises(warc.BrokenRecord):
            warc.unframed(body)
    assert warc.unframed(warc.framed(b"x" * 9000)) == b"x" * 9000 and warc.unframed(b"3;a=b\r\nabc\r\n0\r\nT: x\r\n\r\n") == b"abc"
    with pytest.raises(warc.BrokenRecord):
        warc.joined([(1, b"a"), (3, b"b")], 2)
    with pytest.raises(warc.BrokenRecord):
        warc.joined([(1, b"a"), (2, b"b")], 3)


def test_classifiers_on_held_out_rows(spark):
    path = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    from tidemark.llm.common import held_out

    fold = docs.select("doc_id", "text").join(labels, "doc_id").where(held_out(docs["doc_id"])).collect()
    for module, label, least in ((toxicity, "toxic", 0.93), (quality, "quality", 0.94)):
        model = module.fit(docs, labels)
        p = model.score([r["text"] or "" for r in fold])
        right = np.mean((p >= module.THRESHOLD) == np.array([r[label] for r in fold]))
        assert right >= least, (label, right)
        assert ((model.score(["", "x" * 200_000]) >= 0) & (model.score(["", "y"]) <= 1)).all()


def test_classifiers_without_labels_and_with_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "s"), (1, None, "s"), (None, "text", None)], "doc_id long, text string, score_ string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for module in (toxicity, quality):
        out = module.score_documents(docs, module.fit(docs, labels))
        assert out.columns == ["doc_id", "text", "score_", "score"] and out.count() == 3
        assert module.score_documents(docs.limit(0), module.fit(docs, labels)).count() == 0


def test_foreign_records(spark):
    payload = b"hello"
    sha = hashlib.sha1(payload)
    info = warc.record("warcinfo", "urn:i", "", b"software: x\r\n")
    plain = warc.record("resource", "urn:r", "u", payload, ("WARC-Payload-Digest", "sha1:" + sha.hexdigest()))
    other = warc.record("response", "urn:o", "u", b"HTTP/1.1 200 OK\r\n\r\n" + payload, ("WARC-Payload-Digest", "md5:abc"))
    again = warc.record("revisit", "urn:v", "u", b"", ("WARC-Refers-To", "<urn:o>"))
    data = spark.createDataFrame([(info + plain,), (other + again,), (b"",), (None,)], "data binary")
    got = {r["record_id"]: (r["kind"], r["refers"], r["digest"], r["payload_bytes"], r["payload"]) for r in warc.reassemble(warc.read_records(data)).collect()}
    assert got == {"urn:i": ("warcinfo", None, None, 13, b"software: x\r\n"), "urn:r": ("resource", None, sha.hexdigest(), 5, payload), "urn:o": ("response", None, None, 5, payload), "urn:v": ("revisit", "urn:o", None, None, None)}


def test_convolution_by_plain_formulas():
    """Scores against loops over chunks, and the training gradient's effect: the loss on its own sample falls."""
    rng = random.Random(2)
    sample = [("good text of words " * rng.randint(1, 9) + rng.choice("abc"), 1) for _ in range(30)] + [("@@ 77 ## " * rng.randint(1, 9) + rng.choice("abc"), 0) for _ in range(30)]
    model = quality.train(sample, 0.5, epochs=6)
    for text in ["", "x", "good text @@ 77", "é" * 500, "word " * 3000]:
        codes, _ = quality.coded([text.encode()])
        pooled = []
        for k in range(len(codes) - 1):
            x = np.concatenate([model.embed[c] for c in [*codes[k], *codes[k + 1]]]).astype(float)
            pooled.append(x @ np.concatenate([model.first, model.second]).astype(float) + model.bias)
        top, low = np.max(pooled, 0), np.min(pooled, 0)
        h = np.tanh(np.tanh(np.r_[top, -low]) @ model.mix + model.mix_bias)
        assert abs(1 / (1 + np.exp(-(h @ model.out + model.out_bias))) - model.score([text])[0]) < 1e-4
    p = model.score([t for t, _ in sample])
    assert np.mean((p >= 0.5) == np.array([y for _, y in sample])) >= 0.95


def test_compression_windows_by_plain_calls():
    """Differences against compressing each window by itself; words and windows cover the whole text."""
    rng = random.Random(3)
    words = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    text = lambda bad: " ".join(rng.choice(words) if rng.random() > 0.1 * bad else rng.choice(["moronic", "scumbag"]) for _ in range(60))
    sample = [(text(1), 1) for _ in range(80)] + [(text(0), 0) for _ in range(80)]
    model = toxicity.train(sample, 0.5)
    pair = model.pair()
    t = text(1) + " " + "z" * 200
    of_words, of_windows = model.differences([t], pair)[0]
    size = lambda c, b: len(c.compress(b))
    cut = toxicity.windows(t)
    assert b"".join(cut).count(b"z" * 64) >= 3
    assert of_windows.tolist() == [size(pair.ordinary, w) - size(pair.toxic, w) for w in cut]
    frame = toxicity.FRAME
    shared = lambda w: any((b"  " + w + b"  ")[i : i + 5] in pair.runs for i in range(len(w)))
    assert sorted(of_words.tolist()) == sorted((size(pair.ordinary, frame + w + frame) - size(pair.toxic, frame + w + frame)) * shared(w) for w in set(toxicity.lowered_words(t)))
    fresh = [(text(1), 1) for _ in range(40)] + [(text(0), 0) for _ in range(40)]
    p = model.score([x for x, _ in fresh])
    assert np.mean((p >= 0.5) == np.array([y for _, y in fresh])) >= 0.95


def test_a_score_column_gives_way(spark):
    docs = spark.createDataFrame([(1, "a", "old")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for module in (toxicity, quality):
        out = module.score_documents(docs, module.fit(docs, labels))
        assert out.dtypes == [("doc_id", "bigint"), ("text", "string"), ("score", "double")]


def test_words_over_line_ends_are_put_together_from_parts():
    """Only parts that are new are encoded, a store's misses as one text; ids are the library's."""
    tok = packing.CachedTokenizer(BYTE)
    texts = [f"begin {a}.\n{b}, été!\nПривет; {a}, {b}. {a}'s.\n{b} x\n\ny {b}.\n" for a in ("one", "two", "Three") for b in ("four", "five", "six")]
    want = [np.array(e.ids, "<u4").tobytes() for e in tok.tok.encode_batch(texts, add_special_tokens=False)]
    asked = []

    class Spy:
        def encode_batch_fast(self, some, **how):
            asked.extend(some)
            return lib.encode_batch_fast(some, **how)

    lib, tok.tok = tok.tok, Spy()
    assert list(tok.texts(texts)) == want
    assert not any(x.strip(" \n").startswith(("one.\n", "two.\n", "Three.\n")) for x in asked)
    assert len(asked) <= len(texts) + 20 and not any(packing.LINES.fullmatch(w) for w in tok.words)
