"""Toxicity by compression distance.

Two zstandard dictionaries are compared. Both begin with a part that is trained on ordinary text; the second part of each
is trained on the text of its own class, reduced to what sets that class apart (runs of five-letter sequences that its
documents have far more often than those of the other class), and the shorter of the two is filled with bytes that no
text has, so that both are searched alike. A document is cut into windows of two lengths, each covering all of it: single
words, set in a run of spaces so that a block is always worth compressing, and overlapping windows of ten words. Each is
compressed with either dictionary, and the difference of the two lengths is how much nearer it is to toxic text. A
logistic function of the differences' maxima, means and counts above thresholds is calibrated on labelled documents that
the dictionaries weren't trained on, weighted to the labels' true shares.

Learning takes at most ``PER_CLASS`` rows a class, and of these as many as ``SAMPLE_CHARS`` characters hold (documented
bounds on rows; a row that is learnt from is read whole); scoring reads whole texts of all rows.

Defined results: a null or empty text has no window and scores as a text without any difference; without labels of
both classes every score is the share of toxic labels (0 without labels). Repeated rows score alike; extra columns are
kept, and one of the score column's name gives way to the score.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import partial
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SAMPLE_CHARS, batches, held_out, training_sample, with_score

PER_CLASS = 1500
THRESHOLD = 0.5
WORDS, STEP = 10, 8
LONGEST_WORD = 64
GRAM = 5
#: A sequence is toxic if this share of toxic documents has it, and so many times the share that ordinary ones have.
SHARE, TIMES, LEAST = 0.02, 20, 2
ORDINARY_BYTES, OWN_BYTES = 57_344, 4096
EDGES = (1, 2, 3, 4, 5, 6, 8)
MARKS = ".,;:!?()[]|\"'*#%&$"
#: What a word is set in.
FRAME = b" " * 24
KEPT_WORDS = 200_000
#: Bytes that a match has at least, and texts that are compared at once.
MATCH = 5
TOGETHER = 200


def lowered_words(text: str) -> list[bytes]:
    out = []
    for w in text.lower().encode("utf-8", "replace").split():
        if len(w) <= LONGEST_WORD:
            out.append(w)
        else:
            out += [w[i : i + LONGEST_WORD] for i in range(0, len(w), LONGEST_WORD)]
    return out


def windows(text: str) -> list[bytes]:
    """Overlapping windows of words, together the whole text."""
    w = lowered_words(text)
    if not w:
        return []
    return [b" " + b" ".join(w[i : i + WORDS]) + b" " for i in range(0, max(1, len(w) - WORDS + STEP), STEP)]


def padded_words(text: str) -> set[str]:
    return {f" {w.strip(MARKS)} " for w in text.lower().split() if len(w) <= LONGEST_WORD}


def grams(word: str) -> set[str]:
    return {word[i : i + GRAM] for i in range(len(word) - GRAM + 1)}


def spans(word: str, keys: set[str]) -> list[str]:
    """Longest runs of a word whose five-letter sequences are all keys."""
    out, start = [], None
    for i in range(len(word) - GRAM + 2):
        hit = i <= len(word) - GRAM and word[i : i + GRAM] in keys
        if hit and start is None:
            start = i
        elif not hit and start is not None:
            out.append(word[start : i - 1 + GRAM])
            start = None
    return out


def runs_of(data: bytes) -> set[bytes]:
    """Sequences as long as a match must be, with three bytes at least that aren't spaces."""
    return {x for x in (data[i : i + MATCH] for i in range(len(data) - MATCH + 1)) if MATCH - x.count(b" ") >= 3}


class Pair:
    """Both compressors, and the words compared so far; the store starts anew when full.

    The dictionaries differ in their second parts only, so a word that has no run in common with them is as long with
    either and isn't compressed.
    """

    def __init__(self, ordinary, toxic, runs: set[bytes]) -> None:
        self.ordinary, self.toxic, self.runs = ordinary, toxic, runs
        self.codes = np.array(sorted(int.from_bytes(x, "little") for x in runs), np.uint64)
        self.begins = np.zeros(1 << 16, bool)
        self.begins[self.codes & np.uint64(0xFFFF)] = True
        self.known: dict[bytes, int] = {}

    def compared(self, pieces: list[bytes]) -> np.ndarray:
        if not pieces:
            return np.zeros(0, np.int64)
        a, b = (np.fromiter((len(x) for x in c.multi_compress_to_buffer(pieces, threads=1)), np.int64, len(pieces)) for c in (self.ordinary, self.toxic))
        return a - b

    def sharing(self, words: list[bytes], step: int = 20_000) -> np.ndarray:
        """Which words have a run in common with the second parts; between two words there are spaces enough that no run spans them."""
        if not words or not len(self.codes):
            return np.zeros(len(words), bool)
        if len(words) > step:
            return np.concatenate([self.sharing(words[i : i + step], step) for i in range(0, len(words), step)])
        flat = np.frombuffer(b"".join(b"  " + w + b"  " for w in words) + b" " * MATCH, np.uint8).astype(np.uint64)
        code = sum(flat[i : len(flat) - MATCH + 1 + i] << np.uint64(8 * i) for i in range(MATCH))
        near = np.flatnonzero(self.begins[code & np.uint64(0xFFFF)])
        found = np.searchsorted(self.codes, code[near])
        hit = np.zeros(len(code), bool)
        hit[near] = self.codes[np.minimum(found, len(self.codes) - 1)] == code[near]
        ends = np.cumsum([len(w) + 4 for w in words])
        return np.add.reduceat(hit.astype(np.int32), np.r_[0, ends[:-1]]) > 0

    def words(self, texts: list[str]) -> list[np.ndarray]:
        """Of each text: the differences of its distinct words."""
        own = [list(set(lowered_words(t))) for t in texts]
        fresh = list({w for ws in own for w in ws if w not in self.known})
        if len(self.known) + len(fresh) > KEPT_WORDS:
            self.known, fresh = {}, list({w for ws in own for w in ws})
        apart = list(compress(fresh, self.sharing(fresh)))
        self.known.update(dict.fromkeys(fresh, 0))
        self.known.update(zip(apart, self.compared([FRAME + w + FRAME for w in apart]).tolist()))
        return [np.fromiter(map(self.known.__getitem__, ws), np.int64, len(ws)) if ws else np.zeros(1, np.int64) for ws in own]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    base: int  # bytes that both begin with
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    constant: float | None = None

    def pair(self) -> Pair:
        import zstandard as z

        made = []
        for content in (self.ordinary, self.toxic):
            settings = z.ZstdCompressionParameters.from_level(
                5, min_match=MATCH, window_log=18, hash_log=18, chain_log=18, search_log=4, strategy=z.STRATEGY_LAZY, format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False
            )
            # Without the entropy tables a match in a short block saves more bytes, so that it shows.
            d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=settings)
            made.append(z.ZstdCompressor(dict_data=d, compression_params=settings))
        return Pair(*made, runs_of(self.ordinary[self.base :]) | runs_of(self.toxic[self.base :]))

    def differences(self, texts: list[str], made: Pair | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each text: of its distinct words, and of its windows."""
        made = made or self.pair()
        cut = [windows(t) for t in texts]
        of_words = made.words(texts)
        flat, sizes = [w for ws in cut for w in ws], [len(ws) for ws in cut]
        d = made.compared(flat)
        ends = np.cumsum(sizes)
        return [(w, d[hi - n : hi] if n else np.zeros(1, np.int64)) for w, n, hi in zip(of_words, sizes, ends)]

    def score(self, texts: list[str], made: Pair | None = None) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        made = made or self.pair()
        x = np.array([features(d) for i in range(0, len(texts), TOGETHER) for d in self.differences(texts[i : i + TOGETHER], made)])
        return logistic(np.c_[(x - self.mean) / self.scale, np.ones(len(x))] @ self.weights) if len(x) else np.zeros(0)


def logistic(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


def features(d: tuple[np.ndarray, np.ndarray]) -> list[float]:
    out = []
    for x in d:
        x = np.sort(x)[::-1]
        above = [int((x >= k).sum()) for k in EDGES]
        out += [x[0], x[:2].mean(), x[:4].mean(), x.mean(), np.log(len(x)), *np.log1p(above), *(k / len(x) for k in above)]
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted ridge logistic regression by Newton's steps: means, scales, weights."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    penalty = np.diag(np.r_[np.full(x.shape[1], ridge), 1e-6])
    for _ in range(40):
        p = logistic(z @ w)
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + penalty, z.T @ (weight * (p - y)) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def train(sample: list[tuple[str, int]], toxic_share: float) -> Model:
    """Dictionaries from every second document of a class, calibration from the others."""
    toxic = [t for t, y in sample if y == 1]
    ordinary = [t for t, y in sample if y == 0]
    if len(toxic) < 2 or len(ordinary) < 2:
        return Model(b"", b"", 0, np.zeros(1), np.ones(1), np.zeros(1), constant=float(toxic_share))
    base = ordinary_dictionary(ordinary[::2])
    parts = [own_part(ordinary[::2], toxic[::2]), own_part(toxic[::2], ordinary[::2])]
    longest = max(map(len, parts))
    inert = np.random.default_rng(0).integers(0, 9, longest).astype(np.uint8).tobytes()
    model = Model(*(base + inert[: longest - len(p)] + p for p in parts), len(base), np.zeros(1), np.ones(1), np.zeros(1))
    rest = [(t, 1) for t in toxic[1::2]] + [(t, 0) for t in ordinary[1::2]]
    y = np.array([k for _, k in rest], float)
    pair = model.pair()
    x = np.array([features(d) for i in range(0, len(rest), TOGETHER) for d in model.differences([t for t, _ in rest[i : i + TOGETHER]], pair)])
    share = min(max(toxic_share, 1e-4), 1 - 1e-4)
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    model.mean, model.scale, model.weights = fit_logistic(x, y, weight)
    return model


def own_part(mine: list[str], others: list[str]) -> bytes:
    """A dictionary trained on the texts of one class, reduced to the spans that set it apart; plain where they are too few to train on."""
    import zstandard as z

    have, other = Counter(), Counter()
    for counter, texts in ((have, mine), (other, others)):
        for t in texts:
            counter.update({g for w in padded_words(t) for g in grams(w)})
    n, m = len(mine), len(others)
    keys = {g for g, c in have.items() if c >= max(LEAST, SHARE * n) and c / n > TIMES * (other[g] + 0.1) / m}
    each = [sorted({s for w in padded_words(t) for s in spans(w, keys)}) for t in mine]
    samples = ["   ".join(found).encode() for found in each if found]
    try:
        return z.train_dictionary(OWN_BYTES, samples, k=32, d=6).as_bytes()
    except z.ZstdError:
        found = Counter(s for x in each for s in x)
        return b"".join(s.encode() for s in sorted(found, key=lambda s: (found[s], s)))[-OWN_BYTES:]


def ordinary_dictionary(texts: list[str]) -> bytes:
    """A trained dictionary, or plain text where there is too little to train one."""
    import zstandard as z

    pieces = []
    for t in texts:
        w = lowered_words(t)
        pieces += [b" " + b" ".join(w[i : i + 4]) + b" " for i in range(0, len(w), 4)]
    try:
        return z.train_dictionary(ORDINARY_BYTES, pieces, k=64, d=6).as_bytes()
    except z.ZstdError:
        return b"".join(pieces)[:ORDINARY_BYTES] or b" "


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, sample_chars: int = SAMPLE_CHARS) -> Model:
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
    share = known.agg(F.avg(F.col(label).cast("double")).alias("p")).first()["p"]
    return train(training_sample(docs, labels, label, per_class, sample_chars), share or 0.0)


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` plus a score from 0 to 1."""
    return with_score(docs, lambda: model.score if model.constant is not None else partial(model.score, made=model.pair()), text_col, score_col)
