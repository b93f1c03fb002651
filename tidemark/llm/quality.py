"""Quality by a byte-level convolutional network in numpy.

Bytes are embedded; learned filters run over chunks of ``CHUNK`` bytes that overlap by half and cover the whole
document; the strongest response of each filter and of its opposite is kept (two max-pools, so that texts with little
variety stand out); a small layer combines them into one probability. Training follows the gradient through the chunk
that won each pool.

Learning takes at most ``PER_CLASS`` rows a class, and of these as many as ``SAMPLE_CHARS`` characters hold (documented
bounds on rows; a row that is learnt from is read whole); scoring reads whole texts of all rows, in a memory that a
batch's texts bound.

Defined results: a null or empty text is scored as one chunk of padding; without labels of both classes every score is
the share of good labels (1 without labels). Repeated rows score alike; extra columns are kept, and one of
the score column's name gives way to the score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SAMPLE_CHARS, held_out, training_sample, with_score

PER_CLASS = 900
THRESHOLD = 0.3
STRIDE = 8
CHUNK = 2 * STRIDE
WIDTH = 8
FILTERS = 32
HIDDEN = 24
EPOCHS = 24
#: Bytes of text whose responses are held at once.
AT_ONCE = 1 << 18


@dataclass
class Model:
    embed: np.ndarray  # 256 + 1 by WIDTH, the last row for padding
    first: np.ndarray  # of the filters' halves: STRIDE * WIDTH by FILTERS
    second: np.ndarray
    bias: np.ndarray
    mix: np.ndarray  # 2 * FILTERS by HIDDEN
    mix_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    constant: float | None = None

    def responses(self, codes: np.ndarray) -> np.ndarray:
        """Of each chunk: codes has STRIDE bytes a row; a chunk is a row and the next."""
        x = self.embed[codes].reshape(len(codes), -1)
        r = x[:-1] @ self.first
        r += x[1:] @ self.second
        r += self.bias
        return r

    def pooled(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Highest and lowest response of each filter, the chunks they come from, and all codes."""
        codes, starts = coded(texts)
        r = self.responses(codes)
        top = np.full((len(texts), FILTERS), -np.inf, np.float32)
        low = -top
        where_top = np.zeros((len(texts), FILTERS), np.int64)
        where_low = where_top.copy()
        for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(codes)])):
            part = r[a : b - 1]
            where_top[i], where_low[i] = a + part.argmax(0), a + part.argmin(0)
            top[i], low[i] = part.max(0), part.min(0)
        return top, low, where_top, where_low, codes

    def score(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        raw = [t.encode("utf-8", "replace") for t in texts]
        out = np.empty(len(raw))
        lo = 0
        while lo < len(raw):
            hi, size = lo, 0
            while hi < len(raw) and (hi == lo or size + len(raw[hi]) <= AT_ONCE):
                size += len(raw[hi])
                hi += 1
            out[lo:hi] = self._score(raw[lo:hi])
            lo = hi
        return out

    def _score(self, raw: list[bytes]) -> np.ndarray:
        codes, starts = coded(raw)
        top = np.empty((len(raw), FILTERS), np.float32)
        low = np.empty_like(top)
        if len(raw) == 1 and len(codes) > AT_ONCE // STRIDE:  # a very long text, piece by piece
            step = AT_ONCE // STRIDE
            parts = [self.responses(codes[a : a + step + 1]) for a in range(0, len(codes) - 1, step)]
            top[0], low[0] = np.max([p.max(0) for p in parts], 0), np.min([p.min(0) for p in parts], 0)
        else:
            r = self.responses(codes)
            ends = np.append(starts[1:], len(codes)) - 1  # the last row of a text is padding and starts no chunk
            cut = np.stack([starts, ends], 1).ravel()[: 2 * len(starts) - 1]
            top[:] = np.maximum.reduceat(r, cut)[::2]
            low[:] = np.minimum.reduceat(r, cut)[::2]
        return self.combine(top, low)[0].astype(float)

    def combine(self, top: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.tanh(np.concatenate([top, -low], 1))
        h = np.tanh(x @ self.mix + self.mix_bias)
        return 1 / (1 + np.exp(-np.clip(h @ self.out + self.out_bias, -30, 30))), h, x


def coded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in rows of STRIDE, each text padded to whole rows and one more; the texts' first rows."""
    rows = np.array([max(1, -(-len(t) // STRIDE)) + 1 for t in texts])
    starts = np.r_[0, np.cumsum(rows)[:-1]]
    flat = np.full(int(rows.sum()) * STRIDE, 256, np.int16)
    for t, a in zip(texts, starts):
        flat[a * STRIDE : a * STRIDE + len(t)] = np.frombuffer(t, np.uint8)
    return flat.reshape(-1, STRIDE), starts


def train(sample: list[tuple[str, int]], good_share: float, epochs: int = EPOCHS, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    f32 = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
    half = STRIDE * WIDTH
    model = Model(f32(257, WIDTH, by=0.5), f32(half, FILTERS, by=0.08), f32(half, FILTERS, by=0.08), np.zeros(FILTERS, np.float32), f32(2 * FILTERS, HIDDEN, by=0.15), np.zeros(HIDDEN, np.float32), f32(HIDDEN, by=0.2), 0.0)
    y = np.array([k for _, k in sample], np.float32)
    if not len(sample) or y.min() == y.max():
        model.constant = float(good_share)
        return model
    share = min(max(good_share, 1e-3), 1 - 1e-3)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())).astype(np.float32)
    raw = [t.encode("utf-8", "replace") for t, _ in sample]
    names = ("embed", "first", "second", "bias", "mix", "mix_bias", "out", "out_bias")
    first_moment = {k: 0.0 for k in names}
    second_moment = {k: 0.0 for k in names}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(raw))
        rate = 0.004 * (0.5 + 0.5 * np.cos(np.pi * epoch / epochs)) + 1e-5
        for lo in range(0, len(order), 32):
            some = order[lo : lo + 32]
            top, low, at_top, at_low, codes = model.pooled([raw[i] for i in some])
            p, h, x = model.combine(top, low)
            d = weight[some] * (p - y[some]) / len(some)
            dh = np.outer(d, model.out) * (1 - h * h)
            dx = (dh @ model.mix.T) * (1 - x * x)
            g = {"out": h.T @ d, "out_bias": d.sum(), "mix": x.T @ dh, "mix_bias": dh.sum(0)}
            g["first"], g["second"] = np.zeros_like(model.first), np.zeros_like(model.second)
            g["embed"] = np.zeros_like(model.embed)
            dr = np.concatenate([dx[:, :FILTERS], -dx[:, FILTERS:]], 0)  # of the winning chunks
            at = np.concatenate([at_top, at_low], 0)
            g["bias"] = dr.sum(0)
            for name, shift in (("first", 0), ("second", 1)):
                bytes_at = codes[at + shift]  # documents, filters, STRIDE
                seen = model.embed[bytes_at].reshape(*at.shape, half)
                g[name] = np.einsum("df,dfk->kf", dr, seen)
                back = (dr[:, :, None] * getattr(model, name).T[None]).reshape(-1, WIDTH)
                flat = bytes_at.ravel()
                for k in range(WIDTH):
                    g["embed"][:, k] += np.bincount(flat, back[:, k], minlength=257)
            step += 1
            for k in names:
                first_moment[k] = 0.9 * first_moment[k] + 0.1 * g[k]
                second_moment[k] = 0.999 * second_moment[k] + 0.001 * g[k] ** 2
                move = rate * (first_moment[k] / (1 - 0.9**step)) / (np.sqrt(second_moment[k] / (1 - 0.999**step)) + 1e-8)
                setattr(model, k, (getattr(model, k) - move).astype(np.float32) if k != "out_bias" else float(model.out_bias - move))
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, sample_chars: int = SAMPLE_CHARS) -> Model:
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
    share = known.agg(F.avg(F.col(label).cast("double")).alias("p")).first()["p"]
    return train(training_sample(docs, labels, label, per_class, sample_chars), 1.0 if share is None else share)


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` plus a score from 0 to 1."""
    return with_score(docs, lambda: model.score, text_col, score_col)
