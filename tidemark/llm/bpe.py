"""BPE encoding and decoding by speculation and verification.

A text is cut at white space, and a word that was met before isn't encoded again. For new words:

1. *Speculate*: greedy longest match against the vocabulary proposes tokens, word by word.
2. *Verify*: numpy tests every adjacent pair of all proposals at once. Two tokens are compatible if no merge across
   their border happens while both are built. Greedy tokens that are all valid and pairwise compatible are what
   merging gives (merging is local: a tokenisation is the merged one exactly if each of its adjacent pairs is).
3. Only words with a failing pair are merged exactly, pair by pair in order of rank.

Defined results: a null text counts as empty; an empty text has no tokens and decodes to an empty text. Repeated rows
and null ids pass through. Columns other than the two named ones are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches

#: Words that a worker keeps; beyond it the store starts anew. It bounds memory, not results.
KEPT_WORDS = 600_000
#: White space as Unicode's property has it; Python's own idea also takes in four control characters.
SPACES = regex.compile(r"\p{White_Space}+")
ODD = re.compile("[\x1c-\x1f]")
FAR = np.int64(1) << 60


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    spare = iter(range(0x100, 0x200))
    return [out[b] if b in out else chr(next(spare)) for b in range(256)]


class SpeculativeBpe:
    """Encoder and decoder for a ``tokenizers`` file of lower-cased words with an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.added.items()}
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.pattern = regex.compile(pattern)
        self.letters = byte_letters()
        size = max(self.names) + 1
        self.left = np.zeros(size, np.int64)
        self.right = np.zeros(size, np.int64)
        self.rank = np.full(size, -1, np.int64)
        pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            x, y, made = self.vocab[a], self.vocab[b], self.vocab[a + b]
            pairs.setdefault((x, y), (rank, made))
            if self.rank[made] < 0:
                self.left[made], self.right[made], self.rank[made] = x, y, rank
        self.size = size
        keys = np.fromiter((x * size + y for x, y in pairs), np.int64, len(pairs))
        ranks = np.fromiter((r for r, _ in pairs.values()), np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys, self.key_ranks = keys[order], ranks[order]
        self.made = np.fromiter((m for _, m in pairs.values()), np.int64, len(pairs))[order]
        self.usable = self._usable()
        self.greedy = {s: i for s, i in self.vocab.items() if self.usable[i]}
        self.longest = max(map(len, self.greedy), default=0)
        self.ids_of: dict[str, str] = {}
        self.names_of: dict[str, str] = {}

    def pair_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, FAR where there is none."""
        key = x * self.size + y
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        if not len(self.keys):
            return np.full(len(x), FAR)
        return np.where(self.keys[at] == key, self.key_ranks[at], FAR)

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether merging leaves the border between tokens a and b alone (before the rank ``until``, if given).

        Going back in time: x is the right end of a, y the left end of b; whichever was made last is taken apart.
        x ends at the rank that swallows it, y likewise. Of equal ranks the left one comes first, so a merge
        across the border must come before x ends, but may tie with y's end.
        """
        x, y = a.copy(), b.copy()
        ends_x = np.full(len(x), FAR) if until is None else until.copy()
        ends_y = ends_x.copy()
        fine = np.ones(len(x), bool)
        on = np.arange(len(x))
        while len(on):
            xs, ys = x[on], y[on]
            cross = self.pair_rank(xs, ys)
            broken = (cross < ends_x[on]) & (cross <= ends_y[on])
            fine[on[broken]] = False
            on = on[~broken]
            if not len(on):
                break
            xs, ys = x[on], y[on]
            rx, ry = self.rank[xs], self.rank[ys]
            back_x = rx > ry
            back_y = ~back_x & (ry >= 0)
            i, j = on[back_x], on[back_y]
            ends_x[i], x[i] = self.rank[x[i]], self.right[x[i]]
            ends_y[j], y[j] = self.rank[y[j]], self.left[y[j]]
            on = on[back_x | back_y]
        return fine

    def _usable(self) -> np.ndarray:
        """Tokens that merging their own characters gives; greedy matching proposes no others."""
        merged = np.flatnonzero(self.rank >= 0)
        good = np.ones(self.size, bool)
        whole = self.compatible(self.left[merged], self.right[merged], self.rank[merged])
        good[merged] = whole
        for t in merged[np.argsort(self.rank[merged])]:
            good[t] &= good[self.left[t]] & good[self.right[t]]
        return good

    def exact(self, words: list[list[int]]) -> list[list[int]]:
        """Merging by rank, leftmost first, of many words of base tokens side by side."""
        done: list[list[int]] = [[] for _ in words]
        flat = np.fromiter((t for w in words for t in w), np.int64)
        owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        while len(flat):
            rank = np.full(len(flat), FAR)
            rank[:-1] = np.where(owner[:-1] == owner[1:], self.pair_rank(flat[:-1], flat[1:]), FAR)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            size = np.diff(np.r_[first, len(flat)])
            least = np.minimum.reduceat(rank, first)
            for k in np.flatnonzero(least == FAR):
                done[owner[first[k]]] = flat[first[k] : first[k] + size[k]].tolist()
            on = np.repeat(least < FAR, size)
            hit = on & (rank == np.repeat(least, size))
            at = np.flatnonzero(hit)
            if len(at) > 1 and (np.diff(at) == 1).any():  # a run of equal tokens: every second pair from the left
                run = np.cumsum(np.r_[True, np.diff(at) != 1])
                since = at - at[np.flatnonzero(np.r_[True, run[1:] != run[:-1]])][run - 1]
                at = at[since % 2 == 0]
            flat[at] = self.made[np.searchsorted(self.keys, flat[at] * self.size + flat[at + 1])] if len(at) else 0
            on[at + 1] = False
            flat, owner = flat[on], owner[on]
        return done

    def propose(self, word: str) -> list[int] | None:
        """Greedy longest match over a word's characters and its end; None if a character is unknown."""
        out, i, n = [], 0, len(word)
        get, longest, suffix = self.greedy.get, self.longest, self.suffix
        while i < n:
            found = get(word[i:] + suffix) if n - i <= longest else None
            if found is not None:
                out.append(found)
                break
            for j in range(min(n - 1, i + longest), i, -1):
                found = get(word[i:j])
                if found is not None:
                    out.append(found)
                    i = j
                    break
            else:
                return None
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Tokens of words that are already in the vocabulary's characters."""
        got = [self.propose(w) for w in words]
        flat = np.fromiter((t for g in got if g for t in g), np.int64)
        sizes = np.fromiter((len(g) if g else 0 for g in got), np.int64, len(got))
        owner = np.repeat(np.arange(len(got)), sizes)
        bad = np.fromiter((g is None for g in got), bool, len(got))
        if len(flat) > 1:
            inside = owner[:-1] == owner[1:]
            key = (flat[:-1] * self.size + flat[1:])[inside]
            once, where = np.unique(key, return_inverse=True)
            fine = self.compatible(once // self.size, once % self.size)[where]
            bad[owner[:-1][inside][~fine]] = True
        failing = np.flatnonzero(bad).tolist()
        base = [[self.vocab[c] for c in (*words[i][:-1], words[i][-1] + self.suffix)] for i in failing]
        for i, ids in zip(failing, self.exact(base)):
            got[i] = ids
        return got

    def split(self, piece: str) -> list[str]:
        """The vocabulary's spelling of the words of a piece without white space."""
        if not piece.isascii():
            piece = "".join(c.lower() for c in unicodedata.normalize("NFC", piece))
        else:
            piece = piece.lower()
        letters = self.letters
        return [
            w if w.isascii() and w.isprintable() else "".join(letters[b] for b in w.encode("utf-8"))
            for w in self.pattern.findall(piece)
        ]

    def learn(self, pieces: list[str]) -> None:
        """Fill the store of pieces with their ids and their tokens' names, each joined by spaces."""
        parts = [self.split(p) for p in pieces]
        once = list(dict.fromkeys(w for ws in parts for w in ws))
        names = self.names
        known = {w: (" ".join(map(str, ids)), " ".join([names[t] for t in ids])) for w, ids in zip(once, self.encode_words(once))}
        for p, ws in zip(pieces, parts):
            if len(ws) == 1:
                self.ids_of[p], self.names_of[p] = known[ws[0]]
            else:
                self.ids_of[p] = " ".join([known[w][0] for w in ws])
                self.names_of[p] = " ".join([known[w][1] for w in ws])

    def texts(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Of each text: number of tokens, decimal ids joined by spaces, decoded text."""
        cut: list[list[str]] = []
        seen: set[str] = set()
        for t in texts:
            if any(m in t for m in self.added):
                pieces = self._around_marks(t)
            elif ODD.search(t):
                pieces = [p for p in SPACES.split(t) if p]
            else:
                pieces = t.split()
            cut.append(pieces)
            seen.update(pieces)
        fresh = seen.difference(self.ids_of)
        if len(self.ids_of) + len(fresh) > KEPT_WORDS:
            self.ids_of, self.names_of, fresh = {}, {}, seen
        if fresh:
            self.learn([p for p in fresh if p not in self.added])
            for m in fresh & self.added.keys():
                self.ids_of[m], self.names_of[m] = str(self.added[m]), m
        ids_of, names_of = self.ids_of.__getitem__, self.names_of.__getitem__
        for pieces in cut:
            ids = " ".join(map(ids_of, pieces))
            yield (ids.count(" ") + 1 if ids else 0), ids, " ".join(map(names_of, pieces))

    def _around_marks(self, text: str) -> list[str]:
        """Special tokens in a text stand for themselves; what is between them is cut at white space."""
        out = []
        for part in regex.split("(" + "|".join(regex.escape(m) for m in sorted(self.added, key=len, reverse=True)) + ")", text):
            out += [part] if part in self.added else [p for p in SPACES.split(part) if p]
        return out

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in next(self.texts([text]))[1].split()]

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder, so tokens are joined by one space."""
        return " ".join(self.names[i] for i in ids if i in self.names)


_LOADED: dict[str, SpeculativeBpe] = {}


def loaded(path: str) -> SpeculativeBpe:
    if path not in _LOADED:
        _LOADED[path] = SpeculativeBpe(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, the ids as decimal text, the decoded text and the number of tokens."""
    return _mapped(docs, path, id_col, text_col, False)


def digest_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, the number of tokens, and SHA-256 of the ids' decimals and of the decoded text."""
    return _mapped(docs, path, id_col, text_col, True)


def _mapped(docs: DataFrame, path: str, id_col: str, text_col: str, digest: bool) -> DataFrame:
    batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        keep = sha if digest else (lambda s: s)
        for batch in them:
            n, ids, back = [], [], []
            for k, a, b in bpe.texts(batch.column("text").to_pylist()):
                n.append(k)
                ids.append(keep(a))
                back.append(keep(b))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                names=["id", "n_tokens", "ids", "decoded"],
            )

    out = rows.mapInArrow(run, f"id {kind}, n_tokens long, ids string, decoded string")
    names = ("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded")
    return out.select(F.col("id").alias(id_col), "n_tokens", F.col("ids").alias(names[0]), F.col("decoded").alias(names[1]))
