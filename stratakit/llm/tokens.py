"""Token counts by rank-synchronous array merging.

Texts are cut into pre-tokens by the byte-level pattern; distinct pre-tokens lie in one ragged array of symbol ids.
Each round finds every sequence's lowest-rank adjacent pair and merges it in all sequences at once, until no
sequence has a known pair; the symbols that survive are the tokens.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import _common as C

#: Fixed value: the pre-token pattern of byte-level BPE vocabularies.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space with the run of other characters after it; no pre-token crosses from such a run into white space. A run of
#: common letters and the punctuation behind it are two pieces, as between these there always is a boundary (the
#: apostrophe isn't among the punctuation). So texts can be cut into pieces that are counted once each.
#: \x1c-\x1f are white space for Python only: texts with them aren't cut.
PIECE = re.compile(r"\s*[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+(?=[!#$%&()*+,\-./:;<=>?@]*(?:\s|\Z))|[!#$%&()*+,\-./:;<=>?@]+(?=\s|\Z)|\s*\S+|\s+")
ODD = re.compile(r"[\x1c-\x1f]")


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte: itself if it is printable Latin-1, else the next one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class RankMerger:
    """A byte-level BPE vocabulary read from a tokenizers .json file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        if spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE vocabularies are read")
        self.specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        self.pattern = regex.compile(PRETOKEN)
        self.base = np.zeros(256, dtype=np.int64)
        for b, s in byte_symbols().items():
            self.base[b] = vocab[s]
        self.size = 1 + max(vocab.values())
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        rank_of = dict(zip(self.made.tolist(), range(len(pairs)), strict=True))
        self.byte_ranks = self.rank(np.repeat(self.base, 256), np.tile(self.base, 256)).reshape(256, 256)
        # merging all places of a pair at once equals merging them one by one if what a merge makes only takes part in later ones
        if any(rank_of.get(vocab[x], -1) >= r for r, pair in enumerate(pairs) for x in pair):
            raise ValueError("merges out of order")

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or one past the last."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.ranks))

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The surviving symbols of all words, one after the other, and how many each has."""
        none = len(self.ranks)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        ids, owner = self.base[raw], np.repeat(np.arange(len(words)), sizes)
        done_ids, done_owner = [], []
        rank = np.full(len(ids), none, dtype=np.int64)  # of each symbol with the next of its sequence
        rank[:-1] = np.where(owner[:-1] == owner[1:], self.byte_ranks[raw[:-1], raw[1:]], none)
        while len(ids):
            starts = np.flatnonzero(np.r_[True, owner[:-1] != owner[1:]])
            lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(ids)]))
            if (ended := lowest == none).any():
                done_ids.append(ids[ended])
                done_owner.append(owner[ended])
                ids, owner, rank, lowest = ids[~ended], owner[~ended], rank[~ended], lowest[~ended]
                if not len(ids):
                    break
            hit = rank == lowest
            # of overlapping places (a run of one symbol) every second merges, from the left
            index = np.arange(len(ids))
            head = hit & ~np.r_[False, hit[:-1]]
            hit &= (index - np.maximum.accumulate(np.where(head, index, 0))) % 2 == 0
            ids[hit] = self.made[rank[hit]]
            keep = ~np.r_[False, hit[:-1]]
            ids, owner, rank, hit = ids[keep], owner[keep], rank[keep], hit[keep]
            # only a merged symbol and the one before it have new neighbours
            at = np.flatnonzero(hit | np.r_[hit[1:], False])
            rank[at] = none
            at = at[at < len(ids) - 1]
            at = at[owner[at] == owner[at + 1]]
            rank[at] = self.rank(ids[at], ids[at + 1])
        if not done_ids:
            return np.zeros(0, dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def count_pieces(self, pieces: list[str]) -> list[int]:
        """The tokens of each piece of text, none with a special string."""
        cut = [self.pattern.findall(p) for p in pieces]
        words = {w: i for i, w in enumerate(dict.fromkeys(w for c in cut for w in c))}
        if not words:
            return [0] * len(pieces)
        n = self.merge([w.encode("utf-8", "surrogatepass") for w in words])[1].tolist()
        return [sum(n[words[w]] for w in c) for c in cut]


class Counter:
    """Counts texts; remembers the counts of the first ``most`` pieces, the common ones among them."""

    def __init__(self, merger: RankMerger, most: int = 500_000):
        self.merger, self.most, self.known = merger, most, {}

    def pieces(self, text: str) -> tuple[list[str], int]:
        """The pieces of the text, and how many special strings it holds."""
        parts, specials = [text], 0
        if self.merger.special and any(s in text for s in self.merger.specials):
            parts = self.merger.special.split(text)
            specials = len(parts) - 1
        if ODD.search(text):
            return [p for p in parts if p], specials
        return [x for p in parts for x in PIECE.findall(p)], specials

    def __call__(self, texts: list[str]) -> list[int]:
        cut = [self.pieces(t) for t in texts]
        known, get = self.known, self.known.get
        found = [list(map(get, c)) for c, _ in cut]
        missing = [[i for i, v in enumerate(parts) if v is None] if None in parts else () for parts in found]
        new = list({c[i] for (c, _), at in zip(cut, missing, strict=True) for i in at})
        fresh: dict[str, int] = {}
        for i in range(0, len(new), 50_000):
            fresh.update(zip(new[i : i + 50_000], self.merger.count_pieces(new[i : i + 50_000]), strict=True))
        for (c, _), parts, at in zip(cut, found, missing, strict=True):
            for i in at:
                parts[i] = fresh[c[i]]
        room = self.most - len(known)
        for p, v in fresh.items():
            if room <= 0:
                break
            if len(p) <= 60:
                known[p] = v
                room -= 1
        return [sum(parts) + s for parts, (_, s) in zip(found, cut, strict=True)]


def counter(path: str) -> Counter:
    return C.held(("counter", path), lambda: Counter(RankMerger(path)))


def count(docs: DataFrame, path: str, limit: int = 1024, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` of docs, with n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    ``path``: a byte-level BPE .json file, read on each executor. A null text counts as empty: no bytes, no tokens.
    Special strings inside texts are one token each. Every row gets one row.
    """
    C.batches(docs.sparkSession)
    keep = list(keep)
    docs = docs.select(*(f"`{k}`" for k in keep), docs["text"].cast("string").alias("__text"))

    def run(batches):
        total = counter(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("__text").to_pylist()]
            n = np.array(total(texts), dtype=np.int64)
            sizes = np.fromiter((len(t.encode("utf-8", "surrogatepass")) for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(sizes), pa.array(n), pa.array(n > limit)], names=[*keep, "n_bytes", "n_tokens", "over_limit"])

    return C.dealt(docs).mapInArrow(run, C.ddl(docs.select(*(f"`{k}`" for k in keep))) + ", n_bytes long, n_tokens long, over_limit boolean")


def op4(docs: DataFrame, path: str) -> DataFrame:
    return count(C.pick(docs, doc_id="long", text="string"), path)
