"""Benchmark decontamination by training suffix arrays.

Each run of training text (a shard of documents) becomes a word-level suffix array; every suffix of the test items is
binary-searched in it. Words that no test item has can't be part of a match, so they only separate: suffixes in
which a match of the least length can't begin are left out. These arrays are ordered to the depth of a window, which
finds every place that is hit. What is hit, of the shard and of the items, is then put in one full order, where the
longest verbatim match of each place stands beside it: no pairs of places are formed, however often a text repeats itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

#: Lower-cases A-Z; white space for the bytes that no word has.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
NEVER = 1 << 30


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


@dataclass
class TestBlock:
    """Test items as word ids from 1, and their windows."""

    names: list[str]
    vocabulary: dict[bytes, int]
    text: np.ndarray  # all items, each with a 0 behind it
    item: np.ndarray  # of each place in text
    starts: np.ndarray  # places where a window begins
    windows: np.ndarray  # (w, size): distinct windows, 0 past the end of a shorter one
    lengths: np.ndarray
    owners: np.ndarray  # the items of each window, window by window
    owner_at: np.ndarray  # where each window's begin
    window_at: np.ndarray  # for each place in text the window that begins there, or -1
    place: np.ndarray  # of each window: the first place of the text where it begins
    first: np.ndarray  # of each item: its place in the text less its first word's number in the whole item
    need: np.ndarray  # by word: the shortest window that begins with it

    @classmethod
    def build(cls, rows: list[tuple[str, list[bytes], int]], size: int) -> TestBlock | None:
        """rows: name, words (one at least), and how many words of the item come before them."""
        if not rows:
            return None
        vocabulary: dict[bytes, int] = {}
        names, text, item, starts, lengths, first = [], [], [], [], [], []
        for name, words, before in rows:
            ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words]
            length = min(size, len(ids))
            starts += range(len(text), len(text) + len(ids) - length + 1)
            lengths += [length] * (len(ids) - length + 1)
            first.append(len(text) - before)
            text += [*ids, 0]
            item += [len(names)] * (len(ids) + 1)
            names.append(name)
        padded = np.r_[text, np.zeros(size, dtype=np.int64)].astype(np.int32)
        starts, lengths, item = np.array(starts), np.array(lengths), np.r_[item, np.full(size, -1)]
        grid = padded[starts[:, None] + np.arange(size)]
        grid[np.arange(size) >= lengths[:, None]] = 0
        windows, place, which = np.unique(grid, axis=0, return_index=True, return_inverse=True)
        window_at = np.full(len(padded), -1, dtype=np.int64)
        window_at[starts] = which.ravel()
        pairs = np.unique(np.stack([which.ravel(), item[starts]], axis=1), axis=0)
        size_of = (windows > 0).sum(axis=1)
        need = np.full(len(vocabulary) + 1, NEVER, dtype=np.int64)
        np.minimum.at(need, windows[:, 0], size_of)
        return cls(names, vocabulary, padded, item, starts, windows, size_of, pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(windows) + 1)), window_at, starts[place], np.array(first), need)


class SuffixArray:
    """text: word ids, 0 between documents and for words of no test item; size: the depth of the order."""

    def __init__(self, text: np.ndarray, need: np.ndarray, size: int):
        self.size = size
        # where each place's run of known words ends
        at = np.arange(len(text))
        stops = np.where(text == 0, at, len(text))
        self.run = np.minimum.accumulate(stops[::-1])[::-1] - at
        wanted = self.run >= need[text]
        wanted &= text > 0
        self.text = np.r_[text, np.zeros(size, dtype=text.dtype)]
        # prefix doubling, over the runs with a wanted suffix only
        rank, depth = self.text.astype(np.int64), 1
        del at, stops
        inside = np.flatnonzero(self._reach(wanted))
        while depth < size and len(inside):
            key = rank[inside] * (rank.max() + 1) + np.where(inside + depth < len(rank), rank[np.minimum(inside + depth, len(rank) - 1)], 0)
            doubled = np.zeros_like(rank)
            doubled[inside] = np.unique(key, return_inverse=True)[1] + 1
            rank, depth = doubled, 2 * depth
        found = np.flatnonzero(wanted)
        self.order = found[np.argsort(rank[found], kind="stable")]

    def _reach(self, wanted: np.ndarray) -> np.ndarray:
        """Places within a window's depth after a wanted one."""
        edge = np.zeros(len(wanted) + self.size + 1, dtype=np.int64)
        at = np.flatnonzero(wanted)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + self.size, -1)
        return np.cumsum(edge)[: len(self.text)] > 0

    def search(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of the order in which suffixes begin with each window."""
        bounds = []
        for upper in (False, True):
            lo, hi = np.zeros(len(windows), dtype=np.int64), np.full(len(windows), len(self.order), dtype=np.int64)
            while (open_ := lo < hi).any():
                at = np.flatnonzero(open_)
                mid = (lo[at] + hi[at]) // 2
                suffix = self.text[self.order[mid][:, None] + np.arange(self.size)]
                # only a window's own length counts
                differs = (suffix != windows[at]) & (np.arange(self.size) < lengths[at][:, None])
                first = np.where(differs.any(axis=1), differs.argmax(axis=1), -1)
                rows = np.arange(len(at))
                less = (first >= 0) & (suffix[rows, first] < windows[at][rows, first])
                right = less | ((first < 0) & upper)
                lo[at] = np.where(right, mid + 1, lo[at])
                hi[at] = np.where(right, hi[at], mid)
            bounds.append(lo)
        return bounds[0], bounds[1]


@dataclass
class Found:
    """Of one shard: which words are hit, all documents' in a row; pairs (document, item); and the longest verbatim matches."""

    hit: np.ndarray
    pairs: np.ndarray
    spans: np.ndarray  # document, first word, words, item, first word in the item


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + n[0] - 1, start[1] .."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _last(at: np.ndarray, window: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct places, and the longest window of each."""
    order = np.lexsort((length, at))
    ends = np.r_[np.diff(at[order]) > 0, True]
    return at[order][ends], window[order][ends]


def _covered(starts: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    edge = np.zeros(size + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + lengths, size), -1)
    return np.cumsum(edge[:-1]) > 0


def _runs(text: np.ndarray, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The covered words, a 0 behind each run of them, and the place of each in the text."""
    at = np.flatnonzero(covered)
    to = np.arange(len(at)) + np.cumsum(np.r_[0, np.diff(at) > 1])[: len(at)]
    out, back = np.zeros(len(at) and to[-1] + 2, dtype=np.int64), np.full(len(at) and to[-1] + 2, -1)
    out[to], back[to] = text[at], at
    return out, back


def longest(text: np.ndarray, covered: np.ndarray, tests: np.ndarray, known: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``starts``, places of ``text``: the most words that agree with a place of ``tests``, and that place.

    Only covered words of the text and known ones of the tests take part. Both are put in one order by prefix doubling;
    the place of the tests that agrees longest stands next to a start, before or behind it.
    """
    mine, mine_at = _runs(text, covered)
    theirs, theirs_at = _runs(tests, known)
    both, split = np.r_[mine, theirs], len(mine)
    at = np.arange(len(both))
    run = np.minimum.accumulate(np.where(both == 0, at, len(both))[::-1])[::-1] - at
    most = int(run[split:].max())
    rank = np.unique(both, return_inverse=True)[1]
    ranks, depth = [rank], 1
    while depth < most:
        rank = np.unique(rank * (rank.max() + 1) + np.r_[rank[depth:], np.zeros(min(depth, len(rank)), dtype=rank.dtype)], return_inverse=True)[1]
        ranks.append(rank)
        depth *= 2
    order = np.argsort(rank, kind="stable")
    is_test = order >= split
    place = np.empty(len(both), dtype=np.int64)
    place[order] = at
    before = np.maximum.accumulate(np.where(is_test, at, -1))
    behind = np.minimum.accumulate(np.where(is_test, at, len(both))[::-1])[::-1]
    back = np.full(len(text), -1)
    back[mine_at[mine_at >= 0]] = np.flatnonzero(mine_at >= 0)
    p = back[starts]
    best, where = np.zeros(len(p), dtype=np.int64), np.zeros(len(p), dtype=np.int64)
    for near in (before[place[p]], behind[place[p]]):
        s = order[np.clip(near, 0, len(both) - 1)]
        same = np.zeros(len(p), dtype=np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            x, y = p + same, s + same
            ok = (x < len(both)) & (y < len(both))
            ok[ok] = ranks[k][x[ok]] == ranks[k][y[ok]]
            same += ok << k
        same = np.minimum(np.minimum(same, run[p]), run[s]) * ((near >= 0) & (near < len(both)) & (s >= split))
        where = np.where(same > best, theirs_at[np.maximum(s - split, 0)], where)
        best = np.maximum(best, same)
    return best, where


def search_shard(docs: list[np.ndarray], tests: TestBlock) -> Found:
    """docs: the words of each document as the block's ids, 0 for those it hasn't."""
    size = tests.windows.shape[1]
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    begin = np.r_[0, np.cumsum(sizes + 1)][:-1]
    whole = np.zeros(int(sizes.sum()) + len(docs), dtype=np.int32)
    for b, d in zip(begin.tolist(), docs, strict=True):
        whole[b : b + len(d)] = d
    array = SuffixArray(whole, tests.need, size)
    lo, hi = array.search(tests.windows, tests.lengths)
    n = hi - lo
    window, at = np.repeat(np.arange(len(n)), n), array.order[_ranges(lo, n)]
    covered = _covered(at, tests.lengths[window], len(whole))
    words = np.ones(len(whole), dtype=bool)
    words[begin + sizes] = False
    if not len(at):
        return Found(covered[words], np.zeros((0, 2), dtype=np.int64), np.zeros((0, 5), dtype=np.int64))
    starts, longest_window = _last(at, window, tests.lengths[window])
    # the windows of each document, and so its items
    doc = np.searchsorted(begin, at, side="right") - 1
    doc, window = np.unique(np.stack([doc, window], axis=1), axis=0).T
    many = np.diff(tests.owner_at)[window]
    pairs = np.unique(np.stack([np.repeat(doc, many), tests.owners[_ranges(tests.owner_at[window], many)]], axis=1), axis=0)
    # the longest match of each place where a window occurs; one that only goes on with that of the place before is left out
    occurs = np.zeros(len(tests.lengths) + 1, dtype=bool)
    occurs[window] = True
    open_ = np.flatnonzero(occurs[tests.window_at])
    length, where = longest(whole, covered, tests.text, _covered(open_, tests.lengths[tests.window_at[open_]], len(tests.text)), starts)
    # less than a window of a longer item isn't a match with it: there the longest whole item counts
    short = length < size
    length[short], where[short] = tests.lengths[longest_window[short]], tests.place[longest_window[short]]
    heads = np.r_[True, (np.diff(starts) > 1) | (length[1:] >= length[:-1])]
    starts, length, where = starts[heads], length[heads], where[heads]
    doc = np.searchsorted(begin, starts, side="right") - 1
    return Found(covered[words], pairs, np.stack([doc, starts - begin[doc], length, tests.item[where], where - tests.first[tests.item[where]]], axis=1))


def test_blocks(benchmark: DataFrame, size: int, block_words: int) -> Iterator[TestBlock]:
    """The items in blocks of about ``block_words`` words: what is broadcast at once stays bounded for any benchmark. A
    longer item is cut into pieces that overlap by a window less a word."""
    held, words = [], 0
    for row in C.pick(benchmark, item_id="string", text="string").toLocalIterator():
        found = words_of(row.text)
        for at in range(0, max(1, len(found) - size + 1), block_words) if found else ():
            piece = found[at : at + block_words + size - 1]
            held.append(("null" if row.item_id is None else row.item_id, piece, at))
            words += len(piece)
            if words >= block_words:
                yield TestBlock.build(held, size)
                held, words = [], 0
    if held:
        yield TestBlock.build(held, size)


def scan(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), size: int = 10, block_words: int = 2_000_000, shard_words: int = 250_000, spans: bool = False, prefix: str = "") -> DataFrame:
    """``keep`` of docs (at least text must exist), with n_words, n_hit, n_items, items_sha256, contaminated, longest_match.

    A null or wordless text has no words and no hits. Items without words are never found; items with one id count
    once; a null item_id counts as ``null``. Without items nothing is hit; repeated rows get a row each; an empty table
    gives none. ``prefix`` goes before the new columns' names. ``spans`` adds the longest verbatim matches: first word,
    words, item_id (of several items one) and first word in the item, of each place where a window occurs but those whose
    match only goes on with that of the place before. ``keep`` may hold any columns: they pass unchanged. Blocks of test
    items are taken one after the other; what all but the last find is written, and only one block is broadcast at a time.
    A task holds about a hundred bytes a word of a shard, which is at least one Arrow batch.
    """
    spark = docs.sparkSession
    C.batches(spark)
    keep = list(keep)
    names = [f"__keep{i}" for i in range(len(keep))]
    rows = docs.select(*(docs[f"`{k}`"].alias(n) for k, n in zip(keep, names, strict=True)), docs["text"].cast("string").alias("__text"))
    made = {"n_words": "long", "n_hit": "long", "n_items": "long", "items_sha256": "string", "contaminated": "boolean", "longest_match": "long"}
    span = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("item_id", pa.string()), ("item_start", pa.int64())]))
    sofar = {"__cover": pa.list_(pa.int64()), "__items": pa.list_(pa.string()), "__spans": span}
    found_ddl = "__cover array<long>, __items array<string>, __spans array<struct<start:long,words:long,item_id:string,item_start:long>>"
    rows = C.dealt(rows)
    kept_ddl, first = C.ddl(rows.select(*names)), True
    text_ddl = (kept_ddl + ", " if names else "") + "__text string"

    def search(block, first):
        """Adds to __cover (first and last word, again and again), __items and __spans what the block's items hit."""

        def run(batches):
            C.held("decontamination", dict)  # nothing is kept here, but what another operator kept goes
            for held in C.grouped(batches, lambda b: b.column("__text").nbytes // 6, shard_words):
                tests, get = block.value, block.value.vocabulary.get
                texts = [t for b in held for t in b.column("__text").to_pylist()]
                ids = [np.array([get(w, 0) for w in words_of(t)], dtype=np.int32) for t in texts]
                found = search_shard(ids, tests)
                cover, items, marks = ([[] for _ in texts] for _ in range(3))
                if not first:
                    for mine, name in ((cover, "__cover"), (items, "__items"), (marks, "__spans")):
                        mine[:] = [x for b in held for x in b.column(name).to_pylist()]
                at = np.r_[0, np.cumsum([len(x) for x in ids])]
                for doc in np.unique(found.pairs[:, 0]).tolist():
                    edges = np.flatnonzero(np.diff(np.r_[False, found.hit[at[doc] : at[doc + 1]], False]))
                    cover[doc] = cover[doc] + edges.tolist()
                for doc, item in found.pairs.tolist():
                    items[doc].append(tests.names[item])
                for doc, start, words, item, place in found.spans.tolist():
                    marks[doc].append({"start": start, "words": words, "item_id": tests.names[item], "item_start": place})
                items = [sorted(set(x)) for x in items]
                table = pa.Table.from_batches(held).select([*names, "__text"]).combine_chunks()
                columns = [*(c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in table.columns), *(pa.array(v, kind) for v, kind in zip((cover, items, marks), sofar.values(), strict=True))]
                yield from pa.table(columns, names=[*names, "__text", *sofar]).to_batches()

        return run

    def digest(batches):
        for batch in batches:
            n, hit, sha, longest_ = [], [], [], []
            items = batch.column("__items").to_pylist()
            for text, cover, mine, marks in zip(batch.column("__text").to_pylist(), batch.column("__cover").to_pylist(), items, batch.column("__spans").to_pylist(), strict=True):
                n.append(len(words_of(text)))
                total = reach = 0
                for a, b in sorted(zip(cover[::2], cover[1::2], strict=True)):
                    total += max(0, b - max(a, reach))
                    reach = max(reach, b)
                hit.append(total)
                sha.append(hashlib.sha256(",".join(mine).encode()).hexdigest())
                longest_.append(max((m["words"] for m in marks), default=0))
            columns = [*(batch.column(k) for k in names), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(sha, pa.string()), pa.array([x > 0 for x in hit], pa.bool_()), pa.array(longest_, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, batch.column("__spans")], names=[*names, *(f"__made_{k}" for k in made), "__spans"])

    before = None
    for block in test_blocks(benchmark, size, block_words):
        if before is not None:
            rows, _ = C.written(rows.mapInArrow(search(before, first), f"{text_ddl}, {found_ddl}"), "searched")
            before.destroy()
            first = False
        before = spark.sparkContext.broadcast(block)
    if before is not None:
        last = search(before, first)
    else:
        rows = rows.selectExpr("*", "cast(array() as array<long>) AS __cover", "cast(array() as array<string>) AS __items", "cast(array() as array<struct<start:long,words:long,item_id:string,item_start:long>>) AS __spans")
        last = iter
    out = rows.mapInArrow(lambda batches: digest(last(batches)), ", ".join([*([kept_ddl] if names else []), *(f"__made_{k} {kind}" for k, kind in made.items()), found_ddl.split(", ", 2)[2]]))
    return out.select(*(F.col(n).alias(k) for n, k in zip(names, keep, strict=True)), *(F.col(f"__made_{k}").alias(f"{prefix}{k}") for k in made), *([F.col("__spans").alias(f"{prefix}spans")] if spans else []))


def op5(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return scan(C.pick(docs, doc_id="long", text="string"), benchmark).drop("longest_match")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no window of a test item occurs, with their own columns."""
    return scan(docs, benchmark, keep=tuple(docs.columns), prefix="__leak_").where("not __leak_contaminated").select(*(f"`{c}`" for c in docs.columns))
