"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions; each has a context tree over the bytes before it, as far back as ``depth``. Every
node estimates by Krichevsky-Trofimov from its own counts and is mixed with its children with the weight that the
training text gives it. ``whole`` gives every context a node, dealt out to tasks; ``op7`` uses it. In ``train`` of the
contexts of one depth the commonest ``nodes`` get a node of their own; beside these children a context has one more that
stands for all its others, so that a tree of bounded size counts every byte, whatever the corpus. Counting and scoring
are passes over all documents; only the tree itself is built on the driver.

The base model is a unigram model over white-space words with add-one counts over the whole vocabulary. ``whole`` asks
for the counts of words as for those of contexts; ``score`` has words that make up at least 2**-17 of the corpus in a
table of bounded size, and joins all others.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as C

#: Stands before and after each text; UTF-8 has no such byte.
EDGE = 0xFF
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
END = np.uint64(0x5EED0E2D)  # the hash of the end token, which no word equals but by chance
CHUNK, PIECE = 12_000_000, 1 << 17
#: Packed trees hold log10 probabilities in steps of 1/STEP.
STEP = 4096


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma(x) for x >= 0.5, by Stirling's series after a step of 8."""
    y = x + 8
    steps = np.ones_like(x)
    for i in range(8):
        steps *= x + i
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(steps)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - math.log(math.pi) - log_gamma(np.maximum(a + b + 1.0, 0.5))


def bit_counts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 256) counts of bytes: zeros and ones at the 255 decisions, (n, 255), the first bit's decision first."""
    heap = np.zeros((len(counts), 512))
    heap[:, 256:] = counts
    for i in range(8):
        lo = 128 >> i
        heap[:, lo : 2 * lo] = heap[:, 2 * lo : 4 * lo : 2] + heap[:, 2 * lo + 1 : 4 * lo : 2]
    return heap[:, 2:512:2], heap[:, 3:512:2]


@dataclass
class Tree:
    """Nodes numbered by depth, the root first. down[node, byte]: the node one byte further back, or ~node if there is
    none. log10[node, byte]: probability of the next byte at the deepest node. first[d]: the first node of depth d."""

    down: np.ndarray
    first: list[int]
    log10: np.ndarray | None = None
    pair: np.ndarray = field(default=None)

    def __post_init__(self):
        one = self.down[0].astype(np.int64)  # by the last byte
        two = np.where((one >= 0)[:, None], self.down[np.maximum(one, 0)], one[:, None])
        self.pair = two.astype(np.int32).ravel()  # [last * 256 + the one before]

    def pack(self) -> bytes:
        """A few bytes a child and two a byte of each node, compressed: what is broadcast."""
        parent, byte = np.nonzero(self.down >= 0)
        parts = [np.array([len(self.down), len(parent), len(self.first)], dtype="<i4"), np.array(self.first, dtype="<i4"), parent.astype("<i4"), self.down[parent, byte].astype("<i4"), byte.astype(np.uint8)]
        if self.log10 is not None:
            # column by column, as nodes differ less than bytes
            parts.append(np.round(np.maximum(self.log10, -7.9) * STEP).astype("<i2").T)
        return zlib.compress(b"".join(x.tobytes() for x in parts), 1)

    @classmethod
    def unpack(cls, data: bytes) -> Tree:
        data = zlib.decompress(data)
        nodes, kids, depths = np.frombuffer(data, dtype="<i4", count=3).tolist()
        first = np.frombuffer(data, dtype="<i4", count=depths, offset=12).tolist()
        at = 12 + 4 * depths
        parent, child = np.frombuffer(data, dtype="<i4", count=kids, offset=at), np.frombuffer(data, dtype="<i4", count=kids, offset=at + 4 * kids)
        byte = np.frombuffer(data, dtype=np.uint8, count=kids, offset=at + 8 * kids)
        down = np.empty((nodes, 256), dtype=np.int32)
        down[:] = ~np.arange(nodes, dtype=np.int32)[:, None]
        down[parent, byte] = child
        at += 9 * kids
        log10 = None
        if at < len(data):
            log10 = np.ascontiguousarray(np.frombuffer(data, dtype="<i2", offset=at).reshape(256, nodes).T).astype(np.float32) / STEP
        return cls(down, first, log10)

    def deepest(self, text: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each place of ``text``, in pieces that stay in cache: the deepest node up to ``depth``; ~node if a deeper one was missed."""
        flat = self.down.ravel()
        padded = np.r_[np.full(depth, EDGE, dtype=np.uint8), text].astype(np.int32)
        for start in range(0, len(text), PIECE):
            n = min(PIECE, len(text) - start)
            back = [padded[start + depth - d : start + depth - d + n] for d in range(1, depth + 1)]
            node = self.pair[back[0] * 256 + back[1]]
            for d in range(2, depth):
                node = np.where(node < 0, node, flat[np.maximum(node, 0) * 256 + back[d]])
            yield start, node

    def score(self, text: np.ndarray) -> np.ndarray:
        """log10 probability of each byte given those before it."""
        out, flat = np.empty(len(text), dtype=np.float32), self.log10.ravel()
        for start, node in self.deepest(text, len(self.first) - 2):
            node = np.where(node < 0, ~node, node)
            out[start : start + len(node)] = flat[node * 256 + text[start : start + len(node)]]
        return out

    def count(self, text: np.ndarray, coded: np.ndarray, depth: int) -> np.ndarray:
        """How often each byte follows each node of this depth at the coded places, flat."""
        low, n, parts, held = self.first[depth], np.zeros((self.first[depth + 1] - self.first[depth]) * 256, dtype=np.int64), [], 0
        for start, node in self.deepest(text, depth):
            at = np.flatnonzero((node >= low) & coded[start : start + len(node)])
            parts.append((node[at] - low) * 256 + text[start + at])
            held += len(at)
            if held >= 1 << 21:
                n += np.bincount(np.concatenate(parts), minlength=len(n))
                parts, held = [], 0
        return n + np.bincount(np.concatenate(parts), minlength=len(n)) if parts else n


def unpacked(shipped) -> Tree:
    """The tree of a broadcast, unpacked once a process."""
    return C.held(shipped.value[0], lambda: Tree.unpack(shipped.value[1]))


def ship(spark, tree: Tree):
    return spark.sparkContext.broadcast((uuid.uuid4().hex, tree.pack()))


def build_tree(counts: list[np.ndarray], child: list[np.ndarray]) -> Tree:
    """counts[d]: (nodes, 256) next bytes of each node at depth d; child[d] as in Tree, for all depths but the last."""
    last = len(counts) - 1
    half = math.log(0.5)
    whole, stop, rest_kt, own_kt = [None] * (last + 1), [None] * (last + 1), [None] * (last + 1), [None] * (last + 1)
    for d in range(last, -1, -1):
        a, b = bit_counts(counts[d])
        kt = log_kt(a, b)
        own_kt[d] = ((b + 0.5) / (a + b + 1)).astype(np.float32)
        if d == last:
            whole[d], stop[d] = kt, None
            continue
        parent, _ = np.nonzero(child[d] >= 0)
        kids = child[d][child[d] >= 0]
        below, counted = np.zeros_like(kt), np.zeros_like(counts[d])
        np.add.at(below, parent, whole[d + 1][kids])
        np.add.at(counted, parent, counts[d + 1][kids])
        ra, rb = bit_counts(np.maximum(counts[d] - counted, 0))
        below += log_kt(ra, rb)
        rest_kt[d] = ((rb + 0.5) / (ra + rb + 1)).astype(np.float32)
        whole[d] = half + np.logaddexp(kt, below)
        stop[d] = np.exp(np.minimum(half + kt - whole[d], 0)).astype(np.float32)
        whole[d + 1] = None
    logs10 = []
    mass, sofar = np.ones((1, 255), dtype=np.float32), np.zeros((1, 255), dtype=np.float32)
    for d in range(last + 1):
        if d == last:
            one = sofar + mass * own_kt[d]
        else:
            one = sofar + mass * (stop[d] * own_kt[d] + (1 - stop[d]) * rest_kt[d])
        logs = np.zeros((len(one), 1))
        for i in range(8):
            p = np.clip(one[:, (1 << i) - 1 : (2 << i) - 1].astype(np.float64), 1e-12, 1 - 1e-12)
            logs = np.stack([logs + np.log10(1 - p), logs + np.log10(p)], axis=2).reshape(len(one), 2 << i)
        logs10.append(logs.astype(np.float32))
        if d < last:
            parent, _ = np.nonzero(child[d] >= 0)
            kids = child[d][child[d] >= 0]
            mass_, sofar_ = np.empty((len(kids), 255), dtype=np.float32), np.empty((len(kids), 255), dtype=np.float32)
            mass_[kids] = (mass * (1 - stop[d]))[parent]
            sofar_[kids] = (sofar + mass * stop[d] * own_kt[d])[parent]
            mass, sofar = mass_, sofar_
    tree = join_tree(child)
    tree.log10 = np.concatenate(logs10)
    return tree


def join_tree(child: list[np.ndarray]) -> Tree:
    """child[d][node, byte]: the node at depth d + 1, or -1."""
    sizes = [1, *(int((c >= 0).sum()) for c in child)]
    first = np.r_[0, np.cumsum(sizes)].tolist()
    down = np.empty((first[-1], 256), dtype=np.int32)
    down[:] = ~np.arange(first[-1], dtype=np.int32)[:, None]
    for d, c in enumerate(child):
        mine = down[first[d] : first[d + 1]]
        mine[c >= 0] = c[c >= 0] + first[d + 1]
    # at the greatest depth a node has no children to miss
    return Tree(down, first)


class _Words(dict):
    """Word to its row in ``hash`` (and ``log``: log10(c + 1), nan if unknown here); forgotten when there are ``most``."""

    def __init__(self, common: dict[int, float], most: int = 200_000):
        self.common, self.most = common, most
        self.hash, self.log = np.zeros(most + 1, dtype=np.uint64), np.zeros(most + 1)

    def __missing__(self, word: bytes) -> int:
        at = len(self)
        if at >= len(self.hash):
            self.hash, self.log = np.r_[self.hash, np.zeros_like(self.hash)], np.r_[self.log, np.zeros_like(self.log)]
        value = xxhash.xxh3_64_intdigest(word)
        self.hash[at], self.log[at] = value, self.common.get(value, math.nan)
        self[word] = at
        return at


FOLDS = np.frombuffer(FOLD, dtype=np.uint8)


def _joined(column, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The folded texts of a string column as one array, ``depth`` edges before and one after each: so no context reaches
    into another text. Also where each text begins, and where its end stands."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    begin = offsets[:-1] - offsets[0] + np.arange(len(column)) * (depth + 1) + depth
    end = begin + np.diff(offsets)
    out = np.full(int(offsets[-1] - offsets[0]) + len(column) * (depth + 1), EDGE, dtype=np.uint8)
    for a, b, to in zip(offsets[:-1].tolist(), offsets[1:].tolist(), begin.tolist(), strict=True):
        np.take(FOLDS, data[a:b], out=out[to : to + b - a])
    return out, begin, end


def _coded(begin: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """Whether a place of the joined texts is one of a text or its end."""
    edge = np.zeros(size + 1, dtype=np.int8)
    edge[begin] += 1
    edge[end + 1] -= 1
    return np.cumsum(edge[:-1], dtype=np.int8) > 0


def _split(text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[list[bytes]]:
    """The words of each joined text."""
    raw = text.tobytes()
    return [raw[a:b].split() for a, b in zip(begin.tolist(), end.tolist(), strict=True)]


@dataclass
class Model:
    tree: Tree
    total: int  # N: training tokens
    distinct: int  # V
    common: dict[int, float]  # word hash to log10(c + 1)
    counts: DataFrame  # word, n: of all training tokens


def _common_words(words: DataFrame) -> tuple[int, int, dict[int, float]]:
    """words: word, n. All tokens, distinct ones, and of the common words log10(n + 1)."""
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # a word of at least this share: 131072 of them at most, 8 bytes and a number each
    got = words.where(F.col("n") >= max(1.0, total * 2.0**-17)).select("word", "n").toArrow()
    return int(total), int(distinct), dict(zip(got.column("word").to_numpy().view(np.uint64).tolist(), np.log10(got.column("n").to_numpy() + 1.0).tolist(), strict=True))


def train(docs: DataFrame, depth: int = 6, nodes: int = 8192) -> Model:
    """docs: text, all of them training texts; a null text is empty. Edges stand before and after each text; the one
    after it is coded as its end. No rows: every byte is as likely as another."""
    spark = docs.sparkSession
    C.batches(spark)
    docs = C.dealt(C.pick(docs, text="string"))

    def count(tree, level, words):
        def run(batches):
            for held in C.grouped(batches, lambda b: b.column("text").nbytes, CHUNK):
                joined = [_joined(b.column("text"), depth) for b in held]
                text = np.concatenate([j[0] for j in joined])
                coded = np.concatenate([_coded(b, e, len(j)) for j, b, e in joined])
                if level == 2:
                    # three bytes as one number, of the bytes that occur
                    used = np.flatnonzero(np.bincount(text, minlength=256)) if len(text) else np.array([EDGE])
                    used = np.union1d(used, [EDGE])
                    code, size = np.zeros(256, dtype=np.int32), len(used)
                    code[used] = np.arange(size)
                    n = np.zeros(size**3, dtype=np.int64)
                    for at in range(0, len(text), 1 << 20):
                        before = code[np.r_[np.full(2, EDGE, dtype=np.uint8), text[: at + (1 << 20)]][at:]] if at == 0 else code[text[at - 2 : at + (1 << 20)]]
                        n += np.bincount(((before[:-2] * size + before[1:-1]) * size + before[2:])[coded[at : at + (1 << 20)]], minlength=size**3)
                else:
                    n = unpacked(tree).count(text, coded, level)
                at = key = np.flatnonzero(n)
                if level == 2:
                    key = (used[at // size**2] << 16) | (used[at // size % size] << 8) | used[at % size]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(at), dtype=np.int32)), pa.array(key.astype(np.int64)), pa.array(n[at].astype(np.int64))], names=["kind", "key", "n"])
                if words:
                    tally: dict[bytes, int] = {}
                    for j in joined:
                        for found in _split(*j):
                            for w in found:
                                tally[w] = tally.get(w, 0) + 1
                    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, tally), np.uint64, len(tally))
                    yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(tally) + 1, dtype=np.int32)), pa.array(np.r_[hashes, END].view(np.int64)), pa.array(np.r_[np.fromiter(tally.values(), np.int64, len(tally)), sum(len(j[1]) for j in joined)])], names=["kind", "key", "n"])

        return docs.mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))

    def pulled(df):
        got = df.select("key", "n").toArrow()
        return got.column("key").to_numpy(), got.column("n").to_numpy()

    table, _ = C.written(count(None, 2, True), "counts")
    words = table.where("kind = 1").select(F.col("key").alias("word"), "n")
    total, distinct, common = _common_words(words)

    def commonest(context):
        """Places of the ``nodes`` largest counts of at least 2, ties to the first."""
        at = np.argsort(-context.ravel(), kind="stable")[:nodes]
        at = np.sort(at[context.ravel()[at] >= 2])
        return np.divmod(at, 256)

    key, n = pulled(table.where("kind = 0"))
    c, b1, b2 = key & 255, (key >> 8) & 255, key >> 16
    pair = np.zeros((256, 256))  # [last byte, next]
    np.add.at(pair, (b1, c), n)
    counts, child = [pair.sum(axis=0, keepdims=True)], []
    single = np.flatnonzero(pair.sum(axis=1) > 0)
    child.append(np.full((1, 256), -1, dtype=np.int32))
    child[0][0, single] = np.arange(len(single))
    counts.append(pair[single])
    grams = single[:, None]  # the context of each node at the last depth, the nearest byte first
    # pairs of bytes as contexts of depth 2
    context = np.zeros((256, 256))
    np.add.at(context, (b1, b2), n)
    near, far = commonest(context)
    child.append(np.full((len(grams), 256), -1, dtype=np.int32))
    row = np.full(65536, -1)
    row[near * 256 + far] = np.arange(len(near))
    child[1][child[0][0, near], far] = np.arange(len(near))
    two = np.zeros((len(near), 256))
    mine = row[b1 * 256 + b2]
    np.add.at(two, (mine[mine >= 0], c[mine >= 0]), n[mine >= 0])
    counts.append(two)
    grams = np.stack([near, far], axis=1)
    for d in range(3, depth + 1):
        # the context (x1 nearest .. xd) occurs as often as x1 follows the context (x2 .. xd), a node at depth d - 1 if it is common enough
        index = {tuple(g): i for i, g in enumerate(grams.tolist())}
        node, nxt = np.nonzero(counts[-1] >= 2)
        found = []
        for i, x, c_ in zip(node.tolist(), nxt.tolist(), counts[-1][node, nxt].tolist(), strict=True):
            g = (x, *grams[i].tolist())
            if (parent := index.get(g[:-1])) is not None:
                found.append((-c_, g, parent))
        kids = [(parent, g) for _, g, parent in sorted(found)[:nodes]]
        child.append(np.full((len(grams), 256), -1, dtype=np.int32))
        for k, (parent, g) in enumerate(kids):
            child[-1][parent, g[-1]] = k
        grams = np.array([g for _, g in kids], dtype=np.int64).reshape(len(kids), d)
        level = np.zeros((len(kids), 256))
        if kids:
            tree = ship(spark, join_tree(child))
            key, n = pulled(count(tree, d, False))
            level.reshape(-1)[key] = n
            tree.destroy()
        counts.append(level)
    return Model(build_tree(counts, child), int(total), int(distinct), common, words)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` of docs with n_tokens, n_known, base_score, score, bits_per_byte; a null text is empty: only its end."""
    spark = docs.sparkSession
    C.batches(spark)
    keep = list(keep)
    rows = C.dealt(docs.select(*(f"`{k}`" for k in keep), docs["text"].cast("string").alias("text"))).select("*", F.monotonically_increasing_id().alias("__id"))
    tree, common = ship(spark, model.tree), spark.sparkContext.broadcast(model.common)

    def run(batches):
        words = _Words(common.value)
        for batch in batches:
            depth = len(unpacked(tree).first) - 2
            text, begin, end = _joined(batch.column("text"), depth)
            texts = _split(text, begin, end)
            logs = unpacked(tree).score(text)
            # every other sum is of the edges between a text's end and the next text
            total = np.add.reduceat(logs, np.stack([begin, end + 1], axis=1).ravel()[: 2 * len(begin) - 1], dtype=np.float64)[::2] if len(texts) else np.zeros(0)
            tokens, known, sums, rare, often, ends = [], [], [], [], [], [0]
            for found in texts:
                if len(words) > words.most:
                    words.clear()
                at = np.fromiter(map(words.__getitem__, found), np.int64, len(found))
                log, hashes = np.r_[words.log[at], words.common.get(int(END), math.nan)], np.r_[words.hash[at], END]
                missing = np.isnan(log)
                tokens.append(len(log))
                known.append(int((~missing).sum()))
                sums.append(float(log[~missing].sum()))
                h, k = np.unique(hashes[missing], return_counts=True)
                rare.append(h)
                often.append(k)
                ends.append(ends[-1] + len(h))
            offsets = pa.array(ends, pa.int32())
            flat = np.concatenate(rare).view(np.int64) if rare else np.zeros(0, dtype=np.int64)
            n = np.concatenate(often).astype(np.int64) if often else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep), batch.column("__id"), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(sums, pa.float64()), pa.array(total), pa.array(-total / math.log10(2) / np.maximum(1, end - begin)), pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.ListArray.from_arrays(offsets, pa.array(n))],
                names=[*keep, "__id", "n_tokens", "__known", "__sum", "score", "bits_per_byte", "__rare", "__often"],
            )

    kinds = C.ddl(docs.select(*(f"`{k}`" for k in keep)))
    scored, _ = C.written(rows.mapInArrow(run, f"{kinds}, __id long, n_tokens long, __known long, __sum double, score double, bits_per_byte double, __rare array<long>, __often array<long>"), "scored")
    tree.destroy()
    common.destroy()
    pairs = scored.select("__id", F.explode(F.arrays_zip("__rare", "__often")).alias("p")).select("__id", F.col("p.__rare").alias("word"), F.col("p.__often").alias("k"))
    joined = pairs.join(model.counts, "word").groupBy("__id").agg(F.sum("k").alias("__k"), F.sum(F.col("k") * F.log10(F.col("n") + 1.0)).alias("__s"))
    none = math.log10(model.total + model.distinct + 1)
    return scored.join(joined, "__id", "left").select(
        *(f"`{k}`" for k in keep),
        "n_tokens",
        (F.col("__known") + F.coalesce("__k", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("__sum") + F.coalesce("__s", F.lit(0.0)) - F.col("n_tokens") * F.lit(none)).alias("base_score"),
        "score",
        "bits_per_byte",
    )


def _cells(key: np.ndarray, n: np.ndarray, depth: int, top: int) -> tuple[list, list, np.ndarray]:
    """Counts and weights of the decisions of all contexts from ``depth`` down to ``top``.

    key: distinct, the context's bytes, the nearest one first, and the next byte; n: how often each occurs. Gives by depth
    (cell, a, b, ln of the weighted probability), by depth the place of each cell in the one above, and the place of each
    key's eight decisions among the cells of ``depth``. A cell is a context and a decision's number in the heap of a byte.
    """
    c = key & 255
    heaps = np.stack([(1 << i) | (c >> (8 - i)) for i in range(8)], axis=1)
    cell, at = np.unique(((key >> 8 << 8)[:, None] | heaps).ravel(), return_inverse=True)
    at = at.reshape(heaps.shape)
    ones = np.stack([(c >> (7 - i)) & 1 for i in range(8)], axis=1)
    b = np.bincount(at.ravel(), (n[:, None] * ones).ravel(), len(cell))
    a = np.bincount(at.ravel(), (n[:, None] * (1 - ones)).ravel(), len(cell))
    levels, up = [(cell, a, b, log_kt(a, b))], []
    for _ in range(depth - top):
        cell, a, b, whole = levels[-1]
        cell, to = np.unique((cell >> 16 << 8) | (cell & 255), return_inverse=True)
        a, b, whole = (np.bincount(to, x, len(cell)) for x in (a, b, whole))
        levels.append((cell, a, b, math.log(0.5) + np.logaddexp(log_kt(a, b), whole)))
        up.append(to)
    return levels[::-1], up[::-1], at


def _descend(level, mass: np.ndarray, sofar: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What is left to the contexts below, and the probability of a one that those down to this level give."""
    _, a, b, whole = level
    stop = np.exp(np.minimum(math.log(0.5) + log_kt(a, b) - whole, 0))
    return mass * (1 - stop), sofar + mass * stop * (b + 0.5) / (a + b + 1)


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin; ``x`` isn't empty."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))


def _packed(x: np.ndarray) -> bytes:
    """An array as planes of bytes, compressed: neighbours in sorted keys differ in few of them."""
    return len(x).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, dtype: str) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(data[8:], n * width, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(dtype).ravel()


def _stream(table: pa.Table) -> bytes:
    """A table as an Arrow stream, compressed."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))) as stream:
        stream.write_table(table.combine_chunks())
    return out.getvalue().to_pybytes()


def _added(keys: list, ns: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of sorted arrays, in order, with summed n."""
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = _runs(key)
    return key[first], np.add.reduceat(np.concatenate(ns)[order], first)


def _merged(arrays: Iterator, least: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """As ``_added`` of any number of (key, n); little more than the distinct keys is held."""
    keys, ns, held, most = [], [], 0, least
    for key, n in arrays:
        keys.append(key)
        ns.append(n)
        held += len(key)
        if held >= most:
            key, n = _added(keys, ns)
            keys, ns, held, most = [key], [n], len(key), max(least, 2 * len(key))
    return _added(keys, ns)


def _slices(key: np.ndarray, n: np.ndarray, least: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted keys in runs that end where the two nearest bytes change."""
    start = 0
    for cut in [*_runs(key >> 40)[1:].tolist(), len(key)]:
        if cut - start >= least or cut == len(key):
            yield key[start:cut], n[start:cut]
            start = cut


@dataclass
class _Places:
    """The bytes of all texts and their ends, each with the six bytes before it, in the order of these seven bytes."""

    key: np.ndarray  # the distinct ones, the context's bytes first, the nearest one foremost
    first: np.ndarray  # where the places of each begin
    doc: np.ndarray  # the text of each place
    many: np.ndarray  # places of each text

    @classmethod
    def of(cls, text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> _Places:
        used = np.flatnonzero(np.bincount(text, minlength=256))
        rank = np.zeros(256, dtype=np.uint8)
        rank[used] = np.arange(len(used))
        size, codes, coded, many = len(used), rank[text], _coded(begin, end, len(text)), end + 1 - begin
        doc, shift = np.repeat(np.arange(len(many), dtype=np.int32), many), max(1, len(many) - 1).bit_length()
        key, n = np.empty(len(doc), dtype=np.int64), 0
        for a in range(6, len(text), PIECE):
            b = min(a + PIECE, len(text))
            some = codes[a - 1 : b - 1] * np.int64(size)
            for d in (2, 3, 4, 5, 6, 0):
                some += codes[a - d : b - d]
                if d:
                    some *= size
            some = some[coded[a:b]]
            key[n : n + len(some)] = some
            n += len(some)
        if size**7 << shift < 1 << 63:
            # one number for the bytes and the text: a plain sort does
            key <<= shift
            key |= doc
            key.sort()
            doc = (key & ((1 << shift) - 1)).astype(np.int32)
            key >>= shift
        else:
            order = np.argsort(key, kind="stable")
            key, doc = key[order], doc[order]
        first = _runs(key)
        left, whole = key[first], np.zeros(len(first), dtype=np.int64)
        for i in range(7):
            left, digit = np.divmod(left, size)
            whole |= used[digit] << (8 * i)
        return cls(whole, first, doc, many)


class _Ids(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        return at


def _hashed_words(joined: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct words of all texts; of each word in turn the place there; words of each text."""
    texts, ids = _split(*joined), _Ids()
    many = np.fromiter(map(len, texts), np.int64, len(texts))
    at = np.fromiter(map(ids.__getitem__, chain.from_iterable(texts)), np.int64, int(many.sum()))
    hashes, to = np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, ids), np.uint64, len(ids)), return_inverse=True)
    return hashes, to[at], many


#: Contexts are dealt out by a hash of the two nearest bytes, words by their own hash; words' parts come after the others.
PARTS, WORD_PARTS = 256, 64


def _context_parts(key: np.ndarray) -> np.ndarray:
    return ((key >> 40) * 0x9E3779B1 >> 16 & (PARTS - 1)).astype(np.uint16)


def _word_parts(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(58)).astype(np.uint16) + np.uint16(PARTS)


def _in_parts(key: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order that brings keys of one part together, and each part with its slice of that order."""
    order = np.argsort(part, kind="stable")
    if not len(part):
        return order, []
    first = _runs(part[order])
    return order, list(zip(part[order][first].tolist(), first.tolist(), [*first[1:].tolist(), len(part)], strict=True))


def _columns(batches, *names: str) -> Iterator[tuple]:
    """Rows of batches as tuples."""
    for batch in batches:
        yield from zip(*(batch.column(k).to_pylist() for k in names), strict=True)


def whole(docs: DataFrame, training: Column, keep: tuple[str, ...] = ("doc_id",), block: int = 8_000_000) -> DataFrame:
    """As ``score`` by a model of the rows for which ``training`` holds, with a node for every context of six bytes that
    occurs in any text, and so without a bound: none is left out or shares an estimate.

    Texts go through in chunks of about ``block`` bytes. A chunk sends its distinct contexts and words, sorted and packed,
    to the parts they belong to; a part adds up all chunks, and sends each the probabilities and counts it asked for, in
    the order in which it asked. So every text is read twice and every answer sent once, whatever the number of contexts.
    Only contexts of two bytes meet on the driver.
    """
    spark = docs.sparkSession
    C.batches(spark, 500)
    keep = list(keep)
    names = [f"`{k}`" for k in keep]
    kept = C.ddl(docs.select(*names))

    def count(batches):
        task = TaskContext.get().partitionId() << 32
        for i, held in enumerate(C.grouped((b for b in batches if len(b)), lambda b: b.column("text").nbytes, block)):
            table = pa.Table.from_batches(held)
            train = np.asarray(table.column("__train")).astype(np.int64)
            joined = _joined(table.column("text").combine_chunks(), 6)
            places = _Places.of(*joined)
            words, at, many = _hashed_words(joined)
            asked = [(places.key, np.add.reduceat(train[places.doc], places.first), _context_parts(places.key)), (words, np.bincount(at, np.repeat(train, many), len(words)).astype(np.int64), _word_parts(words))]
            del places, at, joined
            rows = [(-1, _stream(table.select([*keep, "text"])), _packed(train.sum(keepdims=True)))]
            for key, n, part in asked:
                order, parts = _in_parts(key, part)
                key, n = key[order], n[order]
                rows += [(p, _packed(key[a:b]), _packed(n[a:b])) for p, a, b in parts]
            part, data, more = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), task | i)), pa.array(part, pa.int32()), pa.array(data, pa.binary()), pa.array(more, pa.binary())], names=["chunk", "part", "data", "more"])

    rows = C.dealt(docs.select(*names, docs["text"].cast("string").alias("text"), F.coalesce(training, F.lit(False)).alias("__train")))
    table, table_path = C.written(rows.mapInArrow(count, "chunk long, part int, data binary, more binary"), "chunks", **{"parquet.block.size": 32 << 20})
    ends = [int(_unpacked(r.more, "<i8")[0]) for r in table.where("part = -1").select("more").collect()]
    chunks, end = len(ends), sum(ends)
    asked, cores = table.where("part >= 0"), spark.sparkContext.defaultParallelism

    def up(batches):
        for part, rows in groupby(_columns(batches, "part", "data", "more"), lambda r: r[0]):
            kind = "<i8" if part < PARTS else "<u8"
            key, n = _merged((_unpacked(data, kind), _unpacked(more, "<i8")) for _, data, more in rows)
            found = [("sum", _packed(key), _packed(n), None, None)]
            if part < PARTS:
                found += [("top", *map(_packed, _cells(*run, 6, 2)[0][0])) for run in _slices(key, n)]
            else:
                found.append(("words", _packed(np.array([n.sum(), (n > 0).sum()], dtype=np.int64)), None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(found), pa.int32()), *(pa.array(x, t) for x, t in zip(zip(*found, strict=True), [pa.string()] + 4 * [pa.binary()], strict=True))], names=["part", "what", "w", "x", "y", "z"])

    def by_part(df, *order):
        return df.repartition(max(4 * cores, min(PARTS + WORD_PARTS, chunks // 2)), "part").sortWithinPartitions("part", *order)

    nodes, nodes_path = C.written(by_part(asked.select("part", "data", "more")).mapInArrow(up, "part int, what string, w binary, x binary, y binary, z binary"), "nodes")
    total, distinct = end, int(end > 0)
    for r in nodes.where("what = 'words'").select("w").collect():
        n, some = _unpacked(r.w, "<i8").tolist()
        total, distinct = total + n, distinct + some
    got = [tuple(_unpacked(v, k) for v, k in zip(r, ("<i8", "<f8", "<f8", "<f8"), strict=True)) for r in nodes.where("what = 'top'").select("w", "x", "y", "z").collect()]
    levels, above = [tuple(np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, dtype=np.int64), *np.zeros((3, 0)))], []
    for _ in range(2):
        cell, a, b, ln = levels[0]
        cell, to = np.unique((cell >> 16 << 8) | (cell & 255), return_inverse=True)
        a, b, ln = (np.bincount(to, x, len(cell)) for x in (a, b, ln))
        levels.insert(0, (cell, a, b, math.log(0.5) + np.logaddexp(log_kt(a, b), ln)))
        above.insert(0, to)
    mass, sofar = np.ones(len(levels[0][0])), np.zeros(len(levels[0][0]))
    for level, to in zip(levels[:2], above, strict=True):
        mass, sofar = (x[to] for x in _descend(level, mass, sofar))
    order = np.argsort(levels[2][0])
    top = spark.sparkContext.broadcast(tuple(x[order] for x in (levels[2][0], mass, sofar)))

    def probabilities(key, n):
        """log10 of the next byte's probability at each key."""
        cells, left, given = top.value
        levels, to, at = _cells(key, n, 6, 2)
        here = np.searchsorted(cells, levels[0][0])
        mass, sofar = left[here], given[here]
        for level, places in zip(levels[:-1], to, strict=True):
            mass, sofar = (x[places] for x in _descend(level, mass, sofar))
        _, a, b, _ = levels[-1]
        one = (sofar + mass * (b + 0.5) / (a + b + 1))[at]
        bits = np.stack([(key >> (7 - i)) & 1 for i in range(8)], axis=1)
        return np.log10(np.where(bits == 1, one, 1 - one)).sum(axis=1).astype(np.float32)

    def down(batches):
        for part, rows in groupby(_columns(batches, "part", "chunk", "data", "more"), lambda r: r[0]):
            _, _, data, more = next(rows)  # the sums come first
            key, value = _unpacked(data, "<i8" if part < PARTS else "<u8"), _unpacked(more, "<i8")
            if part < PARTS:
                value = np.concatenate([probabilities(*run) for run in _slices(key, value)])
            for _, chunk, data, _ in rows:
                answer = value[np.searchsorted(key, _unpacked(data, str(key.dtype)))]
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([part], pa.int32()), pa.array([_packed(answer)], pa.binary())], names=["chunk", "part", "data"])

    sums = nodes.where("what = 'sum'").select("part", F.lit(None).cast("long").alias("chunk"), F.col("w").alias("data"), F.col("x").alias("more"))
    answers = by_part(sums.union(asked.select("part", "chunk", "data", F.lit(None).cast("binary"))), F.col("chunk").asc_nulls_first()).mapInArrow(down, "chunk long, part int, data binary")
    none, of_end = math.log10(total + distinct + 1), math.log10(end + 1)

    def add(batches):
        for _, held in groupby(_columns(batches, "chunk", "part", "data"), lambda r: r[0]):
            (_, _, texts), *given = held  # the texts come first, then the answers by part
            table = pa.ipc.open_stream(texts).read_all()
            joined = _joined(table.column("text").combine_chunks(), 6)
            words, at, many = _hashed_words(joined)
            n = np.zeros(len(words), dtype=np.int64)
            n[_in_parts(words, _word_parts(words))[0]] = np.concatenate([n[:0], *(_unpacked(d, "<i8") for _, p, d in given if p >= PARTS)])
            doc, size = np.repeat(np.arange(len(many)), many), len(many)
            known = np.bincount(doc, (n > 0)[at], size).astype(np.int64) + (end > 0)
            base = np.bincount(doc, np.log10(n + 1.0)[at], size) + of_end - (many + 1) * none
            del at, doc
            places = _Places.of(*joined)
            log = np.empty(len(places.key), dtype=np.float32)
            log[_in_parts(places.key, _context_parts(places.key))[0]] = np.concatenate([_unpacked(d, "<f4") for _, p, d in given if p < PARTS])
            score = np.bincount(places.doc, np.repeat(log, np.diff(places.first, append=len(places.doc))), size)
            bits = -score / math.log10(2) / np.maximum(1, places.many - 1)
            yield pa.RecordBatch.from_arrays([*(table.column(k).combine_chunks() for k in keep), pa.array(many + 1), pa.array(known), pa.array(np.full(size, total)), pa.array(base), pa.array(score), pa.array(bits)], names=[*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    both = table.where("part = -1").select("chunk", "part", "data").union(answers)
    scored, _ = C.written(both.repartition(max(4 * cores, chunks // 2), "chunk").sortWithinPartitions("chunk", "part").mapInArrow(add, f"{kept}, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"), "scored")
    top.destroy()
    C.remove(spark, table_path, nodes_path)
    return scored


def op7(docs: DataFrame) -> DataFrame:
    """The whole model: every context has its own node."""
    held = C.remainder("doc_id", 7) == 2
    rows = C.pick(docs, doc_id="long", text="string").select("doc_id", held.alias("held_out"), "text")
    return whole(rows, ~F.col("held_out"), ("doc_id", "held_out"))
