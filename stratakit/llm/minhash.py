"""Near-duplicate groups by circulant MinHash.

Two permutations make a whole signature: the first scatters a document's shingles over a circle of 2**20 places;
the second numbers the places, and coordinate k of the signature is the least number found after a turn of the
circle by k. Bands of coordinates propose pairs; a bit of every coordinate tells, far beyond doubt, which of them are
too different; full shingle sets decide the rest.

Documents with equal sets form a class, for which its smallest doc_id stands. In each bucket of a band the members
are compared with one of them, the hub, not with each other. Where a bucket then still holds several components, the
members outside its largest are looked at: most share too few shingles with all other candidates together to be
linked with any; only the rest is compared with the bucket's members. Every link between members of a bucket is found
that way, while a group of copies is joined after the first hub.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _common as C

FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
CIRCLE = 1 << 20


class _Hashes(dict):
    """Word to a 64-bit hash, remembered for the first ``most`` words."""

    def __init__(self, most: int = 150_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.most:
            self[word] = value
        return value


def shingle_set(text: str | None, width: int, hashes: _Hashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of ``width`` words; of all words, if they are fewer."""
    found = text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []
    if not found:
        return np.zeros(0, dtype=np.uint64)
    words = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, 0x9E3779B97F4A7C15 + width, dtype=np.uint64)
    for i in range(width):
        out ^= words[i : i + n]
        out *= np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
    return np.unique(out)


class Circulant:
    """bands x rows signature coordinates from two permutations."""

    def __init__(self, bands: int, rows: int, seed: int = 20):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.scatter = rng.permutation(CIRCLE).astype(np.int64)
        numbers = rng.permutation(CIRCLE).astype(np.uint32)
        self.turns = np.lib.stride_tricks.sliding_window_view(np.r_[numbers, numbers[: bands * rows]], bands * rows)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        places = self.scatter[(shingles & np.uint64(CIRCLE - 1)).astype(np.int64)]
        out = self.turns[places[:4096]].min(axis=0)
        for i in range(4096, len(places), 4096):
            out = np.minimum(out, self.turns[places[i : i + 4096]].min(axis=0))
        return out

    def keys(self, signature: np.ndarray) -> np.ndarray:
        """A 64-bit bucket key for each band."""
        out = np.arange(1, self.bands + 1, dtype=np.uint64)
        for column in signature.reshape(self.bands, self.rows).T.astype(np.uint64):
            out = (out ^ column) * np.uint64(0x9FB21C651E98DF25)
            out ^= out >> np.uint64(29)
        return out.view(np.int64)

    def sketch(self, signature: np.ndarray) -> np.ndarray:
        """The last four bits of each coordinate, 16 coordinates a 64-bit word."""
        out = np.zeros(-(-len(signature) // 16) * 16, dtype=np.uint8)
        out[: len(signature)] = signature & 15
        return (out[0::2] << 4 | out[1::2]).view(np.int64)


def most_differing(percent: int, coordinates: int) -> int:
    """So many coordinates differ between sketches of sets at the threshold with a chance under 1e-7 only."""
    p = percent / 100 + (1 - percent / 100) / 16
    return int(np.ceil(coordinates * (1 - p) + 5.3 * np.sqrt(coordinates * p * (1 - p))))


def differing(a, b):
    """How many coordinates two sketches differ in; Columns of array<long>."""

    def four(x, y):
        v = x.bitwiseXOR(y)
        v = v.bitwiseOR(F.shiftrightunsigned(v, 2))
        return F.bit_count(v.bitwiseOR(F.shiftrightunsigned(v, 1)).bitwiseAND(F.lit(0x1111111111111111)))

    return F.aggregate(F.zip_with(a, b, four), F.lit(0), lambda s, x: s + x)


def sign(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, digest (of the set; null if it is empty), keys, sketch."""
    C.batches(docs.sparkSession)

    def run(batches):
        circle, hashes = C.held(("circulant", bands, rows), lambda: (Circulant(bands, rows), _Hashes()))
        for batch in batches:
            n, digests, keys, sketches = [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingle_set(text, width, hashes)
                n.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                if len(found):
                    signature = circle.signature(found)
                    keys.append(circle.keys(signature))
                    sketches.append(circle.sketch(signature))
                else:
                    keys.append(np.zeros(0, dtype=np.int64))
                    sketches.append(np.zeros(0, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), ragged(keys), ragged(sketches)], names=["doc_id", "n_shingles", "digest", "keys", "sketch"])

    return C.dealt(docs).mapInArrow(run, "doc_id long, n_shingles long, digest binary, keys array<long>, sketch array<long>")


def ragged(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)))


def verify(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b; a written table) of which 100 * intersection >= percent * union, on full sets; texts: doc_id,
    text, a row an id."""
    C.batches(pairs.sparkSession, 256, 8)
    joined = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    joined = C.spread(joined, texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), ["a"], "b", pairs.count(), pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))).select("a", "b", "ta", "tb")

    def run(batches):
        hashes, sets = C.held("hashes", _Hashes), OrderedDict()

        def of(doc_id, text):
            if (found := sets.get(doc_id)) is None:
                found = sets[doc_id] = shingle_set(text, width, hashes)
                if len(sets) > 64:
                    sets.popitem(last=False)
            return found

        for batch in batches:
            keep = []
            for a, b, ta, tb in zip(*(batch.column(k).to_pylist() for k in ("a", "b", "ta", "tb")), strict=True):
                x, y = of(a, ta), shingle_set(tb, width, hashes)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v. Every node of an edge but the smallest of its component, with that: node, component. A written table.

    Large-star and small-star steps in turn until the edges form stars; each step's edges are a written table. The edges
    of a node with many are dealt out in pieces, each with the node's least neighbour.
    """
    spark = edges.sparkSession

    def to_least(now, size):
        """u, v, m: the least of v over the edges of u; each edge once."""
        least, path = C.written(now.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")
        return C.spread(now, least.select("u", "m"), ["u"], "v", size, least.select("u", "n")), path

    now, path = C.written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        # stars: no node is both an end and a centre, and every end has one edge
        ends = now.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        centres = now.select(F.col("v").alias("u")).distinct().withColumn("centre", F.lit(True))
        if not ends.join(centres, "u", "left").where("n > 1 or centre").take(1):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        size = now.count()
        both = now.union(now.select("v", "u"))
        large, least = to_least(both, 2 * size)
        large, large_path = C.written(large.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct(), "edges")
        small, least_small = to_least(large, large.count())
        new = small.select("u", F.col("m").alias("v")).union(small.select("v", "m")).where("u <> v").distinct()
        old = path
        now, path = C.written(new, "edges")
        C.remove(spark, old, least, large_path, least_small)


def only(texts: DataFrame, ids: DataFrame, places: int = 1 << 18) -> DataFrame:
    """The rows of ``texts`` whose doc_id is in ``ids`` (doc_id). Hashes of the ids, ``places`` at most, are broadcast to
    drop most other rows before the texts are dealt out."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(places)).cast("int")
    near = texts.withColumn("__place", place).join(F.broadcast(ids.select(place.alias("__place")).distinct()), "__place", "left_semi").drop("__place")
    return near.join(ids, "doc_id", "left_semi")


def supported(pool: DataFrame, asked: DataFrame, texts: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """What shingles documents share. pool: doc_id, c (component); asked: doc_id, most (a component).

    For each document asked doc_id, shared: how many of its shingles another document of the pool has. And for each
    row asked doc_id, most, within: how many of its shingles that component has.
    """

    def shingles(batches):
        hashes = C.held("hashes", _Hashes)
        for batch in batches:
            sets = [shingle_set(t, width, hashes) for t in batch.column("text").to_pylist()]
            ids = np.repeat(np.array(batch.column("doc_id").to_pylist(), dtype=np.int64), [len(x) for x in sets])
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(flat)], names=["doc_id", "shingle"])

    rows, path = C.written(only(texts, pool.select("doc_id"), 1 << 18).select("doc_id", "text").mapInArrow(shingles, "doc_id long, shingle long"), "shingles")
    cells, cells_path = C.written(rows.join(pool, "doc_id").groupBy("c", "shingle").agg(F.count(F.lit(1)).alias("n")), "cells")
    common, common_path = C.written(cells.groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 1"), "common")
    size = rows.count()
    mine = rows.join(asked.select("doc_id").distinct(), "doc_id", "left_semi")
    mine = C.spread(mine, common.select("shingle"), ["shingle"], "doc_id", size, common)
    shared, shared_path = C.written(mine.groupBy("doc_id").agg(F.count(F.lit(1)).alias("shared")), "shared")
    own, own_path = C.written(rows.join(asked, "doc_id"), "own")
    often = own.groupBy("most", "shingle").agg(F.count(F.lit(1)).alias("n"))
    own = C.spread(own, cells.select(F.col("c").alias("most"), "shingle"), ["most", "shingle"], "doc_id", own.count(), often)
    within, within_path = C.written(own.groupBy("doc_id", "most").agg(F.count(F.lit(1)).alias("within")), "within")
    C.remove(rows.sparkSession, path, cells_path, common_path, own_path)
    return shared, within


def groups(docs: DataFrame, width: int = 5, percent: int = 80, bands: int | None = None, rows: int | None = None) -> DataFrame:
    """docs: doc_id, text. A row for each: doc_id, n_shingles, component_id, kept.

    Texts without words, and null texts, have an empty set and are linked with nothing. Rows with one doc_id are one
    document, linked by any of their texts; each row has the size of its own text's set. A null doc_id is linked with
    nothing: its component_id is null and it is kept. An empty table gives no rows. Unless given, bands and rows are 44
    and 8 from 85 % on, 40 and 7 below: a pair at 85 % is missed with a chance under 1e-6, at 80 % under 1e-4.
    """
    spark = docs.sparkSession
    bands, rows = bands or (44 if percent >= 85 else 40), rows or (8 if percent >= 85 else 7)
    docs = C.pick(docs, doc_id="long", text="string")
    if not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").take(1):
        return _groups(docs, width, percent, bands, rows)
    # repeated ids: each row is a node of its own; afterwards the components that share an id are one
    number = F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())
    numbered, path = C.written(docs.withColumn("node", number), "numbered")
    found = _groups(numbered.select(F.col("node").alias("doc_id"), "text"), width, percent, bands, rows)
    found = numbered.select("node", "doc_id").join(found.where("doc_id is not null").select(F.col("doc_id").alias("node"), "n_shingles", F.col("component_id").alias("part")), "node")
    found, found_path = C.written(found, "found")
    parts, parts_path = C.written(found.groupBy("part").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "parts")
    held, held_path = C.written(found.select("doc_id", "part").distinct(), "held")
    ids, ids_path = C.written(held.groupBy("doc_id").agg(F.min("part").alias("first"), F.count(F.lit(1)).alias("n")), "ids")
    linked = C.spread(held, ids.select("doc_id", "first"), ["doc_id"], "part", held.count(), ids.select("doc_id", "n"))
    stars = components(linked.select(F.col("part").alias("u"), F.col("first").alias("v")))
    rooted, rooted_path = C.written(parts.join(stars.withColumnRenamed("node", "part"), "part", "left").select("part", "n", "low", F.coalesce("component", "part").alias("root")), "rooted")
    lows, lows_path = C.written(rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("m")), "lows")
    ends = C.spread(rooted, lows.select("root", "component_id"), ["root"], "part", rooted.count(), lows.select("root", F.col("m").alias("n")))
    out = C.spread(found, ends.select("part", "component_id"), ["part"], "node", found.count(), parts.select("part", "n"))
    out = out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    nulls = sign(numbered.where("doc_id is null").select("doc_id", "text"), width, bands, rows)
    out, _ = C.written(out.union(nulls.select("doc_id", "n_shingles", F.col("doc_id"), F.lit(True))), "groups")
    C.remove(spark, path, found_path, parts_path, held_path, ids_path, rooted_path, lows_path)
    return out


def _groups(docs: DataFrame, width: int, percent: int, bands: int, rows: int) -> DataFrame:
    """As ``groups``, of documents with an id each."""
    spark = docs.sparkSession
    signed, signed_path = C.written(sign(docs, width, bands, rows), "signed")
    known = signed.where("digest is not null and doc_id is not null")
    # a class is one set; equal sets are brought together before they are dealt out
    least = known.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "keys", "sketch")).alias("s"), F.count(F.lit(1)).alias("copies"))
    sets, sets_path = C.written(least.select("digest", "copies", F.col("s.doc_id").alias("rep"), F.col("s.n_shingles").alias("n"), "s.keys", "s.sketch"), "sets")
    buckets = sets.select("rep", "n", F.explode("keys").alias("key"))
    hubs, hubs_path = C.written(buckets.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("hub"), F.count(F.lit(1)).alias("in_it")).where("in_it > 1"), "hubs")
    members = C.spread(buckets, hubs.select("key", "hub"), ["key"], "rep", sets.count() * bands, hubs.select("key", F.col("in_it").alias("n")))
    members, members_path = C.written(members.where("rep <> hub.rep").select("key", "rep", "n", "hub"), "members")

    def near(n, m):
        return (F.least(n, m) * 100 >= F.greatest(n, m) * percent)

    most = most_differing(percent, bands * rows)
    sketches = sets.select("rep", "sketch")
    proposed, proposed_path = C.written(members.where(near(F.col("n"), F.col("hub.n"))).select(F.col("hub.rep").alias("a"), F.col("rep").alias("b")).distinct(), "proposed")
    pairs = proposed.join(sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("sb")), "b")
    pairs = C.spread(pairs, sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("sa")), ["a"], "b", proposed.count(), proposed.groupBy("a").agg(F.count(F.lit(1)).alias("n")))
    tried, tried_path = C.written(pairs.where(differing(F.col("sa"), F.col("sb")) <= most).select("a", "b"), "pairs")
    texts = docs.where("doc_id is not null and text is not null")

    def decided(pairs):
        wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
        return verify(pairs, only(texts, wanted), width, percent).select(F.col("a").alias("u"), F.col("b").alias("v"))

    stars = components(decided(tried))

    # what the hubs leave open: buckets with members of several components
    labelled, labelled_path = C.written(members.select("key", "rep", "n").join(stars.withColumnRenamed("node", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component"), "labelled")
    parts = labelled.groupBy("key", "c").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("n"))
    mixed = parts.groupBy("key").agg(F.max_by("c", F.struct("k", "c")).alias("most"), F.min("n").alias("least"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.sum("k").alias("in_it")).where("lo < hi").select("key", "most", "least", "in_it")
    mixed, mixed_path = C.written(mixed, "mixed")
    open_ = C.spread(labelled, mixed.select("key", "most", "least"), ["key"], "rep", labelled.count(), mixed.select("key", F.col("in_it").alias("n")))
    open_, open_path = C.written(open_, "open")
    # of two members of different components one at least isn't in its bucket's largest: only these ask. One that shares
    # fewer shingles with all others together than a link with the smallest partner takes has no link, neither as asker
    # nor in a bucket where it is of the largest component and asked: the smallest partner is that of all its buckets
    outside = open_.where("c <> most").withColumnRenamed("rep", "doc_id")
    askers = open_.groupBy(F.col("rep").alias("doc_id")).agg(F.first("n").alias("n"), F.min("least").alias("least"), F.bool_or(F.col("c") != F.col("most")).alias("asks")).where("asks").drop("asks")
    shared, within = supported(open_.select(F.col("rep").alias("doc_id"), "c").distinct(), outside.select("doc_id", "most").distinct(), texts, width)
    needed = (F.col("n") + F.greatest(F.col("least"), F.ceil(F.col("n") * percent / 100))) * percent
    judged, judged_path = C.written(askers.join(shared, "doc_id", "left").select(F.col("doc_id").alias("rep"), F.coalesce("shared", F.lit(0)).alias("shared"), (F.coalesce("shared", F.lit(0)) * (100 + percent) >= needed).alias("able")), "judged")
    left = open_.join(judged, "rep", "left").where("able is null or able").withColumn("shared", F.coalesce("shared", "n")).join(sets.select("rep", "keys", "sketch"), "rep")
    left = left.join(within.withColumnRenamed("doc_id", "rep"), ["rep", "most"], "left")
    x = left.where("c <> most").select("key", F.coalesce("within", F.lit(0)).alias("wa"), F.col("rep").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"), F.col("keys").alias("ka"), F.col("sketch").alias("sa"), F.col("shared").alias("ma"))
    y = left.select(F.col("key").alias("at"), F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"), F.col("keys").alias("kb"), F.col("sketch").alias("sb"), F.col("shared").alias("mb"), (F.col("c") == F.col("most")).alias("still"))
    # a pair of several buckets is taken from the first
    enough = F.least("ma", "mb", F.when(F.col("still"), F.col("wa")).otherwise(F.col("ma"))) * (100 + percent) >= (F.col("na") + F.col("nb")) * percent
    once = (F.col("ca") != F.col("cb")) & (F.col("still") | (F.col("a") < F.col("b"))) & near(F.col("na"), F.col("nb")) & enough & (differing(F.col("sa"), F.col("sb")) <= most) & (F.array_min(F.array_intersect("ka", "kb")) == F.col("key"))
    pairs = x.join(y, (F.col("key") == F.col("at")) & once).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs, pairs_path = C.written(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
    if pairs.take(1):
        stars = components(stars.select(F.col("node").alias("u"), F.col("component").alias("v")).union(decided(pairs)))
    # copies take their class's component
    ends = sets.select("digest", "copies", "rep").join(stars.withColumnRenamed("node", "rep"), "rep", "left").select("digest", "copies", F.coalesce("component", "rep").alias("component_id"))
    ends, ends_path = C.written(ends, "ends")
    rows_ = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    found = C.spread(rows_, ends.select("digest", "component_id"), ["digest"], "doc_id", signed.count(), ends.select("digest", F.col("copies").alias("n")), "left")
    found, _ = C.written(found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")), "groups")
    C.remove(spark, open_path, judged_path, pairs_path, tried_path, members_path, sets_path, hubs_path, proposed_path, labelled_path, mixed_path, signed_path, ends_path)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op2(docs: DataFrame) -> DataFrame:
    return groups(docs, width=3, percent=85)


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group, with its own columns: the one with the smallest doc_id. Of rows with one doc_id the
    one whose text comes first stays (nulls last; among equal texts that with the least hash of the row). Rows with a
    null doc_id all stay, and so does every document without words whose id is its own. An empty table stays empty."""
    found = groups(docs)
    dropped = found.where("not kept").select("doc_id").distinct()
    left = docs.join(dropped, "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))
    if not found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").take(1):
        return left
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    hashed = F.xxhash64(*(F.to_json(F.struct(F.col(f"`{c}`"))) for c in docs.columns))
    first = left.where("doc_id is not null").groupBy("doc_id").agg(F.min_by(row, F.struct(F.col("text").isNull(), F.col("text"), hashed)).alias("row"))
    return first.select("row.*").unionByName(left.where("doc_id is null"))
