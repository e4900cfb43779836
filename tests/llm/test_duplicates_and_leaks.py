import hashlib
import random
import time

import numpy as np
import pytest

from stratakit.llm import _common as C
from stratakit.llm import decontam, minhash


def brute_groups(rows, width, percent):
    def shingles(text):
        w = (text or "").encode().translate(minhash.FOLD).split()
        k = min(width, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    sets, top = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for n in (1, 2, 3, 8, 30, 90, 250):
        base = [rng.choice(words) for _ in range(n)]
        for _ in range(rng.randint(2, 9)):
            t = list(base)
            for _ in range(rng.randint(0, 5)):
                t[rng.randrange(n)] = rng.choice(words)
            texts.append(" ".join(t))
    base = [rng.choice(words) for _ in range(150)]
    for _ in range(40):  # a chain of links, each to the next
        base = [*base[2:], rng.choice(words), rng.choice(words)]
        texts.append(" ".join(base))
    base = [rng.choice(words) for _ in range(200)]
    for _ in range(40):  # a group of which many pairs are just too different
        t = list(base)
        for _ in range(rng.randint(2, 12)):
            t[rng.randrange(200)] = rng.choice(words)
        texts.append("  ".join(t).upper())
    texts += ["", None, " \n"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "width", "percent"), [(1, 3, 85), (2, 5, 80)])
def test_groups_equal_brute_force(spark, seed, width, percent):
    rows = corpus(seed)
    want = brute_groups(rows, width, percent)
    got = minhash.groups(spark.createDataFrame(rows, "doc_id long, text string"), width, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want


def brute_rows(rows, width, percent):
    """As brute_groups, of rows with repeated ids: rows of one id are linked."""
    nodes = brute_groups([(i, t) for i, (_, t) in enumerate(rows)], width, percent)
    top = {d: d for d, _ in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, (_, part, _) in nodes.items():
        x, y = find(rows[i][0]), find(rows[part][0])
        top[max(x, y)] = min(x, y)
    return sorted((d, nodes[i][0], find(d), find(d) == d) for i, (d, _) in enumerate(rows))


def test_repeated_ids_equal_brute_force(spark):
    # one id with two texts, of equal and of unequal length, each with near copies under other ids
    a, b = [f"a{i:02d}" for i in range(60)], [f"b{i:02d}" for i in range(60)]
    rows = [(1, " ".join(a)), (1, " ".join(b)), (5, " ".join(a[:59] + ["x00"])), (7, " ".join(["x01"] + a[1:])), (6, " ".join(b[:59] + ["x00"])), (8, " ".join(["x01"] + b[1:]))]
    assert [r[2] for r in brute_rows(rows, 3, 85)] == [1] * 6
    longer = [(d + 200, t + " longer" * (d == 1 and t[0] == "b")) for d, t in rows]
    mixed = [(d % 90 + 300, t) for d, t in corpus(5)]  # many ids twice, with unlike texts
    some = [*rows, *longer, *mixed]
    got = minhash.op2(spark.createDataFrame(some, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute_rows(some, 3, 85)


def test_frequent_keys_are_dealt_out(spark):
    left = spark.createDataFrame([(1 if i % 3 else None if i % 5 == 0 else i, i) for i in range(600)], "k long, x long")
    right = spark.createDataFrame([(i, i * 2) for i in range(0, 600, 2)] + [(1, 7)], "k long, y long")
    for how in ("inner", "left"):
        out = C.spread(left, right, ["k"], "x", 600, left.groupBy("k").count().withColumnRenamed("count", "n"), how, parts=16)
        assert sorted(map(tuple, out.select("k", "x", "y").collect()), key=str) == sorted(map(tuple, left.join(right, "k", how).select("k", "x", "y").collect()), key=str)
    pieces = C.spread(left, right, ["k"], "x", 600, left.groupBy("k").count().withColumnRenamed("count", "n"), parts=16)
    assert "__piece" in pieces._jdf.queryExecution().toString()


def test_group_edges(spark, odd, empty):
    got = minhash.op2(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[2].component_id == 1 and not by[2].kept and by[1].kept
    assert by[3].n_shingles == by[4].n_shingles == by[5].n_shingles == 0 and by[4].kept and by[5].component_id == 5
    assert by[None].component_id is None and by[None].kept and by[8].kept
    assert minhash.op2(empty).collect() == []
    left = minhash.keep_one(odd)
    assert left.columns == odd.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(["1", "3", "4", "5", "6", "7", "8", "9", "10", "None"])


def test_one_outside_a_bucket_is_still_found_in_others(spark, monkeypatch):
    # y shares 88 shingles with x, of a bucket where y is of the largest component, and 2 with w, of one where it isn't;
    # the hub of both buckets, of one shingle, is like none of them
    y, own = [f"y{i}" for i in range(100)], [f"w{i}" for i in range(98)]
    texts = {0: ["hub"], 1000: y[:88], 2000: y, 3000: y[98:] + own}
    keys = {0: [1, 2], 1000: [1, 3], 2000: [1, 2], 3000: [2, 4]}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    signed = spark.createDataFrame([(i, len(t), str(i).encode(), keys[i], [0]) for i, t in texts.items()], "doc_id long, n_shingles int, digest binary, keys array<long>, sketch array<long>")
    monkeypatch.setattr(minhash, "sign", lambda *_: signed)
    got = {r.doc_id: r.component_id for r in minhash.groups(df, width=1, percent=85, bands=2, rows=1).collect()}
    assert got == {0: 0, 1000: 1000, 2000: 1000, 3000: 3000}


def test_components_of_paths_and_stars(spark):
    rng = np.random.default_rng(3)
    ids = rng.permutation(200)
    path = [(int(a), int(b)) for a, b in zip(ids[:120], ids[1:121], strict=False)]
    star = [(int(ids[130]), int(x)) for x in ids[131:180]]
    got = {r.node: r.component for r in minhash.components(spark.createDataFrame(path + star, "u long, v long")).collect()}
    for part in (ids[:121], ids[130:180]):
        low = int(part.min())
        assert all(got[int(x)] == low for x in part if x != low)


def test_circulant_signature_turns_one_permutation():
    c = minhash.Circulant(4, 3)
    s = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64))
    numbers = c.turns[:, 0]
    places = c.scatter[(s % minhash.CIRCLE).astype(np.int64)]
    want = [numbers[(places + k) % minhash.CIRCLE].min() for k in range(12)]
    assert c.signature(s).tolist() == want
    assert c.sketch(c.signature(s)).view(np.uint8).tolist() == [(a & 15) << 4 | b & 15 for a, b in zip(want[0::2], want[1::2], strict=True)] + [0] * 2


def test_differing_coordinates(spark):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 16, (2, 48)).astype(np.uint32)
    c = minhash.Circulant(12, 4)
    df = spark.createDataFrame([(c.sketch(a).tolist(), c.sketch(b).tolist())], "a array<long>, b array<long>")
    assert df.select(minhash.differing(df.a, df.b)).first()[0] == (a != b).sum()


def brute_leaks(docs, items, size=10):
    known = [("null" if i is None else str(i), decontam.words_of(t)) for i, t in items]
    out = []
    for text in docs:
        w, hit, found = decontam.words_of(text), set(), set()
        for name, iw in known:
            n = min(size, len(iw))
            for s in range(len(iw) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == iw[s : s + n]:
                        hit.update(range(p, p + n))
                        found.add(name)
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize(("size", "block", "shard"), [(3, 10**6, 10**6), (4, 5, 10**6), (3, 10**6, 1)])
def test_leaks_equal_brute_force(spark, size, block, shard):
    rng = random.Random(size)
    letters = ["a", "b", "c", "D", "é"]
    items = [(i, " ".join(rng.choice(letters) for _ in range(rng.choice([0, 2, 3, 6, 9])))) for i in range(12)] + [(None, "b c a d")]
    docs = [" ".join(rng.choice([*letters, "zz", "y"]) for _ in range(rng.randint(0, 30))) for _ in range(50)] + ["", None, "..."]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.scan(d, b, size=size, block_words=block, shard_words=shard).collect()}
    assert [got[i] for i in range(len(docs))] == brute_leaks(docs, items, size)


def test_longest_matches_and_their_places(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    d = spark.createDataFrame([(1, f"start {item} end {item[8:]}"), (2, "one two three")], "doc_id long, text string")
    got = {r.doc_id: r for r in decontam.scan(d, spark.createDataFrame([(7, item)], "item_id long, text string"), spans=True).collect()}
    assert got[1].longest_match == 12 and [(s.start, s.words, s.item_id, s.item_start) for s in got[1].spans] == [(1, 12, "7", 0), (14, 10, "7", 2)]
    assert got[2].spans == [] and not got[2].contaminated


def test_longest_matches_equal_brute_force():
    rng = random.Random(4)
    items = [("i%d" % i, [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.choice([2, 5, 9, 30]))], 0) for i in range(8)]
    tests = decontam.TestBlock.build(items, 4)
    docs = [[rng.choice([b"a", b"b", b"c", b"z"]) for _ in range(rng.randint(0, 60))] + items[i % 8][1] for i in range(30)]
    found = decontam.search_shard([np.array([tests.vocabulary.get(w, 0) for w in d], dtype=np.int32) for d in docs], tests)
    mine = {(d, s): (n, item, at) for d, s, n, item, at in found.spans.tolist()}

    def agree(d, s, words, at):
        n = 0
        while s + n < len(d) and at + n < len(words) and d[s + n] == words[at + n]:
            n += 1
        return n

    for i, d in enumerate(docs):
        best = []
        for s in range(len(d)):
            reach = [agree(d, s, words, at) if agree(d, s, words, at) >= min(4, len(words)) else 0 for _, words, _ in items for at in range(len(words))]
            best.append(max(reach))
        for s, n in enumerate(best):
            head = n > 0 and (s == 0 or best[s - 1] == 0 or n >= best[s - 1])
            assert ((i, s) in mine) == head
            if head:
                size, item, at = mine[i, s]
                assert size == n == agree(d, s, items[item][1], at)


def test_a_text_of_one_word_is_searched_in_linear_time():
    tests = decontam.TestBlock.build([("x", [b"w"] * 1000, 0), ("y", [b"w"] * 400 + [b"v"], 0)], 10)
    began = time.perf_counter()
    found = decontam.search_shard([np.ones(1_000_000, dtype=np.int32), np.zeros(5, dtype=np.int32)], tests)
    assert found.hit.sum() == 1_000_000 and found.pairs.tolist() == [[0, 0], [0, 1]]
    assert found.spans[:, 2].max() == 1000 and time.perf_counter() - began < 60


def test_leak_edges(spark, odd, empty):
    items = spark.createDataFrame([(1, "this is the end"), (2, None), (3, "")], "item_id long, text string")
    got = decontam.op5(odd, items).collect()
    assert len(got) == odd.count() and {r.doc_id for r in got if r.contaminated} == {1, 2}
    assert decontam.op5(empty, items).collect() == [] and not any(r.contaminated for r in decontam.op5(odd, items.limit(0)).collect())
    left = decontam.clean(odd, items)
    assert left.columns == odd.columns and left.count() == odd.count() - 2


def test_a_shard_holds_little():
    import inspect
    import tracemalloc

    tests = decontam.TestBlock.build([(str(i), [b"%d" % (i * 7 + j) for j in range(40)], 0) for i in range(50)], 10)
    words = np.random.default_rng(1).integers(0, 60, inspect.signature(decontam.scan).parameters["shard_words"].default).astype(np.int32)
    tracemalloc.start()
    decontam.search_shard([words], tests)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20


def test_freed_arrays_go_back_to_the_system():
    import subprocess
    import sys

    code = """
import numpy as np
from stratakit.llm import _common
_common.held("one", dict)
for mb in (8, 16, 24, 30):
    np.ones(mb << 17)
rows = [np.ones(2 << 17) for _ in range(60)]
rss = lambda: int(open("/proc/self/statm").read().split()[1]) * 4 >> 10
before = rss()
del rows[::2]
print(before - rss())
"""
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=60).stdout) > 40
