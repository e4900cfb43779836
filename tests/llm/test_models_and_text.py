import math
import re
import zlib
from collections import Counter
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratakit.llm import ann, chat, html, lm


# neighbours


def exact(ids, x, every, k):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[ids == ids[i]] = np.inf
        order = np.lexsort((ids, d))[:k]
        out[int(ids[i])] = [(int(ids[j]), float(d[j])) for j in order if np.isfinite(d[j])]
    return out


@pytest.mark.parametrize("copies", [0, 400])
def test_recall_and_order(spark, copies):
    rng = np.random.default_rng(copies)
    x = np.r_[rng.normal(size=(1500, 12)), np.repeat(rng.normal(size=(1, 12)), copies, axis=0)].astype(np.float32)
    ids = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    got: dict = {}
    # a small sample, so that not every row is known to the tree; groups in partitions of their own, as on many machines
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "false")
    found = ann.search(df, every=50, max_sample=500, shelf=100, block=150).orderBy("query_id", "rank").collect()
    spark.conf.unset("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    for r in found:
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    want = exact(ids, x.astype(float), 50, 10)
    assert sum(len({a for a, _ in got[q]} & {a for a, _ in w}) for q, w in want.items()) >= 0.9 * sum(map(len, want.values()))
    for q, w in want.items():
        assert len(got[q]) == 10
        if {a for a, _ in got[q]} == {a for a, _ in w}:
            assert got[q] == w


def test_neighbours_come_from_visited_leaves(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 12)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    want, found = exact(np.arange(1500), x.astype(float), 50, 10), {}
    # one leaf is asked for, of fewer rows than neighbours: widened, but not to the whole sample, which here is all rows
    for recall, least, most in ((0.0, 0.02, 0.8), (0.97, 0.9, 1.0)):
        got: dict = {}
        for r in ann.search(df, every=50, recall=recall, leaf_size=8, probe=16).collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert all(len(got[q]) == 10 for q in want)
        for q, rows in got.items():
            assert [s for _, s in rows] == pytest.approx([np.sqrt(((x[v].astype(float) - x[q]) ** 2).sum()) for v, _ in rows])
        found[recall] = sum(len({a for a, _ in got[q]} & {a for a, _ in w}) for q, w in want.items()) / 300
        assert least <= found[recall] <= most


def test_vector_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [math.nan, 1.0]), (5, [math.inf, 1.0]), (6, [1.0, None]), (7, [1.0, 0.1]), (None, [1.0, 0.0]), (100, [0.5, 0.5]), (8, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.op6(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 7), (0, 3, 100), (100, 1, 1), (100, 2, 7), (100, 3, 0)]
    assert ann.op6(df.limit(0)).collect() == [] and ann.op6(df.where("vec_id in (1, 7)")).collect() == []
    assert ann.op6(df.where("vec_id = 0")).collect() == []


def test_best_bins_come_first():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 4))
    t = ann.KMeansTree.fit(x, 4, 30)
    leaf = t.assign(x)
    bins = list(t.bins(x[0]))
    assert sorted(set(leaf)) == list(range(t.leaves)) and bins[0][1] == leaf[0]
    assert sorted(b for _, b in bins) == list(range(t.leaves)) and bins == sorted(bins, key=lambda b: b[0])


@pytest.mark.parametrize("rows", [3000, 24_000])
def test_recall_of_the_defaults(spark, rows):
    # below and above the fitting sample
    rng = np.random.default_rng(rows)
    x = (rng.normal(size=(200, 16))[rng.integers(0, 200, rows)] + 0.3 * rng.normal(size=(rows, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.op6(df).cache()
    found: dict = {}
    for r in got.collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    want = exact(np.arange(rows), x.astype(float), 100, 10)
    recall = sum(len(found[q] & {a for a, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))
    assert recall >= 0.9 and abs(ann.measured_recall(df, got) - recall) < 0.05
    got.unpersist()


def test_repeated_vectors_count_once(spark):
    rows = [(0, [0.0, 1.0])] * 3 + [(1, [0.0, 1.0])] * 40 + [(2, [0.0, 2.0])] * 40 + [(i, [float(i), 1.0]) for i in range(3, 20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in ann.op6(df).orderBy("rank").collect()]
    assert got == [(1, 0.0), (2, 1.0)] + [(i, float(i)) for i in range(3, 11)]


# language model


def test_kt_and_gamma():
    x = np.array([0.5, 1, 2.5, 10, 1e5 + 0.5])
    assert lm.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], abs=1e-8)
    p, a, b = 1.0, 0, 0
    for bit in (1, 1, 0, 1):
        p *= ((b if bit else a) + 0.5) / (a + b + 1)
        a, b = a + (not bit), b + bit
    assert math.exp(lm.log_kt(np.array([1.0]), np.array([3.0]))[0]) == pytest.approx(p)


def test_tree_is_a_distribution_and_matches_recursion(spark):
    texts = [b"abracadabra abracadabra", b"abrac"]
    df = spark.createDataFrame([("abracadabra abracadabra",), ("ABRAC",)], "text string")
    t = lm.train(df, depth=2, nodes=10**6).tree
    assert (10.0 ** t.log10.astype(float)).sum(axis=1) == pytest.approx(np.ones(len(t.log10)), abs=1e-5)
    # the first bit of a byte by the recursion of context-tree weighting
    coded = [(b"\xff\xff" + x[:i], c) for x in texts for i, c in enumerate(x + b"\xff")]

    def kt(pairs):
        ones = sum(c >> 7 for _, c in pairs)
        return float(np.exp(lm.log_kt(np.array([float(len(pairs) - ones)]), np.array([float(ones)])))[0])

    def weighted(pairs, depth):
        if depth == 2:
            return kt(pairs)
        parts: dict = {}
        for before, c in pairs:
            parts.setdefault(before[-1 - depth], []).append((before, c))
        own = [x for x in parts.values() if depth == 0 or len(x) >= 2]
        rest = [p for x in parts.values() if not (depth == 0 or len(x) >= 2) for p in x]
        return 0.5 * kt(pairs) + 0.5 * math.prod(weighted(x, depth + 1) for x in own) * kt(rest)

    stop = 0.5 * kt(coded) / weighted(coded, 0)
    ones = sum(c >> 7 for _, c in coded)
    # a byte that never was the last one leaves the tree at the root, whose other child has no counts
    want = stop * (ones + 0.5) / (len(coded) + 1) + (1 - stop) * 0.5
    assert (10.0 ** t.log10[0, 128:].astype(float)).sum() == pytest.approx(want, rel=1e-4)


def test_packed_trees(spark, small):
    m = lm.train(spark.read.parquet(f"{small}/documents.parquet"), depth=4, nodes=500)
    t = lm.Tree.unpack(m.tree.pack())
    assert (t.down == m.tree.down).all() and t.first == m.tree.first and np.abs(t.log10 - np.maximum(m.tree.log10, -7.9)).max() < 2e-4
    assert all(b - a <= 500 for a, b in zip(t.first[3:], t.first[4:], strict=False))


def test_base_model_and_learning(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    seen: Counter = Counter()
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 7 != 2:
            seen.update(r.text.encode().translate(lm.FOLD).split())
            seen[None] += 1
    n, v = sum(seen.values()), len(seen)
    got = {r.doc_id: r for r in lm.op7(docs).collect()}
    for r in rows:
        w = [*r.text.encode().translate(lm.FOLD).split(), None]
        g = got[r.doc_id]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(w), sum(seen[x] > 0 for x in w), n)
        assert g.base_score == pytest.approx(sum(math.log10((seen[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
        assert g.score < 0
    held = [r for r in got.values() if r.held_out]
    assert np.mean([r.bits_per_byte for r in held]) < 3.5


def test_scores_are_products_of_byte_probabilities(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["banana band", "an apple", None, "", "Nab a ban"])], "doc_id long, text string")
    m = lm.train(df, depth=3)
    one = {r.doc_id: r.score for r in lm.score(df.coalesce(1), m).collect()}
    alone = {i: lm.score(df.where(f"doc_id = {i}"), m).first().score for i in range(5)}
    assert one == pytest.approx(alone) and one[2] == one[3]


def test_lm_edges(odd, empty):
    got = lm.op7(odd).collect()
    assert len(got) == odd.count() and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (3, 4, 5)} == {1}
    assert lm.op7(empty).collect() == []


def test_whole_model_is_weighting_over_all_contexts(spark):
    texts = ["abracadabra abracadabra", "abrac", "cadab", None, "zzabra"]
    df = spark.createDataFrame([(i, x, i != 4) for i, x in enumerate(texts)], "doc_id long, text string, train boolean")
    got = {r.doc_id: r.score for r in lm.whole(df, F.col("train"), block=20).collect()}
    raw = [(b"\xff" * 6 + (t or "").encode() + b"\xff") for t in texts]
    places = [(x[i - 6 : i], x[i]) for x in raw[:4] for i in range(6, len(x))]

    def kt(pairs, bit):
        ones = sum(c >> bit & 1 for _, c in pairs)
        return math.exp(lm.log_kt(np.array([float(len(pairs) - ones)]), np.array([float(ones)]))[0])

    def weighted(pairs, depth, bit):
        if depth == 6:
            return kt(pairs, bit)
        parts: dict = {}
        for before, c in pairs:
            parts.setdefault(before[5 - depth], []).append((before, c))
        return 0.5 * kt(pairs, bit) + 0.5 * math.prod(weighted(x, depth + 1, bit) for x in parts.values())

    def log10(before, c):
        total = 0.0
        for bit in range(7, -1, -1):
            pairs = [(x, y) for x, y in places if y >> (bit + 1) == c >> (bit + 1)]
            one, mass = 0.0, 1.0
            for depth in range(7):
                mine = [(x, y) for x, y in pairs if x[6 - depth :] == before[6 - depth :]]
                ones, stop = sum(y >> bit & 1 for _, y in mine), 1.0 if depth == 6 else 0.5 * kt(mine, bit) / weighted(mine, depth, bit)
                one, mass = one + mass * stop * (ones + 0.5) / (len(mine) + 1), mass * (1 - stop)
            total += math.log10(one if c >> bit & 1 else 1 - one)
        return total

    for i, x in enumerate(raw):
        assert got[i] == pytest.approx(sum(log10(x[j - 6 : j], x[j]) for j in range(6, len(x))), rel=1e-5)


def test_passes_do_not_grow_with_contexts(spark, monkeypatch):
    texts = [bytes(np.random.default_rng(i).integers(97, 123, 300, dtype=np.uint8)).decode() for i in range(6)]
    df = spark.createDataFrame([(i, f"{x[:150]} {x[150:]}", i != 4) for i, x in enumerate(texts)], "doc_id long, text string, train boolean").coalesce(2)
    tables: list[str] = []
    written = lm.C.written
    monkeypatch.setattr(lm.C, "written", lambda frame, what, **options: tables.append(what) or written(frame, what, **options))
    got = []
    for block in (1 << 30, 200):
        tables.clear()
        rows = lm.whole(df, F.col("train"), block=block).orderBy("doc_id").collect()
        got.append((list(tables), [(r.n_tokens, r.n_known, r.train_tokens) for r in rows], [x for r in rows for x in (r.base_score, r.score)]))
    assert got[0][:2] == got[1][:2] and got[0][2] == pytest.approx(got[1][2], rel=1e-9)
    assert got[0][1][4] == (3, 1, 15)  # of the text that isn't learned from only the end is known


@pytest.mark.parametrize("docs", [3, 400])
def test_places_of_few_and_of_many_texts(docs):
    # 256 different bytes leave room for 128 texts in a sort of single numbers
    rng = np.random.default_rng(docs)
    texts = [rng.integers(0, 256, n, dtype=np.uint8) for n in (600, *rng.integers(0, 9, docs - 1))]
    joined = [np.r_[np.full(6, lm.EDGE), x, [lm.EDGE]].astype(np.uint8) for x in texts]
    begin = np.cumsum([0, *map(len, joined[:-1])]) + 6
    got = lm._Places.of(np.concatenate(joined), begin, begin + [len(x) for x in texts])
    want = Counter((int.from_bytes(bytes([*x[i - 6 : i][::-1], x[i]]), "big"), d) for d, x in enumerate(joined) for i in range(6, len(x)))
    of = np.repeat(got.key, np.diff(got.first, append=len(got.doc)))
    assert Counter(zip(of.tolist(), got.doc.tolist(), strict=True)) == want
    assert (np.diff(got.key) > 0).all() and got.many.tolist() == [len(x) + 1 for x in texts]


def test_merged_counts_and_packed_arrays():
    rng = np.random.default_rng(3)
    arrays = [np.unique(rng.integers(0, 500, 200), return_counts=True) for _ in range(20)]
    key, n = lm._merged(iter(arrays), least=300)
    want: Counter = Counter()
    for k, m in arrays:
        want.update(dict(zip(k.tolist(), m.tolist(), strict=True)))
    assert dict(zip(key.tolist(), n.tolist(), strict=True)) == want and (np.diff(key) > 0).all()
    for x in (key, n.astype(np.float32), np.array([2**64 - 1], dtype=np.uint64), np.zeros(0)):
        assert (lm._unpacked(lm._packed(x), x.dtype.str) == x).all()


def test_contexts_beyond_a_bound_count(spark):
    letters = [np.random.default_rng(i % 5).integers(0, 26, 4000) for i in range(15)]
    df = spark.createDataFrame([(i + 3, "".join(chr(97 + int(c)) for c in x)) for i, x in enumerate(letters)], "doc_id long, text string")
    bounded = lm.score(df, lm.train(df, nodes=8192)).agg(F.sum("score")).first()[0]
    got = lm.whole(df, F.lit(True)).agg(F.sum("score")).first()[0]
    assert got > 0.7 * bounded


# chat


def test_roles_are_recovered(spark, small):
    turns = spark.read.parquet(f"{small}/conversations.parquet")
    got = chat.op3(turns).join(turns, ["conv_id", "turn"]).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == turns.count() and np.mean([r.role == r.role_pred for r in held]) > 0.8


def test_spans_do_not_change_roles(spark, small, monkeypatch):
    turns = spark.read.parquet(f"{small}/conversations.parquet").where("conv_id < 30")
    model = chat.train(turns)
    whole = sorted(map(tuple, chat.format_turns(turns, model).select("conv_id", "turn", "role_pred").collect()))
    monkeypatch.setattr(chat, "SPAN", 2)
    assert sorted(map(tuple, chat.format_turns(turns, model).select("conv_id", "turn", "role_pred").collect())) == whole


def test_markers_and_rendering(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", ("Human: q" if t % 2 == 0 else "### Assistant: yes it is")) for c in range(6) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_turns(df, chat.train(df)).where("conv_id = 0").orderBy("turn").collect()
    assert [r.rendered for r in got[:2]] == ["<|user|>\nq\n<|end|>", "<|assistant|>\nyes it is\n<|end|>"]


def test_chat_edges(spark):
    rows = [(1, 0, None, None), (1, 0, "user", "a"), (1, None, "user", ""), (None, 0, "system", "b"), (None, None, None, "x" * 100_000), (2, 5, "user", "a"), (2, 5, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("rendered", F.lit(1))
    assert chat.op3(df).count() == len(rows) and chat.op3(df.limit(0)).collect() == []
    nobody = df.withColumn("role", F.lit(None).cast("string"))
    assert {r.role_pred for r in chat.op3(nobody).collect()} == {None}


# pages

PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var t="</p>";</script><style>p{}</style></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></nav><div id="cookie-notice">We use cookies on this site to help you.</div><div class="ad">Buy this now.</div>
<article><h1>Title &amp; more</h1><p>First   paragraph<br>goes&nbsp;on <a href=x>with a link</a> to &lt;b&gt;.<p>Second <b>one.<form>Name <input></form><div class="comments"><p>Great post, I really liked every bit of it!</p></div></article>
<aside>Hi there</aside><footer>&copy; 2020</footer>"""


@pytest.fixture(scope="module")
def tree():
    return html.labelled_tree()


def test_tree_fits_its_table(tree):
    rows = html.labelled_rows()
    assert sum(html.decide(tree, row[:-1]) == row[-1] for row in rows) > 0.95 * len(rows)
    # words and links decide, not the mark alone
    assert {html.FEATURES[f] for f in used(tree)} > {"links+0", "words+0", "words+1", "mark"}


def used(tree):
    return {tree[0]} | used(tree[2]) | used(tree[3]) if isinstance(tree, tuple) else set()


def by_hand(page):
    """The article of a page of the table, by its layout alone: what stands between the tags, markup taken out."""
    inside = page[page.index("<article>") + 9 : page.index("</article>")]
    parts = [" ".join(unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", inside)]
    return "\n\n".join(x for x in parts if x)


def test_pages_by_brute_force(spark, small, tree):
    pages = spark.read.parquet(f"{small}/pages.parquet").collect()
    want = {r.page_id: by_hand(r.html) for r in pages}
    assert {r.page_id: r.text for r in html.op10(spark.read.parquet(f"{small}/pages.parquet")).collect()} == want
    # without the marks of tags and classes nearly every word of an article is still found, and little else
    hit = kept = all_ = 0
    for r in pages:
        a, b = want[r.page_id].split("\n\n"), html.main_text(r.html, tree, marked=False).split("\n\n")
        hit += sum(len(x.split()) for x in a if x in b)
        all_ += sum(len(x.split()) for x in a)
        kept += sum(len(x.split()) for x in b)
    assert hit > 0.98 * all_ and hit > 0.98 * kept


def test_page_that_marks_nothing(tree):
    """Only divs and paragraphs, no class, no tag that names a region."""
    a, b, c = ("one two three four five six seven eight nine ten " * n for n in (6, 4, 7))
    menu = "".join(f"<div><a href=/{i}>Go {i}</a></div>" for i in range(6))
    tags = "".join(f"<div><a href=/t{i}>tag {i}</a></div>" for i in range(4))
    page = f"<body>{menu}<div>A head line of several plain words</div><p>{a}</p><p>{b} <a href=x>with a link</a> in it</p><div>Short.</div><p>{c}</p>{tags}</body>"
    assert html.main_text(page, tree) == "\n\n".join(["A head line of several plain words", a.strip(), f"{b.strip()} with a link in it", "Short.", c.strip()])
    linked = "".join(f"<div><a href=/{i}>read more about thing {i}</a> today</div>" for i in range(8))
    assert html.main_text(f"<body><p>{a}</p><p>{b}</p>{linked}</body>", tree) == f"{a.strip()}\n\n{b.strip()}"


def test_repeated_pages_and_clashing_names(spark):
    rows = [(1, "u", PAGE, "x", 5), (1, "u", PAGE, "x", 5), (None, None, "", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = html.op10(pages).collect()
    assert len(got) == 3 and got[0] == got[1] and (got[2].text, got[2].n_chars) == ("", 0)
    kept = html.extract(pages, keep=("page_id", "text", "html")).first()
    assert kept.text.startswith("Title & more") and kept.html == PAGE


def test_main_text(tree):
    assert html.main_text(PAGE, tree) == "Title & more\n\nFirst paragraph goes on with a link to <b>.\n\nSecond one."


@pytest.mark.parametrize(("page", "want"), [(None, ""), ("", ""), ("<!-- only -->", ""), ("plain text only here <b", "plain text only here"), ("<nav>" + "<a>x</a> " * 9 + "</nav>", ""), ("<article><p>a", "a"), ("<article><p>x &am</article>", "x &am"), ("<script>never ends", "")])
def test_page_edges(tree, page, want):
    assert html.main_text(page, tree) == want


def test_marks(tree):
    page = """<div class="site-header"><p>The name of this site</p></div><article class="post"><div class="entry-header"><h1>A head line</h1></div><p class="lead">The lead.</p><div class="entry-content"><p>Body of it.</p></div>
    <div class="post-footer">Filed under things</div></article><article class="comment"><p>I am a reader with an opinion.</p></article><section id="Comments"><article><p>So am I, and at length.</p></article></section>
    <div role="alert">Mind this.</div><div class="newsletterSignup"><p>Get our letters every week.</p></div>"""
    assert html.main_text(page, tree) == "A head line\n\nThe lead.\n\nBody of it."


def test_page_without_article(tree):
    body = "word " * 30
    page = f"<div class=nav><a href=1>a</a> <a href=2>b</a></div><h1>Head line</h1><p>{body}</p><p>Short.</p><p>{body}</p><ul><li><a>x y</a><li><a>z</a></ul>"
    assert html.main_text(page, tree) == "\n\n".join(["Head line", body.strip(), "Short.", body.strip()])


def test_pages_table(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = html.op10(pages.withColumn("text", F.lit(1)).unionByName(pages.limit(1).withColumn("html", F.lit(None).cast("string")).withColumn("text", F.lit(1)))).collect()
    assert len(got) == pages.count() + 1 and all(r.n_chars == len(r.text) for r in got) and sum(r.text == "" for r in got) == 1
    assert html.op10(pages.limit(0)).collect() == []


def test_long_markup_is_read_in_linear_time(tree):
    assert html.main_text("<p>" + "<b " * 20_000 + 'x="' * 5000, tree) is not None
    assert len(html.main_text("<article>" + "<div>" * 3000 + "deep " * 10, tree)) == 49
