import math
import re
import zlib

import duckdb
import pytest

from stratakit.llm import langid, mixing


def test_language_held_out_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = langid.op1(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in got)


def test_language_edges(odd, empty):
    got = langid.op1(odd).collect()
    assert len(got) == odd.count()
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert und == {3, 4, 5, 7} and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert langid.op1(empty).collect() == []
    nobody = odd.selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r.lang_pred for r in langid.op1(nobody).collect()} == {"und"}
    assert langid.keep_known(odd).columns == odd.columns and langid.keep_known(empty).count() == 0
    predicted = langid.predict(odd, langid.train(odd))
    assert predicted.count() == odd.count() and len(predicted.columns) == len(set(predicted.columns))


def test_backoff_goes_to_shorter_grams(spark):
    df = spark.createDataFrame([("aaaa bbbb aaab", "x"), ("zzzz yyyy zzzy", "z")] * 3, "text string, lang string")
    m = langid.train(df)
    assert langid.classify(["aaabb", "zyzyzy", "aaaa", "q"], m)[0][:3] == ["x", "z", "x"]
    assert "aaaa" in m.words.index and "aaabb" not in m.words.index


def test_long_runs_count_to_their_end(spark):
    df = spark.createDataFrame([("aaaa bbbb aaab", "x"), ("zzzz yyyy zzzy", "z")] * 3, "text string, lang string")
    m = langid.train(df)
    assert langid.classify(["ab" * 250 + "zy" * 5000, "zy" * 250 + "ab" * 5000], m)[0] == ["z", "x"]
    # no false ends: the mean is that of all grams
    assert m.score_word("ab" * 1000 + "b") == pytest.approx(m.score_word("ab" * 100_000 + "b"), abs=0.05)
    runs = spark.createDataFrame([("ab" * 250 + "cd" * 300, "x"), ("zy" * 250 + "wv" * 300, "z")] * 3, "text string, lang string")
    learned = langid.train(runs)
    assert langid.classify(["cdcdcd", "wvwvwv"], learned)[0] == ["x", "z"]
    assert "abcdc" in learned.grams[0].index and "babc" in learned.grams[1].index and "b$" not in learned.grams[3].index


def test_mix_equals_sql(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    a = mixing.op8(docs).toPandas().sort_values("doc_id").reset_index(drop=True)
    b = duckdb.sql(mixing.SQL.format(docs=f"'{small}/documents.parquet'")).df().sort_values("doc_id").reset_index(drop=True)
    assert a.equals(b[a.columns.tolist()])
    assert (a.taken <= 3 * a["size"]).all()
    by = a.merge(docs.select("doc_id", "source").toPandas()).groupby("source").agg({"taken": "sum", "target": "first"})
    assert ((by.target - by.taken).abs() < 1).all()
    again = mixing.op8(docs.repartition(7)).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert a.equals(again)


def test_targets_stop_and_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 500), (None, 1)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    # weights 5, 2, 1, 5: a and null stop at 30 and 3, b gets at most 300, c the rest
    assert got["a"] == 30 and got[None] == 3 and got["b"] == 300 and got["c"] == 611 - 333


def test_mix_edges(odd, empty):
    got = mixing.op8(odd).collect()
    assert len(got) == odd.count() and all(r.taken <= 3 * r.size for r in got)
    assert {r.taken for r in got if r.doc_id in (3, 4, 5)} == {0}
    assert mixing.op8(empty).collect() == []
    out = mixing.apply(odd)
    assert out.columns == odd.columns
    assert sum(len((r.text or "").split()) for r in out.collect()) == sum(r.taken for r in got)


def test_cut_documents_keep_their_first_words(spark):
    df = spark.createDataFrame([(i, f"w{i} x  y\nz", s) for i, s in enumerate(["a"] * 9 + ["b"] * 2)], "doc_id long, text string, source string")
    taken = {r.doc_id: r.taken for r in mixing.op8(df).collect()}
    out = mixing.apply(df).collect()
    for i, n in taken.items():
        mine = [r.text for r in out if r.doc_id == i]
        assert sum(len(t.split()) for t in mine) == n and all(t.split() == f"w{i} x y z".split()[: len(t.split())] for t in mine)


@pytest.mark.parametrize("range_rows", [1, 20])
def test_ranges_do_not_change_the_mix(spark, small, range_rows):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = ["doc_id", "__taken"]
    assert sorted(mixing.mix(docs, range_rows=range_rows).select(columns).collect()) == sorted(mixing.mix(docs).select(columns).collect())


def learned(train):
    """Counts of words and grams as dicts: what word-first backoff learns, written out."""
    langs = sorted({lang for _, lang in train})
    seen: dict = {}
    for t, lang in train:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            for o in (0, 5, 4, 3, 2, 1):
                p = f"^{w}$"
                for g in [w] if o == 0 else [p[i : i + o] for i in range(len(p) - o + 1)]:
                    seen.setdefault(o, {}).setdefault(g, dict.fromkeys(langs, 0))[lang] += 1
    total = {(o, lang): sum(c[lang] for c in m.values()) + 0.5 * len(m) for o, m in seen.items() for lang in langs}
    return langs, seen, total


def by_hand(langs, seen, total, text):
    """Every gram looked at."""
    sums = dict.fromkeys(langs, 0.0)
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    for w in words:
        for o in (0, 5, 4, 3, 2, 1):
            p = f"^{w}$"
            found = [g for g in ([w] if o == 0 else [p[i : i + o] for i in range(len(p) - o + 1)]) if g in seen[o]]
            if found:
                for lang in langs:
                    sums[lang] += sum(math.log((seen[o][g][lang] + 0.5) / total[o, lang]) for g in found) / len(found)
                break
    best = max(langs, key=lambda x: (sums[x], [-ord(c) for c in x]))
    return (best, 1 / sum(math.exp(sums[x] - sums[best]) for x in langs)) if words else ("und", 0.0)


def test_language_equals_brute_force(spark, small):
    rows = [(r.doc_id, (r.text or "")[:400] if r.text is not None else None, r.lang) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    train = [(t, lang) for d, t, lang in rows if zlib.crc32(str(d).encode()) % 3 != 1 and t is not None and lang is not None]
    got = langid.op1(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    texts = {d: t for d, t, _ in rows}
    assert len(got) == len(rows)
    known = learned(train)
    for r in got:
        want, score = by_hand(*known, texts[r.doc_id])
        assert r.lang_pred == want and r.score == pytest.approx(score, abs=1e-3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_mix_of_clashing_columns_and_one_id(spark):
    rows = [(None if i % 3 else 5, f"w{i} " * (i % 7 + 1), "a" if i % 4 else "b", i, i, "x", "y", 1, 2) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target long, start long, s string, r string, source_size long, n long")
    got = mixing.mix(df, range_rows=10).collect()
    assert len(got) == 300 and all(r.target == r.start for r in got)
    for source in "ab":
        mine = [r for r in got if r.source == source]
        size = sum(r.__getitem__("__size") for r in mine)
        assert {r["__source_size"] for r in mine} == {size} and sum(r["__taken"] for r in mine) == int(mine[0]["__target"])
    # what is taken doesn't depend on the ranges
    assert sorted(map(tuple, mixing.mix(df).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert sum(r["__taken"] for r in got) == sum(len(r.text.split()) for r in mixing.apply(df).collect())
    assert mixing.mix(df.limit(0)).collect() == []
