import random
import zlib

import numpy as np
import pytest

from stratakit.llm import tokenfile, tokens

tokenizers = pytest.importorskip("tokenizers")
ALPHABET = "ab \n\t'sé½1., ​\x85 日!\x1c<|"


@pytest.fixture(scope="module")
def library(vocab):
    return tokenizers.Tokenizer.from_file(vocab)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    fixed = ["", "a", "aaaaaaaaaaaaa" * 9, "hi <|endoftext|> there<|endoftext|>", "a\x1cb \x1d c", "  a  b\n\n c\t\t d  x　y z\x85q", "it's they'LL we'd I'm", "日本語のテキスト", "😀😀 é́ ½²", "\n\n", "   ", " \n x", "a\r\n b", "\x00\x01 \x0b v", "ab" * 20000, "<|endoftext", "|> x"]
    return fixed + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 60))) for _ in range(1500)]


def test_counts_are_the_librarys(vocab, library, texts):
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    small = tokens.Counter(tokens.RankMerger(vocab), most=10)
    assert small(texts) == want and small(texts) == want


def test_ids_are_the_librarys(vocab, library, texts):
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for most in (5, 10**6):
        encode = tokenfile.Encoder(vocab, most)
        for _ in range(2):
            assert [np.frombuffer(x, dtype="<u4").tolist() for x in encode(texts)] == want


def test_merged_symbols_are_the_librarys(vocab, library):
    words = [w.encode() for w in ("hello", " world", "aaaa", "é", " antidisestablishmentarianism")]
    ids, n = tokens.RankMerger(vocab).merge(words)
    assert np.split(ids, np.cumsum(n)[:-1])[3].tolist() == library.encode("é", add_special_tokens=False).ids
    assert n.tolist() == [len(library.encode(w.decode(), add_special_tokens=False).ids) for w in words]


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000, 600_000])
def test_shards_round_trip(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 50000, n).astype(np.uint32)
    ids[ids % 17 == 0] = 2**32 - 1
    ids[256:512] = 7
    sizes = np.array([n - n // 2, n // 2])
    doc_ids, back, got = tokenfile.decode_shard(tokenfile.encode_shard(ids, [-5, None], sizes))
    assert doc_ids == [-5, None] and (back == sizes).all() and (got == ids).all()
    with pytest.raises(ValueError):
        tokenfile.decode_shard(b"\0" * 56)


def test_blocks_are_patched():
    ids = np.r_[np.arange(1000, 1250), [4_000_000_000] * 6].astype(np.uint32)
    _, width, packed, many, place, values = tokenfile._encode_blocks(ids.reshape(1, 256), 95)
    assert width.tolist() == [8] and len(packed) == 32 and many.tolist() == [6] and place.tolist() == list(range(250, 256)) and (values == 4_000_000_000 - 1000).all()


def expected(rows, library):
    start, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("shard", [10, 10**7])
def test_files_hold_all_documents_in_order(spark, vocab, library, odd, shard):
    from stratakit.llm import _common

    folder = _common.fresh_path(spark, "tokens")
    manifest = tokenfile.write(odd, vocab, folder, partitions=3, shard_values=shard)
    got = tokenfile.read(spark, folder, manifest, with_ids=True).collect()
    want = expected([(r.doc_id, r.text) for r in odd.collect()], library)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == want
    assert all(len(r.ids) == r.n_tokens and r.ids[-1] == 2 for r in got)
    assert manifest.count() > 1 if shard == 10 else True


def test_whole_table(spark, vocab, library, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokenfile.op9(docs, vocab).collect()), key=lambda r: r[1])
    assert got == expected([(r.doc_id, r.text) for r in docs.collect()], library)
    counts = {r.doc_id: r for r in tokens.op4(docs, vocab).collect()}
    assert all(counts[d].n_tokens == n - 1 and counts[d].over_limit == (n - 1 > 1024) for d, _, n, _ in got)


def test_edges(odd, empty, vocab):
    got = {r.doc_id: r for r in tokens.op4(odd, vocab).collect()}
    assert (got[4].n_bytes, got[4].n_tokens, got[4].over_limit) == (0, 0, False) and got[6].over_limit
    assert tokens.op4(empty, vocab).collect() == [] and tokenfile.op9(empty, vocab).collect() == []
