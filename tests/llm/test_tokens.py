"""Token counts and token files against the libraries themselves."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from glossator.llm import huffman, tokencount, tokenfile

ODD = [None, "", " ", "a", "A  b\n\n c\t\td ", "it's  we'll 'tis 's ''s !'s", "<|endoftext|> x<|startoftext|>y", "x<|endoftext|>", "ΑΣ ΣΑΣ ς İstanbul ǅ", "é café ́x", "a\x1cb\x1d!\x1e? \x85 x\x85y", "a b c　d", "日本語 text 한국어 \U0001f680\U0001f680", "x" * 30000, "ab " * 20000, " \n x \n\ny", "tab\tx \t y", "1234 56 7٣٤ ½", "­ soft", " lead", "trail ", "\r\nwin\r\n", "don't DON'T 'LL", "a \u0085b", "z q"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(ODD)] + [(3, "a", "x", 3), (None, "null id", None, None)], "doc_id long, text string, n_tokens string, start long")


@pytest.mark.parametrize("name", ["documents", "odd"])
def test_counts(spark, sf, odd, name):
    docs = odd if name == "odd" else spark.read.parquet(f"{sf}/documents.parquet")
    path = public_tokenizers.path("word_bpe_49k.json")
    got = sorted(map(tuple, tokencount.count_tokens(docs, path).collect()), key=str)
    t = Tokenizer.from_file(path)
    rows = docs.select("doc_id", "text").collect()
    n = [len(e.ids) for e in t.encode_batch([r.text or "" for r in rows], add_special_tokens=False)]
    want = sorted(((r.doc_id, len((r.text or "").encode()), k, k > 2048) for r, k in zip(rows, n)), key=str)
    assert got == want


def test_counts_empty(spark, odd):
    assert tokencount.count_tokens(odd.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_whole_tokens_are_proven():
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, t = tokencount.whole_tokens(path), Tokenizer.from_file(path)
    assert len(whole) > 20000
    assert all(len(t.encode(w, add_special_tokens=False).ids) == 1 for w in sorted(whole)[::50])


@pytest.mark.parametrize("name", ["documents", "odd"])
def test_files(spark, sf, odd, name, monkeypatch):
    monkeypatch.setattr(tokenfile, "FILE_IDS", 40000)
    docs = odd if name == "odd" else spark.read.parquet(f"{sf}/documents.parquet")
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = sorted(map(tuple, tokenfile.token_output(docs, path).collect()), key=lambda r: r[1])
    t = Tokenizer.from_file(path)
    rows = [(r.doc_id, t.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in docs.select("doc_id", "text").collect()]
    assert [g[0] for g in got] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k))
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted((str(g[0]), g[2], g[3]) for g in got) == sorted((str(k), len(ids), crc(ids)) for k, ids in rows)
    assert [g[1] for g in got] == np.cumsum([0] + [g[2] for g in got])[:-1].tolist()


def test_several_files_a_task(spark, sf, monkeypatch):
    monkeypatch.setattr(tokenfile, "FILE_IDS", 40000)
    docs, path = spark.read.parquet(f"{sf}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json")
    many = tokenfile.token_output(docs, path).collect()
    monkeypatch.setattr(tokenfile, "MOST_PARTS", 3)
    assert sorted(tokenfile.token_output(docs, path).collect()) == sorted(many)


WORDS = ["a", "the", "The", " ", " ", "  ", "\n", "\t", "'s", "'", "é", "中", "文字", "\U0001f680", "<|endoftext|>", "\x00", "\x1f", "\u3000", "\r\n", "12", "...", "supercalifragilistic", "x" * 30, "word"]


@pytest.fixture(scope="module")
def encoder():
    mp = pytest.MonkeyPatch()
    mp.setattr(tokenfile, "REMEMBERED", 300)  # so that tables fill up, and joins are many
    mp.setattr(tokenfile, "LIBRARY_BYTES", 100)
    mp.setattr(tokenfile, "LIBRARY_CHARS", 20)
    yield tokenfile.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    mp.undo()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.lists(st.sampled_from(WORDS), max_size=30).map("".join)), min_size=1, max_size=12))
def test_words_are_the_librarys(encoder, texts):
    ids, n = encoder.encode(pa.array(texts, pa.string()), 2)
    want = [e.ids + [2] for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want


def test_files_empty(spark, odd):
    assert tokenfile.token_output(odd.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_cut_file_is_refused():
    lengths = huffman.code_lengths(np.array([3, 1, 2]))
    data = tokenfile.pack_part(np.array([1]), np.array([0]), np.array([4]), np.array([0, 1, 2, 0]), lengths, huffman.canonical(lengths))
    assert tokenfile.unpack_part(data, huffman.table_of(lengths))[3].tolist() == [0, 1, 2, 0]
    with pytest.raises(ValueError):
        tokenfile.unpack_part(data[:-1], huffman.table_of(lengths))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=3000), st.integers(6, 16))
def test_huffman_round_trip(ids, limit):
    ids = np.array(ids, np.int64) ** 2 % 53
    counts = np.bincount(ids, minlength=60)
    lengths = huffman.code_lengths(counts, limit)
    assert (lengths[counts > 0] > 0).all() and lengths.max(initial=0) <= limit
    assert sum(2.0 ** -int(x) for x in lengths[counts > 0]) <= 1
    stream, checkpoints = huffman.encode(ids, lengths, huffman.canonical(lengths))
    assert huffman.decode(stream, checkpoints, len(ids), huffman.table_of(lengths)).tolist() == ids.tolist()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 10**6), min_size=2, max_size=60))
def test_lengths_are_optimal(counts):
    import heapq

    counts = np.array(counts)
    heap = [(int(c), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    total, k = 0, len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        total += a[0] + b[0]
        heapq.heappush(heap, (a[0] + b[0], k))
        k += 1
    assert int((huffman.code_lengths(counts, 40) * counts).sum()) == total
