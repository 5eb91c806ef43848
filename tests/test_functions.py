"""Texts, words, passages, codecs and files on their own."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glossator.functions import codecs, texts, vectors, words
from glossator.functions.encoders import HashingEncoder, batches_of, embed, query_segments
from glossator.functions.words import chunk_pages, chunks, plain_count, split_by_character, split_words
from glossator.models import MODELS, clamp, positive
from glossator.sources import files

SENTENCE = "The court of cassation held in 1999 that the clause, n. 286, was void between the parties. "


def one(spark, c, **columns):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in columns.items())).select(c.alias("x")).first().x


def test_normalize(spark):
    n = lambda t: one(spark, texts.normalize_page(F.col("t")), t=t)
    assert n("exam-\n ple  of\ttext\x00 here ") == "example of text here"
    assert n("exam\xad\nple") == "example" and n("Anglo-\nSaxon") == "Anglo- Saxon"
    assert n("a b﻿c\xa0d​e") == "a b c d e"
    assert one(spark, texts.clean(F.col("t")), t="exam\xad\nple co-\nop") == "exam\xad ple coop"


def test_excerpt_and_labels(spark):
    assert one(spark, texts.excerpt(F.col("t"), 12), t="one two three four") == "one two…"
    assert one(spark, texts.excerpt(F.col("t"), 50), t=" one  two ") == "one two"
    assert one(spark, texts.truncated(F.col("t"), 3), t="abcd") == "abc…"
    assert one(spark, texts.page_label(F.lit(4), F.lit(True))) == "≈5"
    assert one(spark, texts.citation(F.lit("A"), F.lit(""), F.lit("T"), F.lit(2))) == "A, T, p. 3"
    assert one(spark, texts.prompt(F.lit("[QUERY]: [TEXT]"), F.lit("q"), F.lit("t"))) == "q: t"
    assert one(spark, texts.identifier(F.lit("https://doi.org/10.1000/AbC-1"))) == "10.1000/abc1"
    assert one(spark, texts.isbns(F.lit("978-3-16-148410-0, 12; 0306406152"))) == ["9783161484100", "0306406152"]
    assert one(spark, texts.pages_of(F.lit("a\fb\f"))) == ["a", "b", ""]
    assert one(spark, texts.hyphens_restored(F.lit("a\x02b"))) == "a-\nb"


@pytest.mark.parametrize("day,want", [("2024-02-29", "2024-02-28 23:00:00"), ("2024-02-31", None), ("2024-1-1", None), ("x", None), (None, None)])
def test_since(spark, day, want):
    got = one(spark, texts.since_utc(F.lit(day).cast("string"), "Europe/Rome").cast("string"))
    assert got == want


def test_split_words():
    w = lambda t: [x for x, _, _ in split_words(t)]
    assert w("foo. Bar") == ["foo", ".", "Bar"] and w("n. 286") == ["n", ".286"]
    assert w("abc日本x") == ["abc", "日", "本", "x"] and w("a​b") == ["ab"] and w("1999. x") == ["1999.", "x"]
    assert w("🚀🚀 ok") == ["🚀", "🚀", "ok"] and w("") == []
    assert all("foo  bar, 12 日"[s:e].replace(" ", "") == x for x, s, e in split_words("foo  bar, 12 日"))


@settings(max_examples=400, deadline=None)
@given(st.text("aZé.,|1 9\n\t\xa0\u3000ªº²$*日🚀\u200b\u0301©ﬁ", max_size=40))
def test_fast_split(text):
    assert split_words(text) == split_by_character(text)


def test_chunks_of_pages():
    pages = [SENTENCE * 40, "A short lead. " + SENTENCE * 25, ""]
    got = chunk_pages(pages, plain_count, 126)
    joined = "\n".join(pages)
    assert all(c["pieces"] <= 126 and sum(plain_count(w) for w, _, _ in split_words(c["text"])) == c["pieces"] for c in got)
    assert [w for p in pages for w, _, _ in split_words(p)] == [w for c in got for w, _, _ in split_words(c["text"])]
    assert {c["page"] for c in got} == {0, 1} and all(c["text"].endswith(".") for c in got[:-1])
    assert all(joined[c["char_start"] :].startswith(c["text"][:10]) for c in got)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab. 1é日🚀\n", max_size=120), max_size=4), st.integers(3, 30))
def test_chunks_keep_every_word(pages, most):
    got = chunk_pages(pages, plain_count, most)
    assert sum(c["pieces"] for c in got) == sum(plain_count(w) for p in pages for w, _, _ in split_words(p))


def test_utf16_offsets(spark):
    df = spark.createDataFrame([(["🚀 x. " + SENTENCE * 20],), (None,)], "pages array<string>").select(chunks(40)("pages").alias("c")).collect()
    assert [c.char_start_utf16 - c.char_start for c in df[0].c[:3]] == [0, 1, 1] and df[1].c == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(-60000, 60000, width=32), min_size=1, max_size=40))
def test_f16(values):
    v = np.array(values, np.float32)
    assert (codecs.decode_f16(codecs.encode_f16(v)) == v.astype(np.float16).astype(np.float32)).all()
    assert codecs.encode_f16([np.inf, 1e9, np.nan])[:4] == np.array([np.inf, np.inf], "<f2").tobytes()


def test_quantize_and_norm(spark):
    df = spark.createDataFrame([([3.0, -4.0, 0.0],), ([0.0, 0.0, 0.0],)], "v array<double>")
    a, b = df.select(vectors.quantized8(F.col("v")).alias("q"), vectors.norm(F.col("v")).alias("n"), vectors.unit(F.col("v")).alias("u")).collect()
    assert list(a.q.q) == [95, -127, 0] and a.n == 5 and list(b.q.q) == [0, 0, 0] and b.n == 1 and b.q.scale == 1e-9
    assert one(spark, vectors.half_up(F.lit(-0.5))) == 0 and one(spark, vectors.round_to(F.lit(0.12345), 4)) == 0.1235
    assert one(spark, vectors.from_json_vector(F.lit("[[1, 2]]"))) == [1, 2] and one(spark, vectors.from_json_vector(F.lit("{x"))) is None


def test_encoder(spark):
    e = HashingEncoder(64)
    assert (e.encode(["a b", ""]) == e.encode(["a b", ""])).all() and abs(np.linalg.norm(e.encode(["a b"])) - 1) < 1e-6
    df = spark.createDataFrame([(i, f"text number {i}") for i in range(50)] + [(50, None)], "id long, text string")
    got = {r.id: r.embedding for r in embed(df, "text", e, "passage: ").collect()}
    assert np.allclose(got[7], e.encode(["passage: text number 7"])[0]) and len(got) == 51
    assert sorted(i for b in batches_of([5, 9000, 8000, 9, 20000]) for i in b) == [0, 1, 2, 3, 4]
    assert all(len(b) == 1 or len(b) * 9000 <= 16384 * 2 for b in batches_of([5, 9000, 8000]))
    assert len(query_segments("short", e, "hash64")) == 1 and len(query_segments(SENTENCE * 30, e, "hash64")) > 2


def test_index_file():
    v = np.arange(12, dtype=np.int8).reshape(3, 4)
    data = files.pack_index("db", [("k1", "a.pdf"), ("k2", "b.pdf")], [1, 2, 3], [0, -1, 1], [0, 1, 0], [0.5, 0, 1], v)
    x = files.unpack_index(data, "db", 4)
    assert x["rowids"].tolist() == [1, 2, 3] and (x["vectors"] == v).all() and x["docs"] == [("k1", "a.pdf"), ("k2", "b.pdf")]
    assert files.unpack_index(data, "other", 4) is None and files.unpack_index(data[:-1], "db", 4) is None and files.unpack_index(b"xx", "db", 4) is None
    more = files.pack_index("db", [("k2", "b.pdf"), ("k3", "c.pdf")], [4, 5], [1, 0], [0, 1], [1, 1], v[:2])
    both = files.unpack_index(files.appended(data, more, "db", 4), "db", 4)
    assert both["documents"].tolist() == [0, -1, 1, 2, 1] and len(both["docs"]) == 3
    assert files.appended(None, more, "db", 4) is None


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("page one\fpage two")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    got = {r.path.rpartition("/")[2]: r for r in files.extracted(files.read_bytes(spark, str(tmp_path))).collect()}
    assert got["a.txt"].pages == ["page one", "page two"] and got["b.txt"].pages is None and "UnicodeDecodeError" in got["b.txt"].error
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "x.ssvi").write_bytes(files.pack_index("db", [("k", "f")], [7, 8], [0, -1], [2, 3], [1, 0], np.zeros((2, 4))))
    rows = files.read_index(files.read_bytes(spark, str(tmp_path / "i")), "db", 4).collect()
    assert [(r.rowid, r.id, r.section_number) for r in rows] == [(7, "k", 2)]
    assert files.preferences('user_pref("a.b", true);\nx\nuser_pref("c", "d");\nuser_pref(bad);') == {"a.b": True, "c": "d"}
    head = b'{"w": {"shape": [1]}}'
    assert files.tensor_header(len(head).to_bytes(8, "little") + head) == {"w": {"shape": [1]}}
    with pytest.raises(ValueError):
        files.tensor_header(bytes(8))


def test_settings():
    assert clamp(500, 1, 100, 10) == 100 and clamp(None, 1, 100, 10) == 10 and clamp(float("nan"), 0, 5, 1) == 1
    assert positive(-1, 5) == 5 and positive(2, 5) == 2 and MODELS["e5-small"].dim == 384


def test_spans_are_the_words():
    """Words found by arrays of code points are those of the plain loop, and passages those of words counted one by one."""
    r = random.Random(3)
    letters = "abcXYZéß .,;!?)]… \t\n﻿​\x00\x1cЖдعअกABC中文漢ひカ한글🚀👍©019-—|$+‍\U00010330ªⅧ́"
    for n in [0, 1, 2, 5, 40, 200] * 60:
        text = "".join(r.choice(letters if r.random() < 0.5 else "ab .") for _ in range(n))
        start, end, length = (x.tolist() for x in words.word_spans(words._codes(text)))
        want = split_by_character(text)
        assert list(zip(start, end, length)) == [(s, e, len(w)) for w, s, e in want]
        by_count = lambda w: plain_count(w)  # noqa: E731  # another function, so words are split and counted one by one
        assert chunk_pages([text, "", text[:3]], plain_count, 5) == chunk_pages([text, "", text[:3]], by_count, 5)


def test_words_are_not_made_one_by_one(monkeypatch):
    monkeypatch.setattr(words, "split_words", None)
    assert len(chunk_pages([SENTENCE * 1000], plain_count, 126)) > 50
