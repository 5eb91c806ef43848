"""WordPiece and Unigram against the library that has them too."""

import random

import pytest
import tokenizers as lib
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import models, normalizers, pre_tokenizers

from glossator.functions import tokenizers as own
from glossator.functions.words import chunk_pages

WORDS = "the then there here where house mouse un able do doing undo straße groß müller 东京 北 東 x".split()
PIECES = ["[UNK]", "[CLS]", "[SEP]", *sorted({w[:k] for w in WORDS for k in range(1, 4)}), *sorted({"##" + w[k : k + n] for w in WORDS for k in range(1, 5) for n in (1, 2, 3) if w[k : k + n]})]


@pytest.fixture(scope="module")
def word_piece():
    return own.WordPiece({p: i for i, p in enumerate(PIECES)})


def test_word_piece(word_piece):
    theirs = models.WordPiece({p: i for i, p in enumerate(PIECES)}, unk_token="[UNK]", max_input_chars_per_word=100)
    rng = random.Random(4)
    words = WORDS + ["".join(rng.choice("theruosdngwblé") for _ in range(rng.randrange(1, 14))) for _ in range(800)] + ["t" * 100]
    for w in words:
        assert word_piece.pieces(w) == [t.id for t in theirs.tokenize(w)], w
    assert word_piece.pieces("é" * 60) == [0] == word_piece.pieces("t" * 101)  # by bytes, not characters


def test_encode_has_borders_and_a_limit(word_piece):
    ids = word_piece.encode("the " * 300)
    assert len(ids) == 128 and ids[0] == 1 and ids[-1] == 2
    assert word_piece.encode("") == [1, 2] and word_piece.encode("the the", 3)[1:-1] == word_piece.pieces("the")
    assert [(a, z) for _, a, z in word_piece.tokens(" the  mouse")][:1] == [(1, 4)]


def scores():
    rng = random.Random(2)
    words = [own.SPACE + w for w in WORDS]
    subs = sorted({w[a:z] for w in words for a in range(len(w)) for z in range(a + 1, len(w) + 1)} - {"北"})
    return [("<unk>", 0.0), ("<s>", 0.0), ("</s>", 0.0)] + [(p, -rng.uniform(1, 4) - 3.0 / len(p)) for p in subs]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(WORDS), st.text("thernouésd北東ﬁ①Ａ", max_size=9)), max_size=8))
def test_unigram(words):
    theirs = lib.Tokenizer(models.Unigram(scores(), unk_id=0, byte_fallback=False))
    theirs.normalizer = normalizers.NFKC()
    theirs.pre_tokenizer = pre_tokenizers.Metaspace()
    mine = own.Unigram(scores(), 0, 1, 2)
    text = " ".join(w for w in words if w)
    assert mine.ids(text) == (theirs.encode(" ".join(text.split())).ids if text.strip() else [])
    assert mine.encode(text, 6) == [1, *mine.ids(text)[:4], 2]


def test_unigram_specials():
    mine = own.Unigram(scores(), 0, 1, 2, {"<s>": 1, "</s>": 2})
    assert mine.ids("the</s> mouse") == mine.ids("the") + [2] + mine.ids("mouse")
    assert mine.ids(" \n ") == []


def trie(pairs):
    """A double array of a few keys, each node's children at an offset of their own."""
    units, pool, nodes = [0] * 4096, b"", {b"": 0}
    at, free = {b"": 0}, 256
    keys = {k[:i] for k, _ in pairs for i in range(len(k) + 1)}
    ends = dict(pairs)
    for node in sorted(keys, key=len):
        kids = sorted({k[len(node)] for k in keys if len(k) > len(node) and k.startswith(node)})
        base, free = free, free + 256
        own_unit = (units[at[node]] & 0xFF) if node else 0
        offset = base ^ at[node]
        assert offset < 1 << 21
        units[at[node]] = own_unit | offset << 10 | (node in ends) << 8
        if node in ends:
            units[base] = (1 << 31) | len(pool)
            pool += ends[node].encode() + b"\0"
        for c in kids:
            at[node + bytes([c])] = base ^ c
            units[base ^ c] = c
    import struct

    return struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + pool


def test_chars_map():
    m = own.CharsMap(trie([("ﬁ".encode(), "fi"), ("Ａ".encode(), "A"), (b"e\xcc\x81", "é"), ("\t".encode(), " ")]))
    assert m.normalize("ﬁx Ａ é b\tc ö") == "fix A é b c ö"
    assert m.find(b"zz") is None and own.Unigram(scores(), charsmap=m).normalize(" Ａ\t ﬁ ") == "A fi"


def test_counts_in_a_frame(spark, word_piece):
    df = spark.createDataFrame([("the mouse house",), ("",), (None,)], "t string")
    make = lambda: own.WordPiece({p: i for i, p in enumerate(PIECES)})
    got = df.select(own.counting(make)("t").alias("n"), own.encoding(make, 8)("t").alias("ids"), own.utf8_length(df.t).alias("b")).collect()
    want = sum(word_piece.count(w) for w in "the mouse house".split())
    assert [r.n for r in got] == [want, 0, None] and got[0].ids == word_piece.encode("the mouse house", 8) and got[1].ids == [1, 2] and got[0].b == 15


def test_passages_by_pieces(word_piece):
    text = "the mouse undo the house. " * 40
    got = chunk_pages([text], word_piece.count, 20)
    assert all(c["pieces"] <= 20 for c in got) and sum(c["pieces"] for c in got) == sum(word_piece.count(w) for w, _, _ in own.split_words(text))
