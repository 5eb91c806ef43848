"""Spaced seeds against plain comparison at every offset."""

import itertools
import re
import unicodedata

import pyarrow as pa
import pytest

from glossator.llm import decontaminate as d


def words(t):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())


def plain_leaks(docs, items):
    out = set()
    for i, item in items:
        want = words(item)
        if len(want) < d.LEAST:
            continue
        for k, text in docs:
            got = words(text)
            for shift in range(-len(want), len(got)):
                a, z = max(0, -shift), min(len(want), len(got) - shift)
                n = min(d.WINDOW, len(want))
                if z - a < n:
                    if z - a < d.LEAST:
                        continue
                    n = z - a
                same = [got[x + shift] == want[x] for x in range(a, z)]
                if any(sum(same[s : s + n]) >= d.SHARE * n - 1e-9 and (n == min(d.WINDOW, len(want)) or sum(same[s : s + n]) >= d.LEAST) for s in range(len(same) - n + 1)):
                    out.add((k, i))
    return out


def test_masks_hit_every_pattern():
    masks = [(int(m, 2), len(m)) for m in d.MASKS]
    for n in range(10, d.WINDOW + 1):
        for wrong in itertools.combinations(range(n), int(n * (1 - d.SHARE) + 1e-9)):
            bits = (1 << n) - 1
            for x in wrong:
                bits &= ~(1 << x)
            assert any((bits >> s) & m == m for m, span in masks for s in range(n - span + 1))


def test_against_plain(spark):
    word = [f"w{i}" for i in range(400)]
    item = " ".join(word[:30])
    short = " ".join(word[100:112])
    items = [(1, item), (2, short), (3, "too short to count"), (4, None), (5, item), (1, item)]
    changed = word[:30]
    for i in (3, 8, 14, 19, 25):
        changed[i] = "other"
    many = [w if i % 3 else "no" for i, w in enumerate(word[:30])]
    docs = [
        (1, "pre fix " + item + " and after"),
        (2, "a " + " ".join(changed).upper() + " z"),
        (3, "a " + " ".join(many)),
        (4, ", ".join(x + "***" for x in word[:30])),
        (5, "x " * 50 + short + "!"),
        (6, short[: len(short) // 2]),
        (7, None), (8, ""), (9, "clean text of other words " * 30), (10, item), (10, item), (10, "another text under the same id"),
        (11, " ".join(word[15:30]) + " end"), (12, "x " * 3000 + item + " y" * 3000 + " " + short),
        (None, item),
    ]
    dd = spark.createDataFrame([(k, t, 9, "x") for k, t in docs], "doc_id long, text string, item_id int, region string")
    bb = spark.createDataFrame(items, "item_id long, text string")
    got = d.leaks(dd, bb).collect()
    assert {(r.doc_id, r.item_id) for r in got} == plain_leaks(docs, items)
    assert len(got) == len({(r.doc_id, r.text_hash, r.item_id) for r in got})
    place = {(r.doc_id, r.item_id): r for r in got}
    assert place[1, 1].first_word == 2 and place[1, 1].n_words == 20 == place[1, 1].n_equal
    left = d.without_leaks(dd, bb)
    assert left.columns == dd.columns
    assert {r.doc_id for r in left.collect()} == {3, 6, 7, 8, 9, 10}


def test_accents_in_capitals(spark):
    item = "l'été où Éric révèle à Zoë ce gâteau très sucré près de la forêt brûlée était déjà mûr für größere Bäche übrig"
    docs = [(1, "x y " + item.upper()), (2, unicodedata.normalize("NFD", item)), (3, item), (4, "rien de tel ici ".upper() * 9)]
    dd = spark.createDataFrame(docs, "doc_id long, text string")
    bb = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: r for r in d.leaks(dd, bb).collect()}
    assert set(got) == {1, 2, 3} and all(r.n_words == r.n_equal == 20 for r in got.values())
    assert [r.doc_id for r in d.without_leaks(dd, bb).collect()] == [4]


def test_short_items_and_scripts_without_spaces(spark):
    chinese = "北京是中华人民共和国的首都，也是全国的政治文化中心。"
    thai = "กรุงเทพมหานครเป็นเมืองหลวงของประเทศไทย"
    items = [(1, "The capital of France?"), (2, "Eins"), (3, chinese), (4, thai), (5, "日本"), (6, "... !"), (7, ""), (8, "nine words stand here in a row just so")]
    docs = [
        (1, "he asked: the CAPITAL of france, twice; the capital of France"), (2, "the capital of all France"), (3, "eins " * 5000),
        (4, "前文" + chinese.replace("首都", "首府") + "后文"), (5, "ก่อน" + thai + "หลัง"), (6, "在日本东京"), (7, "日 x 本"), (8, "... !"),
        (9, "nine words stand here in a row just"), (10, "nine words stand here in a row just so"), (11, "capital of France"),
    ]
    dd = spark.createDataFrame(docs, "doc_id long, text string")
    bb = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.first_word, r.n_words, r.n_equal) for r in d.leaks(dd, bb).collect()}
    assert set(got) == {(1, 1), (3, 2), (4, 3), (5, 4), (6, 5), (10, 8)}
    assert got[1, 1] == (2, 4, 4) and got[3, 2] == (0, 1, 1) and got[6, 5] == (1, 2, 2) and got[10, 8] == (0, 9, 9)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 3000")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in d.leaks(docs, bench).collect()}
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(r.item_id, r.text) for r in bench.collect()]
    # only pairs that share some five words in a row, or four of six, can leak: a cheap necessary filter for the plain way
    grams = {}
    for i, t in items:
        w = words(t)
        for s in range(len(w) - 2):
            grams.setdefault(tuple(w[s : s + 3]), set()).add(i)
    near = set()
    for k, t in texts:
        w = words(t)
        for s in range(len(w) - 2):
            near |= {(k, i) for i in grams.get(tuple(w[s : s + 3]), ())}
    by, text = dict(items), dict(texts)
    want = set()
    for k, i in near:
        want |= plain_leaks([(k, text[k])], [(i, by[i])])
    assert got == want and len(got) > 5


def test_empty(spark):
    dd = spark.createDataFrame([], "doc_id long, text string")
    bb = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "doc_id long, text string")
    assert d.leaks(dd, bb).count() == d.leaks(some, bb).count() == d.leaks(dd, some.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_seeds_stay_in_their_text():
    w = d.Words(pa.array(["a b c", "d e f g h i"]), d.PUNCTUATION)
    assert [list(at) for at, _ in d.seeds(w.hashes, w.doc)] == [[3], [], [3, 4]]


@pytest.mark.parametrize("kind", ["short", "int", "string", "decimal(20,2)", "struct<a:int>"])
def test_any_type_of_id(spark, kind):
    item = "some words of an item that is long enough to count here"
    ids = "named_struct('a', id)" if kind.startswith("struct") else f"cast(id as {kind})"
    dd = spark.createDataFrame([(1, "x " + item), (2, "clean"), (None, item)], "id int, text string").selectExpr(f"{ids} as doc_id", "text")
    bb = spark.createDataFrame([("i", item)], "item_id string, text string")
    got = d.leaks(dd, bb)
    assert got.schema["doc_id"].dataType == dd.schema["doc_id"].dataType and got.count() == 2
    assert [r.text for r in d.without_leaks(dd, bb).collect()] == ["clean"]
