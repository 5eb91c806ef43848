"""Near-duplicates against all pairs, components against union-find."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from glossator.llm import common, dedup, graph


def shingles(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def plain(docs):
    sets = [(k, shingles(t)) for k, t in docs]
    root = {k: k for k, _ in sets if k is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = defaultdict(set)
    for n, (k, s) in enumerate(sets):
        for x in s if k is not None else ():
            by[x].add(n)
    seen = set()
    for n, (k, s) in enumerate(sets):
        if k is None:
            continue
        for m in {m for x in s for m in by[x] if m < n}:
            a, b = sets[m][1], s
            if 100 * len(a & b) >= 85 * len(a | b):
                x, y = find(sets[m][0]), find(k)
                root[max(x, y)] = min(x, y)
                seen.add((m, n))
    return sorted(((k, len(s), None if k is None else find(k), k is None or find(k) == k) for k, s in sets), key=str), len(seen)


def test_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want, links = plain(rows)
    got = sorted(map(tuple, dedup.op7_near_dedup(spark, sf).collect()), key=str)
    assert got == want and links > 50


def several_texts():
    """Ids with several texts, which tie otherwise unlike documents together."""
    rng = random.Random(8)
    text = {k: " ".join(rng.choice("abcdefghij") * 3 + str(rng.randrange(99)) for _ in range(40)) for k in "ABCDEF"}
    return [(3, text["A"]), (4, text["B"]), (5, text["A"]), (5, text["B"]), (6, text["C"]), (7, text["C"] + " x y"), (7, text["D"]), (2, text["D"]), (8, text["E"]), (8, text["F"]), (8, None), (9, text["F"])]


def test_ids_of_several_texts(spark):
    rows = several_texts()
    got = sorted(map(tuple, dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == plain(rows)[0]
    assert {c for k, _, c, _ in got if k in (3, 4, 5)} == {3} and {c for k, _, c, _ in got if k in (2, 6, 7)} == {2}


@pytest.mark.parametrize(("block", "hot"), [(dedup.BLOCK_SHINGLES, 1 << 20), (400, 3)])
def test_chains_and_odd_rows(spark, block, hot, monkeypatch):
    monkeypatch.setattr(common, "HOT", hot)
    monkeypatch.setattr(common, "FEW", hot)
    monkeypatch.setattr(dedup, "BLOCK_DOCS", hot + 2)
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(25):  # a chain: neighbours are near, ends aren't
        w = list(base)
        for j in range(0, 2 * i, 2):
            w[(j * 7) % 150] = f"x{j}"
        rows.append((1000 - i, " ".join(w)))
    rows += [(i, " ".join(base).upper()) for i in range(40, 70)]
    rows += [(2000, None), (2001, ""), (2002, " \t"), (2003, "one two"), (2004, "ONE  two"), (2005, "two one"), (None, "one two"), (2003, "one two"), (2006, "É a b c"), (2007, "é a b c"), (3000, "long " * 30000), (3001, "long " * 20000)]
    rows += [(k + 5000 if k else k, t) for k, t in several_texts()]
    df = spark.createDataFrame([(k, t, "s") for k, t in rows], "doc_id long, text string, n string")
    got = sorted(map(tuple, dedup.near_duplicates(df, block_shingles=block).collect()), key=str)
    assert got == plain(rows)[0]
    left = dedup.deduplicated(df)
    assert left.columns == df.columns
    kept = [k for k, _, _, keep in plain(rows)[0] if keep]
    texts = {(k, t) for k, t in rows if k in kept}
    assert sorted(map(str, ((r.doc_id, r.text) for r in left.collect()))) == sorted(map(str, texts))
    assert dedup.near_duplicates(df.limit(0)).count() == 0


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), min_size=1, max_size=40))
def test_components(spark, pairs):
    root = {}
    for a, b in pairs:
        if a != b:
            x, y = root.setdefault(a, a), root.setdefault(b, b)
            for k, v in root.items():
                if v in (x, y):
                    root[k] = min(x, y)
    got = {r.id: r.root for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == root


def test_overlaps_and_signatures():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 3000, n, dtype=np.uint64)) for n in (1, 500, 900, 40, 900)]
    sets.append(sets[2])
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = dedup.overlaps(sets)
    off = ~np.eye(len(sets), dtype=bool)
    assert (got[off] == np.array(want)[off]).all()
    flat, first = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    s = dedup.signatures(flat, first, 2000)
    a, b = set(sets[1].tolist()), set(sets[2].tolist())
    assert abs((s[1] == s[2]).mean() - len(a & b) / len(a | b)) < 0.03 and (s[2] == s[5]).all()
