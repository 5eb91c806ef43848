"""The pipeline, each stage against a plain version of itself on its own input."""

import zlib

import numpy as np
import public_tokenizers
from test_decontaminate import plain_leaks
from test_dedup import plain
from test_mixing import plain_targets
from tokenizers import Tokenizer

import corpus_pipeline


def rows(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


def test_stages(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    seen = [rows(docs)]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        out.write.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        docs = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        if name != "token ids":
            assert docs.columns == columns
            seen.append(rows(docs))
    given, known, once, clean, mixed = seen
    assert len(known) >= 0.97 * len(given) and set(known) <= set(given)

    want, links = plain([(k, t) for k, t, _ in known])
    assert links and sorted(k for k, *_ in once) == sorted(k for k, _, _, keep in want if keep)

    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    bad = {k for k, _ in plain_leaks([(k, t) for k, t, _ in once], bench)}
    assert bad and {k for k, *_ in clean} == {k for k, *_ in once} - bad

    def words(data):
        n = {}
        for _, t, s in data:
            n[s] = n.get(s, 0) + len((t or "").split())
        return n

    for s, target in plain_targets(words(clean)).items():
        assert abs(words(mixed)[s] - target) <= 0.01 * target + 3
    texts = {k: t.split() for k, t, _ in clean}
    assert all(set((t or "").split()) <= set(texts[k]) for k, t, _ in mixed)

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [(k, t.encode(x or "", add_special_tokens=False).ids + [2]) for k, x, _ in mixed]
    crc = [(k, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for k, i in ids]
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in docs.collect()) == sorted(crc)


def test_odd_tables(spark, tmp_path):
    """Nulls in every column, texts without letters, repeated rows, then no rows at all."""
    text = "plain words of a language that is learned from these very rows here "
    rows = [(i, text + f"and number {i} tells it from others " * 3, "en", "s", 9) for i in range(12)]
    rows += [(None, None, None, None, None), (None, text + "without an id", "en", None, 1), (3, rows[3][1], "en", "s", 9), (50, "", "en", "t", 0), (51, "12 34", None, "t", 5), (52, text, None, None, None)]
    for name, n in (("some", None), ("none", 0)):
        d = tmp_path / name
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        (docs if n is None else docs.limit(0)).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, "unlike anything of the words in there, one by one, at all times")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        got = corpus_pipeline.run(spark, str(d)).collect()
        if n == 0:
            assert got == []
        else:
            assert {r.doc_id for r in got} <= {*range(12), None, 52} and len(got) >= 5
            assert sorted(r.start for r in got) == np.cumsum([0] + [r.n_tokens for r in sorted(got, key=lambda r: r.start)])[:-1].tolist()
