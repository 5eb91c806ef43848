"""License scans against exact joins on shingles."""

from oracle import connect, differences

from glossator.llm import licenses
from glossator.llm.license_texts import TEMPLATES


def test_documents(spark, sf):
    df = licenses.op4_license_scan(spark, sf)
    assert differences(df, licenses.oracle(), connect(sf)) is None
    assert df.count() > 20 and df.where("containment < 0.8").count() == 0


def test_every_template_in_odd_rows(spark):
    rows = [(i, f"some words before\n{text.upper()}  ** and after", "x", 1) for i, (_, text) in enumerate(TEMPLATES)]
    mit = next(t for n, t in TEMPLATES if n == "MIT").split()
    cut = " ".join(w for i, w in enumerate(mit) if i not in (40, 90))  # a few shingles are lost
    half = " ".join(mit[: len(mit) // 2])
    rows += [(100, None, None, 0), (101, "", None, 0), (102, "a b c", None, 0), (103, cut, None, 0), (104, half, None, 0), (105, "word " * 40000 + cut + " word" * 40000, None, 0)]
    rows += [(None, TEMPLATES[0][1], None, 0), (1, rows[1][1], "x", 1), (106, (TEMPLATES[0][1] + "\n") * 500, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string, at int")
    got = licenses.scan(df)
    c = connect("/root/testdata/sf0.001")
    c.execute("drop view documents")
    c.register("given", df.toPandas())
    c.execute("create view documents as select cast(doc_id as bigint) as doc_id, text from given")
    assert differences(got, licenses.oracle(), c) is None
    found = {(r.doc_id, r.template) for r in got.collect()}
    assert {(i, i) for i in range(len(TEMPLATES))} <= found
    long_mit = next(i for i, (n, _) in enumerate(TEMPLATES) if n == "MIT")
    assert {(103, long_mit), (105, long_mit), (None, 0), (106, 0)} <= found and (104, long_mit) not in found
    assert licenses.scan(df.limit(0)).count() == 0


def test_only_dataframe_operations(spark, sf):
    plan = licenses.op4_license_scan(spark, sf)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "InArrow"))
