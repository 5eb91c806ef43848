"""Queue, switch, events, HTTP, searches from words to a saved list, the batch job."""

import datetime as dt
import json
import os
import threading
import time
import urllib.error
import urllib.request

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossator import __main__ as job
from glossator import schemas
from glossator.functions import codecs, registered, texts
from glossator.functions.encoders import HashingEncoder
from glossator.operators import control, ingest, items, search, searching, store
from glossator.sources import files, http


def test_events_are_heard_apart():
    heard, failed = [], []
    e = control.Events(lambda channel, error: failed.append((channel, str(error))))
    e.on("index", lambda: 1 / 0)
    off = e.on("index", lambda: heard.append(1))
    assert e.emit("index") == 1 and heard == [1] and failed == [("index", "division by zero")]
    off()
    off()
    assert e.emit("index") == 0 and heard == [1]
    with pytest.raises(ValueError):
        e.on("else", print)


def test_queue():
    q = control.Queue()
    q.add([("a", ["m"]), ("b", ["m"]), ("c", ["n"])])
    q.add([("c", ["m"]), ("b", ["n"])], first=True)
    assert q.take(2) == [("c", ["m", "n"]), ("b", ["m", "n"])]
    q.add([("b", ["m"])])  # runs already
    assert list(q.waiting) == ["a"]
    q.pause()
    assert q.take() == []
    q.resume()
    q.add([("d", ["n"])])
    q.drop_target("n")
    assert list(q.waiting) == ["a"] and not q.done("c") and sorted(q.cancel()) == ["b"] and q.done("b")


def test_switch():
    told = []
    e = control.Events()
    e.on("model", told.append)
    s = control.Switch("one", e)
    assert s.choose("two", False) == "downloading" and s.targets() == ["one"] and not s.pass_complete()
    assert s.downloaded(False) == "error" and s.choose("two", True) == "building"
    assert s.targets() == ["one", "two"] and not s.deletable("two") and s.pass_complete() and s.active == "two" and told == ["two"]
    s.choose("one", True)
    assert s.cancel() == "one" and s.targets() == ["two"]
    assert s.choose("one", True, indexed=True) == "ready" and s.active == "one"
    s.choose("two", True)
    s.use_now()
    assert s.active == "two" and control.Active(lambda: s, own=3).active == "two" and control.Active(lambda: s, own=3).own == 3


def test_remembered_and_readiness(tmp_path):
    now, made = [0.0], []
    m = control.Remembered(10, 2, lambda: now[0])
    get = lambda k: m.get(k, lambda: made.append(k) or k)
    get("a"), get("a"), get("b"), get("c"), get("a")
    now[0] = 11
    get("a")
    assert made == ["a", "b", "c", "a", "a"]
    (tmp_path / "x").write_bytes(b"abc")
    assert control.readiness(str(tmp_path), {"x": 3}) == ("ready", [])
    assert control.readiness(str(tmp_path), {"x": 4, "y": 2}) == ("missing", ["y", "x"])
    digest = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert files.checked(str(tmp_path / "x"), digest, 3)
    for bad in ((digest, 4), ("0" * 64, 3)):
        with pytest.raises(ValueError):
            files.checked(str(tmp_path / "x"), *bad)


def _slow(content):
    time.sleep(30)


def _dies(content):
    os._exit(1)


def test_extractors_end_in_time():
    assert files.within(files.plain_extractor, 10)(b"a\fb") == "a\fb"
    with pytest.raises(TimeoutError):
        files.within(_slow, 0.2)(b"")
    with pytest.raises(ChildProcessError):
        files.within(_dies, 10)(b"")
    with pytest.raises(RuntimeError, match="Unicode"):
        files.within(files.plain_extractor, 10)(b"\xff")


def test_outcomes_of_errors(spark):
    want = {"RuntimeError: bad password": "encrypted", "RuntimeError: xref": "unreadable", "TimeoutError: timeout: no text within 1 s": "retry", "ChildProcessError: crash: the extractor died": "retry", "timed out": "retry"}
    got = ingest.outcomes(spark.createDataFrame([(k, None, k) for k in want], "id string, pages array<string>, error string"))
    assert {r.id: r.status for r in got.collect()} == want


class Echo:
    def index_status(self, args):
        return {"model": "m"}


def test_http():
    call = lambda *a, **k: http.answer(*a, Echo(), **k)
    ping = json.dumps({"jsonrpc": "2.0", "id": 1, "method": "ping"}).encode()
    assert call("POST", "application/json; charset=utf-8", ping) == (200, {"jsonrpc": "2.0", "id": 1, "result": {}})
    assert call("GET", "", b"")[0] == 405 and call("POST", "text/plain", ping)[0] == 415 and call("POST", "application/json", ping, enabled=False)[0] == 404
    assert call("POST", "application/json", b"3")[1]["error"]["code"] == -32700 == call("POST", "application/json", b"{")[1]["error"]["code"]
    assert call("POST", "application/json", b'{"jsonrpc": "2.0", "method": "note"}') == (202, None)
    s = http.server(Echo())
    threading.Thread(target=s.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{s.server_port}/"
    with urllib.request.urlopen(urllib.request.Request(url, ping, {"Content-Type": "application/json"})) as r:
        assert json.load(r)["id"] == 1
    with pytest.raises(urllib.error.HTTPError) as e:
        urllib.request.urlopen(url)
    assert e.value.code == 405 and e.value.headers["Allow"] == "POST"
    s.shutdown()


@pytest.fixture(scope="module")
def passages(spark):
    enc = HashingEncoder(64)
    topics = {"k1": "whale songs travel far under water ", "k2": "court rulings bind lower courts ", "k3": "bread dough rises with yeast "}
    docs = spark.createDataFrame([(k, [t * 40, t * 30], None) for k, t in topics.items()], "id string, pages array<string>, error string")
    empty = spark.createDataFrame([], schemas.PASSAGES)
    rows = store.replace_documents(empty, ingest.indexed(docs, "hash64", enc)).withColumn("file_name", F.concat("id", F.lit(".pdf")))
    return rows.persist()


def test_searches(spark, passages):
    none = spark.createDataFrame([], schemas.HISTORY)
    s = searching.Searcher(passages, "hash64", HashingEncoder(64), F.lit(dt.datetime(2024, 5, 1)))
    first = s.search("whale songs", none, least=0.3)
    rows = first.results.collect()
    assert first.saved and not first.from_cache and {r.folder_id for r in rows} == {"k1"} and rows[0].file_name == "k1.pdf" and rows[0].matched is None
    history = spark.createDataFrame(first.history.collect(), schemas.HISTORY)
    assert history.count() == 1
    again = s.search("whale songs", history, least=0.3)
    assert again.from_cache and not again.saved and again.results.count() == len(rows)
    assert not s.search("whale songs", history, least=0.31).from_cache  # another threshold
    cited = history.withColumn("results", store.with_status(F.col("results"), F.lit("k1"), F.lit(rows[0].section_number), F.lit(1).cast("tinyint")))
    new = s.search("whale songs", cited, least=0.3, use_cache=False).results
    assert {r.status for r in new.where(F.col("section_number") == rows[0].section_number).collect()} == {1}
    other = s.search("whale songs far", cited, least=0.3, carry_from=first.id).results
    assert 1 in {r.status for r in other.collect()}
    keys = spark.createDataFrame([("k2",), ("none",)], "id string")
    within = s.search("court whale", none, keys=keys, least=0.1)
    assert {r.folder_id for r in within.results.collect()} == {"k2"} and not within.saved
    assert s.search("court whale", none, source="mcp", keys=keys, least=0.1).saved
    assert s.search("court whale", none, least=0.1, keep=lambda df: df.where("folder_id = 'k1'")).results.select("folder_id").distinct().count() == 1
    gone = searching.Searcher(passages, "hash64", None)
    assert gone.search("whale songs", history).from_cache
    with pytest.raises(searching.ModelMissing):
        gone.search("other", history)
    with pytest.raises(ValueError):
        s.search(" ", none)
    assert searching.excluding(history, first.id, "k1").first().results == [] and searching.excluding(history, "x", "k1").first().results
    assert store.history_without(history, first.id).count() == 0 and store.history_updated(history, first.id, F.slice("results", 1, 1)).first().results == history.first().results[:1]


def test_long_queries_and_abstracts(spark, passages):
    none = spark.createDataFrame([], schemas.HISTORY)
    s = searching.Searcher(passages, "hash64", HashingEncoder(64))
    got = s.search("court rulings bind lower courts. " * 30 + "whale songs travel far under water. " * 30, none, least=0.1).results.collect()
    assert {r.folder_id for r in got} >= {"k1", "k2"} and any(r.matched and len(r.matched) <= 91 for r in got)
    it = spark.createDataFrame([("i", {"abstractNote": "bread dough"}), ("j", {"date": "x"})], "key string, fields map<string,string>")
    assert s.by_abstract(it, "i", none, least=0.3).results.first().folder_id == "k3"
    for key in "jx":
        with pytest.raises(ValueError):
            s.by_abstract(it, key, none)


def test_located(spark):
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(3000)]
    text = " ".join(words[k] for k in rng.integers(0, 3000, 4000))
    enc = HashingEncoder(64)
    at = text.index(" ", 9000) + 1
    v = enc.encode([text[at : at + 900]])[0].tolist()
    n = len(text) // 1200
    rows = [(1, text, [0, 5000, 12000], int((at - 1000) / len(text) * n), n, v), (2, "", [0], 0, 1, v), (3, None, None, 0, 1, v)]
    got = searching.located(spark.createDataFrame(rows, "rowid long, text string, starts array<int>, section_number int, sections int, embedding array<float>"), enc).collect()
    assert [r.rowid for r in got] == [1] and abs(got[0].char_start - at) < 60 and got[0].match > 0.8 and got[0].page == 1 and got[0].chunk_text in text


def test_blocks_of_queries(spark, sf, monkeypatch):
    from glossator.plans import registry

    names = ("vec_topk_all", "vec_similar_docs", "vec_topk_batch")
    want = [sorted(map(tuple, registry.QUERIES[n](spark, sf).collect())) for n in names]
    monkeypatch.setattr(search, "MOST_QUERIES", 90)
    monkeypatch.setattr(search, "PAIRS", 700)
    assert [sorted(map(tuple, registry.QUERIES[n](spark, sf).collect())) for n in names] == want
    p = registry.passages(spark, sf)
    none = spark.createDataFrame([], "qid long, segment int, vec array<double>")
    assert search.scored(p, none).count() == 0 and search.scored(p.limit(0), registry.segments(spark, sf, [0])).count() == 0
    short = registry.segments(spark, sf, [0]).withColumn("vec", F.slice("vec", 1, 3))
    assert search.scored(p, short).count() == 0  # no passage has vectors of that length


def test_tables_of_two_writers(spark, tmp_path):
    t = store.Table(spark, str(tmp_path / "t"), schemas.META)
    rows = [spark.createDataFrame([(k, "v")], "key string, value string") for k in "abcd"]
    got = []
    writers = [threading.Thread(target=lambda r=r: got.append(t.write(r))) for r in rows]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert len(got) == 4 and t.read().count() == 1 and t.version() in got
    seen = {t.read().first().key for _ in range(3)}
    n = t.version()
    assert len(seen) == 1 and t.write(rows[0]) == n + 1
    assert t.read().first().key == "a" and t.version() == n + 1
    t.vacuum(1)
    assert [x for x in os.listdir(tmp_path / "t") if x.startswith("v=")] == [x for x in os.listdir(tmp_path / "t") if x.startswith(f"v={n + 1}-")] and t.read().count() == 1


def test_values_and_names(spark):
    data = spark.createDataFrame([(1, "a", 7), (1, "b", 8), (2, "a", 9)], "item_id int, field string, value_id int")
    values = spark.createDataFrame([(7, "x"), (8, "y"), (9, None)], "value_id int, value string")
    its = spark.createDataFrame([(1,), (3,)], "item_id int")
    assert {r.item_id: r.fields for r in items.with_fields(its, data, values).collect()} == {1: {"a": "x", "b": "y"}, 3: {}}
    assert [tuple(r) for r in items.by_value(its, data, values, ["b"]).collect()] == [(1, "b", "y")]
    row = spark.createDataFrame([("2024-03-31", "㰀䀀")], "d string, s string").select(texts.months_ago(F.to_date("d"), 1).cast("string"), texts.shown_date(F.lit("soon")), texts.shown_date(F.lit(None).cast("string")), codecs.f16_vector(codecs.bytes_of_units(F.col("s")))).first()
    assert row[:] == ("2024-03-02", "soon", "", [1.0, 2.0])


def test_sql_functions(spark):
    registered.register(spark)
    spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 2.0]), ("b", None)], "k string, v array<float>").createOrReplaceTempView("vectors_here")
    got = {r.k: r.m for r in spark.sql("select k, vector_mean(v) m from vectors_here group by k").collect()}
    assert got["a"] == pytest.approx([2**-0.5] * 2) and got["b"] is None
    assert spark.sql("select vector_dot(v, v) d, vector_norm(v) n, vector_unit(v) u from vectors_here where v[1] = 2").first()[:] == (4.0, 2.0, [0.0, 1.0])
    assert spark.sql("select * from passages('one two. three four.', 100)").first()[:4] == (0, "one two. three four.", 0, 0)


def test_job(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in range(3):
        (tmp_path / "in" / f"d{n}.txt").write_text(f"document number {n} speaks of things at some length. " * 20)
    (tmp_path / "in" / "bad.txt").write_bytes(b"\xff\xfe")
    out = str(tmp_path / "table")
    assert job.index(spark, f"file://{tmp_path}/in", out) == {"index": 3, "unreadable": 1}
    t = store.Table(spark, out, schemas.PASSAGES).read()
    assert t.select("id").distinct().count() == 3 and t.where("embedding is null").count() == 0
    assert job.index(spark, f"file://{tmp_path}/in", out) == {"unreadable": 1} and store.Table(spark, out, schemas.PASSAGES).version() == 1
