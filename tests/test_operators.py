"""Search, stores, ingestion, duplicates, tools and streams."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossator import schemas
from glossator.functions.encoders import HashingEncoder
from glossator.models import MODELS
from glossator.operators import duplicates, ingest, items, search, store, tools
from glossator.streaming import changes

TEXT = "Judges weigh evidence and precedent before a verdict is read. "


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def library(spark):
    enc = HashingEncoder(64)
    topics = {"k1": "whale songs travel far under water ", "k2": "court rulings bind lower courts ", "k3": "bread dough rises with yeast "}
    docs = spark.createDataFrame([(k, [t * 40, t * 30], None) for k, t in topics.items()] + [("k4", ["tiny"], None), ("k5", None, "password needed"), ("k6", None, "time out")], "id string, pages array<string>, error string")
    p = ingest.indexed(docs, "hash64", enc)
    empty = spark.createDataFrame([], "model string, id string, rowid long, section_number int, embedding array<float>, chunk_text string, page int, char_start int, char_start_utf16 int, pieces int, scheme int")
    passages = store.replace_documents(empty, p).persist()
    creators = [("Ann", "Lee", None, "author"), ("X", "Y", None, "translator")]
    rows = [(10, "i1", 1, day(0), day(5), "book", "On whales", creators, {"date": "2001-02", "DOI": "10.1/AB"}, ["sea"], ["C1"], False), (20, "i2", 1, day(90), day(6), "report", "Rulings", None, {"date": "0000"}, None, ["c1", "D"], False), (30, "i3", 1, day(95), day(7), "book", "Dough", None, {"ISBN": "978-3-16-148410-0"}, None, None, True)]
    it = spark.createDataFrame(rows, "item_id long, key string, library_id long, date_added timestamp, date_modified timestamp, item_type string, title string, creators array<struct<first_name:string,last_name:string,name:string,creator_type:string>>, fields map<string,string>, tags array<string>, collections array<string>, deleted boolean")
    att = [(1, 10, "k1", 1, "application/pdf", 0, "storage:a.pdf", day(1), False), (2, 20, "k2", 1, "application/pdf", 0, "attachments:b.pdf", day(1), False), (3, 30, "k3", 1, "application/pdf", 0, "/c.pdf", day(1), False), (4, None, "k4", 1, "application/pdf", 3, "x", day(1), False), (5, None, "k5", 1, "application/pdf", 0, "y", day(100), False)]
    attachments = spark.createDataFrame(att, "item_id long, parent_id long, key string, library_id long, content_type string, link_mode int, path string, date_added timestamp, deleted boolean")
    deleted = spark.createDataFrame([(3,), (None,)], "item_id long")
    excluded = spark.createDataFrame([("z", None, "manual"), ("y", None, "manual"), ("x", None, "no_text")], schemas.EXCLUDED)
    history = spark.createDataFrame([], schemas.HISTORY)
    return tools.Library(passages, it, attachments, deleted, excluded, history, MODELS["hash64"], enc)


def test_outcomes(spark):
    rows = [("a", [TEXT * 3], None), ("b", ["short"], None), ("c", None, "Password required"), ("d", None, "crashed"), ("e", None, "bad xref"), ("f", None, None)]
    got = {r.id: r.status for r in ingest.outcomes(spark.createDataFrame(rows, "id string, pages array<string>, error string")).collect()}
    assert got == {"a": "index", "b": "no_text", "c": "encrypted", "d": "retry", "e": "unreadable", "f": "no_text"}
    log = spark.createDataFrame([("a", "index", 10, 2.0), ("b", "retry", 0, 3.0), ("c", "no_text", 0, 0.0)], "id string, status string, passages long, seconds double")
    assert ingest.statistics(log).first()[:] == (3, 1, 1, 1, 2.0)
    assert ingest.promoted({"active": "a", "building": "b"}, True) == {"active": "b", "building": None}
    assert ingest.promoted({"active": "a", "building": "b"}, False) == {"active": "a", "building": "b"}


def test_library_scan_and_paths(spark, library):
    got = ingest.resolved(ingest.library(library.attachments, library.deleted), "/data", "/base")
    assert {r.key: r.file for r in got.collect()} == {"k1": "/data/storage/k1/a.pdf", "k2": "/base/b.pdf", "k5": "y"}
    assert {r.key for r in ingest.resolved(library.attachments, "/data").collect()} == {"k1", "k3", "k4", "k5"}
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    own = spark.createDataFrame([("a", "own")], "id string, text string")
    host = spark.createDataFrame([("a", "h", True), ("b", "h", True), ("c", "h", False)], "id string, text string, complete boolean")
    assert {r.id: (r.text, r.origin) for r in ingest.texts(keys, own, host).collect()} == {"a": ("own", "own"), "b": ("h", "host"), "c": (None, None)}


def test_indexing_twice_changes_nothing(spark, library):
    p = library.passages
    assert {r.id for r in p.select("id").distinct().collect()} == {"k1", "k2", "k3"}
    left = ingest.unprocessed(spark.createDataFrame([("k1",), ("k2",), (None,)], "id string"), spark.createDataFrame([], "id string"), p, ["hash64"])
    assert left.count() == 0
    again = store.replace_documents(p, p.where("id = 'k2'"))
    n = p.count()
    assert again.count() == n and again.agg(F.max("rowid")).first()[0] > n and again.select("rowid").distinct().count() == n


def test_search(library):
    got = library.semantic_search({"query": "songs of whale under water", "min_similarity": 0.05, "limit": 3})
    assert got["results"][0]["attachment_key"] == "k1" and not got["from_cache"] and got["results"][0]["page"] >= 1
    grouped = library.semantic_search({"query": "lower courts rulings", "min_similarity": 0.01, "group_by_item": True})
    keys = [r["attachment_key"] for r in grouped["results"]]
    assert keys[0] == "k2" and len(keys) == len(set(keys)) and "k3" not in keys  # its item is deleted
    only = library.semantic_search({"query": "courts water", "min_similarity": 0.01, "item_types": ["report"]})
    assert {r["item_type"] for r in only["results"]} == {"report"}
    late = library.semantic_search({"query": "courts water", "min_similarity": 0.01, "added_after": "2024-03-01"})
    assert {r["attachment_key"] for r in late["results"]} == {"k2"}
    assert "note" in library.semantic_search({"query": "zzz", "min_similarity": 0.99})
    with pytest.raises(tools.ToolError):
        library.semantic_search({"query": " "})
    with pytest.raises(tools.ToolError):
        library.semantic_search({"query": "x", "added_after": "yesterday"})


def test_cached_search(spark, library):
    from glossator.functions.texts import history_id

    name = spark.range(1).select(history_id(F.lit("courts"), F.lit("hash64"), F.lit("manual"))).first()[0]
    res = [dict(similarity=0.5, folder_id="k2", file_name=None, section_number=0, rowid=None, status=None, page=None, duplicates=None, matched=None), dict(similarity=0.4, folder_id="k1", file_name=None, section_number=0, rowid=None, status=None, page=None, duplicates=None, matched=None)]
    h = spark.createDataFrame([(name, day(1), "courts", None, res, "hash64", None, library.state(), 0.1)], schemas.HISTORY)
    own = tools.Library(library.passages, library.items, library.attachments, library.deleted, library.excluded, h, library.model, library.encoder)
    got = own.semantic_search({"query": "courts", "min_similarity": 0.1, "use_cache": True, "item_types": ["report"]})
    assert got["from_cache"] and [r["attachment_key"] for r in got["results"]] == ["k2"]
    assert not own.semantic_search({"query": "courts", "min_similarity": 0.2, "use_cache": True})["from_cache"]
    stale = store.reusable(h.withColumn("results", F.array().cast(schemas.HISTORY["results"].dataType)), library.state(), 0.1)
    assert stale.count() == 0


def test_other_tools(library):
    text = library.get_passage({"attachment_key": "k1", "section": 1})["text"]
    assert text.count("whale") > 10
    item = library.get_item({"key": "i1"})
    assert item["citation"] == "Ann Lee; X Y, 2001, On whales" and item["attachments"][0]["key"] == "k1"
    similar = library.find_similar_items({"key": "k1"})
    assert {r["attachment_key"] for r in similar["results"]} == {"k2"}
    status = library.index_status({})
    assert status["documents"] == 3 and status["excluded"] == {"manual": 2, "no_text": 1}
    assert library.list_attachments_without_parent({})["attachments"] == ["k5", "k4"]
    assert library.list_attachments_without_parent({"added_after": "2024-02-01"})["total"] == 1
    assert library.list_saved_searches({})["searches"] == []
    with pytest.raises(tools.ToolError):
        library.create_item({"item_type": "book", "title": "T", "fields": {"DOI": "https://doi.org/10.1/ab"}})
    made = library.create_item({"item_type": "book", "title": "T", "fields": {"DOI": "10.1/ab"}, "allow_duplicate": True, "collections": ["d"], "creators": [{"name": "N"}]})
    assert made["append_item"]["collections"] == ["D"] and made["append_item"]["creators"][0]["creator_type"] == "author"
    assert library.create_item({"item_type": "book", "title": "T", "collections": ["C1"]})["append_item"]["collections"] == ["C1"]
    with pytest.raises(tools.ToolError):
        library.create_item({"item_type": "book", "title": "T", "collections": ["nowhere"]})
    assert library.create_parent_item({"attachment_key": "k4", "item_type": "book", "title": "T"})["set_parent"]["attachment_key"] == "k4"
    for call, args in ((library.create_parent_item, {"attachment_key": "k1", "item_type": "book", "title": "T"}), (library.get_passage, {"attachment_key": "k1", "section": "1"}), (library.get_item, {"key": "none"})):
        with pytest.raises(tools.ToolError):
            call(args)


class Stub:
    def index_status(self, args):
        return {"documents": 1}

    def get_item(self, args):
        raise tools.ToolError("no item")

    def get_passage(self, args):
        raise RuntimeError("broken")


def test_rpc():
    ask = lambda method, k=1, **params: tools.respond({"jsonrpc": "2.0", "id": k, "method": method, "params": params}, Stub())
    assert ask("initialize", protocolVersion="2024-11-05")["result"]["protocolVersion"] == "2024-11-05"
    assert ask("initialize", protocolVersion="1")["result"]["protocolVersion"] == tools.PROTOCOLS[0]
    assert len(ask("tools/list")["result"]["tools"]) == 9 and ask("prompts/list")["result"] == {"prompts": []}
    assert ask("tools/call", name="index_status")["result"]["structuredContent"] == {"documents": 1}
    assert ask("tools/call", name="get_item", arguments={})["result"]["isError"]
    assert ask("tools/call", name="get_passage", arguments={})["error"]["code"] == -32603
    assert ask("tools/call", name="none")["error"]["code"] == -32602 and ask("none")["error"]["code"] == -32601
    assert tools.respond([], Stub())["error"]["code"] == -32600 and tools.respond("x", Stub())["error"]["code"] == -32600
    assert tools.respond({"jsonrpc": "2.0", "method": "ping"}, Stub()) is None
    out = []
    tools.serve(["", "{x", json.dumps([{"jsonrpc": "2.0", "id": 7, "method": "ping"}, {"jsonrpc": "2.0", "method": "ping"}])], Stub(), out.append)
    assert json.loads(out[0])["error"]["code"] == -32700 and json.loads(out[1])[0]["id"] == 7


def test_table_versions(spark, tmp_path):
    t = store.Table(spark, f"file://{tmp_path}/meta", schemas.META)
    assert t.version() == 0 and t.read().count() == 0
    t.write(spark.createDataFrame([("a", "1"), ("b", "2")], schemas.META))
    t.write(store.upsert(t.read(), spark.createDataFrame([("b", "3"), (None, "n")], schemas.META), ["key"]))
    t.write(store.upsert(t.read(), spark.createDataFrame([(None, "m")], schemas.META), ["key"]))
    assert t.version() == 3 and {(r.key, r.value) for r in t.read().collect()} == {("a", "1"), ("b", "3"), (None, "m")}
    t.vacuum(1)
    assert t.read().count() == 3


def test_history_and_statuses(spark):
    new = spark.createDataFrame([("q", day(2), "query", None, None, "m", "manual", "1:1", float("inf")), ("r", day(3), "other", None, None, "m", "mcp", "1:1", 0.5)], schemas.HISTORY)
    got = {r.id: (r.source, r.min_similarity) for r in store.saved(spark.createDataFrame([], schemas.HISTORY), new).collect()}
    assert got == {"q": (None, None), "r": ("mcp", 0.5)}
    results = F.array(F.struct(F.lit("a").alias("folder_id"), F.lit(0).alias("section_number"), F.lit(0).alias("status")), F.struct(F.lit("b").alias("folder_id"), F.lit(0).alias("section_number"), F.lit(0).alias("status")))
    row = spark.range(1).select(store.with_status(results, F.lit("b"), F.lit(0), F.lit(2)).alias("x")).first().x
    assert [r.status for r in row] == [0, 2]
    p = spark.createDataFrame([(1, None, None, None, None), (2, 2, "t", 0, 0)], "rowid long, scheme int, chunk_text string, page int, char_start int")
    f = spark.createDataFrame([(1, "found", 3, 9), (2, "not", 1, 1)], "rowid long, chunk_text string, page int, char_start int")
    assert {r.rowid: (r.chunk_text, r.page) for r in store.relocated(p, f).collect()} == {1: ("found", 3), 2: ("t", 0)}
    files = spark.createDataFrame([("a", 5, 3), ("b", 5, 2), ("c", 5, 2), ("d", 1, 1)], "key string, size long, mtime long")
    assert {r.key for r in store.fitting(files, 10).collect()} == {"a", "b"}


def test_two_phases_equal_one(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((500, 32)).astype("float32")
    p = spark.createDataFrame([(i, f"d{i % 9}", i // 9, [float(v) for v in x[i]]) for i in range(500)], "rowid long, id string, section_number int, embedding array<float>")
    qs = [(q, s, [float(v) for v in rng.standard_normal(32)]) for q in range(3) for s in range(2)]
    fast = {(r.qid, r["rank"]): r.rowid for r in search.two_phase(p, qs, 0.1, 15).collect()}
    q = spark.createDataFrame(qs, "qid long, segment int, vec array<double>")
    plain = search.top(search.pooled(search.scored(p, q).where("similarity >= 0.1")), 15, ["qid"])
    assert fast == {(r.qid, r["rank"]): r.rowid for r in plain.collect()}


def test_collapse_and_cut(spark):
    rows = [(0, 1, "a", 0, 0.9), (0, 2, "b", 0, 0.9), (0, 3, "c", 0, 0.9), (0, 4, "a", 0, 0.8), (0, 5, "d", 1, 0.7)]
    df = spark.createDataFrame(rows, "qid int, rowid long, id string, section_number int, similarity double")
    got = search.collapsed(df, 2).orderBy(F.desc("similarity")).collect()
    assert [(r.rowid, r.duplicates) for r in got] == [(1, ["b", "c"]), (5, [])]


def test_items(spark, library):
    d = {r.key: r for r in items.described(library.attachments, library.items).collect()}
    assert (d["k1"].authors, d["k1"].year, d["k2"].year, d["k3"].missing, d["k4"].missing) == ("Lee", "2001", None, True, True)
    e = items.enriched(library.passages.select("rowid", "id", "section_number").limit(1), library.passages, library.items.withColumn("key", F.lit("k1"))).first()
    assert e.chunk_text and e.page is not None
    rows = spark.createDataFrame([("a", "Lee", "2001", "T", 0.5, 1, 7, 1, False, None), ("a", "Lee", "2001", "T", 0.61239, 0, 7, 1, False, None), ("b", "", None, "U", 0.4, 2, 8, 1, False, 2)], "id string, authors string, year string, title string, similarity double, page int, item_id long, library_id long, missing boolean, status int")
    assert [r.line for r in items.listed(rows).orderBy("n").collect()] == ["1. Lee, 2001, T — p. 1, 2 (0.612)", "2. U — p. 3 (0.400)"]
    c = items.collections(rows, "q" * 70).first()
    assert c.item_ids == [7] and c.name == "q" * 60 + "…"
    assert items.best_attachment(library.attachments).count() == 5


def test_duplicate_merge(spark):
    h = spark.createDataFrame([("a", 1, 5, 5, "h1"), ("b", 1, 5, 5, "h1"), ("c", 1, 9, 5, "h2")], "key string, library_id long, size long, mtime long, hash string")
    f = spark.createDataFrame([("a", 5, 5), ("b", 5, 6), ("n", 1, 1)], "key string, size long, mtime long")
    assert {r.key for r in duplicates.to_hash(f, h).collect()} == {"b", "n"} and {r.key for r in duplicates.pruned(h, f).collect()} == {"a", "b"}
    m = spark.createDataFrame([("h1", "a", 10, 0, day(1)), ("h1", "b", 11, 3, day(0)), ("h1", "c", None, 0, day(0))], "hash string, key string, parent_id long, annotations int, date_added timestamp")
    p = spark.createDataFrame([("h1", 10, day(9)), ("h1", 11, day(1))], "hash string, item_id long, date_modified timestamp")
    plan = {r.key: (r.action, r.target, r.master_id) for r in duplicates.merge_plan(m, p).collect()}
    assert plan == {"a": ("keep", "a", 10), "b": ("move_annotations_and_trash", "a", 10), "c": ("trash", "a", 10)}
    gone = spark.createDataFrame([("b",)], "key string")
    att = spark.createDataFrame([("a", 10), ("b", 11)], "key string, parent_id long")
    notes = spark.createDataFrame([], "parent_id long")
    assert [r.item_id for r in duplicates.empty_parents(p, att, notes, gone).collect()] == [11]
    assert {r.key for r in duplicates.preview_keeper(m.withColumn("date_modified", F.col("date_added"))).collect()} == {"a"}


def test_streams(spark, tmp_path):
    t = dt.datetime(2024, 5, 1, 12, 0, 0)
    s = lambda n: t + dt.timedelta(seconds=n)
    rows = [("a", s(0)), ("a", s(10)), ("a", s(29)), ("a", s(100)), ("b", s(5)), ("z", s(3600))]
    spark.createDataFrame(rows, "key string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    batch = changes.debounced(spark.read.parquet(f"{tmp_path}/in"))
    want = {(r.key, r.n, str(r.fires)) for r in batch.where("key != 'z'").collect()}
    assert want == {("a", 3, str(s(49))), ("a", 1, str(s(120))), ("b", 1, str(s(25)))}
    seen = []
    stream = spark.readStream.schema("key string, ts timestamp").parquet(f"{tmp_path}/in")
    q = changes.index_changes(stream, lambda df, n: seen.extend((r.key, r.n, str(r.fires)) for r in df.collect()), f"{tmp_path}/ck", once=True)
    q.awaitTermination(120)
    assert set(seen) == want
    assert changes.recent(batch.select("key", F.col("last").alias("ts")), s(3700), 10).count() == 1
    known = spark.createDataFrame([("x", "h"), ("y", "g")], "key string, hash string")
    adds = spark.createDataFrame([("n", "h"), ("m", "g"), ("x", "h")], "key string, hash string")
    assert [tuple(r) for r in changes.check_new(adds, known, known.where("hash = 'g'")).collect()] == [("n", "x", "h")]


def test_pending_work(spark, tmp_path):
    t = dt.datetime(2024, 5, 1)
    h = lambda n: t + dt.timedelta(hours=n)
    one = [("a", "started", 5, h(0)), ("b", "started", 5, h(0)), ("a", "seen", 5, h(1)), ("a", "seen", 9, h(2))]
    for i, rows in enumerate([one, [("c", "seen", 1, h(30))], [("c", "seen", 1, h(31))]]):
        spark.createDataFrame(rows, "key string, kind string, size long, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("key string, kind string, size long, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = changes.pending(stream).writeStream.outputMode("append").format("memory").queryName("pending_out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.key, r.outcome) for r in spark.table("pending_out").collect()} == {("a", "done"), ("b", "expired")}


def test_best_of_a_task(spark):
    """Each query's best over all batches of a task leave it, not those of every batch; and the scan needs no full partition."""
    r = np.random.default_rng(5)
    x = r.standard_normal((700, 8)).astype(np.float32)
    x[300:340] = x[:40]  # ties
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "rowid long, embedding array<float>")
    q = p.where("rowid < 350").selectExpr("rowid as qid", "0 as segment", "cast(embedding as array<double>) as vec")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        rows = search.scored(p, q, best=3)
        assert rows.count() <= 350 * 3 * spark.sparkContext.defaultParallelism
        got = {(w.qid, w["rank"]): (w.rowid, w.similarity) for w in search.top(rows, 3, ["qid"]).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    d = x.astype(np.float64)
    n = np.sqrt(np.cumsum(d * d, axis=1)[:, -1])
    for i in range(350):
        s = np.cumsum(d * d[i], axis=1)[:, -1] / (n * n[i])
        best = np.lexsort((np.arange(700), -s))[:3]
        assert [got[i, k + 1] for k in range(3)] == [(int(b), float(s[b])) for b in best]
