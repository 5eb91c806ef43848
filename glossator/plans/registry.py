"""The registered queries of the passage engine over the driver's tables, each with its SQL where SQL expresses it.

Roles: a row of ``embeddings`` is a passage (rowid = vec_id, document = label, section = its place in the document); a row of
``documents`` is a document of one page; ``events`` are changes and saved searches; ``conversations`` are passages with context.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codecs, registered, texts, tokenizers, vectors
from ..functions.words import chunks
from ..operators import control, duplicates, ingest, items, overlap, search, searching, store
from ..sources.files import html_pages
from ..streaming import changes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("label").orderBy("vec_id")
    df = table(spark, sf_dir, "embeddings")
    return df.select(F.col("vec_id").alias("rowid"), F.col("label").cast("string").alias("id"), (F.row_number().over(w) - 1).alias("section_number"), "embedding")


def segments(spark: SparkSession, sf_dir: str, ids: list[int]) -> DataFrame:
    """The query of these vectors, a segment each."""
    e = table(spark, sf_dir, "embeddings").where(F.col("vec_id").isin(ids))
    place = F.create_map(*(F.lit(x) for pair in ((i, n) for n, i in enumerate(ids)) for x in pair))
    return e.select(F.lit(0).cast("long").alias("qid"), place[F.col("vec_id").cast("int")].alias("segment"), vectors.as_doubles(F.col("embedding")).alias("vec"))


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


P = """p as (select vec_id as rowid, cast(label as varchar) as id, cast(row_number() over (partition by label order by vec_id) - 1 as integer) as section_number,
    cast(embedding as double[]) as v from embeddings)"""


def sims(ids: list[int], extra: str = "") -> str:
    q = ", ".join(f"({i}, {n})" for n, i in enumerate(ids))
    return f"""{P}, q as (select segment, v as qv from p join (values {q}) t(qid_, segment) on p.rowid = t.qid_),
        s as (select rowid, id, section_number, segment, list_cosine_similarity(v, qv) as similarity from p, q {extra})"""


# vectors


@query(f"with {sims([0])} select rowid, round(similarity, 6) as similarity, row_number() over (order by similarity desc, rowid) as rank from s where similarity >= 0.2 order by rank limit 20")
def vec_topk(spark, sf):
    got = search.rank(passages(spark, sf), segments(spark, sf, [0]), 0.2, 20)
    return got.select("rowid", r6("similarity").alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query(f"with {sims([1, 2, 3])} select segment, rowid, round(similarity, 6) as similarity from s where similarity >= 0.25")
def vec_threshold(spark, sf):
    got = search.scored(passages(spark, sf), segments(spark, sf, [1, 2, 3]), 0.25)
    return got.select("segment", "rowid", r6("similarity").alias("similarity"))


CENTROID = """c1 as (select id, k, sum(x / n) as x from (select id, unnest(v) as x, unnest(range(1, len(v) + 1)) as k, sqrt(list_sum(list_transform(v, lambda y: y * y))) as n from p) group by id, k),
    c2 as (select id, list(x order by k) as u from c1 group by id),
    c as (select id, list_transform(u, lambda y: y / sqrt(list_sum(list_transform(u, lambda z: z * z)))) as c from c2)"""


@query(f"""with {P}, {CENTROID}, s as (select c.id as qid, rowid, list_cosine_similarity(v, c) as similarity from p, c)
    select qid, rowid, round(similarity, 6) as similarity, row_number() over (partition by qid order by similarity desc, rowid) as rank from s
    qualify row_number() over (partition by qid order by similarity desc, rowid) <= 10""")
def vec_topk_batch(spark, sf):
    p = passages(spark, sf)
    q = search.centroids(p).select(F.col("id").alias("qid"), F.lit(0).alias("segment"), F.col("centroid").alias("vec"))
    got = search.top(search.scored(p, q, best=10), 10, ["qid"])
    return got.select("qid", "rowid", r6("similarity").alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query(f"with {sims([0])} select rowid, id, round(similarity, 6) as similarity from s where id in ('1', '3', '5', 'none') order by similarity desc, rowid limit 15")
def vec_topk_restricted(spark, sf):
    keys = spark.range(1).select(F.explode(F.array(*map(F.lit, ("1", "3", "5", "none")))).alias("id"))
    got = search.rank(passages(spark, sf), segments(spark, sf, [0]), -2.0, 15, keys)
    return got.select("rowid", "id", r6("similarity").alias("similarity"))


@query(f"""with {sims([0, 1, 2])} select rowid, round(max(similarity), 6) as similarity, cast(arg_max(segment, (similarity, -segment)) as integer) as segment from s
    where similarity >= 0.1 group by rowid""")
def vec_maxpool_segments(spark, sf):
    got = search.pooled(search.scored(passages(spark, sf), segments(spark, sf, [0, 1, 2]), 0.1))
    return got.select("rowid", r6("similarity").alias("similarity"), "segment")


@query(f"with {P}, {CENTROID} select id, unnest(range(0, len(c))) as k, round(unnest(c), 6) as x from c")
def vec_centroid(spark, sf):
    got = search.centroids(passages(spark, sf)).select("id", F.posexplode("centroid").alias("k", "x"))
    return got.select("id", F.col("k").cast("long").alias("k"), r6("x").alias("x"))


@query(f"""with {P}, {CENTROID}, s as (select c.id as source, p.id, rowid, list_cosine_similarity(v, c) as score from p join c on p.id != c.id)
    select source, id, round(max(score), 6) as best, round(avg(score), 6) as mean, arg_max(rowid, (score, -rowid)) as rowid,
    row_number() over (partition by source order by max(score) desc, arg_max(rowid, (score, -rowid))) as rank from s group by source, id""")
def vec_similar_docs(spark, sf):
    p = passages(spark, sf)
    got = search.similar_documents(p, search.centroids(p))
    return got.select("source", "id", r6("best").alias("best"), r6("mean").alias("mean"), "rowid", F.col("rank").cast("long").alias("rank"))


@query(f"""with {sims([0])} select id, round(max(similarity), 6) as best, count(*) as n, array_to_string(list(rowid order by similarity desc, rowid), ',') as members from s
    where similarity >= 0.1 group by id""")
def vec_group_by_doc(spark, sf):
    rows = search.scored(passages(spark, sf), segments(spark, sf, [0]), 0.1)
    return search.grouped_by_document(rows).select("id", r6("best").alias("best"), "n", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@query(f"with {sims([0])} select id, rowid, round(similarity, 6) as similarity from s qualify row_number() over (partition by id order by similarity desc, rowid) = 1")
def vec_best_per_doc(spark, sf):
    return search.best_per_document(search.scored(passages(spark, sf), segments(spark, sf, [0]))).select("id", "rowid", r6("similarity").alias("similarity"))


@query(f"""with {sims([0])}, f as (select rowid, id, section_number, floor(similarity * 10 + 0.5) / 10 as similarity from s)
    select rowid, id, section_number, similarity, coalesce(array_to_string(others, ','), '') as duplicates from (
        select *, row_number() over w as n, list(id) over (partition by section_number, similarity order by rowid rows between 1 following and unbounded following) as others
        from f window w as (partition by section_number, similarity order by rowid)) where n = 1""")
def vec_identical_collapse(spark, sf):
    rows = search.scored(passages(spark, sf), segments(spark, sf, [0])).withColumn("similarity", vectors.round_to(F.col("similarity"), 1))
    got = search.collapsed(rows)
    return got.select("rowid", "id", "section_number", "similarity", F.array_join("duplicates", ",").alias("duplicates"))


@query(f"""with {P}, q as (select unnest(v) as x, unnest(range(1, len(v) + 1)) as k from p where rowid in (3, 4, 5, 6)), m as (select k, sum(x) as x from q group by k),
    u as (select list(x order by k) as u from m) select rowid, round(list_cosine_similarity(v, u), 6) as similarity from p, u""")
def vec_mean_query(spark, sf):
    q = segments(spark, sf, [3, 4, 5, 6]).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("segment", "vec"))), lambda t: t["vec"]).alias("all"))
    q = q.select("qid", F.lit(0).alias("segment"), vectors.mean_unit(F.col("all")).alias("vec"))
    return search.scored(passages(spark, sf), q).select("rowid", r6("similarity").alias("similarity"))


I8 = """n8 as (select rowid, list_transform(v, lambda y: y / sqrt(list_sum(list_transform(v, lambda z: z * z)))) as u from p),
    s8 as (select rowid, u, list_max(list_transform(u, lambda y: abs(y))) / 127 as scale from n8)"""


@query(f"with {P}, {I8} select rowid, unnest(range(0, len(u))) as k, cast(floor(unnest(u) / scale + 0.5) as bigint) as q, round(scale, 9) as scale from s8")
def vec_int8_quantize(spark, sf):
    q = passages(spark, sf).select("rowid", vectors.quantized8(F.col("embedding")).alias("z"))
    got = q.select("rowid", F.round("z.scale", 9).alias("scale"), F.posexplode("z.q").alias("k", "q"))
    return got.select("rowid", F.col("k").cast("long").alias("k"), F.col("q").cast("long").alias("q"), "scale")


@query(f"""with {P}, {I8}, q16 as (select u, list_max(list_transform(u, lambda y: abs(y))) / 32767 as scale from n8 where rowid = 0)
    select a.rowid, round(list_dot_product(list_transform(a.u, lambda y: floor(y / a.scale + 0.5)), list_transform(b.u, lambda y: floor(y / b.scale + 0.5))) * a.scale * b.scale, 6) as similarity
    from s8 a, q16 b""")
def vec_int8_scan(spark, sf):
    q = segments(spark, sf, [0]).select(vectors.quantized16(F.col("vec")).alias("q"))
    z = passages(spark, sf).select("rowid", vectors.quantized8(F.col("embedding")).alias("z"))
    return z.join(F.broadcast(q), F.lit(True)).select("rowid", r6(vectors.scanned(F.col("z"), F.col("q"))).alias("similarity"))


@query()
def vec_int8_scan_error(spark, sf):
    """The largest error of the approximate scan against the exact one, over all passages."""
    q = [(r.qid, r.segment, r.vec) for r in segments(spark, sf, [0, 1, 2]).collect()]
    p = passages(spark, sf)
    a = search.scan(p, q, -2.0, approximate=True).withColumnRenamed("similarity", "near")
    return a.join(search.scan(p, q, -2.0), ["qid", "segment", "rowid"]).agg(F.max(F.abs(F.col("near") - F.col("similarity"))).alias("error"), F.count(F.lit(1)).alias("n"))


@query(f"with {sims([0, 1])} select rowid, round(max(similarity), 6) as similarity from s where similarity >= 0.1 group by rowid order by max(similarity) desc, rowid limit 25")
def vec_two_phase(spark, sf):
    q = [(r.qid, r.segment, r.vec) for r in segments(spark, sf, [0, 1]).collect()]
    return search.two_phase(passages(spark, sf), q, 0.1, 25, collapse=False).select("rowid", r6("similarity").alias("similarity"))


COLLAPSED = """a as (select rowid, id, section_number, max(similarity) as similarity from s where similarity >= {} group by all),
    o as (select * from a qualify row_number() over (partition by id, section_number order by similarity desc, rowid) = 1),
    k as (select * from o qualify row_number() over (partition by section_number, cast(similarity as decimal(10,7)) order by similarity desc, rowid) = 1)"""


@query(f"with {sims([0, 1])}, {COLLAPSED.format(0.1)} select rowid, round(similarity, 6) as similarity from k order by k.similarity desc, rowid limit 40")
def vec_rank_collapsed(spark, sf):
    """Ranked results where copies in other documents stand as one."""
    return search.rank(passages(spark, sf), segments(spark, sf, [0, 1]), 0.1, 40).select("rowid", r6("similarity").alias("similarity"))


@query(f"""with {sims([0, 1])}, m as (select rowid, max(similarity) as best from s group by rowid), c as (select rowid from m where best >= (select min(best) from (select best from m order by best desc limit 25)) - 0.02),
    t as (select * from s where rowid in (select rowid from c)), {COLLAPSED.format(0.1).replace("from s ", "from t ")}
    select rowid, round(similarity, 6) as similarity from k order by k.similarity desc, rowid limit 25""")
def vec_two_phase_collapsed(spark, sf):
    q = [(r.qid, r.segment, r.vec) for r in segments(spark, sf, [0, 1]).collect()]
    return search.two_phase(passages(spark, sf), q, 0.1, 25).select("rowid", r6("similarity").alias("similarity"))


@query(f"""with {P}, q as (select rowid as qid, v as qv from p) select qid, rowid, round(list_cosine_similarity(v, qv), 6) as similarity,
    row_number() over (partition by qid order by list_cosine_similarity(v, qv) desc, rowid) as rank from p, q qualify rank <= 3""")
def vec_topk_all(spark, sf):
    """Every passage as a query of its own, in blocks."""
    p = passages(spark, sf)
    q = p.select(F.col("rowid").alias("qid"), F.lit(0).alias("segment"), vectors.as_doubles(F.col("embedding")).alias("vec"))
    got = search.top(search.scored(p.select("rowid", "embedding"), q, best=3), 3, ["qid"])
    return got.select("qid", "rowid", r6("similarity").alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query()
def f16_roundtrip(spark, sf):
    """Vectors through half precision and back: the largest relative error over all."""
    p = passages(spark, sf).withColumn("back", codecs.f16_vector(codecs.f16_bytes("embedding")))
    error = F.array_max(F.zip_with("embedding", "back", lambda a, b: F.abs(a - b) / F.greatest(F.abs(a), F.lit(1e-4))))
    return p.select(error.alias("e")).agg(F.max("e").alias("error"), F.count(F.lit(1)).alias("n"))


@query("select vec_id as rowid, unnest(range(0, len(embedding))) as k, round(cast(unnest(embedding) as double), 6) as x from embeddings")
def json_vector_roundtrip(spark, sf):
    p = table(spark, sf, "embeddings")
    text = F.when(F.col("label") % 2 == 0, F.to_json("embedding")).otherwise(F.to_json(F.array("embedding")))
    got = p.select(F.col("vec_id").alias("rowid"), F.posexplode(vectors.from_json_vector(text)).alias("k", "x"))
    return got.select("rowid", F.col("k").cast("long").alias("k"), r6(F.col("x").cast("double")).alias("x"))


# documents and state


@query("select cast(label as varchar) as id, count(*) as sections, max(vec_id) as last from embeddings group by label")
def doc_sections(spark, sf):
    return passages(spark, sf).groupBy("id").agg(F.count(F.lit(1)).alias("sections"), F.max("rowid").alias("last"))


@query("select source as id, count(*) as sections, min(doc_id) as first, coalesce(max(case when lang = 'de' then 2 end), 1) as scheme, max(lang) as file_name from documents group by source")
def doc_info(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("id"), F.col("doc_id").alias("date"), F.when(F.col("lang") == "de", 2).alias("scheme"), F.col("lang").alias("file_name"))
    return store.document_info(d).withColumnRenamed("date", "first")


@query("select count(distinct label) as documents, count(*) as passages from embeddings")
def doc_count_distinct(spark, sf):
    return passages(spark, sf).agg(F.count_distinct("id").alias("documents"), F.count(F.lit(1)).alias("passages"))


@query("select count(*) || ':' || coalesce(max(vec_id), 0) as state from embeddings where label != 3")
def state_key(spark, sf):
    return store.state_key(store.without(passages(spark, sf), spark.range(1).select(F.lit("3").alias("id"))))


# saved searches and statuses

HISTORY = "h as (select user_id as id, ts as date, event_type as query, event_id as rowid, case when value > 50 then 'mcp' end as source from events)"


def history(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    none = F.array().cast("array<string>")
    return e.select(F.col("user_id").alias("id"), F.col("ts").alias("date"), F.col("event_type").alias("query"), F.col("event_id").alias("rowid"), F.when(F.col("value") > 50, "mcp").alias("source"), none.alias("results"))


@query(f"with {HISTORY} select id, rowid, query from h qualify row_number() over (partition by id order by date desc, rowid desc) = 1")
def history_latest(spark, sf):
    return store.latest(history(spark, sf)).select("id", "rowid", "query")


@query(f"with {HISTORY} select query, count(*) as n from h where contains(lower(query), 'c') and source = 'mcp' group by query")
def history_filter(spark, sf):
    return store.matching(history(spark, sf), "C", "mcp").groupBy("query").agg(F.count(F.lit(1)).alias("n"))


@query("select sha256('e5-small' || chr(10) || text) as id, sha256('mcp' || chr(10) || text) as tool_id, item_id from benchmark")
def history_id_sha256(spark, sf):
    b = table(spark, sf, "benchmark")
    return b.select(texts.history_id(F.col("text"), F.lit("e5-small"), F.lit("manual")).alias("id"), texts.history_id(F.col("text"), F.lit("lealla"), F.lit("mcp")).alias("tool_id"), "item_id")


@query("""select d.doc_id, d.source as folder_id, d.doc_id % 50 as section_number, l.status from documents d left join
    (select source, doc_id % 50 as s, min(toxic + 1) as status from documents join labels using (doc_id) group by all) l on d.source = l.source and d.doc_id % 50 = l.s""")
def status_carry_section(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("folder_id"), (F.col("doc_id") % 50).alias("section_number"))
    old = d.join(table(spark, sf, "labels"), "doc_id").select("folder_id", "section_number", (F.col("toxic") + 1).alias("status"))
    return store.carried_by_section(d, old).select("doc_id", "folder_id", "section_number", "status")


@query("""with o as (select source, doc_id % 50 as page, arg_min(case when toxic = 1 then 1 else 2 end, struct_pack(a := case when toxic = 1 then 0 else 1 end, b := doc_id)) as status
    from documents join labels using (doc_id) group by all)
    select d.doc_id, o.status from documents d left join o on d.source = o.source and d.doc_id % 50 = o.page""")
def status_carry_page(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("folder_id"), (F.col("doc_id") % 50).alias("page"))
    old = d.join(table(spark, sf, "labels"), "doc_id").select("folder_id", "page", F.when(F.col("toxic") == 1, 1).otherwise(2).alias("status"), F.col("doc_id").alias("rank"))
    return store.carried_by_page(d, old).select("doc_id", "status")


# items, filters, pages


@query("select lang as item_type, count(*) as n from documents where lang is not null group by lang")
def facet_counts(spark, sf):
    return items.facets(table(spark, sf, "documents").withColumnRenamed("lang", "item_type"))


@query("""select d.doc_id, lang as item_type from documents d left join labels l using (doc_id) where lang in ('de', 'fr')
    and coalesce(case when toxic = 1 then 2 when quality = 1 then 1 end, 0) != 2""")
def result_filters(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    rows = d.select("doc_id", F.col("lang").alias("item_type"), F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 1).alias("status"))
    return items.filtered(rows, ["de", "fr"], None, "hide-irrelevant").select("doc_id", "item_type")


@query("select case when toxic = 1 then 'manual' when quality = 0 then 'no_text' else 'other' end as reason, count(*) as n from labels group by 1")
def excluded_by_reason(spark, sf):
    reason = F.when(F.col("toxic") == 1, "manual").when(F.col("quality") == 0, "no_text").otherwise("other")
    return items.facets(table(spark, sf, "labels").select(reason.alias("reason")), "reason")


@query("select o_orderkey, o_totalprice, (select count(*) from orders where o_orderstatus = 'O') as total from orders where o_orderstatus = 'O' order by o_totalprice desc, o_orderkey limit 25 offset 50")
def page_limit_offset(spark, sf):
    total, page = items.paged(table(spark, sf, "orders").where("o_orderstatus = 'O'"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 25, 50)
    return page.select("o_orderkey", "o_totalprice").join(F.broadcast(total), F.lit(True))


@query("""select o_orderkey, c_custkey from orders left join customer on o_custkey = c_custkey and c_custkey % 2 = 0
    where coalesce(case when c_custkey is not null then date '1992-01-01' + cast(c_custkey % 3000 as integer) end, cast(o_orderdate as date)) >= date '1996-06-01'""")
def added_since_coalesce(spark, sf):
    a = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("parent_id"), F.col("o_orderdate").cast("timestamp").alias("date_added"))
    day = F.date_add(F.lit("1992-01-01").cast("date"), (F.col("c_custkey") % 3000).cast("int")).cast("timestamp")
    parents = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("item_id"), day.alias("date_added"))
    got = items.added_since(a, parents, texts.since_utc(F.lit("1996-06-01")))
    return got.join(parents.select(F.col("item_id").alias("c_custkey")), F.col("parent_id") == F.col("c_custkey"), "left").select("o_orderkey", "c_custkey")


@query("""with t as (select doc_id, unnest(string_split_regex(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' ')) as token from documents),
    k as (select distinct doc_id, token from t where length(token) >= 14)
    select distinct a.doc_id as new_id, b.doc_id as item_id from k a join k b using (token) where a.doc_id < b.doc_id""")
def identifier_overlap_join(spark, sf):
    d = table(spark, sf, "documents")
    found = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "), " "), lambda x: F.length(x) >= 14)
    k = d.select(F.col("doc_id").alias("id"), F.explode(found).alias("token"))
    return overlap.sharing(k).select(F.col("a").alias("new_id"), F.col("b").alias("item_id"))


@query("""select o_orderkey as id, floor(o_totalprice * 1e4 / 1e6 + 0.5) / 1e4 as score, o_custkey + 1 as page_number, strftime(o_orderdate, '%Y-%m-%d') as day,
    case when length(o_orderpriority) > 6 then substr(o_orderpriority, 1, 6) || '…' else o_orderpriority end as shown from orders""")
def result_shape(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1e6).alias("similarity"), F.col("o_custkey").alias("page"), F.col("o_orderdate").alias("date"), F.col("o_orderpriority").alias("chunk_text"))
    return search.shaped(o, 6).select("id", "score", "page_number", "day", "shown")


# ingestion


@query("select doc_id as id from documents where doc_id not in (select doc_id from labels where toxic = 1) and lang != 'en'")
def unprocessed_anti_join(spark, sf):
    d = table(spark, sf, "documents")
    gone = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    done = d.where("lang = 'en'").select(F.col("doc_id").alias("id"), F.lit("m").alias("model"))
    return ingest.unprocessed(d.select(F.col("doc_id").alias("id")), gone, done, ["m"]).select("id")


@query("""with m as (select doc_id, unnest(['arctic-m-v2', 'e5-small', 'lealla']) as model from documents where doc_id not in (select doc_id from labels where toxic = 1))
    select doc_id as id, string_agg(model, ',' order by model) as targets from m join documents d using (doc_id)
    where not (model = 'e5-small' and d.lang = 'en') and not (model = 'lealla' and d.doc_id % 3 = 0) group by doc_id""")
def unprocessed_multi_model(spark, sf):
    d = table(spark, sf, "documents")
    gone = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    one = d.where("lang = 'en'").select(F.col("doc_id").alias("id"), F.lit("e5-small").alias("model"))
    two = d.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.lit("lealla").alias("model"))
    got = ingest.unprocessed(d.select(F.col("doc_id").alias("id")), gone, one.unionByName(two), ["lealla", "e5-small", "arctic-m-v2"])
    return got.select("id", F.array_join("targets", ",").alias("targets"))


@query("""select coalesce(d.doc_id, l.doc_id) as rowid, case when l.doc_id is null then 'tombstone' else 'load' end as action
    from (select doc_id from documents where doc_id % 2 = 0) d full join labels l on d.doc_id = l.doc_id where d.doc_id is null or l.doc_id is null""")
def reconcile_full_outer(spark, sf):
    cached = table(spark, sf, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("rowid"))
    return ingest.reconciled(cached, table(spark, sf, "labels").select(F.col("doc_id").alias("rowid")))


@query("""select cast(label as varchar) as id, vec_id as rowid, 0 as fresh from embeddings union all
    select d.source, (select max(vec_id) from embeddings) + row_number() over (order by d.source, d.doc_id), 1 from documents d""")
def replace_documents(spark, sf):
    old = table(spark, sf, "embeddings").select(F.lit("m").alias("model"), F.col("label").cast("string").alias("id"), F.col("vec_id").alias("rowid"), F.lit(0).alias("fresh"))
    # the documents' sources are new documents beside the labels
    new = table(spark, sf, "documents").select(F.lit("m").alias("model"), F.col("source").alias("id"), F.col("doc_id").alias("section_number"), F.lit(None).cast("long").alias("rowid"), F.lit(1).alias("fresh"))
    return store.replace_documents(old, new).select("id", "rowid", "fresh")


@query("""select key, max(value) as value from (select 'k' || (l_orderkey % 97) as key, cast(l_partkey as varchar) as value from lineitem
    qualify row_number() over (partition by l_orderkey % 97 order by l_orderkey, l_partkey) = 1) where key not in (select 'k' || n_nationkey from nation) group by key
    union all select 'k' || n_nationkey, n_name from nation""")
def meta_upsert(spark, sf):
    w = Window.partitionBy(F.col("l_orderkey") % 97).orderBy("l_orderkey", "l_partkey")
    old = table(spark, sf, "lineitem").withColumn("n", F.row_number().over(w)).where("n = 1")
    old = old.select(F.concat(F.lit("k"), (F.col("l_orderkey") % 97).cast("string")).alias("key"), F.col("l_partkey").cast("string").alias("value"))
    new = table(spark, sf, "nation").select(F.concat(F.lit("k"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_name").alias("value"))
    return store.upsert(old, new, ["key"])


@query("select cast(label as varchar) as id, count(*) as n from embeddings where label not in (select n_nationkey from nation where n_regionkey = 1) group by label")
def exclusion_cascade(spark, sf):
    new = table(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").cast("string").alias("id"), F.lit("manual").alias("reason"))
    _, left = store.exclude(new.limit(0), passages(spark, sf), new)
    return left.groupBy("id").agg(F.count(F.lit(1)).alias("n"))


# texts


@query(r"""select doc_id, md5(trim(regexp_replace(regexp_replace(text, '(\p{L})[\x{AD}-]\s*[\n]\s*(\p{Ll})', '\1\2', 'g'), '[\p{Cc}\p{Cf}\s]+', ' ', 'g'))) as h from documents""")
def text_normalize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(texts.normalize_page(F.col("text"))).alias("h"))


@query(r"""select doc_id, md5(trim(regexp_replace(regexp_replace(text, '(\p{L})[-]\s*[\n]\s*(\p{Ll})', '\1\2', 'g'), '\s+', ' ', 'g'))) as h from documents""")
def text_clean(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(texts.clean(F.col("text"))).alias("h"))


@query(r"select doc_id, length(regexp_replace(text, '\s+', '', 'g')) as n from documents where length(regexp_replace(text, '\s+', '', 'g')) < 100")
def text_min_chars_filter(spark, sf):
    d = table(spark, sf, "documents")
    return d.where(texts.too_short(F.col("text"))).select("doc_id", texts.n_visible(F.col("text")).cast("long").alias("n"))


@query(r"""with t as (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as t from documents)
    select doc_id, case when length(t) <= 90 then t else regexp_replace(substr(t, 1, 90), '\s+\S*$', '') || '…' end as excerpt from t""")
def text_excerpt(spark, sf):
    return table(spark, sf, "documents").select("doc_id", texts.excerpt(F.col("text"), 90).alias("excerpt"))


@query("""select lang, count(*) as words, count(*) filter (where regexp_matches(w, '[.!?;:…»”)\\]]$')) as ends from
    (select lang, unnest(string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) as w from documents) group by lang""")
def text_sentence_end(spark, sf):
    w = table(spark, sf, "documents").select("lang", F.explode(F.split(texts.collapsed(F.col("text")), " ")).alias("w"))
    return w.groupBy("lang").agg(F.count(F.lit(1)).alias("words"), F.count_if(texts.sentence_end(F.col("w"))).alias("ends"))


@query("""with p as (select doc_id, cast(greatest(ceil(length(text) / 4.0), 1) as integer) as per, text from documents)
    select doc_id, unnest(range(0, 4)) as page, md5(substr(text, cast(unnest(range(0, 4)) * per + 1 as integer), per)) as h from p""")
def page_spread(spark, sf):
    got = table(spark, sf, "documents").select("doc_id", F.posexplode(texts.spread(F.col("text"), F.lit(4))).alias("page", "t"))
    return got.select("doc_id", F.col("page").cast("long").alias("page"), F.md5("t").alias("h"))


@query("""with s as (select conv_id, turn, length(text) as n, sum(length(text) + 1) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as b from conversations)
    select conv_id, turn, coalesce(b, 0) as start, row_number() over (partition by conv_id order by turn) - 1 as page from s""")
def page_starts(spark, sf):
    """Turns as pages: where each begins in the whole, and that the page of that offset is found again."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    c = c.withColumn("whole", texts.with_starts(F.transform("t", lambda x: x["text"])))
    got = c.select("conv_id", "whole", F.posexplode("t").alias("n", "x")).withColumn("start", F.get("whole.starts", F.col("n")))
    return got.select("conv_id", F.col("x.turn").alias("turn"), F.col("start").cast("long").alias("start"), texts.page_at(F.col("whole.starts"), F.col("start")).cast("long").alias("page"))


@query("""select conv_id as id, turn as section_number, md5(text || coalesce(' ' || b, '')) as h from (select conv_id, turn,
    coalesce(lag(text) over w || ' ', '') || text as text, lead(text) over w as b from conversations window w as (partition by conv_id order by turn))""")
def passage_context_window(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("section_number"), F.col("text").alias("chunk_text"))
    return search.context(c, c, 1).select("id", "section_number", F.md5("text").alias("h"))


@query("""with t as (select doc_id, text, length(text) as n, cast(floor(1 / 3.0 * length(text)) as integer) as raw from documents),
    b as (select *, strpos(reverse(substr(text, greatest(raw - 39, 1), least(raw, 40))), ' ') as back from t),
    s as (select *, case when raw > 0 and back > 0 then raw - back + 1 else raw end as start from b),
    e as (select *, strpos(substr(text, start + 1201, 40), ' ') as ahead from s)
    select doc_id, md5(trim(substr(text, start + 1, case when ahead > 0 then 1200 + ahead - 1 else 1200 end))) as h from e""")
def legacy_proportional_passage(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(texts.legacy_passage(F.col("text"), F.lit(1), F.lit(3.0))).alias("h"))


@query()
def chunk_passages(spark, sf):
    """All passages of all documents."""
    got = table(spark, sf, "documents").select("doc_id", F.posexplode(chunks(160)(F.array(texts.normalize_page(F.col("text"))))).alias("section", "c"))
    return got.select("doc_id", "section", "c.text", "c.page", "c.char_start", "c.pieces")


@query(r"""select page_id, length(t) as n, md5(t) as h from (select page_id, regexp_replace(trim(regexp_replace(replace(replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<template\b.*?</template\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
    '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')), '^$', '') as t from pages)""")
def html_text(spark, sf):
    got = html_pages(table(spark, sf, "pages")).select("page_id", texts.collapsed(F.get("pages", F.lit(0))).alias("t"))
    return got.select("page_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("h"))


# duplicates


def hashes(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("key"), F.col("n_chars").alias("size"), duplicates.content_hash(F.col("text").cast("binary")).alias("hash"))


GROUPS = "select 'sha256:' || sha256(text) as hash, max(n_chars) as size, count(*) as n, array_to_string(list(doc_id order by doc_id), ',') as keys from documents {} group by 1 having count(*) > 1"


@query(GROUPS.format(""))
def dup_hash_groups(spark, sf):
    h = hashes(spark, sf)
    got = duplicates.groups(h, h.limit(0), h)
    return got.select("hash", "size", "n", F.array_join(F.col("keys").cast("array<string>"), ",").alias("keys"))


@query(GROUPS.format("where doc_id not in (select doc_id from labels where quality = 0) and sha256(text) not in (select sha256(text) from documents join labels using (doc_id) where toxic = 1)"))
def dup_ignore_anti(spark, sf):
    h, labels = hashes(spark, sf), table(spark, sf, "labels")
    ignored = h.join(labels.where("toxic = 1").select(F.col("doc_id").alias("key")), "key")
    live = h.join(labels.where("quality = 0").select(F.col("doc_id").alias("key")), "key", "left_anti")
    got = duplicates.groups(h, ignored, live)
    return got.select("hash", "size", "n", F.array_join(F.col("keys").cast("array<string>"), ",").alias("keys"))


@query("""select o_custkey as hash, arg_min(o_orderkey, struct_pack(a := case when o_orderstatus = 'F' then 0 else 1 end, b := -cast(substr(o_orderpriority, 1, 1) as integer), c := o_orderdate, d := o_orderkey)) as key
    from orders group by o_custkey""")
def dup_keeper_rank(spark, sf):
    o = table(spark, sf, "orders")
    m = o.select(
        F.col("o_custkey").alias("hash"), F.col("o_orderkey").alias("key"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(2).alias("parent_id"), F.lit(1).alias("master_id"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("annotations"), F.col("o_orderdate").alias("date_added"),
    )
    return duplicates.keeper(m)


@query("""with f as (select n_regionkey as hash, n_nationkey as item_id, unnest([n_name, substr(n_name, 1, 1), '']) as value, unnest(['name', 'initial', 'empty']) as name from nation)
    select hash, name, arg_max(value, item_id) as value from f where value != '' group by hash, name""")
def dup_merge_fields(spark, sf):
    n = table(spark, sf, "nation")
    fields = F.create_map(F.lit("name"), F.col("n_name"), F.lit("initial"), F.substring("n_name", 1, 1), F.lit("empty"), F.lit(""))
    parents = n.select(F.col("n_regionkey").alias("hash"), F.col("n_nationkey").alias("item_id"), F.col("n_nationkey").alias("date_modified"), fields.alias("fields"))
    return duplicates.merged_fields(parents).select("hash", F.explode("fields").alias("name", "value"))


# changes over time


SESSIONS = """with g as (select {key} as key, ts, case when ts - lag(ts) over ({part} order by ts) <= interval '{gap}' then 0 else 1 end as fresh from events),
    s as (select *, sum(fresh) over ({part} order by ts rows unbounded preceding) as n from g)"""


@query(SESSIONS.format(key="user_id", part="partition by user_id", gap="1 hour").replace("partition by user_id order by ts rows", "partition by key order by ts rows")
    + " select key, epoch_us(min(ts)) as first, epoch_us(max(ts)) as last, count(*) as n from s group by key, s.n")
def debounce_sessions(spark, sf):
    e = changes.timed(table(spark, sf, "events")).select(F.col("user_id").alias("key"), "ts")
    got = changes.debounced(e, "1 hour")
    return got.select("key", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"), "n")


@query(SESSIONS.format(key="0", part="", gap="4 minutes") + " select epoch_us(min(ts)) as begin, count(*) as n from s group by s.n")
def alert_batches(spark, sf):
    e = changes.timed(table(spark, sf, "events")).select(F.col("event_type").alias("title"), "ts")
    return changes.bursts(e, "4 minutes").select(F.unix_micros("begin").alias("begin"), "n")


@query("""select o_orderkey as key from (select o_orderkey, sum(cast(o_totalprice as bigint)) over (order by o_orderdate desc, o_orderkey) as total from orders) where total <= 300000000""")
def lru_prune_running_sum(spark, sf):
    f = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.bround("o_totalprice").cast("long").alias("size"), F.col("o_orderdate").alias("mtime"))
    return store.fitting(f, 300_000_000).select("key")




# scans of passages


@query("select vec_id as rowid, label from embeddings where vec_id in (select o_orderkey from orders where o_orderstatus = 'F')")
def scan_rowid_list(spark, sf):
    wanted = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("rowid"))
    return store.by_rowids(table(spark, sf, "embeddings").select(F.col("vec_id").alias("rowid"), "label"), wanted)


@query("select vec_id as rowid, label from embeddings where vec_id between 100 and 299")
def scan_rowid_range(spark, sf):
    return store.in_range(table(spark, sf, "embeddings").select(F.col("vec_id").alias("rowid"), "label"), 100, 299)


@query("select vec_id as rowid from embeddings")
def scan_rowids(spark, sf):
    return store.rowids(passages(spark, sf))


@query("select distinct source as id, 'all' as kind from documents where source is not null union all select distinct source, 'legacy' from documents where source is not null and lang != 'de'")
def indexed_ids(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("id"), F.when(F.col("lang") == "de", 2).alias("scheme"))
    return store.indexed_ids(d).withColumn("kind", F.lit("all")).unionByName(store.indexed_ids(d, True).withColumn("kind", F.lit("legacy")))


@query(f"with {P} select rowid, id, section_number, count(*) over (partition by id) as section_count from p")
def index_entries(spark, sf):
    got = store.entries(passages(spark, sf).withColumn("file_name", F.lit("f")))
    return got.select("rowid", "id", "section_number", "section_count")


@query("""with l as (select doc_id as place, source as id from documents where doc_id % 3 != 0), n as (select id, row_number() over (order by min(place)) - 1 as document from l group by id)
    select place, id, document from l join n using (id)""")
def index_compaction(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("place"), F.col("source").alias("id"), (F.col("doc_id") % 3 != 0).alias("live"), F.lit(0).alias("document"))
    return store.compacted(d).select("place", "id", F.col("document").cast("long").alias("document"))


@query("""select * from (select cast(label as varchar) as id, vec_id as rowid, 0 as fresh from embeddings where cast(label as varchar) not in (select cast(doc_id as varchar) from documents)) union all
    select cast(d.doc_id as varchar), (select max(vec_id) from embeddings) + row_number() over (order by cast(d.doc_id as varchar)), 1 from documents d""")
def replace_documents_again(spark, sf):
    """Documents that are there already lose their old passages."""
    old = table(spark, sf, "embeddings").select(F.lit("m").alias("model"), F.col("label").cast("string").alias("id"), F.col("vec_id").alias("rowid"), F.lit(0).alias("fresh"))
    new = table(spark, sf, "documents").select(F.lit("m").alias("model"), F.col("doc_id").cast("string").alias("id"), F.lit(0).alias("section_number"), F.lit(None).cast("long").alias("rowid"), F.lit(1).alias("fresh"))
    return store.replace_documents(old, new).select("id", "rowid", "fresh")


@query("select model, count(*) as n from (select unnest(['a', 'b', 'c']) as model from embeddings) where model != 'b' group by model")
def delete_model(spark, sf):
    p = passages(spark, sf).withColumn("model", F.explode(F.array(*map(F.lit, "abc"))))
    return store.without_model(p, "b", "a", "c").groupBy("model").agg(F.count(F.lit(1)).alias("n"))


# items once more


def orders_as_files(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderkey").alias("item_id"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("parent_id"),
        F.col("o_orderpriority").alias("title"), F.col("o_orderdate").cast("timestamp").alias("date_added"), F.when(F.col("o_orderstatus") == "F", "application/pdf").otherwise("text/html").alias("content_type"),
        F.lit(False).alias("deleted"), (F.col("o_orderkey") % 3).cast("int").alias("annotations"),
    )


def customers_as_items(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer")
    fields = F.create_map(F.lit("date"), F.when(F.col("c_custkey") % 7 == 0, "0000").otherwise(F.concat(F.lit("19"), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"), F.lit("-05"))), F.lit("url"), F.lit("u"), F.lit("publicationTitle"), F.col("c_mktsegment"))
    person = F.struct(F.lit("A").alias("first_name"), F.concat(F.lit("B"), (F.col("c_custkey") % 10).cast("string")).alias("last_name"), F.lit(None).cast("string").alias("name"), F.when(F.col("c_custkey") % 2 == 0, "author").otherwise("translator").alias("creator_type"))
    return c.select(
        F.col("c_custkey").alias("item_id"), F.col("c_name").alias("key"), F.col("c_name").alias("title"), F.when(F.col("c_nationkey") < 12, "book").otherwise("article").alias("item_type"), fields.alias("fields"), F.array(person).alias("creators"),
        F.array(F.col("c_mktsegment")).alias("collections"), F.timestamp_seconds(F.col("c_custkey")).alias("date_added"), (F.col("c_custkey") % 11 == 0).alias("deleted"),
    )


ITEMS = """a as (select *, cast(o_orderkey as varchar) as key, case when o_orderkey % 5 != 0 then o_custkey end as parent_id from orders),
    i as (select *, case when c_custkey % 7 != 0 then '19' || lpad(cast(c_custkey % 100 as varchar), 2, '0') end as year from customer)"""


@query(f"""with {ITEMS} select key, c_name as title, year, case when c_custkey % 2 = 0 then 'B' || (c_custkey % 10) else '' end as authors, c_mktsegment as publication,
    case when c_nationkey < 12 then 'book' when c_custkey is not null then 'article' end as item_type, coalesce(c_custkey % 11 = 0, true) as missing from a left join i on coalesce(parent_id, -1) = c_custkey""")
def item_metadata(spark, sf):
    files = orders_as_files(spark, sf).withColumn("item_id", F.lit(-1).cast("long"))
    got = items.described(files, customers_as_items(spark, sf))
    return got.select("key", "title", "year", F.coalesce("authors", F.lit("")).alias("authors"), "publication", "item_type", "missing")


@query(f"""with {ITEMS} select key, coalesce(c_name, o_orderpriority) as title, case when c_custkey is not null then year end as year, case when c_custkey is not null then 3 else 0 end as field_count,
    c_custkey is not null as has_metadata, case when c_custkey is not null then 1 else 0 end as collections, cast(o_orderkey % 3 as integer) as annotations from a left join i on parent_id = c_custkey""")
def duplicate_view(spark, sf):
    got = items.described_files(orders_as_files(spark, sf), customers_as_items(spark, sf))
    return got.select("key", "title", "year", "field_count", "has_metadata", "collections", "annotations")


@query("""select coalesce(case when o_orderkey % 5 != 0 then o_custkey end, o_orderkey) as item_id, cast(arg_min(o_orderkey, struct_pack(a := case when o_orderstatus = 'F' then 0 else 1 end, b := o_orderdate, c := o_orderkey)) as varchar) as key
    from orders group by 1""")
def best_attachment(spark, sf):
    got = items.best_attachment(orders_as_files(spark, sf))
    return got.select(F.coalesce("parent_id", "item_id").alias("item_id"), "key")


@query("""with d as (select distinct c_custkey as id, token from customer, (select unnest(['doi', 'isbn']) as kind), lateral (select case when kind = 'doi' then '10.' || (c_custkey % 700) || '/x' else '97800' || lpad(cast(c_custkey % 900 as varchar), 8, '0') end as token)),
    n as (select s_suppkey as new_id, '10.' || (s_suppkey % 700) || '/x' as token from supplier union all select s_suppkey, '97800' || lpad(cast((s_suppkey * 3) % 900 as varchar), 8, '0') from supplier)
    select distinct new_id, id as item_id from n join d using (token)""")
def same_identifier(spark, sf):
    """New items that share a DOI or ISBN, however they are written, with known ones."""
    number = lambda k: F.concat(F.lit("978-0-0"), F.lpad((k % 900).cast("string"), 8, "0"))
    doi = lambda head, k, tail: F.concat(F.lit(head), (k % 700).cast("string"), F.lit(tail))
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    known = table(spark, sf, "customer").select(k.alias("item_id"), F.create_map(F.lit("DOI"), doi("https://doi.org/10.", k, "/X"), F.lit("ISBN"), F.concat(F.lit("short, "), number(k))).alias("fields"))
    new = table(spark, sf, "supplier").select(s.alias("item_id"), F.create_map(F.lit("DOI"), doi("10.", s, "/x"), F.lit("ISBN"), number(s * 3)).alias("fields"))
    return items.same_identifier(new, known)


@query("""select o_orderkey as item_id, field, value from (select o_orderkey, unnest(['clerk', 'status', 'day']) as field, unnest([o_orderpriority, o_orderstatus, strftime(o_orderdate, '%Y')]) as value from orders) where field in ('clerk', 'day')""")
def item_values(spark, sf):
    """Items' values, kept apart as a table of fields and one of values."""
    o = table(spark, sf, "orders")
    rows = o.select(F.col("o_orderkey").alias("item_id"), F.explode(F.create_map(F.lit("clerk"), F.col("o_orderpriority"), F.lit("status"), F.col("o_orderstatus"), F.lit("day"), F.date_format("o_orderdate", "yyyy"))).alias("field", "value"))
    data = rows.select("item_id", "field", F.xxhash64("value").alias("value_id"))
    return items.by_value(o.select(F.col("o_orderkey").alias("item_id")), data, rows.select(F.xxhash64("value").alias("value_id"), "value").distinct(), ["clerk", "day"])


@query("""select o_orderkey as item_id, case when o_orderstatus = 'F' then 'journal' when o_orderstatus = 'O' then 'venue' else 'venue' end as name, o_orderpriority as value, o_orderstatus = 'P' as ignored from orders""")
def field_remap(spark, sf):
    """A field under the name that an item's type has for it; types without one ignore it."""
    v = table(spark, sf, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderstatus").alias("item_type"), F.lit("venue").alias("name"), F.col("o_orderpriority").alias("value"))
    pair = lambda *rows: spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in r)) for r in rows))))
    valid = pair((("item_type", "F"), ("name", "journal")), (("item_type", "O"), ("name", "venue")))
    bases = pair((("item_type", "F"), ("base", "venue"), ("name", "journal")), (("item_type", "P"), ("base", "venue"), ("name", "gone")))
    return items.remapped(v, valid, bases)


@query(f"""with {P}, r as (select vec_id as rowid, vec_id % 7 as s from embeddings) select r.rowid, coalesce(d.text, e.text) as chunk_text, coalesce(l.toxic = 1, true) as missing
    from r left join documents d on d.doc_id = r.rowid and r.rowid % 2 = 0 left join documents e on e.doc_id = r.rowid left join labels l on l.doc_id = r.rowid""")
def enriched_results(spark, sf):
    """Results with their text, by row or else by place, and whether their item is gone."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    p = d.select(F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).otherwise(F.col("doc_id") + 1_000_000_000).alias("rowid"), F.col("doc_id").cast("string").alias("id"), F.lit(0).alias("section_number"), F.col("text").alias("chunk_text"), F.lit(1).alias("page"))
    i = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("key"), F.lit("t").alias("item_type"), F.lit("x").alias("title"), (F.col("toxic") == 1).alias("deleted"))
    r = table(spark, sf, "embeddings").select(F.col("vec_id").alias("rowid"), F.col("vec_id").cast("string").alias("id"), F.lit(0).alias("section_number"), F.lit(0.5).alias("similarity"))
    return items.enriched(r, p, i).select("rowid", "chunk_text", "missing")


@query("""select doc_id as id, l.toxic, case when l.doc_id is null then 'gone' end as state from documents left join labels l using (doc_id)""")
def history_projection(spark, sf):
    """What a saved result keeps, through a list of results and out again."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    r = searching.shape(d.select(F.lit(0.5).alias("similarity"), F.col("doc_id").cast("string").alias("folder_id"), F.lit("f").alias("file_name"), F.lit(1).alias("section_number"), F.col("doc_id").alias("rowid"), F.col("toxic").alias("status"), F.lit("extra").alias("more")))
    kept = r.groupBy().agg(F.to_json(F.collect_list(F.struct("*"))).alias("j"))
    kind = r.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", ": ")
    back = kept.select(F.inline(store.results_of(F.col("j"), f"struct<{kind}>")))
    return back.select(F.col("rowid").alias("id"), F.col("status").cast("int").alias("toxic"), F.when(F.col("status").isNull(), "gone").alias("state"))


@query("""with h as (select user_id as id, count(*) as n, max(value) as top from events group by user_id) select id, n from h where n >= 8 and floor(top / 100) = 2""")
def history_reuse(spark, sf):
    """Saved searches that stand for a new one: results, state and threshold must fit."""
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    h = e.select("id", "n", F.array_repeat(F.lit(1), F.col("n").cast("int")).alias("results"), F.when(F.col("n") >= 8, "7:9").otherwise("7:8").alias("index_state"), F.floor(F.col("top") / 100).cast("double").alias("min_similarity"))
    return store.reusable(h, "7:9", 2.0).select("id", "n")


@query("select doc_id as key, sha256(text) as h, b.doc_id2 as other from documents d join (select doc_id as doc_id2, text as t2 from documents) b on d.text = b.t2 and d.doc_id != b.doc_id2")
def duplicate_watch(spark, sf):
    """Files that equal other known ones, as if all were new."""
    h = hashes(spark, sf).select("key", "hash")
    got = changes.check_new(h, h, h.limit(0))
    return got.select("key", F.substring("hash", 8, 64).alias("h"), "other")


@query("""select count(*) as total, count(*) filter (where event_type = 'click') as done, count(*) filter (where event_type = 'view') as failed, count(*) filter (where event_type not in ('click', 'view')) as excluded,
    round(sum(event_id % 50) / sum(value), 6) as rate from events""")
def index_statistics(spark, sf):
    e = table(spark, sf, "events")
    status = F.when(F.col("event_type") == "click", "index").when(F.col("event_type") == "view", "retry").otherwise("no_text")
    got = ingest.statistics(e.select(F.col("event_id").alias("id"), status.alias("status"), (F.col("event_id") % 50).alias("passages"), F.col("value").alias("seconds")))
    return got.select("total", "done", "failed", "excluded", r6("passages_per_second").alias("rate"))


@query("""select o_custkey as hash, cast(arg_min(o_orderkey, struct_pack(a := case when o_orderkey % 5 = 0 then 1 else 0 end, b := case when o_orderkey % 5 = 0 then 0 else -epoch(o_orderdate) end, c := o_orderdate, d := cast(o_orderkey as varchar))) as varchar) as key
    from orders group by o_custkey""")
def duplicate_preview(spark, sf):
    """The copy that is shown first."""
    f = orders_as_files(spark, sf).join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("hash")), "item_id")
    return duplicates.preview_keeper(f.withColumn("date_modified", F.col("date_added")))


# texts, dates, pieces


@query("select doc_id, cast(strlen(text) as bigint) as n from documents")
def utf8_lengths(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tokenizers.utf8_length(F.col("text")).cast("long").alias("n"))


@query("""select o_orderkey, strftime(o_orderdate, '%d %m %Y') as shown, strftime(date_trunc('month', o_orderdate) - interval 1 month + to_days(cast(day(o_orderdate) as integer) - 1), '%Y-%m-%d') as before,
    strftime(o_orderdate - interval 5 hour, '%Y-%m-%d') as there from orders""")
def dates(spark, sf):
    o = table(spark, sf, "orders").withColumn("t", F.col("o_orderdate").cast("timestamp"))
    day = F.col("t").cast("date")
    return o.select("o_orderkey", texts.shown_date(F.date_format("t", "yyyy-MM-dd"), "dd MM yyyy").alias("shown"), texts.months_ago(day, 1).cast("string").alias("before"), texts.today("Etc/GMT+5", F.col("t")).alias("there"))


@query(r"select doc_id, regexp_replace(text, '[\p{Cc}\p{Cf}]', '', 'g') as t, 'de' || chr(10) || text as p from documents")
def text_controls_and_prompt(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", texts.without_controls(F.col("text")).alias("t"), texts.prompt(F.lit("[QUERY]\n[TEXT]"), F.lit("de"), F.col("text")).alias("p"))


@query("""select o_orderkey, concat_ws(', ', o_orderpriority, strftime(o_orderdate, '%Y')) || ', p. ' || (o_custkey + 1) as cited, '≈' || (o_custkey + 1) as label, cast(greatest(0.15, least(1.0, (o_totalprice / 500000 - 0.4) / 0.4)) as double) as strength from orders""")
def labels_and_strength(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", texts.citation(F.col("o_orderpriority"), F.date_format("o_orderdate", "yyyy"), F.lit(""), F.col("o_custkey")).alias("cited"), texts.page_label(F.col("o_custkey"), F.lit(True)).alias("label"), texts.strength(F.col("o_totalprice") / 500000).alias("strength"))


@query(f"with {P}, v as (select id, unnest(v) as x, unnest(range(1, len(v) + 1)) as k, sqrt(list_sum(list_transform(v, lambda y: y * y))) as n from p) select rowid, round(list_cosine_similarity(v, (select v from p where rowid = 0)), 6) as similarity from p")
def sql_functions(spark, sf):
    """The functions of vectors by their SQL names."""
    registered.register(spark)
    passages(spark, sf).createOrReplaceTempView("glossator_passages")
    return spark.sql("select a.rowid, round(vector_cosine(a.embedding, b.embedding), 6) as similarity from glossator_passages a cross join (select embedding from glossator_passages where rowid = 0) b")


@query("""select user_id as worker, epoch_us(max(ts)) as last from events group by user_id having epoch(timestamp '2024-02-01') - epoch(max(ts)) >= 180""")
def stalled_workers(spark, sf):
    e = changes.timed(table(spark, sf, "events")).select(F.col("user_id").alias("worker"), "ts")
    return control.stalled(e, F.lit("2024-02-01 00:00:00").cast("timestamp")).select("worker", F.unix_micros("last").alias("last"))


@query("select epoch_us(time_bucket(interval '10 minutes', ts)) as begin, count(*) as n from events group by 1")
def coalesced_events(spark, sf):
    e = changes.timed(table(spark, sf, "events")).select(F.col("user_id").alias("key"), "ts")
    return changes.coalesced(e, "10 minutes").select(F.unix_micros("begin").alias("begin"), "n")


@query("""with e as (select *, event_type = 'click' as cached, coalesce(sum(case when event_type = 'click' then 0 else value end) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as used from events)
    select event_id, not cached and used >= 300 as text_pending from e""")
def text_budget(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("request"), F.col("event_id").alias("place"), (F.col("event_type") == "click").alias("cached"), F.col("value").alias("seconds"), F.lit("t").alias("text"))
    return control.within_budget(e, 300.0).select("event_id", "text_pending")
