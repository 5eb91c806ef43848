"""License scans by MinHash bands over overlapping windows, in DataFrame operations only.

Texts and templates become words (runs of a-z and 0-9, lower-cased) and five-word shingles. Texts are cut into windows of
``WINDOW`` shingles, each overlapping the next by half; so are templates. A window's signature is the least hash of its
shingles under each of ``BANDS`` seeds, a band a row. A template window and a text window of similarity s share a band with
probability 1 - (1 - s) ** BANDS: above 0.9997 even if only one of 16 shingles agrees. Two windows can share a band only by a
common shingle, so signatures are made only for windows that hold a template's shingle at all; a bit set of the templates'
hashes, a literal of the plan, finds them inside the scan. Candidates are verified exactly: a match has at least ``SHARE`` of
a template's distinct shingles within a stretch a quarter longer than the template.

Nothing of a text moves but the places of its shingles that templates have, and the shingle hashes of windows around them.

Defined cases: null and empty texts and texts of fewer than five words match nothing; repeated rows and rows that share an id
give that id's best match once; the id may be null; templates of fewer than five words are refused; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .license_texts import TEMPLATES

SHINGLE, WINDOW, BANDS, SHARE = 5, 16, 128, 0.8
BITS = 1 << 18


def words(text: Column) -> Column:
    """Words of a text as an array."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ")


def shingles_of(text: Column) -> Column:
    """Hashes of a text's shingles in order; null with fewer than SHINGLE words.

    The words are bound by a lambda, as an expression that a lambda's body repeats would be run again for every element.
    """

    def cut(w: Column) -> Column:
        def at(i: Column) -> Column:
            return F.xxhash64(*(F.get(w, i + j) for j in range(SHINGLE)))

        return F.when(F.size(w) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), at))

    return F.get(F.transform(F.array(words(text)), cut), F.lit(0))


def template_table(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """template (its number), license, text; short of its bounded number of rows, nothing is on the driver."""
    rows = F.array(*(F.struct(F.lit(i).alias("template"), F.lit(name).alias("license"), F.lit(text).alias("text")) for i, (name, text) in enumerate(templates)))
    return spark.range(1).select(F.inline(rows))


def bands(window: Column) -> Column:
    """The signature: per seed the least hash, with the seed hashed in."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.array_min(F.transform(window, lambda s: F.xxhash64(s, k)))))


def bit_set(hashes: list[int]) -> Column:
    """A literal array of BITS bits with two bits for each hash."""
    lanes = [0] * (BITS // 64)
    for h in hashes:
        for b in (h & (BITS - 1), (h >> 24) & (BITS - 1)):
            lanes[b >> 6] |= 1 << (b & 63)
    signed = (x - (1 << 64) if x >> 63 else x for x in lanes)
    return F.split(F.lit(",".join(map(str, signed))), ",").cast("array<long>")


def scan(docs: DataFrame, doc: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, share: float = SHARE) -> DataFrame:
    """doc_id, license, template, containment, n_shingles, first_word: the best match of each document and template."""
    spark = docs.sparkSession
    known = template_table(spark, templates).select("template", "license", shingles_of(F.col("text")).alias("shingles")).where("shingles is not null")
    known = written(known.withColumn("m", F.size(F.array_distinct("shingles"))), "license-templates")
    own = known.select("template", "m", F.explode(F.array_distinct("shingles")).alias("shingle")).distinct()
    hashes = [r.shingle for r in own.select("shingle").distinct().collect()]  # bounded by the templates
    if known.count() < len(templates):
        raise ValueError(f"a template needs {SHINGLE} words")
    set_ = bit_set(hashes)

    def may(h: Column) -> Column:
        def bit(b: Column) -> Column:
            return F.call_function("shiftright", F.get(set_, F.shiftright(b, 6).cast("int")), b.bitwiseAND(63).cast("int")).bitwiseAND(1) != 0

        return bit(h.bitwiseAND(BITS - 1)) & bit(F.shiftright(h, 24).bitwiseAND(BITS - 1))

    half = WINDOW // 2
    given = docs.select(F.col(doc).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))

    def marked(s: Column) -> Column:
        hits = F.filter(F.transform(s, lambda h, i: F.struct(i.alias("at"), h.alias("shingle"))), lambda x: may(x["shingle"]))
        return F.struct(s.alias("shingles"), hits.alias("hits"))

    there = F.filter(F.transform(F.array(shingles_of(F.col("text"))), marked), lambda x: F.size(x["hits"]) > 0)
    found = written(given.select("doc_id", "text_hash", F.inline(there)), "license-places")
    # windows that hold such a place
    of = F.transform("hits", lambda x: F.array(F.floor(x["at"] / half).cast("int"), F.greatest(F.floor(x["at"] / half).cast("int") - 1, F.lit(0))))
    own_window = F.transform(F.array_distinct(F.flatten(of)), lambda w: F.struct(w.alias("window"), F.slice("shingles", w * half + 1, F.lit(WINDOW)).alias("own")))
    found = found.withColumn("windows", own_window)
    windows = found.select("doc_id", "text_hash", F.inline("windows")).where(F.size("own") > 0)
    templated = known.select("template", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size("shingles") - 1) / half).cast("int") - 1, F.lit(0))), lambda w: F.slice("shingles", w * half + 1, F.lit(WINDOW)))).alias("own"))
    template_bands = F.broadcast(templated.select("template", F.explode(bands(F.col("own"))).alias("band")).distinct())  # bounded by the templates
    candidates = windows.select("doc_id", "text_hash", F.explode(bands(F.col("own"))).alias("band")).join(template_bands, "band").select("doc_id", "text_hash", "template").distinct()

    # exact containment: every stretch of a template's length lies in one of the segments of twice that length
    places = found.select("doc_id", "text_hash", F.inline("hits")).join(F.broadcast(own), "shingle")
    on = [places.doc_id.eqNullSafe(candidates.doc_id), places.text_hash == candidates.text_hash, places.template == candidates.template]
    places = places.join(candidates, on, "left_semi").withColumn("span", F.ceil(F.col("m") * 1.25).cast("int") + SHINGLE - 1)
    segment = F.floor(F.col("at") / F.col("span")).cast("int")
    places = places.withColumn("segment", F.explode(F.array_distinct(F.array(segment, F.greatest(segment - 1, F.lit(0))))))
    grouped = places.groupBy("doc_id", "text_hash", "template", "m", "span", "segment").agg(F.collect_set(F.struct("at", "shingle")).alias("own"))

    def from_here(s: Column) -> Column:
        inside = F.filter("own", lambda x: (x["at"] >= s["at"]) & (x["at"] < s["at"] + F.col("span")))
        return F.struct(F.size(F.array_distinct(F.transform(inside, lambda x: x["shingle"]))).alias("n"), (-s["at"]).alias("o"))

    best = grouped.select("doc_id", "template", "m", F.array_max(F.transform("own", from_here)).alias("b"))
    best = best.groupBy("doc_id", "template", "m").agg(F.max("b").alias("b")).where(F.col("b.n") >= share * F.col("m") - 1e-9)
    named = F.broadcast(known.select("template", "license"))
    return best.join(named, "template").select("doc_id", "license", "template", (F.col("b.n") / F.col("m")).alias("containment"), F.col("b.n").alias("n_shingles"), (-F.col("b.o")).alias("first_word"))


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    """Every document with the licence notices in it."""
    return scan(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same matches by joins on whole shingles, for DuckDB."""
    values = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES))

    def cut(source: str, keys: str) -> str:
        return f"""select {keys}, pos, w[pos + 1] || ' ' || w[pos + 2] || ' ' || w[pos + 3] || ' ' || w[pos + 4] || ' ' || w[pos + 5] as shingle
            from (select {keys}, w, unnest(range(0, len(w) - 4)) as pos from
                (select {keys}, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') as w from {source}) where len(w) >= 5)"""

    return f"""
        with templates(template, license, text) as (values {values}),
        own as (select distinct template, license, shingle from ({cut("templates", "template, license")})),
        sized as (select template, count(*) as m, cast(ceil(count(*) * 1.25) as integer) + 4 as span from own group by template),
        places as (select doc_id, h, pos, template, license, shingle, m, span
            from ({cut("(select *, md5(text) as h from documents)", "doc_id, h")}) join own using (shingle) join sized using (template)),
        counted as (select a.doc_id, a.template, a.license, a.m, a.pos, count(distinct b.shingle) as n from (select distinct * from places) a
            join places b on a.doc_id is not distinct from b.doc_id and a.h = b.h and a.template = b.template and b.pos >= a.pos and b.pos < a.pos + a.span
            group by all),
        best as (select doc_id, template, license, m, max(n) as n from counted group by all having max(n) >= {SHARE} * m - 1e-9)
        select b.doc_id, b.license, b.template, b.n / b.m as containment, cast(b.n as integer) as n_shingles, cast(min(c.pos) as integer) as first_word
        from best b join counted c on b.doc_id is not distinct from c.doc_id and b.template = c.template and b.n = c.n group by all
    """
