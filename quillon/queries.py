"""Registered queries over the driver's tables, each with the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import blocks as block_functions
from .operators import graph, retrieve, schema, search, stats
from .plans import compile as plans
from .plans import ir, parse
from .sources import corpus as sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


# corpora


def texts(spark: SparkSession, sf_dir: str) -> sources.Corpus:
    """documents with their labels: rows without a label lack quality and toxic."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    fm = F.to_json(F.struct("lang", "source", "n_chars", "quality", "toxic", F.array("lang", "source").alias("tags"), F.struct(F.col("lang").alias("code"), F.struct(F.col("n_chars").alias("chars")).alias("size")).alias("meta")))
    key = F.concat(F.lit("doc/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    own = {c: F.col(c) for c in ("lang", "source", "n_chars", "quality", "toxic")}
    rows = sources.documents(docs, key, fm, None, F.col("text"), sources.text_blocks(F.col("text")), own)
    return sources.Corpus(rows, sources.no_edges(spark), sources.no_edges(spark), {}, sources.typed_columns(rows))


#: The same rows for SQL.
TEXTS = """WITH t AS (SELECT 'doc/' || lpad(CAST(d.doc_id AS VARCHAR), 12, '0') AS key, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def geo(spark: SparkSession, sf_dir: str) -> sources.Corpus:
    """region > nation > customer > order as inclusions, nation > supplier too; orders refer to parts and suppliers."""
    t = lambda name: table(spark, sf_dir, name)
    key = lambda kind, c: F.concat(F.lit(kind + "/"), F.col(c).cast("string"))
    c = F.col

    def rows(kind: str, id_col: str, title: Column | None, **own: Column) -> DataFrame:
        own = {"kind": F.lit(kind), **own}
        return sources.documents(t({"order": "orders"}.get(kind, kind)), key(kind, id_col), F.to_json(F.struct(*[v.alias(k) for k, v in own.items()])), title, typed=own)

    docs = [
        rows("region", "r_regionkey", c("r_name"), name=c("r_name")),
        rows("nation", "n_nationkey", c("n_name"), name=c("n_name")),
        rows("customer", "c_custkey", c("c_name"), segment=c("c_mktsegment"), balance=c("c_acctbal")),
        rows("supplier", "s_suppkey", c("s_name"), balance=c("s_acctbal")),
        rows("order", "o_orderkey", None, status=c("o_orderstatus"), price=c("o_totalprice")),
        rows("part", "p_partkey", c("p_name"), brand=c("p_brand"), size=c("p_size")),
    ]
    inclusion = [
        sources.edges(t("nation"), key("region", "n_regionkey"), key("nation", "n_nationkey"), c("n_nationkey")),
        sources.edges(t("customer"), key("nation", "c_nationkey"), key("customer", "c_custkey")),
        sources.edges(t("supplier"), key("nation", "s_nationkey"), key("supplier", "s_suppkey")),
        sources.edges(t("orders"), key("customer", "o_custkey"), key("order", "o_orderkey")),
    ]
    lines = t("lineitem")
    reference = [
        sources.edges(lines, key("order", "l_orderkey"), key("part", "l_partkey"), c("l_linenumber")),
        sources.edges(lines, key("order", "l_orderkey"), key("supplier", "l_suppkey"), c("l_linenumber")),
    ]
    from functools import reduce

    every = lambda parts: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    documents = every(docs)
    return sources.Corpus(documents, every(inclusion), every(reference), {}, sources.typed_columns(documents))


GEO = """WITH RECURSIVE docs AS (
      SELECT 'region/' || r_regionkey AS key, 'region' AS kind, r_name AS title, NULL AS status FROM region
      UNION ALL SELECT 'nation/' || n_nationkey, 'nation', n_name, NULL FROM nation
      UNION ALL SELECT 'customer/' || c_custkey, 'customer', c_name, NULL FROM customer
      UNION ALL SELECT 'supplier/' || s_suppkey, 'supplier', s_name, NULL FROM supplier
      UNION ALL SELECT 'order/' || o_orderkey, 'order', NULL, o_orderstatus FROM orders
      UNION ALL SELECT 'part/' || p_partkey, 'part', p_name, NULL FROM part),
    inc AS (
      SELECT 'region/' || n_regionkey AS src, 'nation/' || n_nationkey AS dst FROM nation
      UNION ALL SELECT 'nation/' || c_nationkey, 'customer/' || c_custkey FROM customer
      UNION ALL SELECT 'nation/' || s_nationkey, 'supplier/' || s_suppkey FROM supplier
      UNION ALL SELECT 'customer/' || o_custkey, 'order/' || o_orderkey FROM orders),
    ref AS (
      SELECT 'order/' || l_orderkey AS src, 'part/' || l_partkey AS dst, l_linenumber AS pos FROM lineitem
      UNION ALL SELECT 'order/' || l_orderkey, 'supplier/' || l_suppkey, l_linenumber FROM lineitem)"""


def copurchase(spark: SparkSession, sf_dir: str) -> sources.Corpus:
    """parts; a part refers to the part on the next line of an order. Cyclic."""
    lines = table(spark, sf_dir, "lineitem")
    following = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    pairs = lines.withColumn("next", F.lead("l_partkey").over(following)).where("next IS NOT NULL")
    part = table(spark, sf_dir, "part")
    key = F.concat(F.lit("part/"), F.col("p_partkey").cast("string"))
    docs = sources.documents(part, key, F.to_json(F.struct(F.col("p_brand").alias("brand"))), F.col("p_name"))
    refs = sources.edges(pairs, F.concat(F.lit("part/"), F.col("l_partkey").cast("string")), F.concat(F.lit("part/"), F.col("next").cast("string")), F.col("l_linenumber"))
    return sources.Corpus(docs, sources.no_edges(spark), refs)


COPURCHASE = """WITH RECURSIVE n AS (SELECT 'part/' || l_partkey AS src, 'part/' || lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem),
    e AS (SELECT DISTINCT src, dst FROM n WHERE dst IS NOT NULL)"""


def threads(spark: SparkSession, sf_dir: str) -> sources.Corpus:
    """conversations, one document each; turns are blocks: system headers, user paragraphs, assistant quotes."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    kind = lambda t: F.when(t["role"] == "system", "header").when(t["role"] == "user", "paragraph").otherwise("quote")
    made = F.transform("turns", lambda t, i: sources.block(i, F.lit(-1), i, F.lit(0), kind(t), t["text"]))
    # a header's section reaches to the next header
    starts = F.filter(F.transform(made, lambda b: F.when(b["kind"] == "header", b["pos"])), lambda p: p.isNotNull())
    ends = F.transform(made, lambda b: b.withField("end_pos", F.when(b["kind"] == "header", F.coalesce(F.array_min(F.filter(starts, lambda p: p > b["pos"])) - 1, F.size("turns") - 1)).otherwise(b["pos"])))
    text = F.array_join(F.transform("turns", lambda t: F.coalesce(t["text"], F.lit(""))), "\n")
    docs = sources.documents(turns, F.concat(F.lit("conv/"), F.col("conv_id").cast("string")), F.to_json(F.struct(F.size("turns").alias("turns"))), None, text, ends)
    return sources.Corpus(docs, sources.no_edges(spark), sources.no_edges(spark))


THREADS = """WITH b AS (SELECT 'conv/' || conv_id AS key, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos, CASE role WHEN 'system' THEN 'header' WHEN 'user' THEN 'paragraph' ELSE 'quote' END AS kind, text AS own FROM conversations),
    h AS (SELECT *, lead(pos) OVER (PARTITION BY key ORDER BY pos) AS nxt FROM b WHERE kind = 'header')"""


def events(spark: SparkSession, sf_dir: str) -> sources.Corpus:
    """events; metadata is the JSON of props beside the columns."""
    t = table(spark, sf_dir, "events")
    fm = F.concat(F.lit('{"type":"'), F.col("event_type"), F.lit('","user":'), F.col("user_id").cast("string"), F.lit(',"props":'), F.coalesce("props", F.lit("null")), F.lit("}"))
    return sources.Corpus(sources.documents(t, F.concat(F.lit("event/"), F.col("event_id").cast("string")), fm), sources.no_edges(spark), sources.no_edges(spark))


EVENTS = "WITH t AS (SELECT 'event/' || event_id AS key, event_type AS type, user_id, CAST(props AS JSON) AS props FROM events)"


def web(spark: SparkSession, sf_dir: str) -> sources.Corpus:
    """pages; the first heading is the title, links are references, mostly to missing pages."""
    pages = table(spark, sf_dir, "pages")
    title = F.trim(F.regexp_replace(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]*>", ""))
    docs = sources.documents(pages, F.col("url"), F.to_json(F.struct("page_id")), F.when(title != "", title), F.col("html"))
    links = pages.select("url", F.posexplode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'))).alias("n", "to"))
    return sources.Corpus(docs, sources.no_edges(spark), sources.edges(links, F.col("url"), F.col("to"), F.col("n")))


WEB = """WITH l AS (SELECT url AS src, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS dst FROM pages)"""

# metadata filters over texts

_FIELD = {
    "field_eq": ("lang: fr", "lang = 'fr'"),
    "field_ne_missing": ("quality: {$ne: 1}", "coalesce(quality <> 1, true)"),
    "field_gt": ("n_chars: {$gt: 2000}", "n_chars > 2000"),
    "field_gte_lte": ("n_chars: {$gte: 500, $lte: 1500}", "n_chars BETWEEN 500 AND 1500"),
    "field_lt": ("lang: {$lt: es}", "lang < 'es'"),
    "field_in": ("lang: {$in: [fr, de]}", "lang IN ('fr', 'de')"),
    "field_nin": ("toxic: {$nin: [1, 2]}", "coalesce(toxic NOT IN (1, 2), true)"),
    "field_exists": ("quality: {$exists: true}", "quality IS NOT NULL"),
    "field_not_exists": ("quality: {$exists: false}", "quality IS NULL"),
    "field_type": ("quality: {$type: [number, 'null']}", "quality IS NOT NULL"),
    "field_type_array": ("tags: {$type: array}", "true"),
    "field_all": ("tags: {$all: [fr, src1]}", "lang = 'fr' AND source = 'src1'"),
    "field_size": ("tags: {$size: {$gte: 2, $lt: 3}}", "true"),
    "field_not": ("n_chars: {$not: {$gt: 500, $lt: 3000}}", "NOT (n_chars > 500 AND n_chars < 3000)"),
    "membership": ("tags: src3", "lang = 'src3' OR source = 'src3'"),
    "whole_array_eq": ("tags: [en, src2]", "lang = 'en' AND source = 'src2'"),
    "no_coercion": ("n_chars: '500'", "false"),
    "nested_path": ("meta: {size: {chars: {$gt: 1000}}}", "n_chars > 1000"),
    "dotted_path": ("meta.code: es", "lang = 'es'"),
    "reserved_invisible": ("_hidden: {$exists: true}", "false"),
    "logic_and": ("$and: [{lang: en}, {n_chars: {$gt: 1000}}]", "lang = 'en' AND n_chars > 1000"),
    "logic_or": ("$or: [{lang: de}, {toxic: 1}]", "coalesce(lang = 'de', false) OR coalesce(toxic = 1, false)"),
    "logic_nor": ("$nor: [{lang: en}, {quality: 1}]", "NOT (coalesce(lang = 'en', false) OR coalesce(quality = 1, false))"),
    "key_in": ("$key: {$in: [doc/000000000003, doc/000000000007, doc/x]}", "key IN ('doc/000000000003', 'doc/000000000007')"),
    "key_nin": ("$key: {$nin: [doc/000000000003]}", "key <> 'doc/000000000003'"),
    "empty_filter": ("{}", "true"),
    "content_text": ("$content: {$text: 'TION ON'}", "contains(lower(text), 'tion on')"),
    "content_regex": ("$content: {$paragraph: {$matches: '\\d{3}-\\d{4}'}}", r"list_bool_or([regexp_matches(x, '\d{3}-\d{4}') for x in string_split(text, chr(10)) if trim(x) <> ''])"),
    "content_absent": ("$nor: [{$content: {$text: the}}]", "NOT coalesce(contains(lower(text), 'the'), false)"),
}


def _field_query(filter_text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = plans.select(texts(spark, sf_dir), parse.parse_filter_expression(filter_text))
        return found.select("key")

    return run


for _name, (_filter, _sql) in _FIELD.items():
    register(f"{TEXTS} SELECT key FROM t WHERE {_sql}", _name)(_field_query(_filter))


@register(f"{TEXTS} SELECT key, lang, n_chars AS chars, row_number() OVER (ORDER BY n_chars DESC, key) AS place FROM t WHERE lang = 'en' ORDER BY place LIMIT 50")
def find_draft(spark, sf_dir):
    """filter, sort, limit and projection together."""
    found = plans.find(texts(spark, sf_dir), "{filter: {lang: en}, sort: {n_chars: -1}, limit: 50, project: {key: $key, lang: 1, chars: n_chars}}")
    row = found.select("key", text_of(F.col("lang")).alias("lang"), F.try_variant_get("chars", "$", "long").alias("chars"))
    return row.withColumn("place", F.row_number().over(Window.orderBy(F.desc("chars"), "key")).cast("long"))


@register(f"{TEXTS} SELECT key, quality FROM t ORDER BY quality ASC NULLS FIRST, key LIMIT 700")
def sort_missing_first(spark, sf_dir):
    found = plans.find(texts(spark, sf_dir), "{sort: {quality: 1}, limit: 700, project: {key: $key, quality: 1}}")
    return found.select("key", F.try_variant_get("quality", "$", "int").alias("quality"))


@register(f"{TEXTS} SELECT key, quality FROM t ORDER BY quality DESC NULLS LAST, key LIMIT 300")
def sort_descending_keys_ascending(spark, sf_dir):
    found = plans.find(texts(spark, sf_dir), "{sort: {quality: -1}, limit: 300, project: {key: $key, quality: 1}}")
    return found.select("key", F.try_variant_get("quality", "$", "int").alias("quality"))


@register(f'{TEXTS} SELECT count(*) AS "count" FROM t WHERE lang = \'en\'')
def count_filtered(spark, sf_dir):
    return plans.count(texts(spark, sf_dir), "filter: {lang: en}")


@register(f'{TEXTS} SELECT least(count(*), 10) AS "count" FROM t WHERE lang = \'fr\'')
def count_limited(spark, sf_dir):
    return plans.count(texts(spark, sf_dir), "{filter: {lang: fr}, limit: 10}")


@register(f"{TEXTS} SELECT key, lang AS language, n_chars AS size, CAST(quality AS VARCHAR) AS quality FROM t WHERE source = 'src1'")
def project_rename(spark, sf_dir):
    found = plans.find(texts(spark, sf_dir), "{filter: {source: src1}, project: {key: $key, language: lang, size: meta.size.chars, quality: 1}}")
    return found.select("key", text_of(F.col("language")).alias("language"), F.try_variant_get("size", "$", "long").alias("size"), text_of(F.col("quality")).alias("quality"))


@register(GEO + " SELECT key, coalesce(title, key) AS title, trim(regexp_replace(lower(coalesce(title, key)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM docs WHERE kind IN ('customer', 'order')")
def project_slug(spark, sf_dir):
    return plans.find(geo(spark, sf_dir), "{filter: {kind: {$in: [customer, order]}}, project: {key: $key, title: $title, slug: $titleSlug}}")


@register(
    GEO
    + """ SELECT d.key, d.title, coalesce(a.x, '') AS includes, coalesce(b.x, '') AS included_by FROM docs d
    LEFT JOIN (SELECT src, string_agg(dst, ',' ORDER BY dst) AS x FROM inc GROUP BY src) a ON a.src = d.key
    LEFT JOIN (SELECT dst, string_agg(src, ',' ORDER BY src) AS x FROM inc GROUP BY dst) b ON b.dst = d.key WHERE d.kind = 'nation'"""
)
def add_fields_edges(spark, sf_dir):
    found = plans.find(geo(spark, sf_dir), "{filter: {kind: nation}, addFields: {kind: 1}}")
    said = lambda c: F.array_join(F.transform(c, lambda e: e["key"]), ",")
    return found.select("key", "title", said("includes").alias("includes"), said("includedBy").alias("included_by"))


@register(
    GEO
    + """ SELECT d.key, count(DISTINCT r.dst) AS n_references, coalesce(min(r.dst), '') AS first_reference FROM docs d
    LEFT JOIN ref r ON r.src = d.key WHERE d.kind = 'order' AND d.status = 'P' GROUP BY d.key"""
)
def project_references(spark, sf_dir):
    found = plans.find(geo(spark, sf_dir), "{filter: {kind: order, status: P}, project: {key: $key, refs: $references}}")
    return found.select("key", F.size("refs").cast("long").alias("n_references"), F.coalesce(F.get(F.col("refs"), F.lit(0))["key"], F.lit("")).alias("first_reference"))


# relations

_DOWN = "w AS (SELECT src AS key, 0 AS d FROM (SELECT 'region/1' AS src) UNION SELECT inc.dst, w.d + 1 FROM w JOIN inc ON inc.src = w.key WHERE w.d < 10)"
_RELATION = {
    "included_by_d1": ("$includedBy: nation/3", "SELECT dst AS key FROM inc WHERE src = 'nation/3'"),
    "included_by_unbounded": ("$includedBy: {match: {$key: region/1}, maxDepth: 0}", "SELECT DISTINCT key FROM w WHERE d > 0"),
    "included_by_band_2_3": ("$includedBy: {match: {$key: region/1}, minDepth: 2, maxDepth: 3}", "SELECT key FROM w GROUP BY key HAVING min(d) BETWEEN 2 AND 3"),
    "included_by_match_field": ("$includedBy: {match: {kind: nation, name: {$gt: J}}}", "SELECT DISTINCT dst AS key FROM inc JOIN docs a ON a.key = inc.src WHERE a.kind = 'nation' AND a.title > 'J'"),
    "includes_d2": ("$includes: {match: {kind: order, status: P}, maxDepth: 2}", "SELECT DISTINCT x.src AS key FROM inc x JOIN docs a ON a.key = x.dst AND a.kind = 'order' AND a.status = 'P' UNION SELECT y.src FROM inc y JOIN inc x ON y.dst = x.src JOIN docs a ON a.key = x.dst AND a.kind = 'order' AND a.status = 'P'"),
    "references_d1": ("$references: part/7", "SELECT DISTINCT src AS key FROM ref WHERE dst = 'part/7'"),
    "referenced_by_d1": ("$referencedBy: order/32", "SELECT DISTINCT dst AS key FROM ref WHERE src = 'order/32'"),
    "relation_and_field": ("{$includedBy: nation/3, kind: supplier}", "SELECT dst AS key FROM inc WHERE src = 'nation/3' AND dst LIKE 'supplier/%'"),
    "relation_nor": ("{kind: supplier, $nor: [{$referencedBy: {match: {kind: order, status: P}}}]}", "SELECT key FROM docs WHERE kind = 'supplier' AND key NOT IN (SELECT r.dst FROM ref r JOIN docs a ON a.key = r.src AND a.status = 'P')"),
    "relation_or": ("$or: [{$includedBy: region/0}, {$references: part/7}]", "SELECT dst AS key FROM inc WHERE src = 'region/0' UNION SELECT src FROM ref WHERE dst = 'part/7'"),
    "relation_size_hubs": ("{kind: part, $referencedBy: {$size: {$gte: 35}}}", "SELECT dst AS key FROM ref WHERE dst LIKE 'part/%' GROUP BY dst HAVING count(DISTINCT src) >= 35"),
    "relation_size_match": ("{kind: nation, $includes: {match: {kind: supplier}, $size: {$gte: 2, $lte: 4}}}", "SELECT src AS key FROM inc WHERE dst LIKE 'supplier/%' GROUP BY src HAVING count(DISTINCT dst) BETWEEN 2 AND 4"),
    "relation_size_deep": ("{kind: {$in: [region, nation]}, $includes: {match: {kind: supplier}, maxDepth: 2, $size: {$gte: 3}}}", "SELECT key FROM (SELECT src AS key, dst FROM inc UNION SELECT a.src, b.dst FROM inc a JOIN inc b ON a.dst = b.src) WHERE dst LIKE 'supplier/%' GROUP BY key HAVING count(DISTINCT dst) >= 3"),
    "roots": ("{kind: {$ne: part}, $includedBy: {$size: 0}}", "SELECT key FROM docs WHERE kind <> 'part' AND key NOT IN (SELECT dst FROM inc)"),
    "leaves": ("{kind: customer, $includes: {$size: 0}}", "SELECT key FROM docs WHERE kind = 'customer' AND key NOT IN (SELECT src FROM inc)"),
}


def _relation_query(filter_text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plans.select(geo(spark, sf_dir), parse.parse_filter_expression(filter_text)).select("key")

    return run


for _name, (_filter, _sql) in _RELATION.items():
    register(f"{GEO}, {_DOWN} {_sql}", _name)(_relation_query(_filter))


@register(COPURCHASE + ", w AS (SELECT 'part/1' AS key, 0 AS d UNION SELECT e.dst, w.d + 1 FROM w JOIN e ON e.src = w.key WHERE w.d < 3) SELECT DISTINCT key FROM w WHERE d > 0 AND key <> 'part/1'")
def referenced_by_multi_hop(spark, sf_dir):
    return plans.select(copurchase(spark, sf_dir), parse.parse_filter_expression("$referencedBy: {match: {$key: part/1}, maxDistance: 3}")).select("key")


@register(COPURCHASE + ", w AS (SELECT 'part/1' AS key UNION SELECT e.dst FROM w JOIN e ON e.src = w.key) SELECT key FROM w WHERE key <> 'part/1'")
def cyclic_bfs(spark, sf_dir):
    return plans.select(copurchase(spark, sf_dir), parse.parse_filter_expression("$referencedBy: {match: {$key: part/1}, maxDistance: 0}")).select("key")


@register(GEO + " SELECT key FROM docs WHERE key NOT IN (SELECT dst FROM inc) AND key NOT IN (SELECT dst FROM ref)")
def orphans(spark, sf_dir):
    return graph.orphans(geo(spark, sf_dir))


@register(WEB + " SELECT DISTINCT src AS source_key, dst AS target_key FROM l WHERE dst NOT IN (SELECT url FROM pages) AND NOT regexp_matches(dst, '^(https?://|mailto:)')")
def dangling_links(spark, sf_dir):
    return graph.dangling(web(spark, sf_dir))


@register(GEO + " SELECT key, count(*) AS popularity FROM (SELECT dst AS key, src, 0 AS pos, 1 AS k FROM inc UNION SELECT dst, src, pos, 2 FROM ref) GROUP BY key")
def backlink_rank(spark, sf_dir):
    return graph.popularity(geo(spark, sf_dir))


@register(GEO + " SELECT DISTINCT dst AS key, src AS source FROM (SELECT src, dst FROM inc UNION ALL SELECT src, dst FROM ref) WHERE dst LIKE 'supplier/%'")
def document_references(spark, sf_dir):
    c = geo(spark, sf_dir)
    return graph.backlinks(c, c.documents.where("key LIKE 'supplier/%'").select("key"))


# blocks


@register(THREADS + " SELECT key, pos, kind, own AS text FROM b WHERE kind = 'paragraph' AND contains(lower(own), 'the')")
def blocks_projection(spark, sf_dir):
    found = plans.find(threads(spark, sf_dir), "{project: {key: $key, hits: {$blocks: {$paragraph: {$text: the}}}}}")
    c = threads(spark, sf_dir)
    hit = c.documents.select("key", F.explode(block_functions.selected(parse.parse_blocks({"$paragraph": {"$text": "the"}}, "$blocks"), F.col("blocks"))).alias("b"))
    said = found.select("key", F.explode("hits").alias("h")).select("key", F.col("h.type").alias("kind"), F.col("h.text").alias("text"))
    return hit.select("key", F.col("b.pos").cast("long").alias("pos"), F.col("b.kind").alias("kind"), F.col("b.own_text").alias("text")).join(said.distinct(), ["key", "kind", "text"], "left_semi")


@register(THREADS + ", lines AS (SELECT key, unnest(string_split(own, chr(10))) AS text FROM b) SELECT key, text FROM lines WHERE regexp_matches(text, '[0-9]{2}')")
def grep_lines(spark, sf_dir):
    found = plans.find(threads(spark, sf_dir), "{project: {key: $key, found: {$matches: '[0-9]{2}'}}}")
    return found.select("key", F.explode("found").alias("f")).select("key", F.col("f.text").alias("text"))


@register(THREADS + " SELECT b.key, b.pos, b.kind FROM b JOIN h ON h.key = b.key AND b.pos > h.pos AND (h.nxt IS NULL OR b.pos < h.nxt) WHERE b.kind = 'quote'")
def section_within(spark, sf_dir):
    c = threads(spark, sf_dir)
    tests = parse.parse_blocks(parse.yamlcore.loads("$within: {$section: {}}\n$quote: {}"), "$blocks")
    found = c.documents.select("key", F.explode(block_functions.selected(tests, F.col("blocks"))).alias("b"))
    return found.select("key", F.col("b.pos").cast("long").alias("pos"), F.col("b.kind").alias("kind"))


@register(THREADS + " SELECT DISTINCT h.key FROM h JOIN b ON h.key = b.key AND b.pos > h.pos AND (h.nxt IS NULL OR b.pos < h.nxt) WHERE b.kind = 'quote' AND length(b.own) > 200")
def content_contains(spark, sf_dir):
    tests = (ir.BlockTest("kind", (), "header"), ir.BlockTest("contains", (ir.BlockTest("quote", ()), ir.BlockTest("matches", "(?s)^.{201}"))))
    return plans.select(threads(spark, sf_dir), ir.Content(tests)).select("key")


# ranking

_TERMS = """tok AS (SELECT key, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM t),
    ix AS (SELECT key, term, count(*) AS tf FROM tok GROUP BY ALL), dl AS (SELECT key, sum(tf) AS dl FROM ix GROUP BY key),
    sz AS (SELECT (SELECT count(*) FROM t) AS n, (SELECT sum(tf) FROM ix) / (SELECT count(*) FROM t) AS avgdl),
    df AS (SELECT term, count(*) AS df FROM ix GROUP BY term),
    wt AS (SELECT ix.key, dl.dl, ix.term, ix.tf, df.df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS w FROM ix JOIN dl USING (key) JOIN df USING (term), sz)"""
_BM25 = "bm AS (SELECT key, sum(idf * w * CASE term WHEN 'the' THEN 2 ELSE 1 END) AS score FROM wt WHERE term IN ('the', 'tion', 'erre') GROUP BY key)"


@register(f"{TEXTS}, {_TERMS}, {_BM25} SELECT key, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, key) AS place FROM bm ORDER BY place LIMIT 100")
def bm25_topk(spark, sf_dir):
    # equal scores may differ in their last bits by the order of the sum
    found = search.bm25(texts(spark, sf_dir), "the tion erre the", "simple").withColumn("score", F.round("score", 9))
    top = found.orderBy(F.desc("score"), "key").limit(100)
    return top.select("key", F.round("score", 6).alias("score"), F.row_number().over(Window.orderBy(F.desc("score"), "key")).cast("long").alias("place"))


@register(
    f"""{TEXTS}, {_TERMS}, {_BM25}, b AS (SELECT key, 1.0 / (60 + row_number() OVER (ORDER BY round(score, 9) DESC, key)) AS part FROM bm JOIN t USING (key) WHERE lang = 'en'),
    c AS (SELECT key, 1.0 / (60 + row_number() OVER (ORDER BY n_chars DESC, key)) AS part FROM t WHERE lang = 'en')
    SELECT key, round(sum(part), 6) AS score FROM (SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY key"""
)
def rrf_fusion(spark, sf_dir):
    c = texts(spark, sf_dir)
    candidates = plans.select(c, parse.parse_filter_expression("lang: en")).select("key")
    lengths = c.documents.select("key", F.try_variant_get("fm", "$.n_chars", "double").alias("score"))
    return search.fused([search.bm25(c, "the tion erre the", "simple").withColumn("score", F.round("score", 9)), lengths], candidates).select("key", F.round("score", 6).alias("score"))


@register()
def fuzzy_topk(spark, sf_dir):
    return search.fuzzy(geo(spark, sf_dir), "cust12").orderBy(F.desc("score"), "key").limit(50)


@register()
def find_search(spark, sf_dir):
    """search and filter in one operation, with the stemming analyzer."""
    return plans.find(texts(spark, sf_dir), "{search: {lexical: 'the tion', fuzzy: doc1}, filter: {lang: en}, limit: 20, project: {key: $key}}")


@register(
    f"""{TEXTS}, {_TERMS}, big AS (SELECT * FROM wt WHERE dl >= 50), own AS (SELECT key, sum(tf * idf * w) AS whole FROM big GROUP BY key),
    pr AS (SELECT a.key AS a, b.key AS b, sum(a.tf * a.idf * b.w) AS s FROM big a JOIN big b ON a.term = b.term AND a.key <> b.key AND greatest(a.dl, b.dl) <= 2 * least(a.dl, b.dl) GROUP BY ALL),
    fw AS (SELECT a, b FROM pr JOIN own ON own.key = pr.a WHERE s / whole >= 0.85 - 1e-9), mu AS (SELECT x.a, x.b FROM fw x JOIN fw y ON x.a = y.b AND x.b = y.a)
    SELECT own.key, count(mu.b) AS links FROM own LEFT JOIN mu ON mu.a = own.key GROUP BY own.key"""
)
def similar_documents(spark, sf_dir):
    return search.similar_documents(texts(spark, sf_dir), analyzer="simple").select("key", "links")


# statistics, schemas, expansion

_STATS = GEO + """, ib AS (SELECT dst AS key, count(*) AS n FROM (SELECT DISTINCT * FROM inc) GROUP BY dst), rb AS (SELECT dst AS key, count(*) AS n FROM (SELECT DISTINCT * FROM ref) GROUP BY dst),
    io AS (SELECT src AS key, count(*) AS n FROM (SELECT DISTINCT * FROM inc) GROUP BY src), ro AS (SELECT src AS key, count(*) AS n FROM ref GROUP BY src),
    st AS (SELECT d.key, coalesce(d.title, d.key) AS title, CAST(coalesce(ib.n, 0) AS BIGINT) AS included_by_count, CAST(coalesce(rb.n, 0) AS BIGINT) AS referenced_by_count, CAST(coalesce(io.n, 0) AS BIGINT) AS includes_count, CAST(coalesce(ro.n, 0) AS BIGINT) AS references_count
      FROM docs d LEFT JOIN ib USING (key) LEFT JOIN rb USING (key) LEFT JOIN io USING (key) LEFT JOIN ro USING (key))"""


@register(_STATS + " SELECT *, included_by_count + referenced_by_count + includes_count + references_count AS total_edges_count FROM st")
def doc_stats(spark, sf_dir):
    return stats.document_stats(geo(spark, sf_dir)).select("key", "title", "included_by_count", "referenced_by_count", "includes_count", "references_count", "total_edges_count")


@register(f"{TEXTS} SELECT key, CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')) AS BIGINT) AS paragraphs, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS words FROM t")
def text_stats(spark, sf_dir):
    return stats.document_stats(texts(spark, sf_dir)).select("key", "paragraphs", "words")


@register(_STATS + " SELECT count(*) AS total_documents, CAST(sum(included_by_count) AS BIGINT) AS inclusion_edges, CAST(sum(referenced_by_count) AS BIGINT) AS reference_edges, round(sum(included_by_count + referenced_by_count) / count(*), 6) AS avg_refs_per_doc, count(*) FILTER (included_by_count + referenced_by_count = 0) AS orphaned_documents, round(100.0 * count(*) FILTER (includes_count = 0) / count(*), 6) AS leaf_percentage FROM st")
def corpus_stats(spark, sf_dir):
    row = stats.corpus_stats(geo(spark, sf_dir))
    return row.select("total_documents", "inclusion_edges", "reference_edges", F.round("avg_refs_per_doc", 6).alias("avg_refs_per_doc"), "orphaned_documents", F.round("leaf_percentage", 6).alias("leaf_percentage"))


@register(_STATS + " SELECT key, included_by_count + referenced_by_count + includes_count + references_count AS edges FROM st ORDER BY edges DESC, key LIMIT 10")
def top_connected(spark, sf_dir):
    return stats.top_documents(geo(spark, sf_dir), "connected").select("key", F.col("total_edges_count").alias("edges"))


@register(_STATS + " SELECT key, included_by_count, referenced_by_count FROM st")
def facet_counts(spark, sf_dir):
    return stats.facet_counts(geo(spark, sf_dir))


_EVENT_FIELDS = EVENTS + """, f AS (SELECT key, 'type' AS path, 'string' AS type, CASE WHEN regexp_full_match(type, '[\\p{L}\\p{N}\\-_./]+') THEN type END AS value FROM t
    UNION ALL SELECT key, 'user', 'number', CAST(user_id AS VARCHAR) FROM t
    UNION ALL SELECT key, 'props', CASE WHEN props IS NULL OR json_type(props) = 'NULL' THEN 'null' ELSE 'object' END, CASE WHEN props IS NULL OR json_type(props) = 'NULL' THEN 'null' END FROM t
    UNION ALL SELECT key, 'props.k', 'number', CAST(props ->> '$.k' AS VARCHAR) FROM t WHERE json_type(props, '$.k') IS NOT NULL)"""


@register(_EVENT_FIELDS + " SELECT path, type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY path), 6) AS percentage FROM f GROUP BY path, type")
def schema_types(spark, sf_dir):
    return schema.types(schema.field_values(events(spark, sf_dir).documents)).withColumn("percentage", F.round("percentage", 6))


@register(_EVENT_FIELDS + " SELECT path, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM t), 6) AS percentage FROM f GROUP BY path")
def schema_coverage(spark, sf_dir):
    docs = events(spark, sf_dir).documents
    return schema.coverage(schema.field_values(docs), docs).withColumn("percentage", F.round("percentage", 6))


@register(_EVENT_FIELDS + ", c AS (SELECT path, value, count(*) AS n FROM f WHERE value IS NOT NULL GROUP BY path, value) SELECT path, value, n FROM c WHERE path IN (SELECT path FROM c GROUP BY path HAVING count(*) <= 100)")
def schema_values(spark, sf_dir):
    return schema.value_counts(schema.field_values(events(spark, sf_dir).documents))


@register(
    f"""{TEXTS}, r AS (SELECT key, n_chars, sum(n_chars) OVER (ORDER BY n_chars DESC, key ROWS UNBOUNDED PRECEDING) AS s, row_number() OVER (ORDER BY n_chars DESC, key) AS n FROM t),
    c AS (SELECT min(n) AS stop FROM r WHERE n > 1 AND s > 200000) SELECT key, n_chars FROM r, c WHERE n < coalesce(stop, n + 1)"""
)
def token_budget(spark, sf_dir):
    """A budget over lengths in characters, which SQL can check; documents in order of length."""
    rows = texts(spark, sf_dir).documents.select("key", F.try_variant_get("fm", "$.n_chars", "long").alias("n_chars"))
    return retrieve.within(rows, [F.desc("n_chars"), F.asc("key")], 200_000, "n_chars")


@register(
    GEO
    + """, seed AS (SELECT key, row_number() OVER (ORDER BY key) AS ord FROM docs WHERE key IN ('nation/3', 'nation/4', 'customer/5')),
    x AS (SELECT ord, key, 0 AS phase, '' AS child, 0 AS depth FROM seed
      UNION ALL SELECT ord, inc.dst, 1, '', 1 FROM seed JOIN inc ON inc.src = seed.key
      UNION ALL SELECT ord, inc.src, 2, '', 1 FROM seed JOIN inc ON inc.dst = seed.key
      UNION ALL SELECT ord, up.src, 3, inc.dst, 1 FROM seed JOIN inc ON inc.src = seed.key JOIN inc up ON up.dst = inc.dst),
    f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord, phase, child, depth) AS n FROM x)
    SELECT key, CAST(ord AS BIGINT) AS ord, phase, depth FROM f WHERE n = 1"""
)
def retrieve_expand(spark, sf_dir):
    c = geo(spark, sf_dir)
    seeds = c.documents.where("key IN ('nation/3', 'nation/4', 'customer/5')").select("key", F.row_number().over(Window.orderBy("key")).alias("ord"))
    return retrieve.expand(c, seeds, includes=1, included_by=1).select("key", F.col("ord").cast("long").alias("ord"), "phase", "depth")


@register(
    GEO
    + """, tr AS (SELECT key AS root, key, 0 AS level FROM docs WHERE key IN ('region/1', 'region/2')
      UNION ALL SELECT tr.root, inc.dst, tr.level + 1 FROM tr JOIN inc ON inc.src = tr.key WHERE tr.level < 2)
    SELECT root, key, level FROM tr"""
)
def tree_depth(spark, sf_dir):
    c = geo(spark, sf_dir)
    starts = c.documents.where("key IN ('region/1', 'region/2')").select("key")
    return graph.tree(c, starts, 3).select("root", "key", "level")


@register(
    GEO
    + """, ch AS (SELECT key, key AS chain, 1 AS n FROM docs WHERE key NOT IN (SELECT dst FROM inc) AND kind = 'region'
      UNION ALL SELECT inc.dst, ch.chain || ' > ' || inc.dst, ch.n + 1 FROM ch JOIN inc ON inc.src = ch.key)
    SELECT chain, n FROM ch"""
)
def node_paths(spark, sf_dir):
    """Chains of keys from the regions down."""
    c = geo(spark, sf_dir)
    one = sources.block(F.lit(0), F.lit(-1), F.lit(0), F.lit(0), F.lit("header"), F.coalesce("title", "key"))
    c.documents = c.documents.withColumn("blocks", F.when(F.col("key").startswith("region/"), F.array(one)).otherwise(F.col("blocks")))
    return graph.paths(c).select(F.array_join("keys", " > ").alias("chain"), F.size("keys").alias("n"))


@register()
def schema_validate(spark, sf_dir):
    """Every text against a schema of its metadata; texts have no metadata of their own, so each violates."""
    return schema.validate(texts(spark, sf_dir), {"note": {"frontmatter": {"required": ["lang"]}, "maxTokens": 4000}}, {"note": ["doc/**"]})


@register()
def update_fields(spark, sf_dir):
    """A guarded metadata edit of matching documents, as a change set."""
    from .operators import edits

    return edits.update(texts(spark, sf_dir), "{filter: {lang: es, n_chars: {$lt: 2000}}, update: {$set: {reviewed: true}}, expect: {min: 0}}")


@register()
def normalize_threads(spark, sf_dir):
    """All conversations as Markdown with normal form, through the reader and renderer."""
    from .operators import edits
    from .sources.files import from_markdown

    turns = threads(spark, sf_dir).documents.select("key", "content")
    return edits.normalize(from_markdown(turns))


# written documents


def sheets(spark: SparkSession, sf_dir: str) -> sources.Corpus:
    """part as Markdown, read by the parser; blocks and metadata depend on the size."""
    from .sources.files import from_markdown

    size = F.col("p_size")
    said = lambda test, *text: F.when(test, F.concat(*[F.lit(t) if isinstance(t, str) else t.cast("string") for t in text])).otherwise("")
    content = F.concat(
        said(size % 6 != 0, "---\nbrand: ", F.col("p_brand"), "\nsize: ", size, "\n---\n\n"),
        said(F.lit(True), "# ", F.col("p_name"), "\n\n", F.col("p_type"), " text\n"),
        said(size % 2 == 1, "\n- item ", F.col("p_brand"), "\n- other\n"),
        said(size % 3 == 0, "\n```sql\nselect ", size, "\n```\n"),
        said(size % 4 == 0, "\n| a | b |\n| - | - |\n| ", F.col("p_brand"), " | x |\n"),
        said(size % 5 == 0, "\n---\n"),
        said(size % 7 == 0, "\n[link](s", size, ")\n"),
        said(size % 2 == 0, "\n> quoted ", F.col("p_type"), "\n"),
    )
    return from_markdown(table(spark, sf_dir, "part").select(F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("key"), content.alias("content")))


_SHEETS = "WITH p AS (SELECT 's' || p_partkey AS key, p_partkey AS id, p_name AS name, p_brand AS brand, p_type AS type, p_size AS size FROM part)"
_BLOCKS = {
    "block_item": ("$item: {$text: 'brand#1'}", "size % 2 = 1 AND contains(lower(brand), 'brand#1')"),
    "block_code": ("$code: {$text: 'select 1'}", "size % 3 = 0 AND contains('select ' || size, 'select 1')"),
    "block_table": ("$table: {$text: 'brand#2'}", "size % 4 = 0 AND contains(lower(brand), 'brand#2')"),
    "block_hr": ("$hr: {}", "size % 5 = 0"),
    "block_ref": ("$ref: {}", "size % 7 = 0"),
    "block_list": ("$list: {}", "size % 2 = 1"),
    "block_quote": ("$within: {$quote: {}}, $text: small", "size % 2 = 0 AND contains(lower(type), 'small')"),
    "block_text_equal": ("$paragraph: {$text: {$eq: 'Small text'}}", "lower(type) = 'small'"),
    "block_references": ("$references: s7", "size = 7"),
    "block_or": ("$or: [{$hr: {}}, {$table: {}}]", "size % 5 = 0 OR size % 4 = 0"),
    "block_and": ("$and: [{$item: {}}, {$text: 'brand#3'}]", "size % 2 = 1 AND contains(lower(brand), 'brand#3')"),
    "block_nor": ("$header: {}, $nor: [{$text: red}, {$text: hot}]", "NOT contains(lower(name), 'red') AND NOT contains(lower(name), 'hot')"),
    "block_in_list": ("$item: {$text: other}, $within: {$section: {$text: gear}}", "size % 2 = 1 AND contains(lower(name), 'gear')"),
}


def _block_query(predicate: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plans.select(sheets(spark, sf_dir), parse.parse_filter_expression(f"$content: {{{predicate}}}")).select("key")

    return run


for _name, (_predicate, _sql) in _BLOCKS.items():
    register(f"{_SHEETS} SELECT key FROM p WHERE {_sql}", _name)(_block_query(_predicate))


@register(_SHEETS + " SELECT key, size % 7 = 0 AS links, brand AS brand FROM p WHERE size % 6 <> 0 AND size > 30")
def sheets_find(spark, sf_dir):
    """Metadata and edges that the parser has read."""
    found = plans.find(sheets(spark, sf_dir), "{filter: {size: {$gt: 30}}, project: {key: $key, brand: 1, to: $references, inside: $includes}}")
    return found.select("key", (F.size("to") + F.size("inside") > 0).alias("links"), text_of(F.col("brand")).alias("brand"))


@register(_SHEETS + " SELECT key, 'frontmatter' AS part FROM p WHERE size % 6 = 0 UNION ALL SELECT key, 'size' FROM p WHERE size % 6 <> 0 AND size > 25")
def schema_violations(spark, sf_dir):
    """Documents without metadata, and with a size over the bound."""
    rules = {"sheet": {"frontmatter": {"required": ["brand"], "properties": {"size": {"maximum": 25}}}}}
    found = schema.validate(sheets(spark, sf_dir), rules, {"sheet": ["s*"]})
    return found.select("key", F.when(F.col("keyword") == "maximum", "size").otherwise("frontmatter").alias("part"))


@register(
    _SHEETS
    + """ SELECT 'update' AS op, key, '---' || chr(10) || 'brand: ' || brand || chr(10) || 'checked: true' || chr(10) || '---' || chr(10) || chr(10) || '# ' || name AS head
    FROM p WHERE size % 6 <> 0 AND size > 40"""
)
def set_and_unset(spark, sf_dir):
    """Metadata edits; the document up to its title."""
    from .operators import edits

    found = edits.update(sheets(spark, sf_dir), "{filter: {size: {$gt: 40}}, update: {$set: {checked: true}, $unset: {size: ''}}}")
    return found.select("op", "key", F.regexp_extract("content", "(?s)^(.*?# [^\n]*)", 1).alias("head"))


@register(_SHEETS + " SELECT 'remove' AS op, key FROM p WHERE size = 7 UNION ALL SELECT 'update', p.key FROM p JOIN p q ON q.id = p.size AND q.size = 7 WHERE p.size % 7 = 0 AND p.size <> 7")
def delete_sheets(spark, sf_dir):
    """Documents that go, and those that linked to them."""
    from .operators import edits

    return edits.delete(sheets(spark, sf_dir), "filter: {size: 7}").select("op", "key")


@register(
    """WITH n AS (SELECT n_regionkey AS r, string_agg('nation ' || n_name, chr(10) || chr(10) ORDER BY n_nationkey) AS said FROM nation GROUP BY n_regionkey)
    SELECT 'r' || r_regionkey AS key, 'of ' || r_name || chr(10) || chr(10) || said || chr(10) AS text FROM region JOIN n ON r = r_regionkey"""
)
def squash_regions(spark, sf_dir):
    """Regions with the nations that they include in place of the links."""
    from .operators import edits
    from .sources.files import from_markdown

    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("key"), F.concat(F.lit("nation "), F.col("n_name"), F.lit("\n")).alias("content"), "n_regionkey", "n_nationkey")
    links = nations.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "key"))).alias("ns"))
    inside = F.array_join(F.transform("ns", lambda n: F.concat(F.lit("["), n["key"], F.lit("]("), n["key"], F.lit(")"))), "\n\n")
    regions = table(spark, sf_dir, "region").join(links, F.col("r_regionkey") == F.col("n_regionkey"))
    regions = regions.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("key"), F.concat(F.lit("of "), F.col("r_name"), F.lit("\n\n"), inside, F.lit("\n")).alias("content"))
    corpus = from_markdown(nations.select("key", "content").unionByName(regions))
    keys = [r["key"] for r in regions.select("key").orderBy("key").collect()]  # a region a row
    return spark.createDataFrame([(k, edits.squash(corpus, k, 1)) for k in keys], "key string, text string")


# clauses on rows that have what they ask for, and rows that don't


@register(THREADS + ", lines AS (SELECT key, unnest(string_split(own, chr(10))) AS text FROM b) SELECT key, text FROM lines WHERE regexp_matches(text, '^In |tion on')")
def grep_turns(spark, sf_dir):
    found = plans.find(threads(spark, sf_dir), "{project: {key: $key, found: {$matches: '^In |tion on'}}}")
    return found.select("key", F.explode("found").alias("f")).select("key", F.col("f.text").alias("text"))


@register(f"{GEO}, {_DOWN} SELECT key FROM docs WHERE kind = 'nation' AND key NOT IN (SELECT dst FROM inc WHERE src = 'region/1')")
def relation_nor_some(spark, sf_dir):
    return plans.select(geo(spark, sf_dir), parse.parse_filter_expression("{kind: nation, $nor: [{$includedBy: region/1}]}")).select("key")


@register(f"{GEO}, {_DOWN} SELECT key FROM docs WHERE kind IN ('nation', 'supplier') AND key NOT IN (SELECT src FROM inc)")
def leaves_some(spark, sf_dir):
    return plans.select(geo(spark, sf_dir), parse.parse_filter_expression("{kind: {$in: [nation, supplier]}, $includes: {$size: 0}}")).select("key")


def _talks(spark: SparkSession, sf_dir: str) -> sources.Corpus:
    """conversations with their roles in order, and a field that filters must not see."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("t"))
    roles = F.col("t.role")
    fm = F.to_json(F.struct(roles.alias("roles"), F.size("t").alias("_turns"), F.struct(roles.alias("r"), F.size("t").alias("n")).alias("of")))
    docs = sources.documents(turns, F.concat(F.lit("conv/"), F.col("conv_id").cast("string")), fm)
    return sources.Corpus(docs, sources.no_edges(spark), sources.no_edges(spark))


_TALKS = "WITH c AS (SELECT 'conv/' || conv_id AS key, list(role ORDER BY turn, role) AS roles, count(*) AS n FROM conversations GROUP BY conv_id)"
_OF_TALKS = {
    "array_size": ("roles: {$size: {$gte: 4, $lt: 7}}", "n >= 4 AND n < 7"),
    "array_whole": ("roles: [user, assistant, user, assistant]", "roles = ['user', 'assistant', 'user', 'assistant']"),
    "object_whole": ("of: {$eq: {n: 2.0, r: [user, assistant]}}", "roles = ['user', 'assistant']"),
    "reserved_never_tested": ("$or: [{_turns: {$gt: 0}}, {roles: {$size: 6}}]", "n = 6"),
}


def _talk_query(filter_text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plans.select(_talks(spark, sf_dir), parse.parse_filter_expression(filter_text)).select("key")

    return run


for _name, (_filter, _sql) in _OF_TALKS.items():
    register(f"{_TALKS} SELECT key FROM c WHERE {_sql}", _name)(_talk_query(_filter))


@register(f"{TEXTS} SELECT key, rank() OVER (ORDER BY n_chars DESC) AS place FROM t")
def shared_ranks(spark, sf_dir):
    from .plans.ranking import tied

    rows = texts(spark, sf_dir).documents.select("key", F.try_variant_get("fm", "$.n_chars", "long").alias("chars"))
    return tied(rows, "chars", "place").select("key", F.col("place").cast("long").alias("place"))


@register(GEO + " SELECT src AS key, dst AS other, min(pos) AS place FROM ref WHERE src LIKE 'order/1%' GROUP BY ALL")
def first_edges(spark, sf_dir):
    """Of several references between two documents, the first in block order."""
    c = geo(spark, sf_dir)
    rows = graph.edge_rows(c, "$references").where("key LIKE 'order/1%'").withColumn("pair", F.concat_ws(">", "key", "other"))
    return graph.first_per(rows, "pair", "block_pos").select("key", "other", F.col("block_pos").alias("place"))
