"""Queries over keyed tables, vectors and streams, and their twins."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import text as X
from ..functions.chains import sql_match
from ..operators import library as B, lines as O, vectors as V
from ..sources import tables as T
from ..sources.stored import BucketedTable, Library, replace_stored_children
from ..sources.tables import table
from ..streaming import jobs

QUERIES, SQL = {}, {}


def _key(text):
    """The title key of a whole text, as a digest: it is short whatever the text's length."""
    return F.md5(X.title_key_plain(text))


_KEY_SQL = f"md5({X.title_key_plain.sql('text')})"


def folder(spark) -> str:
    """A fresh folder that executors see as well."""
    return T.fresh_path(spark, "job")


def topk_context(spark, d):
    """The five rows nearest to vector 0 among those of its label, with their texts, numbered."""
    e = table(spark, d, "embeddings")
    query = e.filter("vec_id = 0").select(F.col("embedding").alias("q"), F.col("label").alias("l"))
    label = query.select("l")
    near = V.topk(e.join(F.broadcast(label), F.col("label") == F.col("l"), "left_semi"), query.select("q"), 5)
    docs = table(spark, d, "documents").select("doc_id", "text")
    got = near.join(docs, F.col("vec_id") == F.col("doc_id"), "left")
    rank = F.row_number().over(W.partitionBy("label").orderBy(F.col("similarity").desc_nulls_last(), "vec_id"))
    return got.select(F.lit(1).alias("query"), rank.alias("rank"), "vec_id", F.round("similarity", 6).alias("similarity"), "text")


QUERIES["topk_context"] = topk_context
_near = """(SELECT vec_id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS s FROM embeddings WHERE embedding IS NOT NULL)"""
SQL["topk_context"] = f"""SELECT 1 AS query, row_number() OVER (ORDER BY s DESC, vec_id) AS rank, vec_id, round(s, 6) AS similarity, text
  FROM (SELECT * FROM {_near} WHERE label = (SELECT label FROM embeddings WHERE vec_id = 0) ORDER BY s DESC, vec_id LIMIT 5) LEFT JOIN documents ON doc_id = vec_id"""


def vector_topk(spark, d):
    e = table(spark, d, "embeddings")
    return V.topk(e, e.filter("vec_id = 0").select(F.col("embedding").alias("q")), 5).select("vec_id", F.round("similarity", 6).alias("similarity"))


QUERIES["vector_topk"] = vector_topk
SQL["vector_topk"] = f"SELECT vec_id, round(s, 6) AS similarity FROM {_near} ORDER BY s DESC, vec_id LIMIT 5"


def _queries(spark, d):
    return table(spark, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q"))


QUERIES["vector_topk_batch"] = lambda s, d: V.topk_batch(_queries(s, d), table(s, d, "embeddings")).select("q_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")
SQL["vector_topk_batch"] = """SELECT a.vec_id AS q_id, b.vec_id AS vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 QUALIFY rank <= 3"""


def vector_topk_ivf(spark, d):
    """Lists grow with the table; so many are probed that 0.9 of the true neighbours are found."""
    index = V.StoredLists(spark, folder(spark)).build(table(spark, d, "embeddings"))
    probes, _ = V.fit_probes(_queries(spark, d), index.rows(), index.centres(), recall=0.9)
    return index.search(_queries(spark, d), probes=probes).select("q_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


QUERIES["vector_topk_ivf"] = vector_topk_ivf
QUERIES["recent_fallback"] = lambda s, d: V.recent(table(s, d, "documents").filter(F.col("lang") == "en").select("doc_id"), [F.col("doc_id").desc()])
SQL["recent_fallback"] = "SELECT doc_id, 0.5::DOUBLE AS similarity FROM documents WHERE lang = 'en' ORDER BY doc_id DESC LIMIT 3"


def _length_embedder():
    """Two numbers of a text, so that SQL can say them too: 1 and the length in thousands of letters."""
    return lambda texts: [[1.0, len(t) / 1024] for t in texts]


QUERIES["embed_sections"] = lambda s, d: V.embed_sections(table(s, d, "documents").select("doc_id", "text"), "text", _length_embedder()).select("doc_id", F.size("embedding").alias("dim"), F.round(F.get("embedding", F.lit(1)).cast("double"), 6).alias("length"))
_BLANK_SQL = "trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')"
SQL["embed_sections"] = f"""SELECT doc_id, CASE WHEN {_BLANK_SQL} <> '' THEN 2 END AS dim, CASE WHEN {_BLANK_SQL} <> '' THEN round(CAST(least(length(text), 8000) / 1024.0 AS FLOAT)::DOUBLE, 6) END AS length FROM documents"""


def search_sections(spark, d):
    """The three English documents nearest to the first benchmark text, by a toy embedding."""
    docs = V.embed_sections(table(spark, d, "documents").select("doc_id", "lang", "text"), "text", _length_embedder())
    text = table(spark, d, "benchmark").agg(F.min_by("text", "item_id").alias("text"))
    return V.search_sections(docs, text, _length_embedder(), [F.col("doc_id").desc()], key="doc_id", kind=F.col("lang") == "en").select("doc_id", F.round("similarity", 6).alias("similarity"))


QUERIES["search_sections"] = search_sections
SQL["search_sections"] = """WITH e AS (SELECT doc_id, CAST(least(length(text), 8000) / 1024.0 AS FLOAT)::DOUBLE AS y FROM documents WHERE lang = 'en' AND trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') <> ''),
  q AS (SELECT CAST(least(length(min_by(text, item_id)), 8000) / 1024.0 AS FLOAT)::DOUBLE AS z FROM benchmark)
  SELECT doc_id, round((1 + y * z) / (sqrt(1 + y * y) * sqrt(1 + z * z)), 6) AS similarity FROM e, q ORDER BY (1 + y * z) / (sqrt(1 + y * y) * sqrt(1 + z * z)) DESC, doc_id LIMIT 3"""


def best_version(spark, d):
    """Documents as versions of a section: texts that differ in letters' case and marks only."""
    docs = table(spark, d, "documents")
    return B.best_version(docs.select("doc_id", "text", "lang"), _key(F.col("text")), "text", ["doc_id"]).select("key", "doc_id", F.length("text").alias("n"), F.col("first_seen.doc_id").alias("first_seen"))


QUERIES["best_version"] = best_version
SQL["best_version"] = f"""SELECT key, doc_id, length(text) AS n, min(doc_id) OVER (PARTITION BY key) AS first_seen FROM (SELECT *, {_KEY_SQL} AS key FROM documents)
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY coalesce(length(text), 0) DESC, doc_id) = 1"""


def refresh_library(spark, d):
    """The library after three batches of changes: two of documents, one that takes every seventh away."""
    kept = Library(spark, folder(spark), buckets=8, deltas=2)
    docs = table(spark, d, "documents").select(_key(F.col("text")).alias("key"), F.col("doc_id").alias("id"), F.coalesce(F.length("text"), F.lit(0)).alias("size"), F.col("doc_id").alias("created"))
    for n, (part, gone) in enumerate((("id % 2 = 0", False), ("id % 2 = 1", False), ("id % 7 = 0", True))):
        kept.change(docs.filter(part).withColumn("gone", F.lit(gone)), n)
    return kept.library().select("key", F.col("id").alias("doc_id"), F.col("size").cast("int").alias("n"), "first_seen")


QUERIES["refresh_library"] = refresh_library
SQL["refresh_library"] = f"""SELECT key, doc_id, coalesce(length(text), 0) AS n, min(doc_id) OVER (PARTITION BY key) AS first_seen FROM (SELECT *, {_KEY_SQL} AS key FROM documents WHERE doc_id % 7 <> 0)
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY coalesce(length(text), 0) DESC, doc_id) = 1"""


def _sections(spark, d):
    """Documents as sections, which have their whole texts as titles; English ones are technologies."""
    return table(spark, d, "documents").select("doc_id", "lang", "source", F.col("text").alias("title"), "n_chars")


def dedup_against_library(spark, d):
    s, only = _sections(spark, d), F.col("lang") == "en"
    old = F.col("doc_id") % 3 == 0
    return B.dedup_against_library(s.filter(~old), s.filter(old & only), _key(F.col("title")), _key(F.col("title")), only, [F.col("doc_id")]).select("doc_id", "lang")


QUERIES["dedup_against_library"] = dedup_against_library
SQL["dedup_against_library"] = f"""WITH s AS (SELECT doc_id, lang, {_KEY_SQL} AS k FROM documents), old AS (SELECT DISTINCT k FROM s WHERE doc_id % 3 = 0 AND lang = 'en')
  SELECT doc_id, lang FROM s WHERE doc_id % 3 <> 0 AND (lang IS NULL OR lang <> 'en') UNION ALL
  SELECT doc_id, lang FROM (SELECT * FROM s WHERE doc_id % 3 <> 0 AND lang = 'en' AND (k IS NULL OR k NOT IN (SELECT k FROM old WHERE k IS NOT NULL)) QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id) = 1)"""


def replace_children(spark, d):
    """The sections of source src1 get new versions: those of src2, in its name."""
    s, only = _sections(spark, d), F.col("lang") == "en"
    new = s.filter("source = 'src2'").withColumn("source", F.lit("src1"))
    return B.replace_children(s, new, "source", _key(F.col("title")), only, [F.col("doc_id")]).groupBy("source").agg(F.count("*").alias("section_count"))


QUERIES["replace_children"] = replace_children
SQL["replace_children"] = f"""WITH s AS (SELECT doc_id, lang, source, {_KEY_SQL} AS k FROM documents), o AS (SELECT * FROM s WHERE source IS NULL OR source <> 'src1'), n AS (SELECT * FROM s WHERE source = 'src2'),
  r AS (SELECT source FROM o UNION ALL SELECT 'src1' FROM n WHERE lang <> 'en' UNION ALL
    SELECT 'src1' FROM (SELECT * FROM n WHERE lang = 'en' AND k NOT IN (SELECT k FROM o WHERE lang = 'en' AND k IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id) = 1))
  SELECT source, count(*) AS section_count FROM r GROUP BY source"""


def reparse_stored(spark, d):
    """A table of sections by source, of which one source gets those of another in its name: what
    the table holds then, by source."""
    s, only, out = _sections(spark, d), F.col("lang") == "en", folder(spark)
    s.write.partitionBy("source").parquet(out)
    new = s.filter("source = 'src2'").withColumn("source", F.lit("src1"))
    replace_stored_children(new, out, "source", _key(F.col("title")), only, [F.col("doc_id")])
    return spark.read.schema(s.select([c for c in s.columns if c != "source"] + ["source"]).schema).parquet(out).groupBy("source").agg(F.count("*").alias("section_count"))


QUERIES["reparse_stored"] = reparse_stored
SQL["reparse_stored"] = SQL["replace_children"]


def prefer_merge(spark, d):
    s = _sections(spark, d).withColumn("k", _key(F.col("title")))
    return B.prefer_merge(s.filter("lang = 'en'"), s.filter("lang <> 'en'"), ["k"], [F.col("doc_id")]).select("k", "doc_id")


QUERIES["prefer_merge"] = prefer_merge
SQL["prefer_merge"] = f"SELECT k, doc_id FROM (SELECT doc_id, lang, {_KEY_SQL} AS k FROM documents WHERE lang IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY k ORDER BY CASE WHEN lang = 'en' THEN 0 ELSE 1 END, doc_id) = 1"


def cascade_delete(spark, d):
    orders, items = table(spark, d, "orders"), table(spark, d, "lineitem")
    gone = orders.filter("o_orderstatus = 'F'").select("o_orderkey")
    left, kids = B.cascade_delete(orders, items, gone, "o_orderkey", "l_orderkey")
    return left.join(kids.groupBy("l_orderkey").agg(F.count("*").alias("n_lines")), F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


QUERIES["cascade_delete"] = cascade_delete
SQL["cascade_delete"] = "SELECT o_orderkey, coalesce(n, 0) AS n_lines FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F'"

_STATUS_OF = {"click": "valid", "view": "withdrawn", "purchase": "replaced", "error": "unknown"}


def _status():
    return F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in _STATUS_OF.items()], F.lit("under_review"))


_STATUS_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATUS_OF.items()) + " ELSE 'under_review' END"
QUERIES["status_summary"] = lambda s, d: B.status_summary(table(s, d, "events"), _status())
SQL["status_summary"] = f"SELECT count(*) AS total, {', '.join(f'count(*) FILTER (s = {v!r}) AS {v}' for v in ('valid', 'withdrawn', 'replaced', 'under_review', 'unknown'))} FROM (SELECT {_STATUS_SQL} AS s FROM events)"
QUERIES["count_by_type"] = lambda s, d: table(s, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
SQL["count_by_type"] = "SELECT lang, count(*) AS n FROM documents GROUP BY lang"


def ttl_cache_split(spark, d):
    """Users as references; their last event is what the cache knows of them."""
    ev = table(spark, d, "events").withColumn("status", _status())
    cache = ev.groupBy("user_id").agg(F.max_by(F.struct("status", "ts"), F.struct("ts", "event_id")).alias("r")).select("user_id", "r.status", F.col("r.ts").alias("checked_at"))
    return B.ttl_split(ev.select("user_id").distinct(), cache, "user_id", F.lit("2024-01-31 00:00:00")).select("user_id", "status", "state")


QUERIES["ttl_cache_split"] = ttl_cache_split
SQL["ttl_cache_split"] = f"""SELECT user_id, s AS status, CASE WHEN epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(ts) < 86400 AND s <> 'unknown' THEN 'fresh' ELSE 'check' END AS state
  FROM (SELECT *, {_STATUS_SQL} AS s FROM events) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""


def _halves(spark, d):
    ev = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return ev.filter("event_id % 2 = 0"), ev.filter("event_id % 2 = 1")


QUERIES["upsert_latest"] = lambda s, d: B.upsert_latest(*_halves(s, d), ["user_id", "event_type"], ["ts", "event_id"])
SQL["upsert_latest"] = "SELECT user_id, event_type, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"


def stored_upsert(spark, d):
    """Events as changes of a stored table, in five batches, of which some are merged."""
    ev = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value")
    kept = BucketedTable(spark, folder(spark), ev.schema, ["user_id", "event_type"], ["ts", "event_id"], buckets=8, deltas=3)
    for n in range(5):
        kept.add(ev.filter(F.col("event_id") % 5 == n), n)
    return kept.rows()


QUERIES["stored_upsert"] = stored_upsert
SQL["stored_upsert"] = SQL["upsert_latest"]
QUERIES["cache_type"] = lambda s, d: table(s, d, "orders").select("o_orderkey", F.when(F.concat(F.when(F.col("o_orderkey") % 2 == 0, "Наредба ").otherwise("БДС "), F.col("o_orderkey").cast("string")).rlike("^(Наредба|Закон)"), "regulation").otherwise("standard").alias("ref_type"))
SQL["cache_type"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'regulation' ELSE 'standard' END AS ref_type FROM orders"


def apply_changes(spark, d):
    """Events as changes of users: clicks create, views and purchases update, errors delete."""
    ev = table(spark, d, "events")
    op = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in (("click", "create"), ("error", "delete"))], F.lit("update"))
    log = ev.select("user_id", op.alias("op"), F.when(F.col("event_type") != "view", F.col("value")).alias("value"), F.when(F.col("event_type") == "view", F.col("props")).alias("props"), "ts", "event_id")
    base = ev.limit(0).select("user_id", "value", "props")
    return B.apply_changes(base, log, "user_id", ["value", "props"], ["ts", "event_id"])


QUERIES["apply_changes"] = apply_changes
SQL["apply_changes"] = """WITH l AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'click' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'update' END AS op, CASE WHEN event_type <> 'view' THEN value END AS v, CASE WHEN event_type = 'view' THEN props END AS p FROM events),
  f AS (SELECT * FROM l WHERE op <> 'update' OR v IS NOT NULL OR p IS NOT NULL),
  b AS (SELECT *, last_value(CASE WHEN op <> 'update' THEN op END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM f),
  n AS (SELECT *, sum(CASE WHEN op = 'create' AND coalesce(prev, 'delete') <> 'create' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS life FROM b),
  k AS (SELECT * FROM n WHERE life > 0 AND life = (SELECT max(life) FROM n m WHERE m.user_id = n.user_id))
  SELECT user_id, last(v ORDER BY ts, event_id) FILTER (v IS NOT NULL) AS value, last(p ORDER BY ts, event_id) FILTER (p IS NOT NULL) AS props, max(ts) AS updated_at FROM k GROUP BY user_id HAVING last(op ORDER BY ts, event_id) <> 'delete'"""

RULES = [(r"(?i)ring|bolt", "Fasteners"), (r"(?i)widget", "Widgets"), (r"(?i)gear", "Gears")]
QUERIES["category_rollup"] = lambda s, d: B.category_rollup(table(s, d, "part"), "p_name", "p_partkey", RULES, "Други СМР")
_rule = "CASE " + " ".join(f"WHEN {sql_match('p_name', p)} THEN '{c}'" for p, c in RULES) + " ELSE 'Други СМР' END"
SQL["category_rollup"] = f"""WITH r AS (SELECT *, {_rule} AS category FROM part), n AS (SELECT category, count(*) AS n, min(p_partkey) AS f FROM r GROUP BY category),
  t AS (SELECT category, string_agg(p_name, ', ' ORDER BY p_partkey) AS names FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY category ORDER BY p_partkey) <= 5) GROUP BY category)
  SELECT category, row_number() OVER (ORDER BY f) AS ord, n, row_number() OVER (ORDER BY f) || '. ' || category || ' (' || names || CASE WHEN n > 5 THEN ' и др.' ELSE '' END || ')' AS line FROM n JOIN t USING (category)"""

QUERIES["list_newest_first"] = lambda s, d: table(s, d, "orders").select("o_orderkey", "o_orderdate").orderBy(F.col("o_orderdate").desc(), "o_orderkey")
SQL["list_newest_first"] = "SELECT o_orderkey, o_orderdate FROM orders"
QUERIES["sections_of_doc"] = lambda s, d: table(s, d, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n")).orderBy("conv_id", "turn")
SQL["sections_of_doc"] = "SELECT conv_id, turn, role, length(text) AS n FROM conversations"
QUERIES["ingest_documents"] = lambda s, d: table(s, d, "documents").select("doc_id", F.concat_ws(".", "source", "lang", F.lit("txt")).alias("filename"), F.length("text").alias("n"))
SQL["ingest_documents"] = "SELECT doc_id, concat_ws('.', source, lang, 'txt') AS filename, length(text) AS n FROM documents"
QUERIES["ingest_manifest"] = lambda s, d: T.manifest(table(s, d, "orders").select(F.concat(F.lit("in/"), "o_orderkey", F.element_at(F.array(*map(F.lit, [".pdf", ".DOCX", ".doc", ".exe", "/../x.pdf", ".xlsx"])), (F.col("o_orderkey") % 6).cast("int") + 1)).alias("path"), (F.col("o_totalprice") * 1000).cast("long").alias("length")))
SQL["ingest_manifest"] = """WITH f AS (SELECT 'in/' || o_orderkey || ['.pdf', '.DOCX', '.doc', '.exe', '/../x.pdf', '.xlsx'][o_orderkey % 6 + 1] AS path, CAST(trunc(o_totalprice * 1000) AS BIGINT) AS length, o_orderkey % 6 AS k FROM orders),
  r AS (SELECT *, CASE WHEN k = 4 THEN 'bad name' WHEN k = 3 THEN 'unknown kind' WHEN k = 2 THEN 'old format' WHEN length > CASE WHEN k = 5 THEN 52428800 ELSE 104857600 END THEN 'too large' END AS reason FROM f) SELECT path, length, reason IS NULL AS accepted, reason FROM r"""


def latest_object(spark, d):
    """The newest order of each customer, as the newest object under a prefix."""
    o = table(spark, d, "orders")
    return o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


QUERIES["latest_object"] = latest_object
SQL["latest_object"] = "SELECT o_custkey, o_orderkey AS latest FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"


def save_sections(spark, d):
    s = _sections(spark, d)
    kids = s.filter("doc_id % 4 <> 0 or lang <> 'en'").select("source", F.col("lang").alias("section_type"), "title", F.lit(None).cast("int").alias("order_index"))
    out = folder(spark)
    B.save_sections(s.select("source").distinct(), kids, "source", out)
    return spark.read.parquet(f"{out}/parents")


QUERIES["save_sections"] = save_sections
SQL["save_sections"] = "SELECT source, CAST(count(*) FILTER (doc_id % 4 <> 0 OR lang <> 'en') AS INT) AS section_count FROM documents GROUP BY source"


def clear_table(spark, d):
    out = folder(spark)
    table(spark, d, "events").write.mode("overwrite").parquet(f"{out}/t")
    B.clear_table(spark, f"{out}/t")
    return spark.read.parquet(f"{out}/t").select("event_id", "event_type")


QUERIES["clear_table"] = clear_table
SQL["clear_table"] = "SELECT event_id, event_type FROM events WHERE false"
QUERIES["augment_list"] = lambda s, d: B.augment(table(s, d, "part").select("p_name", "p_partkey"), "p_name", "p_partkey", [("(?iu)ръководител", "Ръководител на проекта", -1), ("(?i)ring", "ring", 1e12), ("(?iu)геодез", "Геодезист", 1e12)])
SQL["augment_list"] = "SELECT p_name, CAST(p_partkey AS DOUBLE) AS p_partkey FROM part UNION ALL SELECT 'Ръководител на проекта', -1.0 UNION ALL SELECT 'Геодезист', 1e12"


def assemble_sections(spark, d):
    """Conversations as offers: an assistant's turns are technologies; of some nothing was found."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    docs = O.join_lines(turns.select("conv_id", F.col("turn").alias("pos"), F.col("text").alias("line")), "conv_id")
    title = F.regexp_extract("text", r"^[^\n]*", 0)
    rows = turns.filter("conv_id % 5 < 3").select("conv_id", F.when(F.col("role") == "assistant", "smr_technology").otherwise("introduction").alias("section_type"), title.alias("title"), F.col("text").alias("plain_text"), F.col("turn").alias("order_index"))
    tech = rows.filter("section_type = 'smr_technology'").withColumnRenamed("order_index", "ord")
    return B.assemble_sections(docs, rows, tech, "conv_id").select("conv_id", "section_type", "order_index", "title", "plain_text")


QUERIES["assemble_sections"] = assemble_sections
SQL["assemble_sections"] = """WITH t AS (SELECT conv_id, turn, coalesce(role = 'assistant', false) AS tech, coalesce(text, '') AS text FROM conversations)
  SELECT conv_id, CASE WHEN tech THEN 'smr_technology' ELSE 'introduction' END AS section_type, row_number() OVER (PARTITION BY conv_id ORDER BY tech, turn) - 1 AS order_index, split_part(text, chr(10), 1) AS title, text AS plain_text FROM t WHERE conv_id % 5 < 3
  UNION ALL SELECT conv_id, 'other', 0, 'Цялото съдържание', string_agg(text, chr(10) ORDER BY turn) FROM t WHERE conv_id % 5 >= 3 GROUP BY conv_id"""


#: Documents of one file that arrives.
FILE_ROWS = 10_000


def stream_section_ingest(spark, d):
    """Documents arrive in two batches of files, four or more; the table that grows equals the batch
    result's keys. A file has a bounded number of rows, as a task writes and reads it whole."""
    out, s = folder(spark), _sections(spark, d)
    half = max(2, -(-s.count() // (2 * FILE_ROWS)))
    s.repartitionByRange(2 * half, "doc_id").sortWithinPartitions("doc_id").write.parquet(f"{out}/in")
    only = F.col("lang") == "en"
    jobs.section_ingest(jobs.file_source(spark, f"{out}/in", s.schema, half), f"{out}/table", f"{out}/state", _key(F.col("title")), only, [F.col("doc_id")])
    return spark.read.parquet(f"{out}/table").select(_key(F.col("title")).alias("key"), "lang")


QUERIES["stream_section_ingest"] = stream_section_ingest
SQL["stream_section_ingest"] = f"SELECT {_KEY_SQL} AS key, lang FROM documents WHERE lang <> 'en' UNION ALL SELECT DISTINCT {_KEY_SQL}, lang FROM documents WHERE lang = 'en'"


def stream_upsert(spark, d):
    out, ev = folder(spark), table(spark, d, "events").select("user_id", "event_type", "event_id", "ts", "value")
    ev.repartitionByRange(4, "event_id").write.parquet(f"{out}/in")
    kept = jobs.upsert_stream(jobs.file_source(spark, f"{out}/in", ev.schema, 2), f"{out}/table", f"{out}/state", ["user_id", "event_type"], ["ts", "event_id"], buckets=8)
    return kept.rows().select("user_id", "event_type", "event_id")


QUERIES["stream_upsert"] = stream_upsert
SQL["stream_upsert"] = "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"


def stream_ttl_cache(spark, d):
    """Events as questions to the cache of their user; they arrive in four files, by time."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = folder(spark)
    ev = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), _status().alias("status"))
    cuts = ev.select(F.col("ts").cast("double").alias("t")).approxQuantile("t", [0.25, 0.5, 0.75], 0.01) or [0.0]
    for lo, hi in zip([float("-inf"), *cuts], [*cuts, float("inf")], strict=True):
        part = ev.filter((F.col("ts").cast("double") >= lo) & (F.col("ts").cast("double") < hi))
        part.coalesce(1).write.mode("append").parquet(f"{out}/in")
    stream = jobs.ttl_cache(jobs.file_source(spark, f"{out}/in", ev.schema, 1), "user_id")
    stream.writeStream.format("parquet").option("path", f"{out}/out").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/out")


QUERIES["stream_ttl_cache"] = stream_ttl_cache
SQL["stream_ttl_cache"] = f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS t, {_STATUS_SQL} AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  r AS (SELECT user_id, event_id, n, t AS held, status AS known, 'check' AS state FROM e WHERE n = 1
    UNION ALL SELECT e.user_id, e.event_id, e.n, CASE WHEN e.t - r.held < 86400 AND r.known <> 'unknown' THEN r.held ELSE e.t END, CASE WHEN e.t - r.held < 86400 AND r.known <> 'unknown' THEN r.known ELSE e.status END,
      CASE WHEN e.t - r.held < 86400 AND r.known <> 'unknown' THEN 'fresh' ELSE 'check' END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
  SELECT event_id, state FROM r"""
