"""Every registered query over the benchmark tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.counts import parse_count
from threadloom.functions.html import element, inside
from threadloom.functions.urls import post_id
from threadloom.operators import explore, funnel, graph, numeric, report, search
from threadloom.operators.pages import CommentFields, PageFields, extract_links, page_comments, page_fields
from threadloom.operators.texts import corpus_texts
from threadloom.params import Analysis, Filters, StudyProfile
from threadloom.plans import tables
from threadloom.plans.collect import collect_records
from threadloom.plans.corpus import build_corpus, publish_corpus
from threadloom.plans.report import report_table
from threadloom.session import scratch_dir
from threadloom.sources.corpus import append_new, normalize_nulls, read_corpus, write_corpus
from threadloom.sources.records import conform, parse_lines, quarantine, read_lines, read_records, rejected_lines, stamp_study, to_json_lines
from threadloom.streaming.arrivals import append_new_state, append_new_stream, read_rejects, read_state_store, read_store, rejects_of

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str, ints: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query with its SQL; ``ints`` are the columns Spark gives as 32-bit integers."""
    casts = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in ints)

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        SQL[fn.__name__] = f"SELECT * REPLACE ({casts}) FROM ({sql})" if ints else sql
        return fn

    return register


# --- shared SQL -------------------------------------------------------------------------------

# Same records as tables.document_records; {id} is the id rule.
_DOCS = """
docs AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls, lang, source, n_chars FROM documents),
recs AS (
  SELECT doc_id, {id} AS id, source AS subreddit, lang AS keyword_group, lang || ' text' AS keyword,
         'study_' || lang AS study_id, 'Documents' AS theme_label,
         'https://forum.example/r/' || source || '/comments/' || doc_id || '/x' AS url,
         ls[1] AS title, 'u' || doc_id AS author, ls[2] AS body, n_chars AS upvotes,
         len(ls) AS comment_count, CAST(doc_id AS VARCHAR) AS "timestamp",
         ls, CAST(greatest(len(ls) - 2, 0) AS INTEGER) AS n_comments
  FROM docs)"""
_SHARED = _DOCS.format(id="CASE WHEN lang = 'es' THEN NULL WHEN source = 'src3' THEN '' ELSE lang || '-' || n_chars END")
_UNIQUE = _DOCS.format(id="CAST(doc_id AS VARCHAR)")

_CREATOR = r"(tion and)|(license)|(que de\w* le)|(und)"
_FLAG = f"(regexp_matches(title, '{_CREATOR}', 'i') OR regexp_matches(coalesce(body, ''), '{_CREATOR}', 'i'))"

_FIRSTS = """
firsts AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY doc_id) AS rn FROM recs)
  WHERE rn = 1)"""

FILTERS = Filters(
    min_comments=3, min_chars=40, creator_patterns=tables.CREATOR_PATTERNS,
    exclude_terms=("License", "of. the"), require_any_terms=("the of", "und", "QUE"),
)
_BLOB = "lower(title || ' ' || coalesce(body, ''))"
_R1 = "n_comments >= 3"
_R3 = "length(title) + length(coalesce(body, '')) >= 40"
_R4 = f"NOT (contains({_BLOB}, 'license') OR contains({_BLOB}, 'of. the'))"
_R5 = f"(contains({_BLOB}, 'the of') OR contains({_BLOB}, 'und') OR contains({_BLOB}, 'que'))"
_SURVIVORS = f"survivors AS (SELECT * FROM firsts WHERE {_R1} AND {_R3} AND {_R4} AND {_R5})"

_POSTS_COLS = f"""id AS "ID", subreddit AS "Subreddit", keyword AS "Keyword", title AS "Titulo", author AS "Autor",
  coalesce(body, '') AS "Texto", upvotes AS "Upvotes", n_comments AS "Num_Comentarios", "timestamp" AS "Data",
  url AS "URL", {_FLAG} AS is_creator_suspect, study_id AS "Study_ID", theme_label AS "Theme" """
_COMMENTS_COLS = """id AS "Post_ID", keyword_group AS "Autor_Comentario", line AS "Texto_Comentario",
  length(line) AS "Upvotes_Comentario" """


def _exploded(source: str) -> str:
    return f"(SELECT *, unnest(ls[3:]) AS line FROM {source})"


_CORPUS = f"""WITH {_UNIQUE},
posts AS (SELECT {_POSTS_COLS} FROM recs),
comments AS (SELECT {_COMMENTS_COLS} FROM {_exploded('recs')}),
loose AS (
  SELECT 'posts' AS origin, "ID" AS id, "Titulo" || ' ' || "Texto" AS txt FROM posts
  UNION ALL SELECT 'comments', "Post_ID", "Texto_Comentario" FROM comments),
strict AS (
  SELECT origin, id, lower(txt) AS txt FROM (
    SELECT 'posts' AS origin, "ID" AS id, nullif("Titulo", '') || ' ' || nullif("Texto", '') AS txt FROM posts
    UNION ALL SELECT 'comments', "Post_ID", nullif("Texto_Comentario", '') FROM comments)
  WHERE txt IS NOT NULL)"""

_ORDERS = """orders_posts AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS "ID", o_orderpriority AS "Subreddit",
         'Order of ' || o_custkey || ' ' || o_orderpriority AS "Titulo",
         CAST(floor(o_totalprice) AS BIGINT) AS "Upvotes", CAST(coalesce(n, 0) AS INTEGER) AS "Num_Comentarios",
         'https://forum.example/o/' || o_orderkey AS "URL", o_orderstatus = 'F' AS is_creator_suspect
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"""

_EVENTS = """ev AS (
  SELECT CASE WHEN event_type = 'error' THEN '' ELSE user_id || '-' || (event_id % 100) END AS id,
         event_id, ts, event_type, props FROM events),
stored AS (SELECT * FROM ev WHERE ts < TIMESTAMP '2024-01-16'),
incoming AS (SELECT * FROM ev WHERE ts >= TIMESTAMP '2024-01-16')"""


def _occurrences(text: str, term: str) -> str:
    return f"CAST((length({text}) - length(replace({text}, '{term}', ''))) / {len(term)} AS BIGINT)"


def _term_rows(source: str, terms: tuple[str, ...], text: str) -> str:
    rows = [
        f"SELECT {i} AS term_ord, '{t}' AS term, CAST(sum({_occurrences(text, t.lower())}) AS BIGINT) AS n FROM {source}"
        for i, t in enumerate(terms)
    ]
    return " UNION ALL ".join(rows)


TERMS = ("the", "AND", "und", "que", "tion", "license", "shadowban", "erth the", "é")
TACTICS = r"(the|and) (of|on)|tested"
THEORIES = r"\d+ times?|que de|watch time"
LEXICON = ("the", "ing[ ,.]", "un[ad]", "shadowban", "l[ae]s? ", "license", r"\d{2,}")
ACTANTS = {"articles": ("the", "les", "der"), "joins": ("and", "und", "que"), "rare": ("license", "shadowban", "tion")}
_ACTANT_TERMS = tuple(t for members in ACTANTS.values() for t in members)


# --- A. sources and sinks ---------------------------------------------------------------------

_RECORD_COLS = """id, subreddit, keyword_group, keyword, study_id, theme_label, url, title, author, body, upvotes,
  comment_count, "timestamp", n_comments, comment_chars"""
_RECORD_SQL = f"""WITH {_SHARED}
SELECT {_RECORD_COLS} FROM (SELECT *, CAST(length(array_to_string(ls[3:], '')) AS INTEGER) AS comment_chars FROM recs)"""


def _flat(records: DataFrame) -> DataFrame:
    chars = F.length(F.array_join(F.col("comments.body"), ""))
    return records.withColumns({"n_comments": F.size("comments"), "comment_chars": chars}).drop("comments", "_pos")


def _stored_lines(spark: SparkSession, lines: DataFrame, label: str) -> str:
    path = scratch_dir(spark, label)
    lines.write.text(path)
    return path


@query(_RECORD_SQL)
def read_records_query(spark: SparkSession, sf: str) -> DataFrame:
    path = _stored_lines(spark, to_json_lines(tables.document_records(spark, sf)), "records")
    return _flat(read_records(spark, path))


@query(f"""WITH {_SHARED}
SELECT id, title, body, true AS keyword_missing, true AS count_missing,
       CASE WHEN keyword_group = 'fr' THEN 0 ELSE n_comments END AS n_comments, doc_id AS extra FROM recs""")
def conform_query(spark: SparkSession, sf: str) -> DataFrame:
    records = tables.document_records(spark, sf)
    partial_records = records.select(
        "id", "title", "body", F.when(F.col("keyword_group") != "fr", F.col("comments")).alias("comments"), F.col("_pos").alias("extra")
    )
    full = conform(partial_records)
    return full.select(
        "id", "title", "body", F.col("keyword").isNull().alias("keyword_missing"),
        F.col("comment_count").isNull().alias("count_missing"), F.size("comments").alias("n_comments"), "extra",
    )


@query("""SELECT CASE WHEN event_type = 'click' THEN '{"post":{"id":"' || event_id || '"}'
            ELSE '{"post":{"id":"' || event_id || '"}} ' || props END AS raw
FROM events WHERE event_type IN ('click', 'error')""")
def quarantine_query(spark: SparkSession, sf: str) -> DataFrame:
    events = tables.table(spark, sf, "events")
    valid = F.concat(F.lit('{"post":{"id":"'), F.col("event_id").cast("string"), F.lit('"}}'))
    cut = F.concat(F.lit('{"post":{"id":"'), F.col("event_id").cast("string"), F.lit('"}'))
    line = (
        F.when(F.col("event_type") == "click", cut)
        .when(F.col("event_type") == "error", F.concat(valid, F.lit(" "), "props"))
        .when(F.col("event_type") == "view", F.lit("   "))
        .otherwise(valid)
    )
    path = _stored_lines(spark, events.select(line.alias("value")), "lines")
    _, bad = quarantine(parse_lines(read_lines(spark, path)))
    return bad.select("raw")


@query(f"""WITH {_SHARED}
SELECT 'posts' AS tbl, "Study_ID" AS study, "ID" AS id, "Titulo" AS txt, "Upvotes" AS votes FROM (SELECT {_POSTS_COLS} FROM recs)
UNION ALL
SELECT 'comments', NULL, "Post_ID", "Texto_Comentario", "Upvotes_Comentario" FROM (SELECT {_COMMENTS_COLS} FROM {_exploded('recs')})""")
def write_corpus_query(spark: SparkSession, sf: str) -> DataFrame:
    records = funnel.flag_creator(funnel.clean_text(funnel.with_comment_count(tables.document_records(spark, sf))), tables.CREATOR_PATTERNS)
    path = scratch_dir(spark, "corpus")
    write_corpus(funnel.to_posts(records), funnel.to_comments(records, keep_study=True), path)
    posts, comments = read_corpus(spark, path)
    return posts.select(
        F.lit("posts").alias("tbl"), F.col("Study_ID").alias("study"), F.col("ID").alias("id"),
        F.col("Titulo").alias("txt"), F.col("Upvotes").alias("votes"),
    ).unionByName(
        comments.select(
            F.lit("comments").alias("tbl"), F.lit(None).cast("string").alias("study"), F.col("Post_ID").alias("id"),
            F.col("Texto_Comentario").alias("txt"), F.col("Upvotes_Comentario").alias("votes"),
        )
    )


@query("""SELECT part, line, 'bad ' || doc_id AS raw FROM (
  SELECT doc_id, doc_id // 100 AS part, row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) AS line FROM documents)
WHERE doc_id % 5 = 0""")
def rejected_lines_query(spark: SparkSession, sf: str) -> DataFrame:
    doc_id = F.col("doc_id").cast("string")
    record = F.to_json(F.struct(F.struct(doc_id.alias("id"), F.col("source").alias("title")).alias("post")))
    value = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("bad "), doc_id)).when(F.col("doc_id") % 5 == 1, F.lit("  ")).otherwise(record)
    # One file for every hundred ids, in their order.
    filed = tables.table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 100).alias("part"), "doc_id", value.alias("value"))
    folder = scratch_dir(spark, "numbered")
    filed.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "value").write.partitionBy("part").text(folder)
    found = rejected_lines(read_lines(spark, folder))
    return found.select(F.regexp_extract("file", r"part=(\d+)", 1).cast("bigint").alias("part"), "line", "raw")


@query(f"""WITH {_SHARED}
SELECT doc_id, coalesce(id, '') AS id_loose, coalesce(body, '') AS body_loose, nullif(id, '') AS id_strict, nullif(body, '') AS body_strict
FROM recs""")
def normalize_nulls_query(spark: SparkSession, sf: str) -> DataFrame:
    base = tables.document_records(spark, sf).select(F.col("_pos").alias("doc_id"), "id", "body")
    pair = lambda mode, tag: normalize_nulls(base, mode).select("doc_id", F.col("id").alias(f"id_{tag}"), F.col("body").alias(f"body_{tag}"))
    return pair("coalesce", "loose").join(pair("strict", "strict"), "doc_id")


@query(f"""WITH {_EVENTS}
SELECT id, event_id, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts, event_id) AS rn FROM incoming
  WHERE id <> '' AND id NOT IN (SELECT id FROM stored WHERE id <> '')) WHERE rn = 1
UNION ALL SELECT id, event_id, ts FROM incoming WHERE id = ''""")
def append_new_query(spark: SparkSession, sf: str) -> DataFrame:
    stored, incoming = tables.event_sides(spark, sf)
    return append_new(incoming, stored, order=["ts", "event_id"]).select("id", "event_id", "ts")


@query(f"""WITH {_EVENTS}
SELECT 'kept' AS what, id, CASE WHEN id = '' THEN count(*) ELSE 1 END AS n FROM ev GROUP BY id
UNION ALL SELECT 'rejected', 'bad ' || event_id, 1 FROM ev WHERE event_id % 7 = 0""")
def append_new_stream_query(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_dir(spark, "arrivals")
    for side in tables.event_sides(spark, sf):
        record = F.struct(F.struct("id", F.col("event_type").alias("keyword"), F.col("event_id").alias("upvotes")).alias("post"))
        spoilt = side.where("event_id % 7 = 0").select(F.concat(F.lit("bad "), F.col("event_id").cast("string")).alias("value"))
        side.select(F.to_json(record).alias("value")).unionByName(spoilt).write.mode("append").text(f"{root}/in")
        append_new_stream(spark, f"{root}/in", f"{root}/store", f"{root}/checkpoint").awaitTermination()
    kept = read_store(spark, f"{root}/store").select(F.lit("kept").alias("what"), "id")
    bad = read_rejects(spark, rejects_of(f"{root}/store")).select(F.lit("rejected").alias("what"), F.col("raw").alias("id"))
    return kept.unionByName(bad).groupBy("what", "id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_EVENTS}
SELECT id, CASE WHEN id = '' THEN count(*) ELSE 1 END AS n, CASE WHEN id = '' THEN CAST(sum(event_id) AS BIGINT) END AS blank_events
FROM ev GROUP BY id""")
def append_new_state_query(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_dir(spark, "arrivals")
    for side in tables.event_sides(spark, sf):
        record = F.struct(F.struct("id", F.col("event_id").alias("upvotes")).alias("post"))
        side.select(F.to_json(record).alias("value")).write.mode("append").text(f"{root}/in")
        append_new_state(spark, f"{root}/in", f"{root}/store", f"{root}/checkpoint", max_files=2).awaitTermination()
    kept = read_state_store(spark, f"{root}/store")
    # Which of an id's copies comes first is the stream's affair, but every record without an id is there.
    return kept.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("id") == "", F.col("upvotes"))).alias("blank_events"))


@query("""SELECT event_id, 'events_2024' AS study_id, 'Arriving events' AS theme_label FROM events""")
def stamp_study_query(spark: SparkSession, sf: str) -> DataFrame:
    return stamp_study(tables.table(spark, sf, "events").select("event_id"), "events_2024", "Arriving events")


# --- B. collection ----------------------------------------------------------------------------

_KEYWORDS = """kws AS (
  SELECT p_partkey AS study, 0 AS group_ord, p_brand AS keyword_group,
         unnest(range(len(string_split(p_name, ' ')))) AS keyword_ord, unnest(string_split(p_name, ' ')) AS keyword FROM part
  UNION ALL SELECT p_partkey, 1, 'all names', 0, p_name FROM part
  UNION ALL SELECT p_partkey, 1, 'all names', 1, p_brand || ' & co*' FROM part),
subs AS (
  SELECT p_partkey AS study, 0 AS sub_ord, p_type AS subreddit FROM part
  UNION ALL SELECT p_partkey, 1, 'size' || p_size FROM part)"""


@query(f"WITH {_KEYWORDS} SELECT study, group_ord, keyword_group, keyword_ord, keyword FROM kws", ints=("keyword_ord",))
def flatten_keywords_query(spark: SparkSession, sf: str) -> DataFrame:
    return search.flatten_keywords(tables.part_profiles(spark, sf).drop("subreddits"))


@query(f"""WITH {_KEYWORDS}
SELECT study, sub_ord, subreddit, group_ord, keyword_group, keyword_ord, keyword FROM subs JOIN kws USING (study)""", ints=("keyword_ord",))
def search_plan_query(spark: SparkSession, sf: str) -> DataFrame:
    return search.search_plan(tables.part_profiles(spark, sf))


@query(f"""WITH {_KEYWORDS}
SELECT study, sub_ord, group_ord, keyword_ord,
  'https://www.reddit.com/r/' || subreddit || '/search/?q=' ||
  replace(replace(replace(replace(keyword, '#', '%23'), '&', '%26'), '*', '%2A'), ' ', '+') ||
  '&restrict_sr=1&t=month&sort=relevance' AS search_url
FROM subs JOIN kws USING (study)""", ints=("keyword_ord",))
def search_url_query(spark: SparkSession, sf: str) -> DataFrame:
    plan = search.search_url(search.search_plan(tables.part_profiles(spark, sf)), "month")
    return plan.select("study", "sub_ord", "group_ord", "keyword_ord", "search_url")


_VISIBLE = r"""regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g')"""


def _unescaped(text: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{char}')"
    return text


def _inner_text(fragment: str) -> str:
    broken = rf"regexp_replace({fragment}, '(?i)<br\s*/?>|</(p|div|li|h[1-6]|tr)\s*>', ' ', 'g')"
    bare = f"regexp_replace({broken}, '(?s)<[^>]*>', '', 'g')"
    return rf"trim(regexp_replace({_unescaped(bare)}, '[\s\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{3000}}]+', ' ', 'g'))"


@query(rf"""WITH hrefs AS (
  SELECT page_id, url, regexp_extract_all({_VISIBLE}, '(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|''[^'']*'')', 1) AS hs FROM pages),
flat AS (SELECT page_id, url, unnest(range(len(hs))) AS pos, unnest(hs) AS q FROM hrefs),
plain AS (SELECT page_id, url, pos, {_unescaped("substr(q, 2, length(q) - 2)")} AS href FROM flat)
SELECT page_id, url, pos,
  regexp_replace(split_part(CASE WHEN href LIKE '/%' THEN 'https://www.reddit.com' || href ELSE href END, '?', 1), '/+$', '') AS link
FROM plain WHERE contains(href, '/') AND contains(CASE WHEN href LIKE '/%' THEN 'https://www.reddit.com' || href ELSE href END, '/t')""", ints=("pos",))
def extract_links_query(spark: SparkSession, sf: str) -> DataFrame:
    return extract_links(tables.table(spark, sf, "pages"), "t", anchor_contains="/", keep=F.lit("/t"))


@query("""SELECT search_id, link, pos, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY pos, link) AS rank FROM (
    SELECT l_suppkey AS search_id, '/p/' || l_partkey AS link, min(l_orderkey * 10 + l_linenumber) AS pos
    FROM lineitem GROUP BY 1, 2)) WHERE rank <= 40""", ints=("rank",))
def distinct_links_topn_query(spark: SparkSession, sf: str) -> DataFrame:
    links = tables.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("search_id"),
        F.concat(F.lit("/p/"), F.col("l_partkey").cast("string")).alias("link"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
    )
    return search.distinct_links_topn(links, 40)


@query("""SELECT o_orderkey,
  CASE substr(o_orderpriority, 1, 1)
    WHEN '1' THEN CAST(o_orderkey AS VARCHAR) WHEN '2' THEN 'k' || o_custkey WHEN '3' THEN NULL
    WHEN '4' THEN NULL ELSE 'comments' END AS post_id
FROM orders""")
def post_id_query(spark: SparkSession, sf: str) -> DataFrame:
    order, customer = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    kind = F.substring("o_orderpriority", 1, 1)
    url = (
        F.when(kind == "1", F.concat(F.lit("https://h.example/r/a/comments/"), order, F.lit("/x?y=/comments/1")))
        .when(kind == "2", F.concat(F.lit("/r/comments-a/comments/k"), customer, F.lit("#comments/9")))
        .when(kind == "3", F.concat(F.lit("https://comments/"), order))
        .when(kind == "4", F.concat(F.lit("https://h.example/"), customer, F.lit("/comments//")))
        .otherwise(F.concat(F.lit("comments/comments/"), order, F.lit("/"), order))
    )
    return tables.table(spark, sf, "orders").select("o_orderkey", post_id(url).alias("post_id"))


@query("""WITH hits AS (
  SELECT CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS post_id,
         month(o_orderdate) AS sub_ord, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS kw_ord, o_orderkey AS pos
  FROM orders WHERE o_orderstatus <> 'F')
SELECT post_id, sub_ord, kw_ord, pos FROM (
  SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY sub_ord, kw_ord, pos) AS rn FROM hits WHERE post_id <> '') WHERE rn = 1
UNION ALL SELECT post_id, sub_ord, kw_ord, pos FROM hits WHERE post_id = ''""", ints=("sub_ord",))
def attribute_first_search_query(spark: SparkSession, sf: str) -> DataFrame:
    return search.attribute_first_search(tables.order_hits(spark, sf))


@query(rf"""WITH v AS (SELECT page_id, url, {_VISIBLE} AS h FROM pages)
SELECT page_id, url, '' AS id, {_inner_text(r"regexp_extract(h, '(?is)<h1\b[^>]*>(.*?)</h1\s*>', 1)")} AS title, '' AS author,
  {_inner_text(r"regexp_extract(h, '(?is)<article\b[^>]*>.*?<p\b[^>]*>(.*?)(?:</p\s*>|<p\b|</article\s*>)', 1)")} AS body,
  CAST(0 AS BIGINT) AS upvotes, CAST(0 AS BIGINT) AS comment_count, '' AS "timestamp"
FROM v""")
def page_fields_query(spark: SparkSession, sf: str) -> DataFrame:
    layout = PageFields(body=(inside(r"article\b", "p"),))
    return page_fields(tables.spread(tables.table(spark, sf, "pages")), layout)


@query(rf"""WITH v AS (SELECT page_id, {_VISIBLE} AS h FROM pages),
items AS (SELECT page_id, regexp_extract_all(h, '(?is)<li\b[^>]*><a\b[^>]*>(.*?)</a\s*>', 1)[1:4] AS xs FROM v),
flat AS (SELECT page_id, unnest(range(len(xs))) AS spot, unnest(xs) AS x FROM items)
SELECT page_id, spot, {_inner_text('x')} AS author, CAST(0 AS BIGINT) AS upvotes FROM flat WHERE {_inner_text('x')} <> ''""", ints=("spot",))
def page_comments_query(spark: SparkSession, sf: str) -> DataFrame:
    layout = CommentFields(containers=("shreddit-comment\\b", r"li\b"), author=(element(r"a\b"),))
    pages = page_comments(tables.spread(tables.table(spark, sf, "pages")), 4, layout)
    return pages.select("page_id", F.posexplode("comments").alias("spot", "c")).select("page_id", "spot", "c.author", "c.upvotes")


@query("""SELECT 'd' || doc_id AS id, coalesce(source, '') AS subreddit, 'documents' AS study_id,
  CASE WHEN lang = 'en' THEN 'language' ELSE 'source' END AS keyword_group,
  CASE WHEN lang = 'en' THEN 'en' ELSE coalesce(source, '') END AS keyword,
  'Post ' || doc_id || ' & more' AS title, 'u' || doc_id AS author,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE coalesce(lang, '') || 'é’s ' || coalesce(source, '') END AS body,
  CAST(coalesce(n_chars, 0) AS BIGINT) AS upvotes, CAST(doc_id AS BIGINT) AS comment_count, 'at ' || doc_id AS stamp,
  CASE doc_id % 3 WHEN 0 THEN 'Ann' || doc_id || ':' || coalesce(source, '') || ':7' WHEN 1 THEN 'Cy:' || coalesce(lang, '') || '!:1500' ELSE 'Di::0' END AS comments
FROM documents""")
def collect_records_query(spark: SparkSession, sf: str) -> DataFrame:
    profile = StudyProfile("documents", "Documents", ("all",), {"all": ("any",)})
    records = collect_records(tables.document_hits(spark, sf), tables.spread(tables.document_pages(spark, sf)), profile)
    written = F.transform("comments", lambda c: F.concat_ws(":", c["author"], c["body"], c["upvotes"].cast("string")))
    return records.select(
        "id", "subreddit", "study_id", "keyword_group", "keyword", "title", "author", "body", "upvotes", "comment_count",
        F.col("timestamp").alias("stamp"), F.array_join(written, "|").alias("comments"),
    )


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber
    WHEN 1 THEN CAST(trunc(CAST(CAST(q AS VARCHAR) || '.' || l_linenumber AS DOUBLE) * 1000) AS BIGINT)
    WHEN 2 THEN CAST(trunc(CAST(CAST(q AS VARCHAR) || '.35' AS DOUBLE) * 1000000) AS BIGINT)
    WHEN 3 THEN 1000 + q WHEN 4 THEN 0 WHEN 5 THEN -q ELSE q END AS n
FROM (SELECT *, CAST(floor(l_quantity) AS BIGINT) AS q FROM lineitem)""")
def parse_count_query(spark: SparkSession, sf: str) -> DataFrame:
    whole = F.floor("l_quantity").cast("string")
    line = F.col("l_linenumber")
    text = (
        F.when(line == 1, F.concat(whole, F.lit(".1k")))
        .when(line == 2, F.concat(whole, F.lit(".35M ")))
        .when(line == 3, F.concat(F.lit("1,"), F.lpad(whole, 3, "0")))
        .when(line == 4, F.concat(whole, F.lit(" votes")))
        .when(line == 5, F.concat(F.lit(" -"), whole, F.lit(".9")))
        .otherwise(F.concat(whole, F.lit("e0")))
    )
    return tables.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", parse_count(text).alias("n"))


# --- C. cleaning funnel -----------------------------------------------------------------------


def _prepared(spark: SparkSession, sf: str) -> DataFrame:
    return funnel.clean_text(funnel.with_comment_count(tables.document_records(spark, sf)))


def _brief(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(F.col("_pos").alias("doc_id"), "id", *extra)


@query(f"WITH {_SHARED} SELECT doc_id, id, n_comments FROM recs")
def with_comment_count_query(spark: SparkSession, sf: str) -> DataFrame:
    return _brief(funnel.with_comment_count(tables.document_records(spark, sf)), "n_comments")


@query(f"WITH {_SHARED} SELECT doc_id, id, title, coalesce(body, '') AS body FROM recs")
def clean_text_query(spark: SparkSession, sf: str) -> DataFrame:
    return _brief(funnel.clean_text(tables.document_records(spark, sf)), "title", "body")


@query(f"WITH {_SHARED}, {_FIRSTS} SELECT doc_id, id, title FROM firsts")
def dedup_first_query(spark: SparkSession, sf: str) -> DataFrame:
    return _brief(funnel.dedup_first(tables.document_records(spark, sf)), "title")


@query(f"WITH {_SHARED} SELECT doc_id, id, n_comments FROM recs WHERE {_R1}")
def min_comments_query(spark: SparkSession, sf: str) -> DataFrame:
    return _brief(funnel.min_comments(_prepared(spark, sf), 3), "n_comments")


@query(f"WITH {_SHARED} SELECT doc_id, id, {_FLAG} AS is_creator_suspect FROM recs")
def flag_creator_query(spark: SparkSession, sf: str) -> DataFrame:
    return _brief(funnel.flag_creator(_prepared(spark, sf), tables.CREATOR_PATTERNS), "is_creator_suspect")


@query(f"WITH {_SHARED} SELECT doc_id, id FROM recs WHERE {_R3}")
def min_chars_query(spark: SparkSession, sf: str) -> DataFrame:
    return _brief(funnel.min_chars(_prepared(spark, sf), 40))


@query(f"WITH {_SHARED} SELECT doc_id, id FROM recs WHERE {_R4}")
def exclude_terms_query(spark: SparkSession, sf: str) -> DataFrame:
    return _brief(funnel.exclude_terms(_prepared(spark, sf), FILTERS.exclude_terms))


@query(f"WITH {_SHARED} SELECT doc_id, id FROM recs WHERE {_R5}")
def require_any_terms_query(spark: SparkSession, sf: str) -> DataFrame:
    return _brief(funnel.require_any_terms(_prepared(spark, sf), FILTERS.require_any_terms))


_AUDIT_SQL = f"""WITH {_SHARED}, {_FIRSTS},
c AS (
  SELECT (SELECT count(*) FROM recs) AS l, count(*) AS d, count(*) FILTER ({_R1}) AS r1,
         count(*) FILTER ({_R1} AND {_FLAG}) AS fl, count(*) FILTER ({_R1} AND {_R3}) AS r3,
         count(*) FILTER ({_R1} AND {_R3} AND {_R4}) AS r4, count(*) FILTER ({_R1} AND {_R3} AND {_R4} AND {_R5}) AS r5
  FROM firsts)
SELECT 0 AS stage_ord, 'load' AS stage, l AS "rows", 0 AS dropped FROM c
UNION ALL SELECT 1, 'dedup', d, l - d FROM c
UNION ALL SELECT 2, 'min_comments', r1, d - r1 FROM c
UNION ALL SELECT 3, 'creator_flag', fl, 0 FROM c
UNION ALL SELECT 4, 'min_chars', r3, r1 - r3 FROM c
UNION ALL SELECT 5, 'exclude_terms', r4, r3 - r4 FROM c
UNION ALL SELECT 6, 'require_any_terms', r5, r4 - r5 FROM c
UNION ALL SELECT 7, 'output', r5, 0 FROM c"""


@query(_AUDIT_SQL)
def funnel_audit_query(spark: SparkSession, sf: str) -> DataFrame:
    return funnel.funnel_audit(tables.document_records(spark, sf), FILTERS)


@query(f"WITH {_SHARED}, {_FIRSTS}, {_SURVIVORS} SELECT {_POSTS_COLS} FROM survivors")
def to_posts_query(spark: SparkSession, sf: str) -> DataFrame:
    return build_corpus(tables.document_records(spark, sf), FILTERS).posts


@query(f"WITH {_SHARED}, {_FIRSTS}, {_SURVIVORS} SELECT {_COMMENTS_COLS} FROM {_exploded('survivors')}")
def to_comments_query(spark: SparkSession, sf: str) -> DataFrame:
    return build_corpus(tables.document_records(spark, sf), FILTERS).comments


@query(f"""WITH {_SHARED}, {_FIRSTS}, {_SURVIVORS},
p AS (SELECT {_POSTS_COLS} FROM survivors),
c AS (SELECT {_COMMENTS_COLS} FROM {_exploded('survivors')})
SELECT "ID" AS id, "Subreddit" AS subreddit, "Num_Comentarios" AS n_comments, is_creator_suspect, n AS stored_comments, votes
FROM p LEFT JOIN (SELECT "Post_ID", count(*) AS n, CAST(sum("Upvotes_Comentario") AS BIGINT) AS votes FROM c GROUP BY 1)
  ON "Post_ID" IS NOT DISTINCT FROM "ID"
UNION ALL
SELECT 'audit ' || stage_ord, stage, NULL, NULL, rows, dropped FROM ({_AUDIT_SQL})""")
def build_corpus_query(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark, "published")
    stages = publish_corpus(tables.document_records(spark, sf), FILTERS, path)
    posts, comments = read_corpus(spark, path)
    per_post = comments.groupBy("Post_ID").agg(F.count(F.lit(1)).alias("stored_comments"), F.sum("Upvotes_Comentario").alias("votes"))
    joined = posts.join(per_post, F.col("Post_ID").eqNullSafe(F.col("ID")), "left")
    stored = joined.select(
        F.col("ID").alias("id"), F.col("Subreddit").alias("subreddit"), F.col("Num_Comentarios").alias("n_comments"),
        "is_creator_suspect", "stored_comments", "votes",
    )
    counts = stages.select(
        F.concat(F.lit("audit "), "stage_ord").alias("id"), F.col("stage").alias("subreddit"), F.lit(None).cast("int").alias("n_comments"),
        F.lit(None).cast("boolean").alias("is_creator_suspect"), F.col("rows").alias("stored_comments"), F.col("dropped").alias("votes"),
    )
    return stored.unionByName(counts)


# --- D. report --------------------------------------------------------------------------------


@query(f"{_CORPUS} SELECT 'posts' AS metric, count(*) AS n FROM posts UNION ALL SELECT 'comments', count(*) FROM comments")
def corpus_totals_query(spark: SparkSession, sf: str) -> DataFrame:
    return report.corpus_totals(*tables.document_corpus(spark, sf))


_BAR = "repeat('█', least(CAST(floor(n / (SELECT max(n) FROM g) * 20) AS BIGINT), 20))"


@query(f"""WITH {_ORDERS}, g AS (SELECT "Subreddit" AS name, count(*) AS n FROM orders_posts GROUP BY 1)
SELECT name, n, {_BAR} AS bar FROM g""")
def distribution_query(spark: SparkSession, sf: str) -> DataFrame:
    return report.distribution(tables.order_posts(spark, sf), "Subreddit")


@query(f"""WITH {_ORDERS} SELECT count(*) FILTER (is_creator_suspect) AS creators,
  round(count(*) FILTER (is_creator_suspect) / count(*) * 100, 6) AS pct,
  count(*) FILTER (NOT is_creator_suspect) AS others FROM orders_posts""")
def creator_share_query(spark: SparkSession, sf: str) -> DataFrame:
    return report.creator_share(tables.order_posts(spark, sf)).withColumn("pct", F.round("pct", 6))


@query(f"{_CORPUS} {_term_rows('loose', TERMS, 'lower(txt)')}")
def term_counts_query(spark: SparkSession, sf: str) -> DataFrame:
    return report.term_counts(*tables.document_corpus(spark, sf), TERMS)


@query(f"""{_CORPUS}, t AS ({_term_rows('loose', TERMS, 'lower(txt)')})
SELECT rank, term, n FROM (SELECT row_number() OVER (ORDER BY n DESC, term_ord) AS rank, term, n FROM t) WHERE rank <= 8""", ints=("rank",))
def top_terms_query(spark: SparkSession, sf: str) -> DataFrame:
    return report.top_terms(*tables.document_corpus(spark, sf), TERMS, 8)


def _match_sql(pattern: str) -> str:
    return f"""{_CORPUS} SELECT count(*) FILTER (origin = 'posts') AS posts, count(*) FILTER (origin = 'comments') AS comments
FROM loose WHERE regexp_matches(txt, '{pattern}', 'i')"""


@query(_match_sql(TACTICS))
def match_tactics_query(spark: SparkSession, sf: str) -> DataFrame:
    return report.match_tactics(*tables.document_corpus(spark, sf), TACTICS)


@query(_match_sql(THEORIES))
def match_theories_query(spark: SparkSession, sf: str) -> DataFrame:
    return report.match_theories(*tables.document_corpus(spark, sf), THEORIES)


_TOP = """SELECT row_number() OVER (ORDER BY "Num_Comentarios" DESC, "ID") AS rank, "ID" AS id, "Subreddit" AS community,
  is_creator_suspect AS creator, substr("Titulo", 1, 100) AS title, "Num_Comentarios" AS comments, "Upvotes" AS upvotes, "URL" AS url"""


@query(f"WITH {_ORDERS} SELECT * FROM ({_TOP} FROM orders_posts) WHERE rank <= 25", ints=("rank",))
def top_discussions_query(spark: SparkSession, sf: str) -> DataFrame:
    return report.top_discussions(tables.order_posts(spark, sf), 25)


@query(f"""{_CORPUS},
t AS ({_term_rows('loose', TERMS, 'lower(txt)')}),
g AS (SELECT "Subreddit" AS name, count(*) AS n, count(*) FILTER (is_creator_suspect) AS c FROM posts GROUP BY 1),
top AS (SELECT * FROM ({_TOP} FROM posts) WHERE rank <= 5)
SELECT '1a totals' AS section, 1 AS ord, 'posts' AS key, CAST(count(*) AS VARCHAR) AS value FROM posts
UNION ALL SELECT '1a totals', 2, 'comments', CAST(count(*) AS VARCHAR) FROM comments
UNION ALL SELECT '1b communities', row_number() OVER (ORDER BY n DESC, name), name, CAST(n AS VARCHAR) FROM g
UNION ALL SELECT '1c bars', row_number() OVER (ORDER BY n DESC, name), name, {_BAR} FROM g
UNION ALL SELECT '2 creators', 1, 'creators', CAST(sum(c) AS VARCHAR) FROM g
UNION ALL SELECT '2 creators', 2, 'percent', CAST(round_even(sum(c) / sum(n) * 100, 1) AS VARCHAR) FROM g
UNION ALL SELECT '2 creators', 3, 'others', CAST(sum(n) - sum(c) AS VARCHAR) FROM g
UNION ALL SELECT '3 vocabulary', rank, term, CAST(n AS VARCHAR) FROM (
  SELECT row_number() OVER (ORDER BY n DESC, term_ord) AS rank, term, n FROM t) WHERE rank <= 8
UNION ALL SELECT '4 matches', 1, 'tactics posts', CAST(count(*) AS VARCHAR) FROM loose WHERE origin = 'posts' AND regexp_matches(txt, '{TACTICS}', 'i')
UNION ALL SELECT '4 matches', 2, 'tactics comments', CAST(count(*) AS VARCHAR) FROM loose WHERE origin = 'comments' AND regexp_matches(txt, '{TACTICS}', 'i')
UNION ALL SELECT '4 matches', 3, 'theories posts', CAST(count(*) AS VARCHAR) FROM loose WHERE origin = 'posts' AND regexp_matches(txt, '{THEORIES}', 'i')
UNION ALL SELECT '4 matches', 4, 'theories comments', CAST(count(*) AS VARCHAR) FROM loose WHERE origin = 'comments' AND regexp_matches(txt, '{THEORIES}', 'i')
UNION ALL SELECT '5 discussions', rank, 'id', id FROM top
UNION ALL SELECT '5 discussions', rank, 'community', community FROM top
UNION ALL SELECT '5 discussions', rank, 'creator', CAST(creator AS VARCHAR) FROM top
UNION ALL SELECT '5 discussions', rank, 'title', title FROM top
UNION ALL SELECT '5 discussions', rank, 'comments', CAST(comments AS VARCHAR) FROM top
UNION ALL SELECT '5 discussions', rank, 'upvotes', CAST(upvotes AS VARCHAR) FROM top
UNION ALL SELECT '5 discussions', rank, 'url', url FROM top""", ints=("ord",))
def report_table_query(spark: SparkSession, sf: str) -> DataFrame:
    analysis = Analysis(vocabulary_terms=TERMS, tactics_pattern=TACTICS, theories_pattern=THEORIES)
    return report_table(*tables.document_corpus(spark, sf), analysis, top_terms=8)


# --- E. exploration ---------------------------------------------------------------------------


@query(f"""{_CORPUS} SELECT count(*) AS posts, (SELECT count(*) FROM comments) AS comments,
  round(avg("Num_Comentarios"), 6) AS mean_comments, round(avg(CAST(is_creator_suspect AS INTEGER)) * 100, 6) AS pct_creators FROM posts""")
def corpus_summary_query(spark: SparkSession, sf: str) -> DataFrame:
    summary = numeric.corpus_summary(*tables.document_corpus(spark, sf))
    return summary.withColumns({c: F.round(c, 6) for c in ("mean_comments", "pct_creators")})


@query(f"""{_CORPUS} SELECT "Subreddit" AS name, count(*) AS n FROM posts GROUP BY 1""")
def group_counts_ordered_query(spark: SparkSession, sf: str) -> DataFrame:
    return report.group_counts(tables.document_corpus(spark, sf)[0], "Subreddit")


def _box_sql(source: str, col: str) -> str:
    return f"""q AS (SELECT quantile_cont({col}, 0.25) AS q1, quantile_cont({col}, 0.5) AS med, quantile_cont({col}, 0.75) AS q3 FROM {source}),
x AS (SELECT CAST({col} AS DOUBLE) AS v, q1, med, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM {source}, q)
SELECT count(*) AS n, min(q1) AS q1, min(med) AS median, min(q3) AS q3, min(v) FILTER (v >= lo) AS whisker_low,
  max(v) FILTER (v <= hi) AS whisker_high, count(*) FILTER (v < lo OR v > hi) AS outliers FROM x"""


@query(f"{_CORPUS}, {_box_sql('posts', chr(34) + 'Num_Comentarios' + chr(34))}")
def boxplot_stats_query(spark: SparkSession, sf: str) -> DataFrame:
    return numeric.boxplot_stats(tables.document_corpus(spark, sf)[0], "Num_Comentarios")


@query(f"""{_CORPUS}, q AS (SELECT quantile_cont("Num_Comentarios", 0.25) AS q1, quantile_cont("Num_Comentarios", 0.75) AS q3 FROM posts)
SELECT "ID" AS id, "Num_Comentarios" AS n_comments FROM posts, q
WHERE "Num_Comentarios" < q1 - 1.5 * (q3 - q1) OR "Num_Comentarios" > q3 + 1.5 * (q3 - q1)""")
def boxplot_outliers_query(spark: SparkSession, sf: str) -> DataFrame:
    rows = numeric.boxplot_outliers(tables.document_corpus(spark, sf)[0], "Num_Comentarios")
    return rows.select(F.col("ID").alias("id"), F.col("Num_Comentarios").alias("n_comments"))


_ACTIONS = ("the", "and", "und", "que", "tested", "of the")


@query(f"{_CORPUS} " + " UNION ALL ".join(
    f"SELECT {i} AS term_ord, '{t}' AS term, '{o}' AS origin, CAST(coalesce(sum({_occurrences('txt', t)}), 0) AS BIGINT) AS n FROM strict WHERE origin = '{o}'"
    for i, t in enumerate(_ACTIONS) for o in ("posts", "comments")))
def keyword_by_origin_query(spark: SparkSession, sf: str) -> DataFrame:
    return explore.keyword_by_origin(*tables.document_corpus(spark, sf), _ACTIONS)


@query(f"{_CORPUS}, t AS ({_term_rows('strict', _ACTIONS, 'txt')}) SELECT term, n FROM t")
def native_vocabulary_query(spark: SparkSession, sf: str) -> DataFrame:
    return explore.native_vocabulary(*tables.document_corpus(spark, sf), _ACTIONS)


_PAIRS_SQL = f"""{_CORPUS},
terms AS (SELECT unnest([{", ".join(repr(t) for t in _ACTANT_TERMS)}]) AS term),
hits AS (SELECT s.rowid_ AS r, term FROM (SELECT row_number() OVER () AS rowid_, txt FROM strict) s JOIN terms ON contains(txt, term)),
pairs AS (SELECT a.term AS u, b.term AS v, count(*) AS weight FROM hits a JOIN hits b ON a.r = b.r AND a.term < b.term GROUP BY 1, 2)"""


@query(f"{_PAIRS_SQL} SELECT u, v, weight FROM pairs")
def cooccurrence_query(spark: SparkSession, sf: str) -> DataFrame:
    texts = corpus_texts(*tables.document_corpus(spark, sf))
    return graph.cooccurrence(texts, _ACTANT_TERMS)


_CATEGORY_SQL = "CASE " + " ".join(
    f"WHEN term IN ({', '.join(repr(t) for t in members)}) THEN '{name}'" for name, members in ACTANTS.items()
) + " END"


@query(f"{_PAIRS_SQL} SELECT u, v, weight, CAST(weight * 0.5 AS DOUBLE) AS width FROM pairs WHERE weight > 5")
def cooccurrence_graph_query(spark: SparkSession, sf: str) -> DataFrame:
    return graph.cooccurrence_graph(cooccurrence_query(spark, sf), ACTANTS, min_weight=5)[1]


@query(f"""{_PAIRS_SQL} SELECT DISTINCT term, {_CATEGORY_SQL} AS category
FROM (SELECT u AS term, weight FROM pairs UNION ALL SELECT v, weight FROM pairs) WHERE weight > 5""")
def cooccurrence_vertices_query(spark: SparkSession, sf: str) -> DataFrame:
    return graph.cooccurrence_graph(cooccurrence_query(spark, sf), ACTANTS, min_weight=5)[0]


@query(f"{_CORPUS}, t AS (" + " UNION ALL ".join(
    f"SELECT '{p}' AS term, CAST(sum(len(regexp_extract_all(txt, '{p}'))) AS BIGINT) AS n FROM strict" for p in LEXICON
) + ") SELECT term, n FROM t WHERE n > 0")
def lexicon_counts_query(spark: SparkSession, sf: str) -> DataFrame:
    return explore.lexicon_counts(*tables.document_corpus(spark, sf), LEXICON)


@query(f"""WITH {_ORDERS} SELECT round(avg("Upvotes"), 4) AS mean, median("Upvotes") AS median,
  round(stddev_samp("Upvotes"), 4) AS std, round(var_samp("Upvotes") / 1000000, 4) AS variance_m FROM orders_posts""")
def describe_engagement_query(spark: SparkSession, sf: str) -> DataFrame:
    stats = numeric.describe_engagement(tables.order_posts(spark, sf), "Upvotes")
    return stats.select(
        F.round("mean", 4).alias("mean"), "median", F.round("std", 4).alias("std"),
        F.round(F.col("variance") / 1_000_000, 4).alias("variance_m"),
    )


@query(f"""WITH {_ORDERS}, s AS (SELECT min("Upvotes") AS lo, max("Upvotes") AS hi FROM orders_posts),
b AS (SELECT range AS bin, lo + range * ((hi - lo) / 10) AS a, CASE WHEN range = 9 THEN hi ELSE lo + (range + 1) * ((hi - lo) / 10) END AS z, hi FROM range(10), s)
SELECT bin, round(a, 6) AS left_edge, round(z, 6) AS right_edge,
  (SELECT count(*) FROM orders_posts WHERE "Upvotes" >= a AND ("Upvotes" < z OR (bin = 9 AND "Upvotes" = hi))) AS n FROM b""", ints=("bin",))
def histogram_query(spark: SparkSession, sf: str) -> DataFrame:
    bins = numeric.histogram(tables.order_posts(spark, sf), "Upvotes", 10)
    return bins.withColumns({c: F.round(c, 6) for c in ("left_edge", "right_edge")})


@query(f"""{_CORPUS}, vc AS (SELECT CAST("Num_Comentarios" AS DOUBLE) AS v, count(*) AS k FROM posts GROUP BY 1),
s AS (SELECT count(*) AS n, min("Num_Comentarios") AS lo, max("Num_Comentarios") AS hi,
        stddev_samp("Num_Comentarios") * pow(count(*), -0.2) AS h FROM posts)
SELECT range AS point, round(lo + range * (hi - lo) / 199, 6) AS x,
  round(sum(k * exp(-0.5 * pow((lo + range * (hi - lo) / 199 - v) / h, 2))) / max(n * h * sqrt(2 * pi())), 9) AS density
FROM range(200), vc, s GROUP BY range, lo, hi""", ints=("point",))
def density_curve_query(spark: SparkSession, sf: str) -> DataFrame:
    curve = numeric.density_curve(tables.document_corpus(spark, sf)[0], "Num_Comentarios")
    return curve.select("point", F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))


@query(f"{_CORPUS} SELECT origin, id, txt AS text FROM strict")
def corpus_texts_query(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_texts(*tables.document_corpus(spark, sf), "strict")


def _named(entries: dict) -> dict:
    return {name.removesuffix("_query"): value for name, value in entries.items()}


def queries() -> dict[str, Query]:
    return _named(QUERIES)


def oracle_sql() -> dict[str, str]:
    return _named(SQL)
