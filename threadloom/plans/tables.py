"""Discussion-shaped views of the benchmark tables.

``documents`` give nested records (first line = title, second = body, further lines = comments),
``orders`` with ``lineitem`` give flat posts with comment counts, ``events`` give arriving records.
Nothing is grouped into arrays: nesting always comes from within one source row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.funnel import clean_text, flag_creator, to_comments, to_posts, with_comment_count
from threadloom.schema import COMMENTS_TYPE, POSITION

CREATOR_PATTERNS = ("tion and", "license", r"que de\w* le", "und")
STORED_BEFORE = "2024-01-16"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Redistribute a table whose files give fewer scan tasks than there are cores.

    Text work is heavy per row, and a small table in one row group would occupy a single core. A
    table with enough splits, as any large one has, is left alone and not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def document_records(spark: SparkSession, sf_dir: str, unique: bool = False) -> DataFrame:
    """Records with repeated, null and empty ids, or with one id per document."""
    docs = spread(table(spark, sf_dir, "documents")).withColumn("_lines", F.split("text", "\n"))
    lines = F.col("_lines")
    shared = (
        F.when(F.col("lang") == "es", F.lit(None))
        .when(F.col("source") == "src3", F.lit(""))
        .otherwise(F.concat("lang", F.lit("-"), "n_chars"))
    )
    doc_id = F.col("doc_id").cast("string")
    comment = lambda line: F.struct(
        F.col("lang").alias("author"), line.alias("body"), F.length(line).cast("bigint").alias("upvotes")
    )
    return docs.select(
        (doc_id if unique else shared).alias("id"),
        F.col("source").alias("subreddit"),
        F.col("lang").alias("keyword_group"),
        F.concat("lang", F.lit(" text")).alias("keyword"),
        F.concat(F.lit("study_"), "lang").alias("study_id"),
        F.lit("Documents").alias("theme_label"),
        F.concat(F.lit("https://forum.example/r/"), "source", F.lit("/comments/"), doc_id, F.lit("/x")).alias("url"),
        F.get(lines, F.lit(0)).alias("title"),
        F.concat(F.lit("u"), doc_id).alias("author"),
        F.get(lines, F.lit(1)).alias("body"),
        F.col("n_chars").alias("upvotes"),
        F.size(lines).cast("bigint").alias("comment_count"),
        doc_id.alias("timestamp"),
        F.transform(F.slice(lines, 3, F.size(lines)), comment).cast(COMMENTS_TYPE).alias("comments"),
        F.col("doc_id").alias(POSITION),
    )


def document_corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Posts and comments of every document."""
    records = document_records(spark, sf_dir, unique=True)
    return to_posts(flag_creator(clean_text(with_comment_count(records)), CREATOR_PATTERNS)), to_comments(records)


def order_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as posts, their line items as the comment count."""
    counts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    orders = table(spark, sf_dir, "orders").join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return orders.select(
        F.col("o_orderkey").cast("string").alias("ID"),
        F.col("o_orderpriority").alias("Subreddit"),
        F.concat(F.lit("Order of "), F.col("o_custkey").cast("string"), F.lit(" "), "o_orderpriority").alias("Titulo"),
        F.floor("o_totalprice").alias("Upvotes"),
        F.coalesce("n", F.lit(0)).cast("int").alias("Num_Comentarios"),
        F.concat(F.lit("https://forum.example/o/"), F.col("o_orderkey").cast("string")).alias("URL"),
        (F.col("o_orderstatus") == "F").alias("is_creator_suspect"),
    )


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as arriving records; errors come without an id."""
    events = table(spark, sf_dir, "events")
    key = F.concat_ws("-", F.col("user_id").cast("string"), F.pmod("event_id", F.lit(100)).cast("string"))
    return events.select(
        F.when(F.col("event_type") == "error", F.lit("")).otherwise(key).alias("id"),
        "event_id", "ts", "event_type", "props",
    )


def event_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Already stored events and incoming ones."""
    events = event_records(spark, sf_dir)
    cut = F.lit(STORED_BEFORE).cast("timestamp_ntz")
    return events.where(F.col("ts") < cut), events.where(F.col("ts") >= cut)


def part_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a tiny study: words of its type and size as communities, of its name as keywords."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("study"),
        F.array(F.col("p_type"), F.concat(F.lit("size"), F.col("p_size").cast("string"))).alias("subreddits"),
        F.create_map(
            F.col("p_brand"), F.split("p_name", " "), F.lit("all names"), F.array(F.col("p_name"), F.concat("p_brand", F.lit(" & co*")))
        ).alias("keyword_groups"),
    )


def order_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as search hits: customers are the posts, some without an id, some not extracted."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("")).otherwise(F.col("o_custkey").cast("string")).alias("post_id"),
        F.month("o_orderdate").alias("sub_ord"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("kw_ord"),
        F.col("o_orderkey").alias("pos"),
        (F.col("o_orderstatus") != "F").alias("extracted"),
    )


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A captured page per document: nested and empty elements, entities, unquoted attributes, each comment layout in turn."""
    doc, lang, source = F.col("doc_id").cast("string"), F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))
    layout = F.pmod("doc_id", F.lit(3))

    def markup(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(part) if isinstance(part, str) else part for part in parts])

    body = markup('<div data-testid="post-rtjson-content"><div><p>', lang, "&eacute;&#8217;s</p></div><p>", source, "</p></div>")
    comments = (
        F.when(layout == 0, markup(
            '<shreddit-comment><a href="/user/a">Ann', doc, '</a><div slot="comment"><p>', source, "</p></div><faceplate-number>7</faceplate-number>",
            "</shreddit-comment><shreddit-comment></shreddit-comment>",
        ))
        .when(layout == 1, markup('<div class="Comment top"><a href="/user/c">Cy</a><div class="md"><div><p>', lang, '!</p></div></div><b class="score">1.5k</b></div>'))
        .otherwise(F.lit('<div data-testid="comment"><a href="/user/d">Di</a></div>'))
    )
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("page_id"),
        markup("https://forum.example/r/", source, "/comments/d", doc, "/x").alias("url"),
        markup(
            "<html><body><h1>Post ", doc, " &amp; more</h1><a href=\"/user/u", doc, "/\">who</a>",
            F.when(layout == 0, F.lit('<div slot="text-body"></div>')).otherwise(body),
            '<faceplate-number pretty="">', F.coalesce(F.col("n_chars").cast("string"), F.lit("0")), "</faceplate-number>",
            "<span data-testid=comment-count>", doc, "</span><time datetime=\"at ", doc, "\">then</time>", comments, "<p>footer</p></body></html>",
        ).alias("html"),
    )


def document_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches that find the pages: every one by its source, English ones earlier too, and before all a link that was not captured."""
    known = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), "lang", F.coalesce("source", F.lit("")).alias("source"))

    def hit(group: str, keyword: Column, sub_ord: int, link: Column) -> Column:
        return F.struct(F.lit(group).alias("keyword_group"), keyword.alias("keyword"), F.lit(sub_ord).alias("sub_ord"), F.lit(0).alias("kw_ord"), link.alias("link"))

    url = F.concat(F.lit("https://forum.example/r/"), "source", F.lit("/comments/d"), F.col("pos").cast("string"), F.lit("/x"))
    every = F.array(hit("lost", F.col("source"), 0, F.concat(url, F.lit("/other"))), hit("source", F.col("source"), 2, url))
    english = F.array(hit("language", F.col("lang"), 1, url))
    return known.select(F.col("source").alias("subreddit"), "pos", F.inline(F.when(F.col("lang") == "en", F.concat(every, english)).otherwise(every)))
