"""Column contracts shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

# Field names of a raw post record.
RAW_POST_TYPES = {
    "id": T.StringType(),
    "subreddit": T.StringType(),
    "keyword_group": T.StringType(),
    "keyword": T.StringType(),
    "study_id": T.StringType(),
    "theme_label": T.StringType(),
    "url": T.StringType(),
    "title": T.StringType(),
    "author": T.StringType(),
    "body": T.StringType(),
    "upvotes": T.LongType(),
    "comment_count": T.LongType(),
    "timestamp": T.StringType(),
}

COMMENT_TYPE = T.StructType(
    [
        T.StructField("author", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("upvotes", T.LongType()),
    ]
)
COMMENTS_TYPE = T.ArrayType(COMMENT_TYPE)

RECORD_SCHEMA = T.StructType(
    [T.StructField(name, dtype) for name, dtype in RAW_POST_TYPES.items()]
    + [T.StructField("comments", COMMENTS_TYPE)]
)

# Every reader in this package orders records by this column; "first" means lowest.
POSITION = "_pos"
COMMENT_COUNT = "n_comments"

# Published column names of the posts table and the record field behind each.
POSTS_COLUMNS = {
    "ID": "id",
    "Subreddit": "subreddit",
    "Keyword": "keyword",
    "Titulo": "title",
    "Autor": "author",
    "Texto": "body",
    "Upvotes": "upvotes",
    "Num_Comentarios": COMMENT_COUNT,
    "Data": "timestamp",
    "URL": "url",
    "is_creator_suspect": "is_creator_suspect",
    "Study_ID": "study_id",
    "Theme": "theme_label",
}

# Published column names of the comments table.
COMMENTS_COLUMNS = ["Post_ID", "Autor_Comentario", "Texto_Comentario", "Upvotes_Comentario"]
