import json
import random

import pytest
from pyspark.sql import functions as F

from threadloom.params import Filters
from threadloom.plans.corpus import build_corpus, publish_corpus
from threadloom.schema import POSTS_COLUMNS
from threadloom.session import files, put_file
from threadloom.sources.corpus import append_new, drop_old_versions, read_corpus, write_corpus
from threadloom.sources.records import conform, parse_lines, quarantine, read_lines, read_records, rejected_lines, stamp_study, to_json_lines

LINES = [
    '{"post":{"id":"a","title":"T","body":null,"upvotes":3},"comments":[{"author":"x","body":"y","upvotes":2}]}',
    "",
    "   \t",
    '{"post":{"id":"b"',
    "[1,2]",
    "null",
    '{"comments":[]}',
    '{"post":{"id":"c"}}',
    '{"post":{"id":"d"},"comments":"none"}',
    '{"post":{"id":"e"},"comments":{"k":1}}',
    '{"post":{"id":"f"},"comments":[{"author":"x","upvotes":1},5,null,{}]}',
    '{"post":{"id":7,"upvotes":"12"},"comments":[{"body":"z"}]}',
    '{"post":{"id":"g","upvotes":1.9}}',
    '{"post":{"id":"h"}} trailing',
    '{"post":{"id":"i"}}{"post":{"id":"j"}}',
    '{"post":{"id":"k"}},{"post":{"id":"l"}}',
    '{"post":{"id":"m"}}]',
    "{'post':{'id':'n'}}",
    '{"post":{"id":"o","extra":{"deep":[1]}},"more":true}',
    '  {"post":{"id":"p"}}  ',
]
BAD = {3, 4, 5, 13, 14, 15, 16, 17}
BLANK = {1, 2}


def python_accepts(line):
    try:
        return isinstance(json.loads(line), dict)
    except json.JSONDecodeError:
        return False


def written(tmp_path, *files):
    for i, lines in enumerate(files):
        (tmp_path / f"part-{i}.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(tmp_path)


def test_fixture_agrees_with_the_json_library():
    assert {i for i, line in enumerate(LINES) if line.strip() and not python_accepts(line)} == BAD


def test_good_and_bad_lines(spark, tmp_path):
    good, bad = quarantine(parse_lines(read_lines(spark, written(tmp_path, LINES))))
    assert [r.raw for r in bad.orderBy("_pos").collect()] == [LINES[i] for i in sorted(BAD)]
    rows = {r.id: r for r in good.collect()}
    assert set(rows) == {"a", None, "c", "d", "e", "f", "7", "g", "o", "p"}
    assert rows["a"].comments[0].asDict() == {"author": "x", "body": "y", "upvotes": 2}
    assert (rows["a"].upvotes, rows["7"].upvotes, rows["g"].upvotes) == (3, 12, 1)
    assert [len(rows[k].comments) for k in ("c", "d", "e")] == [0, 0, 0]
    comments = rows["f"].comments
    assert [c is None for c in comments] == [False, True, True, False]
    assert comments[3].author is None


def test_file_order_decides_the_first_copy(spark, tmp_path):
    first = ['{"post":{"id":"x","title":"one"}}', '{"post":{"id":"x","title":"two"}}']
    second = ['{"post":{"id":"x","title":"three"}}', '{"post":{"id":"y","title":"four"}}']
    records = read_records(spark, written(tmp_path, first, second))
    assert [r.title for r in records.orderBy("_pos").collect()] == ["one", "two", "three", "four"]
    kept = build_corpus(records, Filters(min_comments=0, min_chars=0)).posts
    assert sorted((r.ID, r.Titulo) for r in kept.collect()) == [("x", "one"), ("y", "four")]


def test_json_lines_round_trip(spark, tmp_path):
    records = read_records(spark, written(tmp_path, LINES))
    out = str(tmp_path / "again")
    to_json_lines(records).write.text(out)
    again = read_records(spark, out).drop("_pos")
    as_rows = lambda df: sorted(map(str, df.collect()))
    assert as_rows(again) == as_rows(records.drop("_pos"))


def test_conform_adds_what_is_missing(spark):
    df = spark.createDataFrame([("a", "not a list", 1)], "id string, comments string, extra int")
    row = conform(df).first()
    assert row.comments == [] and row.extra == 1 and row.title is None and row.upvotes is None
    assert conform(spark.createDataFrame([("a",)], "id string")).first().comments == []


def test_stamp_study_checks_the_identifier(spark):
    df = spark.range(1)
    assert stamp_study(df, "s_1", "Theme").first().theme_label == "Theme"
    try:
        stamp_study(df, "no spaces", "Theme")
    except ValueError:
        return
    raise AssertionError("an invalid study id was accepted")


def test_append_new_keeps_blank_ids_and_adds_nothing_twice(spark):
    schema = "id string, at int"
    stored = spark.createDataFrame([("a", 0), ("", 0), (None, 0), ("a", 1)], schema)
    incoming = spark.createDataFrame([("a", 2), ("b", 4), ("b", 3), ("", 5), ("", 6), (None, 7), ("c", 8)], schema)
    want = [("", 5), ("", 6), ("b", 3), ("c", 8), (None, 7)]
    for small in (False, True):
        fresh = append_new(incoming, stored, order="at", small_incoming=small)
        assert sorted(map(tuple, fresh.collect()), key=str) == sorted(want, key=str)
        again = append_new(incoming, stored.unionByName(fresh), order="at", small_incoming=small)
        assert {r.id for r in again.collect()} <= {"", None}


def test_append_new_keeps_blank_ids_with_equal_or_no_order(spark):
    schema = "id string, at int"
    rows = [("", 5), (None, 5), ("", 5), (None, None), ("", None), ("b", 5)]
    incoming = spark.createDataFrame(rows, schema).repartition(3)
    for small in (False, True):
        fresh = append_new(incoming, incoming.limit(0), order="at", small_incoming=small)
        assert sorted(map(tuple, fresh.collect()), key=str) == sorted(rows, key=str)


def test_publish_then_read_one_study(spark, tmp_path):
    comment = [("u", "text", 1)] * 3
    rows = [("1", "study_a", "t", "b", comment, 0), ("2", "007", "t", "b", comment, 1), ("2", "007", "late", "b", comment, 2)]
    records = spark.createDataFrame(rows, "id string, study_id string, title string, body string, comments array<struct<author:string,body:string,upvotes:bigint>>, _pos int")
    path = str(tmp_path / "corpus")
    audit = publish_corpus(records, Filters(min_chars=0), path)
    posts, comments = read_corpus(spark, path, "007")
    assert [(r.ID, r.Titulo, r.Study_ID) for r in posts.collect()] == [("2", "t", "007")]
    assert comments.count() == 3
    assert {r.stage: r.rows for r in audit.collect()}["load"] == 3
    every, _ = read_corpus(spark, path)
    assert every.count() == 2


@pytest.mark.parametrize("study", ["007", "1e5", "2026"])
def test_a_store_of_one_study_whose_id_reads_as_a_number(spark, tmp_path, study):
    schema = "id string, study_id string, title string, body string, comments array<struct<author:string,body:string,upvotes:bigint>>, _pos int"
    records = spark.createDataFrame([("1", study, "t", "b", [("u", "text", 1)] * 3, 0)], schema)
    path = str(tmp_path / "corpus")
    publish_corpus(records, Filters(min_chars=0), path)
    posts, comments = read_corpus(spark, path, study)
    assert [r.Study_ID for r in posts.collect()] == [study] and comments.count() == 3
    assert read_corpus(spark, path, "other")[0].count() == 0


def test_rejected_lines_have_their_number_in_the_file(spark, tmp_path):
    rng = random.Random(8)
    good = json.dumps({"post": {"id": "a"}, "comments": []})
    want = []
    for name in ("a.jsonl", "b.jsonl", "none.jsonl"):
        rows = [rng.choice([good, "", "   ", f"bad {rng.randrange(10**6)}", "[1]", good + " x" * rng.randrange(40)]) for _ in range(300)]
        rows = rows if name != "none.jsonl" else [good] * 20
        (tmp_path / name).write_text("\n".join(rows) + ("\n" if name == "a.jsonl" else ""), encoding="utf-8")
        want += [(name, n, row) for n, row in enumerate(rows, start=1) if row.strip() and row != good]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        lines = read_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 10
        got = [(r.file.rsplit("/", 1)[1], r.line, r.raw) for r in rejected_lines(lines).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert sorted(got) == sorted(want)


def corpus_of(spark, *ids):
    posts = spark.createDataFrame([tuple(i if c == "ID" else "s" if c == "Study_ID" else None for c in POSTS_COLUMNS) for i in ids], POSTS_TYPE)
    return posts, spark.createDataFrame([(i, "a", f"of {i}", 1, "s") for i in ids], "Post_ID string, Autor_Comentario string, Texto_Comentario string, Upvotes_Comentario long, Study_ID string")


POSTS_TYPE = ", ".join(f"`{c}` string" for c in POSTS_COLUMNS)


def stored(spark, path):
    posts, comments = read_corpus(spark, path)
    return sorted(r.ID for r in posts.collect()), sorted(r.Post_ID for r in comments.collect())


def test_a_job_lost_between_the_tables_leaves_the_old_corpus(spark, tmp_path):
    path = str(tmp_path / "corpus")
    write_corpus(*corpus_of(spark, "a", "b"), path)
    posts, comments = corpus_of(spark, "c")
    broken = comments.withColumn("Autor_Comentario", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        write_corpus(posts, broken, path, mode="overwrite")
    assert stored(spark, path) == (["a", "b"], ["a", "b"])
    assert drop_old_versions(spark, path) == 2
    write_corpus(posts, comments, path, mode="append")
    assert stored(spark, path) == (["a", "b", "c"], ["a", "b", "c"])
    write_corpus(posts, comments, path, mode="overwrite")
    assert stored(spark, path) == (["c"], ["c"])
    assert drop_old_versions(spark, path) == 4 and stored(spark, path) == (["c"], ["c"])
    with pytest.raises(FileExistsError):
        write_corpus(posts, comments, path)


def test_two_writers_cannot_make_the_same_commit(spark, tmp_path):
    put_file(spark, str(tmp_path / "f" / "1"), "one")
    with pytest.raises(FileExistsError):
        put_file(spark, str(tmp_path / "f" / "1"), "two")
    assert (tmp_path / "f" / "1").read_text() == "one" and files(spark, str(tmp_path / "f")) == ["1"]


def test_tables_without_commits_are_read(spark, tmp_path):
    posts, comments = corpus_of(spark, "a")
    posts.write.partitionBy("Study_ID").parquet(str(tmp_path / "posts"))
    comments.write.partitionBy("Study_ID").parquet(str(tmp_path / "comments"))
    assert stored(spark, str(tmp_path)) == (["a"], ["a"])
