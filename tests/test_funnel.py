from collections import OrderedDict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from threadloom.operators import funnel
from threadloom.params import Filters
from threadloom.plans.corpus import build_corpus

SCHEMA = "id string, title string, body string, comments array<struct<author:string,body:string,upvotes:bigint>>, _pos int"
COMMENT = ("u", "c", 1)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, b, [COMMENT] * n, at) for at, (i, t, b, n) in enumerate(rows)], SCHEMA)


def ids(df):
    return sorted((r.id for r in df.collect()), key=str)


def test_first_copy_with_too_few_comments_removes_the_id(spark):
    records = frame(spark, [("a", "long enough title", "", 1), ("a", "long enough title", "", 9), ("b", "long enough title", "", 3)])
    assert [r.ID for r in build_corpus(records, Filters(min_chars=1)).posts.collect()] == ["b"]


def test_null_ids_are_one_group_and_empty_ids_another(spark):
    records = frame(spark, [(None, "n1", "", 0), (None, "n2", "", 0), ("", "e1", "", 0), ("", "e2", "", 0), ("x", "x", "", 0)])
    kept = funnel.dedup_first(records)
    assert sorted(r.title for r in kept.collect()) == ["e1", "n1", "x"]
    assert kept.count() == funnel.dedup_first(kept).count()


def test_terms_may_span_title_and_body_but_creator_patterns_may_not(spark):
    records = funnel.clean_text(frame(spark, [("a", "I tried MY", "Video today", 0), ("b", "my video", None, 0), ("c", None, None, 0)]))
    assert ids(funnel.exclude_terms(records, ["my video"])) == ["c"]
    assert ids(funnel.require_any_terms(records, ["My Video"])) == ["a", "b"]
    flags = {r.id: r.is_creator_suspect for r in funnel.flag_creator(records, ["my video"]).collect()}
    assert flags == {"a": False, "b": True, "c": False}
    assert ids(funnel.exclude_terms(records, [])) == ids(funnel.require_any_terms(records, [])) == ["a", "b", "c"]


def test_length_counts_characters_without_separator(spark):
    records = funnel.clean_text(frame(spark, [("a", "😀é", "xy", 0), ("b", "abc", None, 0)]))
    assert ids(funnel.min_chars(records, 4)) == ["a"]


def test_creator_patterns_follow_python(spark):
    records = frame(spark, [("a", "É isso", "", 0), ("b", "nº ٣", "", 0), ("c", "line\rbreak", "", 0), ("d", "end\n", "", 0)])
    hit = lambda p: ids(funnel.flag_creator(records, [p]).where("is_creator_suspect"))
    assert hit("é isso") == ["a"]
    assert hit(r"nº \d") == ["b"]
    assert hit("line.break") == ["c"]
    assert hit("end$") == ["d"]
    assert hit(r"^é\b|zzz") == ["a"]


def test_comment_defaults_and_dropped_elements(spark):
    rows = [("p", [("a", None, None), None, (None, "x", 4)]), ("q", []), ("r", None)]
    df = spark.createDataFrame(rows, "id string, comments array<struct<author:string,body:string,upvotes:bigint>>")
    got = [tuple(r) for r in funnel.to_comments(df).collect()]
    assert got == [("p", "a", "", 0), ("p", "", "x", 4)]
    assert [r.n_comments for r in funnel.with_comment_count(df).orderBy("id").collect()] == [3, 0, 0]


def brute(rows, f):
    first = OrderedDict()
    for i, t, b, n in rows:
        first.setdefault(i, (t or "", b or "", n))
    blob = lambda r: f"{r[0]} {r[1]}".lower()
    counts = [len(rows), len(first)]
    kept = {i: r for i, r in first.items() if r[2] >= f.min_comments}
    counts.append(len(kept))
    counts.append(sum("und" in r[0].lower() or "und" in r[1].lower() for r in kept.values()))
    kept = {i: r for i, r in kept.items() if len(r[0]) + len(r[1]) >= f.min_chars}
    counts.append(len(kept))
    kept = {i: r for i, r in kept.items() if not any(t.lower() in blob(r) for t in f.exclude_terms)}
    counts.append(len(kept))
    kept = {i: r for i, r in kept.items() if not f.require_any_terms or any(t.lower() in blob(r) for t in f.require_any_terms)}
    return kept, [*counts, len(kept), len(kept)]


text = st.one_of(st.none(), st.text(alphabet="aund É", max_size=6))
record = st.tuples(st.sampled_from([None, "", "a", "b", "c"]), text, text, st.integers(0, 3))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(record, min_size=1, max_size=12), exclude=st.booleans(), require=st.booleans(), parts=st.integers(1, 3))
def test_funnel_and_audit_against_brute_force(spark, rows, exclude, require, parts):
    f = Filters(min_comments=1, min_chars=2, creator_patterns=("und",), exclude_terms=("d É",) if exclude else (), require_any_terms=("A", "u") if require else ())
    corpus = build_corpus(frame(spark, rows).repartition(parts), f)
    kept, counts = brute(rows, f)
    got = {r.ID: (r.Titulo, r.Texto, r.Num_Comentarios) for r in corpus.posts.collect()}
    assert got == kept
    audit = corpus.audit.orderBy("stage_ord").collect()
    assert [r.rows for r in audit] == counts
    funnel_rows = [r for r in audit if r.stage not in ("creator_flag", "output")]
    assert all(b.rows == a.rows - b.dropped for a, b in zip(funnel_rows, funnel_rows[1:]))


def test_empty_input_has_an_all_zero_audit(spark):
    audit = build_corpus(frame(spark, []), Filters()).audit.collect()
    assert len(audit) == 8 and all(r.rows == 0 and r.dropped == 0 for r in audit)
