import pytest

from threadloom.operators import keyed, search
from threadloom.params import Analysis, Filters, SearchParams, StudyProfile


def test_plan_order_is_community_then_group_then_keyword(spark):
    profile = StudyProfile("s", "T", ("B", "A"), {"z": ("k2", "k1"), "a": ("k3",)})
    plan = search.search_plan(search.profile_frame(spark, profile)).orderBy("sub_ord", "group_ord", "keyword_ord")
    got = [(r.subreddit, r.keyword_group, r.keyword) for r in plan.collect()]
    assert got == [(s, g, k) for s in ("B", "A") for g, k in (("z", "k2"), ("z", "k1"), ("a", "k3"))]
    assert "CartesianProduct" not in plan._jdf.queryExecution().executedPlan().toString()


def test_first_n_distinct_links_by_appearance(spark):
    rows = [("s", "b", 0), ("s", "a", 1), ("s", "b", 2), ("s", "c", 3), ("t", "c", 9)]
    links = spark.createDataFrame(rows, "search_id string, link string, pos int")
    got = search.distinct_links_topn(links, 2)
    assert sorted((r.search_id, r.rank, r.link) for r in got.collect()) == [("s", 1, "b"), ("s", 2, "a"), ("t", 1, "c")]


def test_large_n_is_exact_with_salting(spark):
    df = spark.range(5000).selectExpr("id % 2 AS k", "id AS at")
    got = keyed.first_n_per_key(df, ["k"], "at", 1500)
    assert sorted(r["_rank"] for r in got.where("k = 1").collect()) == list(range(1, 1501))
    assert got.agg({"at": "max"}).first()[0] == 2999


def test_failed_extraction_does_not_claim_a_post(spark):
    rows = [("p", 0, 0, 0, False), ("p", 0, 1, 0, True), ("p", 1, 0, 0, True), ("", 0, 0, 1, True), (None, 0, 0, 2, True), ("", 0, 0, 3, False)]
    hits = spark.createDataFrame(rows, "post_id string, sub_ord int, kw_ord int, pos int, extracted boolean")
    got = sorted(((r.post_id, r.sub_ord, r.kw_ord, r.pos) for r in search.attribute_first_search(hits).collect()), key=str)
    assert got == sorted([("p", 0, 1, 0), ("", 0, 0, 1), (None, 0, 0, 2)], key=str)


def test_profile_validation():
    raw = {
        "study_id": "s_1", "theme_label": " T ", "subreddits": [" A "], "keyword_groups": {"g": [" k "]}, "notes": "ignored",
        "filters": {"min_chars": 5, "exclude_terms": [" x "]}, "search": None, "analysis": {"report_title": "r"},
    }
    profile = StudyProfile.from_mapping(raw)
    assert profile.subreddits == ("A",) and profile.keyword_groups == {"g": ("k",)}
    assert profile.filters == Filters(min_chars=5, exclude_terms=("x",)) and profile.search == SearchParams() and profile.analysis == Analysis()
    for broken in (
        {"study_id": "a b"}, {"theme_label": " "}, {"subreddits": []}, {"subreddits": [""]}, {"keyword_groups": {}},
        {"keyword_groups": {"g": []}}, {"search": {"max_posts_per_search": 0}}, {"analysis": {"vocabulary_terms": []}},
    ):
        with pytest.raises(ValueError):
            StudyProfile.from_mapping({**raw, **broken})


@pytest.mark.parametrize("given, kept", [
    (Filters(creator_patterns=("", " tested ")), Filters(creator_patterns=("tested",))),
    (Filters(creator_patterns=(" ",)), Filters()),
    (Filters(exclude_terms=["", " x "], require_any_terms=["\n"]), Filters(exclude_terms=("x",))),
    (Filters(min_comments="4", min_chars="5"), Filters(min_comments=4, min_chars=5)),
    (Analysis(tactics_pattern="", theories_pattern="  "), Analysis()),
    (Analysis(tactics_pattern=" a b ", vocabulary_terms=[" t "]), Analysis(tactics_pattern="a b", vocabulary_terms=("t",))),
    (SearchParams(time_filter=" ", max_posts_per_search="7"), SearchParams(max_posts_per_search=7)),
])
def test_profile_values_are_normalised(given, kept):
    assert given == kept


@pytest.mark.parametrize("make", [lambda: Filters(exclude_terms="x"), lambda: Filters(exclude_terms=[1]), lambda: Analysis(vocabulary_terms=["a", " "]), lambda: Filters(min_chars="x")])
def test_profile_values_that_are_wrong(make):
    with pytest.raises(ValueError):
        make()
