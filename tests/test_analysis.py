import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.functions.text import literal_count, substring_count
from threadloom.operators import explore, graph, numeric, report
from threadloom.operators.texts import MANY_TERMS, corpus_texts, count_terms, count_terms_by_origin
from threadloom.params import Analysis
from threadloom.plans.report import report_table

POSTS = "ID string, Subreddit string, Titulo string, Texto string, Upvotes bigint, Num_Comentarios int, URL string, is_creator_suspect boolean"
COMMENTS = "Post_ID string, Texto_Comentario string"


@pytest.fixture(scope="module")
def corpus(spark):
    posts = [
        ("p1", "A", "Reach and viral", "I tested reach", 5, 20, "u1", True),
        ("p2", "A", "No body VIRAL", "", 7, 20, "u2", False),
        ("p3", "B", None, "null title reach", 1, 3, "u3", None),
        ("p4", "B", "x" * 150, "Watch Time 3 seconds", 9, 4, "u4", True),
    ]
    comments = [("p1", "tested it, worked"), ("p1", ""), ("p2", None), ("p3", "VIRAL viral"), ("p3", "reach viral hook")]
    return spark.createDataFrame(posts, POSTS), spark.createDataFrame(comments, COMMENTS)


def pairs(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_the_two_null_rules_see_different_posts(corpus):
    loose, strict = (corpus_texts(*corpus, mode) for mode in ("coalesce", "strict"))
    assert (loose.count(), strict.count()) == (9, 5)
    assert sorted(r.id for r in strict.where("origin = 'posts'").collect()) == ["p1", "p4"]
    assert "no body viral " in [r.text for r in loose.collect()]
    assert all(r.text == r.text.lower() for r in strict.collect())
    with pytest.raises(ValueError):
        corpus_texts(*corpus, "other")


def test_ties_keep_profile_order_and_zero_counts_stay(corpus):
    got = pairs(report.top_terms(*corpus, ["zero", "reach", "viral", "tested"], 3), "rank", "term", "n")
    assert got == [(1, "viral", 5), (2, "reach", 4), (3, "tested", 2)]
    got = pairs(report.top_terms(*corpus, ["none", "worked", "zero", "hook"], 9), "term", "n")
    assert got == [("worked", 1), ("hook", 1), ("none", 0), ("zero", 0)]


def test_long_term_lists_take_several_passes(corpus):
    terms = [f"t{i}" for i in range(230)] + ["viral"]
    got = pairs(count_terms(corpus_texts(*corpus, "coalesce"), terms), "term_ord", "n")
    assert sorted(got) == [(i, 0) for i in range(230)] + [(230, 5)]
    table = report_table(*corpus, Analysis(vocabulary_terms=terms))
    top = table.where("section = '3 vocabulary'").orderBy("ord").select("key", "value").collect()
    assert [tuple(r) for r in top][:2] == [("viral", "5"), ("t0", "0")] and len(top) == 10


def test_bars_and_share_round_like_the_published_reports(spark):
    posts = spark.range(477).select(
        F.when(F.col("id") < 259, "big").otherwise("small").alias("Subreddit"), (F.col("id") < 72).alias("is_creator_suspect")
    )
    assert pairs(report.distribution(posts, "Subreddit"), "name", "n", "bar") == [("big", 259, "█" * 20), ("small", 218, "█" * 16)]
    share = report.creator_share(posts).first()
    assert (share.creators, f"{share.pct:.1f}", share.others) == (72, "15.1", 405)
    assert report.creator_share(posts.limit(0)).first().pct == 0


def test_top_discussions_break_ties_by_id_and_cut_titles(corpus):
    top = report.top_discussions(corpus[0], 3).collect()
    assert [(r.rank, r.id, r.creator) for r in top] == [(1, "p1", True), (2, "p2", False), (3, "p4", True)]
    assert len(top[2].title) == 100


def test_match_counts_and_report(corpus):
    a = Analysis(vocabulary_terms=("viral", "reach"))
    assert tuple(report.match_tactics(*corpus, a.tactics_pattern).first()) == (1, 1)
    assert tuple(report.match_theories(*corpus, a.theories_pattern).first()) == (1, 0)
    rows = {(r.section, r.ord, r.key): r.value for r in report_table(*corpus, a).collect()}
    assert rows["1a totals", 1, "posts"] == "4" and rows["1a totals", 2, "comments"] == "5"
    assert rows["3 vocabulary", 1, "viral"] == "5" and rows["3 vocabulary", 2, "reach"] == "4"
    assert rows["4 matches", 1, "tactics posts"] == "1" and rows["4 matches", 4, "theories comments"] == "0"
    assert rows["2 creators", 2, "percent"] == "50.0" and rows["1b communities", 1, "A"] == "2"
    assert rows["5 discussions", 1, "id"] == "p1" and len(rows) == 2 + 2 + 4 + 4 + 3 + 35 - 7


def test_exploration_counts(corpus):
    got = pairs(explore.keyword_by_origin(*corpus, ["tested", "reach"]), "term", "origin", "n")
    assert sorted(got) == [("reach", "comments", 1), ("reach", "posts", 2), ("tested", "comments", 1), ("tested", "posts", 1)]
    assert pairs(explore.native_vocabulary(*corpus, ["reach", "viral", "zero"]), "term", "n") == [("viral", 4), ("reach", 3), ("zero", 0)]
    assert pairs(explore.lexicon_counts(*corpus, ["vi.al", "zero", "t[eo]sted"]), "term", "n") == [("vi.al", 4), ("t[eo]sted", 2)]
    only_posts = explore.keyword_by_origin(corpus[0], corpus[1].limit(0), ["reach"])
    assert sorted(pairs(only_posts, "origin", "n")) == [("comments", 0), ("posts", 2)]


values = st.lists(st.integers(-50, 50) | st.integers(-(10**12), 10**12), min_size=1, max_size=40)
reals = st.lists(st.floats(allow_nan=False, allow_infinity=False, width=64, min_value=-1e300, max_value=1e300), min_size=1, max_size=40)
PROBS = (0.0, 0.25, 0.5, 0.75, 1.0)


def quantiles(spark, xs, dtype="bigint"):
    df = spark.createDataFrame([(x,) for x in xs], f"x {dtype}").repartition(3)
    return list(numeric.exact_quantiles(numeric.value_counts(df, "x"), PROBS).first())


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(xs=values)
def test_exact_quantiles(spark, xs):
    assert quantiles(spark, xs) == pytest.approx(list(np.quantile(np.array(xs, dtype=float), PROBS)), rel=1e-9, abs=1e-9)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(xs=reals)
def test_exact_quantiles_of_doubles(spark, xs):
    got = quantiles(spark, xs, "double")
    assert (got[0], got[4]) == (min(xs), max(xs))
    assert got == pytest.approx(list(np.quantile(np.array(xs), PROBS)), rel=1e-9, abs=1e-300)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(xs=st.lists(st.floats(allow_nan=False), min_size=2, max_size=30))
def test_sort_keys_order_like_the_doubles(spark, xs):
    xs = xs + [0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, float("inf"), float("-inf"), 1.7976931348623157e308, 0.5, 1.0 - 2.0**-53]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    keys = [tuple(r) for r in df.select("x", numeric._sort_key(F.col("x"), "double")).collect()]
    assert all((a < b) == (ka < kb) for a, ka in keys for b, kb in keys)


def test_clustered_values_spread_over_the_rounds(spark):
    n = 20_000
    for shape in ("CAST(1e12 AS BIGINT) + id", "0.5D + id * 1e-10D", "-(0.5D + id * 1e-10D)"):
        df = spark.range(n).select(F.expr(shape).alias("x"))
        want = np.quantile(np.array([r.x for r in df.collect()], dtype=float), PROBS)
        assert list(numeric.exact_quantiles(numeric.value_counts(df, "x"), PROBS).first()) == pytest.approx(list(want), rel=1e-15)


def test_infinities_and_nan_are_treated_alike(spark):
    inf, nan = float("inf"), float("nan")
    assert quantiles(spark, [-inf, 1.0, 2.0, 3.0, inf], "double") == [-inf, 1.0, 2.0, 3.0, inf]
    assert quantiles(spark, [inf, inf], "double") == [inf] * 5
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 2.5, 3.0, 4.0, nan, None)], "x double")
    assert numeric.boxplot_stats(df, "x").first().outliers == numeric.boxplot_outliers(df, "x").count() == 0
    assert tuple(numeric.describe_engagement(df, "x").first()) == pytest.approx((2.5, 2.5, 1.25**0.5, 1.25))
    wide = spark.createDataFrame([(x,) for x in (1.0, 2.0, 2.5, 3.0, 4.0, inf)], "x double")
    assert numeric.boxplot_stats(wide, "x").first().outliers == numeric.boxplot_outliers(wide, "x").count() == 1
    assert numeric.describe_engagement(wide, "x").first().mean == inf


def test_any_number_of_terms_takes_one_reading(spark, tmp_path):
    terms = [f"t{i}_" for i in range(301)]
    spark.createDataFrame([("posts", "t0_ t300_ t300_"), ("comments", "t300_ t7_"), ("comments", None)], "origin string, text string").write.parquet(str(tmp_path / "t"))
    texts = spark.read.parquet(str(tmp_path / "t"))
    got = count_terms(texts, terms)
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert {r.term: r.n for r in got.collect() if r.n} == {"t0_": 1, "t7_": 1, "t300_": 3} and got.count() == 301
    sides = {(r.term, r.origin): r.n for r in count_terms_by_origin(texts, terms).collect()}
    assert len(sides) == 602 and (sides["t300_", "posts"], sides["t300_", "comments"], sides["t0_", "comments"]) == (2, 1, 0)


ODD_TERMS = ["an", "ana", "banana", "aa", "aaa", "a", "AN", "é", "É", "ß", "kk", "straße", "i", "x.y", "^$", "🎉🎉", "🎉", "that", "th", "ſ", "σς", "a b", "[", "-]"]
ODD_TEXTS = st.text(st.sampled_from("abnthxyAN.k\u212aKßéÉsſSσςΣiİı🎉^$[]- "), max_size=40)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.tuples(st.sampled_from(["posts", "comments"]), st.none() | ODD_TEXTS), max_size=12))
@pytest.mark.parametrize("counter", [literal_count, substring_count])
def test_terms_found_together_count_as_one_by_one(spark, counter, values):
    texts = spark.createDataFrame(values, "origin string, text string")
    terms = ODD_TERMS + ["banana split", "nab"] + ODD_TERMS[:3]
    many = terms + [f"none{i}" for i in range(MANY_TERMS)]
    cols = "term_ord", "term", "n"
    one_by_one = sorted(pairs(count_terms(texts, terms, counter), *cols))
    assert [r for r in sorted(pairs(count_terms(texts, many, counter), *cols)) if r[0] < len(terms)] == one_by_one
    one_by_one = sorted(pairs(count_terms_by_origin(texts, terms, counter), *cols, "origin"))
    assert [r for r in sorted(pairs(count_terms_by_origin(texts, many, counter), *cols, "origin")) if r[0] < len(terms)] == one_by_one


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(xs=st.lists(st.integers(0, 30), min_size=1, max_size=40), bins=st.integers(1, 12))
def test_histogram(spark, xs, bins):
    rows = numeric.histogram(spark.createDataFrame([(x,) for x in xs], "x int"), "x", bins).orderBy("bin").collect()
    counts, edges = np.histogram(xs, bins)
    assert [r.n for r in rows] == counts.tolist() and sum(r.n for r in rows) == len(xs)
    assert [r.left_edge for r in rows] + [rows[-1].right_edge] == pytest.approx(edges.tolist())


def test_boxplot_describe_and_density(spark):
    xs = [1.0, 2.0, 2.5, 3.0, 4.0, 100.0, float("nan"), None]
    clean = np.array([x for x in xs if x is not None and x == x])
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    box = numeric.boxplot_stats(df, "x").first()
    assert (box.n, box.q1, box.median, box.q3) == (6, 2.125, 2.75, 3.75)
    assert (box.whisker_low, box.whisker_high, box.outliers) == (1.0, 4.0, 1)
    assert [r.x for r in numeric.boxplot_outliers(df, "x").collect()] == [100.0]
    stats = numeric.describe_engagement(df, "x").first()
    want = (clean.mean(), np.median(clean), clean.std(ddof=1), clean.var(ddof=1))
    assert tuple(stats) == pytest.approx(want)
    curve = numeric.density_curve(df, "x", 50).orderBy("point").collect()
    h = clean.std(ddof=1) * len(clean) ** -0.2
    grid = np.linspace(1, 100, 50)
    density = np.exp(-0.5 * ((grid[:, None] - clean) / h) ** 2).sum(1) / (len(clean) * h * np.sqrt(2 * np.pi))
    assert [r.density for r in curve] == pytest.approx(density.tolist())


def test_density_of_far_values_is_whole(spark):
    rng = np.random.default_rng(1)
    xs = np.concatenate([rng.normal(0, 1, 4000), [-3e4, 5.0, 5.0, 7e5]])
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    h = xs.std(ddof=1) * len(xs) ** -0.2
    assert (xs.max() - xs.min()) / h > 2 * numeric.KERNEL_REACH  # so that most points lie beyond most values
    curve = numeric.density_curve(df, "x").orderBy("point").collect()
    grid = np.linspace(xs.min(), xs.max(), 200)
    density = np.exp(-0.5 * ((grid[:, None] - xs) / h) ** 2).sum(1) / (len(xs) * h * np.sqrt(2 * np.pi))
    assert [r.point for r in curve] == list(range(200)) and [r.x for r in curve] == pytest.approx(grid.tolist(), rel=1e-12)
    assert [r.density for r in curve] == pytest.approx(density.tolist(), rel=1e-9, abs=0) and 0.0 in density
    endless = spark.createDataFrame([(1.0,), (2.0,), (float("inf"),)], "x double")
    assert all(r.density != r.density for r in numeric.density_curve(endless, "x").collect())


def test_empty_and_constant_columns(spark):
    empty, same = spark.createDataFrame([], "x int"), spark.createDataFrame([(4,)] * 3, "x int")
    assert tuple(numeric.boxplot_stats(empty, "x").first()) == (0, None, None, None, None, None, 0)
    assert sum(r.n for r in numeric.histogram(empty, "x", 4).collect()) == 0
    assert [(r.left_edge, r.n) for r in numeric.histogram(same, "x", 2).orderBy("bin").collect()] == [(3.5, 0), (4.0, 3)]
    assert numeric.density_curve(same, "x").count() == numeric.density_curve(empty, "x").count() == 0
    assert tuple(numeric.boxplot_stats(same, "x").first()) == (3, 4.0, 4.0, 4.0, 4.0, 4.0, 0)


def shared_rows(texts, terms):
    """Rows that two terms have in common, by intersecting the sets of rows that hold each."""
    rows = {term: {n for n, text in enumerate(texts) if text.find(term) >= 0} for term in terms}
    return {(u, v): len(rows[u] & rows[v]) for u in rows for v in rows if u < v and rows[u] & rows[v]}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(alphabet="abcd ", max_size=8), max_size=15))
def test_cooccurrence_equals_brute_force(spark, texts):
    terms = ("d", "a", "b", "ab", "c a", "bc")
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {(r.u, r.v): r.weight for r in graph.cooccurrence(df, terms).collect()}
    assert got == shared_rows(texts, terms)


def test_cooccurrence_beyond_one_word_of_bits(spark):
    terms = tuple(f"<{i}>" for i in range(130))
    texts = ["<0><61><62><129>", "<62><129>", "<5>", "<0><62>"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    pairs_df = graph.cooccurrence(df, terms)
    assert {(r.u, r.v): r.weight for r in pairs_df.collect()} == shared_rows(texts, terms)
    nodes, edges = graph.cooccurrence_graph(pairs_df, {"even": ("<0>", "<62>"), "odd": ("<129>",)})
    assert sorted(pairs(edges, "u", "v", "weight", "width")) == [("<0>", "<62>", 2, 1.0), ("<129>", "<62>", 2, 1.0)]
    assert sorted(pairs(nodes, "term", "category")) == [("<0>", "even"), ("<129>", "odd"), ("<62>", "even")]
