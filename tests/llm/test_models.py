"""Trees, quality, URLs, language, PPM and neighbours."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import language, neighbours, ppm, quality, queries, trees, urls
from threadloom.llm.common import in_fold

SF = "/root/testdata/sf0.01"


def test_flat_trees_learn_and_walk_like_one_row_at_a_time():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    model = trees.train(x[:1500], y[:1500])
    score = model.score(x[1500:])
    assert ((score >= 0.5) == y[1500:]).mean() > 0.97
    for row, want in zip(x[1500:1520], score[:20], strict=True):
        total = model.base
        for f, t, v in zip(model.feature, model.threshold, model.value, strict=True):
            at = 0
            while at < len(f):
                at = 2 * at + (2 if row[f[at]] > t[at] else 1)
            total += v[at - len(f)]
        assert want == pytest.approx(1 / (1 + math.exp(-total)))


def test_trees_without_a_choice():
    none = trees.train(np.zeros((0, 3)), np.zeros(0))
    assert none.score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert trees.train(np.ones((50, 3)), np.ones(50)).score(np.ones((1, 3)))[0] > 0.9
    same = trees.train(np.ones((50, 3)), np.arange(50) % 2.0)
    assert same.score(np.ones((1, 3)))[0] == pytest.approx(0.5)


def test_quality_on_held_out_documents(spark):
    rows = queries.op5_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out and quality is not null")
    right = [r["predicted"] == r["quality"] for r in rows.collect()]
    assert len(right) > 50 and sum(right) / len(right) > 0.9


def test_quality_on_edge_rows(spark, edge_docs, edge_rows, no_docs):
    labels = spark.createDataFrame([(4, 1), (4, 1), (4, 0), (7, 0), (None, 1), (2, None), (99, 1)], "doc_id long, quality int")
    model = quality.fit_quality(edge_docs, labels)
    got = quality.quality_scores(edge_docs, model).collect()
    assert len(got) == len(edge_rows) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.keep_good(edge_docs, model, 0.0).columns == edge_docs.columns
    assert quality.keep_good(edge_docs, model, 0.0).count() == len(edge_rows)
    none = quality.fit_quality(no_docs, labels)
    assert {r["score"] for r in quality.quality_scores(edge_docs, none).collect()} == {0.5}
    assert quality.quality_scores(no_docs, model).count() == 0


def plain_rule(url):
    at = (url or "").find("://")
    host, path = ("", "") if at < 0 else re.match(r"([^/?#]*)([^?#]*)", url[at + 3 :], re.S).groups()
    host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    fits = [(len(r), r, v) for r, v in queries.RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    _, rule, verdict = max(fits, default=(0, None, None))
    return host, path, rule, verdict


URLS = [
    None, "", "no scheme", "http://", "http://A.ORG", "http://a.org/x?y#z", "https://example.org/es/1", "https://WWW.Example.org/en/1?q=://", "http://org/",
    "x://ÀB.com/fr/", "http://a.com/de/é", "http://com/de/?a=1&b=2", "http://notorg/", "http://a.org:80/", "http://a.net#frag", "http://a.com?x/fr/", "http://a.org//", "h://b.com/fr/\nline",
]


def test_rules_equal_a_plain_reading(spark):
    frame = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(None, "http://a.org/", "h"), (3, "http://", "h")], "page_id long, url string, host string")
    rows = urls.judge_urls(frame, queries.RULES, urls.fit_urls(frame, queries.RULES)).collect()
    assert len(rows) == len(URLS) + 2
    for r in rows:
        if r["page_id"] is not None:
            host, path, rule, verdict = plain_rule(URLS[r["page_id"]])
            assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
            assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    none = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge_urls(none, queries.RULES, urls.fit_urls(none, queries.RULES)).count() == 0


def test_url_query_rules_on_all_pages_and_trees_learn(spark):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()}
    rows = queries.op6_url_filter(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        host, path, rule, verdict = plain_rule(pages[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and (verdict is None or r["verdict"] == verdict)
    ruled = [r for r in rows if r["rule"]]
    assert sum((r["score"] >= 0.5) == (r["verdict"] == "block") for r in ruled) > 0.95 * len(ruled)


def test_language_backs_off_from_words_to_shorter_grams():
    model = language.LanguageModel({"aa": {"hello": 5, "shared": 1}, "bb": {"guten": 5, "shared": 3}})
    assert model.predict(["hello", "guten tag", "shared", "hellos", "gutenberg", "q", None, "12 !"])[0] == ["aa", "bb", "bb", "aa", "bb", "aa", "und", "und"]
    assert (model.word("hellos") == model.logs[5][[model.index[5][g] for g in (" hell", "hello")]].mean(0)).all()
    assert (model.word("zg") == model.logs[1][[model.index[1]["g"]]].mean(0)).all()
    assert not model.word("qq").any()


def test_language_on_held_out_documents(spark):
    rows = queries.op7_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) > 0.97 * len(rows)


def test_language_on_edge_rows(edge_docs, edge_rows, no_docs):
    model = language.fit_languages(edge_docs)
    got = language.predict_languages(edge_docs, model).collect()
    assert len(got) == len(edge_rows) and {r["lang_pred"] for r in got} <= {"en", "de", "fr", "und"} and all(0 <= r["score"] <= 1 for r in got)
    und = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert {1, 2, 3, 12} <= und
    assert {r["lang_pred"] for r in language.predict_languages(edge_docs, language.fit_languages(no_docs)).collect()} == {"und"}
    assert language.predict_languages(no_docs, model).count() == 0


def brute_base(rows, train):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)), None]
    c = Counter(w for i, t in rows if train(i) for w in split(t))
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        w = split(t)
        out.append((i, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)))
    return Counter(out)


class BrutePPM:
    """The same definition, counted and coded one byte at a time."""

    def __init__(self, texts, least):
        counts = defaultdict(Counter)
        for t in texts:
            data = [ppm.START] * ppm.ORDER + list(t) + [ppm.END]
            for i in range(ppm.ORDER, len(data)):
                for n in range(ppm.ORDER + 1):
                    counts[tuple(data[i - n : i])][data[i]] += 1
        self.total = {c: sum(s.values()) for c, s in counts.items() if sum(s.values()) >= least}
        self.kids = {c: {b: k for b, k in counts[c].items() if k >= least} for c in self.total}

    def log10(self, text):
        data, out = [ppm.START] * ppm.ORDER + list(text) + [ppm.END], 0.0
        for i in range(ppm.ORDER, len(data)):
            excluded = set()
            for n in range(ppm.ORDER, -1, -1):
                c = tuple(data[i - n : i])
                if c not in self.total:
                    continue
                kids = {b: k for b, k in self.kids[c].items() if b not in excluded}
                weight = self.total[c] - sum(self.kids[c].get(b, 0) for b in excluded) + len(kids)
                if data[i] in kids:
                    out += math.log10(kids[data[i]] / weight)
                    break
                left = weight - sum(kids.values())
                out += math.log10(left / weight) if left > 0 else 0
                excluded |= set(kids)
            else:
                out -= math.log10(max(1, 255 - len(excluded)))
        return out


@pytest.mark.parametrize("nodes", [1 << 20, 40])
def test_scores_equal_brute_force(spark, monkeypatch, nodes):
    monkeypatch.setattr(ppm, "NODES", nodes)
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["The", "the", "cat", "sat", "é", "x\ty", "zz", "\x1c"]) + rng.choice(["", "s"]) for _ in range(rng.randrange(0, 25)))) for i in range(60)]
    rows += [(70, None), (71, ""), (72, "unseen words ÿ \u0000")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ppm.lm_scores(docs, F.col("doc_id") % 4 != 0).collect()
    train = lambda i: i % 4 != 0
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == brute_base(rows, train)
    taught = [(t or "").encode() for i, t in rows if train(i)]
    size = sum(len(t) + 1 for t in taught)
    model = BrutePPM(taught, max(1, -(-size // nodes)))
    texts = dict(rows)
    for r in got:
        assert r["score"] == pytest.approx(model.log10((texts[r["doc_id"]] or "").encode()), rel=1e-9)




@pytest.mark.parametrize("sent", [1 << 20, 40])
def test_rare_contexts_stay_in_the_model_of_a_larger_corpus(spark, monkeypatch, sent):
    monkeypatch.setattr(ppm, "SENT", sent, raising=False)
    rng = random.Random(16)
    rows = [(1, "the same line again. " * 60_000), (2, "a Rare name: Xaver Żółw 你好")]
    rows += [(i, "".join(rng.choice("abcdéXŻ ") for _ in range(40))) for i in range(3, 40)]
    got = ppm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), F.col("doc_id") < 30).collect()
    model = BrutePPM([t.encode() for i, t in rows if i < 30], 1)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] > 1:
            assert r["score"] == pytest.approx(model.log10(dict(rows)[r["doc_id"]].encode()), rel=1e-9)


def test_grams_of_documents_cross_a_shuffle_packed(spark, monkeypatch):
    """Many buckets and gatherings, texts that share grams, and a row for each bucket of a gathering, not for each gram of a text."""
    for name, value in (("SENT", 40), ("_BUCKET", 100), ("_GATHERED", 300), ("_ROWS", 50)):
        monkeypatch.setattr(ppm, name, value)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(batch)
    asked = []
    inner = ppm._gram_scores
    monkeypatch.setattr(ppm, "_gram_scores", lambda full, packed, buckets, least: asked.append((packed, buckets)) or inner(full, packed, buckets, least))
    rng = random.Random(26)
    rows = [(i, "".join(rng.choice("abcdéXŻ ") for _ in range(rng.randrange(60))) + "shared tail " * rng.randrange(3)) for i in range(80)] + [(90, "z" * 400), (91, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = BrutePPM([t.encode() for i, t in rows if i < 40], 1)
    try:
        spark.conf.set(batch, 5)
        out = ppm.lm_scores(docs, F.col("doc_id") < 40)
        got = {r["doc_id"]: r["score"] for r in out.collect()}
    finally:
        spark.conf.set(batch, usual)
    assert len(got) == len(rows)
    for i, text in rows:
        assert got[i] == pytest.approx(model.log10((text or "").encode()), rel=1e-9)
    ((packed, buckets),) = asked
    lists = packed.collect()
    pairs = sum(len(r["owners"]) for r in lists)
    assert buckets > 9 and len({r["bucket"] for r in lists}) > 9 and len({r["row"] for r in lists}) > 3
    assert all(sum(r["sizes"]) == len(r["owners"]) == len(r["times"]) and len(r["keys"]) == len(r["sizes"]) for r in lists)
    assert len(lists) < pairs / 5 and sum(len(r["keys"]) for r in lists) < pairs
    assert out._jdf.queryExecution().analyzed().toString().count("Generate explode") == 1  # words alone go out one by one


def test_only_words_are_looked_up_row_by_row(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, "other text")], "doc_id long, text string")
    plan = ppm.lm_scores(docs, F.col("doc_id") == 1)._jdf.queryExecution().analyzed().toString()
    assert plan.count("Generate explode") == 1


def test_packed_grams_are_those_of_each_text():
    rng = np.random.default_rng(1)
    keys, docs = rng.choice(rng.integers(0, 1 << 48, 60), 3000), rng.integers(0, ppm._DOCS, 40)[rng.integers(0, 40, 3000)]
    keys[:200] = (1 << 48) - 1
    docs[:200] = ppm._DOCS - 1
    places, lists = ppm._packed(keys * ppm._DOCS + docs, 7)
    assert len(set(places.tolist())) == len(places) <= 7
    got = Counter()
    for place, k, sizes, owners, times in zip(places, *lists, strict=True):
        assert len(set(k.tolist())) == len(k) and (ppm._bucket(ppm._part(k), 7) == place).all()
        for key, owner, n in zip(np.repeat(k, sizes).tolist(), owners.tolist(), times.tolist(), strict=True):
            assert (key, owner) not in got
            got[key, owner] = n
    assert got == Counter(zip(keys.tolist(), docs.tolist(), strict=True))
    assert len(ppm._packed(np.zeros(0, np.int64), 7)[0]) == 0


def test_scores_on_edge_rows(edge_docs, edge_rows, no_docs):
    got = ppm.lm_scores(edge_docs).collect()
    assert len(got) == len(edge_rows) and all(r["score"] < 0 and r["base_score"] < 0 and r["n_known"] == r["n_tokens"] for r in got)
    untaught = ppm.lm_scores(edge_docs, F.lit(False)).collect()
    assert len(untaught) == len(edge_rows) and all(r["n_known"] == 0 == r["train_tokens"] for r in untaught)
    short = next(r for r in untaught if r["doc_id"] == 2)
    assert short["score"] == pytest.approx(-math.log10(255)) and short["base_score"] == pytest.approx(0.0)
    assert ppm.lm_scores(no_docs).count() == 0


def brute_nearest(rows, k):
    out = {}
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v) and len(v) == 4]
    for q, a in fine:
        if q % 5 == 0:
            best = {}
            for i, b in fine:
                if i != q:
                    s = float((b * a).sum() / (np.sqrt((b * b).sum()) * np.sqrt((a * a).sum())))
                    best[i] = max(s, best.get(i, -9))
            out[q] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def test_neighbours_equal_brute_force_when_all_leaves_are_taken(spark):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(300)] + [(1000 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(40)]
    rows += [(500, None), (505, [0.0] * 4), (510, [1.0, None, 1.0, 1.0]), (515, [float("nan"), 1.0, 1.0, 1.0]), (520, [float("inf"), 1.0, 1.0, 1.0]), (525, [1.0]), (None, [1.0] * 4), (530, [])]
    rows += [(3, rows[3][1])]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, leaf int, id string").repartition(4)
    got = neighbours.nearest(frame, F.col("vec_id") % 5 == 0, trees=4, share=99, leaf_rows=8).orderBy("query_id", "rank").collect()
    want = brute_nearest(rows, 5)
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(q, n, i) for q in sorted(want) for n, (i, _) in enumerate(want[q], 1)]
    assert [r["score"] for r in got] == pytest.approx([s for q in sorted(want) for _, s in want[q]], abs=1e-15)


def test_few_or_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = neighbours.nearest(few, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2]
    assert neighbours.nearest(few.limit(0), F.lit(True)).count() == 0


def test_recall(spark):
    got = defaultdict(set)
    for r in queries.op9_nearest_neighbours(spark, SF).collect():
        got[r["query_id"]].add(r["vec_id"])
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits = []
    for k in np.flatnonzero(ids % 50 == 0):
        near = x @ x[k]
        near[k] = -9
        hits.append(len(set(ids[np.argsort(-near)[:5]]) & got[ids[k]]) / 5)
    assert np.mean(hits) >= 0.9


def test_folds(spark):
    import zlib

    rows = {r[0]: r[1] for r in spark.createDataFrame([(i,) for i in [0, 7, -4, None]], "doc_id long").select("doc_id", in_fold("doc_id", 3)).collect()}
    assert rows == {i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i in rows}
