import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from threadloom.llm import queries, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def features(text):
    words = words_of(text)
    return [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def buckets(text):
    return Counter(zlib.crc32(f.encode()) % 10_000 for f in features(text))


def by_hand(docs, target, percent=5, min_words=20):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(buckets(text))
    for text in target:
        t.update(buckets(text))
    S, T = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in range(10_000)]
    rows = []
    for i, text in docs:
        own = buckets(text)
        weight = sum(gain[b] * n for b, n in own.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, own.total(), weight, score, len(words_of(text))))
    able = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = able[: percent * len(able) // 100]
    return rows, drawn


def check(got, docs, target, **how):
    rows, drawn = by_hand(docs, target, **how)
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["n_words"]) for r in got) == Counter(rows)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r["doc_id"], r["score"]) for r in ranked] == [(d[0], d[3]) for d in drawn]


TEXT = st.lists(st.sampled_from(["a", "B", "Zz9", " ", "\n", "-", "é", "你", "\x7f", "0", "x" * 63, "y" * 64, "Q" * 65, "w" * 200, "  "]), max_size=25).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=6), st.sampled_from([1, 2, 7, 64, 300, 1 << 20]))
def test_ngrams_of_slices_are_those_of_whole_texts(texts, slice_bytes):
    got = [Counter() for _ in texts]
    words = [0] * len(texts)
    for rows, found, word_rows in resample._new_ngrams(pa.array(texts, pa.string()), slice_bytes):
        for r, b in zip(rows.tolist(), found.tolist(), strict=True):
            got[r][b] += 1
        for r in word_rows.tolist():
            words[r] += 1
    assert got == [buckets(t) for t in texts]
    assert words == [len(words_of(t)) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.binary(max_size=resample.LONG_WORD + 1))
def test_shifts_join_checksums(left, right):
    crc = resample._shifted(np.array([zlib.crc32(left)], np.uint32), np.array([len(right)]))[0] ^ zlib.crc32(right)
    assert int(crc) == zlib.crc32(left + right)


@pytest.fixture(scope="module")
def some_docs():
    rng = random.Random(11)
    pool = [f"w{k}" for k in range(80)] + ["Benchmark", "été", "你好"]
    docs = [(i, " ".join(rng.choice(pool) for _ in range(rng.choice([0, 5, 19, 20, 21, 60])))) for i in range(400)]
    docs += [(3, docs[5][1]), (3, docs[5][1]), (None, docs[7][1]), (None, None), (900, None), (901, ""), (902, "x" * 3000 + " " + "y " * 40), (903, "é" * 90 + " a-b\tc")]
    return docs, [" ".join(rng.choice(pool[:20]) for _ in range(30)) for _ in range(9)] + [None, ""]


@pytest.mark.parametrize("percent", [0, 5, 37, 100])
def test_draw_by_hand(spark, some_docs, percent):
    docs, target = some_docs
    frame = spark.createDataFrame([(*d, 1, "r") for d in docs], "doc_id long, text string, SCORE int, Rank string").repartition(5)
    items = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    check(resample.resample(frame, items, percent=percent).collect(), docs, target, percent=percent)


def test_empty_tables(spark, some_docs, no_docs):
    docs, target = some_docs
    items = spark.createDataFrame([(t,) for t in target], "text string")
    assert resample.resample(no_docs, items).count() == 0
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    check(resample.resample(frame, items.limit(0)).collect(), docs, [])
    few = [(i, "too short") for i in range(50)]
    check(resample.resample(spark.createDataFrame(few, "doc_id long, text string"), items).collect(), few, target)


def test_query_by_hand(spark):
    small = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    check(queries.op13_importance_resampling(spark, small).collect(), docs, target)


@pytest.mark.parametrize("wanted", [1, 2, 777, 5_000, 9_999, 10_000])
@pytest.mark.parametrize("kind", ["many", "ties", "sorted"])
def test_selection_is_exact(spark, wanted, kind):
    rng = random.Random(wanted)
    low = {"many": lambda i: rng.randrange(10**6), "ties": lambda i: rng.randrange(2), "sorted": lambda i: i}[kind]
    keys = [(low(i), rng.randrange(5), i) for i in range(10_000)]
    frame = spark.createDataFrame(keys, "low long, id long, row long").repartition(4)
    assert resample.cutoff_key(frame, wanted, rest=50) == sorted(keys)[wanted - 1]


def test_selection_discards_a_share_each_time(spark, monkeypatch):
    left = []
    inner = resample._halves

    def watched(keyed, pivot):
        out = inner(keyed, pivot)
        left.append((out[0][1], out[1][1]))
        return out

    monkeypatch.setattr(resample, "_halves", watched)
    frame = spark.range(20_000, numPartitions=7).selectExpr("pmod(hash(id), 97) low", "pmod(hash(id), 5) id", "id row")
    resample.cutoff_key(frame, 1_000, rest=50)
    for under, over in left[1:]:
        assert min(under, over) * 10 >= under + over
