import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.llm import packing, tokens

PATH = tokens.tokenizer_path()


@pytest.fixture(scope="module")
def coder():
    return tokens.WordEncoder(PATH)


PIECES = ["word", " ", "\n", "  ", "don't", ",", "a.", "é", "\u00a0", "\x1c", "\r\n", "<|endoftext|>", "x1", "12", "!?", "你好", "🎉", "\t"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), max_size=6))
def test_cached_words_give_the_ids_of_whole_texts(texts):
    coder = tokens.encoder(PATH)
    got = [ids.tolist() for ids in coder.encode(texts)]
    assert got == [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 600), max_size=900), min_size=1, max_size=5))
def test_segment_round_trip_and_random_access(docs):
    arrays = [np.array(d, np.uint32) for d in docs]
    segment = tokens.Segment(tokens.pack_segment([None, *range(1, len(docs))], arrays))
    flat = [x for d in docs for x in d]
    assert segment.tokens().tolist() == flat
    assert [segment.token(i) for i in range(len(flat))] == flat
    assert segment.null[0] == 1 and segment.ends.tolist() == np.cumsum([len(d) for d in docs]).tolist()
    with pytest.raises(IndexError):
        segment.token(len(flat))


def test_documents_read_back(spark, edge_docs, edge_rows, coder):
    rows = tokens.documents_of(tokens.write_tokens(edge_docs, path=PATH, segment_tokens=1000)).orderBy("start").collect()
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    place, want = 0, Counter()
    for r in rows:
        assert r["start"] == place
        place += r["n_tokens"]
    for i, text, *_ in edge_rows:
        code = np.array(coder.tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        want[i, len(code), zlib.crc32(code.tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == want


def test_no_documents(no_docs):
    assert tokens.documents_of(tokens.write_tokens(no_docs, path=PATH)).count() == 0
    assert packing.pack(packing.token_lengths(no_docs, PATH)).count() == 0


def check_bins(rows, capacities):
    bins = {}
    for r in rows:
        if r["bin_id"] is not None:
            bins.setdefault(r["bin_id"], []).append(r)
    for own in bins.values():
        own.sort(key=lambda r: r["bin_offset"])
        end = 0
        for r in own:
            assert r["bin_offset"] == end
            end += r["n_tokens"]
        fitting = [c for c in capacities if c >= end]
        assert {r["capacity"] for r in own} == {min(fitting)}
    return bins


def test_every_token_has_one_place(spark):
    rng = random.Random(1)
    lengths = [(i, rng.choice([1, 3, 16, 17, 33, 64, 65, 200, None, 0, -4])) for i in range(600)] + [(None, 5), (7, 9), (7, 9)]
    rows = packing.pack(spark.createDataFrame(lengths, "doc_id long, n_tokens long"), (16, 32, 64), group_items=100).collect()
    check_bins(rows, (16, 32, 64))
    got, want = Counter(), Counter()
    for r in rows:
        got[r["doc_id"]] += r["n_tokens"]
    for i, n in lengths:
        want[i] += max(0, n or 0)
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
    assert {r["doc_id"] for r in rows} == {i for i, _ in lengths}
    assert all(r["piece_start"] == 64 * r["piece"] and r["n_tokens"] <= 64 for r in rows)
    assert all((r["bin_id"] is None) == (r["n_tokens"] == 0) for r in rows)


def test_best_fit_takes_the_tightest_bin():
    bins, sizes = packing.pack_lengths(np.array([60, 50, 14, 4]), (64,), packing.sequence_cost)
    assert bins.tolist() == [0, 1, 1, 0] and sizes.tolist() == [64, 64]


def test_bins_shrink_and_sizes_are_chosen_jointly():
    _, sizes = packing.pack_lengths(np.array([10]), (16, 64), packing.sequence_cost)
    assert sizes.tolist() == [16]
    cheap_small = packing.pack_lengths(np.array([16] * 4), (16, 64), lambda c: c * c)[1]
    assert cheap_small.tolist() == [16] * 4
    cheap_large = packing.pack_lengths(np.array([16] * 4), (16, 64), lambda c: c + 100)[1]
    assert cheap_large.tolist() == [64]


def test_lengths_count_whole_texts(edge_docs, edge_rows, coder):
    got = Counter(tuple(r) for r in packing.token_lengths(edge_docs, PATH).collect())
    want = Counter((i, len(coder.tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, *_ in edge_rows)
    assert got == want


def test_a_small_cache_gives_the_ids_of_whole_documents(spark, monkeypatch):
    monkeypatch.setattr(tokens, "SLICE_CHARS", 20_000)
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").select("text").collect()]
    texts += [t.replace(" ", "\n", 3) + "!?" for t in texts[:50]]
    small = tokens.WordEncoder(PATH, cache_words=500)
    for got, text in zip(small.encode(texts), texts, strict=True):
        assert got.tolist() == small.tokenizer.encode(text, add_special_tokens=False).ids
