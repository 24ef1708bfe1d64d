from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from threadloom.llm import queries, token_counts
from threadloom.llm.tokens import tokenizer_path

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"]
PIECES = ["word", " ", "\n", "  ", "don't", ",", "a.", "é", " ", "\x1c", "\r\n", "<|endoftext|>", "<s>", "</s>", "x1", "12", "!?", "你好", "。", "🎉", "\t", " b", "²", "é"]


def whole(path, text):
    """The library's own call, one text at a time."""
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        return len(SentencePieceProcessor(model_file=path).encode(text))
    from tokenizers import Tokenizer

    return len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module", params=FILES)
def path(request):
    return tokenizer_path(request.param)


def test_cut_and_cached_words_add_up(path):
    coder = token_counts.LengthEncoder(path)
    plain = coder.pieces.encode if path.endswith(".model") else lambda t: coder.coder.encode(t, add_special_tokens=False).ids

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), max_size=6), st.sampled_from([1, 3, 9, 1000]), st.sampled_from([1, 20, 10_000]))
    def check(texts, piece_chars, batch_bytes):
        import numpy as np

        total = np.zeros(len(texts), np.int64)
        coder.count(zip(texts, range(len(texts))), total, batch_bytes, piece_chars)
        assert total.tolist() == [len(plain(t)) for t in texts]

    check()


def test_columns_and_edge_rows(spark, edge_docs, edge_rows, path):
    found = token_counts.count_tokens(edge_docs.withColumnRenamed("v", "N_TOKENS"), path, limit=10, piece_chars=100, batch_bytes=500)
    assert found.columns == ["doc_id", "lang", "row", "key", "T1", "n_chars", "n_bytes", "n_tokens", "over_limit"]
    got = Counter((r["doc_id"], r["lang"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in found.collect())
    want = Counter()
    for i, text, lang, *_ in edge_rows:
        n = whole(path, text or "")
        want[i, lang, len((text or "").encode()), n, n > 10] += 1
    assert got == want


def test_a_special_string_is_one_token():
    coder = token_counts.length_encoder(tokenizer_path())
    assert coder.lengths(["<|endoftext|>", "a <|endoftext|> b", " <|endoftext|>"]) == [1, 4, 2]


def test_no_rows(spark, no_docs):
    assert token_counts.count_tokens(no_docs, tokenizer_path()).count() == 0


def test_query_on_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = Counter(tuple(r) for r in queries.op12_token_counts(spark, "/root/testdata/sf0.001").collect())
    assert got == Counter((d["doc_id"], len((d["text"] or "").encode()), n := whole(tokenizer_path(), d["text"] or ""), n > 512) for d in docs)


def test_a_batch_of_long_texts_keeps_few_strings():
    import numpy as np
    import pyarrow as pa

    held = []

    class Watching(token_counts.LengthEncoder):
        def _by_words(self, texts):
            held.append(sum(map(len, texts)))
            return super()._by_words(texts)

    coder = Watching(tokenizer_path())
    text = "some words and more of them. " * 20_000
    column = pa.array([text] * 5)
    total = np.zeros(5, np.int64)
    sizes = np.full(5, len(text))
    coder.count(token_counts._texts(column, sizes, 1 << 18), total, 1 << 18, 1 << 15)
    assert total.tolist() == [total[0]] * 5 and total[0] == len(coder.coder.encode(text, add_special_tokens=False).ids)
    assert max(held) < (1 << 18) + (1 << 15) + 100
