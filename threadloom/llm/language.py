"""Language of a text by its words, with shorter and shorter character n-grams for words never seen.

A known word scores its log relative frequency in each language. An unknown word is scored by its character
n-grams of the longest order of which the model knows at least one, the mean over those it knows; a word of
which nothing is known says nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import local, text_slices
from threadloom.operators.keyed import first_n_per_key

SAMPLE_ROWS = 2_000  # documents of each language
ORDERS = (5, 4, 3, 2, 1)
SMOOTH = 0.1
CACHE_CHARS = 1_500_000  # of words kept by each worker, 8 added for each: about 100,000 words
SLICE_CHARS = 1 << 18
_WORD = re.compile(r"[^\W\d_]+")


def _words(text: str) -> list[str]:
    """Runs of letters, lower-cased. The pattern also takes numerals that are no digits, such as ½ and Ⅷ."""
    found = _WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [part for word in found for part in "".join(c if c.isalpha() else " " for c in word).split()]


def _grams(word: str, order: int) -> list[str]:
    framed = f" {word} " if order > 1 else word
    return [framed[i : i + order] for i in range(len(framed) - order + 1)]


class LanguageModel:
    """Log frequencies by language; ``langs`` in text order, so ties go to the first."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        """``counts``: occurrences of each word by language."""
        self.langs = sorted(counts)
        tables: dict[int, dict[str, np.ndarray]] = {0: {}, **{n: {} for n in ORDERS}}
        for k, lang in enumerate(self.langs):
            for word, n in counts[lang].items():
                for order in (0, *ORDERS):
                    for part in [word] if order == 0 else _grams(word, order):
                        at = tables[order].get(part)
                        if at is None:
                            at = tables[order][part] = np.zeros(len(self.langs), np.float32)
                        at[k] += n
        self.orders = (0, *ORDERS)
        self.index = {o: {part: i for i, part in enumerate(t)} for o, t in tables.items()}
        self.logs = {}
        for order, t in tables.items():
            seen = np.array(list(t.values()), np.float64).reshape(len(t), len(self.langs))
            self.logs[order] = np.log((seen + SMOOTH) / (seen.sum(0) + SMOOTH * (len(seen) + 1))).astype(np.float32)

    @cached_property
    def cache(self) -> dict[str, np.ndarray]:
        return {}

    held = 0  # characters of the cached words

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("cache", "held")}

    def _scores(self, words: list[str]) -> np.ndarray:
        """Scores of distinct words; those asked for before come from a cache of bounded size."""
        cache = self.cache
        if self.held > CACHE_CHARS:
            cache.clear()
            self.held = 0
        out = np.empty((len(words), len(self.langs)))
        for k, word in enumerate(words):
            got = cache.get(word)
            if got is None:
                got = cache[word] = self.word(word)
                self.held += len(word) + 8
            out[k] = got
        return out

    def word(self, word: str) -> np.ndarray:
        """Score of one word in each language."""
        known = self.index[0].get(word)
        if known is not None:
            return self.logs[0][known]
        for order in ORDERS:
            index = self.index[order]
            hits = [i for g in _grams(word, order) if (i := index.get(g)) is not None]
            if hits:
                return self.logs[order][hits].mean(0)
        return np.zeros(len(self.langs), np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and its share of the posterior for each text; ``und`` and 0 for a text without letters."""
        n = len(self.langs)
        if not n:
            return ["und"] * len(texts), np.zeros(len(texts))
        scores = np.zeros((len(texts), n))
        sizes = np.zeros(len(texts), np.int64)
        for rows, parts in text_slices(texts, SLICE_CHARS):
            found = [_words(part) for part in parts]
            number = np.array([len(w) for w in found], np.int64)
            np.add.at(sizes, rows, number)
            if number.sum():
                codes, unique = pd.factorize(np.array([w for ws in found for w in ws], object))
                table = self._scores(unique.tolist())
                owner = np.repeat(np.array(rows), number)
                for k in range(n):
                    scores[:, k] += np.bincount(owner, table[codes, k], len(texts))
        # A text's evidence counts as that of a few words, so that long texts don't all score 1.
        shift = (scores - scores.max(1, keepdims=True)) / np.maximum(1, sizes / 8)[:, None]
        share = np.exp(shift) / np.exp(shift).sum(1, keepdims=True)
        best = scores.argmax(1)
        pred = [self.langs[b] if size else "und" for b, size in zip(best.tolist(), sizes.tolist(), strict=True)]
        return pred, np.where(sizes > 0, share.max(1), 0.0)


def fit_languages(docs: DataFrame, train_on: Column | None = None, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Count words of at most ``sample_rows`` documents of each language, those with the smallest hash of id and text.

    Repeated rows count once. Rows without text or language teach nothing.
    """
    own = docs.where(train_on) if train_on is not None else docs
    own = own.select("lang", "text", F.xxhash64("doc_id", "text").alias("h")).dropna(subset=["lang", "text"])
    # Ranked in salted parts first, so that the commonest language does not meet in one task.
    picked = first_n_per_key(own.select("lang", "h").distinct(), ["lang"], "h", sample_rows).select("lang", "h")
    # The sample is bounded by its parameter, so its keys may be broadcast.
    sample = own.join(F.broadcast(picked), ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                counted: Counter[str] = Counter()
                for _, parts in text_slices(texts.tolist(), SLICE_CHARS):
                    for part in parts:
                        counted.update(_words(part))
                words = pd.Series(counted, dtype=np.int64)
                yield pd.DataFrame({"lang": lang, "word": words.index, "n": words.to_numpy(np.int64)})

    rows = local(sample.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    counts: dict[str, dict[str, int]] = {}
    for lang, word, n in sorted(rows.itertuples(index=False)):
        counts.setdefault(lang, {})[word] = n
    return LanguageModel(counts)


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score of every row; repeated rows each, a null text as one without letters."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lang, score = sent.value.predict(batch["text"].tolist())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "null": batch["null"], "lang_pred": lang, "score": score})

    ready = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("null"), "text")
    out = ready.mapInPandas(predict, "doc_id long, null boolean, lang_pred string, score double")
    return out.select(F.when(~F.col("null"), F.col("doc_id")).alias("doc_id"), "lang_pred", "score")
