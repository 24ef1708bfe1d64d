"""Document quality from boosted trees over statistics of the text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import local
from threadloom.llm.trees import Trees, train

SAMPLE_ROWS = 20_000

_CLASSES = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": b"0123456789", "space": b" \t\n\r",
    "stop": b".!?", "comma": b",;:", "symbol": b"#$%&*@^~=+<>", "bang": b"!", "bar": b"|", "bracket": b"()[]{}/\\_", "quote": b"\"'`",
    "vowel": b"aeiouAEIOU", "other": bytes(range(128, 256)),
}
_MASK = np.zeros((len(_CLASSES), 256))
for _row, _bytes in enumerate(_CLASSES.values()):
    _MASK[_row, list(_bytes)] = 1

WIDTH = len(_CLASSES) + 19


def statistics(text: str) -> np.ndarray:
    """Numbers that describe a whole text; zeros for the empty one."""
    out = np.zeros(WIDTH)
    if not text:
        return out
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    total = counts.sum()
    share = counts[counts > 0] / total
    out[: len(_CLASSES)] = _MASK @ counts / total
    words, lines = text.split(), text.split("\n")
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    n = max(1, len(words))
    often = Counter(words)
    top = max(often.values(), default=0)
    ends = sum(not w[-1].isalnum() for w in often.elements()) if words else 0
    capitals = sum(w.isupper() for w in words)
    titles = sum(w[0].isupper() for w in words)
    repeated = sum(map(eq, words, words[1:]))
    pairs = len(set(zip(words, words[1:], strict=False)))
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    out[len(_CLASSES) :] = [
        np.log1p(total), np.log1p(len(words)), sizes.mean() if len(words) else 0, sizes.std() if len(words) else 0,
        sizes.max(initial=0), (sizes < 3).sum() / n, (sizes > 12).sum() / n, len(often) / n, np.log1p(len(often)), top / n,
        repeated / n, pairs / n, ends / n, capitals / n, titles / n,
        np.log1p(len(lines)), 1 - len(set(lines)) / len(lines), np.log1p(lengths.mean()), -(share * np.log2(share)).sum(),
    ]
    return out


def fit_quality(docs: DataFrame, labels: DataFrame, train_on: Column | None = None, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Train on labelled documents; ``train_on`` picks the documents that may teach.

    At most ``sample_rows`` labelled documents are used, those with the smallest hash of their id. Several
    labels of one document give the majority, and 1 on a tie; of several texts with one id the least is taken; null labels and ids teach nothing.
    """
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("double").alias("quality")).dropna()
    marks = marks.groupBy("doc_id").agg(F.when(F.avg("quality") >= 0.5, 1).otherwise(0).alias("quality"))
    own = docs.where(train_on) if train_on is not None else docs
    known = marks.join(own.select(F.col("doc_id").cast("bigint").alias("doc_id")), "doc_id", "left_semi")
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = own.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "quality": batch["quality"], "x": [statistics(t) for t in batch["text"]]})

    # The sample is bounded by its parameter, so it may be broadcast.
    chosen = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = local(chosen.mapInPandas(measure, "doc_id long, quality int, x array<double>")).sort_values("doc_id")
    x = np.stack(rows["x"].to_list()) if len(rows) else np.zeros((0, WIDTH))
    return train(x, rows["quality"].to_numpy(float))


def quality_scores(docs: DataFrame, model: Trees, column: str = "score") -> DataFrame:
    """doc_id and the probability of good quality of every row; a null text scores as the empty one."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column("text").to_pylist()]).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], names=["doc_id", column])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(judge, f"doc_id long, {column} double")


def keep_good(docs: DataFrame, model: Trees, least: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score below ``least``; all columns stay as they are."""
    text_at = docs.columns.index("text")

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column(text_at).to_pylist()]).reshape(-1, WIDTH)
            yield batch.filter(pa.array(model.score(x) >= least))

    return docs.mapInArrow(good, docs.schema)
