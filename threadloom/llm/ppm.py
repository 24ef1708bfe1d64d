"""Code length of texts under prediction by partial matching over bytes, and under a word unigram baseline.

The pretrained model is a trie of byte contexts up to ``ORDER`` long. Its counts come from every byte of the
training texts, and all of them are kept, in a written table, so the model grows with the corpus. Grams of full
length that make up at least one in ``SENT`` of the training bytes are sent along with their logs. The others of
the documents are shuffled once to the counts: gathered over many documents, each distinct gram with the documents
that have it, as lists rather than a row for each gram of a document. What is asked of contexts of three bytes and
more is decided by grams that share those three bytes, so those that do go to the same bucket, and each bucket is
coded on its own; the nodes of shorter contexts, few as UTF-8 has few sequences of three bytes, are sent along.
``NODES``, if set, leaves out contexts and bytes after a context that make up less than one in ``NODES`` of the
training bytes.

A byte is coded in the longest context of the trie that precedes it. With T occurrences of the context, n of
them before its d child bytes, a child seen c times has probability c/(T+d), and the escape (T-n+d)/(T+d).
After an escape the next shorter context is used without the bytes that the longer one already offered (symbol
exclusion). Children of a context are always children of its suffixes, so what exclusion removes is a constant
of the longer context. At the end any byte is equally likely. Every text is framed by a start and ends with an
end byte, neither of which occurs in UTF-8.

The baseline needs the count of every training word. Words that make up at least one in ``SENT`` training words
are sent along; the others are looked up by a shuffled join, so the vocabulary may have any size. Words are
known by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import local, staged

ORDER = 5
NODES: int | None = None
SENT = 1 << 20
SHORT = 2  # contexts up to this length are sent along
_ROWS = 400_000
_BUCKET = 1 << 17  # grams of the model in a bucket, on average
_GATHERED = 1 << 20  # grams of the documents gathered before they are packed
_DOCS = 1 << 14  # documents they may come from; fits 16 bits
START, END = 0xFE, 0xFF
_CHUNK = 1 << 18
_KEPT = 2_000_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = b" \t\n\x0b\x0c\r"
END_WORD = np.uint64(0)


def grams(texts: list[bytes]) -> np.ndarray:
    """For every byte and end, the byte and the ``ORDER`` before it as one number, the byte in the highest place."""
    joined = b"".join(bytes([START]) * ORDER + t + bytes([END]) for t in texts)
    a = np.frombuffer(joined, np.uint8).astype(np.int64)
    n = len(a) - ORDER
    out = np.zeros(max(0, n), np.int64)
    for back in range(ORDER + 1):
        out |= a[ORDER - back : ORDER - back + n] << (8 * (ORDER - back))
    # The framing bytes themselves are not coded.
    return out[a[ORDER:] != START]


def word_hashes(text: bytes) -> list[bytes]:
    """Words of a text; A-Z are lower-cased and only ASCII white space separates."""
    return text.translate(_LOWER).split()


class _Hasher:
    """64-bit hashes of words, and 0 for none."""

    def many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the words, and the hash of each code."""
        codes, unique = pd.factorize(np.array(words, object)) if words else (np.zeros(0, np.int64), [])
        hashes = pd.util.hash_array(np.array([w.decode("latin-1") for w in unique], object), categorize=False) if len(unique) else np.zeros(0, np.uint64)
        return codes, np.where(hashes == END_WORD, np.uint64(1), hashes)


def _sum(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[: len(keys)]
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts


def _tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of grams (kind 0) and words (kind 1), summed within the task up to a bounded number of keys."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {0: [], 1: []}

    def add(kind: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pd.DataFrame]:
        held[kind].append((keys, counts))
        if sum(len(k) for k, _ in held[kind]) > _KEPT:
            merged = _sum(*map(list, zip(*held[kind], strict=True)))
            held[kind] = [merged]
            if len(merged[0]) > _KEPT // 2:
                yield from flush(kind)

    def flush(kind: int) -> Iterator[pd.DataFrame]:
        if held[kind]:
            keys, counts = _sum(*map(list, zip(*held[kind], strict=True)))
            held[kind] = []
            for at in range(0, len(keys), 100_000):
                yield pd.DataFrame({"kind": kind, "key": keys[at : at + 100_000], "n": counts[at : at + 100_000]})

    for texts in _pieces(batches):
        keys, counts = np.unique(grams(texts), return_counts=True)
        yield from add(0, keys, counts)
        codes, hashes = _Hasher().many([w for t in texts for w in word_hashes(t)])
        yield from add(1, hashes.view(np.int64), np.bincount(codes, minlength=len(hashes)))
        yield from add(1, np.array([END_WORD]).view(np.int64), np.array([len(texts)]))
    for kind in held:
        yield from flush(kind)


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[list[bytes]]:
    """Texts as bytes, a few megabytes at a time."""
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for text in batch["text"]:
            texts.append(text.encode("utf-8", "replace"))
            size += len(texts[-1])
            if size >= _CHUNK:
                yield texts
                texts, size = [], 0
    if texts:
        yield texts


class PartialMatching:
    """The trie as sorted tables: for each length the nodes with their counts, and what is known of each context."""

    def __init__(self, nodes: dict[int, tuple[np.ndarray, np.ndarray]], contexts: dict[int, tuple[np.ndarray, np.ndarray]]):
        """``nodes[n]``: byte and the n before it, with count; ``contexts[n]``: n bytes, with the bytes that follow."""
        self.nodes, self.contexts = nodes, contexts

    @cached_property
    def _tables(self):
        index = {n: pd.Index(keys) for n, (keys, _) in self.nodes.items()}
        where = {n: pd.Index(keys) for n, (keys, _) in self.contexts.items()}
        facts = {}
        for n, (keys, total) in self.contexts.items():
            nodes, counts = self.nodes[n]
            own = where[n].get_indexer(nodes & ((1 << 8 * n) - 1))
            d = np.bincount(own, minlength=len(keys))
            inside = np.bincount(own, counts, len(keys))
            shorter = np.zeros(len(keys))
            if n:  # what the children count for in the next shorter context
                kept, less = self.nodes[n - 1]
                shorter = np.bincount(own, less[index[n - 1].get_indexer(nodes >> 8)], len(keys))
            facts[n] = total.astype(float), inside, d.astype(float), shorter
        return index, where, facts

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """Log probability of the byte in each of ``grams``, which are distinct."""
        index, where, facts = self._tables
        out = np.zeros(len(keys))
        open_ = np.arange(len(keys))
        gone_n, gone_d = np.zeros(len(keys)), np.zeros(len(keys))  # what exclusion takes from the next context
        for n in range(ORDER, -1, -1):
            part = keys[open_] >> (8 * (ORDER - n))
            context = where[n].get_indexer(part & ((1 << 8 * n) - 1))
            node = index[n].get_indexer(part)
            total, inside, d, shorter = facts[n]
            known = context >= 0
            at = open_[known]
            c = context[known]
            left = total[c] - gone_n[at]
            ways = d[c] - gone_d[at]
            weight = left + ways
            hit = node[known] >= 0
            here = at[hit]
            out[here] += np.log10(self.nodes[n][1][node[known][hit]] / weight[hit])
            miss = at[~hit]
            escape = (total[c] - inside[c] + ways)[~hit]
            with np.errstate(divide="ignore", invalid="ignore"):
                out[miss] += np.where(escape > 0, np.log10(escape / weight[~hit]), 0.0)
            gone_n[miss], gone_d[miss] = shorter[c][~hit], d[c][~hit]
            open_ = np.setdiff1d(open_, here, assume_unique=True)
        # The start byte is never coded, so 255 values are left but for those excluded.
        out[open_] -= np.log10(np.maximum(1, 255 - gone_d[open_]))
        return out


def _level(keys: np.ndarray, counts: np.ndarray, size: int, n: int, least: int) -> tuple[tuple, tuple]:
    """Nodes and contexts of length n, with counts, from all nodes of length ``size`` that bear on them."""
    nodes = _sum([keys >> (8 * (size - n))], [counts])
    contexts = _sum([nodes[0] & ((1 << 8 * n) - 1)], [nodes[1]])
    return tuple((k[c >= least], c[c >= least]) for k, c in (nodes, contexts))


def fit_corpus(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables (key, n) of grams of full length and of words, both over every row of ``texts`` (text, not null)."""
    counted = texts.mapInPandas(_tally, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counted = staged(counted, "counts")
    return counted.where("kind = 0").select("key", "n"), counted.where("kind = 1").select("key", "n")


def _head(full: DataFrame, bytes_: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent grams, sorted, and their log probabilities."""
    often = max(least, -(-bytes_ // SENT))
    context = F.col("key").bitwiseAND(F.lit((1 << 8 * ORDER) - 1))
    grams = local(full.where(F.col("n") >= often)).sort_values("key")  # at most SENT rows
    facts = full.groupBy(context.alias("key")).agg(F.sum("n").alias("n"), F.count_if(F.col("n") >= least).alias("d"))
    facts = local(facts.where(F.col("n") >= often)).sort_values("key")  # the contexts of those grams, and at most SENT rows
    keys, counts = grams["key"].to_numpy(np.int64), grams["n"].to_numpy(np.int64)
    own = pd.Index(facts["key"].to_numpy(np.int64)).get_indexer(keys & ((1 << 8 * ORDER) - 1))
    return keys, np.log10(counts / (facts["n"] + facts["d"]).to_numpy(np.int64)[own]) if len(keys) else np.zeros(0)


def _bucket(part, buckets: int):
    """The bucket of the three bytes before a byte, as a number, for arrays and Spark columns alike."""
    return part * 0x9E3779B1 % (1 << 32) % 1_000_003 % buckets


def _part(keys: np.ndarray) -> np.ndarray:
    return keys >> (8 * (ORDER - SHORT - 1)) & ((1 << 8 * (SHORT + 1)) - 1)


def _packed(marks: np.ndarray, buckets: int) -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """Grams of documents, as gram * ``_DOCS`` + document, with repeats: the buckets that occur, and the lists of each.

    The lists are the distinct grams, how many documents have each, those documents, and how often they have it.
    """
    marks = np.sort(marks)
    new = np.flatnonzero(np.concatenate([[True], marks[1:] != marks[:-1]])[: len(marks)])
    times = np.diff(np.append(new, len(marks))).astype(np.int32)
    marks = marks[new]
    keys = marks // _DOCS
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    sizes, keys = np.diff(np.append(first, len(keys))), keys[first]
    place = _bucket(_part(keys), buckets)
    order = np.argsort(place, kind="stable")
    keys, place, ends = keys[order], place[order], np.cumsum(sizes[order])
    pairs = np.repeat(first[order] - ends + sizes[order], sizes[order]) + np.arange(len(marks))
    cut = np.flatnonzero(place[1:] != place[:-1]) + 1
    far = ends[cut - 1]
    lists = [
        np.split(keys, cut), np.split(sizes[order].astype(np.int16), cut),
        np.split((marks[pairs] % _DOCS).astype(np.int16), far), np.split(times[pairs], far),
    ]
    return place[np.append(0, cut)] if len(place) else place, lists


def _gram_scores(full: DataFrame, asked: DataFrame, buckets: int, least: int) -> DataFrame:
    """Log probability (row, log) of the packed grams ``asked``; a row has several, to be added."""
    short = local(full.groupBy(F.shiftright("key", 8 * (ORDER - SHORT)).alias("key")).agg(F.sum("n").alias("n")))
    top = short["key"].to_numpy(np.int64), short["n"].to_numpy(np.int64)
    none = ((np.zeros(0, np.int64),) * 2,) * 2
    sent = full.sparkSession.sparkContext.broadcast({n: _level(*top, SHORT, n, least) if len(top[0]) else none for n in range(SHORT + 1)})
    part = F.shiftright("key", 8 * (ORDER - SHORT - 1)).bitwiseAND(F.lit((1 << 8 * (SHORT + 1)) - 1))
    taught = full.select(_bucket(part, buckets).cast("int").alias("bucket"), F.lit(-1).cast("bigint").alias("row"), "key", "n")
    lists = ("keys", "sizes", "owners", "times")
    # Empty lists, because Spark goes over all null ones of an Arrow batch again for every further row.
    taught = taught.withColumns({c: F.array().cast(asked.schema[c].dataType) for c in lists})
    both = taught.unionByName(asked.select("bucket", "row", F.lit(0).cast("bigint").alias("key"), F.lit(0).cast("bigint").alias("n"), *lists))

    def model_of(taught: list[tuple[np.ndarray, np.ndarray]]) -> PartialMatching:
        levels = dict(sent.value)
        for n in range(SHORT + 1, ORDER + 1):
            levels[n] = _level(*map(np.concatenate, zip(*taught, strict=True)), ORDER, n, least) if taught else none
        return PartialMatching({n: x[0] for n, x in levels.items()}, {n: x[1] for n, x in levels.items()})

    def scores(model: PartialMatching, asked: list[tuple]) -> pa.RecordBatch:
        unique, at = np.unique(np.concatenate([keys for _, keys, *_ in asked]), return_inverse=True)
        logs = np.split(model.log10(unique)[at], np.cumsum([len(keys) for _, keys, *_ in asked])[:-1])
        rows, sums = [], []
        for log, (start, _, sizes, owners, times) in zip(logs, asked, strict=True):
            here = np.flatnonzero(np.bincount(owners))
            rows.append(start + here)
            sums.append(np.bincount(owners, np.repeat(log, sizes) * times)[here])
        return pa.RecordBatch.from_pydict({"row": np.concatenate(rows), "log": np.concatenate(sums)})

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, model = None, None
        taught: list[tuple[np.ndarray, np.ndarray]] = []
        asked: list[tuple] = []
        for batch in batches:
            buckets, starts = batch["bucket"].to_numpy(), batch["row"].to_numpy()
            kind = starts >= 0  # the counts of a bucket come before what is asked of it
            cut = np.flatnonzero((buckets[1:] != buckets[:-1]) | kind[1:] | kind[:-1]) + 1
            for low, high in zip([0, *cut], [*cut, len(starts)], strict=True):
                if high == low:
                    continue
                if buckets[low] != bucket:
                    if asked:
                        yield scores(model or model_of(taught), asked)
                    bucket, model, taught, asked = buckets[low], None, [], []
                if not kind[low]:
                    taught.append(tuple(batch[c].slice(low, high - low).to_numpy().copy() for c in ("key", "n")))
                    continue
                asked.append((starts[low], *(batch[c][low].values.to_numpy() for c in lists)))
                if sum(len(x[1]) for x in asked) >= _ROWS:
                    model = model or model_of(taught)
                    yield scores(model, asked)
                    asked = []
        if asked:
            yield scores(model or model_of(taught), asked)

    return both.repartition("bucket").sortWithinPartitions("bucket", "row").mapInArrow(walk, "row long, log double")


def lm_scores(docs: DataFrame, train_on: Column | None = None) -> DataFrame:
    """Scores of every row of ``docs`` (doc_id, text), learnt from the rows that ``train_on`` picks.

    Columns: doc_id, n_tokens, n_known, train_tokens, base_score (log10 under the smoothed word unigram) and
    score (log10 under the trie). A null text is the empty one, which has the end alone. Without training rows
    no token is known, and every byte is equally likely. Repeated rows are scored each. Other columns are left
    out. An empty table gives no rows.
    """
    own = docs.where(train_on) if train_on is not None else docs
    full, words = fit_corpus(own.select(F.coalesce("text", F.lit("")).alias("text")))
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    scale = math.log10(total + 0.5 * (distinct + 1))
    often = max(1, -(-total // SENT))
    bytes_, grams_known = full.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    buckets = -(-grams_known // _BUCKET) or 1
    least = max(1, -(-bytes_ // NODES)) if NODES else 1
    heavy = local(words.where((F.col("n") >= often) | (F.col("key") == 0))).sort_values("key")  # at most SENT rows and the end
    context = docs.sparkSession.sparkContext
    sent = context.broadcast((_head(full, bytes_, least), heavy["key"].to_numpy(np.int64), heavy["n"].to_numpy(np.int64)))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (known_grams, gram_logs), keys, counts = sent.value
        gram_logs = np.append(gram_logs, 0.0)  # of those looked up later
        logs = np.append(np.log10(counts + 0.5), 0.0)
        marks, start, size = [], 0, 0

        def gathered() -> Iterator[pd.DataFrame]:
            places, (keys, sizes, owners, times) = _packed(np.concatenate(marks) if marks else np.zeros(0, np.int64), buckets)
            if len(places):
                yield pd.DataFrame({
                    "row": start, "doc_id": 0, "null": True, "n_tokens": 0, "known": 0, "base": 0.0, "score": 0.0, "rare": None, "rare_n": None,
                    "bucket": places, "keys": keys, "sizes": sizes, "owners": owners, "times": times,
                })

        for batch in batches:
            for low in _ranges(batch["text"]):
                part = batch.iloc[low]
                rows = part["row"].to_numpy()
                if size >= _GATHERED or rows[-1] - start >= _DOCS:
                    yield from gathered()
                    marks, size = [], 0
                if not size:
                    marks, start = [], rows[0]
                texts = [t.encode("utf-8", "replace") for t in part["text"]]
                sizes = np.array([len(t) for t in texts])
                coded = grams(texts)
                place = _places(known_grams, coded)
                bits = np.concatenate([[0.0], np.cumsum(gram_logs[place])])
                ends = np.cumsum(sizes + 1)
                marks.append(coded[place < 0] * _DOCS + np.repeat(rows - start, sizes + 1)[place < 0])
                size += len(marks[-1])
                lists = [word_hashes(t) for t in texts]
                n = np.array([len(x) for x in lists], np.int64)
                codes, hashes = _Hasher().many([w for x in lists for w in x])
                hashes = hashes.view(np.int64)
                at = _places(keys, hashes)
                owner = np.repeat(np.arange(len(texts)), n)
                token = at[codes]
                end = _places(keys, np.array([END_WORD]).view(np.int64))[0]
                rare, rare_n = _rare(owner[token < 0], hashes[codes[token < 0]], len(texts))
                yield pd.DataFrame({
                    "row": rows, "doc_id": part["doc_id"].to_numpy(), "null": part["null"].to_numpy(), "n_tokens": n + 1,
                    "known": np.bincount(owner[token >= 0], minlength=len(texts)) + (end >= 0),
                    "base": np.bincount(owner, logs[token] * (token >= 0), len(texts)) + logs[end] * (end >= 0),
                    "score": bits[ends] - bits[ends - sizes - 1], "rare": rare, "rare_n": rare_n,
                    "bucket": -1, "keys": None, "sizes": None, "owners": None, "times": None,
                })
        yield from gathered()

    ready = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("null"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    fields = "row long, doc_id long, null boolean, n_tokens long, known long, base double, score double, rare array<long>, rare_n array<int>"
    packed = "bucket int, keys array<long>, sizes array<short>, owners array<short>, times array<int>"
    written = staged(ready.mapInPandas(score, f"{fields}, {packed}"), "scores")
    sent.destroy()
    first = written.where("bucket < 0").drop("bucket", "keys", "sizes", "owners", "times")  # a row for each document
    asked = first.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("row", F.col("x.rare").alias("key"), F.col("x.rare_n").alias("times"))
    rare_words = words.where((F.col("n") < often) & (F.col("key") != 0)).withColumnRenamed("n", "count")
    found = asked.join(rare_words, "key").groupBy("row").agg(
        F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10((F.col("count") + 0.5) / 0.5)).alias("above")
    )
    coded = _gram_scores(full, written.where("bucket >= 0"), buckets, least).groupBy("row").agg(F.sum("log").alias("far_score"))
    out = first.drop("rare", "rare_n").join(found, "row", "left").join(coded, "row", "left")
    zero = F.lit(0)
    unknown = F.lit(math.log10(0.5))
    # Words sent along have their logs in base; all others start as unknown ones and gain from the join.
    return out.select(
        F.when(~F.col("null"), F.col("doc_id")).alias("doc_id"), "n_tokens", (F.col("known") + F.coalesce("rare_known", zero)).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") + (F.col("n_tokens") - F.col("known")) * unknown + F.coalesce("above", F.lit(0.0)) - F.col("n_tokens") * F.lit(scale)).alias("base_score"),
        (F.col("score") + F.coalesce("far_score", F.lit(0.0))).alias("score"),
    )


def _places(ordered: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Where each value stands among ascending distinct ones, -1 if nowhere; needs no index beside them."""
    if not len(ordered):
        return np.full(len(asked), -1)
    unique, codes = np.unique(asked, return_inverse=True)
    at = np.searchsorted(ordered, unique)
    at[at == len(ordered)] = 0
    return np.where(ordered[at] == unique, at, -1)[codes]


def _ranges(texts: pd.Series) -> Iterator[slice]:
    begin, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= _CHUNK or k + 1 - begin == _DOCS:
            yield slice(begin, k + 1)
            begin, size = k + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def _rare(owner: np.ndarray, keys: np.ndarray, n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each text the distinct keys and how often it has them."""
    order = np.lexsort((keys, owner))
    owner, keys = owner[order], keys[order]
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])])[: len(owner)])
    times = np.diff(np.append(new, len(owner))).astype(np.int32)
    cuts = np.searchsorted(owner[new], np.arange(1, n))
    return np.split(keys[new], cuts), np.split(times, cuts)
