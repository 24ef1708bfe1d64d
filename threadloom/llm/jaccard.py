"""Near-duplicate texts by Jaccard similarity of their word n-grams, with Bayesian pruning of candidates.

Texts with the same set of n-grams are one class from the start. Classes that agree in some band of MinHash
values are candidates; connected candidates are compared in blocks. Within a block MinHash values are compared
a few at a time, and a pair goes as soon as the posterior probability that it reaches the threshold (uniform
prior, so a binomial tail) falls below the tolerance. The rest is verified exactly on the n-gram sets.

Bands of 4 out of 128 values miss a pair at 0.8 with probability 5e-8; the tolerance adds less than 1e-5. No
pair ever becomes a row: a block gives each class its number of links and one edge towards its component.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import staged, text_key, unused
from threadloom.llm.components import components

WORDS = 5
THRESHOLD = 0.8
HASHES = 128
BAND = 4
STEP = 16
TOLERANCE = 1e-6
BLOCK_CLASSES = 512
BLOCK_GRAMS = 1 << 20

_RANDOM = np.random.default_rng(11)
_MULTIPLIERS = _RANDOM.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_ADDENDS = _RANDOM.integers(0, 1 << 63, HASHES, np.uint64)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def gram_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted hashes of its word n-grams, in lower case; fewer words make one n-gram, none make none."""
    docs = [t.lower().split() if t else [] for t in texts]
    flat = [w for d in docs for w in d]
    if not flat:
        return [np.zeros(0, np.uint64) for _ in texts]
    codes, unique = pd.factorize(np.array(flat, object))
    hashes = pd.util.hash_array(np.array(unique, object), categorize=False)[codes]
    out, at = [], 0
    for d in docs:
        h = hashes[at : at + len(d)]
        at += len(d)
        n = max(1, len(d) - words + 1) if len(d) else 0
        gram = np.zeros(n, np.uint64)
        for k in range(min(words, len(d))):
            gram = (gram ^ h[k : k + n]) * _FACTOR
            gram ^= gram >> np.uint64(29)
        out.append(np.unique(gram))
    return out


def min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values of sets that are not empty, one row each."""
    out = np.empty((len(sets), HASHES), np.uint32)
    if sets:
        flat, starts = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
        for k in range(HASHES):
            mixed = flat * _MULTIPLIERS[k] + _ADDENDS[k]
            mixed ^= mixed >> np.uint64(31)
            out[:, k] = np.minimum.reduceat(((mixed * _FACTOR) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def _bands(signatures: np.ndarray) -> np.ndarray:
    """One number for each band; equal values in different bands give different numbers."""
    key = np.zeros((len(signatures), HASHES // BAND), np.uint64) + np.arange(HASHES // BAND, dtype=np.uint64)
    for k in range(BAND):
        key = (key ^ signatures[:, k::BAND].astype(np.uint64)) * _FACTOR
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def least_matches(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """After how many values how many must agree, so that the threshold is still likely enough.

    With a uniform prior, the similarity reaches t with probability P(Bin(n + 1, t) <= m) after m of n agree.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail = 0.0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                out.append((n, m))
                break
    return out


def _profile(docs: DataFrame, words: int) -> DataFrame:
    """Each row's hash of its n-gram set, number of n-grams and band keys."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for at in range(0, len(texts), 500):
                sets = gram_sets(texts[at : at + 500], words)
                full = [k for k, s in enumerate(sets) if len(s)]
                bands = _bands(min_hashes([sets[k] for k in full]))
                keys: list = [[] for _ in sets]
                for k, row in zip(full, bands.tolist(), strict=True):
                    keys[k] = row
                digests = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets])
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("t1"), part.column("t2"), pa.array(digests[:, 0]), pa.array(digests[:, 1]),
                     pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "t1", "t2", "k1", "k2", "grams", "bands"],
                )

    return docs.mapInArrow(profile, "doc_id long, t1 long, t2 long, k1 long, k2 long, grams long, bands array<long>")


def _compare(rows: list[tuple], same: bool, threshold: float, checks: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Links within one block pair: (vertex, texts it is linked to, least vertex it hangs together with).

    ``rows``: (vertex, texts, block, n-gram set). Pairs within a block are left to the block paired with itself, which is
    told by ``same``: the other block of a pair may be empty.
    """
    rows = list({r[0]: r for r in rows}.values())
    blocks = np.array([r[2] for r in rows])
    left, right = np.flatnonzero(blocks == blocks.min()), np.flatnonzero(blocks == blocks.max())
    sets = [r[3] for r in rows]
    size = np.array([len(s) for s in sets], np.int64)
    if len(rows) < 2 or same != (blocks.min() == blocks.max()):
        return []
    signatures = min_hashes(sets)
    agree = (signatures[left][:, None, :STEP] == signatures[right][None, :, :STEP]).sum(2)
    a, b = np.nonzero(agree >= checks[0][1])
    matches, a, b = agree[a, b], left[a], right[b]
    if same:
        matches, a, b = matches[a < b], a[a < b], b[a < b]
    for n, least in checks[1:]:
        matches = matches + (signatures[a, n - STEP : n] == signatures[b, n - STEP : n]).sum(1)
        keep = matches >= least
        matches, a, b = matches[keep], a[keep], b[keep]
    if not len(a):
        return []
    if len(a) > 64:
        used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        _, codes = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True)
        owner = np.repeat(np.arange(len(used)), size[used])
        common = np.zeros((len(used), len(used)), np.float32)
        for low in range(0, int(codes.max()) + 1, 16_384):  # a bounded part of the incidence matrix at a time
            part = np.zeros((len(used), 16_384), np.float32)
            here = (codes >= low) & (codes < low + 16_384)
            part[owner[here], codes[here] - low] = 1
            common += part @ part.T
        both = common[at[: len(a)], at[len(a) :]].astype(np.int64)
    else:
        both = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b, strict=True)], np.int64)
    keep = both >= threshold * (size[a] + size[b] - both) - 1e-9
    a, b = a[keep], b[keep]
    texts = np.array([r[1] for r in rows], np.int64)
    links = np.bincount(a, texts[b], len(rows)) + np.bincount(b, texts[a], len(rows))
    vertex = np.array([r[0] for r in rows], np.int64)
    root = vertex.copy()
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        if (before == root).all():
            break
    return [(int(vertex[k]), int(links[k]), int(root[k])) for k in np.flatnonzero(links)]


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, class_id, n_links, n_copies, is_first.

    class_id: least doc_id among the texts that hang together by links of ``threshold`` or more. n_links: how
    many different other texts such a link leads to, those with the same n-grams included. n_copies: rows with
    the same n-grams, this one included. is_first: this row is the one to keep of its class. A text without
    words, a null one too, is a class of its own row and always first. A class has a null class_id only if none
    of its rows has an id. Repeated rows share a class. Other columns are left out. An empty table gives no rows.
    """
    return classify(docs, **how).drop("t1", "t2", "wordless")


def keep_first(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one row of each class; all columns stay as they are."""
    d, w1, w2, empty, n = unused(docs, "_id", "_t1", "_t2", "_wordless", "_n")
    firsts = classify(docs, **how).where("is_first").select(
        F.col("doc_id").alias(d), F.col("t1").alias(w1), F.col("t2").alias(w2), F.col("wordless").alias(empty)
    ).distinct()
    t1, t2 = text_key(F.col("text"))
    kept = docs.join(firsts, F.col("doc_id").cast("bigint").eqNullSafe(F.col(d)) & (t1 == F.col(w1)) & (t2 == F.col(w2)))
    # Rows with the same id and text are one, but for those without words; this needs no other shuffle than the join's.
    kept = kept.withColumn(empty, F.when(F.col(empty), F.monotonically_increasing_id()))
    number = F.row_number().over(Window.partitionBy(d, w1, w2, empty).orderBy(w1))
    return kept.withColumn(n, number).where(F.col(n) == 1).select(*(F.col(f"`{c}`") for c in docs.columns))


def classify(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """The rows of ``near_duplicates`` with the two hashes of the text, t1 and t2, and whether it has no words.

    Vertices are row numbers of a written table, so ids may repeat.
    """
    t1, t2 = text_key(F.col("text"))
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", t1.alias("t1"), t2.alias("t2"))
    rows = staged(_profile(narrow, words).withColumn("row", F.monotonically_increasing_id()), "profiles")

    counted = rows.where("grams > 0").groupBy("k1", "k2", "t1", "t2").agg(F.min("row").alias("v"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = staged(
        counted.groupBy("k1", "k2").agg(F.min("v").alias("v"), F.min("least").alias("least"), F.sum("n").alias("n_copies"), F.count(F.lit(1)).alias("texts")),
        "classes",
    )
    owners = rows.join(classes.select(F.col("v").alias("row")), "row", "left_semi")
    keys = owners.select(F.col("row").alias("v"), F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", "m")
    edges = keys.join(shared, "key").where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    near = components(edges, "candidates")

    active = staged(
        near.join(rows.select(F.col("row").alias("vertex"), "doc_id", "t1", "t2", "grams"), "vertex")
        .join(classes.select(F.col("v").alias("vertex"), "texts"), "vertex"),
        "active",
    )
    sizes = active.groupBy("root").agg(F.sum("grams").alias("g"), F.count(F.lit(1)).alias("m"))
    sizes = sizes.select("root", F.greatest(F.ceil(F.col("g") / BLOCK_GRAMS), F.ceil(F.col("m") / BLOCK_CLASSES)).cast("int").alias("blocks"))
    placed = active.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("vertex"), F.col("blocks")).cast("int"))
    wanted = placed.select("vertex", "root", "texts", "blocks", "block", F.col("doc_id").alias("d"), F.col("t1").alias("w1"), F.col("t2").alias("w2"))
    # The same plan at every size: the classes grow with the documents, so they are never sent to all.
    found = narrow.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t1") == F.col("w1")) & (F.col("t2") == F.col("w2")))

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: set[int] = set()
        for batch in batches:
            batch = batch[~batch["vertex"].isin(done)].drop_duplicates("vertex")
            done.update(batch["vertex"].tolist())
            sets = gram_sets(batch["text"].tolist(), words)
            yield batch.drop(columns="text").assign(grams=[s.tobytes() for s in sets])

    ready = found.select("vertex", "root", "texts", "blocks", "block", "text")
    sets = ready.mapInPandas(expand, "vertex long, root long, texts long, blocks int, block int, grams binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = sets.withColumn("other", other).select(
        "root", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "vertex", "texts", "block", "grams"
    )
    checks = least_matches(threshold, tolerance)

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["vertex", "links", "root"]
        key, held, out = None, [], []
        for batch in batches:
            for root, p, q, *rest, grams in batch.itertuples(index=False):
                if (root, p, q) != key:
                    if held:
                        out += _compare(held, key[1] == key[2], threshold, checks)
                    key, held = (root, p, q), []
                held.append((*rest, np.frombuffer(grams, np.uint64)))
            if out:
                yield pd.DataFrame(out, columns=names)
                out = []
        if held:
            yield pd.DataFrame(_compare(held, key[1] == key[2], threshold, checks), columns=names)

    # Sorted runs of one block pair follow each other, so a task takes many small ones without a call for each.
    grouped = pairs.repartition("root", "p", "q").sortWithinPartitions("root", "p", "q")
    linked = staged(grouped.mapInPandas(link, "vertex long, links long, root long"), "links")
    together = components(linked.select(F.col("vertex").alias("a"), F.col("root").alias("b")), "linked")
    counts = linked.groupBy("vertex").agg(F.sum("links").alias("links"))

    known = classes.join(counts.withColumnRenamed("vertex", "v"), "v", "left").join(together.withColumnRenamed("vertex", "v"), "v", "left")
    known = known.select("k1", "k2", "v", "least", "n_copies", F.coalesce("root", "v").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("texts") - 1).alias("n_links"))
    known = staged(known, "known")
    firsts = known.groupBy("root").agg(F.min("least").alias("class_id"))
    keepers = known.where(F.col("least").isNotNull()).select("root", "least", "v")
    keepers = keepers.join(firsts.select("root", F.col("class_id").alias("least")), ["root", "least"]).groupBy("root").agg(F.min("v").alias("keeper"))
    info = known.join(firsts, "root").join(keepers, "root", "left").withColumn("keeper", F.coalesce("keeper", "root"))
    info = info.select("k1", "k2", "v", "least", "class_id", "n_links", "n_copies", "keeper")
    # Of equal classes the row to keep is the first that has the least id.
    slim = rows.where("grams > 0").select("doc_id", "t1", "t2", "k1", "k2", "row")
    chosen = slim.join(info.where("v = keeper").select("k1", "k2", "least"), ["k1", "k2"]).where(F.col("doc_id").eqNullSafe(F.col("least")))
    chosen = chosen.groupBy("k1", "k2").agg(F.min("row").alias("kept"))
    info = info.select("k1", "k2", "class_id", "n_links", "n_copies").join(chosen, ["k1", "k2"], "left")
    one = slim.join(info, ["k1", "k2"]).select(
        "doc_id", "t1", "t2", "class_id", "n_links", "n_copies", F.coalesce(F.col("row") == F.col("kept"), F.lit(False)).alias("is_first"), F.lit(False).alias("wordless")
    )
    none = rows.where("grams = 0").select(
        "doc_id", "t1", "t2", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.lit(1).cast("bigint").alias("n_copies"),
        F.lit(True).alias("is_first"), F.lit(True).alias("wordless"),
    )
    return one.unionByName(none)
