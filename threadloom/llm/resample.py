"""Importance resampling: documents that look like a target collection are drawn without replacement.

Texts are seen as hashed counts of word n-grams. A bucket's gain is the log ratio of its smoothed share in the target
and in the corpus; gains are one array of fixed length, and a document's weight is the sum of the gains of its
n-grams. Adding a fixed pseudo-random Gumbel term to each weight and keeping the highest scores draws documents in
proportion to their weights.

The lowest key that is drawn is found exactly by selection, without sorting all documents: every part of the
table names the median of its remaining keys, the median of those, weighted by how many keys each part has left, is
the pivot, and counting the keys on both sides of it shows on which side the cutoff lies. At least a fixed share of
the remaining keys is out after every reading. Only the winners are sorted.

N-gram hashes: crc32 of joined words follows from the words' own crc32 by shifting, which is linear, so no n-gram
is ever put together.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import staged
from threadloom.operators.ranked import global_rank

BUCKETS = 10_000
LONGEST = 3  # words of an n-gram
MIN_WORDS = 20
PERCENT = 5
SEED = 42
SLICE_BYTES = 1 << 20
LONG_WORD = 64
REST = 1_000  # keys among which the cutoff is read off
SHRINK = 8

_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


@cache
def _shifts() -> tuple[np.ndarray, np.ndarray]:
    """The crc table, and what each byte of a crc adds after 0 to ``LONG_WORD`` + 1 more zero bytes."""
    table = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32)
    table = table ^ table[0]  # without the usual start and end values, which cancel out in a shift
    now = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    steps = [now]
    for _ in range(LONG_WORD + 1):
        now = (now >> np.uint32(8)) ^ table[now & np.uint32(0xFF)]
        steps.append(now)
    return table, np.stack(steps)


def _shifted(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """crc32 values as they act on a text that goes on for ``by`` bytes."""
    _, steps = _shifts()
    out = steps[by, 0, crc & 0xFF]
    for k in range(1, 4):
        out ^= steps[by, k, (crc >> np.uint32(8 * k)) & 0xFF]
    return out


def _word_crcs(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """crc32 of each stretch of bytes: all together, one byte a round, and long ones each on its own."""
    table, _ = _shifts()
    out = np.full(len(begins), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-np.minimum(sizes, LONG_WORD + 1), kind="stable")
    at, left = begins[order], sizes[order]
    state = out[order]
    fast = left <= LONG_WORD
    skip = int(np.count_nonzero(~fast))
    ends = np.searchsorted(-left[skip:], -np.arange(1, LONG_WORD + 1), "right") + skip  # how many have that many bytes
    for k, end in enumerate(ends.tolist()):
        if end == skip:
            break
        now = state[skip:end]
        state[skip:end] = (now >> np.uint32(8)) ^ table[(now ^ data[at[skip:end] + k]) & 0xFF]
    out[order] = ~state
    for j in order[:skip].tolist():
        out[j] = zlib.crc32(data[begins[j] : begins[j] + sizes[j]].tobytes())
    return out


def ngram_crcs(data: np.ndarray, new_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """All n-grams of a stretch of bytes, in which texts begin at ``new_text`` (ascending places, 0 first).

    Gives where words begin, the text of each word, for each length the crc32 of the n-gram that ends with each
    word, and how many words up to it are of its text, ``LONGEST`` at most: longer n-grams than that do not exist there.
    """
    data = _LOWER[data]
    inside = _IN_WORD[data]
    first = np.zeros(len(data) + 1, bool)
    first[new_text] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:-1]
    begins = np.flatnonzero(begin)
    sizes = np.flatnonzero(end) + 1 - begins
    owner = np.searchsorted(new_text, begins, "right") - 1
    n = len(begins)
    known = np.ones(n, np.int8)
    for k in range(1, LONGEST):
        known[k:] += owner[k:] == owner[:-k]
    word = _word_crcs(data, begins, sizes)
    crcs = [word]
    short = np.minimum(sizes, LONG_WORD)
    spaced = _shifted(np.full(n, zlib.crc32(b" "), np.uint32), short) ^ word
    for k in range(1, LONGEST):
        longer = word.copy()
        longer[1:] = _shifted(crcs[-1][:-1], short[1:] + 1) ^ spaced[1:]
        for j in np.flatnonzero((sizes > LONG_WORD) & (known > k)).tolist():
            at = range(j - k, j + 1)
            longer[j] = zlib.crc32(b" ".join(data[begins[i] : begins[i] + sizes[i]].tobytes() for i in at))
        crcs.append(longer)
    return begins, owner, crcs, known


def _stretches(column: pa.Array, slice_bytes: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """The texts as (first row, bytes, where each text begins, words that were counted before).

    A stretch holds whole texts, or a slice of one long text that begins with the last words of the slice before.
    """
    if not len(column):
        return
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], "<i8", len(column) + 1, column.offset * 8)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + slice_bytes, "right")) - 1)
        begin, end = int(offsets[row]), int(offsets[last])
        if end - begin <= slice_bytes:
            yield row, data[begin:end], offsets[row:last] - begin, 0
        else:
            yield from ((row, part, np.zeros(1, np.int64), skip) for part, skip in _slices(data[begin:end], slice_bytes))
        row = last


def _slices(data: np.ndarray, slice_bytes: int) -> Iterator[tuple[np.ndarray, int]]:
    begin, reach, skip = 0, slice_bytes, 0
    while True:
        end = min(reach, len(data))
        while 0 < end < len(data) and _IN_WORD[data[end - 1]] and _IN_WORD[data[end]]:
            ahead = _IN_WORD[data[end : end + slice_bytes]]
            end += int(np.argmin(ahead)) if not ahead.all() else len(ahead)
        yield data[begin:end], skip
        if end >= len(data):
            return
        inside = _IN_WORD[data[begin:end]]
        inside[1:] &= ~inside[:-1]
        begins = np.flatnonzero(inside)
        skip = min(LONGEST - 1, len(begins))
        begin, reach = (begin + int(begins[-skip]) if skip else end), end + slice_bytes


def _new_ngrams(column: pa.Array, slice_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Stretch by stretch: row and bucket of every n-gram, and the row of every word, each n-gram and word once."""
    for row, data, new_text, skip in _stretches(column, slice_bytes):
        if not len(data):
            continue
        # A text that is empty begins where the next one does, which then owns the words.
        _, owner, crcs, known = ngram_crcs(data, new_text)
        fresh = np.arange(len(owner)) >= skip
        rows, buckets = [], []
        for k, crc in enumerate(crcs):
            own = fresh & (known > k)
            rows.append(owner[own] + row)
            buckets.append(crc[own].astype(np.int64) % BUCKETS)
        yield np.concatenate(rows), np.concatenate(buckets), owner[fresh] + row


def bucket_counts(texts: DataFrame, text: str = "text", slice_bytes: int = SLICE_BYTES) -> np.ndarray:
    """Occurrences of the n-grams of all texts by bucket. Each task sends one row per bucket that it saw."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, buckets, _ in _new_ngrams(batch.column(0), slice_bytes):
                total += np.bincount(buckets, minlength=BUCKETS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["bucket", "n"])

    found = texts.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).mapInArrow(count, "bucket int, n long")
    rows = found.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def bucket_gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares, rounded down."""
    t, s = target.astype(np.float64), corpus.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel variate that depends on nothing but seed and id, rounded down; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def weigh(docs: DataFrame, gains: np.ndarray, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(gains)  # 80 kB whatever the corpus

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            words, features, weights = (np.zeros(n, np.int64) for _ in range(3))
            for rows, buckets, word_rows in _new_ngrams(batch.column(1), slice_bytes):
                words += np.bincount(word_rows, minlength=n)
                features += np.bincount(rows, minlength=n)
                # Sums of whole numbers below 2^53 are exact in doubles.
                weights += np.bincount(rows, sent.value[buckets], n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, features, weights))], names=["doc_id", "n_words", "n_features", "weight"])

    ready = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return ready.mapInArrow(score, "doc_id long, n_words long, n_features long, weight long")


# Keys are ordered by what is drawn first: high scores, then small ids, then the row's number.
_KEY = np.dtype([("low", "<i8"), ("id", "<i8"), ("row", "<i8")])


def _median(keys: np.ndarray, sizes: np.ndarray | None = None) -> tuple[np.void, int]:
    """The key at which half of the weight is reached, and the whole weight."""
    order = np.lexsort((keys["row"], keys["id"], keys["low"]))
    if sizes is None:
        return keys[order[(len(keys) - 1) // 2]], len(keys)
    total = np.cumsum(sizes[order])
    return keys[order[int(np.searchsorted(total, (total[-1] + 1) // 2))]], int(total[-1])


def _below(keys: np.ndarray, pivot: tuple[int, int, int]) -> np.ndarray:
    low, own, row = pivot
    return (keys["low"] < low) | ((keys["low"] == low) & ((keys["id"] < own) | ((keys["id"] == own) & (keys["row"] < row))))


def _halves(keyed: DataFrame, pivot: tuple[int, int, int] | None) -> list[tuple[bool, int, np.ndarray, np.ndarray]]:
    """For the keys under the pivot and for the others: their number, each part's median and how many each part has.

    A task takes the median of every batch and the weighted median of those, so it holds one batch and sends at
    most two rows.
    """

    def medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bool, list[tuple[np.void, int]]] = {True: [], False: []}
        for batch in batches:
            keys = np.empty(batch.num_rows, _KEY)
            for k, name in enumerate(_KEY.names):
                keys[name] = batch.column(k).to_numpy()
            under = _below(keys, pivot) if pivot else np.ones(len(keys), bool)
            for side in (True, False):
                own = keys[under == side]
                if len(own):
                    found[side].append(_median(own))
        for side, some in found.items():
            if some:
                key, n = _median(np.array([k for k, _ in some], _KEY), np.array([n for _, n in some]))
                yield pa.RecordBatch.from_pylist([{"under": side, "n": n, **{f: int(key[f]) for f in _KEY.names}}], schema=wire)

    wire = pa.schema([("under", pa.bool_()), ("n", pa.int64()), *((f, pa.int64()) for f in _KEY.names)])
    rows = keyed.select(*_KEY.names).mapInArrow(medians, "under boolean, n long, low long, id long, row long").toArrow()
    out = []
    for side in (True, False):
        own = rows.filter(pc.equal(rows.column("under"), side))
        keys = np.empty(own.num_rows, _KEY)
        for f in _KEY.names:
            keys[f] = own.column(f).to_numpy()
        sizes = own.column("n").to_numpy()
        out.append((side, int(sizes.sum()), keys, sizes))
    return out


def cutoff_key(keyed: DataFrame, drawn: int, rest: int = REST) -> tuple[int, int, int] | None:
    """The ``drawn``-th smallest of the unique keys (low, id, row) of ``keyed``, exactly; None if nothing is drawn.

    One reading per pivot. The remaining keys are written again whenever they have become an eighth, so all
    readings together are a small multiple of the table.
    """
    if drawn < 1:
        return None
    keyed = keyed.select(*_KEY.names)
    ((_, left, keys, sizes), _) = _halves(keyed, None)
    if drawn > left:
        raise ValueError("more rows to draw than there are")
    written, wanted = left, drawn
    while left > rest:
        pivot = tuple(int(x) for x in _median(keys, sizes)[0])
        sides = _halves(keyed, pivot)
        under = sides[0][1]
        if wanted <= under:
            (_, left, keys, sizes), side = sides[0], _before(pivot)
        else:
            (_, left, keys, sizes), side = sides[1], ~_before(pivot)
            wanted -= under
        keyed = keyed.where(side)
        if left * SHRINK <= written:
            keyed, written = staged(keyed, "keys"), left
    found = keyed.orderBy(*_KEY.names).limit(wanted).toArrow().to_pylist()[-1]
    return tuple(found[f] for f in _KEY.names)


def _before(key: tuple[int, int, int]) -> Column:
    low, own, row = (F.lit(x).cast("bigint") for x in key)
    return (F.col("low") < low) | ((F.col("low") == low) & ((F.col("id") < own) | ((F.col("id") == own) & (F.col("row") < row))))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """Draw ``percent`` of the documents (doc_id, text) with ``min_words`` words that look most like ``target`` (text).

    One row per row of ``docs``: doc_id, n_features, weight, score, rank, n_words. rank counts the drawn documents
    from 1 in descending score, ties to smaller ids, and is null for the others. A null text has no words; a null id
    counts as an empty one and comes last among ties; rows that tie in score and id, such as repeated ones, come in the order of their
    places in the written table. An empty target gives every bucket a gain by the corpus alone; an empty table gives
    no rows. Other columns are left out.
    """
    gains = bucket_gains(bucket_counts(target), bucket_counts(docs))
    scored = weigh(docs, gains).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    rows = staged(scored.withColumn("row", F.monotonically_increasing_id()), "weights")
    last = F.lit((1 << 63) - 1)
    keyed = rows.withColumns({"low": -F.col("score"), "id": F.coalesce("doc_id", last)})
    able = F.col("n_words") >= min_words
    cut = cutoff_key(keyed.where(able), percent * rows.where(able).count() // 100)
    out = ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    none = F.lit(None).cast("bigint").alias("rank")
    if cut is None:
        return rows.withColumn("rank", none).select(*out)
    before, at = _before(cut), F.col("row") == cut[2]
    drawn = able & (before | at)
    winners = global_rank(keyed.where(drawn), [F.col(f) for f in _KEY.names])
    return winners.select(*out).unionByName(keyed.where(~drawn).withColumn("rank", none).select(*out))
