"""How five filters of a text collection work together, under every order of applying them.

Each document has a mask that says which filters it fails, and each mask one wide integer with a field for every
(order, step): 1 where that step removes such a document. The documents of a part are counted by mask, the
integers are added up, each as often as its mask occurs, and the fields of the sum are the counts of all steps.
A field is wide enough for all documents of the part, so no field runs over into the next. A second family of
integers does the same for documents that fail a step's filter after an earlier one removed them.

Counting by mask happens in Spark before anything is added up, so a part sends at most 2^filters x 4 rows,
whatever share of the documents it holds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import staged, text_key

SPACES = r"[\x20\x09-\x0D]+"
MIN_WORDS = 200
DISTINCT_PERCENT = 50
CAPITAL_PERCENT = 2
MARKS = r"[#$%&*|]"
LETTERS = "ABCDE"  # the last is the filter of repeated texts


@dataclass(frozen=True)
class StepCounters:
    """The wide integers of every mask of ``n`` filters; field ``order * n + step``, orders as ``permutations`` gives them."""

    n: int

    @cached_property
    def orders(self) -> list[tuple[int, ...]]:
        return list(permutations(range(self.n)))

    @property
    def fields(self) -> int:
        return len(self.orders) * self.n

    def _outcomes(self, mask: int) -> tuple[list[int], list[int]]:
        """The fields of one mask: where it is removed, and where it would have been had it not gone before."""
        removed, redundant = [0] * self.fields, [0] * self.fields
        for o, order in enumerate(self.orders):
            gone = False
            for step, k in enumerate(order):
                if mask >> k & 1:
                    (redundant if gone else removed)[o * self.n + step] = 1
                    gone = True
        return removed, redundant

    def packed(self, width: int) -> list[tuple[int, int]]:
        """Both integers of every mask, with fields of ``width`` bytes."""

        def wide(flags: list[int]) -> int:
            return int.from_bytes(b"".join(f.to_bytes(width, "little") for f in flags), "little")

        return [(wide(removed), wide(redundant)) for removed, redundant in map(self._outcomes, range(1 << self.n))]

    def unpacked(self, total: int, width: int) -> np.ndarray:
        """The fields of a sum."""
        data = np.frombuffer(total.to_bytes(self.fields * width, "little"), np.uint8).reshape(self.fields, width)
        out = np.zeros((self.fields, 8), np.uint8)
        out[:, :width] = data
        return out.view("<i8")[:, 0]


def width_for(documents: int) -> int:
    """Bytes of a field that can hold a count of all documents."""
    return (documents.bit_length() + 7) // 8 or 1


def failures(text: Column) -> Column:
    """Mask of the filters that look at one text: short, repetitive, shouting, marked. A null text is the empty one."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")

    def mask(words: Column) -> Column:
        n = F.size(words).cast("bigint")
        rules = (
            n < MIN_WORDS,
            100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * n,
            100 * F.regexp_count(text, F.lit("[A-Z]")).cast("bigint") > CAPITAL_PERCENT * F.length(text),
            text.rlike(MARKS),
        )
        return sum((F.when(rule, 1 << k).otherwise(0) for k, rule in enumerate(rules[1:], start=1)), F.when(rules[0], 1).otherwise(0))

    # The lambda names the words, which three rules use, so that the text is cut once.
    return F.get(F.transform(F.array(words), mask), F.lit(0))


def masked_documents(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask of every row, and k1, k2 that stand for its text; written once, so that no lost task cuts texts again.

    A null source is the empty string. The mask has the filter of repeated texts not yet.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    k1, k2 = text_key(text)
    part = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return staged(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), part.alias("part"), failures(text).alias("mask"), k1.alias("k1"), k2.alias("k2")), "masks")


def count_masks(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic, n: the documents of every part by all five filters and by label.

    A text is repeated if a smaller id has the same one; a row without an id neither is a copy nor makes one. Equal
    texts have equal masks, so copies are counted by text, part and label before they meet, and a text that a third
    of all rows hold reaches its task as a few rows. Several labels of one id count if any says 1; an id without
    label, and a row without id, is neither good nor toxic.
    """
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    known = known.where("good OR toxic").withColumn("salt", F.lit(0).cast("bigint"))
    # Rows without an id have no label; a number that is never 0 spreads them over the tasks.
    salt = F.when(F.col("doc_id").isNull(), F.col("k1").bitwiseOR(1)).otherwise(0)
    labelled = rows.select("k1", "k2", "part", "mask", F.coalesce("doc_id", F.lit(0)).alias("id"), salt.alias("salt")).join(known, ["id", "salt"], "left")
    alike = ["k1", "k2", "part", "mask", "good", "toxic"]
    no = F.lit(False)
    per_id = labelled.withColumns({"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)}).groupBy("id", "salt", *alike).agg(F.count(F.lit(1)).alias("c"))
    own = F.when(F.col("salt") == 0, F.col("id"))
    groups = per_id.groupBy(*alike).agg(
        F.sum("c").alias("n"), F.sum(F.when(F.col("salt") == 0, F.col("c"))).alias("ids"), F.min(own).alias("first"), F.min_by("c", own).alias("firsts")
    )
    leads = F.col("first") == F.min("first").over(Window.partitionBy("k1", "k2"))
    split = groups.withColumn("copies", F.coalesce(F.col("ids") - F.when(leads, F.col("firsts")).otherwise(0), F.lit(0)))
    either = F.array(
        F.struct(F.col("mask").alias("mask"), (F.col("n") - F.col("copies")).alias("n")),
        F.struct((F.col("mask") + (1 << (len(LETTERS) - 1))).alias("mask"), F.col("copies").alias("n")),
    )
    counted = split.select("part", "good", "toxic", F.inline(either)).where("n > 0")
    return counted.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def step_counts(counts: DataFrame, letters: Sequence[str] = LETTERS) -> DataFrame:
    """Every part's outcome of each order and step, from counts by mask; see ``audit_filters``."""
    counters = StepCounters(len(letters))
    names = ["".join(letters[k] for k in order) for order in counters.orders]
    filters = np.array(counters.orders).ravel()
    orders, steps = np.repeat(names, counters.n).tolist(), np.tile(np.arange(1, counters.n + 1), len(names))
    fields = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

    def audit(part: str, groups: list[dict], packed: dict[int, list[tuple[int, int]]]) -> pa.RecordBatch:
        total = sum(g["n"] for g in groups)
        width = width_for(total)
        if width not in packed:
            packed[width] = counters.packed(width)
        wide = packed[width]
        sums = [0, 0, 0, 0]
        alone = np.zeros(counters.n, np.int64)
        for g in groups:
            mask, n = g["mask"], g["n"]
            removed, redundant = wide[mask]
            sums[0] += n * removed
            sums[1] += n * redundant
            sums[2] += n * removed * g["good"]
            sums[3] += n * removed * g["toxic"]
            if mask.bit_count() == 1:
                alone[mask.bit_length() - 1] += n
        removed, redundant, good, toxic = (counters.unpacked(s, width) for s in sums)
        kept = total - removed.reshape(-1, counters.n).cumsum(1).ravel()
        shapley = np.array([removed[filters == k].sum() for k in range(counters.n)])
        values = (kept, removed, redundant, alone[filters], good, toxic, shapley[filters])
        columns = [pa.array([part] * counters.fields, pa.string()), pa.array(orders), pa.array(steps, pa.int32()), *(pa.array(v, pa.int64()) for v in values)]
        return pa.RecordBatch.from_arrays(columns, names=["part", "filter_order", "step", *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed: dict[int, list[tuple[int, int]]] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                (row,) = batch.slice(at, 1).to_pylist()
                yield audit(row["part"], row["groups"], packed)

    # At most 2^filters x 4 structs a part.
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("groups"))
    return parts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{f} long" for f in fields))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What every step of every order of the filters A to E does to each part of ``docs`` (doc_id, text, source).

    A fails with under 200 words, B with under half of its words distinct, C with over 2 % capitals A to Z among
    its characters, D with any of ``#$%&*|``, E if a smaller id has the same text. One row per part, order and
    step: part, filter_order, step, and within the part kept, removed, redundant (failing this filter after an
    earlier one removed them), unique_fails (failing this filter alone), good_lost and toxic_lost (removed here, by
    label), shapley (removed by this filter, summed over all orders). Null and empty sources are one part; null
    texts are empty, so copies of each other; repeated rows are counted each and are no copies of themselves. An
    empty table has no parts and gives no rows. Other columns play no part.
    """
    return step_counts(count_masks(masked_documents(docs), labels))
