"""Best-fit packing of token sequences into bins of several permitted lengths.

Pieces are placed from the longest down, each into the open bin with the least room that still takes it. When
none does, a new bin opens at the length whose cost per token it can expect to hold is least. At the end each
bin shrinks to the smallest permitted length that holds its contents. Which lengths may be opened is decided
jointly: every ceiling is tried over the whole group and the one with the least total cost after shrinking wins.

Pieces are dealt into groups of about ``group_items`` by a hash, and groups are packed apart. A group needs
neither texts nor other groups, and only its last few bins suffer from its edge.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import staged
from threadloom.llm.token_counts import count_tokens

CAPACITIES = (512, 1024, 2048, 4096, 8192)
GROUP_ITEMS = 50_000
SEQUENCE_COST = 32


def sequence_cost(capacity: int) -> float:
    """Padded tokens and a fixed cost of each sequence, in tokens."""
    return capacity + SEQUENCE_COST


def _fill(lengths: list[int], allowed: list[int], ceiling: int, cost: Callable[[int], float]) -> tuple[list[int], list[int]]:
    """The bin of each length, longest first, and what each bin holds."""
    bins: list[int] = []
    room_of: list[int] = []
    held: list[int] = []
    open_at: dict[int, list[int]] = {}  # bins by the room they have left
    rooms = 0  # bit r is set while a bin with room r is open
    rest = sum(lengths)
    for length in lengths:
        fits = rooms >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            where = open_at[room].pop()
            if not open_at[room]:
                rooms ^= 1 << room
        else:
            sizes = [c for c in allowed if length <= c <= ceiling] or [min(c for c in allowed if c >= length)]
            where, room = len(held), min(sizes, key=lambda c: (cost(c) / min(c, rest), c))
            held.append(0)
            room_of.append(room)
        rest -= length
        held[where] += length
        room -= length
        if room:
            open_at.setdefault(room, []).append(where)
            rooms |= 1 << room
        bins.append(where)
    return bins, held


def pack_lengths(lengths: np.ndarray, allowed: tuple[int, ...], cost: Callable[[int], float]) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each length (already longest first, none above the largest) and the final length of each bin."""
    sizes = np.array(sorted(allowed))
    costs = np.array([cost(int(c)) for c in sizes])
    best = None
    for ceiling in sizes.tolist():
        bins, held = _fill(lengths.tolist(), sizes.tolist(), ceiling, cost)
        final = np.searchsorted(sizes, held)
        total = costs[final].sum()
        if best is None or total < best[0]:
            best = total, np.array(bins, np.int64), sizes[final]
    return best[1], best[2]


def pack(
    items: DataFrame, capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = sequence_cost, group_items: int = GROUP_ITEMS
) -> DataFrame:
    """Place ``items`` (doc_id long, n_tokens long) into bins; one row per piece.

    Items above the largest capacity are cut into pieces of it and a rest. Columns: doc_id, piece (from 0),
    piece_start (first token within the item), n_tokens, bin_id, capacity, bin_offset. An item whose length is
    null or below 1 has one row with 0 tokens and null bin. Repeated rows are separate items. Other columns are
    left out. An empty table gives no rows.
    """
    if not capacities or min(capacities) < 1:
        raise ValueError("capacities must be positive")
    top = max(capacities)
    rows = staged(
        items.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)).cast("bigint").alias("n"))
        .withColumn("item", F.monotonically_increasing_id()),
        "lengths",
    )
    cut = rows.select("doc_id", "item", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / top) - 1, F.lit(0)))).alias("piece"), "n")
    pieces = cut.select(
        "doc_id", "item", "piece", (F.col("piece") * top).alias("piece_start"),
        F.least(F.lit(top), F.col("n") - F.col("piece") * top).cast("bigint").alias("n_tokens"),
    )
    placed = pieces.where("n_tokens > 0")
    n = rows.agg(F.sum(F.ceil(F.col("n") / top))).first()[0] or 0
    groups = max(1, -(-n // group_items))

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n_tokens", "item", "piece"], ascending=[False, True, True], ignore_index=True)
        lengths = group["n_tokens"].to_numpy()
        bins, sizes = pack_lengths(lengths, capacities, cost)
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(lengths[order])
        first = np.searchsorted(bins[order], bins[order])
        offset = np.empty(len(bins), np.int64)
        offset[order] = ends - lengths[order] - (ends - lengths[order])[first]
        return group.assign(bin_id=(int(group["group"].iloc[0]) << 32) + bins, capacity=sizes[bins], bin_offset=offset)[OUT]

    OUT = ["doc_id", "piece", "piece_start", "n_tokens", "bin_id", "capacity", "bin_offset"]
    schema = "doc_id long, piece long, piece_start long, n_tokens long, bin_id long, capacity long, bin_offset long"
    keyed = placed.withColumns({"group": F.pmod(F.xxhash64("item", "piece"), F.lit(groups)), "null": F.col("doc_id").isNull(), "doc_id": F.coalesce("doc_id", F.lit(0))})
    OUT.append("null")
    bins = keyed.groupBy("group").applyInPandas(place, schema + ", null boolean")
    bins = bins.withColumn("doc_id", F.when(~F.col("null"), F.col("doc_id"))).drop("null")
    none = F.lit(None).cast("bigint")
    empty = pieces.where("n_tokens <= 0").select("doc_id", "piece", "piece_start", "n_tokens", none.alias("bin_id"), none.alias("capacity"), none.alias("bin_offset"))
    return bins.unionByName(empty)


def token_lengths(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the tokens of each whole text with its end token; a null text has the end alone."""
    counted = count_tokens(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), path)
    return counted.select("doc_id", (F.col("n_tokens") + 1).alias("n_tokens"))
