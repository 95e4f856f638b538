"""Best-fit packing into sequences of several permitted lengths.

A document longer than the largest length gives full sequences and a rest, so
nothing is cut off.  Rests are dealt into blocks of bounded size by hash, and
each block is packed by itself: longest first, into the open bin with the
least room that suffices.  Where none suffices a bin is opened, and its size is
chosen with regard to the lengths that are left: for each permitted size it is
reckoned which of them would fill it, longest first, and what the bin would
cost for each token after it shrinks to its contents.  Which size is cheapest
for one bin isn't always best for all, so a block is packed once more for each
permitted size, with bins of at least that size, and the cheapest of these
packings counts.  At the end every bin shrinks to the least permitted size that
holds its contents.  Blocks lose at most a few partly filled bins each.

The items are written once, with their lengths, so texts are read once.

Defined results: a length that is null or not positive has no tokens and its
row has no bin; repeated rows are items of their own; items of one length are
told apart by their order; an empty table gives an empty table; other columns
pass through on every segment's row, and ``segment``, ``start``, ``n_tokens``,
``bin_id``, ``bin_capacity`` and ``bin_offset`` replace columns of that name.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkmap.llm.common import SPACE_CLASS, materialise, tune

#: Items that one task packs together.
BLOCK_ITEMS = 20_000


@dataclass(frozen=True)
class Sizes:
    """Permitted sequence lengths and what a bin of each costs: its tokens, a fixed part, and attention's quadratic part."""

    capacities: tuple[int, ...] = (512, 1024, 2048, 4096)
    fixed: float = 32.0
    quadratic: float = 1 / 65536

    def cost(self, capacity: int) -> float:
        return self.fixed + capacity + self.quadratic * capacity * capacity


class Left:
    """How many items of each length are still to be packed."""

    def __init__(self, lengths: list[int]):
        self.count = Counter(lengths)
        self.sizes = sorted(self.count)

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            del self.count[n]
            self.sizes.pop(bisect_left(self.sizes, n))

    def fill(self, room: int) -> int:
        """Tokens of the items that would go into a bin with so much room, longest first."""
        used, k = 0, len(self.sizes)
        while True:
            k = bisect_right(self.sizes, room - used, 0, k)
            if not k or used == room:
                return used
            k -= 1
            n = self.sizes[k]
            used += n * min(self.count[n], (room - used) // n)


def _packed(lengths: list[int], order: list[int], sizes: Sizes, least: int | None) -> tuple[float, list[int], list[int], list[int]]:
    """Cost, bins, offsets and final capacities, with bins of at least a size, or (None) of the size that is cheapest with what is left."""
    bin_of, offset = [0] * len(lengths), [0] * len(lengths)
    used: list[int] = []
    room: list[int] = []  # distinct free amounts, ascending
    by_room: dict[int, list[int]] = {}
    caps = sorted(sizes.capacities)
    left = Left(lengths)

    def shrunk(n: int) -> int:
        return caps[bisect_left(caps, n)]

    def opened(n: int) -> int:
        fit = caps[bisect_left(caps, n) :]
        if least is not None:
            return max(fit[0], least)
        full = {c: n + left.fill(c - n) for c in fit}
        return min(fit, key=lambda c: (sizes.cost(shrunk(full[c])) / full[c], c))

    def put(b: int, free: int) -> None:
        if free:
            if free not in by_room:
                by_room[free] = []
                insort(room, free)
            by_room[free].append(b)

    for i in order:
        n = lengths[i]
        left.take(n)
        k = bisect_left(room, n)
        if k < len(room):
            free = room[k]
            b = by_room[free].pop()
            if not by_room[free]:
                del by_room[free]
                room.pop(k)
        else:
            free, b = opened(n), len(used)
            used.append(0)
        bin_of[i], offset[i] = b, used[b]
        used[b] += n
        put(b, free - n)
    final = [shrunk(u) for u in used]
    return sum(map(sizes.cost, final)), bin_of, offset, final


def pack_block(lengths: list[int], sizes: Sizes) -> tuple[list[int], list[int], list[int]]:
    """For items of given lengths: bin, offset in it, and the final capacity of each bin."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    return min((_packed(lengths, order, sizes, least) for least in (None, *sorted(sizes.capacities))), key=lambda x: x[0])[1:]


def word_tokens(text: Column) -> Column:
    """Words of a text and one end token."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")).cast("long") + 1


def pack(items: DataFrame, length_column: str, sizes: Sizes | None = None, id_column: str = "doc_id", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """A row for each segment: the item's columns, ``segment``, ``start`` and ``n_tokens`` in the item, ``bin_id``, ``bin_capacity``, ``bin_offset``."""
    sizes = sizes or Sizes()
    spark = tune(items.sparkSession)
    largest = max(sizes.capacities)
    own = ("segment", "start", "n_tokens", "bin_id", "bin_capacity", "bin_offset")
    n = F.greatest(F.coalesce(F.col(length_column).cast("long"), F.lit(0)), F.lit(0))
    # written once: what follows reads lengths, not texts
    base = materialise(items.withColumn("__n", n).drop(*[x for x in own if x != id_column]), "items")
    last = F.floor(F.greatest(F.col("__n") - 1, F.lit(0)) / largest)
    segments = base.withColumn("segment", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn("start", F.col("segment") * largest).withColumn("n_tokens", F.least(F.lit(largest), F.col("__n") - F.col("start"))).drop("__n")
    count = base.count()
    blocks = max(1, math.ceil(count / block_items))
    # the row's own number keeps repeated rows from one block
    block = F.pmod(F.xxhash64(F.col(id_column), F.monotonically_increasing_id()), F.lit(blocks))
    kept = [f for f in segments.schema.fields]
    schema = T.StructType([*kept, T.StructField("bin_id", T.StringType()), T.StructField("bin_capacity", T.LongType()), T.StructField("bin_offset", T.LongType())])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([id_column, "segment"], kind="stable").reset_index(drop=True)
        bins, offsets, caps = pack_block([int(x) for x in pdf["n_tokens"]], sizes)
        pdf["bin_id"] = [f"{key[0]}-{b}" for b in bins]
        pdf["bin_capacity"] = np.array(caps, np.int64)[bins]
        pdf["bin_offset"] = np.array(offsets, np.int64)
        return pdf.drop(columns="__block")

    rests = segments.where((F.col("n_tokens") > 0) & (F.col("n_tokens") < largest)).withColumn("__block", block).groupBy("__block").applyInPandas(run, schema)
    full = segments.where(F.col("n_tokens") == largest).select("*", F.concat_ws("-", F.lit("full"), F.monotonically_increasing_id().cast("string")).alias("bin_id"), F.lit(largest).cast("long").alias("bin_capacity"), F.lit(0).cast("long").alias("bin_offset"))
    none = segments.where(F.col("n_tokens") == 0).select("*", F.lit(None).cast("string").alias("bin_id"), F.lit(None).cast("long").alias("bin_capacity"), F.lit(None).cast("long").alias("bin_offset"))
    return rests.unionByName(full).unionByName(none)
