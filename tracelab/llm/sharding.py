"""Sharding by an exact minimax contiguous partition of atomic groups."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelab.llm.common import plain_text, staged

SHARDS = 40
ROW_BYTES = 16  # added to the bytes of a text
FIRST_BITS, MORE_BITS = 14, 8  # order bits of the first look at the groups, and of each closer one
SPREAD = 512  # parts of a shard that number their rows apart


@dataclass
class Atom:
    """Neighbouring groups: their first place in the order, how many order bits they share, bytes and groups."""

    start: int
    bits: int
    size: int
    groups: int


def fits(prefix: list[int], capacity: int, shards: int) -> list[int] | None:
    """Greedy cuts (index of the first atom of each later shard) with no shard above ``capacity``; None if they do not fit."""
    cuts, at, n = [], 0, len(prefix) - 1
    for _ in range(shards):
        at = bisect_right(prefix, prefix[at] + capacity) - 1
        if at >= n:
            return cuts
        cuts.append(at)
    return None


def least_capacity(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """Smallest capacity that a contiguous partition into ``shards`` shards needs, by binary search, and the prefix sums."""
    prefix = [0]
    for s in sizes:
        prefix.append(prefix[-1] + s)
    low, high = max(max(sizes, default=0), -(-prefix[-1] // shards)), prefix[-1]
    while low < high:
        middle = (low + high) // 2
        if fits(prefix, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return high, prefix


def even_cuts(prefix: list[int], capacity: int, shards: int) -> list[int]:
    """Cuts of a partition within ``capacity``, each as near to its even place as that allows.

    Greedy cutting fills every shard to the brim and leaves the last ones short or empty. Cutting greedily from the end gives
    the earliest place that each cut may have; between that and the latest place (from the cut before) the one next to the
    even share is taken, which keeps every shard within the capacity.
    """
    n, total = len(prefix) - 1, prefix[-1]
    earliest, at = [], n
    for _ in range(shards - 1):
        low, high = 0, at
        while low < high:  # first index whose rest up to ``at`` is within the capacity
            middle = (low + high) // 2
            low, high = (low, middle) if prefix[at] - prefix[middle] <= capacity else (middle + 1, high)
        at = low
        earliest.append(at)
    cuts, at = [], 0
    for i, first in enumerate(reversed(earliest), 1):
        latest = bisect_right(prefix, prefix[at] + capacity) - 1
        ideal = total * i // shards
        near = bisect_right(prefix, ideal) - 1
        if near < n and prefix[near + 1] - ideal < ideal - prefix[near]:
            near += 1
        at = min(max(near, first, at), latest)
        cuts.append(at)
    return cuts


def _look(groups: DataFrame, bits: int, parents: list[Atom] | None) -> list[Atom]:
    """Atoms of ``bits`` order bits, of all groups or of those inside ``parents``."""
    place = F.shiftright("place", 63 - bits)
    rows = groups.withColumn("_at", place)
    if parents is not None:
        up = parents[0].bits
        wanted = groups.sparkSession.createDataFrame([(p.start >> (63 - up),) for p in parents], "_up bigint")
        rows = rows.withColumn("_up", F.shiftright("place", 63 - up)).join(F.broadcast(wanted), "_up", "left_semi")
    got = rows.groupBy("_at").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("groups")).collect()
    return sorted((Atom(r["_at"] << (63 - bits), bits, r["size"], r["groups"]) for r in got), key=lambda a: a.start)


def plan(groups: DataFrame, shards: int) -> tuple[list[int], list[int]]:
    """Places of groups that fill a shard alone, and places where the other shards start.

    ``groups`` has ``place`` (63 order bits) and ``size``. Groups of at least an even share of what is left stand alone, so
    that they do not set the others' capacity. The rest is partitioned exactly, from coarse to fine: atoms of many groups
    give a capacity that suffices, C. In any partition within C cut i lies between total - (shards - i) C and i C, so only
    atoms that reach into these short stretches are looked at closer, until those hold one group each; then the
    smallest capacity over atoms is the smallest over groups. The driver sees at most 2**FIRST_BITS sums at
    first and the few open atoms' parts later, never the groups.
    """
    total = groups.agg(F.sum("size")).first()[0] or 0
    alone: list[int] = []
    rest = shards
    giants = groups.orderBy(F.desc("size"), "place").limit(shards).collect()  # no more than ``shards`` can reach an even share
    for g in giants:
        if rest > 1 and g["size"] * rest >= total:
            alone.append(g["place"])
            total -= g["size"]
            rest -= 1
    if alone:
        groups = groups.where(~F.col("place").isin(alone))
    atoms, bits = _look(groups, FIRST_BITS, None), FIRST_BITS
    while True:
        capacity, prefix = least_capacity([a.size for a in atoms], rest)
        near = [
            a
            for a, x, y in zip(atoms, prefix, prefix[1:])
            if a.groups > 1 and any(y > total - (rest - i) * capacity and x < i * capacity for i in range(1, rest))
        ]
        if not near or bits >= 63:
            break
        bits = min(63, bits + MORE_BITS)
        # atoms that were coarse before and lie inside a stretch are all of the last depth, as the stretches only shrink
        finer = _look(groups, bits, near)
        gone = {a.start for a in near}
        atoms = sorted([a for a in atoms if a.start not in gone] + finer, key=lambda a: a.start)
    cuts = even_cuts(prefix, capacity, rest)
    places = [a.start for a in atoms]
    return alone, [places[c] if c < len(places) else (1 << 63) - 1 for c in cuts]


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """All columns of ``docs`` plus ``_size, _shard, _slot``: equal texts share a shard, shards are nearly equal in bytes.

    Size: UTF-8 bytes of the text (null: none) plus 16. Groups are equal texts (null texts are one group, empty texts another), in the
    order of a 63-bit hash of the text; two texts with one hash are one group. The cuts are constants in the plan, so no
    row moves for its shard. Slots are numbered from 0 in each shard without gaps: each shard's rows are split by a hash of
    id and text into ``SPREAD`` parts, numbered inside each (by id, then text hash), and shifted by the sizes of the parts before, so no
    shard is one task. Repeated rows get slots of their own. An empty table gives an empty result.
    """
    return _slots(_placed(docs, shards))


def _placed(docs: DataFrame, shards: int) -> DataFrame:
    size = (F.octet_length(plain_text()) + ROW_BYTES).cast("bigint")
    place = F.xxhash64(F.col("text").isNull(), F.col("text")).bitwiseAND(F.lit((1 << 63) - 1))
    sized = docs.withColumn("_size", size).withColumn("_place", place)
    groups = staged(sized.groupBy(F.col("_place").alias("place")).agg(F.sum("_size").alias("size")), "groups")
    alone, cuts = plan(groups, shards)
    number = F.lit(len(alone))
    for c in cuts:
        number = number + (F.col("_place") >= c).cast("int")
    for i, place_ in enumerate(alone):
        number = F.when(F.col("_place") == place_, i).otherwise(number)
    return sized.withColumn("_shard", number.cast("int"))


def _slots(placed: DataFrame) -> DataFrame:
    part = placed.withColumn("_part", F.pmod(F.xxhash64(F.col("doc_id"), F.col("_place")), F.lit(SPREAD)).cast("int"))
    # at most shards * SPREAD rows, whatever the input
    sizes = part.groupBy("_shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_shard", "_part").orderBy("doc_id", "_place")
    return (
        part.withColumn("_row", F.row_number().over(inside))
        .join(F.broadcast(offsets), ["_shard", "_part"])
        .withColumn("_slot", F.col("_before") + F.col("_row") - 1)
        .drop("_part", "_row", "_before", "_place")
    )


def report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``; texts stay behind before the shuffle."""
    placed = _placed(docs.select("doc_id", "text"), shards)
    thin = placed.select("doc_id", "_size", F.crc32(plain_text().cast("binary")).alias("text_crc32"), "_place", "_shard")
    return _slots(thin).select(
        "doc_id",
        F.col("_size").alias("size"),
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
