"""Sharding: minimax contiguous partition over ordered atomic groups.

Documents of equal text form one atomic group.  Groups stand in the order of
their text's MD5, and a shard is a run of groups.  The smallest feasible
capacity is found by binary search with a greedy check, as for an array of
sizes, but the array stays in Spark: the driver only knows the summed sizes of
MD5 prefixes.  With prefixes instead of groups the greedy check gives a
pessimistic answer (cut only between known prefixes) and an optimistic one
(cut anywhere inside a prefix that still holds several groups).  Prefixes in
which some cut may fall are opened by more digits until both answers agree;
what the driver holds is bounded by the prefixes opened, whatever the number
of groups.

Groups larger than an even share each take a shard first, so that a text that
is a third of the corpus doesn't set the capacity of the others.
"""

import bisect
from itertools import accumulate

from pyspark.sql import DataFrame, Window, functions as F

from ..sources.scratch import materialize

DIGITS = 3           # hexadecimal digits by which a prefix is opened: 4096 ways
CELL_ROWS = 100_000  # rows of all shards whose slots are counted together, about


class _Line:
    """Known prefixes in order: where each begins, how large it is, whether it is one group."""

    def __init__(self, rows):
        self.rows = sorted(rows)                       # (prefix, size, groups)
        self.ends = list(accumulate(r[1] for r in self.rows))
        self.total = self.ends[-1] if self.rows else 0

    def down(self, x):
        """Greatest known boundary at or below x."""
        i = bisect.bisect_right(self.ends, x)
        return self.ends[i - 1] if i else 0

    def reach(self, x, optimistic):
        """How far a shard may stretch that must end at or below x."""
        x = min(x, self.total)
        i = bisect.bisect_right(self.ends, x)
        if optimistic and i < len(self.rows) and self.rows[i][2] > 1:
            return x
        return self.ends[i - 1] if i else 0

    def cuts(self, capacity, shards, optimistic):
        at, out = 0, []
        for _ in range(shards):
            at = self.reach(at + capacity, optimistic)
            out.append(at)
        return out

    def smallest(self, shards, optimistic):
        lo = -(-self.total // shards)
        hi = self.total
        while lo < hi:
            mid = (lo + hi) // 2
            if self.cuts(mid, shards, optimistic)[-1] >= self.total:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def unsure(self, low, high):
        """Prefixes of several groups that lie between positions low and high."""
        i = bisect.bisect_right(self.ends, low)
        out = []
        while i < len(self.rows) and (self.ends[i - 1] if i else 0) < high:
            if self.rows[i][2] > 1:
                out.append(self.rows[i][0])
            i += 1
        return out


def balanced_cuts(line: _Line, capacity: int, shards: int) -> list[int]:
    """Boundaries near even shares, none of the shards over ``capacity``."""
    late = line.cuts(capacity, shards, False)
    early, at = [0] * shards, line.total       # earliest cuts that leave a feasible rest
    for i in range(shards - 1, 0, -1):
        j = bisect.bisect_left(line.ends, at - capacity)
        at = line.ends[j] if at - capacity > 0 else 0
        early[i - 1] = at
    out, at = [], 0
    for i in range(shards - 1):
        ideal = line.total * (i + 1) // shards
        top = min(late[i], line.down(at + capacity))
        near = line.down(ideal)
        j = bisect.bisect_right(line.ends, ideal)
        above = line.ends[j] if j < len(line.ends) else line.total
        pick = near if ideal - near <= above - ideal else above
        at = max(early[i], at, min(pick, top))
        out.append(at)
    return out


def plan_cuts(groups: DataFrame, shards: int) -> tuple[list[str], list[str]]:
    """(group keys that take a shard of their own, first keys of the further shards)."""
    total = groups.agg(F.sum("size")).first()[0] or 0
    alone = []
    # fewer than ``shards`` groups can exceed an even share, so this list is bounded
    for key, size in (groups.filter(F.col("size") * shards > total)
                      .orderBy(F.desc("size"), "key").limit(shards - 1).select("key", "size").collect()):
        if size * (shards - len(alone)) > total:
            alone.append(key)
            total -= size
    rest = groups.filter(~F.col("key").isin(alone)) if alone else groups
    shards -= len(alone)

    def summed(df, digits):
        return [(r[0], r[1], r[2]) for r in df.groupBy(F.substring("key", 1, digits).alias("p"))
                .agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()]
    digits, known = DIGITS, summed(rest, DIGITS)
    while True:
        line = _Line(known)
        low, high = (line.smallest(shards, o) for o in (True, False))
        spread = set()
        for a, b in zip(line.cuts(low, shards, False)[:-1], line.cuts(high, shards, True)[:-1]):
            spread.update(line.unsure(a, b) if high > low else ())
        for i in range(1, shards):
            spread.update(line.unsure(line.total * i // shards - 1, line.total * i // shards + 1))
        if not spread:
            break
        width = {len(p) for p in spread}
        known = [r for r in known if r[0] not in spread]
        for w in width:
            opened = [p for p in spread if len(p) == w]
            known += summed(rest.filter(F.substring("key", 1, w).isin(opened)), w + DIGITS)
        digits += DIGITS
    ends = balanced_cuts(line, high, shards)
    firsts = []
    for e in ends:
        j = bisect.bisect_right(line.ends, e)
        firsts.append(line.rows[j][0] if j < len(line.rows) else "g")   # "g": after all keys
    return alone, firsts


def shard_of(key, alone: list[str], firsts: list[str]):
    inside = F.lit(len(alone))
    for first in firsts:
        inside = inside + (key >= first).cast("int")
    for i, k in enumerate(alone):
        inside = F.when(key == k, F.lit(i)).otherwise(inside)
    return inside.cast("int")


def assign_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """docs with shard and slot, sizes near equal (law ``bytes``).

    docs: doc_id long, text string, further columns pass through; columns named
    size, shard or slot are replaced.  A document's size is its UTF-8 bytes
    plus 1; a null text counts as empty.  Equal texts share a shard, repeated
    rows included.  slot counts the rows of a shard from 0 without gaps, by
    cell of doc_id and then doc_id, so ties share no slot.  With fewer groups
    than shards some shards stay empty.  No rows give no rows.
    """
    kept = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    # the caller's columns travel in one struct, so none of their names meets one used here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    text = F.col("row.text")
    key = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    rows = rows.withColumn("size", F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1)
    groups = materialize(rows.select(key.alias("key"), "size").groupBy("key")
                         .agg(F.sum("size").alias("size"), F.count("*").alias("rows")), "groups")
    alone, firsts = plan_cuts(groups, shards)
    expected = groups.agg(F.sum("rows")).first()[0] or 0
    numbered = number_rows(rows.withColumn("shard", shard_of(key, alone, firsts)), F.col("row.doc_id"), key, expected)
    return numbered.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "size", "shard", "slot")


def number_rows(rows: DataFrame, doc_id, key, expected: int) -> DataFrame:
    """Add slot, the place of each row in its shard.

    Rows are counted in cells of about CELL_ROWS rows by a hash of doc_id, of the text's key where
    there is none, so neither a shard nor a hot text is numbered in one task; a cell's
    first slot is the number of rows in the cells before it.
    """
    cells = max(16, expected // CELL_ROWS)
    spread = F.when(doc_id.isNull(), F.xxhash64(key)).otherwise(F.xxhash64(doc_id))
    rows = rows.withColumn("cell", F.pmod(spread, F.lit(cells)).cast("int"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(
        rows.groupBy("shard", "cell").agg(F.count("*").alias("n"))
        .select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")), "cells")
    place = F.row_number().over(Window.partitionBy("shard", "cell").orderBy(doc_id)) - 1
    return rows.join(starts, ["shard", "cell"]).withColumn("slot", (F.col("start") + place).cast("long")).drop("cell", "start")
