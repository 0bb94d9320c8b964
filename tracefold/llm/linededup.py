"""Line dedup by pairwise alignment.

A line is hashed without the white space around it.  Every repeated line knows
its first holder, the smallest doc_id.  Each further holder is paired with the
first one, so pairs stay linear in the repeated lines; a pair is aligned by
patience diff, and by a longest common subsequence where no line is unique.
The aligned common blocks are deleted from the later document, and what is left of
it is aligned again until the two share no line, so that blocks that were moved
or repeated go, too.  One rule holds however many documents share a line.
"""

from bisect import bisect_left
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..sources.scratch import materialize

BLANK = 0
LCS_CELLS = 1 << 28     # bits of one table of a longest common subsequence


def line_hashes(text: str | None) -> list[int]:
    """Signed 64-bit hash of each line, BLANK for white space."""
    if not text:
        return []
    out = []
    for line in text.split("\n"):
        line = line.strip()
        h = xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) if line else BLANK
        out.append(h - (1 << 64) if h >= 1 << 63 else h)
    return out


def _longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs, sorted by their first, whose second numbers increase (patience sorting)."""
    tops, piles, back = [], [], []
    for i, (_, b) in enumerate(pairs):
        p = bisect_left(tops, b)
        if p == len(tops):
            tops.append(b)
            piles.append(i)
        else:
            tops[p], piles[p] = b, i
        back.append(piles[p - 1] if p else -1)
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def _lcs_rows(a: list, b: list):
    """After each line of b the bits of a: 0 where the subsequence with this prefix of a is one longer."""
    places, full = {}, (1 << len(a)) - 1
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    row = full
    for x in b:
        hit = row & places.get(x, 0)
        row = (row + hit | row - hit) & full
        yield row


def _lcs_lengths(a: list, b: list) -> list[int]:
    """Length of the longest common subsequence of b with each prefix of a."""
    row = (1 << len(a)) - 1
    for row in _lcs_rows(a, b):
        pass
    out = [0]
    for bit in reversed(bin(row)[2:].zfill(len(a))) if a else ():
        out.append(out[-1] + (bit == "0"))
    return out


def longest_common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence; long stretches are halved until a table is small."""
    both = set(a) & set(b)
    at_a, at_b = ([i for i, x in enumerate(y) if x in both] for y in (a, b))
    a, b = [a[i] for i in at_a], [b[j] for j in at_b]
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 == a1 or b0 == b1:
            continue
        if b1 - b0 > 1 and (a1 - a0) * (b1 - b0) > LCS_CELLS:
            half = (b0 + b1) // 2
            left = _lcs_lengths(a[a0:a1], b[b0:half])
            right = _lcs_lengths(a[a0:a1][::-1], b[half:b1][::-1])[::-1]
            cut = a0 + max(range(len(left)), key=lambda i: left[i] + right[i])
            todo += [(a0, cut, b0, half), (cut, a1, half, b1)]
            continue
        rows = list(_lcs_rows(a[a0:a1], b[b0:b1]))
        i, j = a1 - a0, b1 - b0
        while i and j:
            if rows[j - 1] >> i - 1 & 1:
                i -= 1
                continue
            j -= 1
            if not j or rows[j - 1] >> i - 1 & 1:
                i -= 1
                out.append((at_a[a0 + i], at_b[b0 + j]))
    return sorted(out)


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched positions of equal lines in a and b, increasing in both.

    Lines unique in both stretches are anchors; equal lines next to anchors and
    at the ends of a stretch match too; stretches between matches are handled alike,
    those without an anchor by a longest common subsequence.
    """
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        place_a, place_b = {}, {}
        for place, lines, lo, hi in ((place_a, a, a0, a1), (place_b, b, b0, b1)):
            for i in range(lo, hi):
                place[lines[i]] = -1 if lines[i] in place else i
        anchors = [(i, place_b[x]) for x, i in place_a.items()
                   if i >= 0 and x != BLANK and place_b.get(x, -1) >= 0]
        anchors = _longest_increasing(sorted(anchors))
        if not anchors:
            out += [(a0 + i, b0 + j) for i, j in longest_common(a[a0:a1], b[b0:b1])]
            continue
        last_a, last_b = a0, b0
        for i, j in anchors:
            todo.append((last_a, i, last_b, j))
            out.append((i, j))
            last_a, last_b = i + 1, j + 1
        todo.append((last_a, a1, last_b, b1))
    return sorted(out)


def _chains(earlier: list[int], later: list[int], places: list[int]) -> list[list[tuple[int, int]]]:
    """Further alignments that together match every shared line of later at ``places``, each increasing on both sides.

    Each line, matched to its first place in earlier, goes to the alignment whose last match lies
    closest before it; no fewer alignments could hold them.
    """
    first = {}
    for i, x in enumerate(earlier):
        first.setdefault(x, i)
    lasts, chains = [], []                  # last places of the alignments, ascending
    for j in places:
        i = first.get(later[j], -1) if later[j] != BLANK else -1
        if i < 0:
            continue
        at = bisect_left(lasts, i) - 1
        if at < 0:
            lasts.insert(0, i)
            chains.insert(0, [(i, j)])
        else:
            lasts[at] = i
            chains[at].append((i, j))
    return chains


def _blocks(matches: list[tuple[int, int]], later: list[int]) -> list[int]:
    """Places in later of runs that follow each other on both sides and hold a line that is not blank."""
    out, run = [], []
    for i, j in [*matches, (-9, -9)]:
        if run and (i != run[-1][0] + 1 or j != run[-1][1] + 1):
            if any(later[q] != BLANK for _, q in run):
                out += [q for _, q in run]
            run = []
        run.append((i, j))
    return out


def common_blocks(earlier: list[int], later: list[int]) -> list[int]:
    """Positions in later of the blocks that repeated alignment with earlier finds.

    The documents are aligned, the common blocks are taken out of later, and what is left is
    aligned again, until no line is shared: a block that was moved goes by a later
    alignment.  Rounds that find little are followed by one that finds the rest.
    """
    held = set(earlier) - {BLANK}
    left, out = list(range(len(later))), []
    while True:
        shared = sum(later[j] in held for j in left)
        if not shared:
            return sorted(out)
        matches = patience(earlier, [later[j] for j in left])
        gone = _blocks([(i, left[j]) for i, j in matches], later)
        if 8 * len(gone) < shared:
            gone += [q for chain in _chains(earlier, later, sorted(set(left) - set(gone))) for q in _blocks(chain, later)]
        out += gone
        gone = set(gone)
        left = [j for j in left if j not in gone]


def _hash_rows(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([line_hashes(t.as_py()) for t in batch.column("text")],
                                              pa.list_(pa.int64()))], ["doc_id", "lines"])


def _align(batches):
    for batch in batches:
        gone = [common_blocks(e, d) for e, d in zip(batch.column("earlier").to_pylist(),
                                                    batch.column("later").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(gone, pa.list_(pa.int32()))], ["doc_id", "gone"])


def _remove(gone_name: str, hot_name: str):
    def run(batches):
        names = None
        for batch in batches:
            names = names or [n for n in batch.schema.names if n not in (gone_name, hot_name)]
            texts, total, removed = [], [], []
            for text, gone, hot in zip(batch.column("text"), batch.column(gone_name).to_pylist(),
                                       batch.column(hot_name).to_pylist()):
                text = text.as_py()
                lines = text.split("\n") if text else []
                drop = set(gone or ())
                if hot:
                    hot = set(hot)
                    drop.update(i for i, h in enumerate(line_hashes(text)) if h in hot)
                total.append(len(lines))
                removed.append(len(drop))
                texts.append("\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else text)
            out = {n: batch.column(n) for n in names} | {
                "text": pa.array(texts, pa.string()), "n_lines": pa.array(total, pa.int32()),
                "n_removed": pa.array(removed, pa.int32())}
            yield pa.RecordBatch.from_pydict(out)
    return run


def dedup_lines(docs: DataFrame, rare: int | None = None) -> DataFrame:
    """docs without lines that an earlier document holds; adds n_lines, n_removed.

    docs: doc_id long, text string; further columns pass through, but n_lines and
    n_removed are replaced.  Lines end at "\\n".
    Earlier means smaller doc_id.  Blank lines only go inside a deleted block.
    A text whose lines are all deleted becomes empty; null texts stay null with
    0 lines, rows without doc_id stay as they are.  doc_id is a key: rows that
    repeat it must repeat the text and lose the same lines.  Lines repeated
    inside one document stay, unless another document held them first.  With
    ``rare``, lines in more documents than that go without alignment, so that
    blank lines between them stay; other lines fare alike.
    """
    docs = docs.drop("n_lines", "n_removed")
    taken = {c.lower() for c in docs.columns}
    # names of our own that no column of the caller has
    key, gone_name, hot_name = (next(n for i in count() if (n := f"{c}_{i}") not in taken) for c in ("id", "gone", "hot"))
    lines = materialize(
        docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .mapInArrow(_hash_rows, "doc_id long, lines array<long>").dropDuplicates(["doc_id"]), "lines")
    held = lines.select("doc_id", F.explode(F.array_distinct("lines")).alias("h")).filter(F.col("h") != BLANK)
    # written before it is joined back: a plain join can be split where a line is hot
    repeated = materialize(held.groupBy("h").agg(F.count("*").alias("df"), F.min("doc_id").alias("first"))
                           .filter("df > 1"), "repeated-lines")
    hits = materialize(held.join(repeated, "h").filter("doc_id <> first"), "line-hits")
    pairs = (hits if rare is None else hits.filter(F.col("df") <= rare)).select("doc_id", "first").distinct()
    gone = (pairs.join(lines.withColumnRenamed("lines", "later"), "doc_id")
            .join(lines.toDF("first", "earlier"), "first").mapInArrow(_align, "doc_id long, gone array<int>"))
    gone = gone.select("doc_id", "gone", F.lit(None).cast("long").alias("hot"))
    hot = hits.filter(F.lit(False) if rare is None else F.col("df") > rare).select("doc_id", F.lit(None).cast("array<int>").alias("gone"), F.col("h").alias("hot"))
    # at most one entry per line of the document
    changes = gone.union(hot).groupBy(F.col("doc_id").alias(key)).agg(
        F.array_distinct(F.flatten(F.collect_list("gone"))).alias(gone_name), F.collect_list("hot").alias(hot_name))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return (docs.join(changes, F.col("doc_id") == F.col(key), "left").drop(key)
            .mapInArrow(_remove(gone_name, hot_name), f"{schema}, n_lines int, n_removed int"))
