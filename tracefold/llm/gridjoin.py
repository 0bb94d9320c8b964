"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors with a cosine of c or more lie at most epsilon = sqrt(2 - 2c) apart,
and so do their projections on any orthonormal axes.

1. Equal vectors become one weighted row.
2. Axes: principal directions of a bounded sample.  Cells of width epsilon along
   the leading ones order the vectors; sorted by cell, and inside a cell by its
   halves, they are cut into blocks of bounded size.  Blocks are intervals of
   that sequence and carry the box of their projections.
3. Intervals are joined recursively: from the whole sequence down, a pair of
   intervals is replaced by the pairs of their parts unless the boxes lie more than
   epsilon apart.  This runs on block boxes as a join per level.
4. Each remaining pair of blocks meets in one task, where the recursion goes on
   down to LEAF vectors: leaves whose balls are provably apart are skipped, leaves
   whose balls are provably within epsilon count as linked throughout, all others
   are compared by a matrix product in double precision.  Products next to the
   threshold are summed again without rounding.
   A task returns a count per vector and a spanning forest, never the pairs.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.scratch import materialize
from .components import components
from .sampling import thin_out

AXES = 16                # leading principal directions that order vectors and bound boxes
SAMPLE = 4096            # vectors the directions are taken from, at most about
BLOCK = 4096             # vectors of a block
LEAF = 64                # vectors that meet at the end of the recursion
FAN = 8                  # parts of an interval
SLACK = 1e-9             # distances and cosines closer than this are never decided by a bound


def sound_vectors(vectors: DataFrame) -> DataFrame:
    """(id, least, weight, vec, dim): distinct vectors that can link, numbered, with least vec_id and rows."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("vec"))
    return (rows.filter("vec_id IS NOT NULL AND vec IS NOT NULL").filter(fine & F.exists("vec", lambda v: v != 0))
            .groupBy("vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
            .select(F.monotonically_increasing_id().alias("id"), "least", "weight", "vec", F.size("vec").alias("dim")))


def unit(m: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled first, so that neither large nor small components overflow."""
    m = m / np.abs(m).max(1, initial=0, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """By dimension: leading principal directions of unit vectors, as columns."""
    by: dict[int, list] = {}
    for r in thin_out(vectors, "id", SAMPLE).select("dim", "vec").orderBy(F.xxhash64("id"), "id").limit(2 * SAMPLE).collect():
        by.setdefault(r.dim, []).append(r.vec)
    out = {}
    for dim, rows in by.items():
        m = unit(np.array(rows, np.float64))
        _, _, axes = np.linalg.svd(m - m.mean(0), full_matrices=False)
        out[dim] = axes[:AXES].T
    return out


def _place(axes):
    """Projections on the axes of the vector's dimension; none where the sample held no such vector."""
    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                place = unit(_matrix(part.column("vec"))) @ axes.get(int(dim), np.zeros((int(dim), 0)))
                yield part.append_column("place", pa.array(list(place), pa.list_(pa.float64())))
    return run


def _number(batches):
    """Place of each row among those of its dimension in the sorted partition."""
    seen: dict[int, int] = {}
    for batch in batches:
        out = []
        for dim in batch.column("dim").to_pylist():
            out.append(seen.get(dim, 0))
            seen[dim] = out[-1] + 1
        yield batch.append_column("seq", pa.array(out, pa.int64()))


def ordered_blocks(vectors: DataFrame, epsilon: float) -> DataFrame:
    """(block, dim, id, weight, vec, place): vectors in grid order, cut into numbered intervals."""
    placed = vectors.select("id", "weight", "vec", "dim").mapInArrow(_place(principal_axes(vectors)),
                                "id long, weight long, vec array<double>, dim int, place array<double>")
    cell = F.transform("place", lambda x: F.floor(x / epsilon))
    fine = F.transform("place", lambda x: F.floor(4 * x / epsilon))
    keys = ["dim", "cell", "fine", "id"]
    # ids end the key, so a cell with many vectors spreads over partitions
    placed = materialize(placed.withColumn("cell", cell).withColumn("fine", fine), "placed")
    rows = (placed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("cell", "fine")
            .withColumn("part", F.spark_partition_id())
            .mapInArrow(_number, "id long, weight long, vec array<double>, dim int, place array<double>, part int, seq long"))
    rows = materialize(rows, "sequence")
    # places in the whole sequence, from one row per partition: blocks don't hang on how it is dealt
    counts = sorted((r.dim, r.part, r.n) for r in rows.groupBy("dim", "part").agg(F.count("*").alias("n")).collect())
    start, first, before, last = [], 0, 0, None
    for dim, part, n in counts:
        if dim != last:
            first, before, last = first + -(-before // BLOCK), 0, dim
        start.append((dim, part, first, before))
        before += n
    offset = vectors.sparkSession.createDataFrame(start, "dim int, part int, first long, before long")
    block = F.col("first") + F.floor((F.col("before") + F.col("seq")) / BLOCK)
    return rows.join(F.broadcast(offset), ["dim", "part"]).select(block.alias("block"), "dim", "id", "weight", "vec", "place")


def _apart(epsilon: float):
    """Boxes (lo, hi) and (lo2, hi2) are provably more than epsilon apart."""
    gaps = F.zip_with(F.arrays_zip("lo", "hi"), F.arrays_zip("lo2", "hi2"), lambda a, b: F.greatest(
        a["lo"] - b["hi2"], b["lo2"] - a["hi"], F.lit(0.0)))
    return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g) > epsilon * epsilon + SLACK


def near_intervals(blocks: DataFrame, epsilon: float) -> DataFrame:
    """(block, other), block <= other, of blocks that are not provably apart, found from the top down."""
    lows = [F.min(F.get("place", i)) for i in range(AXES)]
    highs = [F.max(F.get("place", i)) for i in range(AXES)]
    none = lambda xs: F.filter(F.array(*xs), lambda x: x.isNotNull())  # noqa: E731 - short places end in nulls
    levels = [materialize(blocks.groupBy("dim", "block").agg(none(lows).alias("lo"), none(highs).alias("hi")), "boxes")]
    most = levels[0].agg(F.max("block")).first()[0]
    if most is None:
        return levels[0].select("block", F.col("block").alias("other"))
    at = lambda c, i: F.get(c, i)
    while most > 0:
        most //= FAN
        up = levels[-1].groupBy("dim", F.expr(f"block div {FAN}").alias("block")).agg(
            none([F.min(at("lo", i)) for i in range(AXES)]).alias("lo"),
            none([F.max(at("hi", i)) for i in range(AXES)]).alias("hi"))
        levels.append(materialize(up, "boxes"))
    pairs = levels[-1].select("dim", "block", F.col("block").alias("other"))
    for boxes in reversed(levels[:-1]):
        parts = lambda c: F.explode(F.sequence(F.col(c) * FAN, F.col(c) * FAN + FAN - 1))
        pairs = (pairs.select("dim", parts("block").alias("block"), "other")
                 .select("dim", "block", parts("other").alias("other")).filter("block <= other")
                 .join(boxes, ["dim", "block"])
                 .join(boxes.toDF("dim", "other", "lo2", "hi2"), ["dim", "other"]))
        pairs = materialize(pairs.filter(~_apart(epsilon)).select("dim", "block", "other"), "intervals")
    return pairs.select("block", "other")


class _Forest:
    """Components of the rows of one task, and the links that joined them."""

    def __init__(self, n):
        self.label, self.links = np.arange(n), []

    def join(self, rows, cols, hit):
        """Joins rows and columns along the hits; only links between components are kept."""
        while True:
            new = hit & (self.label[rows][:, None] != self.label[cols][None, :])
            at = int(new.argmax())
            i, j = rows[at // len(cols)], cols[at % len(cols)]
            if not new.flat[at]:
                return
            self.label[self.label == self.label[i]] = self.label[j]
            self.links.append((int(i), int(j)))


def _balls(m):
    """Centres and radii of LEAF rows at a time."""
    starts = range(0, len(m), LEAF)
    centres = np.array([m[s:s + LEAF].mean(0) for s in starts])
    radii = np.array([np.sqrt(((m[s:s + LEAF] - c) ** 2).sum(1)).max() for s, c in zip(starts, centres)])
    return centres, radii


def exact_cosine(a, b) -> float:
    """Cosine in double precision, sums rounded once."""
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))


def links_between(x, y, raw_x, raw_y, weight_x, weight_y, least: float, same: bool):
    """Counts for rows of x and of y, and a spanning forest of (row of x, row of y).

    x, y: unit vectors, raw_x, raw_y: the vectors themselves; same: both blocks are one.
    """
    epsilon = math.sqrt(2 - 2 * least)
    count_x, count_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    forest = _Forest(len(x) + (0 if same else len(y)))
    shift = 0 if same else len(x)
    (cx, rx), (cy, ry) = _balls(x), _balls(y)
    for p in range(len(cx)):
        d = np.sqrt(((cx[p] - cy) ** 2).sum(1))
        maybe = np.flatnonzero(d - rx[p] - ry <= epsilon + SLACK)
        all_near = d + rx[p] + ry < epsilon - SLACK
        rows = np.arange(p * LEAF, min((p + 1) * LEAF, len(x)))
        for q in maybe[maybe >= p] if same else maybe:
            cols = np.arange(q * LEAF, min((q + 1) * LEAF, len(y)))
            if all_near[q]:
                hit = np.ones((len(rows), len(cols)), bool)
            else:
                dot = x[rows] @ y[cols].T
                hit = dot >= least
                for i, j in zip(*np.nonzero(np.abs(dot - least) < SLACK)):
                    hit[i, j] = exact_cosine(raw_x[rows[i]], raw_y[cols[j]]) >= least
            if same and p == q:
                np.fill_diagonal(hit, False)
            if not hit.any():
                continue
            count_x[rows] += hit @ weight_y[cols]
            if not (same and p == q):
                count_y[cols] += hit.T @ weight_x[rows]
            forest.join(rows, cols + shift, hit)
    return count_x, count_y, forest.links


def _block(table, suffix=""):
    """Ids, weights and vectors of a block, in its order."""
    ids, weight, at = (table.column(c + suffix).to_numpy() for c in ("id", "weight", "at"))
    order = np.lexsort((ids, at))
    return ids[order], weight[order], _matrix(table.column("vec" + suffix))[order]


def _compare(least):
    """Rows (id, n, null) with counts and (id, null, other) with links of one pair of blocks."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, weight, raw = _block(left)
        same = not right.num_rows
        ids2, weight2, raw2 = (ids, weight, raw) if same else _block(right, "2")
        x = unit(raw)
        n, n2, links = links_between(x, x if same else unit(raw2), raw, raw2, weight, weight2, least, same)
        if same:
            n, every = n + n2, ids
        else:
            n, every = np.concatenate([n, n2]), np.concatenate([ids, ids2])
        some = np.flatnonzero(n)
        blank = [None] * len(links)
        return pa.table({"id": pa.array(every[some].tolist() + [int(every[i]) for i, _ in links], pa.int64()),
                         "n": pa.array(n[some].tolist() + blank, pa.int64()),
                         "other": pa.array([None] * len(some) + [int(every[j]) for _, j in links], pa.int64())})
    return run


def near_vectors(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    vectors: vec_id long, embedding array of numbers; further columns are ignored.  Vectors of
    one dimension are linked if their cosine is ``least`` (over 0) or more.  n_links: rows linked
    directly, the row itself left out; component_id: the least vec_id reachable; kept: vec_id is
    component_id.  Vectors that are null, empty, zero, or hold a null, nan or infinite component
    link with nothing, nor do rows without vec_id, which get a null component and are
    kept.  Rows that repeat a vec_id are vectors of their own.  Rows with equal vectors are linked.
    No rows give no rows.
    """
    epsilon = math.sqrt(2 - 2 * least)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"))
    classes = materialize(sound_vectors(rows), "classes")
    blocks = materialize(ordered_blocks(classes, epsilon), "blocks")
    pairs = materialize(near_intervals(blocks, epsilon), "pairs")
    # inside a task rows keep the grid order of their leading axis
    part = blocks.select("block", "id", "weight", "vec", F.coalesce(F.get("place", F.lit(0)), F.lit(0.0)).alias("at"))
    left = pairs.join(part, "block")
    right = (pairs.filter("block <> other").toDF("first", "second")
             .join(part.toDF("second", "id2", "weight2", "vec2", "at2"), "second"))
    found = materialize(left.groupBy("block", "other").cogroup(right.groupBy("first", "second"))
                        .applyInArrow(_compare(least), "id long, n long, other long"), "links")
    counts = found.filter("other IS NULL").groupBy("id").agg(F.sum("n").alias("n"))
    comps = components(found.filter("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")))
    classes = classes.join(counts, "id", "left").join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
    classes = materialize(classes, "classes")
    named = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    known = classes.join(named, "component").select("vec", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    keyed = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.transform("embedding", lambda v: v.cast("double"))).alias("vec"))
    named = keyed.join(known, "vec", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return named.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
