"""Exact top-k inner products by a Voronoi join.

Vectors become integers floor(256 x).  Pivots split data and queries into
Voronoi cells.  A cell's summary holds its radius and the distances of the
vectors nearest to its pivot p.  For a query q and any x of the cell,

    q.p - |q||x - p|  <=  q.x  <=  q.p + |q||x - p|,

so the k-th greatest lower bound over all summaries is a score that q's answer
reaches in any case, and only cells whose upper bound (with the radius) reaches
it can hold part of the answer.  Queries, the smaller side, are replicated to
just those cells; each cell is cut into blocks of bounded size and solved
locally with exact integer products, block by block, and the blocks' bests meet
in one last ranking.  Nothing is approximate: pruned cells can't hold an answer.
"""

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..sources.scratch import materialize
from .sampling import thin_out

SCALE = 256
PIVOTS = 48              # at least; more for more vectors, by their square root
MOST_PIVOTS = 4096
DATA_BLOCK = 8192        # vectors of a cell that meet in one task
QUERY_BLOCK = 2048       # queries that meet them
SAMPLE = 16              # candidates for a pivot, per pivot

LONG = 2 ** 63
DIGITS = 700             # more than any product of doubles has
_LARGEST = 1.7976931348623157e308

_CELLED = "vec_id long, vec array<double>, cell int, distance double, query boolean"


def quantize(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec): integer vectors, as doubles, of rows without null, nan or infinite components.

    256 x is exact in doubles, and from 2**53 on a whole number; where it exceeds the
    doubles it is their bound.
    """
    x = F.col("embedding")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    whole = lambda y: F.when(F.abs(y) < 2.0 ** 53, F.floor(y).cast("double")).otherwise(
        F.greatest(F.lit(-_LARGEST), F.least(y, F.lit(_LARGEST))))
    return (vectors.filter(x.isNotNull() & F.col("vec_id").isNotNull()).filter(F.coalesce(sound, F.lit(False)))
            .select(F.col("vec_id").cast("long").alias("vec_id"),
                    F.transform(x, lambda v: whole(v.cast("double") * SCALE)).alias("vec")))


def _matrix(column, dim):
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _by_dimension(column):
    """(dimension, rows with it) of an array column."""
    lengths = np.array([len(v) for v in column]) if len(column) else np.zeros(0, int)
    for dim in np.unique(lengths):
        yield int(dim), np.flatnonzero(lengths == dim)


def choose_pivots(vectors: DataFrame, count: int) -> dict[int, np.ndarray]:
    """Pivots by dimension: of a bounded hashed sample, those farthest from one another."""
    some = thin_out(vectors, "vec_id", 2 * count * SAMPLE)
    rows = (some.select("vec").distinct().orderBy(F.xxhash64("vec"), "vec").limit(count * SAMPLE).collect())
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r.vec), []).append(r.vec)
    out = {}
    for dim, vs in by.items():
        m = np.array(vs, np.float64).reshape(len(vs), dim)
        picked, near = [0], ((m - m[0]) ** 2).sum(1)
        while len(picked) < min(count, len(m)) and near.max() > 0:
            picked.append(int(near.argmax()))
            near = np.minimum(near, ((m - m[picked[-1]]) ** 2).sum(1))
        out[dim] = m[picked]
    return out


def _cell_number(dim: int, cell: int) -> int:
    return dim * MOST_PIVOTS + cell


def _assign(pivots, every):
    def run(batches):
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            for dim, rows in _by_dimension(batch.column("vec")):
                vecs = batch.column("vec").take(pa.array(rows))
                m = _matrix(vecs, dim)
                p = pivots.get(dim, np.zeros((1, dim)))
                with np.errstate(all="ignore"):      # very large components overflow; any cell will do for them
                    d = ((m ** 2).sum(1)[:, None] + (p ** 2).sum(1)[None, :] - 2 * m @ p.T) if dim else np.zeros((len(rows), 1))
                    cell = d.argmin(1)
                    # as differences: exact for integers, and rounded only by the root
                    distance = np.sqrt(((m - p[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[rows]), vecs.cast(pa.list_(pa.float64())),
                     pa.array([_cell_number(dim, c) for c in cell], pa.int32()), pa.array(distance),
                     pa.array(ids[rows] % every == 0)],
                    ["vec_id", "vec", "cell", "distance", "query"])
    return run


def summaries(data: DataFrame, k: int) -> dict[int, tuple]:
    """Per cell: vectors, radius, distances of the k nearest to the pivot that are no queries."""
    sizes = data.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).collect()
    order = Window.partitionBy("cell").orderBy("distance")
    near = (data.filter("NOT query").select("cell", "distance").withColumn("r", F.row_number().over(order))
            .filter(F.col("r") <= k).groupBy("cell").agg(F.sort_array(F.collect_list("distance")).alias("near")).collect())
    near = {r.cell: r.near for r in near}
    return {r.cell: (r.n, r.radius, near.get(r.cell, [])) for r in sizes}


def _route(pivots, cells, k):
    """For each query the cells that may hold part of its answer."""
    by: dict[int, list] = {}
    for c in sorted(cells):
        by.setdefault(c // MOST_PIVOTS, []).append(c)

    def run(batches):
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            for dim, rows in _by_dimension(batch.column("vec")):
                here = by.get(dim, [])
                if not here:
                    continue
                m = _matrix(batch.column("vec").take(pa.array(rows)), dim)
                p = pivots.get(dim, np.zeros((1, dim)))[[c % MOST_PIVOTS for c in here]]
                with np.errstate(all="ignore"):
                    dot, norm = m @ p.T, np.sqrt((m ** 2).sum(1))[:, None]
                    radius = np.array([cells[c][1] for c in here])
                    far = radius.max() + np.sqrt((p ** 2).sum(1)).max(initial=0)
                    slack = 1e-9 * (1 + norm * (1 + far))
                    low = np.concatenate([dot[:, i:i + 1] - norm * np.array(cells[c][2])[None, :]
                                          for i, c in enumerate(here) if cells[c][2]] or [np.zeros((len(m), 0))], 1)
                    least = (np.partition(low, -k, axis=1)[:, -k][:, None] if low.shape[1] >= k
                             else np.full((len(m), 1), -np.inf))
                    # a bound that overflowed to nan rules nothing out
                    need = ~(dot + norm * radius[None, :] + slack < least - slack)
                q, c = np.nonzero(need)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[rows][q]), pa.array(np.array(here)[c], pa.int32())], ["query_id", "cell"])
    return run


def _ranked(query, vec, score, beyond):
    """beyond: where the score is at the bound of long, the true one as digits that sort alike."""
    return pa.table({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(vec, pa.int64()),
                     "score": pa.array(score, pa.int64()), "beyond": pa.array(beyond, pa.string())})


def _solve(k):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """left: queries (query_id, qvec), right: data (vec_id, vec) of one block."""
        if not left.num_rows or not right.num_rows:
            return _ranked([], [], [], [])
        dim = len(left.column("qvec")[0])
        q, x = _matrix(left.column("qvec"), dim), _matrix(right.column("vec"), dim)
        qid, xid = left.column("query_id").to_numpy(), right.column("vec_id").to_numpy()
        order = np.argsort(xid, kind="stable")
        x, xid = x[order], xid[order]
        with np.errstate(over="ignore"):
            bound = dim * np.abs(q).max(initial=0) * np.abs(x).max(initial=0)
        # floats hold whole numbers up to 2**53 exactly, longs up to 2**63; beyond, Python integers do
        if bound >= 2 ** 62:
            q, x = (np.array([[int(v) for v in row] for row in m], object).reshape(m.shape) for m in (q, x))
        elif bound >= 2 ** 52:
            q, x = q.astype(np.int64), x.astype(np.int64)
        out = [[], [], [], []]
        if q.dtype == object:
            for i, row in zip(qid, q @ x.T if dim else np.zeros((len(q), len(x)), int).astype(object)):
                best = heapq.nsmallest(k, ((-s, j) for s, j in zip(row, xid) if j != i))
                out[0] += [i] * len(best)
                out[1] += [j for _, j in best]
                out[2] += [max(-LONG + 1, min(LONG - 1, -s)) for s, _ in best]
                out[3] += [None if abs(s) < LONG else f"{-s + (s > 0) * 10 ** DIGITS:0{DIGITS}d}" for s, _ in best]
            return _ranked(*out)
        for lo in range(0, len(q), 256):
            s = (q[lo:lo + 256] @ x.T).astype(np.int64)
            own = qid[lo:lo + 256][:, None] == xid[None, :]
            for i in range(len(s)):
                row = np.where(own[i], np.iinfo(np.int64).min, s[i])
                m = min(k, len(row) - int(own[i].sum()))
                if m <= 0:
                    continue
                floor = np.partition(row, len(row) - m)[len(row) - m]
                above = np.flatnonzero(row > floor)
                ties = np.flatnonzero((row == floor) & ~own[i])[:m - len(above)]   # smaller ids stand first
                best = np.concatenate([above, ties])
                out[0] += [qid[lo + i]] * len(best)
                out[1] += xid[best].tolist()
                out[2] += row[best].tolist()
                out[3] += [None] * len(best)
        return _ranked(*out)
    return run


def top_products(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: the k greatest inner products of each query.

    vectors: vec_id long, embedding array of numbers; further columns are
    ignored.  Queries are the vectors whose vec_id is divisible by ``every``;
    candidates are all vectors of the same dimension but those with the query's
    own vec_id.  Ties go to the smaller vec_id.  Null vectors, null vec_ids and
    vectors with a null, nan or infinite component take no part.  Rows that repeat a vec_id are
    candidates each; as queries they count once, with the greatest vector.
    A query with fewer candidates returns them all, one without returns no row.
    A score beyond 2**63 - 1 either way is given as that bound; ranks follow the true scores.
    """
    sound = materialize(quantize(vectors), "quantized")
    pivots = choose_pivots(sound, max(PIVOTS, min(MOST_PIVOTS, math.isqrt(sound.count()) // 8)))
    data = materialize(sound.mapInArrow(_assign(pivots, every), _CELLED), "cells")
    cells = summaries(data, k)
    queries = data.filter("query").groupBy(F.col("vec_id").alias("query_id")).agg(F.max("vec").alias("qvec"))
    routes = (queries.select(F.col("query_id").alias("vec_id"), F.col("qvec").alias("vec"))
              .mapInArrow(_route(pivots, cells, k), "query_id long, cell int"))
    routes = routes.join(queries, "query_id")
    blocks = {c: -(-v[0] // DATA_BLOCK) for c, v in cells.items()}
    slices = max(1, -(-(queries.count() or 1) // QUERY_BLOCK))
    large = {c: n for c, n in blocks.items() if n > 1} or {-1: 1}
    wide = F.coalesce(F.element_at(F.map_from_arrays(F.array(*map(F.lit, large)), F.array(*map(F.lit, large.values()))),
                                   F.col("cell")), F.lit(1))
    left = (routes.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(slices)).cast("int"))
            .withColumn("block", F.explode(F.sequence(F.lit(0), wide - 1))))
    left = materialize(left, "routes")
    # data travel to the slices of queries that want their cell, and to no other
    right = (data.select("vec_id", "vec", "cell")
             .withColumn("block", F.pmod(F.xxhash64("vec_id", "vec"), wide).cast("int"))
             .join(left.select("cell", "block", "part").distinct().toDF("c", "b", "part2"),
                   F.expr("cell = c AND block = b")).select("vec_id", "vec", "c", "b", "part2"))
    keys = ["cell", "block", "part"]
    best = (left.groupBy(*keys).cogroup(right.groupBy("c", "b", "part2"))
            .applyInArrow(_solve(k), "query_id long, vec_id long, score long, beyond string"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


TOP_SQL = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5"""
