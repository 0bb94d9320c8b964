"""Near-duplicate documents: fast similarity sketches, banding, exact confirmation.

The sketch follows Dahlgaard, Knudsen and Thorup, "Fast Similarity Sketching"
(2017): with t coordinates, round i < t throws every element of the set into a
hashed coordinate with value (i, hash); round i >= t offers every element to
coordinate i - t.  A coordinate keeps its smallest value, and rounds stop once
all are filled, so small sets fill every coordinate too and the share of equal
coordinates is concentrated around the similarity.

Work over the corpus:

1. one pass writes id, set size, set fingerprint, band keys and a byte per
   coordinate; texts stay where they are;
2. documents with equal sets become one class, by aggregation;
3. classes that share a band key are candidates.  Small buckets give their
   pairs, each pair once; of a large bucket each member first meets only the
   bucket's smallest id, so candidates stay linear in the memberships;
4. candidates whose sketches are too far apart to be linked (seven standard
   deviations) go; the others are confirmed on the full sets of words;
5. components.  A large bucket whose members are not yet all in one component
   is compared in full, inside tasks: blocks of bounded rows and shingles, counting common
   shingles by a matrix product, only between its largest component and the
   rest, returning a spanning forest and never the pairs.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.scratch import materialize
from .components import components
from .hashing import WordHasher, ascii_words, mix, seeds, shingle_hashes
import hashlib

COORDINATES = 128
BAND_ROWS = 4
SMALL_BUCKET = 32
BLOCK_SHINGLES = 1_000_000
BLOCK_ROWS = 2048        # a task compares two blocks: 64 MB of counts
CHUNK = 1_000_000
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_SEEDS = seeds(2 * COORDINATES, 7)


def sketch(sets: list[np.ndarray], t: int = COORDINATES) -> np.ndarray:
    """One row of t values per non-empty set; equal values mark equal coordinates."""
    out = np.full((len(sets), t), EMPTY, dtype=np.uint64)
    flat = out.reshape(-1)
    open_ = np.array([i for i, s in enumerate(sets) if len(s)], dtype=np.int64)
    for i in range(2 * t):
        if len(open_) == 0:
            break
        elements = np.concatenate([sets[j] for j in open_])
        row = np.repeat(open_, [len(sets[j]) for j in open_])
        h = mix(elements ^ _SEEDS[i])
        bin_ = (h % np.uint64(t)).astype(np.int64) if i < t else np.int64(i - t)
        value = (np.uint64(i) << np.uint64(56)) | (mix(h) >> np.uint64(8))
        np.minimum.at(flat, row * t + bin_, value)
        open_ = open_[(out[open_] == EMPTY).any(axis=1)]
    return out


def band_keys(sketches: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    n, t = sketches.shape
    bands = t // rows
    key = np.broadcast_to(seeds(bands, 3), (n, bands)).copy()
    for r in range(rows):
        key = mix(key ^ sketches[:, r:bands * rows:rows]) + np.uint64(r)
    return key.view(np.int64)


_SKETCH_SCHEMA = "doc_id long, n_shingles long, fp string, bands array<long>, sig binary"


def _sketcher(width: int):
    def one(ids, sets):
        sk = sketch(sets)
        keys = band_keys(sk)
        low = (sk & np.uint64(255)).astype(np.uint8)
        full = [len(s) > 0 for s in sets]
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array(ids, pa.int64()),
            "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
            "fp": pa.array([hashlib.md5(s.tobytes()).hexdigest() if ok else None
                            for s, ok in zip(sets, full)], pa.string()),
            "bands": pa.array([k if ok else None for k, ok in zip(keys, full)],
                              pa.list_(pa.int64())),
            "sig": pa.array([x.tobytes() if ok else None for x, ok in zip(low, full)],
                            pa.binary())})

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            ids, sets, held = [], [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                s = shingle_hashes(hasher(ascii_words(text.as_py())), width)
                ids.append(doc_id.as_py())
                sets.append(s)
                held += len(s)
                if held > CHUNK:
                    yield one(ids, sets)
                    ids, sets, held = [], [], 0
            if ids:
                yield one(ids, sets)
    return run


def _shingles(text: str, width: int) -> set:
    words = ascii_words(text)
    if len(words) <= width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(width))))


def linked(common, left, right, percent: int):
    """100 * intersection >= percent * union."""
    return 100 * common >= percent * (left + right - common)


def _near(least: int):
    """Keep pairs with at least ``least`` equal coordinates."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8)
                    .reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
            keep = (a == b).sum(axis=1) >= least
            yield batch.select(["a", "b"]).filter(pa.array(keep))
    return run


def _confirm(width: int, percent: int):
    def run(batches):
        last, left = None, set()
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch.column("a").to_pylist(), batch.column("text_a"),
                                 batch.column("text_b")):
                if a != last:
                    last, left = a, _shingles(ta.as_py(), width)
                right = _shingles(tb.as_py(), width)
                keep.append(linked(len(left & right), len(left), len(right), percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _compare_block(width: int, percent: int):
    """Links between the components of one block pair, as a spanning forest."""
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_pylist()
        comps = table.column("component").to_pylist()
        side = np.array(table.column("outside").to_pylist())
        code: dict = {}
        owner, col, sizes = [], [], []
        for i, text in enumerate(table.column("text")):
            s = _shingles(text.as_py(), width)
            sizes.append(len(s))
            for x in s:
                col.append(code.setdefault(x, len(code)))
            owner.extend([i] * len(s))
        code.clear()
        col, owner, sizes = np.array(col), np.array(owner), np.array(sizes)
        shared = np.bincount(col) > 1          # a shingle held once adds to no intersection
        keep = shared[col]
        col, owner = (np.cumsum(shared) - 1)[col[keep]], owner[keep]
        common = np.zeros((len(ids), len(ids)), np.float32)
        for lo in range(0, int(shared.sum()), 2048):
            here = (col >= lo) & (col < lo + 2048)
            m = np.zeros((len(ids), min(2048, int(shared.sum()) - lo)), np.float32)
            m[owner[here], col[here] - lo] = 1
            common += m @ m.T
        parent = {c: c for c in comps}

        def root(c):
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c
        out = []
        for i in np.flatnonzero(side):
            hit = linked(common[i].astype(np.int64), sizes[i], sizes, percent)
            for j in np.flatnonzero(hit):
                x, y = root(comps[i]), root(comps[j])
                if x != y:
                    parent[x] = y
                    out.append((ids[i], ids[j]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()),
                         "b": pa.array([y for _, y in out], pa.int64())})
    return run


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the ids; of rows that repeat an id, one with the greatest text."""
    return (docs.join(ids, docs.doc_id == ids.id, "left_semi")
            .groupBy(F.col("doc_id").alias("id")).agg(F.max("text").alias("text")))


def _deal(rest: DataFrame) -> DataFrame:
    """Members of unfinished buckets dealt to block pairs of bounded size.

    The bucket's largest component meets only the members outside it, and
    those also meet one another.
    """
    counts = rest.groupBy("bucket", "component").agg(F.count("*").alias("c"))
    home = counts.groupBy("bucket").agg(F.max_by("component", F.struct("c", "component"))
                                        .alias("home"))
    rest = rest.join(home, "bucket").withColumn("outside", F.col("component") != F.col("home"))

    def needed(here):
        """Blocks for the rows where ``here`` holds: neither shingles nor rows of one grow with the bucket."""
        return F.greatest(F.lit(1), F.ceil(F.sum(F.when(here, F.col("n_shingles"))) / BLOCK_SHINGLES),
                          F.ceil(F.count_if(here) / BLOCK_ROWS)).cast("int")
    blocks = rest.groupBy("bucket").agg(needed(F.col("outside")).alias("n_out"), needed(F.lit(True)).alias("n_all"))
    rest = rest.join(blocks, "bucket").withColumn("h", F.xxhash64("id"))
    own = F.pmod("h", F.when(F.col("outside"), F.col("n_out")).otherwise(F.col("n_all"))).cast("int")
    # outside block o meets outside block p >= o as (o, p) and home block g as (o, n_out + g)
    pairs = F.when(F.col("outside"), F.concat(
        F.transform(F.sequence(F.lit(0), F.col("n_out") - 1), lambda p: F.struct(
            F.least(F.col("own"), p).alias("x"), F.greatest(F.col("own"), p).alias("y"))),
        F.transform(F.sequence(F.lit(0), F.col("n_all") - 1), lambda g: F.struct(
            F.col("own").alias("x"), (F.col("n_out") + g).alias("y"))))
    ).otherwise(F.transform(F.sequence(F.lit(0), F.col("n_out") - 1), lambda o: F.struct(
        o.alias("x"), (F.col("n_out") + F.col("own")).alias("y"))))
    return rest.withColumn("own", own).select("bucket", "id", "component", "outside", F.inline(pairs))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Component of every document under links of at least ``percent`` % similarity.

    docs: doc_id long, text string; further columns are ignored.  Returns one
    row per row of docs: doc_id, n_shingles, component_id (smallest doc_id
    reachable over links), kept (doc_id = component_id; true without a doc_id).  Null, empty and
    blank texts have no shingles and no links.  A text shorter than ``width``
    words is one shingle.  Rows without doc_id have no component and no
    links.  doc_id is a key: rows that repeat it must repeat the text, and each
    gets the same answer.  No rows give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sk = materialize(docs.mapInArrow(_sketcher(width), _SKETCH_SCHEMA), "sketches")
    full = sk.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialize(full.groupBy("fp").agg(F.min("doc_id").alias("id")), "classes")
    reps = materialize(full.join(classes.select("id"), F.col("doc_id") == F.col("id"), "left_semi")
                       .dropDuplicates(["doc_id"])
                       .select(F.col("doc_id").alias("id"), "n_shingles", "sig", "bands"), "reps")
    members = reps.select("id", "n_shingles", F.explode("bands").alias("bucket"))
    buckets = (members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("leader"))
               .filter("n > 1"))
    members = materialize(members.join(buckets, "bucket"), "members")

    small = members.filter(F.col("n") <= SMALL_BUCKET)
    pairs = (small.select("bucket", F.col("id").alias("a"))
             .join(small.select("bucket", F.col("id").alias("b")), "bucket").filter("a < b")
             .select("a", "b")
             .union(members.filter((F.col("n") > SMALL_BUCKET) & (F.col("id") != F.col("leader")))
                    .select("leader", "id")).distinct())
    sigs = reps.select("id", "sig")
    p = percent / 100
    least = math.floor(COORDINATES * p - 7 * math.sqrt(COORDINATES * p * (1 - p)))
    near = materialize(
        pairs.join(sigs.toDF("a", "sig_a"), "a").join(sigs.toDF("b", "sig_b"), "b")
        .mapInArrow(_near(least), "a long, b long"), "near")
    large = members.filter(F.col("n") > SMALL_BUCKET)
    wanted = near.select("a").union(near.select("b")).union(large.select("id")).toDF("id").distinct()
    texts = materialize(_texts(docs, wanted), "texts")
    links = materialize(
        near.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
        .mapInArrow(_confirm(width, percent), "a long, b long"), "links")
    comps = components(links)

    large = (large.join(comps, "id", "left")
             .withColumn("component", F.coalesce("component", "id")))
    mixed = large.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    rest = materialize(large.join(mixed.filter("lo <> hi").select("bucket"), "bucket", "left_semi")
                       .select("bucket", "id", "component", "n_shingles"), "rest")
    if not rest.isEmpty():
        more = (_deal(rest).join(texts, "id").groupBy("bucket", "x", "y")
                .applyInArrow(_compare_block(width, percent), "a long, b long"))
        comps = components(materialize(
            more.union(comps.select("id", "component")), "links"))
    named = (classes.join(comps, "id", "left")
             .select("fp", F.coalesce("component", "id").alias("component")))
    return (sk.select("doc_id", "n_shingles", "fp").join(named, "fp", "left")
            .select("doc_id", "n_shingles",
                    F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component")),
                               F.col("doc_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def keep_one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Rows of docs, all columns, whose doc_id is its component; of rows repeating a doc_id, one.

    Rows without doc_id all stay.
    """
    gone = near_duplicates(docs, width, percent).filter("NOT kept").select("doc_id").distinct()
    named = (docs.filter("doc_id IS NOT NULL").join(gone, "doc_id", "left_anti")
             .dropDuplicates(["doc_id"]))
    return named.unionByName(docs.filter("doc_id IS NULL"))
