"""Prefix trie of conversations: a splitter skeleton and locally finished shards.

A conversation is a path: the SHA-256 digests of its turns, in order, as one
string of 64 hex digits a turn.  Nodes of the trie are the distinct prefixes of
paths.  Sorted by path, the members of a node lie side by side.

1. Equal paths become one weighted row first, so a group of copies is one row.
   The digest of the ids that end there is taken over id lists of bounded length,
   made from a range partition by (path, id): a hot path is many such lists.
2. A bounded sample of paths, weighted by their turns, gives splitters: each is
   the shortest prefix that tells a sampled path from the one before it.  Paths go
   to the shard between two splitters.
3. Only a proper prefix of a splitter can have members in two shards.  These
   prefixes and the root are the skeleton; its trie is broadcast.
4. A shard, sorted by path, is read once with a stack of open nodes.  Nodes off the
   skeleton are finished where they close; for skeleton nodes the shard returns one
   row of partial sums each, which an aggregation adds up.  A hot first turn is a
   skeleton node: its members are spread over the shards.
"""

from bisect import bisect_right
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..sources.scratch import materialize
from .sampling import thin_out

DIGEST = 64              # hex digits of a turn in a path
SHARD_TURNS = 10_000     # turns of distinct paths in a shard, about
SHARDS = 2048            # at most: bounds sample and skeleton
OVERSAMPLE = 16          # sampled paths per shard
SPLITTER_TURNS = 256     # a longer splitter is cut, which only affects balance
ID_LIST = 4096           # ids joined in one row
NO_IDS = hashlib.sha256(b"").hexdigest()

_NODES = ("skeleton int, conv_id long, depth long, parent long, parent_skeleton int, n_convs long, "
          "n_children long, n_leaves long, saved_tokens long, chars long, ends_sha256 string")


def with_borrowed_starts(turns: DataFrame, period: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Each conversation with its start taken from another: (conv_id, turn, role, text), and all conv_ids.

    With h = crc32(conv_id) % most: the first h turns of conversation
    conv_id - conv_id % period, then the own turns after the first h.  Turns are
    ordered by turn, null first, then by role and text, and numbered from 1; null roles and
    texts are empty.  Rows without conv_id are left out.  A conversation may be left without
    turns, so the ids come beside them.
    """
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"),
                         F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                         F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("conv_id IS NOT NULL")
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    turns = turns.withColumn("turn", F.row_number().over(order).cast("long"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    ids = turns.select("conv_id").distinct()
    starts = (turns.filter((F.col("turn") < most) & (F.col("conv_id") % period == 0))
              .withColumnRenamed("conv_id", "base"))
    borrowed = (ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % period).alias("base"), h.alias("h"))
                .join(starts, "base").filter("turn <= h").select("conv_id", "turn", "role", "text"))
    return turns.filter(F.col("turn") > h).unionByName(borrowed), ids


def _paths(turns: DataFrame, ids: DataFrame | None) -> DataFrame:
    """(conv_id, path, chars): digests of the turns in order, and their texts' code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    turn = F.struct("turn", role.alias("role"), digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    if ids is not None:
        none = F.lit(None).cast(rows.schema["t"].dataType)
        rows = rows.union(ids.select(F.col("conv_id").cast("long"), none))
    listed = (rows.filter("conv_id IS NOT NULL").groupBy("conv_id")
              .agg(F.array_sort(F.collect_list("t")).alias("t")))     # a null is not collected
    return listed.select("conv_id", F.array_join("t.digest", "").alias("path"), F.col("t.chars").alias("chars"))


def _join_ids(batches):
    """Sorted (leaf, conv_id) rows as lists of at most ID_LIST ids."""
    last, ids = None, []

    def row():
        return pa.RecordBatch.from_pydict({"leaf": [last], "first": pa.array([ids[0]], pa.int64()),
                                           "ids": [",".join(map(str, ids))]})
    for batch in batches:
        for leaf, i in zip(batch.column("leaf").to_pylist(), batch.column("conv_id").to_pylist()):
            if ids and (leaf != last or len(ids) == ID_LIST):
                yield row()
                ids = []
            last = leaf
            ids.append(i)
    if ids:
        yield row()


def _digest_ids(batches):
    """One SHA-256 per leaf over its id lists, which come in order."""
    last, digest = None, None
    for batch in batches:
        out = []
        for leaf, ids in zip(batch.column("leaf").to_pylist(), batch.column("ids").to_pylist()):
            if leaf == last:
                digest.update(b",")
            else:
                if digest:
                    out.append((last, digest.hexdigest()))
                last, digest = leaf, hashlib.sha256()
            digest.update(ids.encode())
        yield pa.RecordBatch.from_pydict({"leaf": pa.array([x for x, _ in out], pa.string()),
                                          "ends_sha256": pa.array([x for _, x in out], pa.string())})
    if digest:
        yield pa.RecordBatch.from_pydict({"leaf": [last], "ends_sha256": [digest.hexdigest()]})


def ends_of(paths: DataFrame) -> DataFrame:
    """(leaf, ends_sha256): digest of the ascending conv_ids of each path, comma-joined."""
    lists = materialize(paths.select("leaf", "conv_id").repartitionByRange("leaf", "conv_id")
                        .sortWithinPartitions("leaf", "conv_id")
                        .mapInArrow(_join_ids, "leaf string, first long, ids string"), "id-lists")
    return (lists.repartition("leaf").sortWithinPartitions("leaf", "first").select("leaf", "ids")
            .mapInArrow(_digest_ids, "leaf string, ends_sha256 string"))


def choose_splitters(paths: DataFrame) -> list[str]:
    """Prefixes of paths that cut the distinct paths into shards of about SHARD_TURNS turns."""
    turns = paths.agg(F.sum(F.length("path") / DIGEST + 1)).first()[0] or 0
    shards = min(SHARDS, int(turns // SHARD_TURNS) + 1)
    if shards == 1:
        return []
    # one turn more than a splitter may have still tells it from the path before
    start = F.substring("path", 1, SPLITTER_TURNS * DIGEST)
    sample = (thin_out(paths, "leaf", OVERSAMPLE * shards)
              .select(start.alias("path"), (F.length("path") / DIGEST + 1).alias("w")).collect())
    sample = sorted((r.path, r.w) for r in sample)
    total, held, out = sum(w for _, w in sample), 0.0, []
    for (before, w), (path, _) in zip(sample, sample[1:]):
        held += w
        if held < total * (len(out) + 1) / shards or path == before:
            continue
        same = _common(before, path)
        out.append(path[:(same + 1) * DIGEST])
    return sorted(set(out))


def _common(a: str, b: str) -> int:
    """Turns that two paths share at their start."""
    lo, hi = 0, min(len(a), len(b)) // DIGEST
    while lo < hi:                      # prefixes agree up to some length, then never again
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid * DIGEST] == b[:mid * DIGEST] else (lo, mid - 1)
    return lo


def skeleton_of(splitters: list[str]) -> list[str]:
    """The root and all proper prefixes of splitters: nodes that may have members in two shards."""
    return sorted({s[:d * DIGEST] for s in splitters for d in range(len(s) // DIGEST)} | {""})


def _shard(splitters):
    def run(batches):
        for batch in batches:
            shard = [bisect_right(splitters.value[0], p) for p in batch.column("path").to_pylist()]
            yield batch.append_column("shard", pa.array(shard, pa.int32()))
    return run


def _finish(trie):
    """Nodes of sorted shards: finished ones, and one row of partial sums per skeleton node."""
    def run(batches):
        number = {p: i for i, p in enumerate(trie.value[1])}
        out, stack, last, shard = [], [], "", None
        # an open node: [skeleton number or None, least id, members, children, leaves, saved, chars, ends, depth, kept rows]

        def close():
            s, least, n, children, leaves, saved, chars, ends, depth, below = stack.pop()
            up = stack[-1] if stack else None
            if s is None:
                leaves = leaves or 1
                saved += (n - 1) * chars
                row = [None, least, depth, None, None, n, children, leaves, saved, chars, ends or NO_IDS]
                for r in below:                       # children that waited for the least id
                    r[3] = least
                out.extend(below)
                if up[0] is None:
                    up[9].append(row)
                else:                                 # the parent's least id is known after the reduction
                    row[4] = up[0]
                    out.append(row)
            else:
                out.append([s, least, depth, None, None, n, children, leaves, saved, chars, ends])
            if up is not None:
                up[1], up[2] = min(up[1], least), up[2] + n
                up[3] += s is None                    # skeleton children are counted from the trie itself
                up[4] += leaves
                up[5] += saved

        def flush():
            cols = list(zip(*out)) if out else [[]] * 11
            kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
            names, kinds = zip(*((name, kinds[kind]) for name, kind in map(str.split, _NODES.split(", "))))
            rows = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], list(names))
            out.clear()
            return rows
        for batch in batches:
            for at, path, chars, n, least, ends in zip(*(batch.column(c).to_pylist() for c in (
                    "shard", "path", "chars", "n", "least", "ends_sha256"))):
                if at != shard:
                    while stack:
                        close()
                    stack.append([number[""], least, 0, 0, 0, 0, 0, None, 0, []])
                    last, shard = "", at
                same = _common(last, path)
                while len(stack) > same + 1:
                    close()
                for d in range(same + 1, len(path) // DIGEST + 1):
                    s = number.get(path[:d * DIGEST]) if stack[-1][0] is not None else None
                    stack.append([s, least, 0, 0, 0, 0, chars[d - 1], None, d, []])
                top = stack[-1]
                top[1], top[2], top[7] = min(top[1], least), top[2] + n, ends
                last = path
                if len(out) > 10_000:
                    yield flush()
        while stack:
            close()
        yield flush()
    return run


def prefix_trie(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per node of the trie of conversations.

    turns: conv_id long, turn, role string, text string; further columns are ignored.  Turns
    are ordered by turn, null first, then by role and digest.  Null role or text is empty.
    Rows without conv_id are left out.  ids: conv_ids that count even if they have no turns.
    Repeated rows are turns each.  No conversations give no rows.  A conversation's digests,
    64 characters a turn, are held in one row.

    Returns conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs,
    n_children, n_leaves (childless nodes of the subtree), saved_tokens (over the subtree, the
    sum of (n_convs - 1) times the code points of the node's last text), ends_sha256 (digest
    of the conv_ids that end at the node, ascending, comma-joined).
    """
    spark = turns.sparkSession
    paths = materialize(_paths(turns, ids).withColumn("leaf", F.sha2("path", 256)), "paths")
    distinct = paths.groupBy("leaf", "path", "chars").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"))
    distinct = materialize(distinct.join(ends_of(paths), "leaf"), "distinct-paths")

    splitters = choose_splitters(distinct)
    skeleton = skeleton_of(splitters)
    trie = spark.sparkContext.broadcast((splitters, skeleton))
    shards = distinct.select("path", "chars", "n", "least", "ends_sha256").mapInArrow(
        _shard(trie), "path string, chars array<long>, n long, least long, ends_sha256 string, shard int")
    shards = shards.repartitionById(len(splitters) + 1, F.col("shard")).sortWithinPartitions("shard", "path")
    solved = materialize(shards.mapInArrow(_finish(trie), _NODES), "nodes")

    number = {p: i for i, p in enumerate(skeleton)}
    frame = spark.createDataFrame(
        [(i, number[p[:-DIGEST]] if p else None, [number[p[:d * DIGEST]] for d in range(len(p) // DIGEST + 1)])
         for p, i in number.items()], "skeleton int, up int, line array<int>")
    sums = materialize(solved.filter("skeleton IS NOT NULL").groupBy("skeleton", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("chars").alias("chars"),
        F.max("ends_sha256").alias("ends_sha256")).join(frame, "skeleton"), "skeleton")
    # what a shard could not know: what skeleton nodes save themselves, and skeleton children
    below = (sums.select(F.explode("line").alias("skeleton"), ((F.col("n_convs") - 1) * F.col("chars")).alias("own"))
             .groupBy("skeleton").agg(F.sum("own").alias("own")))
    children = frame.filter("up IS NOT NULL").groupBy(F.col("up").alias("skeleton")).agg(F.count("*").alias("more"))
    whole = sums.join(below, "skeleton").join(children, "skeleton", "left")
    parents = sums.select(F.col("skeleton").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    count = F.col("n_children") + F.coalesce("more", F.lit(0))
    whole = whole.join(parents, "up", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", count.alias("n_children"),
        F.when(count == 0, F.lit(1).cast("long")).otherwise(F.col("n_leaves")).alias("n_leaves"),
        (F.col("saved_tokens") + F.col("own")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"))
    rest = (solved.filter("skeleton IS NULL").join(parents.withColumnRenamed("up", "parent_skeleton"), "parent_skeleton", "left")
            .select("conv_id", "depth", F.coalesce("parent", "parent_conv_id").alias("parent_conv_id"), "n_convs", "n_children",
                    "n_leaves", "saved_tokens", "ends_sha256"))
    return rest.unionByName(whole)
