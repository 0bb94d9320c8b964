"""Benchmark decontamination: BM25 index of test items, block-max WAND, overlap check.

Test items are cut into pieces of at most PIECE words and indexed: a term's
impact in a piece is its BM25 weight as a share of what the piece scores with
itself, so a passage's score is the share of the piece it matches.  Training
documents are cut into passages of two half-windows; every passage is a query.

Per document, with arrays instead of cursors:

* WAND: very frequent terms, whose impacts in any one piece sum to less than
  the threshold, can't lift a piece over it alone.  Only the other terms open
  posting blocks.
* Block-max: pieces stand in blocks; a term's postings of a block hold their
  largest impact.  A block is opened for a passage only if block maxima plus
  the most the frequent terms can add reach the threshold.
* The pieces of opened blocks are scored exactly.

All pieces that reach the threshold are retrieved, none is dropped by rank.
Their items are then compared with the document: shares of question shingles
and answer words that the document holds.

The index is built from the items by joins and travels in blocks of bounded
size, so the benchmark may grow; each block of items costs one pass.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..sources.scratch import materialize

WORD = re.compile(r"\w+")
PIECE = 48               # words of an index piece, at most; half a passage
WORDS_AT_ONCE = 100_000
HALF = 64                # words of half a passage
BLOCK = 4                # pieces whose largest impact is kept per term
PIECES_A_PASS = 4_000    # index pieces that travel with one pass
K1, B = 1.2, 0.75
LEAST_SCORE = 0.6        # share of a piece's own score
FREE = 0.5               # share of the threshold that frequent terms may add
LEAST_OVERLAP = 0.5      # share of question shingles and of answer words
SHINGLE = 3


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def question_answer(text: str | None) -> tuple[list[str], list[str]]:
    """Words before the last sentence or line, and words of it; one sentence is both."""
    text = (text or "").strip()
    cuts = [m.end() for m in re.finditer(r"[.!?:]\s+|\n", text)]
    for cut in reversed(cuts):
        question, answer = words_of(text[:cut]), words_of(text[cut:])
        if question and answer:
            return question, answer
    return words_of(text), words_of(text)


def _shingles(words: list[str]) -> set:
    n = min(SHINGLE, len(words))
    return set(zip(*(words[i:] for i in range(n)))) if n else set()


_PIECES = "item_id long, piece int, word string, tf int, length int"


def _pieces(batches):
    for batch in batches:
        out = []
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text")):
            words = words_of(text.as_py())
            count = max(1, -(-len(words) // PIECE))
            for p in range(count):
                part = words[p * len(words) // count:(p + 1) * len(words) // count]
                for w in dict.fromkeys(part):
                    out.append((item, p, w, part.count(w), len(part)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], t) for i, t in enumerate(
                (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32()))],
            ["item_id", "piece", "word", "tf", "length"])


def build_index(items: DataFrame) -> DataFrame:
    """(item_id, piece, word, impact): BM25 impacts that sum to 1 in each piece."""
    terms = items.select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(_pieces, _PIECES)
    pieces, length = (terms.select("item_id", "piece", "length").distinct()
                      .agg(F.count("*"), F.avg("length")).first())
    df = terms.groupBy("word").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(pieces) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    raw = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(length or 1.0)))
    whole = Window.partitionBy("item_id", "piece")
    return (terms.join(df, "word").withColumn("raw", raw)
            .select("item_id", "piece", "word", "df", (F.col("raw") / F.sum("raw").over(whole)).alias("impact")))


class Index:
    """Postings of one block of items, as arrays."""

    def __init__(self, rows, texts):
        keys = sorted({(r[0], r[1]) for r in rows})
        number = {k: i for i, k in enumerate(keys)}
        self.items = [k[0] for k in keys]
        self.texts = {i: question_answer(t) for i, t in texts.items()}
        frequency = {}
        for _, _, w, df, _ in rows:
            frequency[w] = df
        order = sorted(frequency, key=lambda w: (-frequency[w], w))
        self.term = {w: t for t, w in enumerate(order)}
        t = np.array([self.term[r[2]] for r in rows], np.int64)
        d = np.array([number[r[0], r[1]] for r in rows], np.int64)
        v = np.array([r[4] for r in rows])
        by = np.lexsort((d, t))
        self.doc, self.impact = d[by], v[by]
        self.start = np.searchsorted(t[by], np.arange(len(order) + 1))
        # frequent terms, most frequent first, while no piece gets half the threshold from them
        self.free = np.zeros(len(keys))
        self.frequent = np.zeros(len(order), bool)
        for x in range(len(order)):
            span = slice(self.start[x], self.start[x + 1])
            if (self.free[self.doc[span]] + self.impact[span] < LEAST_SCORE * FREE).all():
                self.free[self.doc[span]] += self.impact[span]
                self.frequent[x] = True
        self.blocks = -(-len(keys) // BLOCK)
        self.free_block = np.maximum.reduceat(self.free, np.arange(0, len(keys), BLOCK)) if keys else self.free
        bt, bb = t[by], self.doc // BLOCK
        head = np.flatnonzero(np.concatenate([[True], (bt[1:] != bt[:-1]) | (bb[1:] != bb[:-1])])) if len(bt) else np.zeros(0, int)
        self.block_of = bb[head]
        self.block_max = np.maximum.reduceat(self.impact, head) if len(head) else np.zeros(0)
        self.block_start = np.searchsorted(bt[head], np.arange(len(order) + 1))

    @staticmethod
    def _expand(starts, ends):
        """Indices of several ranges in one array, and the number of the range each came from."""
        n = ends - starts
        source = np.repeat(np.arange(len(n)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(starts, n) + at, source

    def retrieve(self, texts: list[list[str]]) -> list[dict]:
        """For each text, the items that reach LEAST_SCORE in a passage, with their largest scores.

        Passage p of a text is its halves p and p + 1; texts are numbered so that
        no passage holds halves of two.
        """
        known, out = self.term.get, [{} for _ in texts]
        firsts = np.cumsum([0] + [len(w) // HALF + 2 for w in texts])
        terms = np.fromiter((known(w, -1) for words in texts for w in words), np.int64)
        half = np.concatenate([first + np.arange(len(w)) // HALF for first, w in zip(firsts, texts)])
        held = terms >= 0
        # each term once per half, and then in both passages that hold the half
        key = np.unique(half[held] * len(self.term) + terms[held])
        half, terms = key // max(1, len(self.term)), key % max(1, len(self.term))
        rare = ~self.frequent[terms]
        at, source = self._expand(self.block_start[terms[rare]], self.block_start[terms[rare] + 1])
        cell = half[rare][source] * self.blocks + self.block_of[at]
        bound = self.block_max[at]
        cells, where = np.unique(np.concatenate([cell, cell - self.blocks]), return_inverse=True)
        total = np.bincount(where, np.concatenate([bound, bound]), len(cells)) + self.free_block[cells % self.blocks]
        cells = cells[total >= LEAST_SCORE]
        passage, block = cells // self.blocks, cells % self.blocks
        begin, end = np.searchsorted(half, passage), np.searchsorted(half, passage + 2)
        owner = np.searchsorted(firsts, passage + 1, side="right") - 1     # half p may be the gap before
        for text, b, lo, hi in zip(owner.tolist(), block.tolist(), begin.tolist(), end.tolist()):
            mine = np.unique(terms[lo:hi])
            at, _ = self._expand(self.start[mine], self.start[mine + 1])
            at = at[self.doc[at] // BLOCK == b]
            scores = np.bincount(self.doc[at] - b * BLOCK, self.impact[at], BLOCK)
            for d in np.flatnonzero(scores >= LEAST_SCORE - 1e-12):
                item, best = self.items[b * BLOCK + d], out[text]
                best[item] = max(best.get(item, 0.0), float(scores[d]))
        return out

    def overlaps(self, words: list[str], found: dict) -> list[tuple]:
        """(item, score, question overlap, answer overlap) of the found items that the words give away."""
        if not found:
            return []
        held = set(words)
        runs = {n: set(zip(*(words[i:] for i in range(n)))) for n in range(1, SHINGLE + 1)}
        out = []
        for item, score in sorted(found.items()):
            question, answer = self.texts[item]
            asked, told = _shingles(question), set(answer)
            q = len(asked & runs[min(SHINGLE, len(question))]) / len(asked)
            a = len(told & held) / len(told)
            if q >= LEAST_OVERLAP and a >= LEAST_OVERLAP:
                out.append((item, round(score, 4), round(q, 4), round(a, 4)))
        return out

    def leaks(self, texts: list[str | None]) -> list[list[tuple]]:
        """The leaked items of each text."""
        out, group, size = [], [], 0
        for n, text in enumerate(texts):
            group.append(words_of(text))
            size += len(group[-1])
            if size > WORDS_AT_ONCE or n == len(texts) - 1:
                out += [self.overlaps(w, f) for w, f in zip(group, self.retrieve(group))]
                group, size = [], 0
        return out


def index_blocks(items: DataFrame):
    """The index in blocks of about PIECES_A_PASS pieces, each small enough to travel with tasks."""
    items = items.filter("item_id IS NOT NULL").groupBy("item_id").agg(F.max("text").alias("text"))
    index = materialize(build_index(items), "bm25")
    blocks = max(1, -(-index.select("item_id", "piece").distinct().count() // PIECES_A_PASS))
    for b in range(blocks):
        mine = F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b
        rows = index.filter(mine).select("item_id", "piece", "word", "df", "impact").collect()
        texts = {r[0]: r[1] for r in items.filter(mine).collect()}
        if rows:
            yield Index([tuple(r) for r in rows], texts)


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of every leak.

    docs: doc_id, text; items: item_id, text; further columns are ignored.
    Words are lower-cased runs of letters, digits and underscores.  Null, empty and
    wordless texts leak nothing, and wordless items are never leaked.  Items that repeat
    an item_id count once (greatest text).  Equal rows of docs give equal rows; each
    item gives at most one row a document, with its best passage's score.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in index_blocks(items):
        def run(batches, index=index):              # the index is bounded by PIECES_A_PASS
            for batch in batches:
                rows = [(d, *leak) for d, found in zip(batch.column("doc_id").to_pylist(),
                                                       index.leaks(batch.column("text").to_pylist())) for leak in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], pa.int64() if i < 2 else pa.float64()) for i in range(5)],
                    ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])
        out = out.unionByName(docs.mapInArrow(run, schema))
    return out


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of docs, all columns, that leak no item; no shuffle."""
    for index in index_blocks(items):
        def run(batches, index=index):
            for batch in batches:
                yield batch.filter(pa.array([not x for x in index.leaks(batch.column("text").to_pylist())],
                                            pa.bool_()))
        docs = docs.mapInArrow(run, docs.schema)
    return docs
