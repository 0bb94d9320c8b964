"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Ratings are grades 0 < 1 < ... < K-1.  One weight vector over hashed text
features is shared by all grades, and K-1 ordered thresholds cut its score:

    P(grade <= k | x) = sigmoid(threshold_k - w.x)

Expected grade and tail probabilities P(grade >= k) follow, and documents are
selected on the tail of the best grade.  Its threshold is moved to where, in held-out
parts of the ratings, a text is as likely to have the best grade as not.  The model is fitted in one task on a bounded sample of
rated documents (``sample`` rows, smallest hashes first); its size depends on
the number of hash buckets alone.  Every document is scored whole, in one pass
without a shuffle.
"""

import re
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .sampling import thin_out

BUCKETS = 1 << 18
SAMPLE = 12_000         # rated documents that the model is fitted on, at most
FEATURES = 400        # hashed features with a weight, at most
SIGNIFICANT = 5.0       # standard errors between the means of two grades
LEAST_TEXTS = 3        # rated texts that must hold a feature
RIDGE = 1e-6
NEWTON_STEPS = 60
CACHE_TOKENS = 400_000
FOLDS = 4               # parts of the ratings, each graded by a model of the others
LEAST_TAIL = 0.5
_CORE = re.compile(r"\w+")
REPEATED = 0            # bucket of the share of tokens that repeat the one before


SHAPES = 4096           # buckets below hold shapes, the others words


def _bucket(kind: str, value: str) -> int:
    h = xxhash.xxh3_64_intdigest(f"{kind}|{value}")
    return 1 + h % (SHAPES - 1) if kind == "s" else SHAPES + h % (BUCKETS - SHAPES)


def _token_buckets(token: str) -> tuple[list, list]:
    """Hashed word and its beginnings; hashed shape of the token."""
    core = "".join(_CORE.findall(token))
    word = core.lower()
    shape = ("A" if core.isupper() else "a") + "".join(c for c in token if not c.isalnum())[:4]
    words = [_bucket("w", word)] if word else []
    words += [_bucket("p", word[:n]) for n in (4, 5) if len(word) > n]
    return words, [_bucket("s", shape)]


class Featurizer:
    """(buckets, values) of a text: 1 for words and word beginnings it holds, the share of its
    tokens with each shape, and the share that repeat the token before."""

    def __init__(self):
        self.known: dict = {}

    def __call__(self, text: str | None):
        tokens = (text or "").split()
        if not tokens:
            return np.zeros(0, np.int32), np.zeros(0, np.float32)
        known = self.known
        if len(known) > CACHE_TOKENS:
            known.clear()
        words, shapes = set(), Counter()
        for token, count in Counter(tokens).items():
            buckets = known.get(token)
            if buckets is None:
                buckets = known[token] = _token_buckets(token)
            words.update(buckets[0])
            shapes[buckets[1][0]] += count
        shapes[REPEATED] = sum(map(eq, tokens, tokens[1:]))
        ids = np.fromiter([*words, *shapes], np.int32, len(words) + len(shapes))
        values = np.ones(len(ids), np.float32)
        values[len(words):] = np.fromiter(shapes.values(), np.float32, len(shapes)) / len(tokens)
        return ids, values


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def grade_tails(score: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade >= k) for k = 1..K-1, one row per score."""
    return _sigmoid(score[:, None] - thresholds[None, :])


def screen(ids, values, lengths, grades, grades_n: int, most: int) -> np.ndarray:
    """Features whose means differ between neighbouring grades, the clearest of each pair."""
    row_grade = np.repeat(grades, lengths)
    counts = np.maximum(np.bincount(grades, minlength=grades_n), 1)
    sums = [np.bincount(ids[row_grade == k], values[row_grade == k], BUCKETS) for k in range(grades_n)]
    squares = [np.bincount(ids[row_grade == k], values[row_grade == k] ** 2, BUCKETS) for k in range(grades_n)]
    held = np.bincount(ids, minlength=BUCKETS)
    chosen = [np.zeros(0, np.int64)]
    rated = np.flatnonzero(np.bincount(grades, minlength=grades_n))
    for j, k in zip(rated, rated[1:]):
        n = counts[j] + counts[k]
        mean = (sums[j] + sums[k]) / n
        spread = np.maximum((squares[j] + squares[k]) / n - mean ** 2, 0)
        z = np.abs(sums[j] / counts[j] - sums[k] / counts[k]) / np.sqrt(
            spread * (1 / counts[j] + 1 / counts[k]) + 1e-9)
        z[held < LEAST_TEXTS] = 0
        best = np.argsort(-z, kind="stable")[:most // (grades_n - 1)]
        chosen.append(best[z[best] > SIGNIFICANT])
    return np.unique(np.concatenate(chosen))


def fit(ids, values, lengths, grades, grades_n: int, most: int = FEATURES, ridge: float = RIDGE):
    """Weights and thresholds of greatest likelihood under a ridge penalty, by Fisher scoring.

    Grades weigh alike, so that rare ones are learnt.  Features are first screened by
    their score tests; the others have no weight.
    """
    n = len(lengths)
    counts = np.bincount(grades, minlength=grades_n)
    weight = (1 / (grades_n * np.maximum(counts, 1)))[grades]
    chosen = screen(ids, values, lengths, grades, grades_n, most)
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))
    here = place[ids]
    x = np.zeros((n, len(chosen)), np.float32)
    x[np.repeat(np.arange(n), lengths)[here >= 0], here[here >= 0]] = values[here >= 0]
    scale = 1 / (np.sqrt((x ** 2).sum(0) / np.maximum((x > 0).sum(0), 1)) + 1e-6)
    x *= scale
    mean = weight.astype(np.float32) @ x
    x -= mean
    w, at = np.zeros(len(chosen)), np.arange(n)
    cuts = np.linspace(-1, 1, grades_n - 1)

    def state(w, cuts):
        score = x @ w.astype(np.float32)
        above = np.concatenate([np.ones((n, 1)), _sigmoid(score[:, None] - cuts), np.zeros((n, 1))], 1)
        slope = above * (1 - above)
        p = np.maximum(above[:, :-1] - above[:, 1:], 1e-12)
        loss = -(weight * np.log(p[at, grades])).sum() + ridge / 2 * w @ w
        return loss, p, slope

    loss, p, slope = state(w, cuts)
    for _ in range(NEWTON_STEPS):
        lo, hi = slope[at, grades] / p[at, grades], slope[at, grades + 1] / p[at, grades]
        curve = ((slope[:, :-1] - slope[:, 1:]) ** 2 / p).sum(1) * weight + 1e-9
        g = x.T @ ((hi - lo) * weight).astype(np.float32) + ridge * w
        h = (x * curve[:, None].astype(np.float32)).T @ x + np.eye(len(w)) * ridge
        g_cut = (np.bincount(grades, lo * weight, grades_n + 1)
                 - np.bincount(grades + 1, hi * weight, grades_n + 1))[1:-1]
        step, step_cut = np.linalg.solve(h, g), 2 * g_cut
        size = 1.0
        while size > 1e-4:
            new, new_cuts = w - size * step, np.sort(cuts - size * step_cut)
            new_loss, new_p, new_slope = state(new, new_cuts)
            if new_loss < loss:
                break
            size /= 2
        else:
            break
        done = loss - new_loss < 1e-7
        w, cuts, loss, p, slope = new, new_cuts, new_loss, new_p, new_slope
        if done:
            break
    full = np.zeros(BUCKETS)
    full[chosen] = w * scale
    return full, cuts + mean @ w


def even_point(ids, values, lengths, grades, grades_n: int) -> float:
    """Score above the last threshold at which the best grade is as likely as the others together.

    Held-out parts are scored by models of the other parts; a logistic regression of the best grade
    on these scores, ratings weighing as they occur, gives the point.  If it tells nothing the point
    lies below all scores, so that documents stay.
    """
    n = len(lengths)
    rows = np.repeat(np.arange(n), lengths)
    fold = np.bincount(rows, ids, n).astype(np.int64) % FOLDS      # equal texts share a part
    score = np.full(n, np.nan)
    for k in range(FOLDS):
        held, here = fold == k, (fold == k)[rows]
        if held.any() and len(np.unique(grades[~held])) > 1:
            weights, cuts = fit(ids[~here], values[~here], lengths[~held], grades[~held], grades_n)
            score[held] = np.bincount(rows[here], weights[ids[here]] * values[here], n)[held] - cuts[-1]
    known = ~np.isnan(score)
    x, y = np.stack([score[known], np.ones(known.sum())]), (grades[known] == grades_n - 1) * 1.0
    if not 0 < y.sum() < len(y):
        return 0.0
    line = np.array([1.0, 0.0])
    for _ in range(NEWTON_STEPS):
        p = _sigmoid(line @ x)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)) @ x.T + 1e-6 * np.eye(2), x @ (y - p))
        line = line + np.clip(step, -1, 1)
    p, share = np.where(y == 1, _sigmoid(line @ x), 1 - _sigmoid(line @ x)), y.mean()
    gain = np.log(np.maximum(p, 1e-12)).sum() - len(y) * (share * np.log(share) + (1 - share) * np.log(1 - share))
    return float(-line[1] / line[0] if line[0] > 0 and gain > 2 else x[0].min() - 1)


_FEATURES = "grade int, ids array<int>, vals array<float>"


def _featurize(batches):
    features = Featurizer()
    for batch in batches:
        rows = [features(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("grade"), pa.array([r[0] for r in rows], pa.list_(pa.int32())),
             pa.array([r[1] for r in rows], pa.list_(pa.float32()))], ["grade", "ids", "vals"])


def _fit_group(grades_n: int):
    def run(table: pa.Table) -> pa.Table:
        grades = table.column("grade").to_numpy()
        ids, vals = table.column("ids").combine_chunks(), table.column("vals").combine_chunks()
        lengths = np.diff(ids.offsets.to_numpy())
        rated = ids.flatten().to_numpy(), vals.flatten().to_numpy(), lengths, grades, grades_n
        weights, cuts = fit(*rated)
        even = cuts[-1] + even_point(*rated)
        cuts = np.append(np.minimum(cuts[:-1], even), even)
        held = np.flatnonzero(weights)
        return pa.table({"bucket": pa.array(np.concatenate([held, -1 - np.arange(len(cuts))]), pa.int32()),
                         "weight": pa.array(np.concatenate([weights[held], cuts]), pa.float64())})
    return run


def fit_grades(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE) -> tuple[dict, list]:
    """(weight by bucket, ordered thresholds) from rated documents.

    ratings: doc_id, grade (0 is worst; null is not rated).  Rated documents are
    taken in the order of a hash of doc_id, ``sample`` of them at most; of several
    grades of one document the worst counts.  With ratings of fewer than two
    grades there is nothing to learn: no weights, no thresholds.
    """
    ratings = ratings.filter("grade IS NOT NULL AND doc_id IS NOT NULL")
    chosen = (thin_out(ratings, "doc_id", 2 * sample).groupBy("doc_id")
              .agg(F.min("grade").cast("int").alias("grade"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    grades = [r[0] for r in chosen.groupBy("grade").count().orderBy("grade").collect()]
    if len(grades) < 2:
        return {}, []
    rated = (docs.select("doc_id", F.col("text").cast("string").alias("text"))
             .join(F.broadcast(chosen), "doc_id").select("grade", "text"))     # at most ``sample`` rows
    fitted = (rated.mapInArrow(_featurize, _FEATURES).withColumn("model", F.lit(0)).groupBy("model")
              .applyInArrow(_fit_group(grades[-1] + 1), "bucket int, weight double").collect())
    weights = {r.bucket: r.weight for r in fitted if r.bucket >= 0}
    cuts = [r.weight for r in sorted((r for r in fitted if r.bucket < 0), key=lambda r: -r.bucket)]
    return weights, cuts


class Scorer:
    """Score of a text under the weights; remembers what each frequent token adds."""

    def __init__(self, weights: dict):
        self.weights, self.known = weights, {}

    def __call__(self, text: str | None) -> float:
        tokens = (text or "").split()
        if not tokens:
            return 0.0
        weights, known = self.weights, self.known
        if len(known) > CACHE_TOKENS:
            known.clear()
        words, shape = set(), 0.0
        for token, count in Counter(tokens).items():
            adds = known.get(token)
            if adds is None:
                w, s = _token_buckets(token)
                adds = known[token] = [b for b in w if b in weights], weights.get(s[0], 0.0)
            if adds[0]:
                words.update(adds[0])
            shape += count * adds[1]
        shape += weights.get(REPEATED, 0.0) * sum(map(eq, tokens, tokens[1:]))
        return sum(weights[b] for b in sorted(words)) + shape / len(tokens)


def _grader(weights: dict, cuts: list):
    cuts = np.array(cuts)

    def grades(batch):
        scores = np.array([scorer(t.as_py()) for t in batch.column("text")], np.float64)
        tails = grade_tails(scores, cuts)
        return tails.sum(1), tails[:, -1] if len(cuts) else np.ones(len(scores))
    scorer = Scorer(weights)
    return grades


def grade_documents(docs: DataFrame, model: tuple[dict, list], least: float = LEAST_TAIL) -> DataFrame:
    """doc_id, expected_grade, best_tail = P(best grade), selected (best_tail >= least), per row.

    docs: doc_id, text; further columns are ignored.  Null, empty and blank
    texts have score 0, like a text without any weighted feature.  Equal rows get equal
    grades.  A model without thresholds selects everything.
    """
    def run(batches):
        grader = _grader(*model)
        for batch in batches:
            expected, tail = grader(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.round(expected, 4)), pa.array(np.round(tail, 4)),
                 pa.array(tail >= least)], ["doc_id", "expected_grade", "best_tail", "selected"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, expected_grade double, best_tail double, selected boolean")


def select_documents(docs: DataFrame, model: tuple[dict, list], least: float = LEAST_TAIL) -> DataFrame:
    """Rows of docs, all columns, that grade_documents selects; one pass, no shuffle."""
    def run(batches):
        grader = _grader(*model)
        for batch in batches:
            yield batch.filter(pa.array(grader(batch)[1] >= least))
    return docs.mapInArrow(run, docs.schema)


def ratings_from_labels(labels: DataFrame) -> DataFrame:
    """Grades 0 poor, 1 fluent but toxic, 2 good; unrated where a label is missing."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1)
                         .when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).alias("grade"))
