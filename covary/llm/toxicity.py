"""Operator 6: toxicity by maximum-scoring segments.

Tokens are the lower-cased words of a text, and every one of them scores its log-odds of a toxic against a clean text.
The odds come from counts of labelled texts (a text counts once, however often it repeats a word) under Dirichlet
priors: the prior of a word is what its longest counted prefix of three to eight letters says, the prior of a prefix
what the next shorter one says, and the shortest have the base rate; each prior weighs `PRIOR` texts. So a word seen in
one text only says little more than its prefix, an unseen one just what its prefix says, and no feature is gated by its
significance. A word scores `DRIFT` less than its log-odds, the log prior odds of a word to belong to a toxic passage,
so that ordinary words score below zero; the k-th place of a word in a text scores a k-th of it, where it is positive, so
that mere repetition makes no passage. A linear-time scan (all maximal scoring subsequences) finds every passage whose
total can't be raised by growing or shrinking it. A passage of score S in a text of n words is significant by the
extreme-value law P(max >= S) = 1 - exp(-K n exp(-lambda S)), lambda and K fitted by likelihood on the best passages of
clean labelled texts. The text's score is a logistic calibration of its best and its summed significant passages. Both
fits use scores that a text got from the other folds' counts (`FOLDS`, by hash of the text), not from its own.

Learned from: at most `PER_CLASS` labelled texts of either class, those with the smallest hash. Features that a single
one of them holds are left to their prefix; that bounds the table by the sample, and nothing else does. Labels and
nothing else of a row than its text are used; a doc_id labelled twice is toxic if any label says so; null labels and ids
are not learned from. A null or empty text has no passage and the score of a text without one; without labels of both
classes every score is 0. Repeated rows get equal scores; other columns are ignored."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covary.llm.shared import id_fold, slices, table, written

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = range(3, 9)
DRIFT = 0.5
PER_CLASS = 5000
PRIOR = 5.0
FOLDS = 3
SURE = 3.0  # -log of the chance at which a passage is significant: 5 %


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def features_of(word: str) -> list[str]:
    """A word's features from general to specific: its proper prefixes, and itself with an end mark."""
    return [*(word[:k] for k in PREFIXES if k < len(word)), word + "$"]


def features_in(text: str | None) -> set[str]:
    return {f for w in set(words_of(text)) for f in features_of(w)}


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring subsequences of a sequence: (score, first place, last place), in linear time."""
    found: list[list] = []  # [sum before, sum after, first, last, the nearest earlier one that began lower]
    after = np.cumsum(scores)
    for at in np.flatnonzero(scores > 0).tolist():
        new = [float(after[at - 1]) if at else 0.0, float(after[at]), at, at]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= new[0]:
                j = found[j][4]
            if j < 0 or found[j][1] >= new[1]:
                found.append([*new, j])
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(end - begin, a, b) for begin, end, a, b, _ in found]


class Lexicon(dict):
    """word -> its score; holds the scores it has looked up, of 200,000 words at a time."""

    def __init__(self, odds: dict[str, float]):
        super().__init__()
        self.odds = odds

    def __missing__(self, word: str) -> float:
        if len(self) >= 200_000:
            self.clear()
        self[word] = s = next((self.odds[f] for f in reversed(features_of(word)) if f in self.odds), 0.0) - DRIFT
        return s


def passages(text: str | None, lexicon: Lexicon) -> tuple[int, list[tuple[float, int, int]]]:
    """The number of words of a text, and its passages."""
    words = words_of(text)
    scores = np.array([lexicon[w] for w in words], float)
    times: Counter = Counter()
    for at in np.flatnonzero(scores > 0).tolist():
        times[words[at]] += 1
        scores[at] /= times[words[at]]
    return len(words), segments(scores)


def log_odds(counts: dict[str, tuple[int, int]], n_clean: int, n_toxic: int) -> dict[str, float]:
    """Feature -> log-odds, from (clean, toxic) counts of texts; every feature's prior is its prefix's posterior."""
    rate = n_toxic / (n_clean + n_toxic)  # of the sample, so that log-odds are zero where a feature says nothing
    base = math.log(n_toxic / n_clean)
    share: dict[str, float] = {}
    for f in sorted(counts, key=len):
        # "abc$" follows "abc" and shorter ones only where those are proper prefixes of longer words too
        prior = next((share[f[:k]] for k in range(min(len(f) - 1, PREFIXES[-1]), PREFIXES[0] - 1, -1) if f[:k] in share and (f[k:] != "$")), rate)
        clean, toxic = counts[f]
        p = (toxic + PRIOR * prior) / (clean + toxic + PRIOR)
        share[f] = min(max(p, 1e-6), 1 - 1e-6)  # a chain of one-sided prefixes must not round to certainty
    return {f: math.log(p / (1 - p)) - base for f, p in share.items()}


class Model:
    """Log-odds, the extreme-value law of clean texts and the calibration. Without calibration every score is 0."""

    def __init__(self, odds: dict[str, float], lam: float = 1.0, k: float = 1e-3, calibration: tuple[float, ...] | None = None):
        self.odds, self.lam, self.k, self.calibration = odds, lam, k, calibration

    def bits(self, score: float, n: int) -> float:
        """-log of the number of passages as good as this one that chance alone gives in n words."""
        return self.lam * score - math.log(max(self.k * n, 1e-12))

    def evidence(self, n: int, scores: list[float]) -> list[float]:
        """Of the best passage, and of all that are significant."""
        b = [self.bits(s, n) for s in scores]
        return [1.0, min(max(max(b, default=-5.0), -5.0), 20.0), math.log1p(sum(x for x in b if x > SURE))]

    def score(self, n: int, scores: list[float]) -> float:
        if self.calibration is None:
            return 0.0
        z = sum(a * x for a, x in zip(self.calibration, self.evidence(n, scores), strict=True))
        return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(text, toxic) of at most per_class labelled documents of either class, one row for each id: of several texts that
    share it the one whose hash is least."""
    y = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    y = written(y)
    some = [y.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    ids = some[0].union(some[1])  # bounded, so it may be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic")


def _counted(rows: DataFrame) -> dict[str, np.ndarray]:
    """Feature -> how many (clean, toxic) texts of each fold hold it; "" counts all texts."""

    def count(batches):
        seen = [Counter() for _ in range(2 * FOLDS)]
        for b in slices(batches):
            for t, y, fold in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                own = seen[2 * fold + (y > 0)]
                own.update(features_in(t.as_py()))
                own[""] += 1
            if sum(map(len, seen)) > 400_000:
                yield from flushed(seen)
        yield from flushed(seen)

    def flushed(seen):
        for at, c in enumerate(seen):
            yield pa.record_batch([pa.array(list(c), pa.string()), pa.array([at] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], names=["feature", "at", "n"])
            c.clear()

    sums = [F.sum(F.when(F.col("at") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(2 * FOLDS)]
    found = rows.mapInArrow(count, "feature string, at int, n bigint").groupBy("feature").agg(*sums)
    got = found.where(sum(F.col(f"n{i}") for i in range(2 * FOLDS)) >= 2).toArrow()  # bounded by the sample
    n = np.array([c.to_numpy() for c in got.columns[1:]]).reshape(2 * FOLDS, -1).T
    return dict(zip(got.column(0).to_pylist(), n, strict=True))


def _scanned(rows: DataFrame, by_fold: list[dict[str, float]]) -> list[dict]:
    """(toxic, n, scores) of the labelled sample, every text scanned without the counts of its own fold."""
    shared = rows.sparkSession.sparkContext.broadcast(by_fold)

    def run(batches):
        lexicons = [Lexicon(odds) for odds in shared.value]
        for b in slices(batches):
            got = [passages(t.as_py(), lexicons[fold]) for t, fold in zip(b.column(0), b.column(2).to_pylist(), strict=True)]
            scores = pa.array([[s for s, _, _ in found] for _, found in got], pa.list_(pa.float32()))
            yield pa.record_batch([b.column(1), pa.array([n for n, _ in got], pa.int32()), scores], names=["toxic", "n", "scores"])

    return rows.mapInArrow(run, "toxic int, n int, scores array<float>").toArrow().to_pylist()


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learns from the rows of docs that labels covers."""
    rows = written(sample(docs, labels, per_class).withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")))
    counts = _counted(rows)
    size = counts.pop("", np.zeros(2 * FOLDS, int))

    def without(fold: int | None) -> dict[str, float]:
        use = np.array([i // 2 != fold for i in range(2 * FOLDS)])
        clean, toxic = use & (np.arange(2 * FOLDS) % 2 == 0), use & (np.arange(2 * FOLDS) % 2 == 1)
        if not size[clean].sum() or not size[toxic].sum():
            return {}
        kept = {f: (int(n[clean].sum()), int(n[toxic].sum())) for f, n in counts.items()}
        return log_odds({f: n for f, n in kept.items() if sum(n)}, int(size[clean].sum()), int(size[toxic].sum()))

    odds = without(None)
    if not odds:
        return Model({})
    return calibrated(odds, _scanned(rows, [without(k) for k in range(FOLDS)]))


def extreme_value_law(n: np.ndarray, best: np.ndarray) -> tuple[float, float]:
    """(lambda, K) of the greatest likelihood for texts of n words whose best passages score `best`."""
    fits = []
    for lam in np.geomspace(0.05, 5, 120):
        k = len(n) / float((n * np.exp(-lam * best)).sum())
        fits.append((len(n) * math.log(lam * k) - lam * float(best.sum()), float(lam), k))
    return max(fits)[1:]


def calibrated(odds: dict[str, float], rows: list[dict]) -> Model:
    """The law of clean texts' best passages, then the logistic map of the evidence to the labels."""
    clean = [(r["n"], max(r["scores"], default=0.0)) for r in rows if not r["toxic"] and r["n"]]
    model = Model(odds)
    if clean:
        model.lam, model.k = extreme_value_law(*np.array(clean, float).T)
    x = np.array([model.evidence(r["n"], r["scores"]) for r in rows])
    y = np.array([r["toxic"] > 0 for r in rows], float)
    w = np.zeros(x.shape[1])
    for _ in range(40):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
    model.calibration = tuple(map(float, w))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, passages): passages are the significant ones, as first and last word and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        model = shared.value
        lexicon = Lexicon(model.odds)
        for b in slices(batches):
            got = [passages(t.as_py(), lexicon) for t in b.column(1)]
            scores = [model.score(n, [s for s, _, _ in found]) for n, found in got]
            found = [[{"first": a, "last": z, "score": s} for s, a, z in found if model.bits(s, n) > SURE] for n, found in got]
            yield pa.record_batch([b.column(0), pa.array(scores, pa.float64()), pa.array(found, place)], names=["doc_id", "score", "passages"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, passages array<struct<first:int,last:int,score:double>>")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: every document's toxicity, learned from four fifths of the labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(id_fold(F.col("doc_id"), 5) != 0))
    return score(docs, model).select(
        "doc_id", (id_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages")
    )
