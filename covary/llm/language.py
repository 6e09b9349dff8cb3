"""Operator 4: language identification.

Features are character n-grams (one to three code points of the lower-cased text, everything but letters a space),
hashed to 2**14 slots, weighted 1 + log(count) times inverse document frequency and scaled to length one. The
document frequencies are counted over all documents that may be learned from. A multinomial logistic regression is
trained on a bounded sample of them by follow-the-regularised-leader with elastic-net penalties (the L1 part makes it
sparse), a temperature is fitted on a fifth of the sample, and every whole text is scored with it.

The sample holds at most `per_language` rows of a language, those with the smallest hash, and at most `SAMPLE` rows (or
one of each language) in all; it is the only thing that reaches the driver besides the slot counts. A null text and one without a letter are `und` with score 0, as is every
text if nothing can be learned; null languages are not learned from; ids may be null or repeated; other columns are
ignored."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covary.llm.shared import id_fold, quoted, slices, table

SLOTS = 1 << 14
PER_LANGUAGE = 1500
SAMPLE = 12_000  # rows of all languages together
UNKNOWN = "und"
_ODD = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
_letters: list[np.ndarray] = []


def slots(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of a text, by slot."""
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)], bool))
    c = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(_letters[0][c], c, np.uint32(32))
    shift = np.uint32(18)
    one = c * _ODD[0]
    two = one[:-1] + c[1:] * _ODD[1]
    three = two[:-1] + c[2:] * _ODD[2]
    return np.bincount(np.concatenate([one * _ODD[2] >> shift, two * _ODD[2] >> shift, (three ^ (three >> np.uint32(15))) * _ODD[1] >> shift]), minlength=SLOTS)


def known(text: str | None) -> bool:
    """Whether a text has a letter; digits, numerals and other signs of whatever script are none."""
    return bool(text) and any(map(str.isalpha, text))


def weighted(count: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(count)
    v = (1 + np.log(count[at])) * idf[at]
    return at, v / max(1e-9, float(np.sqrt(v @ v)))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # languages x slots
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, count: np.ndarray) -> np.ndarray:
        at, v = weighted(count, self.idf)
        return self.weights[:, at] @ v + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not known(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(slots(text)) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(min(1.0, max(0.0, p[k])))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
    """Per-coordinate FTRL-proximal for softmax regression: (weights, bias)."""
    z, n = np.zeros((classes, SLOTS + 1)), np.zeros((classes, SLOTS + 1))

    def solved(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, v, y = rows[i]
            at, v = np.append(at, SLOTS), np.append(v, 1.0)
            zi, ni = z[:, at], n[:, at]
            w = solved(zi, ni)
            p = softmax(w @ v)
            p[y] -= 1
            g = np.outer(p, v)
            n[:, at] = grown = ni + g * g
            z[:, at] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / alpha * w
    w = solved(z, n)
    return w[:, :SLOTS].astype(np.float32), w[:, SLOTS]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the smallest negative log-likelihood."""
    best = (np.inf, 1.0)
    for t in np.geomspace(0.05, 5, 80):
        s = logits / t
        s = s - s.max(axis=1, keepdims=True)
        loss = float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).sum())
        best = min(best, (loss, float(t)))
    return best[1]


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each slot occurs, and how many texts there are: one vector per task, summed by slot."""

    def run(batches):
        df = np.zeros(SLOTS + 1, np.int64)
        for b in slices(batches):
            for t in b.column(0):
                text = t.as_py()
                if text:
                    df[:SLOTS] += slots(text) > 0
                    df[SLOTS] += 1
        yield pa.record_batch([pa.array(np.arange(SLOTS + 1, dtype=np.int32)), pa.array(df)], names=["slot", "n"])

    sums = docs.select("text").mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    out = np.zeros(SLOTS + 1, np.int64)
    for slot, n in sums.collect():  # SLOTS + 1 rows
        out[slot] = n
    return out[:SLOTS], int(out[SLOTS])


def packed(sample: pa.Table, idf: np.ndarray, names: list[str]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(slots, weights, class) of each row of (lang, at, n), as views of one array of slots and one of weights: two large
    blocks go back to the system once the model is trained, which thousands of small ones don't."""
    total = sum(len(c.values) for c in sample.column("at").chunks)
    slot, weight = np.empty(total, np.uint16), np.empty(total)  # SLOTS fit into 16 bits
    rows, start = [], 0
    for lang, at, n in zip(sample.column("lang").to_pylist(), sample.column("at"), sample.column("n"), strict=True):
        at, n = at.values.to_numpy(), n.values.to_numpy()
        v = (1 + np.log(n)) * idf[at]
        end = start + len(at)
        slot[start:end], weight[start:end] = at, v / np.sqrt(v @ v)
        rows.append((slot[start:end], weight[start:end], names.index(lang)))
        start = end
    return rows


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """docs needs doc_id, text and lang; all its rows may be learned from."""
    docs = docs.where(F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    seen, total = document_frequency(docs)
    idf = np.log((1 + total) / (1 + seen)) + 1
    key = F.xxhash64("doc_id", F.col("text").isNull(), "text")
    sizes = docs.groupBy("lang").count().collect()  # a row a language, as the model has
    per_language = max(1, min(per_language, SAMPLE // max(1, len(sizes))))
    # thin out by hash before ranking, so that no window sees a whole language
    least = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, 1.5 * per_language / r["count"] + 1e-4))]) if sizes else F.create_map(F.lit(""), F.lit(0.0))
    keyed = docs.select("lang", key.alias("key")).where(F.pmod("key", F.lit(1 << 20)) < F.try_element_at(least, F.col("lang")) * (1 << 20))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    picked = keyed.withColumn("k", rank).where(F.col("k") <= per_language).select("key").distinct()

    def run(batches):
        for b in slices(batches):
            rows = []
            for text, lang in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                if known(text.as_py()):
                    c = slots(text.as_py())
                    at = np.flatnonzero(c)
                    rows.append((lang, at.astype(np.int32), c[at].astype(np.int32)))
            yield pa.record_batch(
                [pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[i] for r in rows], pa.list_(pa.int32())) for i in (1, 2))], names=["lang", "at", "n"]
            )

    sample = docs.withColumn("key", key).join(F.broadcast(picked), "key", "left_semi")
    sample = sample.dropDuplicates(["key", "lang"])  # rows of equal id and text count once, so the sample is bounded
    got = sample.select("text", "lang").mapInArrow(run, "lang string, at array<int>, n array<int>").toArrow()
    names = sorted(set(got.column("lang").to_pylist()))
    if not names:
        return Model([], idf, np.zeros((0, SLOTS), np.float32), np.zeros(0))
    rows = packed(got, idf, names)
    del got
    pa.default_memory_pool().release_unused()  # the driver keeps the sample once
    rows.sort(key=lambda r: (len(r[0]), float(r[1].sum()), r[2]))
    held = rows[::5] if len(rows) >= 50 else rows
    rest = [r for i, r in enumerate(rows) if i % 5] if len(rows) >= 50 else rows
    w, b = ftrl(rest, len(names))
    logits = np.array([w[:, at] @ v + b for at, v, _ in held])
    return Model(names, idf, w, b, temperature(logits, np.array([y for _, _, y in held])))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(of, lang_pred, score): the row's columns as they were, as one struct, so that no name of theirs can clash."""
    cols = docs.select(F.col("text").alias("text"), F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("of"))

    def run(batches):
        for b in slices(batches):
            out = [model.predict(t.as_py()) for t in b.column(0)]
            yield pa.record_batch([b.column(1), pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], names=["of", "lang_pred", "score"])

    return cols.mapInArrow(run, T.StructType([cols.schema["of"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def keep_identified(docs: DataFrame, model: Model, least: float = 0.34) -> DataFrame:
    """docs without those whose language can't be told: `und`, or a score under `least`."""
    at = docs.columns.index("text")

    def run(batches):
        for b in slices(batches):
            told = [model.predict(t.as_py()) for t in b.column(at)]
            yield b.filter(pa.array([lang != UNKNOWN and p >= least for lang, p in told], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: the language of every document, learned from two thirds of them."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(id_fold(F.col("doc_id"), 3) != 1))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("of.doc_id", (id_fold(F.col("of.doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
