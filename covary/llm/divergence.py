"""Operator 13: source divergence audit by sorting token-start pointers.

A shard is a slice of an Arrow batch of at most SHARD bytes of text (one document if that is longer). Its letters are
lower-cased in a copy of the Arrow buffer, and a pointer is set to the start of every term. Pointers are sorted by
multikey quicksort with eight bytes for a character: pointers equal so far stay together in one run, and a run goes on to
the next eight bytes only with those of its terms that are longer. Documents are numbered by (lang, source) first, so that
one more sort by (term, document) leaves equal runs whose lengths are counts, and whose distinct documents are document
frequencies, for every (lang, source) of the shard. A shard sends one row per (lang, source, term) it holds.

These rows are summed by Spark, partially before each exchange; the second one brings a kept term's counts together, one
entry a source. Terms of fewer than `least` documents of their language end there. Every share, difference and sum is
over integers: those that may not fit 64 bits are Python integers.

Pairs of sources are compared in blocks of kept terms, one source against those behind it; a block sends a partial sum
per pair and its own ten best terms per source, and both are merged by ordinary aggregates. What every task knows is one
row per (lang, source): the pairs to return are its square, so it is small wherever the result can be written at all.

Null texts, langs and sources count as empty ones. A repeated row is a document of its own. A language without kept
terms has pairs of value 0 and no terms; an empty table gives an empty result. Other columns, whatever their names, are
ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covary.llm.shared import Tables, table

LEAST, TOP, UNIT = 10, 10, 1_000_000_000
SHARD = 8 << 20
#: Cells (terms x sources) of a block that is compared at once.
CELLS = 1 << 18
_LOWER, _LETTER = np.arange(256, dtype=np.uint8), np.zeros(256, bool)
_LOWER[65:91] += 32
_LETTER[97:123] = _LETTER[128:] = True
#: Of a big-endian word, the first n bytes.
_FIRST = np.array([0] + [(1 << 64) - (1 << (64 - 8 * n)) for n in range(1, 9)], np.uint64)


def pointers(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, document) of every term of the lower-cased bytes; offsets are the documents' bounds."""
    inside = np.zeros(len(text) + 2, bool)
    inside[1:-1] = _LETTER[text]
    cut = np.zeros(len(text) + 1, bool)  # a document begins or ends here
    cut[offsets] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    return start, end - start, np.searchsorted(offsets, start, "right") - 1


def equal_runs(text: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A number for each pointer, equal for equal terms only: multikey quicksort on words of eight bytes."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ndarray(len(text) + 1, ">u8", padded, strides=(1,))
    run, used = np.zeros(len(start), np.int64), 0
    on, depth = np.arange(len(start)), 0
    while len(on):
        key = words[start[on] + depth].astype(np.uint64) & _FIRST[np.minimum(length[on] - depth, 8)]
        order = np.lexsort((key, run[on])) if depth else np.argsort(key)
        on, key = on[order], key[order]
        before = run[on]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (before[1:] != before[:-1])])
        run[on] = used + np.cumsum(new)
        used += int(new.sum())
        depth += 8
        on = on[length[on] > depth]  # those get a number of their own at the next word
    return run


def bounds(column: pa.Array) -> np.ndarray:
    """Where the texts of the column begin and end in its buffer."""
    kind = np.int32 if column.type == pa.string() else np.int64
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def shard_counts(column: pa.Array, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(term, group, count, documents) for every term and group of the texts."""
    raw, offsets = np.frombuffer(column.buffers()[2] or b"", np.uint8), bounds(column)
    text = _LOWER[raw[offsets[0] : offsets[-1]]]
    start, length, doc = pointers(text, offsets - offsets[0])
    if not len(start):
        return pa.array([], pa.string()), *(np.empty(0, np.int64) for _ in range(3))
    run = equal_runs(text, start, length)
    by_group = np.empty(len(group), np.int64)  # documents numbered by group
    place = np.argsort(group, kind="stable")
    by_group[place] = np.arange(len(group))
    key = run * len(group) + by_group[doc]
    order = np.argsort(key)
    key = key[order]
    fresh = np.concatenate([[True], key[1:] != key[:-1]])  # first of a term's occurrences in a document
    of = group[place[key % len(group)]]
    term = key // len(group)
    first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (of[1:] != of[:-1])]))
    count = np.diff(np.append(first, len(key)))
    documents = np.add.reduceat(fresh.astype(np.int64), first)
    at = order[first]
    size = length[at]
    to = np.concatenate([[0], np.cumsum(size)])
    flat = text[np.repeat(start[at] - to[:-1], size) + np.arange(to[-1])]
    terms = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(to.astype(np.int64)), pa.py_buffer(flat))
    return terms.cast(pa.string()), of[first], count, documents


def shards(batch: pa.RecordBatch):
    """The batch in slices of about SHARD bytes of its first column."""
    size = bounds(batch.column(0))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, size[at] + SHARD, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term in every source of a language."""

    def run(batches):
        for whole in batches:
            for b in shards(whole) if whole.num_rows else ():
                lang, source = b.column(1).dictionary_encode(), b.column(2).dictionary_encode()
                n = len(source.dictionary)
                term, of, count, documents = shard_counts(b.column(0), lang.indices.to_numpy().astype(np.int64) * n + source.indices.to_numpy())
                yield pa.record_batch(
                    [lang.dictionary.take(pa.array(of // n)), source.dictionary.take(pa.array(of % n)), term, pa.array(count, pa.int64()), pa.array(documents, pa.int64())],
                    names=["lang", "source", "term", "n", "docs"],
                )

    rows = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counted = rows.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, term, per): the terms in at least `least` documents of a language, with their count in each source."""
    per = F.collect_list(F.struct("source", "n")).alias("per")
    return term_counts(docs).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), per).where(F.col("docs") >= least).select("lang", "term", "per")


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 2) / total), exactly; total is N + 2 V."""
    wide = int(total.max(initial=0)) >= 1 << 33  # UNIT times that doesn't fit 64 bits
    c, t = (count.astype(object), total.astype(object)) if wide else (count, total)
    return (1 + UNIT * (c + 2) // t).astype(np.int64)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def compared(kept: DataFrame, known: dict[str, tuple[list[str], np.ndarray, int, int]]) -> DataFrame:
    """Partial (lang, source, part, item, value) of blocks of kept terms; known has, by lang, its sources, their totals,
    the total of all and the number of kept terms."""

    def block(lang: str, terms: list[str], rows: list[list[dict]]):
        sources, totals, total, v = known[lang]
        at = {s: i for i, s in enumerate(sources)}
        count = np.zeros((len(sources), len(terms)), np.int64)
        for j, per in enumerate(rows):
            for x in per:
                count[at[x["source"]], j] = x["n"]
        p = share(count, np.broadcast_to((totals + 2 * v)[:, None], count.shape))
        q = share(count.sum(axis=0), np.full(len(terms), total + 2 * v))
        name = np.array(terms, object)
        for i, s in enumerate(sources):
            sums = distance(p[i], p[i + 1 :]).sum(axis=1).tolist()
            yield from ((lang, s, "pair", t, x) for t, x in zip(sources[i + 1 :], sums, strict=True))
            more = np.flatnonzero((count[i] > 0) & (p[i] > q))
            f = distance(p[i, more], q[more])
            best = sorted(zip((-f).tolist(), [t.encode() for t in name[more]], strict=True))[:TOP]
            yield from ((lang, s, "term", t.decode(), -x) for x, t in best)

    def run(batches):
        for whole in batches:
            for lang in whole.column(0).unique().to_pylist():
                mine = whole.filter(pa.compute.equal(whole.column(0), lang))
                step = max(1, CELLS // max(1, len(known[lang][0])))
                for k in range(0, mine.num_rows, step):
                    b = mine.slice(k, step)
                    out = list(block(lang, b.column(1).to_pylist(), b.column(2).to_pylist()))
                    yield pa.record_batch([pa.array([r[i] for r in out], pa.string() if i < 4 else pa.int64()) for i in range(5)], names=["lang", "source", "part", "item", "value"])

    return kept.mapInArrow(run, "lang string, source string, part string, item string, value bigint")


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source lies from the others of its language, and its most
    overused terms. docs needs text, lang and source."""
    keep = Tables(docs.sparkSession)
    kept = keep.written(kept_terms(docs, least))
    groups = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    totals = kept.select("lang", F.explode("per").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    rows = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").select("lang", "source", F.coalesce("total", F.lit(0)), F.coalesce("v", F.lit(0))).collect()
    known: dict = {}
    for lang, source, total, v in sorted(rows):
        known.setdefault(lang, []).append((source, total, v))
    known = {lang: ([s for s, _, _ in x], np.array([n for _, n, _ in x], np.int64), sum(n for _, n, _ in x), x[0][2]) for lang, x in known.items()}
    parts = compared(kept, known)
    every = docs.sparkSession.createDataFrame([(lang, x[0]) for lang, x in known.items()], "lang string, sources array<string>")
    none = every.select("lang", F.explode("sources").alias("source"), "sources").repartition("lang", "source").select("lang", "source", F.explode("sources").alias("item")).where("source < item")
    parts = parts.union(none.select("lang", "source", F.lit("pair"), "item", F.lit(0).cast("bigint")))
    sums = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    back = F.struct(F.col("item").alias("source"), F.col("source").alias("item"))
    both = F.when(F.col("part") == "pair", F.array(F.struct("source", "item"), back)).otherwise(F.array(F.struct("source", "item")))
    out = sums.select("lang", "part", "value", F.explode(both).alias("x")).select("lang", "x.source", "part", "x.item", "value")
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))


def query(spark, sf_dir: str) -> DataFrame:
    """op13: every source's divergence from the others of its language, and its ten most overused terms."""
    return divergence(table(spark, sf_dir, "documents"))


SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents
), t AS (
  SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL
), k AS (
  SELECT lang, term, sum(n) AS n FROM t GROUP BY ALL HAVING count(*) >= {LEAST}
), c AS (
  SELECT t.lang, t.source, t.term, sum(t.n) AS n FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL
), g AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL
), l AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + {UNIT}::HUGEINT * (coalesce(c.n, 0) + 2)::HUGEINT // (g.total + 2 * l.v)::HUGEINT AS HUGEINT) AS p,
         CAST(1 + {UNIT}::HUGEINT * (k.n + 2)::HUGEINT // (l.total + 2 * l.v)::HUGEINT AS HUGEINT) AS q
  FROM g JOIN k ON g.lang = k.lang JOIN l ON g.lang = l.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q
)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM parts) WHERE part = 'pair' OR rank <= {TOP}
"""
