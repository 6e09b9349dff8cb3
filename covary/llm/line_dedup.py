"""Operator 7: substring deduplication by hashing lines and runs of lines and sentences.

A text is cut into units behind its line feeds and behind sentence ends (`.`, `!` or `?` before white space); a unit is
normalised (A-Z lower-cased, runs of ASCII white space to one space, trimmed). Hashed to 128 bits are

* every line that has at least `line` words, whatever its neighbours, and
* from every unit that has words, the shortest run of units that reaches `words` words, so that units of any length
  count and a passage is found wherever in a line it stands and however it is wrapped.

Digests are grouped over all documents; what ranks first (smallest doc_id, then place; a null doc_id last) stays, and the
units of every other one are removed, with their code-point offsets in the original text kept in `removed`. Whatever goes
has equal words at an earlier place, so that no wording is lost. What stays of a repeated passage are the parts of
sentences at its two ends, units behind its last full run (fewer than `words` words) unless they are lines, and passages
whose whole sentences have fewer than `words` words together and whose lines have fewer than `line`.

Texts are hashed once, and only digests and places are shuffled for grouping: the first place of each digest is a partial
minimum, so a passage that stands in a third of all documents reaches the reducer once per task; the join that brings it
back to the places is an ordinary one, which AQE splits where a digest is hot. Spans are merged by a window over their
document and cut out in one pass over its text, so that a text of any number of repeats takes linear time.

A null text has no unit and stays null; rows that agree in doc_id and text count as one document and get one result
each; what overlaps its own first place stays; an empty table gives an empty result; other columns are kept by
drop_repeats."""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covary.llm.shared import Tables, quoted, slices, table

#: Runs that matter are longer than this; clean texts share no run of this length.
WORDS = 20
#: Words of a line that counts by itself: longer than headings and list marks.
LINE = 8
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: A unit with what ends it. Every place of a text lies in just one unit.
_UNIT = r"[^.!?\n]*(?:[.!?]+[^\x20\x09-\x0D.!?][^.!?\n]*)*(?:[.!?]+[\x20\x09\x0B-\x0D]+|[.!?]*\n|[.!?]*{end})"
UNIT = re.compile(_UNIT.format(end=r"\Z"))
SPANS = "array<struct<start:int,end:int>>"


def runs(text: str, least: int, line: int = LINE) -> list[tuple[int, int, bytes]]:
    """(start, end, digest) of the lines of `line` words and more, and of the shortest run of units from each one with
    words that reaches `least` words."""
    words, starts, ends, lines, at, nth = [], [], [], [], 0, 0
    for unit in UNIT.findall(text):
        w = unit.encode("utf-8", "surrogatepass").translate(_LOWER).split()
        if w:
            words.append(w)
            starts.append(at)
            ends.append(at + len(unit))
            lines.append(nth)
        at += len(unit)
        nth += unit.endswith("\n")
    flat = [x for w in words for x in w]
    upto = [0, *accumulate(map(len, words))]
    spans = set()
    for i in range(len(starts)):
        j = bisect_left(upto, upto[i] + least)
        if j > len(words):
            break
        spans.add((i, j))
    begin = 0
    for i in range(1, len(lines) + 1):
        if i == len(lines) or lines[i] != lines[begin]:
            if upto[i] - upto[begin] >= line:
                spans.add((begin, i))
            begin = i
    return [(starts[i], ends[j - 1], xxhash.xxh3_128_digest(b" ".join(flat[upto[i] : upto[j]]))) for i, j in sorted(spans)]


def row_hash() -> Column:
    """With doc_id, the identity of a row: rows of equal id are told apart by 64 bits of their text."""
    return F.xxhash64("text", F.col("text").isNull(), "doc_id")


def hashed_runs(docs: DataFrame, words: int = WORDS, line: int = LINE) -> DataFrame:
    """(doc_id, row, start, end, hi, lo) for every run; hi and lo are the digest's halves."""

    def run(batches):
        for b in slices(batches):
            found = [runs(t.as_py() or "", words, line) for t in b.column(2)]
            take = pa.array([i for i, f in enumerate(found) for _ in f], pa.int32())
            flat = [x for f in found for x in f]
            halves = [pa.array([int.from_bytes(x[2][k : k + 8], "big", signed=True) for x in flat], pa.int64()) for k in (0, 8)]
            yield pa.record_batch(
                [b.column(0).take(take), b.column(1).take(take), *(pa.array([x[k] for x in flat], pa.int32()) for k in (0, 1)), *halves],
                names=["doc_id", "row", "start", "end", "hi", "lo"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", row_hash().alias("row"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, row bigint, start int, end int, hi bigint, lo bigint")


def repeats(docs: DataFrame, words: int = WORDS, line: int = LINE, tables: Tables | None = None) -> DataFrame:
    """(doc_id, row, removed): for each document with a run that isn't the first of its digest, the spans to remove, those
    that overlap or touch being one."""
    keep = tables or Tables(docs.sparkSession)
    found = keep.written(hashed_runs(docs, words, line))
    place = F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "row", "start", "end")
    first = keep.written(found.groupBy("hi", "lo").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("hi", "lo", "first"))
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row") == F.col("first.row"))
    later = found.join(first, ["hi", "lo"]).where(~same | (F.col("start") >= F.col("first.end")))
    of = ["doc_id", "row"]
    spans = later.select(*of, "start", "end").repartition(*of).groupBy(*of, "start").agg(F.max("end").alias("end"))
    reached = F.max("end").over(Window.partitionBy(*of).orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("fresh", F.when(F.col("start") <= reached, 0).otherwise(1))
    spans = spans.withColumn("island", F.sum("fresh").over(Window.partitionBy(*of).orderBy("start")))
    spans = spans.groupBy(*of, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return spans.groupBy(*of).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("removed"))


@F.pandas_udf(T.StringType())
def _cut(text: pd.Series, ends: pd.Series) -> pd.Series:
    """The texts without the spans, whose starts and ends are given in turn."""

    def one(t, at):
        if t is None or at is None:
            return None
        at = [0, *at, len(t)]
        return "".join(t[at[i] : at[i + 1]] for i in range(0, len(at), 2))

    return pd.Series([one(t, at) for t, at in zip(text, ends, strict=True)], dtype=object)


def without_repeats(docs: DataFrame, words: int = WORDS, line: int = LINE) -> DataFrame:
    """(of, text, removed): the row's columns as they were, as one struct; its text without repeats; and the code-point
    spans of the original that went."""
    keep, result = Tables(docs.sparkSession), Tables(docs.sparkSession)
    gone = result.written(repeats(docs, words, line, keep).select(F.col("doc_id").alias("gone_id"), F.col("row").alias("gone_row"), "removed"))
    keep.drop()
    keyed = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("of"), row_hash().alias("row"))
    out = keyed.join(gone, F.col("of.doc_id").eqNullSafe(F.col("gone_id")) & (F.col("row") == F.col("gone_row")), "left")
    spans, text = F.col("removed"), F.col("of.text")
    ends = F.flatten(F.transform(spans, lambda s: F.array(s["start"], s["end"])))
    cut = _cut(F.when(spans.isNotNull(), text), ends)
    return out.select("of", F.when(spans.isNull(), text).otherwise(cut).alias("text"), F.coalesce(spans, F.array().cast(SPANS)).alias("removed"))


def drop_repeats(docs: DataFrame, words: int = WORDS, line: int = LINE) -> DataFrame:
    """docs, of the same columns, with the repeated units cut out of text; n_chars, if there, follows the new text."""
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        n = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.size("removed") > 0, n).otherwise(F.col("of.n_chars"))
    return without_repeats(docs, words, line).select(*[changed.get(c, F.col("of").getField(c)).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """op7: every document's text without what an earlier one holds, and the removed spans as start-end,start-end."""
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    span = F.transform("removed", lambda s: F.concat_ws("-", s["start"], s["end"]))
    return out.select(F.col("of.doc_id").alias("doc_id"), "text", F.size("removed").cast("bigint").alias("n_removed"), F.array_join(span, ",").alias("removed"))


SQL = rf"""
WITH u AS (
  SELECT doc_id, k, l[k] AS unit FROM (SELECT doc_id, l, unnest(generate_series(1, len(l))) AS k
  FROM (SELECT doc_id, regexp_extract_all(text, '{_UNIT.format(end="$")}') AS l FROM documents))
), n AS (
  SELECT *, CASE WHEN norm = '' THEN 0 ELSE length(norm) - length(replace(norm, ' ', '')) + 1 END AS w FROM (
    SELECT doc_id, k, unit, trim(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM u)
), c AS (
  SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY k) AS upto, sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY k) - length(unit) AS s,
         coalesce(sum(CAST(unit LIKE '%' || chr(10) AS INT)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM n
), r AS (
  SELECT doc_id, min(k) AS i, max(k) AS j FROM c WHERE w > 0 GROUP BY doc_id, line HAVING sum(w) >= {LINE}
  UNION
  SELECT a.doc_id, a.k AS i, min(b.k) AS j FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.k >= a.k AND b.upto >= a.upto - a.w + {WORDS} WHERE a.w > 0 GROUP BY ALL
), l AS (
  SELECT doc_id, list(norm ORDER BY k) AS norms FROM n GROUP BY doc_id
), t AS (
  SELECT doc_id, i, j, first_value(struct_pack(d := doc_id, j := j)) OVER (PARTITION BY run ORDER BY doc_id, i) AS f
  FROM (SELECT doc_id, i, j, array_to_string(list_filter(list_slice(norms, i, j), lambda x: x <> ''), ' ') AS run FROM r JOIN l USING (doc_id))
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, j)) AS k FROM t WHERE doc_id <> f.d OR i > f.j
), g AS (
  SELECT c.*, gone.k IS NOT NULL AS gone FROM c LEFT JOIN gone ON c.doc_id = gone.doc_id AND c.k = gone.k
), spans AS (
  SELECT doc_id, min(s) AS s, max(s + length(unit)) AS e FROM (SELECT *, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS island FROM g WHERE gone) GROUP BY doc_id, island
), listed AS (
  SELECT doc_id, count(*) AS n, string_agg(CAST(s AS VARCHAR) || '-' || CAST(e AS VARCHAR), ',' ORDER BY s) AS removed FROM spans GROUP BY doc_id
), kept AS (
  SELECT doc_id, coalesce(string_agg(unit, '' ORDER BY k) FILTER (NOT gone), '') AS text FROM g GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE kept.text END AS text, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(removed, '') AS removed
FROM documents d LEFT JOIN kept ON d.doc_id = kept.doc_id LEFT JOIN listed ON d.doc_id = listed.doc_id
"""
