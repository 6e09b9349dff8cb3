"""Operator 3: benchmark decontamination by winnowing, in DataFrame functions only.

Of the hashes of every GRAM = 5 consecutive words, the smallest of every SPAN = 6 neighbours is kept, with its place.
A passage of GRAM + SPAN - 1 = 10 words that a document shares with an item holds at least one hash that both keep, so
joining the kept hashes misses none; each hit is then extended word by word, five to either side, and counts if it
grows to ten words. Each kept hash travels with the 15 words around it, so hits are extended where they are found and
no text is shuffled. Items of one to nine words are one window each, which winnowing can't promise to find; all the
word runs of just those lengths are joined to them, in one more pass whatever the lengths.

The item side doesn't grow with the documents. It is counted first and broadcast only while it has at most
BROADCAST_GRAMS kept hashes (some 30 MB); beyond that the join shuffles both sides on the hash, and AQE splits hot ones.

Words are compared by their 64-bit hashes. A null text has no words; rows that agree in doc_id and text are counted
once and all get the result; ids may be null (a null item_id is found but neither listed nor counted); items of
equal words are matched once for all their ids; an empty benchmark leaves every document clean; other columns are
ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covary.llm.shared import ascii_lower, let, quoted, row_key, table, written

#: Runs of digits, lower-case letters and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM, SPAN = 5, 6
WINDOW = GRAM + SPAN - 1
SIDE = WINDOW - GRAM
PLACE = (1 << 30) - 1
BROADCAST_GRAMS = 100_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def kept_grams(h: Column) -> Column:
    """Word hashes -> array<bigint>: of each window the smallest (34 bits of gram hash, 30 bits of place)."""
    first = lambda a, n: F.slice(a, 1, F.greatest(F.size(a) - n, F.lit(0)))
    gram = F.transform(
        first(h, GRAM - 1),
        lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, GRAM)]).bitwiseAND(F.lit(~PLACE)).bitwiseOR(i.cast("bigint")),
    )
    return gram, lambda g: F.array_distinct(F.transform(first(g, SPAN - 1), lambda x, i: F.least(x, *[F.get(g, i + j) for j in range(1, SPAN)])))


def located(df: DataFrame, keys: list[str]) -> DataFrame:
    """A row per kept gram: its hash, its place and the hashes of the words around it (null beyond the ends)."""
    gram, winnow = kept_grams(F.col("h"))
    beyond = F.array_repeat(F.lit(None).cast("bigint"), SIDE)

    def hit(m: Column, h: Column) -> Column:
        place = m.bitwiseAND(F.lit(PLACE)).cast("int")
        return F.struct(F.shiftright(m, 30).alias("gram"), place.alias("place"), F.slice(h, place + 1, F.lit(GRAM + 2 * SIDE)).alias("near"))

    kept = df.withColumn("g", gram).withColumn("kept", winnow(F.col("g")))
    return kept.select(*keys, F.explode(let(F.concat(beyond, "h", beyond), lambda h: F.transform("kept", lambda m: hit(m, h)))).alias("x")).select(*keys, "x.gram", "x.place", "x.near")


def item_grams(items: DataFrame) -> DataFrame:
    """(ids, gram, item_near): each kept gram of an item once for each surroundings. Where an item repeats one phrase, all
    places within it are alike, so that a document's gram meets a bounded number of them and not every place."""
    return located(items, ["ids"]).withColumnRenamed("near", "item_near").drop("place").distinct()


def _extended(hits: DataFrame) -> DataFrame:
    """Hits of a document's gram on an item's: how far the words agree, as (start, n)."""
    same = [F.get("near", F.lit(i)).isNotNull() & F.get("near", F.lit(i)).eqNullSafe(F.get("item_near", F.lit(i))) for i in range(GRAM + 2 * SIDE)]

    def run(order: list[int]) -> Column:
        out = F.lit(len(order))
        for n, i in reversed(list(enumerate(order))):
            out = F.when(~same[i], F.lit(n)).otherwise(out)
        return out

    left, right = run(list(range(SIDE - 1, -1, -1))), run(list(range(SIDE + GRAM, GRAM + 2 * SIDE)))
    core = run(list(range(SIDE, SIDE + GRAM)))
    return (
        hits.withColumn("left", left)
        .withColumn("n", F.col("left") + GRAM + right)
        .where((core == GRAM) & (F.col("n") >= WINDOW))
        .select("row", "ids", (F.col("place") - F.col("left")).alias("start"), "n")
    )


def _runs(n: int) -> Column:
    """Every run of n words of `h`, as (n, hash, start)."""
    start = F.slice("h", 1, F.greatest(F.size("h") - (n - 1), F.lit(0)))
    return F.transform(start, lambda x, i: F.struct(F.lit(n).alias("n"), F.xxhash64(x, *[F.get("h", i + j) for j in range(1, n)]).alias("run"), i.alias("start")))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(row, n_hit, items): for each document row (see row_key) with a hit, how many of its words lie in an item's
    window and the sorted ids, as strings, of those items."""
    items = (
        benchmark.select(F.col("item_id").cast("string").alias("id"), word_hashes(F.col("text")).alias("h"))
        .where(F.size("h") > 0)
        .groupBy("h")
        .agg(F.collect_set("id").alias("ids"))
    )
    items = written(items)
    text = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row"), word_hashes(F.col("text")).alias("h"))
    grams = written(item_grams(items))
    few = grams.count() <= BROADCAST_GRAMS
    small = F.broadcast if few else (lambda df: df)
    found = _extended(located(text, ["row"]).join(small(grams), "gram"))
    lengths = [n for (n,) in items.where(F.size("h") < WINDOW).select(F.size("h")).distinct().collect()]  # at most nine
    if lengths:
        run_of = F.coalesce(*[F.when(F.size("h") == n, F.xxhash64(*[F.get("h", F.lit(j)) for j in range(n)])) for n in lengths])
        short = items.where(F.size("h") < WINDOW).select(F.size("h").alias("n"), run_of.alias("run"), "ids")
        at = text.select("row", F.explode(F.concat(*[_runs(n) for n in sorted(lengths)])).alias("x")).select("row", "x.*")
        found = found.union(at.join(small(short), ["n", "run"]).select("row", "ids", "start", "n"))
    hit = found.select("row", "ids", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("word"))
    return hit.groupBy("row").agg(
        F.count_distinct("word").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a window of an item."""
    # the row's columns travel as one struct, so that no name of theirs can clash with the key
    keyed = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row"), F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("of"))
    found = written(contaminated(docs, benchmark).select("row"))
    return keyed.join(found, "row", "left_anti").select("of.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: per document its words, those inside an item's window, and those items."""
    docs = table(spark, sf_dir, "documents")
    found = contaminated(docs, table(spark, sf_dir, "benchmark"))
    # counting needs no lower-casing: the upper-case letters are in the class instead
    n_words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    rows = docs.select("doc_id", n_words.cast("bigint").alias("n_words"), row_key(F.col("doc_id"), F.col("text")).alias("row"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return rows.join(found, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), iw AS (
  SELECT DISTINCT id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS s
  FROM (SELECT id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)
), hits AS (
  SELECT doc_id, i, dw.n AS n, id FROM dw JOIN iw ON dw.n = iw.n AND dw.s = iw.s
), p AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM hits) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
