"""Operator 2: near-duplicates by SimHash and a byte-position inverted index.

``fingerprints`` folds the shingle hashes of every whole text into one fingerprint. ``close_fingerprints`` links
fingerprints that differ in a few bits: the fingerprint is cut into positional bytes; if at most two bits differ, at
least six of the eight bytes are equal. Exact copies collapse to one fingerprint before anything is indexed. A list for
one positional byte alone would hold a 256th of the corpus, so the index is inverted on four of them at a time, in six
choices of which such a pair shares one. The shared positional bytes of the pairs in a list are tallied, pairs with
fewer than six go, the others are verified bit by bit. The pairs of a list of over LISTED members aren't made one by
one; it is searched, as exactly, by the values one bit away from its members, at 33 rows a member.

``near_duplicates`` is for the looser similarity that whole-corpus cleaning needs (Jaccard 0.8 on five-word shingles).
It moves 4 to 14 of SimHash's 64 bits, so that no positional byte need be equal; there a position's byte comes from the
shingle that is smallest under the position's own permutation, and two texts agree in a position as often as they are
similar. The index is inverted on BAND neighbouring positions; shared positional bytes are tallied per pair, pairs that
reach the least number stay (57 of 96 at 0.8) and are verified on all their shingles. A pair at a similarity of 0.8 is lost with
a chance of 5 in a million (3 that no key of 24 agrees, 1 to 2 that the tally falls short), a closer one more rarely.

Nulls: a null text has no words and gets fingerprint zero, as an empty one; a null doc_id is kept as a row and is
never the smallest id of a component (null only if no row of it has an id). Repeated rows get equal results. Other
columns are ignored. Very long texts are hashed in slices.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covary.llm.shared import Tables, connected_components, quoted, row_key, slices, table, written

SLICE = 1 << 15
_xxh64 = partial(xxhash.xxh64_intdigest, seed=42)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text: A-Z lower-cased, cut at ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_hashes(words: list[bytes], k: int, distinct: bool = False) -> np.ndarray:
    """XXH64 (seed 42) of every k-word shingle; the whole sequence if it is shorter; none if there are no words."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= k:
        return np.array([_xxh64(b" ".join(words))], np.uint64)
    n = len(words) - k + 1
    h = np.fromiter(map(_xxh64, map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))), np.uint64, n)
    return np.unique(h) if distinct else h


def majority_bits(hashes: np.ndarray) -> bytes:
    """The eight bytes whose bits are those set in over half the hashes."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), SLICE):
        part = np.ascontiguousarray(hashes[i : i + SLICE]).astype(">u8").view(np.uint8)
        total += np.unpackbits(part).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint long): bit 1 where over half the shingle hashes have it."""

    def run(batches):
        for b in slices(batches):
            out = [
                int.from_bytes(majority_bits(shingle_hashes(words_of(t.as_py()), shingle)), "big", signed=True)
                for t in b.column(1)
            ]
            yield pa.record_batch([b.column(0), pa.array(out, pa.int64())], names=["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint bigint")


def byte_at(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 56 - 8 * i).bitwiseAND(F.lit(255))


def shared_bytes(a: Column, b: Column) -> Column:
    """How many of the eight positional bytes two fingerprints share."""
    return sum(((byte_at(a, i) == byte_at(b, i)).cast("int") for i in range(8)), F.lit(0))


#: The eight positions in four couples. Of two fingerprints that share at least six positional bytes, at least two couples
#: agree, so that they meet in the posting list of one of the six choices of two couples.
COUPLES = ((0, 1), (2, 3), (4, 5), (6, 7))
KEYS = list(combinations(COUPLES, 2))
#: Members up to which a list's pairs are tallied one by one; a longer one is searched by neighbouring values instead.
LISTED = 64


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def postings(fps: DataFrame) -> DataFrame:
    """(n, kept, fp): the inverted index; kept holds the bytes of the n-th choice of positions, the others are zero."""
    fp = F.col("fingerprint")
    mask = [_signed(sum(255 << (56 - 8 * i) for couple in key for i in couple)) for key in KEYS]
    keys = F.array(*[F.struct(F.lit(n).cast("byte").alias("n"), fp.bitwiseAND(F.lit(m)).alias("kept")) for n, m in enumerate(mask)])
    return fps.select(fp.alias("fp"), F.explode(keys).alias("key")).select("key.n", "key.kept", "fp")


def tallied(lists: DataFrame) -> DataFrame:
    """(a, b, shared): the pairs of each list with the number of positional bytes they share."""
    x, y = lists.select("n", "kept", F.col("fp").alias("a")), lists.select("n", "kept", F.col("fp").alias("b"))
    return x.join(y, ["n", "kept"]).where("a < b").select("a", "b", shared_bytes(F.col("a"), F.col("b")).alias("shared"))


def _probed(lists: DataFrame) -> DataFrame:
    """Links (a, b) that connect all members of a list that differ in at most two bits: each member stands under itself
    and every value one bit away from it, and those that meet there are two bits apart at most. A value gathers 33
    members at most, whatever the list's length."""
    free = [[i for i in range(8) if not any(i in couple for couple in key)] for key in KEYS]
    flips = [F.array(F.lit(0), *[F.lit(_signed(1 << (56 - 8 * i + j))) for i in f for j in range(8)]) for f in free]
    flip = F.element_at(F.array(*flips), F.col("n").cast("int") + 1)
    met = lists.select("n", "kept", "fp", F.explode(F.transform(flip, lambda x: F.col("fp").bitwiseXOR(x))).alias("mid"))
    met = met.groupBy("n", "kept", "mid").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1)
    return met.select(F.array_min("members").alias("a"), F.explode("members").alias("b")).where("a < b")


def close_fingerprints(fps: DataFrame) -> DataFrame:
    """Distinct `fingerprint`s -> links (a, b) that connect exactly what links at two or fewer differing bits."""
    index = postings(fps)
    sizes = index.groupBy("n", "kept").agg(F.count("*").alias("size")).where("size > 1")
    lists = written(index.join(sizes, ["n", "kept"]))
    enough = tallied(lists.where(F.col("size") <= LISTED)).where("shared >= 6").select("a", "b")
    near = enough.union(_probed(lists.where(F.col("size") > LISTED)))
    return near.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).distinct()


def simhash_components(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id): component_id is the smallest doc_id reachable over links of two bits."""
    fp = written(fingerprints(docs, shingle))
    firsts = fp.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    label = connected_components(close_fingerprints(firsts))
    groups = firsts.join(label, firsts["fingerprint"] == label["node"], "left").select(
        "fingerprint", "first", F.coalesce("component", "fingerprint").alias("component")
    )
    least = groups.groupBy("component").agg(F.min("first").alias("component_id"))
    of = written(groups.join(least, "component").select("fingerprint", "component_id"))
    return fp.join(of, "fingerprint").select("doc_id", "fingerprint", "component_id")


# ---------------------------------------------------------------- similarity 0.8 on five-word shingles

#: Positions of a sketch, and how many neighbouring ones make a key of the index.
POSITIONS, BAND = 96, 4
#: How many standard deviations below its mean a pair's number of shared positional bytes may lie. At a similarity of
#: 0.8 that is 57 bytes where 77 are the mean; one pair in a million has fewer.
DEVIATIONS = 5
#: So that a product with a similarity isn't above a whole number by its last bit.
EPSILON = 1e-6
_ODD = np.random.default_rng(5).integers(1, 1 << 63, (2, POSITIONS), dtype=np.uint64) | np.uint64(1)
_ODD.setflags(write=False)


def minima(hashes: np.ndarray) -> np.ndarray:
    """For each position the smallest of the hashes under that position's permutation."""
    out = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 512):
        mixed = (hashes[i : i + 512, None] ^ _ODD[0]) * _ODD[1]
        np.minimum(out, mixed.min(axis=0), out=out)
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(row, text_key, n, positions, keys): text_key is one for texts of equal words, n the number of distinct shingles,
    positions the sketch's bytes, eight in a long, keys the index's keys."""

    def run(batches):
        for b in slices(batches):
            digests, sizes, minimal = [], [], []
            for t in b.column(1):
                words = words_of(t.as_py())
                h = shingle_hashes(words, shingle, distinct=True)
                digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
                sizes.append(len(h))
                minimal.append(minima(h))
            m = _mixed(np.array(minimal, np.uint64).reshape(-1, POSITIONS))
            positions = np.ascontiguousarray((m >> np.uint64(56)).astype(np.uint8)).view("<i8")
            bands = m.reshape(len(m), -1, BAND) * _ODD[1, :BAND]
            keys = _mixed(np.bitwise_xor.reduce(bands ^ (bands >> np.uint64(29)), axis=2) + _ODD[0, : POSITIONS // BAND]).view(np.int64)
            fixed = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.record_batch(
                [b.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), fixed(positions), fixed(keys)],
                names=["row", "text_key", "n", "positions", "keys"],
            )

    kind = docs.schema["row"].dataType.simpleString()
    return docs.select("row", "text").mapInArrow(run, f"row {kind}, text_key binary, n int, positions array<bigint>, keys array<bigint>")


def shared_positions(a: Column, b: Column) -> Column:
    """How many positional bytes two sketches share."""

    def equal_bytes(x: Column) -> Column:
        for k in (4, 2, 1):  # a byte's lowest bit becomes one if any of its bits is
            x = x.bitwiseOR(F.shiftrightunsigned(x, k).bitwiseAND(F.lit(int.from_bytes(bytes([(1 << (8 - k)) - 1] * 8), "big"))))
        return F.lit(8) - F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))

    return sum((equal_bytes(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(POSITIONS // 8)), F.lit(0))


def _shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(fid, shingles): the hashes of the distinct k-word shingles."""

    def run(batches):
        for b in slices(batches):
            sets = [shingle_hashes(words_of(t.as_py()), k, distinct=True).view(np.int64) for t in b.column(1)]
            lengths = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64), pa.int64())
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(lengths), flat)], names=["fid", "shingles"])

    return docs.select("fid", "text").mapInArrow(run, "fid bigint, shingles array<bigint>")


def mixed_lists(members: DataFrame) -> DataFrame:
    """(key, big, own, all) of the posting lists whose members lie in several parts: the largest part, its members in the
    list and all members. members is (key, fid, part, ...)."""
    sizes = members.groupBy("key", "part").agg(F.count("*").alias("own"))
    lists = sizes.groupBy("key").agg(F.sum("own").alias("all"), F.max(F.struct("own", "part")).alias("big"), F.count("*").alias("parts"))
    return lists.where("parts > 1").select("key", F.col("big.part").alias("big"), F.col("big.own").alias("own"), "all")


def across_parts(members: DataFrame, alike: Callable[[str, str], Column], block: int = 500, tables: Tables | None = None) -> DataFrame:
    """(x, y) for every two members of a posting list that lie in different parts and are alike, once per list. alike gets
    the prefixes of the two sides' columns. Only members outside the list's largest part are dealt to tiles of
    about `block`, and every member meets each tile: no list is cut, a long one is spread over tasks, and one that a
    single part fills but for a few members isn't repeated. With tables, what both sides read is written there."""
    tiles = F.ceil((F.col("all") - F.col("own")) / block).cast("int").alias("tiles")
    mixed = members.join(mixed_lists(members).select("key", "big", tiles), "key")
    mixed = tables.written(mixed) if tables else mixed
    cols = [c for c in members.columns if c != "key"]
    x = mixed.where("part != big").select("key", F.pmod(F.xxhash64("fid"), "tiles").cast("int").alias("tile"), *[F.col(c).alias(f"x_{c}") for c in cols])
    y = mixed.select("key", "big", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), *[F.col(c).alias(f"y_{c}") for c in cols])
    once = (F.col("y_part") == F.col("big")) | (F.col("x_part") < F.col("y_part"))
    return x.join(y, ["key", "tile"]).where(once & alike("x_", "y_")).select(F.least("x_fid", "y_fid").alias("x"), F.greatest("x_fid", "y_fid").alias("y"))


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, tables: Tables | None = None) -> DataFrame:
    """(row, group) for every row of docs: rows of one group are linked by equal words or by a Jaccard similarity of
    the distinct `shingle`-word shingles of at least `similarity`; group is the smallest row. docs needs `row` (of any
    orderable type; rows of equal id and text may share it) and `text`.

    First each text meets the most alike of its lists' leaders, then, where a list isn't one part yet, all of them on all
    shingles; what these pairs link makes parts. Then members of different parts meet, over what sets them apart from
    their leader: a large group of copies, or of texts that share a pattern, costs a number of rows that grows with its
    size, and no list of any length is cut. Every other pair whose shared positional bytes reach the minimum is verified on all shingles,
    so that nothing is linked that isn't similar. The index is made for similarities of 0.8 and more.

    What more than one side of a join reads is written first. Spark plans a query anew after each of its stages, so the
    driver's memory follows the largest single plan; several small ones need less of it."""
    least_shared = int(POSITIONS * similarity - DEVIATIONS * math.sqrt(POSITIONS * similarity * (1 - similarity)))
    keep, brief = tables or Tables(docs.sparkSession), Tables(docs.sparkSession)
    sketch = keep.written(sketches(docs, shingle))
    # one row per different text; its number is fixed once it is written
    texts = sketch.groupBy("text_key").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("positions").alias("positions"), F.first("keys").alias("keys"))
    texts = keep.written(texts.select(F.monotonically_increasing_id().alias("fid"), "*"))
    postings = texts.where("n > 0").select(F.explode("keys").alias("key"), "fid", "n")
    lists = postings.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = brief.written(postings.join(lists, "key"))
    # lists are led by the member that has the most company over all its lists: of a text and its edited copies that is
    # the text, to which all copies are more alike than to each other
    company = members.groupBy("fid").agg(F.sum("size").alias("company"))
    members = keep.written(members.join(company, "fid").select("key", "fid", "n", (-F.col("company")).alias("rank")))
    brief.drop()
    positions = texts.select("fid", "n", "positions")

    def alike(x: str, y: str) -> Column:
        """What two sizes allow."""
        return F.least(x + "n", y + "n") >= similarity * F.greatest(x + "n", y + "n") - EPSILON

    def tallied_pairs(pairs: DataFrame) -> DataFrame:
        """Those of the distinct (a, b) that share enough positional bytes, with their number."""
        x, y = (positions.select(F.col("fid").alias(s), F.col("n").alias(f"{s}_n"), F.col("positions").alias(f"{s}_p")) for s in "ab")
        shared = pairs.join(x, "a").join(y, "b").where(alike("a_", "b_")).select("a", "b", shared_positions(F.col("a_p"), F.col("b_p")).alias("shared"))
        return shared.where(F.col("shared") >= least_shared)

    def best_of(pairs: DataFrame) -> DataFrame:
        """For each b the pair that shares most."""
        best = tallied_pairs(pairs).groupBy("b").agg(F.max(F.struct("shared", (-F.col("a")).alias("a"))).alias("best"))
        return brief.written(best.select((-F.col("best.a")).alias("a"), "b"))

    # the shingles of all texts that stand in any list, in one pass over the texts
    listed = members.select("fid").distinct().join(texts.select("fid", "row"), "fid")
    sets = keep.written(_shingle_sets(docs.select("row", "text").join(listed, "row").dropDuplicates(["fid"]), shingle))

    def similar(pairs: DataFrame) -> DataFrame:
        x, y = (sets.select(F.col("fid").alias(s), F.col("shingles").alias(f"{s}_s")) for s in "ab")
        common = F.size(F.array_intersect("a_s", "b_s"))
        ok = common >= similarity * (F.size("a_s") + F.size("b_s") - common) - EPSILON
        return keep.written(pairs.join(y, "b").join(x, "a").where(ok).select("a", "b"))

    first = members.groupBy("key").agg(F.min(F.struct("rank", "fid"))["fid"].alias("a"))
    led = members.join(first, "key").where("a != fid").select("a", F.col("fid").alias("b")).distinct()
    ok = similar(best_of(led))
    brief.drop()
    # every member has one link at most, to one that ranks before it, so its part is what two steps up lead to; a chain
    # of more steps is several parts, which meet like any others
    part = ok.select(F.col("b").alias("fid"), F.col("a").alias("part"))
    above = part.select(F.col("fid").alias("part"), F.col("part").alias("higher"))
    part = part.join(above, "part", "left").select("fid", F.coalesce("higher", "part").alias("part"))
    label = keep.written(listed.select("fid").join(part, "fid", "left").select("fid", F.coalesce("part", "fid").alias("part")))
    # What is left are lists whose members lie in different parts. Each member is measured against the list's leader: how
    # many of its shingles the leader holds, and which ones only one of the two has.
    apart = members.select("key", "fid", "n").join(label, "fid")
    apart = brief.written(apart.join(mixed_lists(apart).select("key"), "key").join(first, "key").select("key", "fid", "a"))
    x, y = (sets.select(F.col("fid").alias(s), F.col("shingles").alias(f"{s}_s")) for s in "ab")
    held = apart.where("a != fid").select("a", F.col("fid").alias("b")).distinct().join(y, "b").join(x, "a")
    inside, n = F.size(F.array_intersect("a_s", "b_s")).alias("inside"), F.size("b_s").alias("n")
    differ = F.concat(F.array_except("b_s", "a_s"), F.array_except("a_s", "b_s")).alias("differ")
    held = keep.written(held.select("a", "b", inside, F.size("a_s").alias("a_n"), n, differ))
    to_leader = F.col("inside") >= similarity * (F.col("a_n") + F.col("n") - F.col("inside")) - EPSILON
    parts = connected_components(ok.union(held.where(to_leader).select("a", "b")))
    label = listed.select("fid").join(parts, F.col("fid") == F.col("node"), "left").select("fid", F.coalesce("component", "fid").alias("part"))
    label = keep.written(label)
    # Two members share inside + inside - a_n shingles and as many more as their differences from the leader share: they
    # meet under those. Of a member's differences only those are indexed, rarest first, that a partner can't all lack:
    # with `over` of them and at least `least` to be shared, the first over - least + 1. A partner of n shingles adds
    # share * n to what must be shared and min(n, a_n) at most to what is, so that it lessens `least` by (1 - share) * a_n
    # at most; one that the leader doesn't link lessens it by less than share * a_n, and a member that it links need meet
    # no others. So `least` is over zero for every two members of different parts.
    mixed = mixed_lists(apart.join(label, "fid")).select("key")
    still = brief.written(apart.join(mixed, "key").where("a != fid").select("a", F.col("fid").alias("b")).distinct())
    share, over = similarity / (1 + similarity), F.size("differ")
    partner = F.when(to_leader, 1 - share).otherwise(share) * F.col("a_n")
    least = F.greatest(F.lit(1), F.ceil(share * F.col("n") - F.col("inside") + partner - EPSILON))
    differing = held.join(still, ["a", "b"]).select("a", F.col("b").alias("fid"), "n", "a_n", "inside", over.alias("over"), (over - least + 1).alias("first"), F.explode("differ").alias("shingle"))
    common = differing.groupBy("a", "shingle").agg(F.count("*").alias("df")).where("df > 1")
    # a shingle in which no other member differs comes first in its member's order and meets nobody
    shared = differing.join(common, ["a", "shingle"])
    nth = F.row_number().over(Window.partitionBy("a", "fid").orderBy("df", "shingle"))
    alone = F.col("over") - F.count("*").over(Window.partitionBy("a", "fid"))
    shared = shared.withColumn("nth", nth + alone).where("nth <= first").join(label, "fid")
    index = brief.written(shared.select(F.xxhash64("a", "shingle").alias("key"), "a", "fid", "n", "part", "a_n", "inside", "over", "nth"))

    def can_reach(x: str, y: str) -> Column:
        """Whether the two, first met under this shingle, may share as many as their sizes ask for."""
        needed = F.ceil(share * (F.col(x + "n") + F.col(y + "n")) - EPSILON) - F.col(x + "inside") - F.col(y + "inside") + F.col(x + "a_n")
        left = F.least(F.col(x + "over") - F.col(x + "nth"), F.col(y + "over") - F.col(y + "nth")) + 1
        return (F.col(x + "a") == F.col(y + "a")) & alike(x, y) & (left >= needed)

    met = brief.written(across_parts(index, can_reach, tables=brief).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    across = similar(brief.written(tallied_pairs(met).select("a", "b")))
    brief.drop()
    label = connected_components(label.select(F.col("part").alias("a"), F.col("fid").alias("b")).union(across))
    groups = texts.join(label, texts["fid"] == label["node"], "left").select("text_key", "row", F.coalesce("component", "fid").alias("component"))
    least = groups.groupBy("component").agg(F.min("row").alias("group"))
    return sketch.select("row", "text_key").join(groups.select("text_key", "component").join(least, "component"), "text_key").select("row", "group")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs without the rows that are near-duplicates of another; the row with the smallest doc_id of each group stays
    (of rows that agree in doc_id and text one; a null doc_id comes last)."""
    keep = Tables(docs.sparkSession)
    cols = [F.col(quoted(c)) for c in docs.columns]
    # the row's columns travel as one struct, so that no name of theirs can clash with the key
    keyed = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row"), F.struct(*cols).alias("of"))
    group = near_duplicates(keyed.select("row", F.col("of.text").alias("text")), tables=keep, **options)
    place = F.struct(F.col("of.doc_id").isNull().alias("last"), F.col("of.doc_id").alias("doc_id"), "row")
    places = keyed.select("row", place.alias("place")).groupBy("row").agg(F.first("place").alias("place"), F.count("*").alias("times"))
    ranked = keep.written(group.dropDuplicates(["row"]).join(places, "row"))
    best = ranked.groupBy("group").agg(F.min("place").alias("best"))
    stays = ranked.join(best, "group").where("place = best").select("row", "times")
    result = Tables(docs.sparkSession)
    stays = result.written(stays)
    keep.drop()
    kept = keyed.join(stays, "row")
    if stays.where("times > 1").isEmpty():
        return kept.select("of.*")
    # rows that agree in doc_id and text: only these are brought together
    return kept.where("times = 1").select("of.*").union(kept.where("times > 1").dropDuplicates(["row"]).select("of.*"))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: every document's fingerprint as 16 hex digits and the smallest doc_id it reaches."""
    out = simhash_components(table(spark, sf_dir, "documents"), shingle=3)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
