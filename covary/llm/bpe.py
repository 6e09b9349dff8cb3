"""Operator 5: byte-level BPE encoding and decoding.

``encode`` splits every whole text by the tokenizer's pattern and folds the ranked merges over the bytes of each
distinct word: of all neighbouring parts whose concatenation has a rank, the lowest (leftmost of equals) is merged
until none has. A task keeps the words it has folded in a table of bounded size, so a word is folded about once per
task, and its ids are looked up everywhere else; nothing is shuffled. Words of over LONG bytes are merged with a heap,
so a text that is one long word costs n log n. ``decode`` concatenates the byte pieces of the ids.

``merge_words`` is the same fold in Spark's higher-order functions over a literal rank map, for a table of distinct
words. It is what the operator was first to use everywhere; see the README for why encode() does not.

A null text counts as the empty one and has no ids. Ids may be null or repeated; other columns are ignored; the rank
file is a parameter and is read on the driver only."""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covary.llm.shared import slices, table

RANKS = "byte_bpe_50k.tiktoken"
LONG = 48
HELD = 200_000
BUCKETS = 4096
#: White space as the tokenizer's engine has it; this one's \s takes in four control characters more.
PATTERN = public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


def read_ranks(path: str | None = None) -> dict[bytes, int]:
    with open(path or public_tokenizers.path(RANKS), "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > LONG:
        return _fold_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    get = ranks.get
    pair = [get(word[i : i + 2]) for i in range(len(word) - 1)]
    while True:
        best = min((r for r in pair if r is not None), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        i = pair.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pair[i]
        if i < len(pair):
            pair[i] = get(parts[i] + parts[i + 1])
        if i:
            pair[i - 1] = get(parts[i - 1] + parts[i])


def _fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(word)
    end, left, right = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))  # parts by their first byte
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = bytearray(b"\1") * n
    while heap:
        _, i, upto = heapq.heappop(heap)
        j = right[i]
        if not alive[i] or j >= n or end[j] != upto:
            continue
        alive[j], end[i], right[i] = 0, upto, right[j]
        if right[i] < n:
            left[right[i]] = i
            if (r := ranks.get(word[i : end[right[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[right[i]]))
        if left[i] >= 0 and (r := ranks.get(word[left[i] : upto])) is not None:
            heapq.heappush(heap, (r, left[i], upto))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class Words(dict):
    """word -> its ids as little-endian 32-bit integers; folds what it doesn't hold yet."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> bytes:
        ids = np.array(fold(word.encode("utf-8", "surrogatepass"), self.ranks), "<u4").tobytes()
        if len(word) <= LONG:
            if len(self) >= HELD:
                self.clear()
            self[word] = ids
        return ids


class Codec:
    """The tokenizer within one task."""

    def __init__(self, ranks: dict[bytes, int]):
        self.words = Words(ranks)
        self.find = regex.compile(PATTERN).findall
        self.pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.words.__getitem__, self.find(text))) if text else b""

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, ranks: dict[bytes, int] | None = None) -> DataFrame:
    """(doc_id, ids array<int>)"""
    ranks = docs.sparkSession.sparkContext.broadcast(ranks or read_ranks())

    def run(batches):
        codec = Codec(ranks.value)
        for b in slices(batches):
            got = [np.frombuffer(codec.encode(t.as_py()), "<u4").astype(np.int32) for t in b.column(1)]
            ends = pa.array(np.cumsum([0, *map(len, got)]).astype(np.int32))
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(got) if got else np.empty(0, np.int32)))], names=["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(tokens: DataFrame, ranks: dict[bytes, int] | None = None) -> DataFrame:
    """(doc_id, decoded binary) of (doc_id, ids)."""
    ranks = tokens.sparkSession.sparkContext.broadcast(ranks or read_ranks())

    def run(batches):
        codec = Codec(ranks.value)
        for b in slices(batches):
            out = [codec.decode(np.array(i.as_py() or [], "<u4").tobytes()) for i in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "decoded"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, decoded binary")


def digests(docs: DataFrame, ranks: dict[bytes, int] | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoded, decoded again and summed up in one pass; with_ids adds
    the ids themselves."""
    ranks = docs.sparkSession.sparkContext.broadcast(ranks or read_ranks())

    def run(batches):
        codec = Codec(ranks.value)
        for b in slices(batches):
            ids = [codec.encode(t.as_py()) for t in b.column(1)]
            cols = [
                b.column(0),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in ids], pa.string()),
            ]
            if with_ids:
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))))
            yield pa.record_batch(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(cols)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def merge_words(words: DataFrame, ranks: dict[bytes, int] | None = None) -> DataFrame:
    """(word, ids array<int>) of a column of distinct words, in higher-order functions only."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in (ranks or read_ranks()).items():
        key = piece.hex().upper()
        buckets[crc32(key.encode()) % BUCKETS][key] = rank
    literal = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")

    def rank(part: Column) -> Column:
        return F.try_element_at(F.get(literal, (F.crc32(part.cast("binary")) % BUCKETS).cast("int")), part)

    def step(parts: Column, _) -> Column:
        pairs = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p, i: rank(F.concat(p, F.get(parts, i + 1))))
        best = lambda r: F.array_min(r)

        def merged(r: Column) -> Column:
            at = F.array_position(r, best(r)).cast("int")
            both = F.array(F.concat(F.get(parts, at - 1), F.get(parts, at)))
            return F.when(best(r).isNull(), parts).otherwise(F.concat(F.slice(parts, 1, at - 1), both, F.slice(parts, at + 2, F.size(parts))))

        return F.when(F.size(parts) < 2, parts).otherwise(F.get(F.transform(F.array(pairs), merged), F.lit(0)))

    hexed = F.hex(F.col("word").cast("binary"))
    single = F.transform(F.sequence(F.lit(0), F.octet_length("word") - 1), lambda i: F.substring(hexed, 2 * i + 1, F.lit(2)))
    folded = F.aggregate(F.sequence(F.lit(1), F.octet_length("word")), single, step)
    ids = F.when(F.octet_length("word") == 0, F.array().cast("array<int>")).otherwise(F.transform(folded, rank))
    return words.select("word", ids.alias("ids"))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: every document's number of tokens and the digests of its ids and of what they decode to."""
    return digests(table(spark, sf_dir, "documents"))
