"""Operator 1: URL filters by a bit-parallel wildcard automaton.

Rules are globs over the canonical url "." + host + path (A-Z of the host lower-cased, no scheme, query or fragment):
``?`` is one byte but "/", ``*`` any run of bytes without "/", ``**`` any run of bytes. All rules are packed side by
side into one multiword Shift-And automaton, a bit per state; a step over the next byte of all the urls of an Arrow
batch is a shift with carry between words, a table look-up and two masks. Urls are taken longest first, so each step
works on just those that still have bytes.

A list rule (host, path) is the glob ``*.hostpath**``: the leading ``*`` can't cross into the path, so it fits the host
and its subdomains. Of the list rules that fit, the longest decides (of equals the one with the longer host, then
the blocking one); if none fits, a url that fits one of the block globs is blocked, any other allowed. A null url or
one without "://" has an empty host and path, fits nothing and is allowed. The batch's tables have a fixed size."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covary.llm.shared import ascii_lower, table

RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
BLOCK_GLOBS = ("*spam-farm*/**", "*.cheap-pills.*/**")


@dataclass
class Automaton:
    """step: bit j of step[c] lets state j-1 go on to j over byte c; stay: bit j of stay[c] lets j keep to itself."""

    start: np.ndarray
    final: np.ndarray
    step: np.ndarray
    stay: np.ndarray
    owner: list[tuple[int, int]]  # word and bit of each glob's last state

    @classmethod
    def of(cls, globs: list[list]) -> Automaton:
        n = sum(1 + sum(x not in ("*", "**") for x in g) for g in globs)
        words = max(1, -(-n // 64))
        a = cls(np.zeros(words, np.uint64), np.zeros(words, np.uint64), np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64), [])
        every, inside = np.arange(256), np.array([c for c in range(256) if c != ord("/")])
        state = 0
        for g in globs:
            bit = lambda s: (s // 64, np.uint64(1) << np.uint64(s % 64))
            w, b = bit(state)
            a.start[w] |= b
            for x in g:
                w, b = bit(state)
                if x in ("*", "**"):
                    a.stay[inside if x == "*" else every, w] |= b
                else:
                    state += 1
                    w, b = bit(state)
                    a.step[inside if x == "?" else x, w] |= b
            w, b = bit(state)
            a.final[w] |= b
            a.owner.append((w, state % 64))
            state += 1
        return a

    def fits(self, texts: list[bytes]) -> np.ndarray:
        """(texts, globs) booleans: which globs fit each whole text."""
        length = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-length, kind="stable")
        at = np.concatenate([[0], np.cumsum(length)[:-1]])[order] if len(texts) else length
        flat = np.frombuffer(b"".join(texts), np.uint8)
        d = np.tile(self.start, (len(texts), 1))
        longest_first = -length[order]
        for t in range(int(length.max(initial=0))):
            k = int(np.searchsorted(longest_first, -t, "left"))  # those longer than t
            c, now = flat[at[:k] + t], d[:k]
            shifted = now << np.uint64(1)
            shifted[:, 1:] |= now[:, :-1] >> np.uint64(63)
            d[:k] = (shifted & self.step[c]) | (now & self.stay[c])
        back = np.empty_like(d)
        back[order] = d
        return np.stack([(back[:, w] >> np.uint64(b)) & np.uint64(1) for w, b in self.owner], axis=1).astype(bool)


def parsed(glob: str) -> list:
    out: list = []
    i = 0
    raw = glob.encode()
    while i < len(raw):
        if raw[i] == ord("*"):
            many = raw[i + 1 : i + 2] == b"*"
            out.append("**" if many else "*")
            i += 1 + many
        else:
            out.append("?" if raw[i] == ord("?") else raw[i])
            i += 1
    return out


def host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)([^?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)([^?#]*)", 2)


def judge_urls(pages: DataFrame, rules=RULES, block_globs=BLOCK_GLOBS, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict) for every row; see above."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block"))
    globs = [["*", *f".{h}{p}".encode(), "**"] for _, h, p in ranked] + [parsed(g) for g in block_globs]
    automaton, n = Automaton.of(globs), len(ranked)
    names = np.array([h + p for _, h, p in ranked] + [None], object)
    said = np.array([v for v, _, _ in ranked] + ["allow", "block"], object)

    def run(batches):
        for b in batches:
            texts = [f".{h}{p}".encode("utf-8", "surrogatepass") for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            fit = automaton.fits(texts)
            first = np.where(fit[:, :n].any(axis=1), fit[:, :n].argmax(axis=1) if n else 0, n)
            verdict = np.where(first < n, first, n + fit[:, n:].any(axis=1))
            yield pa.record_batch([*b.columns, pa.array(names[first], pa.string()), pa.array(said[verdict], pa.string())], names=[key, "host", "path", "rule", "verdict"])

    kind = pages.schema[key].dataType.simpleString()
    rows = pages.select(F.col(key), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    return rows.mapInArrow(run, f"`{key}` {kind}, host string, path string, rule string, verdict string")


def query(spark, sf_dir: str) -> DataFrame:
    """op1: every page's host, path, the rule that decides and the verdict."""
    return judge_urls(table(spark, sf_dir, "pages"))


SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), hp AS (
  SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw, regexp_extract(substr(coalesce(rest, ''), length(regexp_extract(coalesce(rest, ''), '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u
), c AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM hp
), r(verdict, h, p) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fit AS (
  SELECT page_id, r.verdict, h || p AS rule, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, length(h) DESC, r.verdict DESC) AS k
  FROM c JOIN r ON ends_with('.' || c.host, '.' || r.h) AND starts_with(c.path, r.p)
)
SELECT c.page_id, host, path, rule,
       coalesce(verdict, CASE WHEN path LIKE '/%' AND (host LIKE '%spam-farm%' OR '.' || host LIKE '%.cheap-pills.%') THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN fit ON c.page_id = fit.page_id AND k = 1
"""
