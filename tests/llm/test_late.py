"""Operators 11 to 13 against brute force, with nulls, ties, repeated rows, empty tables and clashing names."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from covary.llm import centroids, divergence, pii

# ---------------------------------------------------------------- clustering


def plain_kmeans(vectors, k, rounds, seed=1):
    """[(id, cluster, distance)], centroids of [(id, ints)] by measuring everything."""
    key = lambda v: (hashlib.sha256(f"{seed}:{'' if v[0] is None else v[0]}".encode()).hexdigest(), v[1])
    c = [v[1] for v in sorted(vectors, key=key)[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), j) for j, y in enumerate(c))
    for _ in range(rounds):
        of = [near(x)[1] for _, x in vectors]
        for j in range(len(c)):
            mine = [x for (_, x), o in zip(vectors, of, strict=True) if o == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return [(i, near(x)[1], near(x)[0]) for i, x in vectors], c


@pytest.mark.parametrize("rounds", [0, 1, 3, 9])
def test_clusters_equal_plain_kmeans(spark, rounds):
    r = random.Random(rounds)
    rows = [(i, [r.gauss(4 * (i % 5), 1.5) for _ in range(6)]) for i in range(400)]
    rows += [(i, [float(r.randint(0, 2)) for _ in range(6)]) for i in range(400, 500)]  # many ties
    rows += [rows[3], rows[3], (7, [9.0] * 6), (None, [1.0] * 6), (None, [2.5] * 6)]
    bad = [(600, None), (601, [1.0] * 5), (602, [1.0] * 7), (603, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (604, [math.nan] + [0.0] * 5), (605, [math.inf] + [0.0] * 5), (606, [])]
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows + bad], "vec_id bigint, embedding array<float>, cluster string, dist int").repartition(5)
    of, c = centroids.cluster_vectors(df, k=7, rounds=rounds, size=6)
    whole = [(i, [math.floor(float(np.float32(x)) * 64) for x in v]) for i, v in rows]
    want, want_c = plain_kmeans(whole, 7, rounds)
    order = lambda rows: sorted(rows, key=lambda x: (x[0] is None, x))
    assert order([(x.id, x.cluster, x.distance) for x in of.collect()]) == order(want)
    assert c.tolist() == want_c


def test_bounds_save_measurements_and_stay_exact():
    r = np.random.default_rng(3)
    x = r.integers(-50, 50, (2000, 8)) + np.repeat(np.arange(10) * 400, 200)[:, None]
    history = x[::200][None].astype(np.int64)
    state, measured = (None, None, None), []
    for _ in range(6):
        state = centroids.assigned(x, *state, history)
        full = ((x[:, None, :] - history[-1][None]) ** 2).sum(axis=2)
        assert (state[0] == full.argmin(axis=1)).all()
        measured.append(int((state[2] == len(history) - 1).sum()))
        nxt = np.array([x[state[0] == j].sum(axis=0) // max(1, (state[0] == j).sum()) for j in range(10)])
        history = np.concatenate([history, nxt[None]])
    assert measured[0] == 20_000 and max(measured[1:]) < 4_000
    # the total displacement is what counts: a centroid that went and came back loosens nothing
    there_and_back = np.stack([history[0], history[0] + 999, history[0]])
    first = centroids.assigned(x, None, None, None, history[:1])
    again = centroids.assigned(x, *first, there_and_back)
    assert (again[0] == first[0]).all() and (again[2] == 2).sum() == 0


def test_few_or_no_vectors(spark):
    kind = "vec_id bigint, embedding array<float>"
    of, c = centroids.cluster_vectors(spark.createDataFrame([], kind))
    assert of.collect() == [] and len(c) == 0
    of, c = centroids.cluster_vectors(spark.createDataFrame([(1, [0.5] * 64), (2, [0.25] * 64)], kind))
    assert sorted(x.distance for x in of.collect()) == [0, 0] and len(c) == 2
    with pytest.raises(Exception, match="too large"):
        centroids.cluster_vectors(spark.createDataFrame([(1, [1e9] * 64)], kind))[0].collect()


# ---------------------------------------------------------------- personal data

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_luhn(digits):
    return sum(sum(divmod(int(d) * 2, 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def plain_base(text):
    out = []
    for n, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and plain_luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), n, m.end(), kind))
    return sorted(out)


def test_base_spans_equal_plain_search(spark):
    r = random.Random(5)
    bits = ["a", "b.c", "@", "x@y.zz", "_", ".", "..", "-", " ", "+1", "+49 30 ", "(743)", "555-3824", "1.2.3.4", "256.1.1.1", "00", "4465758382889437", "4465 7583 8288 9437", "9", "12", "é", "😀", "\n", "%", "@a.b", "0.0.0.0", "+", "4111111111111111"]
    texts = ["".join(r.choices(bits, k=r.randint(0, 25))) for _ in range(1500)] + [None, "", "@", "+", "1", "a@b.c" * 300]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0]), (None, "x@y.zz")], "doc_id bigint, text string")
    got = pii.find_pii(df).collect()
    assert len(got) == len(texts) + 2
    for x in got:
        assert [(s.start, s.kind_order, s.end, s.kind) for s in x.spans if s.base] == plain_base(x.text), x.text
        for s in x.spans:
            assert s.base or plain_luhn(x.text[s.start : s.end])


def test_checksums_and_context(spark):
    texts = {
        "DE89370400440532013000": [("iban", 80)],
        "IBAN: DE89 3704 0044 0532 0130 00, please": [("iban", 100)],
        "DE88370400440532013000 konto": [],  # the checksum fails
        "XDE89370400440532013000": [],
        "number 123-45-6789": [],  # no context
        "her SSN 123-45-6789": [("ssn", 70)],
        "SSN 000-45-6789, SSN 123-45-67890": [],
        "4111111111111111": [("card", 80)],
        "pay by card 4111 1111 1111 1111": [("card", 100)],
        "4111111111111112": [],
        "4111111111111111 4111111111111111 7": [("card", 80), ("card", 80)],
        "call +1 (743) 555-3824": [("phone", 80)],
        "host 10.0.0.1": [("ip", 80)],
        "mail me: a.b@c.de": [("email", 90)],
    }
    got = pii.find_pii(spark.createDataFrame([(t, "s") for t in texts], "`the.text` string, spans_ string"), "the.text", "found").collect()
    assert {x[0]: [(s.kind, s.score) for s in x.found] for x in got} == texts
    assert pii.find_pii(spark.createDataFrame([], "text string")).collect() == []


def test_long_texts_of_personal_data(spark):
    texts = ["a@b.cc " * 30_000, "1" * 500_000, "a." * 300_000 + "@", "a@" + "b." * 300_000, "4111111111111111 " * 20_000, "+1(" * 100_000]
    rows = pii.find_pii(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")).selectExpr("doc_id", "size(spans) AS n", "try_element_at(spans, -1) AS last").collect()
    assert {x.doc_id: x.n for x in rows} == {0: 30_000, 1: 0, 2: 0, 3: 1, 4: 20_000, 5: 0}
    last = {x.doc_id: x["last"] for x in rows}
    assert (last[0].start, last[0].end) == (7 * 29_999, 7 * 29_999 + 6) and last[4].start == 17 * 19_999


# ---------------------------------------------------------------- divergence


def plain_divergence(docs, least, top=10):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(low))
        count[lang or "", source or ""].update(words)
        df[lang or ""].update(set(words))
        groups[lang or ""].add(source or "")
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        all_of = Counter()
        for s in sources:
            all_of.update({t: count[lang, s][t] for t in kept})
        p = lambda c: (lambda total: {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept})(sum(c[t] for t in kept))
        per, q = {s: p(count[lang, s]) for s in sources}, p(all_of)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(t, sum(f(per[s][w], per[t][w]) for w in kept)) for t in sources if t != s]
            terms = [(w, f(per[s][w], q[w])) for w in kept if count[lang, s][w] and per[s][w] > q[w]]
            for part, rows, limit in (("pair", pairs, None), ("term", terms, top)):
                rows = sorted(rows, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(rows)]
    return sorted(out)


@pytest.mark.parametrize("shard, cells", [(divergence.SHARD, divergence.CELLS), (40, 6)])
def test_divergence_equals_counting(spark, monkeypatch, shard, cells):
    monkeypatch.setattr(divergence, "SHARD", shard)
    monkeypatch.setattr(divergence, "CELLS", cells)
    r = random.Random(8)
    vocabulary = ["a", "B", "ab", "abcdefgh", "abcdefghi", "abcdefghij", "ABCDEFGHIJ", "abcdefghabcdefgh", "abcdefghabcdefghx", "é", "Éa", "😀", "naïveté", "x" * 40, "x" * 41] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    docs = [(" ,1\n-"[r.randrange(5)].join(r.choices(vocabulary[: r.choice([5, 20, 79])], k=r.randint(0, 30))), r.choice(["en", "en", "fr", None]), r.choice(["s0", "s0", "s1", "s2", "é", None])) for _ in range(300)]
    docs += [(None, "en", "s9"), ("", "xx", "s0"), ("once", "xx", "s1"), (None, None, None), docs[0], docs[0], ("", "", "s0"), ("end", "en", "s0"), ("ing", "en", "s0")]
    df = spark.createDataFrame([(*d, 0) for d in docs], "text string, lang string, source string, term int").repartition(3)
    assert sorted(map(tuple, divergence.divergence(df, least=4).collect())) == plain_divergence(docs, 4)


def test_long_terms_and_empty_tables(spark):
    assert divergence.divergence(spark.createDataFrame([], "text string, lang string, source string")).collect() == []
    long = "q" * 300_000
    docs = [(long, "en", "a"), (long + "r", "en", "b"), (long + " " + long, "en", "b"), ("word " * 200_000, "en", "a")]
    got = divergence.kept_terms(spark.createDataFrame(docs, "text string, lang string, source string"), 1).collect()
    assert {x.term: {p.source: p.n for p in x.per} for x in got} == {long: {"a": 1, "b": 2}, long + "r": {"b": 1}, "word": {"a": 200_000}}


def test_shares_beyond_64_bits():
    c, total = np.array([10**12, 5]), np.array([10**12 + 7, 10**12 + 7])
    assert divergence.share(c, total).tolist() == [1 + 10**9 * (int(x) + 2) // int(t) for x, t in zip(c, total, strict=True)]
