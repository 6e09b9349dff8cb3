"""SimHash, decontamination and line deduplication against brute force and on awkward rows."""

import hashlib
import random
import re
import time

import pytest
import xxhash
from pyspark.sql import functions as F

from covary.llm import decontaminate, line_dedup, shared, simhash

DOC = "doc_id bigint, text string"
WORDS = ["alpha", "beta", "gamma", "delta", "été", "Straße", "x", "of", "the", "and", "zeta", "eta", "theta"]


def frame(spark, rows, schema=DOC):
    return spark.createDataFrame(rows, schema)


def awkward():
    """Nulls in every column, empty and one-word texts, a long text, ties and repeated rows."""
    return [(1, None), (2, ""), (3, " \n\t"), (None, "alpha beta"), (None, None), (4, "alpha beta"), (4, "alpha beta"), (5, "word"), (6, "the of " * 30_000), (7, "Alpha\x0bBETA")]


def brute_fingerprint(text, k=3):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """fps: [(doc_id, fingerprint)] -> component per row by breadth-first search."""
    values = sorted({f for _, f in fps})
    group = {}
    for v in values:
        if v in group:
            continue
        todo, own = [v], {v}
        while todo:
            x = todo.pop()
            for y in values:
                if y not in own and (x ^ y).bit_count() <= 2:
                    own.add(y)
                    todo.append(y)
        first = min((d for d, f in fps if f in own and d is not None), default=None)
        group |= dict.fromkeys(own, first)
    return [group[f] for _, f in fps]


def test_fingerprints_match_brute_force(spark):
    r = random.Random(3)
    rows = awkward() + [(100 + i, " ".join(r.choices(WORDS, k=r.randint(1, 60)))) for i in range(60)]
    got = simhash.fingerprints(frame(spark, rows)).collect()
    assert [(x.doc_id, x.fingerprint & (1 << 64) - 1) for x in got] == [(d, brute_fingerprint(t)) for d, t in rows]


@pytest.mark.parametrize("listed", [0, 4, 64])
def test_components_of_close_fingerprints(spark, monkeypatch, listed):
    monkeypatch.setattr(simhash, "LISTED", listed)  # lists searched by neighbouring values, both ways, pair by pair
    r = random.Random(5)
    centres = [r.getrandbits(64) for _ in range(6)]
    fps = [(i, r.getrandbits(64)) for i in range(40)]
    for c in centres:
        v = c
        for _ in range(40):  # chains of one or two flips, and stars around the centre
            v = r.choice([c, v]) ^ (1 << r.randrange(64)) ^ r.choice([0, 1 << r.randrange(64)])
            fps.append((len(fps), v))
    signed = [(i, v - (1 << 64) if v >> 63 else v) for i, v in fps]
    df = frame(spark, signed, "doc_id bigint, fingerprint bigint")
    label = shared.connected_components(simhash.close_fingerprints(df.select("fingerprint").distinct()))
    comp = {x.node: x.component for x in label.collect()}
    first = {}
    for d, v in signed:
        c = comp.get(v, v)
        first[c] = min(first.get(c, d), d)
    assert [first[comp.get(v, v)] for _, v in signed] == brute_components(fps)


def test_the_tally_rejects_pairs_of_a_list(spark):
    a = 0x0123456789ABCDEF
    fps = {a: None, a ^ 1: 7, a ^ 0x0101: 6, a ^ 0x010101: 5, a ^ 0xFFFFFFFF: 4, a ^ (0xFFFFFFFF << 16): None}
    df = frame(spark, [(x,) for x in fps], "fingerprint bigint")
    got = {(x.a, x.b): x.shared for x in simhash.tallied(simhash.postings(df)).collect()}
    assert all(4 <= n < 8 for n in got.values()) and {x: got[min(x, a), max(x, a)] for x, n in fps.items() if n} == {x: n for x, n in fps.items() if n}
    links = {frozenset(map(int, x)) for x in simhash.close_fingerprints(df).collect()}
    assert links == {frozenset(p) for p in ((a, a ^ 1), (a, a ^ 0x0101), (a ^ 1, a ^ 0x0101), (a ^ 1, a ^ 0x010101), (a ^ 0x0101, a ^ 0x010101))}


def test_simhash_on_awkward_rows(spark):
    rows = [(d, t, "s", i) for i, (d, t) in enumerate(awkward())]
    df = frame(spark, rows, DOC + ", component_id string, fingerprint int")  # clashing names
    got = simhash.simhash_components(df).collect()
    fps = [(d, brute_fingerprint(t)) for d, t, *_ in rows]
    want = sorted(((d, f, c) for (d, f), c in zip(fps, brute_components(fps), strict=True)), key=str)
    assert sorted(((x.doc_id, x.fingerprint & (1 << 64) - 1, x.component_id) for x in got), key=str) == want


def test_empty_tables(spark):
    docs, bench = frame(spark, []), frame(spark, [], "item_id bigint, text string")
    assert simhash.simhash_components(docs).count() == 0
    assert simhash.drop_near_duplicates(docs).count() == 0
    assert line_dedup.without_repeats(docs).count() == 0
    assert decontaminate.decontaminate(docs, bench).count() == 0
    one = frame(spark, [(1, "a b c")])
    assert decontaminate.decontaminate(one, bench).count() == 1


def near_groups(texts, k=5, least=0.8):
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return {(i, j) for i in range(len(sets)) for j in range(i) if texts[i].lower().split() == texts[j].lower().split() or len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])}


def test_near_duplicates(spark):
    r = random.Random(9)
    vocabulary = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]
    texts = []
    for _ in range(25):
        w = r.choices(vocabulary, k=300)
        texts.append(" ".join(w))
        for edits in (0, 1, 2, 4, 60):
            v = list(w)
            for _ in range(edits):
                v[r.randrange(len(v))] = r.choice(vocabulary)
            texts.append(" ".join(v).upper() if edits == 0 else " ".join(v))
    r.shuffle(texts)
    got = {x.row: x.group for x in simhash.near_duplicates(frame(spark, list(enumerate(texts)), "row bigint, text string")).collect()}
    links = near_groups(texts)
    assert [p for p in links if got[p[0]] != got[p[1]]] == []
    joined = {(i, j) for i in got for j in range(i) if got[i] == got[j]}
    parent = list(range(len(texts)))
    for i, j in links:
        a, b = (x for x in (i, j))
        while parent[a] != a:
            a = parent[a]
        while parent[b] != b:
            b = parent[b]
        parent[max(a, b)] = min(a, b)
    root = lambda x: x if parent[x] == x else root(parent[x])
    assert all(root(i) == root(j) for i, j in joined)  # nothing joined that exact search would not join


@pytest.mark.parametrize("edit", ["replaced", "appended", "dropped"])
def test_near_duplicates_by_one_passage(spark, edit):
    r = random.Random(31)
    texts, pairs = [], []
    for i in range(60):
        w = [f"w{r.randrange(3000)}" for _ in range(r.choice([60, 300, 900]))]
        n = int(len(w) * r.uniform(0.01, {"replaced": 0.11, "appended": 0.25, "dropped": 0.2}[edit]))
        at = r.randrange(len(w) - n)
        new = [f"n{r.randrange(3000)}" for _ in range(n)]
        v = {"replaced": w[:at] + new + w[at + n :], "appended": w + new, "dropped": w[:at] + w[at + n :]}[edit]
        pairs.append((len(texts), len(texts) + 1))
        texts += [" ".join(w), " ".join(v)]
    links = {tuple(sorted(p)) for p in near_groups(texts)}
    assert len(links) > 40
    got = {x.row: x.group for x in simhash.near_duplicates(frame(spark, list(enumerate(texts)), "row bigint, text string")).collect()}
    assert [p for p in pairs if (got[p[0]] == got[p[1]]) != (p in links)] == []


def test_families_below_the_similarity_keep_their_few_links(spark):
    """Texts that all come of one, most of them less than 0.8 alike, and texts that lie within a longer one: the groups
    are those of comparing all pairs."""
    r = random.Random(41)
    word = lambda: f"w{r.randrange(5000)}"
    base, texts = [word() for _ in range(300)], []
    for k in range(45):
        v = list(base)
        for _ in range(r.choice([2, 8, 10, 12])):
            v[r.randrange(300)] = word()
        texts.append(v)
        if k % 3 == 0:
            u = list(v)
            for _ in range(r.choice([3, 6, 9])):
                u[r.randrange(300)] = word()
            texts.append(u)
    whole = [word() for _ in range(500)]
    texts += [whole, *(whole[a : a + n] for a, n in ((0, 300), (20, 300), (90, 310), (150, 280), (160, 330), (60, 440)))]
    texts = [" ".join(t) for t in texts]
    got = {x.row: x.group for x in simhash.near_duplicates(frame(spark, list(enumerate(texts)), "row bigint, text string")).collect()}
    parent = list(range(len(texts)))
    root = lambda x: x if parent[x] == x else root(parent[x])
    for i, j in near_groups(texts):
        parent[max(root(i), root(j))] = min(root(i), root(j))
    assert got == {i: root(i) for i in range(len(texts))} and 5 < len(set(got.values())) < len(texts) - 5


def test_a_large_group_of_copies_keeps_one(spark):
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join([*base[:i], "edit", *base[i + 1 :]]) for i in range(0, 120)] + [" ".join(base)] * 50
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(None, "alone here with five words", None), (900, None, None), (901, "", None), (901, "", None)]
    kept = simhash.drop_near_duplicates(frame(spark, rows, DOC + ", lang string"))
    assert kept.columns == ["doc_id", "text", "lang"]
    assert sorted((str(x.doc_id) for x in kept.collect())) == ["0", "900", "None"]


def test_every_two_members_of_a_list_in_different_parts_meet(spark):
    r = random.Random(12)
    lists = {1: [7] * 30 + [40, 41, 41, 42], 2: list(range(100, 160)), 3: [7] * 20, 4: [5]}
    rows, want = [], set()
    for key, parts in lists.items():
        fids = r.sample(range(1000), len(parts))
        rows += [(key, f, p) for f, p in zip(fids, parts, strict=True)]
        want |= {(key, *sorted((f, g))) for f, p in zip(fids, parts, strict=True) for g, q in zip(fids, parts, strict=True) if p != q}
    for block in (7, 500):
        for key in lists:
            one = frame(spark, [x for x in rows if x[0] == key], "key bigint, fid bigint, part bigint")
            got = [(key, *sorted(x)) for x in simhash.across_parts(one, lambda x, y: F.lit(True), block).collect()]
            assert len(got) == len(set(got)) and set(got) == {x for x in want if x[0] == key}


def test_no_single_plan_of_near_duplicates_is_large(spark, monkeypatch):
    """The driver plans a query anew after each of its stages, so that its memory follows the largest plan."""
    joins, written = [], shared.Tables.written

    def noted(self, df):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return written(self, df)

    monkeypatch.setattr(shared.Tables, "written", noted)
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(0, text), (1, text + " x"), (2, "other words " + text)]
    got = {x.row: x.group for x in simhash.near_duplicates(frame(spark, rows, "row bigint, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 0} and max(joins) <= 6


def joined_rows(spark, since, keys):
    """The rows of all joins by these keys in the queries after `since`."""
    store, total = spark._jsparkSession.sharedState().statusStore(), 0
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    for i in range(since, store.executionsCount()):
        run = store.executionsList().apply(i)
        metrics = store.executionMetrics(run.executionId())
        nodes = store.planGraph(run.executionId()).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            if re.search(rf"Join \[{keys}\], \[{keys}\], Inner", re.sub(r"#\d+L?", "", node.desc())):
                for m in (node.metrics().apply(k) for k in range(node.metrics().size())):
                    if m.name() == "number of output rows" and metrics.contains(m.accumulatorId()):
                        total += int(metrics.apply(m.accumulatorId()).replace(",", ""))
    return total


def test_a_group_meets_its_leaders_and_not_itself(spark):
    """Copies of a text and many parts of it, few of which are alike: the joined rows follow the number of texts."""
    r = random.Random(77)
    base = [f"w{i}" for i in range(400)]
    texts = [base, *([*base[:i], "edit", *base[i + 1 :]] for i in range(0, 360, 6))]
    for _ in range(150):
        gone = {20 * i + k for i in r.sample(range(20), 6) for k in range(20)}
        texts.append([w for i, w in enumerate(base) if i not in gone])
    texts = [" ".join(t) for t in texts]
    since = spark._jsparkSession.sharedState().statusStore().executionsCount()
    got = {x.row: x.group for x in simhash.near_duplicates(frame(spark, list(enumerate(texts)), "row bigint, text string")).collect()}
    links = near_groups(texts)
    assert all(got[i] == got[j] for i, j in links) and {i for i in got if got[i] != i} == {i for i, _ in links}
    made = {keys: joined_rows(spark, since, keys) for keys in ("a", "key, tile")}
    # the leaders of 24 lists at most, in two steps
    assert 0 < made["a"] < 2 * 24 * len(texts) and made["key, tile"] < len(texts)


# ------------------------------------------------------------------ decontamination


def brute_contamination(docs, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for d, t in docs:
        w, hit, found = cut(t), set(), set()
        for i, x in items:
            v = cut(x)
            n = min(10, len(v))
            windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else set()
            for k in range(len(w) - n + 1 if n else 0):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    if i is not None:
                        found.add(str(i))
        ids = ",".join(sorted(found))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def contamination(spark, docs, items, tmp_path):
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    frame(spark, items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return sorted(map(tuple, decontaminate.query(spark, str(tmp_path)).collect()), key=str)


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontamination_matches_brute_force(spark, tmp_path, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontaminate, "BROADCAST_GRAMS", -1)
    r = random.Random(1)
    vocabulary = WORDS[:9]
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice([12, 15, 30])))) for i in range(12)] + [(90, "Zeta-eta THETA"), (91, "unseenword"), (92, None), (93, ""), (94, "zeta eta theta"), (None, "the the the the the the the the the the the")]
    docs = awkward()
    for i in range(60):
        w = r.choices(vocabulary, k=r.randint(0, 40))
        if i % 2:
            v = re.findall(r"\w+", items[r.randrange(12)][1])
            a = r.randrange(len(v) - 9)
            w[5:5] = v[a : a + r.choice([9, 10, 11, 25])]
        if i % 7 == 0:
            w += ["zeta", "eta", "theta"]
        docs.append((100 + i, ", ".join(w)))
    docs.append((999, "the " * 500))
    assert contamination(spark, docs, items, tmp_path) == brute_contamination(docs, items)


def test_decontamination_of_one_phrase_repeated(spark, tmp_path):
    """An item that repeats a word or a phrase leaves rows for its two ends and its phrase, however long it is."""
    items = [(1, "the " * 400), (2, "of the " * 400)]
    h = frame(spark, [([str(i)], t) for i, t in items], "ids array<string>, text string").select("ids", decontaminate.word_hashes(F.col("text")).alias("h"))
    assert decontaminate.item_grams(h).count() <= 4 * (2 * decontaminate.SIDE + 1)
    docs = [(1, "the " * 700), (2, "of the " * 300 + "end"), (3, "of of " * 9), (4, "the " * 9), (5, "the " * 10)]
    assert contamination(spark, docs, items, tmp_path) == brute_contamination(docs, items)


def test_decontaminate_drops_only_hits(spark):
    items = frame(spark, [(1, "one two three four five six seven eight nine ten eleven", None)], "item_id bigint, text string, row string")
    rows = [(1, "x one two three four five six seven eight nine ten", "a", 1), (2, "one two three four five six seven eight nine", "b", 2), (None, None, None, None)]
    out = decontaminate.decontaminate(frame(spark, rows, DOC + ", ids string, h int"), items)
    assert sorted(str(x.doc_id) for x in out.collect()) == ["2", "None"] and out.columns == ["doc_id", "text", "ids", "h"]


# ------------------------------------------------------------------ lines


def brute_runs(text, least=20, line=8):
    """(start, end, words) of the long lines and of the shortest run from each unit, found by walking the text character
    by character."""
    units, begin, i = [], 0, 0
    white = " \t\n\r\x0b\x0c"
    while i < len(text):
        i += 1
        if text[i - 1] == "\n":
            units.append((begin, i))
            begin = i
        elif text[i - 1] in ".!?" and i < len(text) and text[i] in white and text[i] != "\n":
            while i < len(text) and text[i] in white and text[i] != "\n":
                i += 1
            units.append((begin, i))
            begin = i
    units.append((begin, len(text)))
    units = [(a, b, text[a:b].encode().lower().split()) for a, b in units]
    units = [u for u in units if u[2]]
    out = []
    for i in range(len(units)):
        words = []
        for j in range(i, len(units)):
            words += units[j][2]
            if len(words) >= least:
                out.append((units[i][0], units[j][1], tuple(words)))
                break
    begin = 0
    for whole in text.splitlines(keepends=True) if not set(text) & set("\r\x0b\x0c\x1c\x85\u2028") else text.split("\n"):
        end = begin + len(whole)
        own = [u for u in units if begin <= u[0] and u[1] <= end]
        words = [w for u in own for w in u[2]]
        if len(words) >= line:
            out.append((own[0][0], own[-1][1], tuple(words)))
        begin = end
    return sorted(set(out))


def brute_repeats(docs, least=20):
    first, out = {}, []
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0, i))
    for i in order:
        d, t = docs[i]
        gone = set()
        for a, b, words in brute_runs(t or "", least):
            f, end = first.setdefault(words, (i, b))
            if f != i or a >= end:
                gone |= set(range(a, b))
        spans = [(a, next(b for b in range(a, len(t) + 1) if b not in gone)) for a in sorted(gone) if a - 1 not in gone]
        text = None if t is None else "".join(c for k, c in enumerate(t) if k not in gone)
        out.append((d, text, len(spans), ",".join(f"{a}-{b}" for a, b in spans)))
    return sorted(out, key=str)


def test_runs_match_brute_force(spark, tmp_path):
    r = random.Random(4)
    say = lambda n: " ".join(r.choices(WORDS, k=n))
    ends = [". ", "! ", "? ", ".\n", "\n", "\n\n", "...  ", ".x ", " ", ".\t"]
    passages = ["".join(say(r.randint(1, 14)) + r.choice(ends) for _ in range(r.choice([1, 3, 6]))) for _ in range(8)]
    docs = [(1, None), (2, ""), (3, "\n\n"), (4, passages[0].upper() * 300), (5, "word " * 3000), (6, ".!? . \n?"), (None, passages[1])]
    for i in range(70):
        units = [r.choice([r.choice(passages), r.choice(passages).upper(), say(25) + ". ", "\n", "short. "]) for _ in range(r.randint(1, 7))]
        docs.append((10 + i, "".join(units)))
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, line_dedup.query(spark, str(tmp_path)).collect()), key=str)
    assert got == brute_repeats(docs)


def test_short_lines_go_and_shorter_ones_stay(spark):
    line, short = "this line of eight words is a repeat", "just seven words are in this line"
    docs = [(i, f"own{i} {'x ' * i}\n{line}\nmore of {i} here.\n{short}\nAnd {line} in a sentence {i}") for i in range(30)]
    got = {x.of.doc_id: x.text for x in line_dedup.without_repeats(frame(spark, docs)).collect()}
    assert got[0] == docs[0][1] and all(got[i] == docs[i][1].replace(line + "\n", "", 1) for i in range(1, 30))


def test_many_repeats_in_one_text_take_linear_time(spark):
    lines = [" ".join(f"w{i}x{k}" for k in range(20)) for i in range(8000)]
    texts = [(1, "\n".join(lines)), (2, "".join(f"{x}\nown {i}\n" for i, x in enumerate(lines)))]
    began = time.time()
    got = {x.of.doc_id: x for x in line_dedup.without_repeats(frame(spark, texts)).collect()}
    assert len(got[1].removed) == 0 and len(got[2].removed) == 8000
    assert got[2].text == "".join(f"own {i}\n" for i in range(8000))
    assert time.time() - began < 20  # seconds; it was hours when each cut walked the text anew


def test_planted_passages_go_wherever_they_stand(spark):
    r = random.Random(17)
    sentence = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n)) + "."
    docs, planted = [], []
    for i in range(40):
        passage = " ".join(sentence(r.randint(3, 14)) for _ in range(9)).split()[2:-2]  # starts and ends amid a sentence
        for _ in range(2):
            own = [sentence(r.randint(4, 30)) for _ in range(6)]
            at = r.randrange(1, 6)
            wrapped = [w + r.choice(["\n"] if k % 11 == 10 and w.endswith(".") else [" "]) for k, w in enumerate(passage)]
            docs.append((len(docs), " ".join(own[:at]) + " stray " + "".join(wrapped) + "tail " + "\n".join(own[at:])))
        planted.append(len(docs) - 1)
    docs += [(1000 + i, " ".join(sentence(12) for _ in range(8)) + "\nReleased under a license.") for i in range(40)]
    got = {x.of.doc_id: len(x.removed) for x in line_dedup.without_repeats(frame(spark, docs)).collect()}
    assert {d for d, n in got.items() if n} == set(planted)


def test_drop_repeats_keeps_columns_and_rows(spark):
    line = " ".join(f"w{i}" for i in range(30))
    rows = [(2, line + "\nown", 200, "x"), (1, line, 100, "y"), (None, line, None, None), (3, None, 0, None), (2, line + "\nown", 200, "x")]
    out = line_dedup.drop_repeats(frame(spark, rows, DOC + ", n_chars bigint, row string"))
    assert out.columns == ["doc_id", "text", "n_chars", "row"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, line, 100, "y"), (2, "own", 3, "x"), (2, "own", 3, "x"), (3, None, 0, None), (None, "", 0, None)], key=str)


def test_dotted_and_clashing_columns_survive(spark):
    line = " ".join(f"w{i}" for i in range(30))
    names = "doc_id bigint, text string, `a.b` int, `of` string, `__row` int, `row` int, removed int, `key` int, place int, `tick``` int"
    rows = [(1, line, 1, "o", 2, 3, 4, 5, 6, 7), (2, line, 1, "o", 2, 3, 4, 5, 6, 7), (3, "own words", 9, None, 2, 3, 4, 5, 6, 7)]
    docs, items = frame(spark, rows, names), frame(spark, [(1, "own words")], "item_id bigint, text string")
    for out, ids in ((simhash.drop_near_duplicates(docs), [1, 3]), (line_dedup.drop_repeats(docs), [1, 2, 3]), (decontaminate.decontaminate(docs, items), [1, 2])):
        assert out.columns == docs.columns and sorted(x.doc_id for x in out.collect()) == ids
        assert all(tuple(x)[2:] == next(r for r in rows if r[0] == x.doc_id)[2:] for x in out.collect())


def test_components_survive_chains(spark):
    n = 200
    edges = frame(spark, [(i, i + 1) for i in range(n)] + [(500, 501), (501, 500), (7, 7)], "a bigint, b bigint")
    got = {x.node: x.component for x in shared.connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(n + 1), 0), 500: 500, 501: 500}
    assert shared.connected_components(edges.where(F.lit(False))).count() == 0
