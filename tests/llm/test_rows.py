"""Operators that treat each row by itself: urls, language, tokens, toxicity, audio, shards, main text."""

import hashlib
import random
import struct
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from public_tokenizers import PATTERN
from pyspark.sql import functions as F

from covary.llm import bpe, html_text, language, mpeg_audio, sharding, toxicity, url_filter

DOC = "doc_id bigint, text string"
AWKWARD = [(1, None), (2, ""), (3, " \n"), (None, "words here"), (None, None), (4, "same"), (4, "same"), (5, "é😀\x00ß" * 20_000)]


def save(spark, path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


# ------------------------------------------------------------------ urls


def glob_fits(glob, text):
    """Plain recursive matching, for comparison."""
    if not glob:
        return not text
    if glob[:2] == "**":
        return any(glob_fits(glob[2:], text[i:]) for i in range(len(text) + 1))
    if glob[0] == "*":
        n = text.find("/") if "/" in text else len(text)
        return any(glob_fits(glob[1:], text[i:]) for i in range(n + 1))
    return bool(text) and (text[0] == glob[0] or glob[0] == "?" and text[0] != "/") and glob_fits(glob[1:], text[1:])


def test_automaton_matches_plain_globs():
    r = random.Random(2)
    globs = ["".join(r.choice(["a", "b", "/", "?", "*", "**", "ab/", "x"]) for _ in range(r.randint(1, 9))).replace("***", "**") for _ in range(60)]
    texts = ["".join(r.choices("ab/x", k=r.randint(0, 12))) for _ in range(200)] + ["ab" * 200]
    fit = url_filter.Automaton.of([url_filter.parsed(g) for g in globs]).fits([t.encode() for t in texts])
    want = [[glob_fits(g, t) for g in globs] for t in texts[:-1]]
    assert (fit[:-1] == np.array(want)).all() and fit.shape == (201, 60)


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://WWW.Example.org/es/a?b#c", "www.example.org", "/es/a", "example.org/es/", "block"),
        ("https://example.org/en/17", "example.org", "/en/17", "example.org/en/1", "block"),
        ("https://org/", "org", "/", "org/", "allow"),
        ("https://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        ("https://x.net/a.org/", "x.net", "/a.org/", None, "allow"),
        ("https://x.org?y=/", "x.org", "", None, "allow"),
        ("https://a.com/de/x", "a.com", "/de/x", "com/de/", "block"),
        ("https://a.com/De/x", "a.com", "/De/x", None, "allow"),
        ("https://spam-farm.x.net/q", "spam-farm.x.net", "/q", None, "block"),
        ("https://x.net/spam-farm/q", "x.net", "/spam-farm/q", None, "allow"),
        ("no scheme.org/", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("a://b://c.org/", "b:", "//c.org/", None, "allow"),
    ],
)
def test_verdicts(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, "x", 2)], "page_id int, url string, host string, verdict int")
    assert tuple(url_filter.judge_urls(pages).first()) == (1, host, path, rule, verdict)


def test_urls_of_an_empty_table_and_a_long_url(spark):
    pages = spark.createDataFrame([(None, "http://a.org/" + "x" * 100_000)], "page_id int, url string")
    assert url_filter.judge_urls(pages).first().rule == "org/"
    assert url_filter.judge_urls(pages.where(F.lit(False))).count() == 0


# ------------------------------------------------------------------ language

SYLLABLES = {"aa": ["the", "and", "ing", "er", "wh"], "bb": ["le", "que", "é", "tion", "ou"], "cc": ["der", "ung", "sch", "ü", "ein"]}


def speak(r, lang, n):
    return " ".join("".join(r.choices(SYLLABLES[lang], k=r.randint(1, 3))) for _ in range(n))


def test_language_held_out_and_edges(spark, tmp_path):
    r = random.Random(8)
    rows = [(i, speak(r, lang, r.randint(3, 40)), lang) for i in range(600) for lang in [r.choice(list(SYLLABLES))]]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "12 34 !?", None), (903, speak(r, "cc", 30_000), None), (None, speak(r, "bb", 9), "bb"), (904, speak(r, "aa", 9), None)]
    got = language.query(spark, save(spark, tmp_path, documents=(rows, DOC + ", lang string"))).collect()
    by = {x.doc_id: x for x in got}
    assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got)
    for i in (900, 901, 902):
        assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
    assert by[903].lang_pred == "cc" and by[None].lang_pred == "bb" and by[904].lang_pred == "aa"
    held = [(by[i].lang_pred, lang) for i, _, lang in rows[:600] if by[i].held_out]
    assert {i for i, *_ in rows[:600] if by[i].held_out} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert len(held) > 150 and np.mean([a == b for a, b in held]) > 0.98


def test_language_sample_lies_in_two_blocks():
    """Thousands of small arrays would stay with the driver after the training."""
    at, n = [[1, 5, 9], [2], [3, 16383]], [[1, 2, 1], [4], [7, 1]]
    idf = np.linspace(1, 2, language.SLOTS)
    cut = lambda x, a, b: pa.array(x[a:b], pa.list_(pa.int32()))
    sample = pa.table({"lang": pa.chunked_array([["b", "a"], ["b"]]), **{k: pa.chunked_array([cut(x, 0, 2), cut(x, 2, 3)]) for k, x in (("at", at), ("n", n))}})
    rows = language.packed(sample, idf, ["a", "b"])
    assert len({id(r[k].base) for r in rows for k in (0, 1)}) == 2
    assert [(r[0].tolist(), r[2]) for r in rows] == list(zip(at, [1, 0, 1], strict=True))
    for r, a, c in zip(rows, at, n, strict=True):
        v = (1 + np.log(c)) * idf[a]
        assert np.array_equal(r[1], v / np.sqrt(v @ v))


def test_language_without_anything_to_learn(spark, tmp_path):
    got = language.query(spark, save(spark, tmp_path, documents=([(1, "text", None)], DOC + ", lang string"))).collect()
    assert [(x.lang_pred, x.score) for x in got] == [("und", 0.0)]
    model = language.train(spark.createDataFrame([], DOC + ", lang string"))
    assert model.languages == [] and model.predict("abc") == ("und", 0.0)


def test_l1_makes_the_weights_sparse(spark):
    r = random.Random(8)
    df = spark.createDataFrame([(i, speak(r, lang, 20), lang) for i in range(90) for lang in [r.choice(list(SYLLABLES))]], DOC + ", lang string")
    assert (language.train(df).weights == 0).mean() > 0.5


# ------------------------------------------------------------------ tokens


def test_tokens_match_the_library(spark, tmp_path):
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(), special_tokens={})
    r = random.Random(6)
    alphabet = "abcde  \n\t\x1c\x85\xa0éñ😀12٣'s're\u3000中文==--_"
    rows = AWKWARD + [(100 + i, "".join(r.choices(alphabet, k=r.randint(0, 300)))) for i in range(200)] + [(7, "x" * 3000), (8, "ab" * 2000 + "=" * 999)]
    got = bpe.query(spark, save(spark, tmp_path, documents=(rows, DOC))).collect()
    want = []
    for d, t in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_round_trip_of_the_operators(spark):
    df = spark.createDataFrame([(*r, 0) for r in AWKWARD], DOC + ", ids int")
    back = bpe.decode(bpe.encode(df)).collect()
    assert [(x.doc_id, bytes(x.decoded)) for x in back] == [(d, (t or "").encode()) for d, t in AWKWARD]
    assert bpe.encode(df.where(F.lit(False))).count() == 0


def test_fold_in_higher_order_functions(spark):
    ranks = bpe.read_ranks()
    words = ["the", " thtionhare", "x", "", "Straße", " 😀", "=" * 20, "abcabcabc"]
    got = {x.word: x.ids for x in bpe.merge_words(spark.createDataFrame([(w,) for w in words], "word string"), ranks).collect()}
    assert got == {w: bpe.fold(w.encode(), ranks) if w else [] for w in words}
    long = "ab" * 500
    assert bpe._fold_long(long.encode(), ranks) == tiktoken.Encoding("o", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(long)


# ------------------------------------------------------------------ toxicity


def brute_segments(scores):
    """All maximal scoring subsequences, by taking the best stretch and going on to both sides."""

    def within(a, b):
        best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
        if best[0] <= 1e-12:
            return []
        *_, i, j = best
        return [*within(a, i), (round(best[0], 6), i, j - 1), *within(j, b)]

    return within(0, len(scores))


def test_segments_match_brute_force():
    r = random.Random(12)
    for _ in range(150):
        n = r.randint(1, 18)
        scores = [r.choice([0.3, 0.7, 1.1, 2.05, -0.41, -0.9, -1.3]) + r.random() / 100 for _ in range(n)]
        got = [(round(s, 6), a, b) for s, a, b in toxicity.segments(np.array(scores))]
        assert got == brute_segments(scores)
    assert toxicity.segments(np.array([])) == []


def test_a_words_prior_is_its_prefix():
    counts = {"vil": (0, 30), "vile": (0, 30), "vilescum$": (0, 28), "vilegood$": (20, 1), "one$": (1, 1)}
    odds = toxicity.log_odds(counts, 100, 100)
    lexicon = toxicity.Lexicon(odds)
    assert odds["vile"] > odds["vil"] > 2 and abs(odds["one$"]) < 1e-9
    assert lexicon["vileother"] == odds["vile"] - toxicity.DRIFT and lexicon["unseen"] == -toxicity.DRIFT
    assert odds["vilegood$"] < 0 < odds["vilescum$"]
    sided = toxicity.log_odds({"rottenest"[:k]: (0, 10**6) for k in range(3, 9)} | {"rottenest$": (0, 10**6)}, 10**6, 10**6)
    assert all(5 < x < 20 for x in sided.values())
    n, found = toxicity.passages("Vilescum vilescum a vilescum b", lexicon)
    s = lexicon["vilescum"]
    assert n == 5 and [(a, z) for _, a, z in found] == [(0, 3)] and abs(found[0][0] - (s + s / 2 + s / 3 - toxicity.DRIFT)) < 1e-9


def test_toxicity_held_out_and_edges(spark, tmp_path):
    r = random.Random(13)
    vocabulary = [f"{a}{b}{c}" for a in ("ba", "ce", "di") for b in ("lo", "mu", "na") for c in ("pa", "re", "si", "to")]
    slurs = ["vilescum", "rottenfool", "vileclown", "vileworm"]
    docs, labels = [], []
    for i in range(1200):
        w = r.choices(vocabulary, k=r.randint(5, 150))
        toxic = r.random() < 0.15
        if toxic:
            for _ in range(r.randint(1, 5)):
                w.insert(r.randrange(len(w)), r.choice(slurs))
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    docs += [(2000, None), (2001, ""), (None, "vilescum"), (2002, "bamupa " * 50_000), (2003, "vileunseen " + docs[3][1])]
    labels += [(None, 1, 1), (5, 0, None), (7, 1, labels[7][2])]
    path = save(spark, tmp_path, documents=(docs, DOC), labels=(labels, "doc_id bigint, quality int, toxic int"))
    by = {x.doc_id: x for x in toxicity.query(spark, path).collect()}
    assert len(by) == len(docs) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in by.values())
    held = [(by[i].predicted, t) for i, _, t in labels[:1200] if by[i].held_out]
    assert len(held) > 180 and np.mean([a == b for a, b in held]) > 0.97
    assert by[2000].predicted == by[2001].predicted == by[2002].predicted == 0 and by[None].predicted == 1 and by[2003].predicted == 1


def test_toxicity_without_labels(spark, tmp_path):
    path = save(spark, tmp_path, documents=(AWKWARD, DOC), labels=([(1, 1, 0)], "doc_id bigint, quality int, toxic int"))
    assert {x.score for x in toxicity.query(spark, path).collect()} == {0.0}


# ------------------------------------------------------------------ audio


def test_audio_round_trip(spark, tmp_path):
    rows = AWKWARD + [(20 + n, "y" * n) for n in (63, 64, 65, 922, 923, 5000)]
    got = mpeg_audio.query(spark, save(spark, tmp_path, documents=(rows, DOC))).collect()
    assert len(got) == len(rows)
    by = {(x.doc_id, x.n_bytes): x for x in got}
    for d, t in rows:
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        x = by[d, len(raw)]
        assert (x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    stored = mpeg_audio.store_documents(spark.createDataFrame(rows, DOC))
    for x in mpeg_audio.read_media(stored).collect():
        assert bytes(x.payload) == mpeg_audio.padded(bytes(x.payload)[: x.n_bytes].decode())[1]
        assert x.bad_crc == 0 and x.vbr_frames == x.frames and x.duration == x.frames * 1152 / 48000
        assert all(x.media[o] == 0xFF and x.media[o + 1] == 0xFA for o in x.offsets)


def test_audio_resynchronises_and_sees_damage():
    media = mpeg_audio.store(mpeg_audio.padded("words " * 900)[1])
    whole = mpeg_audio.parse(media)
    assert whole["payload"] and whole["skipped"] == 0
    at = whole["offsets"][2]
    broken = bytearray(media)
    broken[at + 10] ^= 1  # side information under the check word
    assert mpeg_audio.parse(bytes(broken))["bad_crc"] == 1
    cut = mpeg_audio.parse(media[:at] + b"\xff\xfbjunk\xff" + media[at:])
    assert cut["frames"] == whole["frames"] and cut["skipped"] == 7 and cut["payload"] == whole["payload"]
    r = random.Random(16)
    for k in range(0, len(media), 7):  # any prefix, and any changed byte, is read without a fault and never as another payload
        assert mpeg_audio.parse(media[:k])["payload"] is None
        changed = media[:k] + bytes([media[k] ^ r.randrange(1, 256)]) + media[k + 1 :]
        assert mpeg_audio.parse(changed)["payload"] in (None, whole["payload"])
    assert mpeg_audio.parse(b"ID3\3\0\0\0\0\7\x68TXXX\0")["frames"] == 0
    for _ in range(300):
        mpeg_audio.parse(bytes(r.choices([0, 0xFF, 0xFA, 0x44, 0x49, 0x33, r.randrange(256)], k=r.randrange(400))))
    assert mpeg_audio.parse(b"")["payload"] is None and mpeg_audio.parse(media[: at + 5])["payload"] is None


# ------------------------------------------------------------------ shards


def test_shards_fit_and_split_only_when_too_large(spark):
    r = random.Random(14)
    rows = [(i, "z" * r.randint(0, 400)) for i in range(400)] + [(1000, "w" * 5000), (1001, None), (None, "q"), (None, "qq")] + [(7777, "v" * 100)] * 60
    limit = 2000
    got = sharding.shards(spark.createDataFrame([(*x, "b", 1) for x in rows], DOC + ", bucket string, depth int"), limit, step=4).collect()
    assert sorted(((x.doc_id, x.size) for x in got), key=str) == sorted(((d, len(t or "")) for d, t in rows), key=str)
    total = {}
    for x in got:
        total[x.shard] = total.get(x.shard, 0) + x.size
    large = {x.shard for x in got if x.oversize}
    assert len(large) == 1 and all(v <= limit for k, v in total.items() if k not in large)
    buckets = {x.bucket for x in got}
    by_prefix = lambda p: sum(x.size for x in got if x.bucket.startswith(p))
    assert all(by_prefix(b[:-1]) > limit for b in buckets if b)
    assert sharding.shards(spark.createDataFrame([], DOC)).count() == 0


# ------------------------------------------------------------------ main text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
<!-- x --><div class="ad">Buy this now.</div><article><h1>Head &amp; line</h1><p><b>First  para\n one.<br><p>Second &lt;x&gt; para.</p></article><footer>&copy; me</footer></body></html>"""


@pytest.fixture(scope="module")
def text_model():
    return html_text.train([PAGE] * 3)


def test_main_text(text_model):
    assert text_model.extract(PAGE) == "Head & line\nFirst para one.\nSecond <x> para."
    assert text_model.extract(PAGE[: PAGE.index("para.")]) == "Head & line\nFirst para one.\nSecond <x>"
    assert text_model.extract(None) == text_model.extract("") == ""


@pytest.mark.parametrize("noise", ['<aside>Side {}</aside>', '<header><p>Top {}</p></header>', '<form><p>Name {}</p></form>', '<div class="comments"><p>I say {}</p></div>', '<div class="cookie-notice">Cookies {}</div>', '<section id="comments"><p>Reply {}</p></section>', '<div class="sidebar"><p>More {}</p></div>'])
@pytest.mark.parametrize("home", ["<main>{}</main>", '<div class="content">{}</div>', "<article>{}</article>"])
def test_other_marks(text_model, noise, home):
    body = home.format("<h1>A title of the page</h1>" + "".join(f"<p>Sentence {i} of the text goes on for a while, as it should.</p>" for i in range(5)))
    page = f"<html><body>{noise.format('words here')}{body}{noise.format('again')}</body></html>"
    got = text_model.extract(page).split("\n")
    assert got[0] == "A title of the page" and len(got) == 6


def test_viterbi_matches_enumeration(text_model):
    blocks = html_text.blocks_of(PAGE)[:6]
    from itertools import product

    def total(y):
        s = text_model.start[y[0]] + sum(text_model.emission(b) for b, k in zip(blocks, y, strict=True) if k)
        return s + sum(text_model.turn[2 * a + b] for a, b in zip(y, y[1:], strict=False))

    assert text_model.decode(blocks) == list(max(product((0, 1), repeat=len(blocks)), key=total))


def test_pages_of_all_kinds(spark, tmp_path):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<p>" * 20_000 + "<" * 5000), (4, "x", "<div " + "a" * 100_000)]
    got = html_text.query(spark, save(spark, tmp_path, pages=([(*r, "t", 3) for r in rows], "page_id bigint, url string, html string, text string, n_chars int"))).collect()
    assert len(got) == 6 and all(x.n_chars == len(x.text) for x in got)
    assert [x.text for x in got if x.page_id == 1] == ["Head & line\nFirst para one.\nSecond <x> para."] * 2
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/none/pages.parquet")
    assert html_text.query(spark, f"{tmp_path}/none").count() == 0


def test_unclosed_and_nested_elements_without_text():
    texts = lambda page: [b.text for b in html_text.blocks_of(page)]
    assert texts("<article><p>One.</p><canvas><p>drawn</p></article><p>Two.</p>") == ["One.", "Two."]
    assert texts("<div><svg><svg>a</svg>b</svg>c</div>") == ["c"]
    assert texts("<div><object><div>x</div></object>y</div><p>z") == ["y", "z"]
    assert texts("<div><math/>one</div><script>if (a</div>b) {}</script>two<style>") == ["one", "two"]
    assert texts("<section><template><p>t</section>rest") == ["rest"]


def test_samples_take_one_row_for_each_key(spark, monkeypatch):
    copies = [(1, "bad words here", "en")] * 50 + [(2, "good words here", "en"), (3, "bons mots ici", "fr")]
    docs = spark.createDataFrame(copies, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, toxic int")
    assert sorted(map(tuple, toxicity.sample(docs, labels).collect())) == [("bad words here", 1), ("good words here", 0)]
    seen = []
    monkeypatch.setattr(language, "ftrl", lambda rows, *a: seen.append(len(rows)) or (np.zeros((2, language.SLOTS)), np.zeros(2)))
    language.train(docs)
    assert seen == [3]


def test_copies_beyond_a_step_are_all_dealt(spark, monkeypatch):
    monkeypatch.setattr(sharding, "STEP", 3)
    docs = spark.createDataFrame([(1, "x" * 10)] * 50 + [(2, "y" * 10)] * 28, "doc_id bigint, text string")
    got = sharding.shards(docs, limit=40)
    arrays = got._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(transform(" not in arrays
    per = {}
    for x in got.collect():
        per[x.doc_id, x.shard] = per.get((x.doc_id, x.shard), 0) + 1
    assert sorted(per.values()) == [2] + [4] * 19 and sum(n for (d, _), n in per.items() if d == 1) == 50


def test_written_shards_hold_every_document_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * (i % 40)) for i in range(120)], "doc_id bigint, text string")
    sharding.write_shards(docs, f"{tmp_path}/shards", limit=300)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert sorted((x.doc_id, x.text) for x in back.collect()) == [(i, "x" * (i % 40)) for i in range(120)]
    assert all(x.n <= 300 for x in back.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("n")).collect())


def test_empty_tables_of_the_row_operators(spark, tmp_path):
    path = save(spark, tmp_path, documents=([], DOC), labels=([], "doc_id bigint, quality int, toxic int"))
    assert toxicity.query(spark, path).count() == mpeg_audio.query(spark, path).count() == 0
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(f"{path}/pages.parquet")
    assert url_filter.query(spark, path).count() == 0


def test_numerals_and_marks_are_no_letters():
    assert not any(map(language.known, [None, "", "²", "½ ① Ⅷ", "12 34 ...", "_", "٣"]))
    assert all(map(language.known, ["a", "1é", "日", "½ x"]))


def test_language_of_rows_with_clashing_names(spark):
    rows = [(i, "the and ing " * 5 if i % 2 else "le que tion " * 5, "en" if i % 2 else "fr", 7.5, "x") for i in range(80)]
    docs = spark.createDataFrame(rows + rows[:2], "doc_id bigint, text string, lang string, score double, lang_pred string")
    out = language.predict(docs, language.train(docs)).collect()
    assert len(out) == 82 and all(x.of.score == 7.5 and x.of.lang_pred == "x" and x.lang_pred == x.of.lang for x in out)


def test_deep_nesting_takes_linear_time(text_model):
    n = 30_000
    for page in ("<div class='c'>x" * n, "<b>x" * n + "<div></div>" * n, "<div>" * n + "<td></td>x</i>" * n, "".join(f"<div class='k{'ab' * (i % 50)}'>x" for i in range(n)), "<a href=1>x<svg>" * n):
        began = time.time()
        text_model.extract(page)
        assert time.time() - began < 20  # seconds; quadratic time would be minutes
    path = html_text.blocks_of("<main class='a b'><div class='b c'><b><p id='c'>x")[0].node
    assert [x.tag for x in path.chain()] == ["p", "div", "main"]
    assert html_text.path_features(path) == ["a:div", "a:main", "a:p", "m:a", "m:b", "m:c", "t:p"]


def test_open_svg_and_math_end_where_a_browser_leaves_them():
    texts = lambda page: [b.text for b in html_text.blocks_of(page)]
    assert texts('<article><svg><path d="x"><p>One.</p><p>Two.</p></article>') == ["One.", "Two."]
    assert texts("<div><math><mi>x</mi><div>After") == ["After"]
    assert texts("<div><svg><foreignObject><p>drawn</p></foreignObject></svg>rest</div>") == ["rest"]


def dense_scores(model, text):
    """A text's class probabilities from dictionaries of its n-grams, one by one."""
    c = "".join(x if x.isalpha() else " " for x in f" {text.lower()} ")
    at = [ord(x) for x in c]
    odd = [int(x) for x in language._ODD]
    m = (1 << 32) - 1
    count = {}
    for i, x in enumerate(at):
        one = x * odd[0] & m
        count[(one * odd[2] & m) >> 18] = count.get((one * odd[2] & m) >> 18, 0) + 1
        if i + 1 < len(at):
            two = (one + at[i + 1] * odd[1]) & m
            count[(two * odd[2] & m) >> 18] = count.get((two * odd[2] & m) >> 18, 0) + 1
            if i + 2 < len(at):
                three = (two + at[i + 2] * odd[2]) & m
                three = ((three ^ (three >> 15)) * odd[1] & m) >> 18
                count[three] = count.get(three, 0) + 1
    v = {k: (1 + np.log(n)) * model.idf[k] for k, n in count.items()}
    size = np.sqrt(sum(x * x for x in v.values()))
    z = [(sum(float(model.weights[j, k]) * x / size for k, x in v.items()) + model.bias[j]) / model.temperature for j in range(len(model.languages))]
    e = np.exp(np.array(z) - max(z))
    return dict(zip(model.languages, e / e.sum(), strict=True))


def test_language_scores_equal_a_dense_sum(spark, tmp_path):
    rows = [(i, f"the {'and ' * (i % 4)}ing {i}" if i % 2 else f"le {'que ' * (i % 5)}tion é {i}", "en" if i % 2 else "fr") for i in range(200)] + [(900, "12 ² ½", "en"), (901, None, "fr")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.train(docs.where(language.id_fold(F.col("doc_id"), 3) != 1))
    got = {x.doc_id: x for x in language.query(spark, save(spark, tmp_path, documents=(rows, "doc_id bigint, text string, lang string"))).collect()}
    for i, text, _ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        if i >= 900:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
        else:
            want = dense_scores(model, text)
            assert got[i].lang_pred == max(want, key=want.get) and abs(got[i].score - max(want.values())) < 1e-4


def walked_frames(media):
    """(offset, frame) of an MPEG-1 Layer III stream at 48 kHz, by the letter of the format and nothing of the library."""
    assert media[:3] == b"ID3"
    at = 10 + sum(b << 7 * (3 - i) for i, b in enumerate(media[6:10]))
    out = []
    while at < len(media):
        assert media[at] == 0xFF and media[at + 1] >> 5 == 7 and media[at + 2] >> 2 & 3 == 1
        kbps = [0, *range(32, 65, 8), *range(80, 129, 16), *range(160, 257, 32), 320][media[at + 2] >> 4]
        size = 144 * kbps * 1000 // 48000
        out.append((at, media[at : at + size]))
        at += size
    assert at == len(media)
    return out


def remainder(bits):
    """CRC-16 by long division, the start value being added to the first sixteen bits."""
    n = int(bits, 2) << 16
    n ^= 0xFFFF << len(bits)
    for i in range(len(bits) + 15, 15, -1):
        if n >> i & 1:
            n ^= 0x18005 << (i - 16)
    return n


def test_media_against_an_independent_reader(spark):
    texts = {1: None, 2: "a", 3: "héllo 😀 " * 2000, 4: "x" * 922, 5: "", 6: "x" * 923, 7: "line\n" * 40_000}
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id bigint, text string, media int")
    stored = {x.doc_id: bytes(x.media) for x in mpeg_audio.store_documents(docs).collect()}
    for x in mpeg_audio.digests(docs).collect():
        raw = (texts[x.doc_id] or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        media, frames = stored[x.doc_id], walked_frames(stored[x.doc_id])
        assert (x.media_bytes, x.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert b"".join(f[38:] for _, f in frames[1:]).startswith(payload)  # ancillary bytes, the first frame being the table
        for _, f in frames[1:]:
            covered = "".join(f"{b:08b}" for b in f[2:4] + f[6:38])
            assert remainder(covered) == int.from_bytes(f[4:6], "big")
        table = frames[0][1]
        assert table[36:40] == b"Xing" or table[38:42] == b"Xing"
        offsets = [at for at, _ in frames[1:]]
        n = len(offsets)
        crc = zlib.crc32(b"".join(o.to_bytes(8, "little") for o in offsets))
        assert x.feature == f"frames={n};samples={1152 * n};bad_crc=0;vbr={n};last={offsets[-1]};offsets={crc}"
