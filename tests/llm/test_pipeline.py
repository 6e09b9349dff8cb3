"""The pipeline's stages in order, each on what its predecessor kept, against what is planted."""

import random

import corpus_pipeline
from covary.llm import bpe

SYLLABLES = {"en": ["the", "and", "ing", "er", "wh", "ou"], "fr": ["le", "que", "é", "tion", "ou", "re"]}


def speak(r, lang, n):
    return " ".join("".join(r.choices(SYLLABLES[lang], k=r.randint(2, 4))) for _ in range(n))


def test_stages(spark, tmp_path):
    r = random.Random(21)
    docs = [[i, "\n".join(speak(r, lang, 40) for _ in range(4)), lang, f"s{i % 3}", 0] for i in range(240) for lang in [r.choice(["en", "fr"])]]
    item = speak(r, "en", 30)
    passage = speak(r, "fr", 60)
    docs[10][1] += " " + item  # leaks
    docs[11][1] = item + "\n" + docs[11][1]
    docs[20][1] += "\n" + passage  # repeats
    docs[21][1] = passage + "\n" + docs[21][1]
    docs += [[500, docs[3][1], "en", "s0", 0], [501, docs[4][1].replace("\n", " ").upper(), None, "s0", 0]]  # copies
    words = docs[5][1].split()
    words[70] = "changed"
    docs += [[502, " ".join(words), "en", "s1", 0], [503, None, "en", "s1", None], [504, "12 34", "fr", None, 5]]
    spark.createDataFrame([tuple(d) for d in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept, frame = [], spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = frame.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frame, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        frame = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert frame.columns == columns, name
        kept.append({x.doc_id: x for x in frame.collect()})
    everything = {d[0] for d in docs}
    assert set(kept[0]) == everything - {503, 504}
    assert set(kept[1]) == set(kept[0]) - {500, 501, 502}
    assert set(kept[2]) == set(kept[1])
    assert passage in kept[2][20].text and passage not in kept[2][21].text
    assert all(kept[2][i].text == docs[i][1] for i in range(240) if i != 21)
    assert set(kept[3]) == set(kept[2]) - {10, 11}
    ranks = bpe.read_ranks()
    codec = bpe.Codec(ranks)
    for i, x in kept[4].items():
        assert x.n_tokens == len(x.ids) and codec.decode(codec.encode(kept[3][i].text)) == kept[3][i].text.encode()
    assert set(kept[4]) == set(kept[3])
    assert {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(kept[4])


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
