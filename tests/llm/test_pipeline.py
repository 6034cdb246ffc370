"""The stages in order: columns stay, decisions take effect, clean documents survive."""

import random

import numpy as np

import corpus_pipeline
from paretoflow.llm import tokens
from tests.llm.conftest import prose


def test_stages(spark, tmp_path):
    r = random.Random(5)
    clean = [(k, prose(500 + k, 60) + ".\n" + prose(900 + k, 40) + ".", "en", f"src{k % 2}") for k in range(40)]
    near = [(100 + k, clean[k][1].replace(" ", "  ", 1), "en", "src0") for k in range(5)]
    passage = prose(77, 70)
    shared = [(200 + k, prose(600 + k, 50) + ".\n" + passage, "en", "src1") for k in range(4)]
    junk = [(300 + k, " ".join(w + "$$$" for w in prose(700 + k, 60).split()), "en", "src0") for k in range(20)]
    empty = [(400, "", "en", "src0"), (401, None, None, None)]
    data = [(i, t, lang, s, len(t or "")) for i, t, lang, s in clean + near + shared + junk + empty]
    r.shuffle(data)
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, 1, 0) for k in range(0, 40, 2)] + [(300 + k, 0, 0) for k in range(0, 20, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path}/stage{n}"
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        columns, docs = docs.columns, spark.read.parquet(path)
        assert n == 4 or docs.columns == columns
        kept[n] = {i: x for x in docs.collect() for i in (x["doc_ids"] if n == 4 else [x["doc_id"]])}
    assert set(kept[0]) == {i for i, *_ in clean + near + shared}
    assert set(kept[1]) == {i for i, *_ in clean + shared}
    assert sum(passage in x["text"] for x in kept[2].values()) == 1 and passage in kept[2][200]["text"]
    assert all(kept[2][i]["text"] == t for i, t, *_ in clean)
    assert all(x["n_chars"] == len(x["text"]) for x in kept[2].values())
    assert set(kept[4]) == set(kept[3]) and kept[3]
    encode, texts = tokens.encoder(tokens.vocabulary_path()), {i: x["text"] for i, x in kept[3].items()}
    for s in docs.collect():
        ids = np.frombuffer(bytes(s["token_ids"]), "<u4").tolist()
        assert len(ids) == s["n_tokens"] == sum(s["lengths"]) <= 2048
        for i, start, length in zip(s["doc_ids"], s["starts"], s["lengths"]):
            assert ids[:length] == [*encode(texts[i]), 1][start : start + length]
            ids = ids[length:]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_stages_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
