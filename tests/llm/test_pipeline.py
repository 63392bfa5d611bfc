"""The pipeline's stages on a small table."""

import random

import corpus_pipeline
from gridmoments.llm import jaccard, packing, quality, suffix


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice(["ta", "ne", "lo", "mi", "ka", "ré"]) for _ in range(rnd.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(70)
    rows, labels = [], []
    for i in range(300):
        t = text(rnd.randint(40, 120))
        if i % 5 == 0:
            t += " zorkish blargful zorkish"
            labels.append((i, 1, 1))
        else:
            labels.append((i, 1, 0))
        rows.append((i, t))
    rows += [(400 + k, text(60) + " " + passage + " " + text(60)) for k in range(4)] + [(500, rows[1][1]), (501, rows[1][1] + " end"), *((600 + k, " ".join(w + "###" for w in text(80).split())) for k in range(20)), (504, None), (505, "")]
    docs = spark.createDataFrame([(i, t, None if i % 7 else "en", "s", len(t or "")) for i, t in rows] + [(None, text(50), "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, kept = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        kept.append({r["doc_id"] for r in now.collect()})
    everyone = {i for i, _ in rows} | {None}
    toxic = set(range(0, 300, 5))
    assert everyone - kept[0] <= toxic and len(everyone - kept[0]) >= 0.9 * len(toxic)
    assert kept[0] - kept[1] == set(range(600, 620))
    assert kept[1] - kept[2] == {500, 501}
    assert kept[3] == kept[2]
    cut = {r["doc_id"]: r for r in now.collect()}
    assert all(passage[50:-50] not in cut[400 + k]["text"] and cut[400 + k]["n_chars"] == len(cut[400 + k]["text"]) for k in range(4))
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in pieces.collect()} == kept[3]
    assert jaccard and quality and suffix


def words(n, mark):
    return [f"{mark}{k}" for k in range(n)]


def test_near_copies_from_four_fifths_on(spark):
    a, b, c = words(100, "a"), words(100, "b"), words(100, "c")
    texts = [a, a + words(20, "x"), b, [*b[:30], "y", *b[31:60], "z", *b[61:]], c, c + words(30, "w")]  # 0.828, 0.811 and 0.762 of five-word shingles
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.keep_one_of_group(spark, docs, "").collect()} == {0, 2, 4, 5}


def test_packed_pieces_hold_their_tokens(spark):
    texts = {1: "some words of a text", 2: "other words " * 1500, 3: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    pieces = corpus_pipeline.pack_sequences(spark, docs, "").collect()
    encode = packing.whole_texts(corpus_pipeline.tokenizer("word_bpe_49k.json"), last=1)
    for i, t in texts.items():
        mine = sorted((p["start"], p["ids"]) for p in pieces if p["doc_id"] == i)
        assert [k for _, ids in mine for k in ids] == encode([t])[0][0].tolist()


def test_texts_of_one_id_are_different_documents(spark):
    a, b = " ".join(words(100, "a")), " ".join(words(100, "b"))
    docs = spark.createDataFrame([(1, a), (1, a), (1, b), (0, b + " end"), (3, a + " end")], "doc_id long, text string")
    kept = corpus_pipeline.keep_one_of_group(spark, docs, "")
    assert sorted(map(tuple, kept.collect())) == [(0, b + " end"), (1, a)]
    two = spark.createDataFrame([(1, a), (1, b), (None, "x")], "doc_id long, text string")
    assert sorted((tuple(r) for r in corpus_pipeline.cut_repeats(spark, two, "").collect()), key=str) == [(1, a), (1, b), (None, "x")]
    assert corpus_pipeline.keep_one_of_group(spark, two, "").count() == 3


def test_stages_take_empty_tables_and_clashing_columns(spark, tmp_path):
    text = " ".join(words(80, "a"))
    names = ["_row", "_toxicity", "_changed", "_quality_score", "component_id", "spans"]
    rows = [(i, text if i < 2 else " ".join(words(80, f"m{i}x")), "en", "s", 300, *range(10 * i, 10 * i + len(names))) for i in range(6)]
    form = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} long" for n in names)
    docs = spark.createDataFrame(rows, form)
    spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for some, most in ((docs, 6), (docs.where("false"), 0)):
            out = stage(spark, some, str(tmp_path))
            got = out.collect()
            assert out.columns == docs.columns and len(got) <= most, name
            assert all(r[n] == 10 * r["doc_id"] + k for r in got for k, n in enumerate(names)), name
        if name == "near_duplicates":
            assert {r["doc_id"] for r in stage(spark, docs, str(tmp_path)).collect()} == {0, 2, 3, 4, 5}
    assert corpus_pipeline.pack_sequences(spark, docs.where("false"), "").count() == 0
