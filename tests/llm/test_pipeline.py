import re

import corpus_pipeline
from taskweft.llm import op5_minhash
from taskweft.llm.queries import oracle_sql, queries


def test_stages(spark, odd, clash, none, no_labels, tmp_path):
    no_labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd, clash, none):
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, stage(spark, docs, str(tmp_path))
            assert docs.count() <= before.count(), name
            if name != "pieces":
                assert docs.columns == before.columns and docs.dtypes == before.dtypes, name
    assert "piece_ids" in docs.columns


def test_near_copies_leave_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.near_dedup(spark, docs, sf)
    judged = op5_minhash.near_duplicates(docs, words=5, percent=80, rows=6)
    assert kept.count() == judged.where("kept").count() == judged.select("component_id").distinct().count()


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0.5 * spark.read.parquet(f"{sf}/documents.parquet").count()
    assert [s for s, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mixing", "pieces"]


def test_names():
    names = list(queries())
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14)) and set(oracle_sql()) <= set(names)


def test_each_stage_against_brute_force(spark, tmp_path):
    """Every stage on what the one before kept, beside a plain version of it."""
    import random

    import sentencepiece
    from pyspark.sql import functions as F

    from taskweft.llm import op2_mixing, op4_quality
    from corpus_pipeline import LINE_PAGES
    from taskweft.llm.queries import LINE_RATIO, MIX, PIECE_MODEL, tokenizer_path
    from tests.llm.test_lines_urls import brute_lines
    from tests.llm.test_near_duplicates import brute

    rng = random.Random(4)
    words, rows, labels = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)], [], []
    for i in range(120):
        body = [" ".join(rng.choices(words, k=25)) for _ in range(3)]
        if i % 10 == 7:
            body = [x.upper().replace(" ", "!! ") for x in body]
        if i % 10 == 8:
            body[0] += " " + rng.choice(["idiot", "scum"]) + " moron"
        if i % 10 == 9 and i > 20:
            body = rows[i - 20][1].split("\n")[1:]
        rows.append((i, "\n".join(["site menu", *body]), "en", f"s{i % 3}", 500))
        labels.append((i, int(i % 10 != 7), int(i % 10 == 8)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    stages, folder = dict(corpus_pipeline.STAGES), str(tmp_path)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}

    good = stages["quality"](spark, docs, folder)
    assert ids(good) == ids(op4_quality.score_documents(docs, op4_quality.train(docs, labels)).where("score >= 0.5"))
    assert ids(good) >= {i for i in range(120) if i % 10 < 7}

    lines = stages["line_dedup"](spark, good, folder)
    want = brute_lines([(r.doc_id, r.text, r.source) for r in good.collect()], LINE_RATIO, LINE_PAGES)
    assert sorted(((r.doc_id, r.text) for r in lines.collect()), key=repr) == want and not any("menu" in t for _, t in want)
    assert lines.where(F.length("text") != F.col("n_chars")).count() == 0

    unique = stages["near_dedup"](spark, lines, folder)
    roots = brute([(r.doc_id, r.text) for r in lines.collect()], 5, 80)
    assert ids(unique) == {i for i, root in roots.items() if i == root} and len(ids(unique)) < lines.count()

    mixed = stages["mixing"](spark, unique, folder)
    rates = op2_mixing.mixing_rates(unique, op2_mixing.train_domains(unique, labels), MIX)
    assert ids(mixed) == ids(rates.where("copies > 0")) and not ids(mixed) & {i for i in range(120) if i % 10 == 8}

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECE_MODEL))
    for r in stages["pieces"](spark, mixed, folder).collect():
        assert r.piece_ids == sp.encode(r.text) and r.n_pieces == len(r.piece_ids)
