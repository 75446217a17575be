import corpus_pipeline
from tallyloom.llm import language_id, toxicity
from tallyloom.llm.queries import held_out
from tallyloom.llm.scratch import materialize

from . import plain

SF = "/root/testdata/sf0.001"


def test_each_stage_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, SF), name)
        seen.append((name, before, docs))
        if name != "packing":
            assert docs.columns == columns and docs.dtypes == before.dtypes
    by = {name: (a, b) for name, a, b in seen}

    a, b = by["language_id"]
    wanted = plain.kept_by_language([r.asDict() for r in a.collect()], list(language_id.LANGUAGES), language_id.trigrams, language_id.BUCKETS)
    assert {r.doc_id for r in b.collect()} == wanted

    a, b = by["toxicity"]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").filter(~held_out()).collect()}
    rows = [(r.doc_id, r.text) for r in a.collect()]
    assert {r.doc_id for r in b.collect()} == dict(rows).keys() - plain.toxic(rows, labels, toxicity.fold)
    assert b.count() < a.count()

    a, b = by["line_dedup"]
    gone = plain.repeated_lines([(r.doc_id, r.text) for r in a.collect()])
    texts = {r.doc_id: r.text for r in a.collect()}
    result = {r.doc_id: r for r in b.collect()}
    assert result.keys() == texts.keys() and all(r.n_chars == len(r.text) for r in result.values())
    for i, lines in gone.items():
        assert result[i].text == "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in lines)

    a, b = by["simhash"]
    roots = plain.near_copies([(r.doc_id, r.text) for r in a.collect()])
    assert {r.doc_id for r in b.collect()} == set(roots.values()) and b.count() < a.count()

    a, b = by["packing"]
    assert b.select("doc_id").distinct().count() == a.count()


def test_stages_take_odd_documents(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "the of and to in a", "en", None, None), (3, "x" * 100_000, "en", "s", 1)], schema)
    kept = {}
    for rows in (odd, odd.limit(0)):
        docs = rows
        for name, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, SF), name)
            kept[name] = sorted((r.doc_id is None, r.doc_id or 0) for r in docs.select("doc_id").distinct().collect())
        # texts without letters go, and the one that the only other text's model tells nothing of; the last is neither toxic nor a copy
        assert all(k == ([(False, 3)] if rows is odd else []) for k in kept.values()), kept
    assert corpus_pipeline.run(spark, SF).count() > 0
