"""The pipeline's stages against brute force on a small table."""

import os

import pytest

import corpus_pipeline
from quillstream.llm import rules

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    assert len(corpus_pipeline.STAGES) == 4
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"] for r in rules.apply_rules(docs).filter("kept").collect()}
    sizes, now = [], docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.stored(stage(spark, now, SF), "t")
        assert now.columns == docs.columns
        sizes.append({r["doc_id"] for r in now.collect()})
    assert sizes[0] == kept and sizes[2] <= sizes[1] <= sizes[0]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len({texts[i] for i in sizes[2]}) == len(sizes[2])  # no copy is left

    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}

    sets = {i: grams(texts[i]) for i in sizes[1]}
    near = lambda a, b: len(a & b) >= 0.5 * len(a | b) and bool(a & b)
    left = sorted(sizes[2])
    assert not any(near(sets[a], sets[b]) for k, a in enumerate(left) for b in left[:k])
    assert all(any(near(sets[i], sets[j]) for j in sizes[1] - {i}) for i in sizes[1] - sizes[2])  # only copies go
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in packed} == sizes[2]


ODD = [None, "", " \n", "x", "word " * 5]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `_text` string, Row_Key string, kept string, `a.b` int, features string"


def folder(spark, tmp_path, rows, labels):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages_keep_clashing_columns_and_survive_odd_rows(spark, tmp_path):
    good = [r for r in spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1"), "doc_id").orderBy("doc_id").limit(40).collect()]
    rest = ("en", "s", 1, "mine", "mine", "mine", 7, "mine")
    rows = [(r["doc_id"], r["text"], *rest) for r in good]
    rows += [(r["doc_id"] + 10**6, r["text"], *rest) for r in good[:5]] + rows[:3] + [(None, rows[0][1], *rest), (None, rows[0][1], *rest)]
    rows += [(2 * 10**6 + k, t, *rest) for k, t in enumerate(ODD)] + [(3 * 10**6, " ".join([rows[0][1], rows[1][1]] * 60), *rest)]
    at = folder(spark, tmp_path, rows, [(r["doc_id"], 1, 0) for r in good] + [(None, 1, 0), (5, None, None)])
    now = spark.read.parquet(f"{at}/documents.parquet")
    columns = now.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.stored(stage(spark, now, at), "t")
        assert now.columns == columns
        assert all(tuple(r)[2:] == rest for r in now.collect())
    texts = [r["text"] for r in now.collect()]
    assert texts and len(texts) == len(set(texts)) and not set(texts) & set(ODD)
    ids = [r["doc_id"] for r in now.collect()]
    assert all(i is not None and i < 10**6 or i == 3 * 10**6 for i in ids)  # of copies the least id stays
    packed = corpus_pipeline.pattern_packing(spark, now, at).collect()
    assert {r["doc_id"] for r in packed} == set(ids)


def test_empty_tables_and_missing_labels(spark, tmp_path):
    at = folder(spark, tmp_path, [], [(1, 0, 0)])
    assert corpus_pipeline.run(spark, at).count() == 0
    rows = [(k, f"the river and the stone in a garden of light {k} " * 4, "en", "s", 1, "", "", "", 1, "") for k in range(3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert corpus_pipeline.quality_classifier(spark, docs, at).count() == 3


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
