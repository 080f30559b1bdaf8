import corpus_pipeline as pipeline
from panelcast.session import stage

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    sizes = [docs.count()]
    for name, function in pipeline.STAGES:
        docs = stage(function(spark, docs, SF), name)
        sizes.append(docs.count())
        if name != "tokens":
            assert docs.columns == pipeline.COLUMNS
        if name == "near_duplicates":
            kept = [r["text"] for r in docs.collect()]
            assert len(set(kept)) == len(kept)
        if name == "secrets":
            assert docs.where("text rlike '[0-9a-f]{32}|AKIA[A-Z0-9]{12}'").count() == 0
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    assert sizes[0] > sizes[1] >= sizes[2] == sizes[3] and sizes[4] == sizes[5]
    assert docs.where("NOT round_trip").count() == 0 and set(texts) >= {r["doc_id"] for r in docs.collect()}


def test_empty_and_odd_rows(spark):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "s", 0)]
    rows += [(None, "plain words " * 30, "en", "s", 360)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, function in pipeline.STAGES:
        assert function(spark, docs.limit(0), SF).count() == 0, name
        out = function(spark, docs, SF).count()
        assert out == {"quality_rules": 0, "near_duplicates": 3}.get(name, out)
