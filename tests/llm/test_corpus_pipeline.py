"""The pipeline's stages against the operators' rules."""

import corpus_pipeline as pipeline
from pyspark.sql import functions as F
from llm_fixtures import by_id, no_rows, oracle, tables, texts  # noqa: F401
from ledgerline.llm import toxicity
from ledgerline.llm.jaccard_join import link_components
from ledgerline.llm.line_dedup import LineIndex


def test_stages(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, start = docs.columns, docs
    kept = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, tables)
        out.write.parquet(f"{tmp_path}/{name}")
        kept[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name != pipeline.STAGES[-1][0]:
            assert kept[name].columns == columns
        docs = kept[name]
    lexicon = toxicity.fit(start, spark.read.parquet(f"{tables}/labels.parquet"))
    clean = {d for d, (s,) in by_id(toxicity.score(start, lexicon), "score").items() if s < 0.3}
    assert {r["doc_id"] for r in kept["toxicity"].collect()} == clean
    index = LineIndex(spark, f"{tmp_path}/lines")
    index.insert(kept["toxicity"])
    want = by_id(index.apply(kept["toxicity"]).select(*columns), "text")
    assert by_id(kept["line_dedup"], "text") == want
    groups = by_id(link_components(kept["line_dedup"], pipeline.NEAR_WORDS, pipeline.NEAR_PERCENT),
                   "component_id")
    assert {r["doc_id"] for r in kept["jaccard_join"].collect()} == {c for c, in groups.values()}
    before = {r["doc_id"] for r in kept["jaccard_join"].collect()}
    times = {}
    for r in kept["mixing"].collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert set(times) <= before and max(times.values()) <= 3
    pieces = kept["packing"].collect()
    whole = {}
    for r in pieces:
        whole[r["doc_id"]] = whole.get(r["doc_id"], 0) + r["length"] / r["doc_tokens"]
    assert {d: round(n) for d, n in whole.items()} == times


def test_no_documents(spark, no_rows):
    assert pipeline.run(spark, no_rows).collect() == []


def test_one_of_each_keeps_rows_without_id(spark):
    from ledgerline.llm.jaccard_join import one_of_each
    text = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(2, text, "a"), (1, text + " end", "b"), (None, text, "c"),
                                  (3, "", "d"), (4, None, "e")], "doc_id long, text string, x string")
    assert sorted(r["x"] for r in one_of_each(docs).collect()) == ["b", "c", "d", "e"]


def test_near_copies_by_five_words_and_four_fifths(spark):
    words = [f"word{i}" for i in range(500)]
    near, far = list(words), list(words)
    for i in range(11):  # 441 of 551 shingles of five words: 0.8004
        near[40 * i + 20] = f"edit{i}"
    for i in range(12):  # 436 of 556: 0.784
        far[40 * i + 10] = f"other{i}"
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))],
                                 "doc_id long, text string")
    kept = pipeline.one_per_group(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_own_columns_keep_their_values(spark, tables):
    names = ["_id", "_rank", "_draw", "_drop", "_drop_doc", "_copy", "_part", "_n", "doc", "size",
             "source_size", "target", "times", "n_lines", "n_dropped", "kept_sha256", "h1"]
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    docs = docs.unionAll(docs.where("doc_id % 40 = 0"))  # repeated rows
    docs = docs.unionAll(docs.limit(1).selectExpr("CAST(NULL AS BIGINT) AS doc_id", *[
        f"`{c}`" for c in docs.columns if c != "doc_id"]).select(*docs.columns))
    docs = docs.select("*", *[
        F.concat_ws("-", F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n)
        for n in names])
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, tables)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows, name
        for r in rows:
            own = "none" if r["doc_id"] is None else str(r["doc_id"])
            assert all(r[n] == f"{n}-{own}" for n in names), (name, r["doc_id"])
    assert pipeline.STAGES[-1][1](spark, docs, tables).count() >= docs.count()
