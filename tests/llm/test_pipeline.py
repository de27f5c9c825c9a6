"""The pipeline's stages, each on what its predecessor kept."""
import random
import re

import corpus_pipeline as P
from lineweave.llm import queries
from lineweave.llm.shared import n_words

from .cases import docs_of, words


def test_queries_have_all_operators():
    assert sorted({int(k[2:].split("_")[0]) for k in queries.QUERIES}) == list(range(1, 14)) and set(queries.ORACLES) <= set(queries.QUERIES)


def test_stages(spark, tmp_path):
    rng = random.Random(21)
    item = words(rng, 40, 5000)
    texts = {i: words(rng, 70, 5000) for i in range(40)}
    texts |= {50: texts[1], 51: texts[2] + " more", 52: words(rng, 30, 5000) + " " + item + " " + words(rng, 30, 5000), 53: words(rng, 30, 5000) + " mail me@here.org now", 54: "too short", 55: None, 56: ""}
    rows = [(i, t, f"src{i % 3}") for i, t in texts.items()] + [(3, texts[3], "src0"), (None, words(rng, 50, 5000), None), (60, words(rng, 60, 5000), "src1"), (60, words(rng, 60, 5000), "src1")]
    docs = docs_of(spark, rows)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    d = docs
    seen = []
    for k, (name, stage) in enumerate(P.STAGES):
        d = stage(spark, d, str(tmp_path))
        d.write.parquet(f"{tmp_path}/out{k}")
        d = spark.read.parquet(f"{tmp_path}/out{k}")
        if k < 4:
            assert d.columns == docs.columns
        seen.append(sorted(str(r.doc_id) for r in d.select("doc_id").collect()))
    plain = [*range(40), 53, 60, 60]  # two texts of one id are two documents
    assert seen[0] == sorted(map(str, [*plain, 3, 50, 51, 52, None]))
    assert seen[1] == sorted(map(str, [*plain, 52, None]))
    assert seen[2] == seen[3] == seen[4] == sorted(map(str, [*plain, None]))
    redacted = spark.read.parquet(f"{tmp_path}/out3").filter("doc_id = 53").first()
    assert redacted.text.endswith("mail [email] now") and redacted.n_chars == len(redacted.text)
    assert P.run(spark, str(tmp_path)).count() == len(seen[4])


def test_stages_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs_of(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_tells_rows_apart(spark):
    rng = random.Random(8)
    a, b, c = (words(rng, 60, 5000) for _ in range(3))
    rows = [(1, a), (1, b), (2, c), (2, c), (3, c), (None, c), (None, None), (None, None), (4, "")]
    got = P.near_dedup(spark, docs_of(spark, rows), "").collect()
    assert sorted((str(r.doc_id), r.text or "") for r in got) == sorted([("1", a), ("1", b), ("2", c), ("None", ""), ("4", "")])


def test_words_are_counted_without_holding_each(spark):
    texts = [None, "", " \t", "a", " a\tb\x0bc\x0cd\re\n", "w w", "ação x \U0001F600 y", "\x85  é"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", n_words("t").alias("n"))
    assert [r.n for r in df.collect()] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    assert "regexp_extract_all" not in df._jdf.queryExecution().optimizedPlan().toString()
