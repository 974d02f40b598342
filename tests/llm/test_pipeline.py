import hashlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tidemill.llm import bpe, pii

from test_text_operators import brute_classes


def test_stages(spark, corpus, tmp_path):
    docs = corpus.select("doc_id", "text", "lang", "source", "n_chars").dropDuplicates(["doc_id"])
    rows = [(5000 + i, f"plain words number {i} zorkan zorkel you idiot {i}", "en", "s", 0) for i in range(12)]
    clean = [(6000 + i, f"some plain words number {i} that nobody minds at all {i * 7}", "en", "s", 0) for i in range(30)]
    extra = [(7000, "call one two three four five six seven eight nine ten now, please", "en", "s", 0), (7001, "write to the.72@mail3.example.com about a garden with blue doors", "en", "s", 0)]
    docs = docs.unionByName(spark.createDataFrame(rows + clean + extra, docs.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(5000 <= i < 6000)) for i, *_ in rows + clean]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, sf = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, sf)
        at.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id: r for r in at.collect()}
        if name != "bpe":
            assert at.columns == docs.columns
    assert not [i for i in seen["toxicity"] if 5000 <= i < 6000] and len(seen["toxicity"]) >= docs.count() - 14
    stage_in = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tmp_path}/toxicity").collect()]
    assert set(seen["near_duplicates"]) == {i for i, _, _, kept in brute_classes(stage_in) if kept}
    assert set(seen["near_duplicates"]) - set(seen["decontamination"]) == {7000}
    assert "the.72@" not in seen["pii"][7001].text and set(seen["pii"]) == set(seen["decontamination"])
    library = Tokenizer.from_file(bpe.VOCABULARY)
    for i, r in seen["bpe"].items():
        ids = np.array(library.encode(seen["pii"][i].text or "", add_special_tokens=False).ids, "<u4").tobytes()
        assert (r.ids, r.n_tokens, r.ids_sha256) == (ids, len(ids) // 4, hashlib.sha256(ids).hexdigest())
    whole = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, sf).collect()}
    assert whole == {i: r.ids_sha256 for i, r in seen["bpe"].items()}
    assert pii.pseudonymised(at.select("doc_id", F.lit("x").alias("text"))).count() == at.count()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def written(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(i >= 5000)) for i, *_ in rows if i]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)


def test_stages_on_empty_tables(spark, tmp_path):
    docs, sf = written(spark, tmp_path, [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0 and (name == "bpe" or out.columns == docs.columns)
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_rows_without_doc_id_and_with_the_same(spark, tmp_path):
    text = lambda k, n=30: " ".join(f"t{k}w{i}" for i in range(n))
    rows = [(None, text(1), "en", "a", 1), (None, text(1), "en", "a", 1), (None, None, "en", "a", 0), (1, text(2), "en", "a", 1), (1, text(3), "en", "b", 1), (1, text(2), "en", "a", 1), (2, text(3), "en", "a", 1), (3, text(4), "en", "a", 1), (4, "", "en", "a", 0), (5, None, "en", "a", None)]
    docs, sf = written(spark, tmp_path, rows)
    stages = dict(corpus_pipeline.STAGES)
    left = sorted(map(tuple, stages["near_duplicates"](spark, docs, sf).collect()), key=repr)
    # 2 has a text of 1's; of 1's rows only the repeated one goes
    assert left == sorted([r for k, r in enumerate(rows) if k not in (5, 6)], key=repr)
    for name in ("toxicity", "decontamination", "pii"):
        assert stages[name](spark, docs, sf).count() == len(rows)
    tokens = stages["bpe"](spark, docs, sf)
    assert tokens.count() == len(rows) and tokens.filter("n_tokens = 0").count() == 3


def test_registered():
    names = set(__spark_entry__.queries())
    assert {f"op{n}_" for n in range(1, 11)} <= {x.split("_")[0] + "_" for x in names} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= names
