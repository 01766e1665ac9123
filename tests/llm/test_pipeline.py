import random

import corpus_pipeline
from dashframe.llm.common import stored
from tests.llm.helpers import docs, odd_rows, prose, row


def test_stages_on_odd_rows(spark, tmp_path):
    rng = random.Random(51)
    item = prose(rng, 40)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    base = prose(rng, 200)
    rows = odd_rows() + [row(100 + i, prose(rng, 80) + "\n" + prose(rng, 30)) for i in range(30)]
    rows += [row(200, base), row(201, base.replace("the", "thy", 1)), row(300, prose(rng, 40) + " " + item),
             row(400, " ".join(w + "$$$" for w in prose(rng, 50).split()))]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = frame.columns
    for name, stage in corpus_pipeline.STAGES:
        frame = stored(stage(spark, frame, str(tmp_path)), "test-stage")
        seen[name] = {r.doc_id for r in frame.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert frame.columns == names
    clean = {100 + i for i in range(30)}
    assert all(clean | {200} <= ids for ids in seen.values())
    assert not {1, 2, 3, 4} & seen["quality rules"]
    assert 201 not in seen["n-gram Jaccard join"] and 300 not in seen["benchmark decontamination"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == seen["byte-level BPE"]


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
