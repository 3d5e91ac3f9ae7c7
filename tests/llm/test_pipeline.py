"""The pipeline: stages chained as files, columns kept, and what each stage must do on a small corpus."""

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402


def test_stages_on_a_small_corpus(spark, make, tmp_path):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(80)) for _ in range(60)]
    bad = [t + " vile nasty rotten" for t in texts[:20]]
    near = [t.replace(t.split()[40], "changed", 1) for t in texts[20:30]]  # one line each, so lines decide
    private = ["mail me at someone@mail.example.org " + t for t in texts[30:33]]
    split = ["\n".join(" ".join(t.split()[i: i + 10]) for i in range(0, 80, 10)) for t in texts[33:36]]
    every = [*texts[20:30], *near, *bad, *private, *split, *split, None, ""]
    labels = [(i, int("vile" in (t or "")), 1) for i, t in enumerate(every)]
    folder = str(tmp_path)
    make(every).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
        kept.append(docs)
        assert k == 4 or docs.columns == columns
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in kept]
    toxic = set(range(20, 40))
    assert not ids[0] & toxic and ids[0] | toxic == set(range(len(every)))
    assert ids[1] == ids[0] - set(range(10, 20)) - {46, 47, 48}
    assert ids[2] == ids[1] == ids[3] == ids[4]
    assert not kept[3].where("text LIKE '%someone@%'").count()


def test_run_is_the_stages(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    assert rows.columns == ["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"]
