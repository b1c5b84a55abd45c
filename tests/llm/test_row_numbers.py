import pytest
from llm_cases import SCHEMA, frame, prose

import corpus_pipeline as P
from loomspan.llm import exact_dedup, near_copies
from loomspan.plans import storage


@pytest.mark.parametrize("stage", [P.drop_exact_copies, P.drop_near_copies])
def test_other_splits_between_scans(spark, tmp_path, monkeypatch, stage):
    """The cores of the moment, and with them the splits, change between a stage's jobs; the right rows go."""
    cores = "spark.sql.leafNodeDefaultParallelism"
    texts = prose(31, 60)
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(100 + i, t, "en", "s", len(t)) for i, t in enumerate(texts[:25])]
    frame(spark, rows).repartition(13).write.parquet(f"{tmp_path}/documents")

    def write(df, inner=storage.materialize):
        out = inner(df)
        spark.conf.set(cores, "2" if spark.conf.get(cores) == "7" else "7")
        return out

    for module in (storage, exact_dedup, near_copies):
        monkeypatch.setattr(module, "materialize", write)
    spark.conf.set(cores, "7")
    try:
        got = stage(spark, spark.read.parquet(f"{tmp_path}/documents"), "").collect()
    finally:
        spark.conf.unset(cores)
    assert sorted(r.text for r in got) == sorted(texts)


def test_copies_of_a_table_give_one_corpus(spark, tmp_path):
    """Where ids tie, what a row holds decides, not where its file lies."""
    texts = prose(77, 40)
    rows = [(i % 20, t if i % 2 else t.replace("t", "T"), "en", f"s{i % 3}", i) for i, t in enumerate(x for t in texts for x in (t, t))]
    kept = []
    for k in range(3):
        frame(spark, rows).repartition(3 + k).write.parquet(f"{tmp_path}/copy{k}")
        docs = spark.read.schema(SCHEMA).parquet(f"{tmp_path}/copy{k}")
        for stage in (P.drop_exact_copies, P.drop_near_copies):
            kept.append((stage.__name__, sorted(map(tuple, stage(spark, docs, "").collect()))))
    assert all(rows == dict(kept)[name] for name, rows in kept) and all(0 < len(rows) <= 40 for _, rows in kept)
