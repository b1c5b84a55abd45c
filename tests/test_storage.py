from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomspan.plans import storage as S


def written_bytes(table):
    return sum(f.stat().st_size for f in Path(table._written_at.removeprefix("file:")).glob("*.parquet"))


@pytest.mark.parametrize("limit", [S.BROADCAST_BYTES, 9000])
def test_rows_are_picked_where_they_lie(spark, tmp_path, limit):
    spark.range(100_000).repartition(7).select("id", F.lit("x").alias("__row"), F.lit(1).alias("_metadata"), F.lit(2).alias("__block")).write.parquet(f"{tmp_path}/d")
    numbered = S.number_rows(spark.read.parquet(f"{tmp_path}/d"))
    assert numbered.df.select(F.count_distinct(numbered.row)).first()[0] == 100_000
    listed = numbered.df.filter("id % 10 = 0").select(numbered.row)
    for keep, n, tens in ((True, 10_000, 10_000), (False, 90_000, 0)):
        got = numbered.pick(listed, keep=keep, limit=limit)
        assert got.columns == numbered.df.columns
        assert tuple(got.agg(F.count("*"), F.count(F.when(F.col("id") % 10 == 0, 1))).first()) == (n, tens)
    marks = numbered.marks(numbered.df.select(numbered.row, (F.col("id") % 4).alias("n")), most=3)
    assert numbered.counted(marks, "n", lambda rows: rows, limit).filter("n <> id % 4").isEmpty()


def test_what_is_written_does_not_depend_on_the_limit(spark, tmp_path):
    texts = spark.range(20_000).repartition(7).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text"))
    texts.write.parquet(f"{tmp_path}/d")
    numbered = S.number_rows(spark.read.parquet(f"{tmp_path}/d"))
    listed = numbered.df.filter("id % 2000 = 7").select(numbered.row)
    whole = sum(f.stat().st_size for f in (tmp_path / "d").glob("*.parquet"))
    sizes = []
    for limit in (S.BROADCAST_BYTES, 9000):
        picked = numbered.pick(listed, limit=limit)
        assert sorted(r.id for r in picked.collect()) == list(range(7, 20_000, 2000))
        sizes.append(written_bytes(picked))
    assert max(sizes) < whole / 50 and max(sizes) - min(sizes) < whole / 50
    # a decision that keeps few rows writes few, in one group or in several
    marks = numbered.marks(listed.select(numbered.row, F.lit(1).alias("n")))
    kept = numbered.counted(marks, "n", lambda rows: rows.filter("n = 1").select("id", "text"), 9000)
    assert S.is_written(kept) and kept.count() == 10 and written_bytes(kept) < whole / 50


def test_digest_of_a_row(spark):
    rows = spark.createDataFrame([(1, "a", None, {"k": 1}), (1, "a", None, {"k": 1}), (1, "A", None, {"k": 1}), (1, "a", 0, {"k": 1}), (1, "a", None, None)], "i int, t string, n int, m map<string,int>")
    got = [r[0] for r in rows.select(S.row_digest(rows)).collect()]
    assert got[0] == got[1] and len(set(got)) == 4


def test_tables_without_files_are_written_first(spark):
    numbered = S.number_rows(spark.range(10).filter("id <> 3"))
    assert sorted(r.id for r in numbered.pick(numbered.df.filter("id > 6").select(numbered.row)).collect()) == [7, 8, 9]
    empty = S.number_rows(spark.range(0))
    assert empty.pick(empty.df.select(empty.row)).collect() == []


def test_scratch_tables_go(spark):
    with S.scratch() as keep:
        gone, stays = S.materialize(spark.range(3)), keep(S.materialize(spark.range(4)))
    assert stays.count() == 4
    with pytest.raises(Exception, match="(?i)exist|not find|not_found"):
        spark.read.parquet(gone._written_at).count()
    S.discard(stays)


def test_rows_are_dealt_by_their_number(spark):
    rows = spark.range(0, 10_000, 1, 1).selectExpr("id div 5 AS graph", "id")
    some = S.dealt(rows, "graph", most=500)
    sizes = [n for (n,) in some.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).select("n").collect()]
    assert len(sizes) == 20 and max(sizes) < 1_000 and sum(sizes) == 10_000
    assert S.dealt(rows, "graph", most=10_000) is rows
