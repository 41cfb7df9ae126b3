"""Queries on containers rank the columns they use."""

from basewise.queries import QUERIES
from basewise.session import scratch_dir
from basewise.streaming.commit import folders


def test_containers_store_only_the_columns_in_use(spark, tmp_path):
    rows = spark.range(40).selectExpr("id as o_orderkey", "id * 7 as o_custkey", "case when id % 9 = 0 then 'P' else 'O' end as o_orderstatus")
    rows.write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(25).selectExpr("cast(id as int) as n_nationkey", "concat('N', id) as n_name").write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(5).selectExpr("cast(id as int) as r_regionkey", "concat('R', id) as r_name").write.parquet(f"{tmp_path}/region.parquet")
    old = set(folders(spark, f"{scratch_dir(spark)}/ranked-*"))
    assert QUERIES["containers_by_coordinate"](spark, str(tmp_path)).count() > 0
    new = [f for f in folders(spark, f"{scratch_dir(spark)}/ranked-*") if f not in old]
    assert new and not {"seq", "qual", "tags", "cigar"} & set(spark.read.parquet(new[0]).columns)
