import pytest
from pyspark.sql import functions as F

from spindrift.operators import diff, merkle


def table(spark, n, change=lambda i: i):
    rows = [(f"k{i}", f"v{c}") for i in range(n) if (c := change(i)) is not None]
    return spark.createDataFrame(rows, "path string, hash string")


def rows_of(df):
    return sorted((r.path, r.state) for r in df.collect())


def test_difference_is_that_of_the_join(spark, tmp_path):
    old = table(spark, 6000)
    new = table(spark, 6010, lambda i: None if i in (5, 700) else -1 if i in (9, 4000) else i)
    a = merkle.build(old, f"{tmp_path}/a")
    b = merkle.build(new, f"{tmp_path}/b", like=a)
    assert a.levels == 2 and rows_of(merkle.tree_diff(a, b)) == rows_of(diff.manifest_diff(old, new))
    unlike = merkle.differing(a, b)
    assert 0 < len(unlike) <= 14
    read = merkle.leaves(a, unlike)
    assert read.count() <= 14 * 60 and "PartitionFilters: [folder" in read._jdf.queryExecution().executedPlan().toString()
    assert merkle.tree_diff(a, b).count() == 14


def test_equal_tables_have_one_fingerprint(spark, tmp_path):
    a = merkle.build(table(spark, 500), f"{tmp_path}/a")
    b = merkle.build(table(spark, 500).orderBy(F.desc("hash")).repartition(3), f"{tmp_path}/b", like=a)
    assert a.root() == b.root() and merkle.differing(a, b) == [] and merkle.tree_diff(a, b).count() == 0
    again = merkle.open_tree(spark, f"{tmp_path}/a")
    assert again.root() == a.root() and again.levels == a.levels


def test_nulls_empty_tables_and_shapes(spark, tmp_path):
    none = merkle.build(table(spark, 0), f"{tmp_path}/none")
    rows = spark.createDataFrame([("a", None), ("b", "x"), ("c", "")], "path string, hash string")
    some = merkle.build(rows, f"{tmp_path}/some", like=none)
    assert none.root() is None and rows_of(merkle.tree_diff(none, some)) == [("a", "extra"), ("b", "extra"), ("c", "extra")]
    other = merkle.build(rows.fillna({"hash": ""}), f"{tmp_path}/other", like=none)
    assert rows_of(merkle.tree_diff(some, other)) == [("a", "stale")]
    with pytest.raises(ValueError):
        merkle.differing(none, merkle.build(table(spark, 6000), f"{tmp_path}/large"))


def test_many_differences_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "NAMED", 3)
    old, new = table(spark, 900), table(spark, 900, lambda i: -i)
    a = merkle.build(old, f"{tmp_path}/a")
    b = merkle.build(new, f"{tmp_path}/b", like=a)
    assert merkle.differing(a, b) is None and rows_of(merkle.tree_diff(a, b)) == rows_of(diff.manifest_diff(old, new))
