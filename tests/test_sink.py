import os

import pytest
from pyspark.sql import functions as F

from spindrift.sources import sink


def files_below(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names)


def table(spark, rows):
    return spark.createDataFrame(rows, "name string, text string, other int").repartition(3, "name")


def test_files_are_written_read_back_and_replaced(spark, tmp_path):
    sink.register(spark)
    path = str(tmp_path / "out")
    rows = [(f"page/{i} ü", f"# Title {i}\n\nüber\n", i) for i in range(20)] + [("_x", None, 0), (".y", "", 0), ("z" * 400, "long", 0)]
    table(spark, rows).write.format("markdown").mode("append").save(path)
    found = files_below(path)
    assert len(found) == 23 and all(f.endswith(".md") and f.startswith("task-") for f in found)
    read = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    assert {r.value for r in read.collect()} == {t for _, t, _ in rows if t}  # empty files give no row
    table(spark, rows[:2]).write.format("markdown").mode("overwrite").save(path)
    assert len(files_below(path)) == 2
    table(spark, rows[2:3]).write.format("markdown").mode("append").save(path)
    assert len(files_below(path)) == 3


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    sink.register(spark)
    path = str(tmp_path / "out")
    table(spark, [("kept", "x", 1)]).write.format("markdown").mode("append").save(path)
    before = files_below(path)
    bad = table(spark, [(f"n{i}" if i != 5 else None, "t", i) for i in range(9)])
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="no name"):
            bad.write.format("markdown").mode(mode).save(path)
        assert files_below(path) == before
    with pytest.raises(Exception, match="columns name and text"):
        bad.select(F.col("name")).write.format("markdown").mode("append").save(path)


def test_names():
    names = ["a/b", "a%2Fb", ".x", "_x", "x" * 300, "x" * 299 + "y"]
    made = [sink.file_name(n) for n in names]
    assert len(set(made)) == len(names) and all("/" not in n and n[0] not in "._" and len(n) <= sink.LONGEST for n in made)
