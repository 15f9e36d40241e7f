"""The versioned table: replacements, failing jobs, rollback, conflicts."""

import pytest
from pyspark.sql import functions as F

from siftwork.sources.shared import shared_folder
from siftwork.sources.versions import VersionConflict, VersionedTable


def told(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def table(spark):
    return VersionedTable(spark, shared_folder(spark, "versions"), spark.createDataFrame([], "file_id long, part int, text string").schema, ["file_id"])


def test_replace_read_rollback(spark, table):
    rows = lambda *r: spark.createDataFrame(list(r), table.schema)
    assert told(table.read()) == [] and table.versions() == []
    first = [(k, p, f"a{k}") for k in range(60) for p in range(2)] + [(None, 0, "none")]
    assert table.replace(rows(*first)) == 1 and told(table.read()) == sorted(first, key=str)
    assert table.replace(rows((3, 0, "b"), (99, 0, "c"), (None, 1, "new")), gone=spark.createDataFrame([(5,)], "file_id long")) == 2
    want = [r for r in first if r[0] not in (3, 5, None)] + [(3, 0, "b"), (99, 0, "c"), (None, 1, "new")]
    assert told(table.read()) == sorted(want, key=str) and told(table.read(1)) == sorted(first, key=str)
    assert len({f for k, f in table._manifest(2).items()}) == 2  # only some buckets are written again
    assert table.rollback(1) == 3 and told(table.read()) == sorted(first, key=str)
    assert table.replace(rows()) == 4 and told(table.read()) == sorted(first, key=str)
    with pytest.raises(ValueError):
        table.read(9)
    assert table.vacuum() == 2 and table.versions() == [4] and told(table.read()) == sorted(first, key=str)


def test_a_job_that_fails_leaves_the_version(spark, table):
    table.replace(spark.createDataFrame([(k, 0, "a") for k in range(40)], table.schema))
    broken = spark.range(40).select(F.col("id").alias("file_id"), F.lit(0).alias("part"), F.when(F.col("id") == 39, F.raise_error(F.lit("half-way")).cast("string")).otherwise("b").alias("text"))
    with pytest.raises(Exception, match="half-way"):
        table.replace(broken.repartition(8))
    assert table.versions() == [1] and {r["text"] for r in table.read().collect()} == {"a"} and table.read().count() == 40


def test_two_writers(spark, table):
    table.replace(spark.createDataFrame([(1, 0, "a")], table.schema))
    with pytest.raises(VersionConflict):
        table._point(1, {})
    assert told(table.read()) == [(1, 0, "a")]
