"""Pages from an index and after a key, against OFFSET."""
import random

import pytest
from pyspark.sql import functions as F

from syllabase.operators import paging as P

ORDER = [("a", True), ("b", False), ("k", True)]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = [(rng.choice([None, 1, 2, 3, 4]), rng.choice([None, "x", "y", "é"]), i) for i in range(403)]
    return spark.createDataFrame(data, "a int, b string, k long").repartition(4)


def whole(rows):
    return [tuple(r) for r in rows.orderBy(F.col("a").asc_nulls_first(), F.col("b").desc_nulls_last(), "k").collect()]


def test_index_pages_equal_offset_and_read_their_ranges_only(spark, rows):
    folder, want = P.build_index(rows, ORDER, ranges=8), whole(rows)
    got = []
    for page in range(1, 12):
        df = P.seek_page(spark, folder, page, 40, ORDER)
        got += [tuple(r)[:3] for r in df.collect()]
        assert all((r["total"], r["per_page"], r["last_page"]) == (403, 40, 11) for r in df.collect())
        if page == 10:
            assert 1 <= len({f.split("_range=")[1].split("/")[0] for f in df.inputFiles() if "_range=" in f}) <= 8
            text = df._jdf.queryExecution().executedPlan().toString()
            assert "PartitionFilters: [isnotnull(_range" in text and "Offset" not in text
    assert got == want and P.seek_page(spark, folder, 12, 40, ORDER).count() == 0
    # A page inside one range has one scan.
    assert P.seek_page(spark, folder, 1, 10, ORDER)._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_pages_after_a_key_equal_offset(rows):
    want, last, got = whole(rows), None, []
    while True:
        page = [tuple(r) for r in P.page_after(rows, ORDER, last, 60).collect()]
        if not page:
            break
        got += page
        last = list(page[-1])
    assert got == want


def test_the_key_reaches_the_scan(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey", "l_linenumber")
    text = P.page_after(lines, [("l_orderkey", True), ("l_linenumber", True)], [10, 2], 5)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_orderkey" in text and "TakeOrderedAndProject" in text


def test_an_empty_table_has_no_pages(spark):
    none = spark.createDataFrame([], "k long")
    folder = P.build_index(none, [("k", True)], ranges=2)
    assert P.seek_page(spark, folder, 1, 5, [("k", True)]).count() == 0
