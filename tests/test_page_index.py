"""The page index: scans, repeats, killed writes, conflicts, clean-up."""

import pytest
from pyspark.sql import functions as F

from shelfwise.sources.page_index import Conflict, PageIndex

PAGES = "at long, url string, sku string"


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(k, f"u{k}", None if k % 5 == 4 else f"S{k % 30}") for k in range(100)], PAGES)


def first_of(n):
    out = {}
    for k in range(n):
        if k % 5 != 4:
            out.setdefault(f"S{k % 30}", (f"S{k % 30}", f"u{k}", k))
    return sorted(out.values())


def test_scans_and_repeats_give_one_index(spark, pages, tmp_path):
    index = PageIndex(spark, f"file://{tmp_path}/a", buckets=8)
    assert index.version().number == 0 and rows_of(index.read()) == []
    one = index.scan(index.pending(pages, 10))
    assert (one.number, one.mark, one.rows) == (1, 9, 8) and rows_of(index.read()) == first_of(10)
    two = index.scan(index.pending(pages))
    assert (two.number, two.mark) == (2, 99) and rows_of(index.read()) == first_of(100)
    assert index.scan(pages) == two and index.scan(pages.limit(0)) == two and index.pending(pages).count() == 0
    whole = PageIndex(spark, f"file://{tmp_path}/b", buckets=3)
    whole.scan(pages)
    assert rows_of(whole.read()) == rows_of(index.read())
    assert rows_of(index.read(1)) == first_of(10)
    (s,) = index.stats(pages.select("url")).collect()
    assert (s.sitemap_urls, s.indexed, s.coverage_pct) == (100, len(first_of(100)), round(len(first_of(100)), 1))
    found = index.lookup(spark.createDataFrame([("S1",), ("S8",), ("S999",)], "sku string"))
    assert rows_of(found.withColumn("url", F.coalesce("url", F.lit("")))) == [("S1", "u1"), ("S8", "u8"), ("S999", "")]


def test_only_changed_buckets_are_written(spark, tmp_path):
    index = PageIndex(spark, f"file://{tmp_path}", buckets=64)
    index.scan(spark.createDataFrame([(k, f"u{k}", f"S{k}") for k in range(200)], PAGES))
    before = index.version()
    after = index.scan(spark.createDataFrame([(300, "u300", "S300"), (301, "u1", "S301")], PAGES))
    assert sum(after.folders[b] != before.folders.get(b) for b in after.folders) == 1 and after.rows == 201
    assert index.vacuum(keep=1) == [] and rows_of(index.read())[0][0] == "S0"


def test_a_killed_write_and_a_second_writer(spark, pages, tmp_path, monkeypatch):
    index = PageIndex(spark, f"file://{tmp_path}", buckets=4)
    index.scan(pages.filter("at < 20"))
    want = rows_of(index.read())

    def killed(version):
        raise KeyboardInterrupt

    monkeypatch.setattr(index, "_publish", killed)
    with pytest.raises(KeyboardInterrupt):
        index.scan(pages)
    other = PageIndex(spark, f"file://{tmp_path}", buckets=4)
    assert rows_of(other.read()) == want and other.version().number == 1
    stale = other.version()
    other.scan(pages)
    with pytest.raises(Conflict):
        other._publish(type(stale)(stale.number + 1))
    assert rows_of(other.read()) == first_of(100)
    assert len(other.vacuum(keep=1)) >= 1 and rows_of(other.read()) == first_of(100)
