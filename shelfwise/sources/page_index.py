"""The index of article numbers to product pages, as a table with versions.

A version is a manifest: for each bucket of article numbers the folder that holds its rows, and how far pages have been
scanned. A scan finds what the last version lacks, writes only the buckets that change into a new folder, and its manifest
last, under a name that no other writer can take. So readers see whole versions, a write that is killed leaves the old one
as it was, and a scan that is repeated changes nothing.

The first page (by its place in the sitemap) with an article number holds it; pages without one are scanned once.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col

SCHEMA = "sku string, url string, at long"


@dataclass
class Version:
    number: int = 0
    mark: int = -1  # the last place in the sitemap that was scanned
    rows: int = 0
    folders: dict[str, str] = field(default_factory=dict)  # by bucket


class Conflict(RuntimeError):
    """Another writer has written this version first."""


class PageIndex:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        """root: a folder that the driver and all executors share; buckets is fixed when the first version is written."""
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # files

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _listed(self, folder: str) -> list[str]:
        fs, path = self._fs(), self._path(folder)
        return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []

    def _numbers(self) -> list[int]:
        return [int(x.removesuffix(".json")) for x in self._listed("versions") if x.endswith(".json")]

    def _manifest(self, number: int) -> Version:
        (text,) = self.spark.read.text(f"{self.root}/versions/{number:09d}.json", wholetext=True).first()
        return Version(**json.loads(text))

    def _publish(self, version: Version) -> None:
        """Writes a manifest aside and gives it its name at once, if nobody has taken it."""
        fs, name = self._fs(), f"{version.number:09d}.json"
        aside = self._path("aside", uuid.uuid4().hex)
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(asdict(version)).encode()))
        out.close()
        fs.mkdirs(self._path("versions"))
        if fs.exists(self._path("versions", name)) or not fs.rename(aside, self._path("versions", name)):
            fs.delete(aside, False)
            raise Conflict(f"version {version.number} is taken")

    # reading

    def version(self, number: int | None = None) -> Version:
        """The last version, or that of a number; an empty one before the first."""
        have = self._numbers()
        return self._manifest(number if number is not None else max(have)) if have else Version()

    def read(self, number: int | None = None) -> DataFrame:
        """(sku, url, at) of a version."""
        v = self.version(number)
        paths = [f"{self.root}/data/{folder}/bucket={b}" for b, folder in sorted(v.folders.items())]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def lookup(self, targets: DataFrame, key: str = "sku") -> DataFrame:
        """targets with the url of each article number's page, null where the index has none."""
        return targets.join(self.read().select(c("sku").alias(key), "url"), key, "left")

    def stats(self, sitemap: DataFrame) -> DataFrame:
        """(sitemap_urls, indexed, coverage_pct) against a sitemap (url)."""
        counted = sitemap.join(self.read().select("url", c("sku").isNotNull().alias("known")), "url", "left").agg(F.count_distinct("url").alias("sitemap_urls"), F.count_distinct(F.when(c("known"), c("url"))).alias("indexed"))
        pct = F.when(c("sitemap_urls") > 0, F.round(c("indexed") / c("sitemap_urls") * 100, 1)).otherwise(0.0)
        return counted.select("sitemap_urls", "indexed", pct.alias("coverage_pct"))

    def pending(self, sitemap: DataFrame, most: int | None = None) -> DataFrame:
        """Pages (at, url, ...) that no scan has seen and whose url isn't in the index, the first `most` of them."""
        left = sitemap.filter(c("at") > self.version().mark).join(self.read().select("url"), "url", "left_anti")
        return left if most is None else left.orderBy("at").limit(most)

    # writing

    def _bucket(self):
        return F.pmod(F.xxhash64("sku"), F.lit(self.buckets)).cast("int")

    def scan(self, pages: DataFrame) -> Version:
        """Takes pages (at, url, sku) into the index; pages without a sku only move the mark. Gives the version that then holds."""
        v = self.version()
        held = self.read()
        seen = pages.select(c("at").cast("long").alias("at"), "url", c("sku").cast("string").alias("sku"))
        found = seen.filter("sku is not null and sku <> ''").join(held.select("url"), "url", "left_anti").join(held.select("sku"), "sku", "left_anti")
        first = found.groupBy("sku").agg(F.min_by("url", F.struct("at", "url")).alias("url"), F.min("at").alias("at")).withColumn("bucket", self._bucket())
        # one row for each bucket: as many as the index has, whatever the pages
        changed = {r.bucket: r.n for r in first.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
        mark = max(v.mark, seen.agg(F.max("at")).first()[0] or -1)
        if not changed and mark == v.mark:
            return v
        folders = dict(v.folders)
        if changed:
            folder = f"{v.number + 1:09d}-{uuid.uuid4().hex}"
            old = held.withColumn("bucket", self._bucket()).filter(c("bucket").isin(*changed))
            rows = old.unionByName(first.select("sku", "url", "at", "bucket")).repartition("bucket")
            rows.write.partitionBy("bucket").parquet(f"{self.root}/data/{folder}")
            folders |= {str(b): folder for b in changed}
        after = Version(v.number + 1, mark, v.rows + sum(changed.values()), folders)
        self._publish(after)
        return after

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes data that none of the last `keep` versions has, and older manifests. Gives the folders that went."""
        numbers = sorted(self._numbers())[-keep:]
        used = {f for n in numbers for f in self._manifest(n).folders.values()}
        gone = [x for x in self._listed("data") if x not in used]
        for x in gone:
            self._fs().delete(self._path("data", x), True)
        for n in set(self._numbers()) - set(numbers):
            self._fs().delete(self._path("versions", f"{n:09d}.json"), False)
        return gone
