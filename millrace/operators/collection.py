"""A stored collection of hashed items that new batches are looked up in and added to.

The collection is two Parquet tables in a folder. ``items`` holds each item's place in scan order, its hashes and what is known
of it; ``index`` holds the bands of its hashes (:mod:`millrace.operators.hamming`), bucketed by band and value, so a lookup
shuffles the new items' values to the buckets and never the index. Each batch that is added is a generation of its own and earlier ones
are not rewritten; a generation counts once its folder of ``done`` is there, so a batch that broke off is never seen and can be
added again. Any session that can read the folder can open the collection.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.hamming import Band, asked, first_band, keyed, plan
from millrace.plans.materialize import materialize, release


class Collection:
    """Items (id, place, hashes array<bigint>, facts) in ``path``. Places give the scan order: a later batch's should follow
    those before it; ties go by id."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        found = spark.read.parquet(f"{self.path}/bands").orderBy("number").collect()
        self.radius, self.buckets, self.bands = found[0]["radius"], found[0]["buckets"], [Band(r["start"], r["width"], r["flips"]) for r in found]

    @classmethod
    def create(cls, spark: SparkSession, path: str, radius: int, expected: int, buckets: int = 16) -> Collection:
        """An empty collection for lookups within the radius, with bands for about ``expected`` hashes; buckets
        should be as many as tasks that a generation's index is worth."""
        rows = [(k, *b, radius, buckets) for k, b in enumerate(plan(radius, expected))]
        spark.createDataFrame(rows, "number int, start int, width int, flips int, radius int, buckets int").coalesce(1).write.parquet(f"{path.rstrip('/')}/bands")
        return cls(spark, path)

    def _files(self, name: str) -> list[int]:
        """Generations of which ``name`` has a folder."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        folder = hadoop.Path(f"{self.path}/{name}")
        store = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(folder):
            return []
        return sorted(int(s.getPath().getName().split("=")[1]) for s in store.listStatus(folder) if s.getPath().getName().startswith("generation="))

    def generations(self) -> list[int]:
        return self._files("done")

    def _index(self, generation: int) -> tuple[str, str]:
        """The name of a generation's index table in this session's catalog, and where it lies."""
        at = f"{self.path}/index/generation={generation}"
        return "millrace_index_" + hashlib.sha256(at.encode()).hexdigest()[:24], at

    def _opened(self, generation: int) -> DataFrame:
        name, at = self._index(generation)
        if not self.spark.catalog.tableExists(name):
            kinds = {f.name: f.dataType.simpleString() for f in self.spark.read.parquet(f"{self.path}/items/generation={generation}").schema}
            self.spark.sql(f"CREATE TABLE {name} (id {kinds['id']}, place {kinds['place']}, y BIGINT, band INT, key BIGINT) USING parquet CLUSTERED BY (band, key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{at}'")
        return self.spark.table(name)

    def add(self, items: DataFrame, item: str = "id", place: str = "place", hashes: str = "hashes") -> int:
        """Write a batch as the next generation and return its number. Items without hashes are stored and never found."""
        n = max([-1, *self.generations()]) + 1
        items.select(F.col(item).alias("id"), F.col(place).alias("place"), F.col(hashes).alias("hashes"), *(c for c in items.columns if c not in (item, place, hashes))).write.mode("overwrite").parquet(f"{self.path}/items/generation={n}")
        each = self.spark.read.parquet(f"{self.path}/items/generation={n}").select("id", "place", F.explode("hashes").alias("y")).where("y is not null").distinct()
        name, at = self._index(n)
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        rows = keyed(each, "y", self.bands).repartition(self.buckets, "band", "key")
        rows.write.mode("overwrite").bucketBy(self.buckets, "band", "key").sortBy("key").option("path", at).saveAsTable(name)
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/done/generation={n}")
        return n

    def near(self, new: DataFrame, generation: int, item: str = "id", hashes: str = "hashes") -> DataFrame:
        """(new_id, id, place, distance) of stored items of a generation within the radius of new ones, by their nearest
        hashes."""
        rows = new.select(F.col(item).alias("new_id"), F.explode(hashes).alias("x")).where("x is not null").distinct()
        apart = F.bit_count(F.col("x").bitwiseXOR(F.col("y")))
        found = asked(rows, "x", self.bands).join(self._opened(generation), ["band", "key"]).where((apart <= self.radius) & first_band(F.col("x"), F.col("y"), self.bands))
        return found.groupBy("new_id", "id", "place").agg(F.min(apart).alias("distance"))

    def first_matches(self, new: DataFrame, accepts: Callable[[DataFrame], Column], item: str = "id", hashes: str = "hashes") -> DataFrame:
        """The first stored item, in scan order, that is acceptable for each new one: the columns of ``new`` with ``match_id``,
        ``match_place`` and ``distance``; new items without one are left out.

        ``accepts`` gets candidates (columns of ``new``, ``distance`` and a struct ``stored`` of the stored item's columns)
        and gives a boolean column. Generations are searched in their order, and new items that have found their match leave
        the search: they don't ask later generations. What is left is written after each.
        """
        waiting, kept, found = materialize(new, "waiting"), [], None
        for n in self.generations():
            stored = self.spark.read.parquet(f"{self.path}/items/generation={n}")
            pairs = self.near(waiting, n, item, hashes).withColumnRenamed("id", "_id").drop("place")
            pairs = pairs.join(stored.select(F.col("id").alias("_id"), F.struct(*stored.columns).alias("stored")), "_id")
            pairs = pairs.join(waiting, F.col("new_id") == F.col(item))
            good = pairs.where(accepts(pairs)).groupBy("new_id").agg(F.min(F.struct(F.col("stored.place").alias("p"), F.col("stored.id").alias("i"), "distance")).alias("m"))
            hit = materialize(good.select("new_id", F.col("m.i").alias("match_id"), F.col("m.p").alias("match_place"), F.col("m.distance").alias("distance")), "matches")
            kept.append(hit)
            found = hit if found is None else found.unionByName(hit)
            last, waiting = waiting, materialize(waiting.join(hit.select("new_id"), F.col(item) == F.col("new_id"), "left_anti"), "waiting")
            release(last)
            if not waiting.limit(1).count():
                break
        release(waiting)
        if found is None:
            return new.limit(0).select("*", F.lit(None).cast("bigint").alias("match_id"), F.lit(None).cast("bigint").alias("match_place"), F.lit(0).alias("distance"))
        return new.join(found, F.col(item) == F.col("new_id")).drop("new_id")
