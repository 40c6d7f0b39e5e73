import time
from pathlib import Path

from wayfare.schemas import WEIGHT
from wayfare.session import clear_scratch, ensure_utc, materialize, release, scratch_path, shared_dir


def test_configured_folder_is_used(spark, tmp_path, monkeypatch):
    # The setting belongs to the launch of a session and cannot be changed in a running one.
    settings = type(spark.conf)
    plain = settings.get

    def get(self, key, *default):
        return str(tmp_path) if key == "spark.checkpoint.dir" else plain(self, key, *default)

    monkeypatch.setattr(settings, "get", get)
    assert shared_dir(spark) == str(tmp_path)
    own = f"{tmp_path}/scratch-{spark.sparkContext.applicationId}"
    assert scratch_path(spark, "x").startswith(f"{own}/x-")
    kept = materialize(spark.createDataFrame([("a", "1")], WEIGHT), "weights")
    assert [tuple(r) for r in kept.collect()] == [("a", "1")]
    assert list(tmp_path.glob("scratch-*/weights-*/*.parquet"))
    clear_scratch(spark)
    assert not list(tmp_path.glob("scratch-*"))


def test_folder_is_chosen_once_where_none_is_set(spark):
    assert shared_dir(spark) == shared_dir(spark)


def test_utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    ensure_utc(spark)
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"


def test_a_written_table_leaves_no_shuffle_files(spark):
    """They would stay on disk until the driver happens to collect garbage."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        names = {b.name() for b in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(blocks.getAllBlocks())}
        return {n for n in names if n.startswith("shuffle")}

    before = shuffled()
    sums = spark.range(10_000).selectExpr("id % 100 as k", "id as v").groupBy("k").sum("v")
    assert sums.count() == 100
    counted = shuffled() - before
    assert counted
    kept = materialize(sums, "sums")
    end = time.time() + 20
    while shuffled() - before - counted and time.time() < end:
        time.sleep(0.2)
    assert not shuffled() - before - counted
    assert kept.count() == 100


def test_release_deletes_the_table(spark):
    kept = materialize(spark.range(3), "kept")
    assert kept.count() == 3
    release(kept)
    assert not Path(kept._scratch).exists()
