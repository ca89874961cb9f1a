"""Sites, cached results, entity layout and samples."""

import os
import time

import pytest
from pyspark.sql import functions as F

from chronoward.sources import layout


def test_sites(spark, tmp_path):
    root = str(tmp_path / "all sites")
    for site, cols in (("b+c", ["id"]), ("a b", ["id", "x"]), ("_pooled", ["id"]), (".git", ["id"]), ("docs", ["id"])):
        spark.range(3).withColumn("x", F.lit(1.5)).select(*cols).write.parquet(f"{root}/{site}/t.parquet")
    os.makedirs(f"{root}/empty/deeper")
    (tmp_path / "all sites" / "note.txt").write_text("no site")
    spark.range(2).write.parquet(f"{root}/other/u.parquet")
    assert layout.site_folders(spark, root, ["docs"]) == ["a b", "b+c", "other"]
    got = layout.stacked_sites(spark, root, "t.parquet", ["docs"])
    assert sorted(map(tuple, got.select("site", "id", "x").collect()), key=str) == sorted([("a b", i, 1.5) for i in range(3)] + [("b+c", i, None) for i in range(3)], key=str)
    for site, text in (("a b", "k,n\np,1\n"), ("b+c", "k,m\nq,2\n")):
        with open(f"{root}/{site}/s.csv", "w") as f:
            f.write(text)
    assert sorted(map(tuple, layout.stacked_sites(spark, root, "s.csv").select("site", "k", "n", "m").collect())) == [("a b", "p", 1, None), ("b+c", "q", None, 2)]
    assert layout.site_folders(spark, root + "/nowhere") == []
    with pytest.raises(FileNotFoundError):
        layout.stacked_sites(spark, root, "nothing.parquet")


def test_cached_results(spark, tmp_path):
    source, path, made = str(tmp_path / "in"), str(tmp_path / "out"), []
    spark.range(5).write.parquet(source)

    def make():
        made.append(1)
        return spark.read.parquet(source).where("id > 0")

    def get(mode="cached", version="1"):
        return layout.result(spark, path, make, [spark.read.parquet(source)], version, mode).count()

    assert (get(), get(), len(made)) == (4, 4, 1)  # made once
    assert (get("fresh"), len(made)) == (4, 2)
    assert (get(version="2"), len(made)) == (4, 3)  # other code
    assert (get(version="2"), len(made)) == (4, 3)
    time.sleep(0.01)
    spark.range(10, 12).write.mode("append").parquet(source)
    assert (get(version="2"), len(made)) == (6, 4)  # other input
    assert len([n for n in os.listdir(path) if not n.startswith(".")]) == 1  # older results are gone
    with pytest.raises(RuntimeError):
        layout.result(spark, path, lambda: (_ for _ in ()).throw(RuntimeError("no")), [spark.read.parquet(source)], "3")
    assert get(version="2") == 6 and len(made) == 4  # a failed run leaves the result as it was
    spark.range(3).write.parquet(str(tmp_path / "given"))
    assert layout.result(spark, str(tmp_path / "given"), make, mode="external").count() == 3 and len(made) == 4
    with pytest.raises(ValueError):
        layout.result(spark, path, make, mode="other")


def test_entity_layout(spark, sf_dir, tmp_path):
    """Joins of a chain on the entity without an exchange; a read of one entity opens one bucket of sixteen."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    spark.sql("CREATE DATABASE IF NOT EXISTS laid_out")
    names = ["laid_out.events", "laid_out.users", "laid_out.last"]
    try:
        tables = [
            layout.write_by_entity(events, names[0], "user_id", ["ts"], 16, str(tmp_path / "e")),
            layout.write_by_entity(events.groupBy("user_id").agg(F.count("*").alias("n")), names[1], "user_id", [], 16, str(tmp_path / "u")),
            layout.write_by_entity(events.groupBy("user_id").agg(F.max("ts").alias("last")), names[2], "user_id", [], 16, str(tmp_path / "l")),
        ]
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        chain = tables[0].join(tables[1], "user_id", "left").join(tables[2], "user_id", "left").groupBy("user_id").agg(F.count("*").alias("rows"), F.max("n").alias("n"))
        assert "Exchange" not in chain._jdf.queryExecution().executedPlan().toString()
        assert chain.where("rows <> n").count() == 0 and chain.count() == events.select("user_id").distinct().count()
        one = tables[0].where("user_id = 7")
        files = lambda df: sum(len(p.files()) for p in df._jdf.queryExecution().toRdd().partitions())
        assert files(tables[0]) >= 10 and files(one) == 1  # of 16, some empty
        reader = layout.EntityReader(tables[0], "user_id", keep=2)
        assert len(reader.rows(7)) == events.where("user_id = 7").count()
        for user in (7, 8, 7, 9, 7, 8):
            reader.rows(user)
        assert reader.reads == 4  # 7, 8, 9, and 8 again: the one that was used least lately had gone
        with pytest.raises(ValueError):
            layout.EntityReader(tables[0], "user_id", most_rows=2).rows(7)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for n in names:
            spark.sql(f"DROP TABLE IF EXISTS {n}")
        spark.sql("DROP DATABASE IF EXISTS laid_out")


def test_samples(spark):
    df = spark.range(5000).withColumn("who", F.col("id") % 100)
    a, b = (sorted(r[0] for r in layout.sampled(df.repartition(n), ["id"], rows=50).select("id").collect()) for n in (3, 7))
    assert a == b and len(a) == 50
    some = layout.sampled(df, ["who"], share=0.2)
    who = {r[0] for r in some.select("who").distinct().collect()}
    assert 8 <= len(who) <= 35 and some.count() == 50 * len(who)
    assert "Exchange" not in some._jdf.queryExecution().executedPlan().toString()
    assert layout.sampled(df, ["who"], share=1.0).count() == 5000 and layout.sampled(df, ["who"], share=0.0).count() == 0
