"""Stars read from a database, here an embedded one."""

from pyspark.sql import functions as F

from starloom.operators.stars import bright_stars
from starloom.sources import remote


def test_stars_are_filtered_in_the_database_and_read_in_ranges(spark, capsys):
    url = "jdbc:derby:memory:stars;create=true"
    stars = spark.range(500).select((F.col("id") * 1000003).alias("source_id"), (F.col("id") % 360).cast("double").alias("ra"), (F.col("id") % 170 - 85).cast("double").alias("dec"), (F.col("id") % 13 + 7).cast("double").alias("phot_g_mean_mag"), (F.col("id") % 61 - 30).cast("double").alias("b"), F.lit(1.0).alias("parallax"))
    how = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    stars.write.format("jdbc").options(url=url, dbtable="stars", **how).mode("overwrite").save()
    for more in ({}, {"ra": (10.0, 50.0), "dec": (-20.0, None)}):
        got = remote.remote_stars(spark, url, "stars", 12.0, 10.0, partitions=6, **more, **how)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, bright_stars(stars, 12.0, 10.0, **more).collect())) != []
    assert got.rdd.getNumPartitions() == 6
    got.explain("formatted")
    plan = capsys.readouterr().out
    pushed = next(x for x in plan.splitlines() if "PushedFilters" in x)
    assert "phot_g_mean_mag" in pushed and "Or(" in pushed.replace("Or[", "Or(") and "ra" in pushed
    assert "parallax" not in plan
    stars.limit(1).write.format("jdbc").options(url=url, dbtable="few", **how).mode("overwrite").save()
    assert remote.star_table(spark, url, "few", **how).count() == 1
    stars.limit(0).write.format("jdbc").options(url=url, dbtable="void", **how).mode("overwrite").save()
    assert remote.remote_stars(spark, url, "void", **how).count() == 0
