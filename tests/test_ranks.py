from pyspark.sql import functions as F

from lumenloom.operators.ranks import with_rank


def test_places(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 1000 != 7, F.pmod(F.xxhash64("id"), F.lit(10**12)).cast("string")).alias("k"), "id").repartition(7)
    got = with_rank(rows, [F.col("k").asc_nulls_last(), F.col("id")], "place").collect()
    want = sorted(((r.k is None, r.k or "", r.id) for r in rows.collect()))
    assert [r.id for r in sorted(got, key=lambda r: r.place)] == [i for _, _, i in want]
    assert sorted(r.place for r in got) == list(range(1, 5001))
    assert with_rank(rows.limit(0), ["k"], "place").columns == ["k", "id", "place"]


def test_compiled(spark):
    """The other tests go without generated code; with it the same rows come out."""
    import __spark_entry__

    compiled = spark.newSession()
    for name, value in {"spark.sql.codegen.wholeStage": "true", "spark.sql.codegen.factoryMode": "CODEGEN_ONLY", "spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": "2"}.items():
        compiled.conf.set(name, value)
    for name in ("derive_stops", "xmltv_timestamps", "select_globs", "label_vote", "turkish_dates", "redact_url", "published_order"):
        query = __spark_entry__.queries()[name]
        a, b = (sorted(map(str, query(s, "/root/testdata/sf0.001").collect())) for s in (spark, compiled))
        assert a == b and a, name
