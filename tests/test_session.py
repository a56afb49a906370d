"""Size-checked broadcast and materialization helpers."""

from tidecast.session import materialize, sized_broadcast


def _is_broadcast(df):
    return "broadcast" in df._jdf.queryExecution().logical().toString().lower()


def test_sized_broadcast_respects_bound(spark):
    df = spark.range(100)
    assert _is_broadcast(sized_broadcast(df, max_rows=1000))
    big = sized_broadcast(df, max_rows=10)
    assert not _is_broadcast(big)
    assert big.count() == 100


def test_materialize_roundtrip(spark):
    df = spark.range(50).selectExpr("id", "id * 2 AS v")
    m = materialize(df)
    assert sorted(tuple(r) for r in m.collect()) == sorted(tuple(r) for r in df.collect())
    assert [(f.name, f.dataType) for f in m.schema] == [(f.name, f.dataType) for f in df.schema]  # parquet re-reads as nullable
