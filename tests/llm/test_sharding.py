import zlib

import pytest
from pyspark.sql import functions as F

from lamella.llm import queries as Q
from lamella.llm.sharding import histogram_shards
from lamella.session import ship
from tests.conftest import SF


def held(frame, shards, widest):
    total = frame["size"].sum()
    by = frame.groupby("shard")["size"].sum().reindex(range(shards), fill_value=0)
    assert (abs(by - total / shards) <= widest + 0.03 * total / shards).all()
    for _, own in frame.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))


def test_query(spark):
    ship(spark)
    got = Q.op5_sharding(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas().set_index("doc_id")["text"]
    assert sorted(got["doc_id"]) == sorted(docs.index)
    for r in got.itertuples():
        raw = (docs[r.doc_id] or "").encode()
        assert r.size == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw)
    held(got, 40, got["size"].max())
    assert set(got["law"]) == {"bytes"} and got["grown_shard"].isna().all()


def test_hot_group_is_cut(spark):
    rows = [(i, "same text " * 20 if i % 3 else f"text {i} " * 20) for i in range(3000)]
    got = histogram_shards(spark.createDataFrame(rows, "doc_id long, text string"), 8).toPandas()
    held(got, 8, got["size"].max())
    again = histogram_shards(spark.createDataFrame(rows[::-1], "doc_id long, text string"), 8).toPandas()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))


def test_slots_over_many_blocks(spark, monkeypatch):
    from lamella.llm import sharding

    monkeypatch.setattr(sharding, "BLOCK_ROWS", 20)
    rows = [(i, f"text {i % 700} " * (1 + i % 5)) for i in range(3000)]
    got = histogram_shards(spark.createDataFrame(rows, "doc_id long, text string"), 6).toPandas()
    assert len(got) == 3000
    held(got, 6, got["size"].max())


@pytest.mark.parametrize("shards", [1, 5])
def test_odd_rows(spark, shards):
    rows = [(1, None), (None, "a"), (None, None), (2, ""), (3, "b" * 100_000), (4, "x"), (4, "x"), (4, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("mine")).withColumn("__k", F.lit(1))
    got = histogram_shards(df, shards).toPandas()
    assert len(got) == len(rows) and "__k" in got.columns
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    assert got[got.doc_id == 4]["shard"].nunique() == 1


def test_empty(spark):
    assert histogram_shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cuts_against_a_full_sort(spark):
    """Shards are ranges of the sorted keys; each cut is where the full running sum says, within tolerance or one row."""
    ship(spark)
    from lamella.llm.sharding import text_key

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    keys = docs.select("doc_id", text_key(F.coalesce("text", F.lit(""))).alias("k1"), F.shiftrightunsigned(F.xxhash64("doc_id"), 1).alias("k2")).toPandas()
    got = histogram_shards(docs, 40, tolerance=0.01).select("doc_id", "size", "shard").toPandas().merge(keys, on="doc_id").sort_values(["k1", "k2"])
    shard, size = got["shard"].to_numpy(), got["size"].to_numpy()
    assert (shard[1:] >= shard[:-1]).all()
    below = size.cumsum()
    for cut in range(1, 40):
        at = int((shard < cut).sum())
        bytes_below = below[at - 1] if at else 0
        near = size[max(at - 1, 0) : at + 1].max()
        assert abs(bytes_below - below[-1] * cut / 40) <= max(0.01 * below[-1] / 40, near)
