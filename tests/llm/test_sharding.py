from glyphaudit.llm import sharding


def test_growth_moves_rows_only_into_the_new_shard(docs_of):
    rows = sharding.shard(docs_of([(i, "ä" * (i % 7)) for i in range(4000)], extra=True)).collect()
    assert all(r["grown_shard"] in (r["shard"], 8) for r in rows)
    assert 300 < sum(r["grown_shard"] == 8 for r in rows) < 600
    for s in range(8):
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own))) and 350 < len(own) < 650
    assert all(r["size"] == 2 * (r["doc_id"] % 7) + 1 for r in rows)


def test_nulls_repeats_and_empty(docs_of):
    rows = sharding.shard(docs_of([(None, None), (None, None), (1, "x"), (1, "x"), (1, None)])).collect()
    assert len(rows) == 5 and all(r["size"] == 1 and r["text_crc32"] == 0 for r in rows if r["doc_id"] is None)
    assert len({(r["shard"], r["slot"]) for r in rows}) == 5
    assert len({r["shard"] for r in rows if r["doc_id"] == 1}) == 1
    assert sharding.shard(docs_of([])).count() == 0


def test_weights_confine_movement(spark):
    from pyspark.sql import functions as F

    a, b = sharding.tree(8), sharding.tree(8, {5: 2.0})
    key = F.col("id").cast("string")
    rows = spark.range(4000).select(sharding.place(key, a).alias("a"), sharding.place(key, b).alias("b")).collect()
    moved = [r for r in rows if r["a"] != r["b"]]
    assert moved and all(r["b"] // 4 == 1 for r in moved)


def test_weight_zero_drains_a_shard(spark):
    import pytest
    from pyspark.sql import functions as F

    key = F.col("id").cast("string")
    a, b = sharding.tree(8), sharding.tree(8, {5: 0.0, 4: 0.0})
    rows = spark.range(3000).select(sharding.place(key, a).alias("a"), sharding.place(key, b).alias("b")).collect()
    assert {r["b"] for r in rows} == {0, 1, 2, 3, 6, 7}
    # The rack that lost its weight sends its documents away; the other region only gains.
    assert all(r["b"] == r["a"] for r in rows if r["a"] < 4)
    for wrong in ({s: 0.0 for s in range(8)}, {1: -1.0}):
        with pytest.raises(ValueError):
            sharding.tree(8, wrong)


def test_like_sql(docs_of, same_as_sql):
    texts = [(i % 50, f"text {i} ä" * (i % 4)) for i in range(300)] + [(None, None), (None, "x"), (None, "x"), (-5, ""), (1 << 62, "y" * 3000)]
    same_as_sql(sharding.shard(docs_of(texts)), sharding.sql(), texts)


def test_rows_without_an_id_are_dealt_over_all_buckets(docs_of):
    rows = sharding.shard(docs_of([(None, f"t {i}") for i in range(400)])).collect()
    assert len({r["shard"] for r in rows}) == 1 and len({r["bucket"] for r in rows}) > 200
    assert sorted(r["slot"] for r in rows) == list(range(400))
