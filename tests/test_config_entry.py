from faresight.schema import CHUNK_SIZE, MEMORY_LIMIT_GB, SEED, SPLIT_RATIOS, TARGET, Settings


def test_defaults():
    s = Settings()
    assert s.target == TARGET == "Average_Fare"
    assert s.memory_limit_gb == MEMORY_LIMIT_GB == 5.0
    assert s.seed == SEED == 42
    assert abs(sum(SPLIT_RATIOS) - 1.0) < 1e-9
    assert CHUNK_SIZE == 100_000


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    qs, ora = E.queries(), E.oracle_sql()
    assert set(ora) <= set(qs)
    df = E.entry(spark)
    assert df.count() > 0
    assert "Carrier_target_enc" in df.columns


def test_sizing_conf():
    from faresight.session import sizing_conf
    c = sizing_conf(100 * 1024 ** 4, 8000)
    assert int(c["spark.sql.shuffle.partitions"]) == 819200
    assert sizing_conf(10 * 1024 ** 2, 8)["spark.sql.shuffle.partitions"] == "16"
