"""The files of ``incremental_ingest``: a scan of enough parts is written without a shuffle."""
from faresight.plans import registry as R

SF = "/root/testdata/sf0.001"


def test_a_scan_of_enough_parts_is_not_shuffled(spark, monkeypatch):
    wrote, write = [], R.FS.write_csv
    m = R.market(spark, SF)

    def watched(df, path, **how):
        wrote.append(df)
        return write(df, path, **how)

    monkeypatch.setattr(R.FS, "write_csv", watched)
    for parts, shuffled in ((7, False), (2, True)):
        rows = m.coalesce(1) if shuffled else m.repartition(parts)
        monkeypatch.setattr(R, "market", lambda spark, sf, rows=rows: rows)
        assert R.QUERIES["incremental_ingest"](spark, SF).count() == m.count()
        assert (wrote[-1] is not rows) == shuffled and wrote[-1].rdd.getNumPartitions() == (6 if shuffled else 7)
