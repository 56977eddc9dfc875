import os
import tempfile

from faresight.cli import main


def test_cli_end_to_end(spark, sample_df, capsys):
    d = tempfile.mkdtemp(prefix="faresight-cli-")
    sample_df.drop("rid").write.option("header", True).csv(os.path.join(d, "raw"))
    assert main(["inspect", "--input", f"{d}/raw", "--output", f"{d}/inspect"]) == 0
    assert main(["build-parquet", "--input", f"{d}/raw", "--output", f"{d}/clean", "--report", f"{d}/rep"]) == 0
    assert spark.read.parquet(f"{d}/clean").count() == 200
    assert main(["build-features", "--input", f"{d}/clean", "--output", f"{d}/feat"]) == 0
    assert "Carrier_target_enc" in spark.read.parquet(f"{d}/feat").columns
    for m in ["global_mean", "ridge"]:
        assert main(["train", "--input", f"{d}/clean", "--output", f"{d}/models", "--model", m]) == 0
    capsys.readouterr()
    assert main(["compare", "--models-dir", f"{d}/models"]) == 0
    out = capsys.readouterr().out
    assert "ridge" in out and "global_mean" in out
    assert main(["explain", "--models-dir", f"{d}/models", "--top", "3"]) == 0
    assert main(["revenue-sim", "--input", f"{d}/clean", "--output", f"{d}/rev"]) == 0
    assert main(["export", "--input", f"{d}/clean", "--output", f"{d}/exp", "--models-dir", f"{d}/models",
                 "--scenarios", f"{d}/rev/scenarios"]) == 0
    assert len(os.listdir(f"{d}/exp")) == 3
