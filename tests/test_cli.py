import pytest

from ridgeline.__main__ import main


def test_commands(spark, sf_dir, tmp_path, capsys):
    assert main(["list"]) == 0 and "composite" in capsys.readouterr().out
    assert main(["show", "status_counts", sf_dir, "--top", "9"]) == 0 and "candidate" in capsys.readouterr().out
    assert main(["write", "status_counts", sf_dir, str(tmp_path / "out"), "--csv"]) == 0
    assert main(["write", "stage_timing", sf_dir, str(tmp_path / "p")]) == 0 and spark.read.parquet(str(tmp_path / "p")).count() > 0
    with pytest.raises(SystemExit):
        main(["show", "nothing", sf_dir])
