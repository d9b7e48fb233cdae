import json
import subprocess
import sys
from pathlib import Path

import pytest

from tessera import __main__ as cli

ROOT = Path(__file__).resolve().parent.parent


def test_profile(capsys):
    cli.main(["profile", "fast", "--set", "sample_every=9.5", "--tuned"])
    got = json.loads(capsys.readouterr().out)
    assert got["sample_every"] == 9.5 and got["eps"] == 0.40 and got["profile"] == "fast"


def test_modes(spark, tmp_path):
    ids = spark.createDataFrame([("A", False), ("b", False)], "label string, locked boolean")
    ids.write.parquet(str(tmp_path / "ids"))
    run = lambda *a: cli.result(cli.parser().parse_args(list(a)), spark)
    got = run("identity", "lock", "--source", "B", "--identities", str(tmp_path / "ids"))
    assert {(r["label"], r["locked"]) for r in got.collect()} == {("A", False), ("b", True)}
    with pytest.raises(SystemExit):
        run("identity", "merge", "--source", "B", "--identities", str(tmp_path / "ids"))
    rows = [("a", 1, "s", 10.0, 1, 1, 1.0, [0]), ("b", 1, "s", 10.0, 2, 1, 1.0, [0])]
    spark.createDataFrame(rows, "path string, size bigint, sha1 string, duration double, width int, height int, bitrate double, phash array<bigint>").write.parquet(str(tmp_path / "media"))
    assert {r["primary_path"] for r in run("duplicates", "--media", str(tmp_path / "media")).collect()} == {"b"}


def test_runtime_from_a_shell():
    out = subprocess.run([sys.executable, "-m", "tessera", "runtime"], cwd=ROOT, capture_output=True, text=True, check=True, timeout=120).stdout
    assert "pyspark" in json.loads(out)
