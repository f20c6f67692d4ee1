"""The command line: each command once, and crashes that kill the process."""

import subprocess
import sys
from pathlib import Path

import pytest

from chronotier import cli
from chronotier.engine import Engine

ROOT = Path(__file__).resolve().parents[1]


def test_commands_in_turn(spark, tmp_path, capsys):
    root = str(tmp_path / "e")
    said = lambda: capsys.readouterr().out
    cli.write(spark, root, 60)
    assert "wrote 60 points" in said()
    Engine(spark, root).flush()
    cli.write(spark, root, 60)
    Engine(spark, root).flush()
    cli.consolidate(spark, root)
    assert "source_blocks=2, target_blocks=1, rows=120" in said()
    cli.bench(spark, root)
    assert "points=120" in said()
    cli.compact(spark, root)
    cli.compact_rollup(spark, root, 1)
    assert said().count("ran=True") == 2
    cli.query(spark, root, 0, 1 << 60, ["metric=cpu"])
    assert "level=2  scanned=1  skipped=0" in said()
    cli.recover(spark, root)
    assert "l2_blocks=1" in said()
    cli.vacuum(spark, root, 0)
    assert "deleted" in said() and Engine(spark, root).scan(2).count() == 5


def test_benches_run(spark, tmp_path, capsys):
    cli.cardbench(spark, str(tmp_path), [50])
    cli.indexbench(spark, str(tmp_path), 500)
    cli.query_bench(spark, str(tmp_path))
    out = capsys.readouterr().out
    assert "50 label sets" in out and "prefix: 111 hits" in out
    assert all(x in out for x in ("scanned 1, skipped 99", "scanned 3, skipped 97", "scanned 90, skipped 10"))


def test_usage():
    for argv in ([], ["write"], ["nonsense", "dir"]):
        with pytest.raises(SystemExit):
            cli.main(argv)


@pytest.mark.parametrize(("point", "levels"), [("post_l0_write_pre_manifest", [0, 0, 0]), ("post_manifest_pre_wal_unlink", [1, 0, 0]), ("post_rollup_manifest_rename_pre_source_delete_L2", [0, 0, 1])])
def test_a_killed_process_loses_and_repeats_nothing(spark, tmp_path, capsys, point, levels):
    root = str(tmp_path / "e")
    done = subprocess.run([sys.executable, "-m", "chronotier.cli", "crashtest", root, point], cwd=ROOT, capture_output=True, timeout=300)
    assert done.returncode == -9
    cli.recover(spark, root)
    e = Engine(spark, root)
    m = e.manifest
    assert [len(m.level(n)) for n in range(3)] == levels
    if levels[2]:
        assert e.scan(2).agg({"count": "sum"}).first()[0] == 100
    else:
        assert e.query(["metric=cpu"], 0, 1 << 60).count() == 100
