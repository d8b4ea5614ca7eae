"""The command line and the profiler."""

import json

import pytest

from progdf import __main__ as cli
from progdf.functions.profile import Profiler


def test_regions_nest_and_mismatches_are_told(spark):
    p = Profiler()
    with p.region("outer"):
        with p.region("inner"):
            pass
        p.end("never")
    p.start("a")
    p.start("b")
    p.end("a")
    assert [(r[0], r[1], r[2]) for r in p.rows] == [("inner", 1, "ok"), ("outer", 0, "ok"), ("b", 1, "failed"), ("a", 0, "ok")]
    assert len(p.diagnostics) == 2 and p.records(spark).count() == 4


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "m.py").write_text("def f(x):\n    return x if x else f(1)\nf(2)\n")
    assert cli.main(["all", str(tmp_path)]) == 0
    out = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert out["codes"] == 2 and out["cfg"] > 0 and {p["phase"] for p in out["profiling"]} == {"load", "analyze"}
    assert cli.main(["cfg", str(tmp_path / "none"), "--no-profile"]) == 1
    with pytest.raises(SystemExit) as e:
        cli.main(["nothing"])
    assert e.value.code == 2
