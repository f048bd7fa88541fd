"""bench.py prints one JSON line with the fields the driver reads."""

from __future__ import annotations

import json
import os
import subprocess
import sys

import pytest

from .conftest import TESTDATA

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.skipif(not os.path.exists(f"{TESTDATA}/sf0.001"), reason="driver data absent")
def test_bench_prints_one_json_line():
    env = {**os.environ, "BENCH_SF_DIR": f"{TESTDATA}/sf0.001", "BENCH_CPUS": "2", "BENCH_RUNS": "1"}
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py"), "monthly_growth", "dim_category"],
                         env=env, capture_output=True, text=True, timeout=600, check=True).stdout
    lines = [line for line in out.splitlines() if line.strip()]
    assert len(lines) == 1
    result = json.loads(lines[0])
    assert {"metric", "value", "unit", "queries", "sf"} <= set(result)
    assert result["unit"] == "sec" and set(result["queries"]) == {"monthly_growth", "dim_category"}
    assert result["sf"] == 0.001 and "errors" not in result
