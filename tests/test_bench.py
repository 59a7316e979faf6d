"""bench.py prints exactly one JSON line with the expected fields."""

import json
import os
import subprocess
import sys

from fixture_paths import ROOT, SF0001


def test_bench_json_line():
    env = dict(os.environ, BENCH_SF_DIR=SF0001, BENCH_CPUS="2")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py"), "hourly_mean_pivot", "gap_report"],
                         capture_output=True, text=True, env=env, timeout=600)
    lines = [ln for ln in out.stdout.splitlines() if ln.strip()]
    assert len(lines) == 1, out.stdout + out.stderr
    rec = json.loads(lines[0])
    assert rec["unit"] == "sec" and rec["sf"] == "0.001" and set(rec["queries"]) == {"hourly_mean_pivot", "gap_report"}
    assert rec["value"] >= 0
