"""bench.py prints one JSON line with the fields the driver records."""

import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_CPUS="2", BENCH_REPEAT="1",
               BENCH_WARMUP_DIR="", BENCH_DRIVER_MEMORY="2g")
    out = subprocess.run([sys.executable, f"{ROOT}/bench.py", "volume_trend", "bounce_rate"],
                         capture_output=True, text=True, env=env, timeout=600, cwd="/tmp")
    assert out.returncode == 0, out.stderr[-2000:]
    lines = [ln for ln in out.stdout.splitlines() if ln.strip()]
    assert len(lines) == 1
    d = json.loads(lines[0])
    assert d["unit"] == "sec" and d["sf"] == 0.001 and isinstance(d["metric"], str)
    assert set(d["queries"]) == {"volume_trend", "bounce_rate"}
    assert abs(d["value"] - d["fixture_build_sec"] - sum(d["queries"].values())) < 0.002
