"""Task failures (recomputation) do not change results: the flagship pipeline with an injected failure on the
first attempt of a partition in every stage equals the undisturbed run."""

import json
import os
import subprocess
import sys

from tests.conftest import SF_SMALL

HERE = os.path.dirname(os.path.abspath(__file__))


def _run(*extra):
    out = subprocess.run(
        [sys.executable, os.path.join(HERE, "retry_run.py"), SF_SMALL, *extra],
        capture_output=True, text=True, timeout=900,
    )
    assert out.returncode == 0, out.stderr[-2000:]
    return json.loads(out.stdout.strip().splitlines()[-1])


def test_results_survive_task_retries():
    clean = _run()
    flaky = _run("--fail")
    assert clean == flaky
    assert clean["acc"] == [888, 5.968468, 23.423423, 47.072072]
