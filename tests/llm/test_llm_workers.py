from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]

RUN = """
import sys
sys.path.insert(0, {repo!r})
from farol.session import local_session
from farol.llm import queries
spark = local_session(cores=4, **{{"spark.checkpoint.dir": {shared!r}, "spark.ui.showConsoleProgress": "false"}})

def importable(batches):
    import importlib.util
    for batch in batches:
        yield batch.assign(found=importlib.util.find_spec("farol") is not None)

assert not spark.range(1).mapInPandas(importable, "id long, found boolean").first()["found"]
for name, job in queries.QUERIES.items():
    print(name, job(spark, "/root/testdata/sf0.001").count())
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    """All queries run with the package on the driver's path alone."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", RUN.format(repo=str(REPO), shared=str(tmp_path / "shared"))], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-3000:]
    assert len([line for line in done.stdout.splitlines() if line.startswith("op")]) == 13
