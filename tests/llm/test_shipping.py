"""Every query of the subpackage must run where the executors have no copy of the package."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as E
from funnelwise import build_session
spark = build_session("local[4]", shuffle_partitions=4)
bad = spark.sparkContext.parallelize([0], 1).map(lambda _: __import__("importlib").util.find_spec("funnelwise") is not None).collect()
assert bad == [False], "the workers can import the package, so this test shows nothing"
for name, query in E.LLM_QUERIES.items():
    query(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    print("ran", name, flush=True)
"""


def test_queries_run_without_the_package_on_the_workers(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = tmp_path / "run.py"
    script.write_text(SCRIPT)
    out = subprocess.run([sys.executable, str(script), ROOT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert out.returncode == 0, out.stderr[-3000:]
    ran = [line.split()[1] for line in out.stdout.splitlines() if line.startswith("ran ")]
    assert len(ran) == 14 and "pipeline" in ran
