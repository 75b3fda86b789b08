"""Queries with Python code run where the workers do not have the package."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import functions as F
from ledgerlens.session import build_session
spark = build_session("local[4]", shuffle_partitions=4)
try:
    spark.range(1).mapInPandas(lambda b: (x for x in b if __import__("ledgerlens")), "id long").collect()
    print("WORKERS HAVE IT")
except Exception:
    pass
from ledgerlens.llm.queries import REGISTRY
for name in {names!r}:
    print(name, REGISTRY[name][0](spark, "/root/testdata/sf0.001").count(), flush=True)
"""
NAMES = ["op1_toxicity", "op2_chat_format", "op3_chunk_dedup", "op5_pack", "op6_language_id", "op7_decontaminate", "op9_quality",
         "op12_line_quality", "op13_repair"]


def test_workers_need_not_have_the_package():
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    if "PYTHONPATH" in os.environ:  # what else is there stays, the package does not
        env["PYTHONPATH"] = os.pathsep.join(p for p in os.environ["PYTHONPATH"].split(os.pathsep) if p and not os.path.isdir(os.path.join(p, "ledgerlens")))
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT, names=NAMES)], cwd=tempfile.mkdtemp(prefix="ll-else-"),
                         env=env, capture_output=True, text=True, timeout=600)
    assert "WORKERS HAVE IT" not in out.stdout
    assert [line.split()[0] for line in out.stdout.splitlines() if line.startswith("op")] == NAMES, out.stderr[-3000:]
