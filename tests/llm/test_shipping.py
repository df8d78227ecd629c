import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
PROGRAM = """
import sys
sys.path.insert(0, {root!r})
from tidecast.session import local_session
from tidecast.llm import queries
spark = local_session(2, "elsewhere")
print("rows", queries.op6_bpe(spark, "/root/testdata/sf0.001").count())
"""


def test_executors_need_no_copy_of_the_package(tmp_path):
    """A driver that alone can import the package, from its search path."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    program = PROGRAM.format(root=str(ROOT))
    out = subprocess.run(
        [sys.executable, "-c", program], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180
    )
    assert "rows 200" in out.stdout, out.stderr[-2000:]
