import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def names(*blocked):
    """Registered queries in a fresh interpreter where some modules cannot be imported."""
    code = "import sys\nfor m in sys.argv[1:]: sys.modules[m] = None\nimport __spark_entry__ as e\nprint('NAMES', *e.queries()); e.oracle_sql()"
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", code, *blocked], cwd=ROOT, capture_output=True, text=True, check=True)
    return set(done.stdout.rpartition("NAMES")[2].split())


def test_core_queries_need_no_optional_part():
    core = {n for n in names() if n != "pipeline" and not (n.startswith("op") and n[2:3].isdigit())}
    for blocked in ("xxhash", "larkspur.llm", "corpus_pipeline"):
        assert names(blocked) == core and len(core) > 100
