"""The entry module without the optional operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_without_the_optional_part():
    code = (
        "import sys; sys.modules['postlake.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e\n"
        "from postlake.plans.queries import QUERIES\n"
        "assert set(e.queries()) == set(QUERIES) == set(e.oracle_sql())\n"
    )
    subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, check=True, timeout=120)
