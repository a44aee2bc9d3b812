"""The catalogue when optional parts, or libraries that they need, are not there."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
COUNT = "import sys; sys.modules[{0!r}] = None; import __spark_entry__ as e; q = e.queries(); print(len([n for n in q if not n.startswith('op')]), len(e.oracle_sql()))"


@pytest.mark.parametrize("missing", ["zstandard", "tokenizers", "public_tokenizers", "ledgerlab.llm", "corpus_pipeline"])
def test_the_library_stands_without_optional_parts(missing):
    def counts(name):
        out = subprocess.run([sys.executable, "-c", COUNT.format(name)], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
        return int(out[0]), int(out[1])

    own, checks = counts(missing)
    every, all_checks = counts("no_such_module")
    # The pipeline is the only query of the optional parts whose name is no operator's.
    assert own in (every, every - 1) and own > 100 and checks > 100 and checks <= all_checks
