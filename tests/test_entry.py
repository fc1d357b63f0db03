"""The entry works without the optional subpackage, or without what that needs."""

import subprocess
import sys

import pytest

CODE = """
import sys
sys.modules[{missing!r}] = None  # importing it fails
import __spark_entry__ as entry
names, sqls = set(entry.queries()), set(entry.oracle_sql())
assert sqls <= names and "C1_consolidated" in names and "M20_train_and_evaluate" in names
assert not any(n.startswith("op") or n == "pipeline" for n in names)
print(len(names))
"""


@pytest.mark.parametrize("missing", ["vouchlens.llm", "public_tokenizers"])
def test_entry_without(missing):
    done = subprocess.run([sys.executable, "-c", CODE.format(missing=missing)], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) > 200


def test_library_does_not_import_the_subpackage():
    code = "import sys\nfor m in __import__('__spark_entry__').SUITES: __import__(m)\nassert not any(m.startswith('vouchlens.llm') for m in sys.modules)"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
