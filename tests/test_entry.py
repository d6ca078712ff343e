"""The library's queries are there with and without the text operators."""

import subprocess
import sys

import __spark_entry__ as spark_entry


def test_own_queries_are_registered():
    assert set(spark_entry._QUERIES) <= set(spark_entry.queries())
    assert set(spark_entry.statements()) <= set(spark_entry.oracle_sql())


def test_import_without_the_text_operators():
    code = (
        "import sys; sys.modules['anchorwake.llm'] = None; import __spark_entry__ as e; "
        "assert set(e.queries()) == set(e._QUERIES); assert set(e.oracle_sql()) == set(e.statements())"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=spark_entry.__file__.rpartition("/")[0], timeout=120)


def test_other_import_errors_are_raised():
    code = (
        "import sys, __spark_entry__ as e; sys.modules['numpy'] = None\n"
        "try:\n    e.queries()\nexcept ModuleNotFoundError as x:\n    assert x.name == 'numpy', x\n"
        "else:\n    import importlib.util as u; assert u.find_spec('anchorwake.llm') is None"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=spark_entry.__file__.rpartition("/")[0], timeout=120)
