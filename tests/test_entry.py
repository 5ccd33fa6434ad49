import importlib.util
import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p3_found", "p5_found", "p6_found"} <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(importlib.util.find_spec("millrace.llm") is None, reason="the subpackage is not here")
def test_nothing_else_imports_the_text_subpackage():
    code = "import sys; sys.modules['millrace.llm'] = None; import importlib, pkgutil, millrace; [importlib.import_module(m.name) for m in pkgutil.walk_packages(millrace.__path__, 'millrace.') if not m.name.startswith('millrace.llm')]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(entry.__file__))
