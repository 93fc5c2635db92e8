import importlib.util
import os
import subprocess
import sys

import __spark_entry__ as entry

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_query_has_a_name_and_sql_names_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100


def test_llm_subpackage_is_not_imported_by_the_rest():
    code = "import sys\nsys.modules['terrafold.llm'] = None\nimport __spark_entry__ as e\nassert len(e.queries()) > 90 and not any(n.startswith('terrafold.llm.') for n in sys.modules)"
    subprocess.run([sys.executable, "-c", code], cwd=HERE, check=True)
    for at, _, names in os.walk(os.path.join(HERE, "terrafold")):
        for n in names:
            if n.endswith(".py") and os.sep + "llm" not in at:
                with open(os.path.join(at, n)) as f:
                    assert "terrafold.llm" not in f.read()


def test_flagship(spark, data):
    assert entry.entry(spark).count() > 0


def test_llm_queries_are_there_with_the_subpackage():
    has = importlib.util.find_spec("terrafold.llm") is not None
    assert ("p7_found" in entry.queries()) == has
