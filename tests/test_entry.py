import subprocess
import sys
from pathlib import Path

import lexspan.queries as core

ROOT = Path(__file__).resolve().parent.parent


def test_each_sql_has_a_query():
    assert set(core.oracle_sql()) <= set(core.queries()) and len(core.queries()) >= 50


def test_entry_works_without_the_subpackage():
    code = "import sys; sys.modules['lexspan.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nassert set(e.queries()) == set(e.core.queries()) and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "lexspan").rglob("*.py"):
        if "llm" not in path.parts:
            assert "lexspan.llm" not in path.read_text()


def test_no_name_is_defined_twice_in_a_module():
    import ast
    from pathlib import Path

    top = Path(__file__).resolve().parent.parent
    for path in [*top.glob("*.py"), *top.glob("lexspan/**/*.py")]:
        names = [x.name for x in ast.parse(path.read_text()).body if isinstance(x, (ast.FunctionDef, ast.ClassDef)) and x.name != "_"]
        assert len(names) == len(set(names)), path
