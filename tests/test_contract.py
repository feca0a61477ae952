import subprocess
import sys
from pathlib import Path


def test_the_rest_works_without_the_text_folders(tmp_path):
    """The entry module imports, and keeps the other queries, where the optional folders are gone."""
    root = Path(__file__).parent.parent
    for p in root.iterdir():
        if p.name in ("corpus_pipeline.py", ".git", "tests"):
            continue
        if p.name == "sightline":
            (tmp_path / "sightline").mkdir()
            for q in p.iterdir():
                if q.name != "llm":
                    (tmp_path / "sightline" / q.name).symlink_to(q)
        else:
            (tmp_path / p.name).symlink_to(p)
    code = "import sys; sys.path[0] = '.'; import __spark_entry__ as e; q = e.queries(); assert 'coverage_union' in q and not any(k.startswith('op') and k[2:3].isdigit() or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=120)
