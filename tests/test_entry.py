"""The driver's contract, with and without the corpus operators."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_names_match():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_works_without_the_corpus_operators(tmp_path):
    for p in ROOT.iterdir():
        if p.name not in (".git", "corpus_pipeline.py", "rarefold", "tests"):
            os.symlink(p, tmp_path / p.name)
    (tmp_path / "rarefold").mkdir()
    for p in (ROOT / "rarefold").iterdir():
        if p.name != "llm":
            os.symlink(p, tmp_path / "rarefold" / p.name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'f2_rank_vote' in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
