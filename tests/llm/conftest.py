import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
# workers import the operators by name
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def shared(spark, tmp_path_factory):
    """A session whose intermediate tables go to a folder of this run."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    return spark


@pytest.fixture(scope="session")
def docs_of(shared):
    """A documents table from (doc_id, text) pairs, with columns whose names clash with inner ones."""
    def make(*rows):
        return shared.createDataFrame(
            [(i, t, "en", "s", len(t or ""), 1, "x", "y") for i, t in rows],
            "doc_id long, text string, lang string, source string, n_chars long, id int, key string, a string",
        )

    return make
