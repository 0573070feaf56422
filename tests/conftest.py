import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from treeshift.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def one_range(spark):
    return spark.createDataFrame(
        [("x", "r", "base", "head")], "range_id string, repo string, base_ref string, head_ref string"
    )


@pytest.fixture(scope="session")
def make_tree(spark):
    def build(base: dict[str, str], head: dict[str, str], **more: dict[str, str]):
        rows = [
            ("r", ref, path, content)
            for ref, files in {"base": base, "head": head, **more}.items()
            for path, content in files.items()
        ]
        return spark.createDataFrame(rows, "repo string, ref string, path string, content string")

    return build
