import json
import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from agentmeter.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "agentmeter-tests",
        "local[4]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def write_jsonl(tmp_path):
    def write(name, *records):
        path = tmp_path / "corpus" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        lines = [r if isinstance(r, str) else json.dumps(r, separators=(",", ":"), ensure_ascii=False) for r in records]
        path.write_text("".join(line + "\n" for line in lines), encoding="utf8")
        return str(tmp_path / "corpus")

    return write
