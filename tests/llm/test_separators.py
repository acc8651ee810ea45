import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from agentmeter.llm import separators, tokens


def flat(tmp_path, name, ids):
    folder = tmp_path / "flat"
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(np.array(ids, "<u2").tobytes())
    return str(folder)


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
def test_documents_run_over_blocks(spark, tmp_path, block):
    rng, want = random.Random(block), {}
    for name in ("a", "b", "c", "open"):
        ids = [9 if rng.random() < 0.2 else rng.randint(10, 99) for _ in range(rng.randint(50, 300))]
        # 0x0909 and ids whose bytes join to the separator across a border aren't separators.
        ids = [0x0909, 9, 9, *ids, 0x0900, 0x0009 if name != "open" else 77]
        path = flat(tmp_path, name, ids)
        ends = [-1, *(i for i, x in enumerate(ids) if x == 9)]
        rows = [(k, b - a - 1, True) for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False))]
        if ends[-1] != len(ids) - 1:
            rows.append((len(rows), len(ids) - 1 - ends[-1], False))
        want[name] = rows
    flat(tmp_path, "empty", [])
    got = {}
    for r in separators.scan(spark, path, 9, block).collect():
        got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.ordinal, r.n_tokens, r.ended))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_half_an_id_is_an_error(spark, tmp_path):
    path = flat(tmp_path, "x", [1, 2, 9])
    (tmp_path / "flat" / "x").write_bytes(b"abc")
    with pytest.raises(Exception, match="ends within an id"):
        separators.scan(spark, path, 9).collect()
    with pytest.raises(ValueError):
        separators.scan(spark, path, 9, 3)


def test_counts(make_documents, spark, tmp_path, odd):
    rows = [*odd, (20, "a <|endoftext|> b"), (21, "ünï 日本")]
    path = str(tmp_path / "docs")
    make_documents(rows).repartition(3).write.parquet(path)
    library = Tokenizer.from_file(tokens.default_path())
    library.encode_special_tokens = True
    got = [(r.doc_id, r.n_tokens) for r in separators.counts(spark.read.parquet(path)).collect()]
    want = [(i, len(library.encode(x or "", add_special_tokens=False).ids)) for i, x in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_no_documents(make_documents, spark, tmp_path):
    path = str(tmp_path / "none")
    make_documents([]).write.parquet(path)
    assert separators.counts(spark.read.parquet(path)).collect() == []
