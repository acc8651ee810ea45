"""Against plain integer arithmetic over all entries."""

import numpy as np
import pytest

from agentmeter.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int, id string, code string, v int, away int, of int, copy int"


def made(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", None, 1, 2, 3, 4) for i, v, lab in rows], SCHEMA)


def brute(rows, rounds=codes.ROUNDS, entries=codes.ENTRIES):
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // 8)
    whole = [[int(np.floor(4096.0 * x)) for x in v] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, whole[k]))
    padded = [v + [0] * (8 * width - len(v)) for v in whole]
    part = lambda k, p: padded[k][p * width : (p + 1) * width]
    books = [[part(k, p) for k in order[:entries]] for p in range(8)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(8):
            got = [near(part(k, p), books[p])[1] for k in range(len(kept))]
            for e in range(len(books[p])):
                mine = [part(k, p) for k in range(len(kept)) if got[k] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    out, by_label = [], {}
    for k, (i, _, lab) in enumerate(kept):
        found = [near(part(k, p), books[p]) for p in range(8)]
        error = sum(d for d, _ in found)
        by_label[lab] = by_label.get(lab, 0) + error
        out.append((i, lab, "".join(f"{e:02x}" for _, e in found), error))
    return sorted(((*r, by_label[r[1]]) for r in out), key=repr), ",".join(str(x) for book in books for e in book for x in e)


def result(spark, rows):
    coded, books = codes.encode(made(spark, rows))
    got = codes.with_label_errors(coded)
    assert got.columns == ["vec_id", "label", "code", "error", "label_error"]
    return sorted(map(tuple, got.collect()), key=repr), codes.stated(books)


@pytest.mark.parametrize("width", [16, 24])
def test_equals_brute_force(spark, width):
    some = np.random.default_rng(width)
    centres = some.normal(size=(30, width))
    rows = [(int(i), (centres[i % 30] + some.normal(size=width) / 9).tolist(), int(i) % 3 or None) for i in some.permutation(250)]
    assert result(spark, rows) == brute(rows)


def test_ties_repeats_and_odd_rows(spark):
    some = np.random.default_rng(3)
    rows = [(int(i // 2), (some.integers(-2, 3, 8) / 4).tolist(), 1) for i in range(120)]
    rows += rows[:20] + [(None, [0.5] * 8, None), (None, [-0.5] * 8, None), (7, None, 1), (8, [None] * 8, 2)]
    rows += [(9, [float("nan")] * 8, 1), (10, [float("inf")] + [0.0] * 7, 1)]
    assert result(spark, rows) == brute(rows)


def test_few_uneven_and_no_rows(spark):
    rows = [(3, [0.25, 1.0, -7.3], 1), (1, [], 1), (2, [0.1] * 11, None)]
    assert result(spark, rows) == brute(rows)
    assert result(spark, [(1, [], 1)]) == ([(1, 1, "00" * 8, 0, 0)], "")
    assert result(spark, []) == ([], "") == result(spark, [(1, None, 1)])


def test_components_far_apart_stay_exact(spark):
    some = np.random.default_rng(4)
    rows = [(i, (some.normal(size=8) * 10.0 ** some.integers(0, 6)).tolist(), i % 2) for i in range(80)]
    assert result(spark, rows) == brute(rows)
    far = [(i, [float(i) * 1e12] + [0.5] * 7, 0) for i in range(40)]
    got = result(spark, far)[0]
    assert any(r[3] is None for r in got) and all(r[4] is None for r in got)


def test_bounds_save_evaluations_and_change_nothing():
    some = np.random.default_rng(6)
    book = some.integers(-4000, 4000, (16, 8))
    parts = book[some.integers(0, 16, 4000)] + some.integers(-300, 300, (4000, 8))
    fixed = codes.pivots(book[None])
    away = codes.roots(parts[:, None], fixed).astype(np.float32)[:, 0]
    anchors = codes.roots(book[:, None], fixed)[:, 0]
    entry, square, tried = codes.nearest(parts, away.astype(float), book, anchors)
    whole = ((parts[:, None] - book[None]) ** 2).sum(-1)
    assert (entry == whole.argmin(1)).all() and (square == whole.min(1)).all()
    assert tried < 0.3 * whole.size
