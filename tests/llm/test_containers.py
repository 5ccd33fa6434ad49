import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import containers as C


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=120))
def test_no_window_is_overfull_and_all_items_are_in_one(sizes):
    s = np.array(sizes)
    w = C.pack(s, 100)
    assert len(w) == len(s) and np.bincount(w, s).max() <= 100


def test_differencing_evens_out():
    rng = np.random.default_rng(4)
    s = rng.integers(1, 300, 1000)
    w, sums = C.difference(s, 40)
    assert sums.sum() == s.sum() and np.ptp(sums) <= 5 and (np.bincount(w, s, 40) == sums).all()
    windows = len(set(C.pack(s, 2048)))
    assert s.sum() / (windows * 2048) > 0.97


def test_table(spark):
    rows = [(i, (i * 37) % 900 + 1) for i in range(3000)] + [(5000, 4096), (5001, 5000), (5002, 2048), (5003, 0), (5004, None), (5005, -3), (7, 1), (None, 10)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, n long, container string")
    got = C.fill(df, "id", "n", 2048, 500).collect()
    by = {}
    for r in got:
        by.setdefault(r.container, []).append(r)
    assert all(sum(r["size"] for r in v) <= 2048 and sorted(r.place for r in v) == list(range(1, len(v) + 1)) for v in by.values())
    pieces = {}
    for r in got:
        pieces.setdefault(r.id, []).append(r)
    assert len(pieces) == 3000 + 3 + 1 and all(len(v) == 1 for k, v in pieces.items() if k not in (5000, 5001))
    assert sorted((r.piece, r.start, r["size"]) for r in pieces[5001]) == [(1, 0, 2048), (2, 2048, 2048), (3, 4096, 904)]
    assert sum(r["size"] for r in got) / (len(by) * 2048) > 0.95
    assert C.fill(df.limit(0), "id", "n").count() == 0
    assert set(C.fill(df, "id", "n", 2048, 500).collect()) == set(got)


def test_documents(spark):
    long = "word " * 5000
    df = spark.createDataFrame([(1, long), (2, "a b"), (3, None), (4, " \n "), (5, "x" * 30000)], "doc_id long, text string")
    tokens = {r.doc_id: r.tokens for r in C.count_tokens(df, "doc_id", "text").collect()}
    assert set(tokens) == {1, 2, 5} and tokens[2] == 2 and tokens[1] == len(C.tokenizer().encode_ordinary(long))
    got = C.fill_documents(df).collect()
    assert {r.doc_id for r in got} == {1, 2, 5} and sum(r["size"] for r in got if r.doc_id == 1) == tokens[1]
