import base64
import json

from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import pieces as P

TEXTS = st.lists(st.sampled_from(["word", "A sentence. ", "\n", "\n\n", "# Head\n", "<!-- page 3 -->\n", "ééé", "漢字。", " ", "x" * 70, "end! "]), max_size=120).map("".join)


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(60, 300), st.integers(0, 50))
def test_pieces_keep_the_limit_and_give_the_text_back(text, limit, overlap):
    out = P.split_text(text, limit, overlap)
    assert "".join(b for _, b in out) == text
    assert all(len((o + b).encode()) <= limit for o, b in out)
    for (_, before), (o, _) in zip(out, out[1:]):
        assert before.endswith(o) and len(o.encode()) <= overlap


def test_cuts_fall_at_the_best_boundary():
    text = "<!-- page 1 -->\n\n" + "Some words here. " * 10 + "\n\n<!-- page 2 -->\n\n" + "Other words there. " * 10
    assert [b[:17] for _, b in P.split_text(text, 260, 20)] == ["<!-- page 1 -->\n\n", "<!-- page 2 -->\n\n"]
    bodies = [b for _, b in P.split_text("para one is here. " * 5 + "\n\n" + "para two is here. " * 5, 120, 10)]
    assert bodies[0].endswith("\n\n")
    assert all(b.endswith(". ") for b in [b for _, b in P.split_text("A short sentence. " * 40, 100, 0)][:-1])
    assert [len(b) for _, b in P.split_text("x" * 1000, 300, 0)] == [300, 300, 300, 100]


def test_page_lists():
    cases = {("1-3, 5", 9): 4, ("1 – 20", 30): 20, ("26-46", 30): 21, ("5-", 30): 26, ("-7", 30): 7, (None, 25): 25, ("  ", None): 0, ("100-1", 200): 100, ("1-3;2-5;4", 9): 5, ("abc", 50): 0, ("7-", None): 0, ("3000000", 5): 1, ("2-3000001", 5): 3_000_000, ("1-" + "9" * 20, 5): 10**20 - 1, ("7" * 5000, 5): 0}
    for (text, count), n in cases.items():
        assert sum(b - a + 1 for a, b in P.page_spans(text, count)) == n, text
    groups = list(P.split_pages(P.page_spans("1-15, 30-60", None)))
    assert [sum(b - a + 1 for a, b in g) for g in groups] == [20, 20, 6] and groups[0] == [(1, 15), (30, 34)]


def cursor(obj):
    return "ocr1." + base64.urlsafe_b64encode(json.dumps(obj).encode()).rstrip(b"=").decode() + ".0123456789abcdef"


def test_tables(spark):
    rows = [(1, "1-21", 30, "a. " * 4000, False, cursor({"at": {"joint": 0, "unit": 3, "pos": 9}})), (2, "1-20", 30, "short", False, cursor({"at": {"joint": 1}})), (3, None, None, None, False, "ocr1.@@.1"), (4, "", 21, "", True, cursor({"at": {"joint": 0}})), (5, None, 2, "é" * 3001, None, cursor({"at": {"joint": 0}})), (6, "x", 5, "y", False, cursor({"at": None}))]
    df = spark.createDataFrame(rows, "record_id long, pages string, page_count int, markdown string, is_complete boolean, next_cursor string")
    assert {r.record_id for r in P.page_ranges(df, "record_id", "pages", "page_count").where("piece = 2").collect()} == {1, 4}
    got = P.text_pieces(df.withColumn("text", df.pages).withColumn("piece", df.pages), "record_id", "markdown").orderBy("record_id", "piece").collect()
    assert {r.record_id for r in got} == {1, 5} and "".join(r.text.encode()[r.overlap_bytes :].decode() for r in got if r.record_id == 1) == "a. " * 4000
    assert all(len(r.text.encode()) <= 6000 for r in got) and [r.start_byte for r in got if r.record_id == 5][0] == 0
    assert [tuple(r) for r in P.open_cursors(df, "record_id", "next_cursor", "is_complete").collect()] == [(1, 3, 9)]
    for f in (P.page_ranges(df.limit(0), "record_id", "pages", "page_count"), P.text_pieces(df.limit(0), "record_id", "markdown"), P.open_cursors(df.limit(0), "record_id", "next_cursor", "is_complete")):
        assert f.count() == 0


def test_very_long_text_is_cut_in_linear_time():
    import time

    began = time.time()
    out = P.split_text("lorem ipsum " * 400_000)
    assert len(out) > 800 and time.time() - began < 20


def test_ranges_of_any_length(spark):
    df = spark.createDataFrame([(1, "5-2000004", 3), (2, "1-" + "9" * 30, None), (3, "8", None)], "record_id int, pages string, n int")
    assert {r.record_id for r in P.page_ranges(df, "record_id", "pages", "n", upto=2).where("piece = 2").collect()} == {1, 2}
    got = P.page_ranges(df.where("record_id = 1"), "record_id", "pages", "n")
    assert got.count() == 100_000 and got.where("piece = 100000").first().pages == "1999985-2000004"
