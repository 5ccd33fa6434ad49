"""Queries that have the whole of their input, on small tables made to hold what a cut would lose."""

import datetime as dt
import re

from millrace import plans
from millrace.streaming import events as E

BLANK = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def run(spark, folder, name, table, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
    return plans.all_queries()[name](spark, str(folder)).collect()


def duck(folder, name, table):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    return c.execute(plans.all_sql()[name]).fetchall()


def test_collapse_whole_text(spark, tmp_path):
    texts = {1: "a  b " * 200 + "end", 2: "n\xe9 \u2028\u3000x\xa0y ", 3: "\x0b\x85\u2003lead\t\tand\r\ntail\u202f", 4: "", 5: " \n\xa0", 6: None, 7: "\xe9" * 900 + "  z", 8: "x\x1cy\u200bz"}
    got = {r.doc_id: r.squeezed for r in run(spark, tmp_path, "text_collapse", "documents", list(texts.items()), "doc_id long, text string")}
    assert got == {k: re.sub(BLANK, " ", t).strip(" ") for k, t in texts.items() if t is not None}
    assert dict(duck(tmp_path, "text_collapse", "documents")) == got


def test_walls_of_all_kinds(spark, tmp_path):
    texts = {
        1: "Please LOG IN", 2: "Sign in to continue", 3: "sign in to my account", 4: "Subscribers only", 5: "Subscribe to read on", 6: "subscribe by mail", 7: "We use cookies.", 8: "Cookie policy",
        9: "a cookie", 10: "Checking your browser; we use cookies", 11: "log in to view, subscribe to continue", 12: "subscribers only: cookie policy", 13: "we use cookies" + "." * 700, 14: "text", 15: "", 16: None, 17: "x" * 686 + "we use cookies",
    }
    want = {1: "login", 2: "login", 4: "paywall", 5: "paywall", 7: "cookies", 8: "cookies", 10: "challenge", 11: "login", 12: "paywall", 17: "cookies"}
    got = {r.doc_id: r.wall for r in run(spark, tmp_path, "page_walls", "documents", list(texts.items()), "doc_id long, text string")}
    assert got == {k: want.get(k) for k, t in texts.items() if t is not None}
    assert dict(duck(tmp_path, "page_walls", "documents")) == got


def test_regex_over_whole_text(spark, tmp_path):
    texts = {1: "ab 12 " * 40 + "Zoe\u00e9 end", 2: "\U0001f600\U0001f600x\ny", 3: "", 4: None, 5: "lower"}
    rows = run(spark, tmp_path, "regex_functions", "documents", [(k, t, "a/b.py") for k, t in texts.items()], "doc_id long, text string, path string")
    assert {r.doc_id: r.squeezed for r in rows} == {k: re.sub("[^a-z]+", "_", t) for k, t in texts.items() if t is not None}
    assert sorted(map(tuple, rows)) == sorted(duck(tmp_path, "regex_functions", "documents"))


def test_unnest_every_element(spark, tmp_path):
    vectors = {1: [float(x) for x in range(64)], 2: [0.5], 3: [], 4: None, 5: [1.0, None, 2.0, None]}
    got = sorted(map(tuple, run(spark, tmp_path, "unnest", "embeddings", list(vectors.items()), "vec_id long, embedding array<float>")), key=lambda r: r[:2])
    assert got == [(k, i + 1, x) for k, v in vectors.items() for i, x in enumerate(v or [])]
    assert sorted(duck(tmp_path, "unnest", "embeddings"), key=lambda r: r[:2]) == got


def test_sessions_of_the_stream(spark, tmp_path, monkeypatch):
    seen, sessions = [], E.sessions
    monkeypatch.setattr(E, "sessions", lambda stream, *a, **k: seen.append(stream.isStreaming) or sessions(stream, *a, **k))
    at = lambda m: dt.datetime(2025, 1, 1) + dt.timedelta(minutes=m)
    minutes = {1: [0, 5, 14, 30, 31], 2: [100_000], 3: [0, 50_000, 50_009, 49_995]}
    rows = [(u, at(m)) for u, ms in minutes.items() for m in ms]
    got = {r.user_id: (r.events, r.sessions) for r in run(spark, tmp_path, "stream_sessions", "events", rows, "user_id long, ts timestamp_ntz")}
    assert seen == [True]
    assert got == {1: (5, 2), 2: (1, 1), 3: (4, 2)}
    assert {u: (n, s) for u, n, s in duck(tmp_path, "stream_sessions", "events")} == got


def test_sources_read_all_documents(spark, tmp_path):
    texts = ["a, \"b\"; c\n\n|d\t\\n \\", "", None, " edge ", "\xe9\u2028\u3042\U0001f600", "{}", "12", "[1]\n"]
    n = len(texts) * 500
    rows = [(k, texts[k % len(texts)], "en", f"s/{k}", k if k % 3 else None, None, "p/a.py" if k % 5 else None, dt.datetime(2025, 1, 1, 0, 0, 0, k)) for k in range(n)]
    rows.append((n, "last", "en", "12", 2**40, None, "true", None))
    schema = "doc_id long, text string, lang string, source string, n_chars long, pack string, path string, created_at timestamp_ntz"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("source_csv", "source_json"):
        df = plans.all_queries()[name](spark, str(tmp_path))
        stamp = (lambda t: t) if "csv" in name else lambda t: t and t.strftime("%Y-%m-%d %H:%M:%S.%f")  # noqa: B023
        assert dict(df.dtypes)["n_chars"] == "bigint" and dict(df.dtypes)["text"] == "string"
        got = sorted(map(tuple, df.collect()))
        assert got == [(*r[:7], stamp(r[7])) for r in rows]
        assert sorted(duck(tmp_path, name, "documents")) == got
