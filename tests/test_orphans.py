import datetime as dt
import random

from millrace.operators.orphans import Child, Parent, count_orphans, find_orphans

T0 = dt.datetime(2025, 1, 1)
P = "k string, created_at timestamp_ntz, deleted_at timestamp_ntz"
C = "record_id long, k string, created_at timestamp_ntz"


def hours(h):
    return None if h is None else T0 + dt.timedelta(hours=h)


def run(spark, parents, children):
    p = spark.createDataFrame([(k, hours(c), hours(d)) for k, c, d in parents], P)
    c = spark.createDataFrame([(i, k, hours(t)) for i, k, t in children], C)
    out = find_orphans([Child(c, "R", "p", "k")], [Parent(p, "p", "k")])
    return {r.record_id: r.reason for r in out.collect()}, out


def brute(parents, children):
    norm = lambda k: (k or "").strip().lower()
    out = {}
    for i, k, t in children:
        own = [(c, d) for q, c, d in parents if norm(q) == norm(k)]
        if not norm(k) or t is not None and any(c is not None and c <= t and (d is None or d > t) for c, d in own):
            continue
        late = t is not None and own and all(c is not None and c > t for c, _ in own)
        out[i] = "missing" if not own else "late" if late else "deleted"
    return out


def test_reasons_and_spelling(spark):
    parents = [("A", 0, None), ("b", 0, 5), ("b", 10, None), ("c", 7, None), ("d", 3, 3), ("e", None, None)]
    children = [(1, " a\t", 1), (2, "B", 4.5), (3, "b", 5), (4, "b", 10), (5, "c", 6.99), (6, "zz", 1), (7, None, 1), (8, "  ", 1), (9, "d", 3), (10, "e", 1), (11, "a", None), (12, "zz", None)]
    got, out = run(spark, parents, children)
    assert got == brute(parents, children) == {3: "deleted", 5: "late", 6: "missing", 9: "deleted", 10: "deleted", 11: "deleted", 12: "missing"}
    assert {(r.record_type, r.created_month, r.reason): r.orphan_count for r in count_orphans(out).collect()}[("R", "2025-01", "deleted")] == 3


def test_random_against_brute_force(spark):
    rng = random.Random(3)
    parents = [(rng.choice("abcdef"), rng.choice([None, *range(40)]) if rng.random() < 0.9 else None, rng.choice([None, None, *range(40)])) for _ in range(60)]
    children = [(i, rng.choice("abcdefgh"), rng.choice([None, *[x / 2 for x in range(100)]])) for i in range(300)]
    assert run(spark, parents, children)[0] == brute(parents, children)


def test_hot_key_repeats_empty_and_clashing_columns(spark):
    parents = [("hot", h, h + 1) for h in range(0, 200, 2)] * 3
    children = [(i, "hot", i % 210) for i in range(2000)]
    children += children[:50]
    assert run(spark, parents, children)[0] == brute(parents, children)
    assert run(spark, [], [(1, "x", 0)])[0] == {1: "missing"}
    assert run(spark, [("x", 0, None)], [])[0] == {}
    p = spark.createDataFrame([("x", T0, None, 1)], P + ", ref_key int")
    c = spark.createDataFrame([(1, "y", T0, "q")], C + ", ref_table string")
    assert find_orphans([Child(c, "R", "p", "k")], [Parent(p, "p", "k")]).count() == 1
