import random
import re

from millrace.llm import leaks as L


def words(t):
    return re.findall(r"[a-z0-9]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, n=12):
    out = {}
    for i, d in docs:
        w = words(d)
        for j, t in items:
            v = words(t)
            best = 0
            for a in range(len(w)):
                for b in range(len(v)):
                    k = 0
                    while a + k < len(w) and b + k < len(v) and w[a + k] == v[b + k]:
                        k += 1
                    best = max(best, k)
            if best >= n:
                out[i, j] = best
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(30)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(5, 40)))) for k in range(12)]
    docs = []
    for i in range(80):
        parts = []
        for _ in range(3):
            if rng.random() < 0.5:
                v = words(rng.choice(items)[1])
                a = rng.randint(0, len(v) - 1)
                parts.append("> \n".join(x.upper() for x in v[a : a + rng.randint(8, 20)]))
            parts.append(" ".join(rng.choice(vocab + ["zz"]) for _ in range(10)))
        docs.append((i, ", ".join(parts)))
    return docs, items


def run(spark, docs, items, **k):
    c = spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, item_id string")
    t = spark.createDataFrame([(*x, "s") for x in items], "item_id long, text string, doc_id string")
    return L.find_leaks(c, t, **k)


def test_longest_matches_against_brute_force(spark):
    docs, items = corpus(1)
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id): r.matched_words for r in run(spark, docs, items).collect()} == want and len(want) > 10
    assert {(r.doc_id, r.item_id): r.matched_words for r in run(spark, docs, items, block_chars=200).collect()} == want


def test_places_shards_and_edges(spark, monkeypatch):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = [(1, "x y " + item.title() + " z"), (2, " ".join(item.split()[:11])), (3, None), (4, ""), (5, "İ " + item.replace(" ", "-İ-")), (6, item[:-9]), (7, "twelve thirteen"), (8, ("pad " * 50_000) + item)]
    monkeypatch.setattr(L, "SHARD_WORDS", 20)
    got = {r.doc_id: (r.matched_words, r.doc_start, r.item_start) for r in run(spark, docs, [(1, item), (2, None), (3, "too short")]).collect()}
    assert got == {1: (13, 3, 1), 5: (13, 1, 1), 6: (12, 1, 1), 8: (13, 50_001, 1)}
    clean = L.without_leaks(spark.createDataFrame(docs, "doc_id long, text string"), run(spark, docs, [(1, item)]))
    assert sorted(r.doc_id for r in clean.collect()) == [2, 3, 4, 7]


def test_empty_sides_and_repeats(spark):
    docs, items = corpus(2)
    assert run(spark, [], items).count() == 0 and run(spark, docs, []).count() == 0
    assert run(spark, docs * 2, items).count() == 2 * run(spark, docs, items).count()
