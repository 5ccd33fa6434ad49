import random

import pytest

from millrace.llm import glyphs as G
from millrace.llm import scans as S

NOUNS = "ledger mailbox runtime timeout session policy harness cursor margin registry channel planner verdict handler summary sampler catalog window bundle fixture".split()
ADJ = "stale public hidden remote lenient dormant frozen optional".split()
VERBS = "retries samples records rewrites validates delivers captures follows".split()


def sentence(rng):
    return f"The {rng.choice(ADJ)} {rng.choice(NOUNS)} {rng.choice(VERBS)} the {rng.choice(['run-time', 'time-out', 'file-level'])} {rng.choice(NOUNS)} before another {rng.choice(NOUNS)} follows it."


def pages(seed=1, n=40):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = " ".join(sentence(rng) for _ in range(12)).split()
        lines, line = [], ""
        for w in text:
            if len(line) + len(w) > 60:
                lines.append(line.strip())
                line = ""
            line += w + " "
        lines.append(line.strip())
        out.append(["Public Ledger Manual   " + str(i + 1), "", *lines, "", f"- {i + 1} -"])
    return out


@pytest.fixture(scope="module")
def table(spark):
    body = pages()
    body[3][4] = body[3][4].replace("e", "c", 1).replace("another", "anothcr")
    body[5][3] = "The stale ledger retries the run-"
    body[5][4] = "time mailbox before another session fol-"
    body[5][5] = "lows it. The hid den cursor records"
    body[7][0] = "Pub1ic Ledger Manua1   8"
    body[9][2] = "- 17 -"
    body[9][3] = "in total, as counted."
    rows = [(i, "s.pdf", i + 1, "\n".join(b), True) for i, b in enumerate(body)]
    rows += [(100, "clean.docx", 1, "\n".join(pages(9, 1)[0][2:-2]), True), (101, "x.pdf", 1, None, True), (102, None, None, "", True), (103, "y.pdf", 1, "The public ledger retries the mail", False), (0, "s.pdf", 1, "\n".join(body[0]), True)]
    return spark.createDataFrame(rows, "page_id long, source string, page int, markdown string, done boolean"), body


def part(df):
    return [S.Part(df, "P", "page_id", "markdown", page="page", finished="done")]


def test_damage(table):
    df, body = table
    got = {(r.record_id, r.line_no, r.damage) for r in S.damaged_lines(part(df), share=1e-3).collect()}
    here = {k for k in got if k[2] in ("running", "pageno")}
    assert here == {(i, 1, "running") for i in range(40)} | {(i, len(body[i]), "pageno") for i in range(40)}
    assert got - here == {(3, 5, "misread"), (5, 5, "hyphen"), (5, 6, "misread")} | {k for k in got if k[:2] == (3, 5)}


def test_repair(table):
    df, body = table
    got = {r.record_id: r.text for r in S.repaired_texts(part(df), share=1e-3).collect()}
    assert "the run-time mailbox before another session follows it. The hidden cursor records" in got[5]
    assert {r.record_id for r in S.repaired_texts(part(df), share=1e-3).where("continues").collect()} == set()
    assert not any("Manual" in t for t in got.values()) and "in total, as counted." in got[9] and got[102] == ""
    assert len(got) == 40 + 3


def test_empty(spark, table):
    df, _ = table
    assert S.damaged_lines(part(df.limit(0))).count() == 0 and S.repaired_texts(part(df.limit(0))).count() == 0


def test_links():
    lex = G.Lexicon({"when": 900, "verifier": 500, "classify": 400, "margin": 300, "and": 800, "where": 700})
    assert lex.links("whcn") == ("when",) and lex.links("ver1fier") == ("verifier",) and lex.links("c1assify") == ("classify",) and lex.links("margiri") == ("margin",)
    assert lex.links("cl■ssify") == ("classify",) and lex.links("wh€re")[0] == "where" and lex.links("there") == () and lex.links("paper") == ()


def test_labels():
    for text, number in {"- 12 -": 12, "[3]": 3, "Page 4 of 9": 4, "p. l7": 17, "xiv": 14, "12 / 30": 12, "— 5 —": 5, "Page 3O": 30}.items():
        assert S.label_of(text)[1] == number, text
    assert S.label_of("n = 27") is None and S.label_of("samples.") is None and S.label_of("") is None


def test_vectors_follow_contexts():
    import numpy as np

    # Words 0 and 1 have the same neighbours, word 2 others.
    p = np.zeros((6, 6))
    for a, b in ((0, 3), (1, 3), (0, 4), (1, 4), (2, 5)):
        p[a, b] = p[b, a] = 50
    w, _ = G.train_vectors(p, size=8)
    cos = lambda a, b: float(w[a] @ w[b] / np.linalg.norm(w[a]) / np.linalg.norm(w[b]))
    assert cos(0, 1) > 0.9 > cos(0, 2)


def test_lines_in_fences_and_long_lines_are_left_alone():
    lines = S.lines_of("<!-- page 2 -->\nabc\n```\nqwxz zzq\n```\n" + "the cat " * 50_000, None)
    assert [x.kind for x in lines] == ["marker", "text", "fence", "code", "fence", "text"] and lines[1].page == 2


def test_words_broken_over_a_page_end(spark):
    body = [b[2:-2] for b in pages(3, 30)]
    body[4][-1], body[5][0] = "The stale ledger retries the mail-", "box before another session follows it."
    body[8][-1], body[9][0] = "The public ledger delivers the", "frozen mailbox before another cursor follows it."
    df = spark.createDataFrame([(i, "s.pdf", i + 1, "\n".join(b), True) for i, b in enumerate(body)], "page_id long, source string, page int, markdown string, done boolean")
    got = {r.record_id: r for r in S.repaired_texts(part(df), share=1e-3).collect()}
    assert got[4].text.endswith("The stale ledger retries the mailbox") and got[5].text.startswith("before another session follows it.") and got[5].continues
    assert got[9].continues and got[8].text.endswith("delivers the") and not got[4].continues and len(got) == 30


def test_accented_words_are_no_damage(spark):
    rng = random.Random(4)
    nouns, adjectives = ["Größe", "Prüfung", "Tür", "Ablage", "Straße", "café", "añadido", "élève"], ["schöne", "alte", "kleine"]
    body = [" ".join(f"Die {rng.choice(adjectives)} {rng.choice(nouns)} steht neben der {rng.choice(nouns)} im Haus." for _ in range(30)) for _ in range(40)]
    body[3] += " Die kleine Prüfunq steht neben der Tur."
    df = spark.createDataFrame([(i, "s.pdf", i + 1, b, True) for i, b in enumerate(body)], "page_id long, source string, page int, markdown string, done boolean")
    assert {(r.record_id, r.damage) for r in S.damaged_lines(part(df), share=1e-3).collect()} == {(3, "misread")}


def modems(spark):
    rng = random.Random(5)
    old = lambda w: f"The {w} {rng.choice(['house', 'church', 'bridge', 'tower'])} was {rng.choice(['built', 'drawn'])} by architects."
    wire = lambda w: f"Plug your {w} {rng.choice(['cable', 'socket', 'adapter'])} into that wall {rng.choice(['today', 'slowly'])}, please."
    body = [" ".join(old("modern") if rng.random() < 0.5 else wire(rng.choice(["phone", "printer", "router"])) for _ in range(40)) for _ in range(60)]
    for i in range(0, 60, 3):
        body[i] += "\n" + wire("modem")
    for i in range(1, 60, 6):
        body[i] += "\n" + old("rnodern")
    return spark.createDataFrame([(i, f"s{i}.pdf", 1, b, True) for i, b in enumerate(body)], "page_id long, source string, page int, markdown string, done boolean")


def test_vectors_tell_a_rare_word_from_a_misread_one(spark, monkeypatch):
    df = modems(spark)
    damaged = lambda: {(r.record_id, r.line_no) for r in S.damaged_lines(part(df), share=5e-3).where("damage = 'misread'").collect()}
    assert damaged() == {(i, 2) for i in range(1, 60, 6)}
    # Without the vectors' word, the shape alone takes the one for the other.
    monkeypatch.setattr(S, "_settled", lambda *_: {})
    assert damaged() == {(i, 2) for i in range(1, 60, 6)} | {(i, 2) for i in range(0, 60, 3)}


def test_like_lines_far_apart_are_no_header(spark):
    body = [[f"Line {chr(97 + i % 26)}{chr(97 + i // 26 % 26)} opens this page of text", "", *b[2:-2]] for i, b in enumerate(pages(6, 120))]
    for i in (2, 110):
        body[i][0] = "further details are given where the session"
    for i in range(50, 56):
        body[i][0] = "chapter of many small sessions"
    df = spark.createDataFrame([(i, "s.pdf", i + 1, "\n".join(b), True) for i, b in enumerate(body)], "page_id long, source string, page int, markdown string, done boolean")
    got = {r.record_id for r in S.damaged_lines(part(df), share=1e-3).where("damage = 'running' AND line_no = 1").collect()}
    assert set(range(50, 56)) <= got and not {2, 110} & got
