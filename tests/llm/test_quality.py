import random

from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import quality as Q

PROSE = "The call to project_buffer invalidates the endpoint and returns a missing process. Nothing groups the inode until the bounded legend has been idle for 17 seconds. "
WORDS = "retry conflict harness buffer rule gauge nonce cipher market wheel garden winter copper engine letter bridge window silver pepper candle".split()
SIGNS = "}{8\\1!9?;~>{;~90>($9 }]09?6:10-$;|>\n#+({<]<(="
DOCS = {
    "list": [
        "\n".join(f"- open the {w} of {v}" for w, v in zip(WORDS, WORDS[7:])), "\n".join(f"docs/{w}/{v}.rs" for w, v in zip(WORDS, WORDS[5:])), "\n".join(f"{w}_{v}: {i}" for i, (w, v) in enumerate(zip(WORDS, WORDS[9:]))),
        "\n".join(f"{w} {v}" for w, v in zip(WORDS[:9], WORDS[10:])), "## Changed\n" + "\n".join(f"{i}) drop the {w}" for i, w in enumerate(WORDS, 1)),
    ],
    "table": [
        "| a | b |\n| --- | --- |\n" + "\n".join(f"| {i} | {w} |" for i, w in enumerate(WORDS)), "\n".join(f"{w},{i},,{v}" for i, (w, v) in enumerate(zip(WORDS, WORDS[6:]))), "\n".join(f"{w}\t{i}\t\t{v}" for i, (w, v) in enumerate(zip(WORDS, WORDS[6:]))),
        "\n".join(f"{w:12}{i:<10}{v}" for i, (w, v) in enumerate(zip(WORDS, WORDS[6:]))), "<table>\n" + "\n".join(f"<tr><td>{w}</td><td>{i}</td></tr>" for i, w in enumerate(WORDS)) + "\n</table>",
    ],
    "junk": [
        SIGNS * 3, "worker. deadline. " * 30, "scanline\nregression\n" * 30, "ficd. juup wdrehfcnim. ifoimkx eettfzwp jhannnc whdktfd wmkpjemo rxc qj nglhcbek ceguzdu", "00000000: fa8e 0c66 66ab 4363 9f3d\n00000010: a90e d6f4 ac32 2994 7330",
        "H7u44y/Cpqj3D/zkflylYXHfQW2d6JQKu8lOwXqLWTOb4DiQN04m0tIjHZOFkqOzNQXFZ5uKJsh7", "â€™ï¿½tÃ¤nâ€™e�Ã¼��tÃ¤�ï¿½Ã¼â€™Ã¼tÃ¼", "=====\n* * * * * *\n......\n",
    ],
    "prose": [PROSE * 2, "# Heading\n\n" + PROSE, PROSE + "\n\n- short\n- list", "Es gibt keinen Bericht ohne Puffer, weil der kurze Verweis ihn sonst meldet.", "Il n'y a pas de rapport sans lot, car le modèle le vérifie.", "No hay contador sin contrato, porque el bloque único lo escribe."],
}


LETTERS = "the of and that returns invalidates missing process groups bounded legend seconds open retry conflict harness gauge contador bericht modèle kurze verweis worker deadline scanline regression item"
KNOW = Q.Words(
    "the to and a nothing until has been for on es keinen ohne weil der ihn sonst il n pas de sans car le no hay sin porque el lo".split(),
    {p for w in [*LETTERS.split(), *WORDS, *PROSE.split()] for p in Q.letter_pairs(w.lower())},
)


def whole(text):
    return dict(zip(Q.SUMS, Q.finished(Q.partial(text, 0, len(text), KNOW))))


def test_kinds(spark):
    rows = [(f"{k}{i}", t) for k, ts in DOCS.items() for i, t in enumerate(ts)]
    got = {r.doc_id: r.kind for r in Q.text_quality(spark.createDataFrame(rows, "doc_id string, text string"), words=KNOW).collect()}
    assert {k: v for k, v in got.items() if not k.startswith(v)} == {}


TEXT = st.lists(st.sampled_from([PROSE, "\n", "\n\n", "- item\n", "a,b,c\n", "worker. ", "x", "é", "!!", "| a | b |\n", "H7u44y/Cpqj3D/zkflylYXHfQW2d6JQKu8lOw "]), max_size=40).map("".join)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(20, 200))
def test_any_split_gives_the_same_sums(text, size):
    state = None
    for i in range(0, max(1, len(text)), size):
        a, b = max(0, i - Q.CONTEXT), min(len(text), i + size + Q.CONTEXT)
        p = Q.partial(text[a:b], i - a, min(len(text), i + size) - a, KNOW)
        state = p if state is None else Q.merge(state, p)
    assert dict(zip(Q.SUMS, Q.finished(state))) == whole(text)


def test_statistics(spark):
    r = Q.text_quality(spark.createDataFrame([(1, "The cat sat.\nOn a mat!\n\nxyz")], "doc_id int, text string"), words=Q.Words(["the", "on", "a"])).first()
    assert r.word_count == 7
    assert abs(r.mean_word_length - 18 / 7) < 1e-9 and abs(r.punctuated_line_share - 2 / 3) < 1e-9 and abs(r.common_word_share - 3 / 7) < 1e-9


def test_huge_repeated_null_and_empty(spark):
    rng = random.Random(1)
    huge = "".join(rng.choice([PROSE, "- item\n", "a,b,c\n", "\n"]) for _ in range(3000))
    df = spark.createDataFrame([(1, huge, 1), (1, huge, 1), (2, None, 1), (3, "  \n ", 1), (4, "x" * 100_000, 1), (5, "", 1)], "doc_id int, text string, chunk_ int")
    got = {r.doc_id: r for r in Q.text_quality(df, chunk=5000, words=KNOW).collect()}
    want = whole(huge)
    assert set(got) == {1, 3, 4, 5} and got[1].word_count == want["words"] and abs(got[1].list_share - want["list"] / want["chars"]) < 1e-12
    assert got[3].kind is None and got[5].word_count == 0 and got[4].word_count == 1
    assert Q.text_quality(df.limit(0)).count() == 0 and Q.not_prose(df).where("doc_id IN (3, 5)").count() == 0


def test_common_words_and_letter_pairs_are_learned(spark):
    rows = [(i, f"The {WORDS[i % 20]} of the {WORDS[(i + 7) % 20]} number{i} is zqx{i}.", "en") for i in range(60)] + [(100 + i, f"Der {WORDS[i % 20]} ist es {i}.", "de") for i in range(10)] + [(200, "qqq qqq der", None), (201, None, "en"), (202, "", "en")]
    know = Q.learn(spark.createDataFrame(rows, "doc_id int, text string, lang string"), lang_col="lang")
    assert know.common == {"the", "of", "is", "der", "ist", "es"} and "th" in know.pairs and "re" in know.pairs and not {"qq", "zq"} & know.pairs
    assert Q.learn(spark.createDataFrame(rows[:0], "doc_id int, text string, lang string")).common == set()
