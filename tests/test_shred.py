import json

from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.operators import shred as S


def walk(doc):
    """The flat rows of a plugin call by plain recursion."""
    x = S.parsed(doc)
    if x is None:
        return set()
    get, out = S.member, set()
    caller = get(x, ("input.caller",))
    if isinstance(caller, dict) and get(caller, ("agent_id",)) is not None:
        out.add(("caller", 0, 1))
    for i, data in enumerate(S.elements(get(x, ("input.data",))), 1):
        for j, row in enumerate(S.elements(S.member(S.decoded(data), ("rows",))), 1):
            if S.decoded(row) is not None:
                out.add(("data_row", i, j))
    progress = get(x, ("expect.progress", "expect.effects.progress"))
    if isinstance(progress, dict):
        if get(progress, ("state",)) is not None:
            out.add(("progress", 0, 1))
        for i, phase in enumerate(S.elements(get(progress, ("phases",))), 1):
            phase = S.decoded(phase)
            if phase is not None:
                out.add(("phase", 1, i))
            for j, slot in enumerate(S.elements(S.member(phase, ("active",))), 1):
                if S.decoded(slot) is not None:
                    out.add(("slot", i, j))
    return out


def flat(doc):
    x = S.parsed(doc)
    return set() if x is None else {(e, p, q) for e, p, q, _ in S.assemble(S.shred(x, S.CALL), S.CALL_TABLES)}


leaf = st.one_of(st.none(), st.integers(), st.text(max_size=4), st.just({}), st.just([]))
slots = st.one_of(leaf, st.lists(st.one_of(st.none(), st.just({"slot": "a"})), max_size=3), st.just({"slot": "b"}), st.just('[{"slot":1},null]'))
phases = st.one_of(leaf, st.lists(st.one_of(st.none(), st.fixed_dictionaries({}, optional={"active": slots, "title": leaf})), max_size=4))
progress = st.one_of(leaf, st.fixed_dictionaries({}, optional={"state": leaf, "phases": phases}), st.just('{"state":"x","phases":[{}]}'))
rows = st.one_of(leaf, st.lists(st.one_of(leaf, st.lists(leaf, max_size=2)), max_size=4), st.just('[[1],[2]]'))
data = st.one_of(leaf, st.fixed_dictionaries({}, optional={"rows": rows}), st.lists(st.one_of(st.none(), st.fixed_dictionaries({}, optional={"rows": rows})), max_size=3))
docs = st.fixed_dictionaries({}, optional={"input": st.one_of(leaf, st.fixed_dictionaries({}, optional={"caller": st.one_of(leaf, st.just({"agent_id": "x"}), st.just('{"agent_id":"y"}')), "data": data})), "expect": st.one_of(leaf, st.fixed_dictionaries({}, optional={"progress": progress, "effects": st.one_of(leaf, st.fixed_dictionaries({}, optional={"progress": progress}))}))})


@settings(max_examples=300, deadline=None)
@given(docs)
def test_levels_give_what_recursion_gives(doc):
    assert flat(json.dumps(doc)) == walk(json.dumps(doc))


def test_levels_of_nested_lists():
    doc = {"input": {"data": [{"rows": [[1], None]}, None, {"rows": {"a": 1}}]}}
    entries = S.shred(doc, S.CALL)["call.data.rows.element"]
    assert [(r, d) for r, d, _ in entries] == [(0, 4), (2, 3), (1, 2), (1, 4)]
    assert flat(json.dumps(doc)) == {("data_row", 1, 1), ("data_row", 3, 1)}


def test_table_with_bad_documents(spark):
    docs = ['﻿{"input":{"caller":{"agent_id":"a"}}}', "", None, '{"input"', "[1]", "{}", '{"expect":{"progress":{"phases":{"active":[null,{"slot":1}]}}}}', '{"a":' * 5000]
    df = spark.createDataFrame([(i, d, "x") for i, d in enumerate(docs)], "case_id long, doc string, entity string")
    got = {tuple(r) for r in S.flatten(df, "case_id", "doc", S.CALL, S.CALL_TABLES).select("case_id", "entity", "parent_pos", "pos").collect()}
    assert got == {(0, "caller", 0, 1), (6, "phase", 1, 1), (6, "slot", 1, 2)}
    assert S.flatten(df.limit(0), "case_id", "doc", S.CALL, S.CALL_TABLES).count() == 0
    levels = S.shred_levels(df, "case_id", "doc", S.CALL).where("case_id = 5").collect()
    assert len(levels) == 5 and {r.definition for r in levels} == {1}


def test_null_and_large_keys(spark):
    big = 2**62 + 1
    df = spark.createDataFrame([(big, '{"input":{"caller":{"agent_id":"a"}}}'), (None, '{"input":{"caller":{"agent_id":"b"}}}')], "case_id long, doc string")
    assert {(r.case_id, r.value) for r in S.flatten(df, "case_id", "doc", S.CALL, S.CALL_TABLES).collect()} == {(big, "a"), (None, "b")}
