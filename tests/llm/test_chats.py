import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkdlp.llm import catalog, chat_format
from tests.conftest import SF

SCHEMA = "conv_id long, turn long, role string, text string, n long, block string, segments string"


def awkward_turns():
    hostile = chat_format.HOSTILE
    rows = [
        (-1, 0, "user", hostile), (-1, 1, "assistant", hostile),
        (1, 0, "system", "s"), (1, 1, "user", "a\\"), (1, 2, "assistant", "\\[INST] <"),
        (2, 1, "user", None), (2, 2, "assistant", ""), (2, 3, "user", "x" * 300_000),
        (3, 1, None, None), (3, 1, None, None), (3, None, "to\nol\\", "x\ny"), (3, 2, "system", " <<SYS>>\n"),
        (None, 1, "user", "q"), (None, 2, "assistant", "[TURN]</s>[/TURN]"),
        (4, 0, "assistant", "first"), (4, 1, "user", "then"), (5, 7, "user", "same"), (5, 7, "user", "same"),
        (6, 0, "user", "<s><s></s><</SYS>>"), (6, 1, "assistant", "<<SYS>>\\\\[/INST][INST]\n"),
    ]
    rows += [(100, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(90)]
    rows += [(101, i, "system" if i == 41 else ("user", "assistant")[i % 2], f"t{i}") for i in range(91)]
    return [(*r, 1, "clash", "clash") for r in rows]


def by_hand(rows):
    """What each conversation must read back as, in plain Python."""
    chats = {}
    for conv, turn, role, text, *_ in rows:
        chats.setdefault(conv, []).append(((turn is not None, turn or 0), (role is not None, role or ""), text or ""))
    out = {}
    for conv, turns in chats.items():
        turns = [(role, text) for _, (_, role), text in sorted(turns)]
        state, bad = "start", None
        for at, (role, _) in enumerate(turns):
            state = chat_format.INSTRUCTIONS.moves.get((state, role)) if state else None
            if state is None and bad is None:
                bad = at
        learnt = "".join(text for role, text in turns if role == "assistant")
        told = "".join(f"{role}\n{text}\n" for role, text in turns)
        out[conv] = (
            len(turns), hashlib.sha256(told.encode()).hexdigest(), len(learnt),
            hashlib.sha256(learnt.encode()).hexdigest(), bad is None, state == "answered", bad,
        )
    return out


@pytest.mark.parametrize("block", [1024, 16])
def test_read_back_equals_what_was_said(spark, block):
    rows = awkward_turns()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = chat_format.digests(chat_format.formatted(docs, block=block)).drop("formatted_chars").collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == by_hand(rows) and len(got) == len(by_hand(rows))


def test_marks_and_masks(spark):
    rows = [(1, 0, "system", "be brief", 1, "", ""), (1, 1, "user", "hi [INST]", 1, "", ""), (1, 2, "assistant", "yes", 1, "", "")]
    done = chat_format.formatted(spark.createDataFrame(rows, SCHEMA))
    assert done.select(chat_format.joined(F.col("segments"))).first()[0] == "<s><<SYS>>\nbe brief\n<</SYS>>\n\n[INST] hi [\\INST] [/INST] yes</s>"
    assert [s.text for s in done.first().segments if s.loss] == ["yes"]


def test_control_strings_never_survive(spark, texts):
    parts = [*chat_format.INSTRUCTIONS.controls, "\\", "<", "[", "a"]
    docs = texts(*(x + y + z for x in parts for y in parts for z in parts))
    rows = docs.withColumn("e", chat_format.escape(F.col("text"))).withColumn("u", chat_format.unescape(F.col("e"))).collect()
    assert all(r.u == r.text for r in rows)
    assert not [r for r in rows if any(c in r.e for c in chat_format.INSTRUCTIONS.controls)]


def test_unfit_templates_are_refused():
    good = chat_format.INSTRUCTIONS
    make = lambda **new: chat_format.Template(**({f: getattr(good, f) for f in good.__dataclass_fields__ if f != "states"} | new))
    make()
    with pytest.raises(ValueError):
        make(marks={**good.marks, "assistant": (" ", "/s></s>")})
    with pytest.raises(ValueError):
        make(marks={**good.marks, "assistant": (" ", "\n")})
    with pytest.raises(ValueError):
        make(marks={**good.marks, "assistant": ("[INST] ", "</s>")})


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    got = catalog.op11_chat_format(spark, SF)
    want = con.sql(catalog.ORACLES["op11_chat_format"])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in ("Python", "Arrow", "Pandas", "ExistingRDD") if x in plan]


def test_no_conversations(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert chat_format.digests(chat_format.formatted(none)).count() == 0
