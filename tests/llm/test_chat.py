"""Chat formatting: exact round trips, and a row-by-row version beside it."""

from __future__ import annotations

import random
import re
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from parcelwatch.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string"
PIECES = ["\\", "#", "##", "###", "</turn>", "</turn>\n", "<", ":", ": ", "### assistant: ", "a", "é", "\U0001f600", "\n", " "]


def plain_turn(role, text):
    text = re.sub(r"\\|#(?=##)|<(?=/turn>)", lambda m: "\\" + m[0], text)
    role = re.sub(r"\\|:|#(?=##)|<(?=/turn>)", lambda m: "\\" + m[0], role)
    return f"### {role}: ", text, "</turn>\n"


def plain_report(rows):
    """conv_id: (turns, digest, characters under the mask, digest, formatted characters)."""
    order = lambda r: tuple((v is not None, v if v is not None else 0) for v in r[1:])
    grouped = defaultdict(list)
    for row in sorted(rows, key=order):
        grouped[row[0]].append((row[2] or "", row[3] or ""))
    out = {}
    for conv, turns in grouped.items():
        answers = "".join(t for r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        n = sum(len(part) for turn in turns for part in plain_turn(*turn))
        out[conv] = (len(turns), sha256(said.encode()).hexdigest(), len(answers), sha256(answers.encode()).hexdigest(), n)
    return out


def reported(df):
    found = chat.read_back(chat.format_conversations(df)).collect()
    out = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in found}
    assert len(out) == len(found)
    return out


def random_rows(n, seed):
    rng = random.Random(seed)
    some = lambda k: "".join(rng.choices(PIECES, k=rng.randrange(k)))
    roles = ["user", "assistant", "assistant", "system", None, "", "a: b", "as\\sistant", "###", "x</turn>"]
    return [(rng.choice([*range(40), None]), rng.choice([*range(6), None]), rng.choice(roles), rng.choice([None, some(9), some(40)])) for _ in range(n)]


def test_turns_survive_a_round_trip():
    rng = random.Random(1)
    for _ in range(300):
        turns = [("".join(rng.choices(PIECES, k=rng.randrange(6))), "".join(rng.choices(PIECES, k=rng.randrange(12)))) for _ in range(rng.randrange(1, 6))]
        octets, ends, spans = chat.assemble(*(pa.array(side, pa.string()) for side in zip(*turns, strict=True)))
        formatted = octets.tobytes().decode()
        assert formatted == "".join(part for turn in turns for part in plain_turn(*turn))
        assert chat.parse(formatted) == turns
        assert [octets[a:b].tobytes().decode() for a, b in spans] == [plain_turn(*t)[1] for t in turns]
        assert ends[-1] == len(octets)
        # no marker of the template but the template's own
        assert len(re.findall(r"(?<!\\)(?:\\\\)*### ", formatted)) == len(turns)


def test_slices_of_columns_are_read_where_they_lie():
    roles, texts = pa.array(["x", None, "user", "assistant", "y"]), pa.array(["no", "no", "a#", None, "no"])
    octets, ends, spans = chat.assemble(roles.slice(2, 2), texts.slice(2, 2))
    assert octets.tobytes() == b"### user: a#</turn>\n### assistant: </turn>\n"
    assert ends.tolist() == [20, 43] and spans.tolist() == [[10, 12], [35, 35]]


def test_bytes_that_are_no_conversation_are_refused():
    none = np.zeros((0, 2), np.int64)
    for text in (b"### user: a", b"user: a</turn>\n", b"### user a</turn>\n", b"### a: b</turn>\nx"):
        with pytest.raises(ValueError, match="formatted"):
            chat.dissect(np.frombuffer(text, np.uint8), none)


@pytest.mark.parametrize("part, at_a_time", [(1 << 20, 4 << 20), (60, 4 << 20), (200, 150), (1, 1)])
def test_report_matches_plain_formatting(spark, monkeypatch, part, at_a_time):
    monkeypatch.setattr(chat, "PART_BYTES", part)
    monkeypatch.setattr(chat, "SLICE_BYTES", at_a_time)
    rows = random_rows(700, 2)
    assert reported(spark.createDataFrame(rows, SCHEMA)) == plain_report(rows)


def test_a_long_conversation_is_cut_between_turns(spark, monkeypatch):
    """One conversation with most turns, and a turn that is longer than a part."""
    monkeypatch.setattr(chat, "PART_BYTES", 5000)
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} ###") for i in range(3000)]
    rows += [(1, 3000, "assistant", "\\#" * 40_000), (2, 0, "user", None), (3, 0, "assistant", "x" * 20_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    made = chat.format_conversations(df).collect()
    parts = sorted((r.part, r) for r in made if r.conv_id == 1)
    assert len(parts) > 10 and [p for p, _ in parts] == sorted({p for p, _ in parts})
    assert sum((chat.parse(r.formatted) for _, r in parts), []) == [(r[2], r[3]) for r in rows[:3001]]
    for _, r in parts:
        answers = [t for role, t in chat.parse(r.formatted) if role == "assistant"]
        assert [plain_turn("", t)[1] for t in answers] == [r.formatted[s.start : s.end] for s in r.loss]
    assert max(len(r.formatted) for _, r in parts[:-1]) < 6000
    assert reported(df) == plain_report(rows)


def test_empty_repeated_and_clashing(spark):
    assert reported(spark.createDataFrame([], SCHEMA)) == {}
    rows = [(1, 0, "user", "same"), (1, 0, "user", "same"), (1, None, None, None), (None, 1, "assistant", "")]
    assert reported(spark.createDataFrame(rows, SCHEMA)) == plain_report(rows)
    odd = spark.createDataFrame([("c", 1, "assistant", "hi", 5, 6)], "c string, n int, who string, said string, part int, loss int")
    found = chat.read_back(chat.format_conversations(odd, "c", "n", "who", "said")).first()
    assert (found.conv_id, found.n_turns, found.loss_chars) == ("c", 1, 2)


def test_query_equals_its_sql(spark):
    from checks.compare import connect, rows_of

    sf = "/root/testdata/sf0.001"
    got = queries.QUERIES["op12_chat_formatting"](spark, sf)
    result = connect(sf).execute(queries.SQL["op12_chat_formatting"])
    names = [d[0] for d in result.description]
    rows = rows_of(got.columns, [tuple(r) for r in got.collect()])
    assert sorted(names) == sorted(got.columns) and rows == rows_of(names, result.fetchall())
    assert got.filter("conv_id = -7").count() == 1
