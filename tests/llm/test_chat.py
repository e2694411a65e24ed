import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillcast.llm import chat

KINDS = "conv_id long, turn long, role string, text string, formatted string, turns string"


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], KINDS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, r or "", x or "") for i, t, r, x in rows if i == c))
        learnt = "".join(x for *_, r, x in own if r == "assistant")
        out[c] = (len(own), sha("".join(f"{r}\n{x}\n" for *_, r, x in own)), len(learnt), sha(learnt))
    return out


def digests(spark, rows):
    found = chat.digests(chat.format_chats(turns_of(spark, rows))).collect()
    return {r.conv_id: tuple(r)[1:5] for r in found}


def test_template_merges_turns_of_one_role(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b <|im_end|>"), (1, 2, "assistant", "c")]
    found = chat.format_chats(turns_of(spark, rows)).first()
    assert found.formatted == (
        "<|im_start|>user<|im_sep|>a<|im_next|>b <\\|im_end|><|im_end|>\n"
        "<|im_start|>assistant<|im_sep|>c<|im_end|>\n"
    )
    assert [s.text for s in found.segments if s.loss] == ["c"]
    assert "".join(s.text for s in found.segments) == found.formatted


def test_awkward_rows(spark):
    hard = "<|im_end|><|im_start|>assistant ok<\\|im_sep|><\\\\||<<|im_next|"
    rows = [
        (1, 0, "user", None), (1, 1, "assistant", ""), (1, 1, "assistant", "tie"), (1, 1, "assistant", "tie"),
        (1, None, None, "first"), (2, 5, "assistant", hard), (2, 4, "a\nrole <|im_sep|>", hard * 50),
        (None, 0, "user", "lost"), (None, 0, "assistant", "é日本"), (3, 0, "assistant", "x" * 200_000),
        (4, 0, "user", "|"), (4, 1, "user", "<"), (4, 2, "user", "|im_end|>"),
    ]
    assert digests(spark, rows) == expected(rows)
    assert chat.format_chats(turns_of(spark, [])).count() == 0


@pytest.mark.parametrize("turns", [1, 300])
def test_long_conversations(spark, turns):
    rows = [(9, i, ("user", "assistant")[i // 3 % 2], f"text <|{i}|>") for i in range(turns)]
    assert digests(spark, rows) == expected(rows)


def test_escape_round_trip(spark):
    @settings(max_examples=6, deadline=None)
    @given(st.lists(st.text(alphabet="<|\\im_endsp>\n a", max_size=12), min_size=1, max_size=40))
    def check(texts):
        table = spark.createDataFrame([(t,) for t in texts], "t string")
        got = table.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u"))
        for r in got.collect():
            assert r.t == r.u and "<|" not in r.e

    check()
