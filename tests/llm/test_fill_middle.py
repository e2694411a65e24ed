import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from samples import awkward, documents, prose

from tillcast.llm import fill_middle
from tillcast.llm.fill_middle import Sequence, WaveletMatrix

UNIT = re.compile("[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text, seed=42, rate=50, spm_rate=80):
    """n, form, prefix_chars, middle_chars and output by the definition."""
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, None)))
    if h[3] % 100 < spm_rate:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 7), max_size=300))
def test_ranks(symbols):
    matrix = WaveletMatrix(np.array(symbols, np.uint8), 3)
    places = np.arange(len(symbols) + 1)
    for s in range(8):
        want = np.cumsum([0] + [x == s for x in symbols])
        assert matrix.rank(s, places).tolist() == want.tolist()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab é日𝄞\n\t ", max_size=80), min_size=1, max_size=4), st.randoms())
def test_cuts(texts, draw):
    found, units = Sequence([t.encode() for t in texts]), [UNIT.findall(t) for t in texts]
    assert found.units().tolist() == [len(u) for u in units]
    wanted = [draw.randint(0, len(u)) for u in units]
    places = found.cuts(np.array(wanted))
    parts = ["".join(u[:k]) for u, k in zip(units, wanted)]
    assert (places - found.starts).tolist() == [len(p.encode()) for p in parts]
    assert (found.characters(places) - found.characters(found.starts)).tolist() == [len(p) for p in parts]


def rows_of(found):
    return sorted(
        (tuple(None if x != x else x for x in r) for r in found.toPandas().itertuples(index=False)), key=repr
    )


def test_equals_definition(spark, monkeypatch):
    monkeypatch.setattr(fill_middle, "SEQUENCE_BYTES", 700)  # several sequences a batch
    draw, rows = random.Random(3), awkward()
    marks = ["<P> inside", "ends with <", "<S", "a <M> b", " lead", "trail \n", "é" * 40, "<<P", "x"]
    rows += [(100 + i, t) for i, t in enumerate(marks)]
    rows += [(200 + i, prose(i, draw.randint(1, 80)) + draw.choice(["", "\n", " <", "日"])) for i in range(150)]
    docs = documents(spark, [r[:2] for r in rows])
    found = fill_middle.transform(docs, ["doc_id", "row"], rate=90, spm_rate=50)
    want = sorted(((r[0], "a", *plain(r[0], r[1], rate=90, spm_rate=50)) for r in rows), key=repr)
    assert rows_of(found) == want
    assert {r[3] for r in want} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("rate", [0, 100])
def test_restored(spark, rate):
    rows = [(i, t) for i, (_, t, *_) in enumerate(awkward())]
    rows += [(50 + i, x * 30) for i, x in enumerate(["<", "<P", "<S", "M>", "a<\n", " <M"])]
    docs = documents(spark, rows)
    found = fill_middle.transform(docs, rate=rate)
    back = found.select("doc_id", fill_middle.restore(F.col("output"), F.col("form")).alias("back"))
    assert dict(map(tuple, back.collect())) == {i: t or "" for i, t in rows}
    assert set(docs.columns) < set(found.columns)


def test_very_long_and_empty(spark):
    long = " ".join(f"wörd{i}" for i in range(1_200_000))
    docs = documents(spark, [(1, long), (2, None)], False)
    found = {r["doc_id"]: r for r in fill_middle.transform(docs, ["doc_id"], rate=100).collect()}
    n, form, prefix, middle, output = plain(1, long, rate=100)
    got = found[1]
    assert (got["n"], got["form"], got["prefix_chars"], got["middle_chars"]) == (n, form, prefix, middle)
    assert got["output"] == output and found[2]["form"] == "plain" and found[2]["n"] == 0
    assert fill_middle.transform(docs.limit(0)).count() == 0
