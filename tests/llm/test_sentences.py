import random

from samples import awkward, documents, prose

from tillcast.llm import sentences


def cleaned(spark, rows):
    found = sentences.remove_repeats(documents(spark, rows)).collect()
    return {r.doc_id: r for r in found}


def plain_cut(text):
    """Sentences of a text none of which is too long: one character after the other."""
    parts, part, i = [], "", 0
    while i < len(text):
        part += text[i]
        stop = text[i] in ".!?\u2026\u3002"
        i += 1
        if part[-1] == "\n":
            while i < len(text) and text[i].isspace():
                part, i = part + text[i], i + 1
            parts, part = [*parts, part], ""
        elif stop and i < len(text) and text[i] == " ":
            while i < len(text) and text[i] == " ":
                part, i = part + text[i], i + 1
            parts, part = [*parts, part], ""
    return [*parts, part] if part else parts


def plain_spans(parts):
    """Every run of sentences that is a span, by trying all: (first, end, its words)."""
    plain = [p.lower().split() for p in parts]
    at = [i for i, p in enumerate(plain) if p]
    out = set()
    for a in range(len(at)):
        for b in range(a + 1, len(at) + 1):
            size = sum(len(plain[i]) for i in at[a:b])
            last, first = len(plain[at[b - 1]]), len(plain[at[a]])
            runs = b - a == sentences.RUN and size >= sentences.FEWEST_WORDS
            dense = b - a < sentences.RUN and size >= sentences.LONG_WORDS > size - last
            sparse = b - a > sentences.RUN and size >= sentences.FEWEST_WORDS
            if runs or dense or sparse and sentences.FEWEST_WORDS > min(size - last, size - first):
                out.add((a, b))
    if at and not out and sum(map(len, plain)) >= sentences.FEWEST_WORDS:
        out.add((0, len(at)))
    return [(at[a], at[b - 1] + 1, tuple(w for i in at[a:b] for w in plain[i])) for a, b in sorted(out)]


def plain_removal(rows):
    """The definition, over all documents at once: rows of (doc_id, text) without repeated ids."""
    cuts = {d: plain_cut(t or "") for d, t in rows}
    holders, out = {}, {}
    for d, parts in cuts.items():
        for _, _, digest in plain_spans(parts):
            holders.setdefault(digest, set()).add(d)
    for d, parts in cuts.items():
        drop, seen = set(), {}
        for a, b, digest in plain_spans(parts):
            if min(holders[digest]) < d:
                drop |= set(range(a, b))
            if digest in seen:
                drop |= set(range(max(a, seen[digest]), b))
            else:
                seen[digest] = b
        out[d] = "".join(p for i, p in enumerate(parts) if i not in drop)
    return out


def test_cut_loses_nothing():
    for text in ("", " \n ", "One. Two! Three?\nFour", prose(1, 5000).replace(".", ""), "a" * 10_000, ". . ."):
        assert b"".join(sentences.cut(text.encode())) == text.encode()
    assert max(len(s.split()) for s in sentences.cut(prose(1, 5000).replace(".", "").encode())) < 400


def test_spans_cover_every_sentence_of_a_passage():
    passage = sentences.cut(prose(3, 120).encode())
    covered = {i for a, b, _ in sentences.spans(passage) for i in range(a, b)}
    assert covered == set(range(len(passage)))
    inside = sentences.cut((prose(4, 40) + ". " + prose(3, 120) + "\n" + prose(5, 40)).encode())
    shared = {d for *_, d in sentences.spans(passage)} & {d for *_, d in sentences.spans(inside)}
    assert len(shared) >= len(passage) - 4


def test_passage_stays_in_the_first_document_only(spark):
    passage = prose(50, 70) + "."
    rows = [(i, f"{prose(i, 60)}.\n{passage}\n{prose(100 + i, 60)}.") for i in range(12)]
    found = cleaned(spark, rows)
    assert passage in found[0].text and found[0].n_removed == 0
    for i in range(1, 12):
        assert found[i].text == f"{prose(i, 60)}.\n{prose(100 + i, 60)}."


def test_equals_the_definition(spark):
    pieces = [prose(i, 15 + 5 * i) + ("." if i % 2 else "\n") for i in range(14)]
    rows = [
        (i, " ".join(pieces[(i * k + k * k) % 14] for k in range(1, 6)) + " " + prose(1000 + i, 40))
        for i in range(40)
    ]
    found = cleaned(spark, rows)
    assert {d: r.text for d, r in found.items()} == plain_removal(rows)


def test_spans_equal_the_definition():
    draw = random.Random(5)
    for i in range(300):
        text = "".join(
            " ".join(f"w{draw.randrange(9)}" for _ in range(draw.choice((1, 2, 4, 9, 17, 30)))) + draw.choice((". ", "! ", "\n", ".\n\n"))
            for _ in range(draw.randrange(12))
        )
        parts = plain_cut(text)
        assert [p.encode() for p in parts] == sentences.cut(text.encode())
        found = [(a, b) for a, b, _ in sentences.spans(sentences.cut(text.encode()))]
        assert found == [(a, b) for a, b, _ in plain_spans(parts)], i


def test_sentences_stay_whole(spark):
    """What is removed ends at the ends of sentences, unless these have over LONGEST words."""
    rows = [(i, " ".join(prose(k, 25 + k) + "." for k in (i % 5, 90 + i, i % 3, 50 + i % 4))) for i in range(30)]
    assert max(len(p.split()) for _, t in rows for p in plain_cut(t)) <= sentences.LONGEST
    for i, r in cleaned(spark, rows).items():
        whole = {p.strip() for p in plain_cut(rows[i][1])}
        assert {p.strip() for p in plain_cut(r.text)} <= whole and (i < 5 or r.n_removed > 0)


def test_hot_spans_and_others_alike(spark):
    """A span of all documents goes by the broadcast, with few spans everything repeated does."""
    rows = [(i, f"{prose(7, 60)}.\n" + "\n".join(prose(100 + i // 2 * 40 + k, 30) + "." for k in range(40))) for i in range(60)]
    assert {d: r.text for d, r in cleaned(spark, rows).items()} == plain_removal(rows)


def test_awkward_rows(spark):
    rows = awkward()
    docs = documents(spark, rows)
    found = sentences.remove_repeats(docs).collect()
    assert len(found) == len(rows)
    assert sentences.remove_repeats(docs).columns == [*docs.columns, "n_sentences", "n_removed"]
    texts = {}
    for r in found:
        texts.setdefault(r.doc_id, []).append(r.text)
    assert texts[1] == [rows[0][1]] and texts[2] == ["", ""] and sorted(texts[None], key=str) == ["", None]
    assert texts[4] == [None] and texts[5] == [""] and texts[6] == [" \n\t "] and texts[9] == [rows[10][1]]
    assert sentences.remove_repeats(documents(spark, [])).count() == 0


def test_text_that_repeats_itself(spark):
    text = prose(7, 60) + ".\n"
    assert cleaned(spark, [(1, text * 4)])[1].text == text


def test_passages_inside_long_sentences_share_spans():
    for words in (50, 55, 70):
        for i in range(200):
            passage = prose(i, words, 3000).replace(".", "").lower()
            a, b = (prose(k * 1000 + i, n, 3000).replace(".", "") for k, n in ((1, i % 31), (2, i % 37)))
            # Each of these is one sentence of over LONGEST words.
            texts = [f"{a} {passage} {b}.", f"{b} {passage} {a}", f"{passage}\n{a}"]
            found = [{d for *_, d in sentences.spans(sentences.cut(t.encode()))} for t in texts]
            assert found[0] & found[1] and found[0] & found[2], (words, i)
