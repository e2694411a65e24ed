from samples import awkward, documents, prose, repeated_words, table, words

from tillcast.llm import fertility, queries


def dup_lines(text):
    seen, n = set(), 0
    for line in (text or "").split("\n"):
        n += line in seen
        if words(line):
            seen.add(line)
    return n


def base(text):
    found = words(text)
    n, again = len(found), repeated_words(text)
    return (
        n, sum(map(len, found)), sum((text or "").count(c) for c in "#*$%&|<>"), dup_lines(text), again,
        n < 20 or 100 * again > 30 * n,
    )


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_base_columns_of_the_query(spark):
    from samples import SMALL

    found = queries.QUERIES["op4_fertility"](spark, SMALL).toPandas().set_index("doc_id")
    texts = table("documents").set_index("doc_id").text
    assert len(found) == len(texts)
    for doc_id, text in texts.items():
        assert tuple(found.loc[doc_id, COLUMNS]) == base(text), doc_id
    assert not found.kept[found.base_failed].any()


def test_measures_equal_the_tokenizer_on_whole_texts(spark):
    import math
    from collections import Counter

    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=fertility.VOCABULARY)
    text = prose(8, 300) + " 語語 ¤¤¤"
    got = fertility.rate(documents(spark, [(1, text)]), ["doc_id"]).first()
    pieces = model.encode(" ".join(text.split()))
    assert got.n_tokens == len(pieces)
    assert abs(got.fallback_share - sum(map(model.is_byte, pieces)) / len(pieces)) < 1e-12
    share = [n / len(pieces) for n in Counter(pieces).values()]
    assert abs(got.token_entropy + sum(p * math.log2(p) for p in share)) < 1e-9
    assert abs(got.chars_per_token - sum(map(len, text.split())) / len(pieces)) < 1e-12


def test_bands_reject_junk_and_keep_prose(spark):
    good = [(i, prose(i, 80 + i % 60)) for i in range(120)]
    junk = [(1000 + i, prose(i, 120).upper().replace(" ", "!! ")) for i in range(10)]
    found = fertility.rate(documents(spark, good + junk), ["doc_id"]).toPandas().set_index("doc_id").kept
    assert found[found.index < 1000].all() and not found[found.index >= 1000].any()


def test_awkward_rows(spark):
    rows = awkward()
    docs = documents(spark, rows)
    found = fertility.rate(docs, ["doc_id", "text", "kept"]).toPandas()
    assert len(found) == len(rows)
    for r in found.itertuples():
        assert tuple(getattr(r, c) for c in COLUMNS) == base(r.text if isinstance(r.text, str) else None)
    kept = fertility.keep_good(docs).toPandas()
    assert list(kept.columns) == docs.columns and set(kept.kept) == {"f"}
    assert fertility.keep_good(documents(spark, [])).count() == 0


def test_strings_of_digits_and_rare_languages_are_judged(spark):
    import hashlib

    def dump(i):
        return " ".join(hashlib.sha256(f"{i} {k}".encode()).hexdigest() for k in range(40))

    good = [(i, prose(i, 80 + i % 60)) for i in range(120)]
    junk = [(1000 + i, dump(i)) for i in range(5)] + [(2000 + i, dump(50 + i), "xx", "s0") for i in range(5)]
    found = fertility.rate(documents(spark, good + junk), ["doc_id"]).toPandas().set_index("doc_id").kept
    assert found[found.index < 1000].all() and not found[found.index >= 1000].any()


def test_equal_words_in_any_order_measure_the_same():
    """Measures by word are sums over the pieces in one order, so that permuted texts agree to the bit."""
    meter = fertility.Meter(fertility.VOCABULARY)
    found = prose(21, 400).split()
    names = ("n_tokens", "chars_per_token", "fallback_share", "token_entropy")
    at = [fertility.NAMES.index(c) for c in names]
    for n in range(50, 400, 50):
        got, back = meter(" ".join(found[:n]).encode()), meter(" ".join(found[:n][::-1]).encode())
        assert [got[i] for i in at] == [back[i] for i in at]
