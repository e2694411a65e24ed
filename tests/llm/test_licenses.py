from samples import awkward, documents, prose

from tillcast.llm import licenses


def found_in(spark, rows, templates=licenses.TEMPLATES):
    return {(r.doc_id, r.license): r for r in licenses.scan(documents(spark, rows), templates).collect()}


def by_hand(rows, templates=licenses.TEMPLATES):
    def runs(text):
        w = licenses.plain(text or "")
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}

    return {
        (d, name)
        for d, text in rows
        for name, t in templates
        if len(runs(t) & runs(text)) >= licenses.CONTAINED * len(runs(t))
    }


def test_every_template_is_found_wherever_it_stands(spark):
    rows = []
    for i, (_, text) in enumerate(licenses.TEMPLATES):
        for shift in range(5):
            rows.append((10 * i + shift, f"{prose(i, 20 + shift)} {text.upper()}; {prose(99, 30)}"))
    rows += [(900, "Licensed under whatever"), (901, prose(5, 400)), (902, "the MIT license the MIT License")]
    assert set(found_in(spark, rows)) == by_hand(rows)


def test_changed_words(spark):
    rows = []
    for i, (_, text) in enumerate(licenses.TEMPLATES):
        words = text.split()
        for at in range(0, len(words), 2):
            rows.append((100 * i + at, " ".join([*words[:at], "other", *words[at + 1 :], prose(i, 30)])))
    assert set(found_in(spark, rows)) == by_hand(rows)


def test_own_templates_and_bounds(spark):
    own = [("house", "this text belongs to the house and must stay inside the house")]
    rows = [(1, "so: This text belongs to the house, and must stay inside the house!"), (2, prose(1, 50))]
    assert set(found_in(spark, rows, own)) == {(1, "house")}
    assert licenses.BANDS >= 10 and 1 - (1 - licenses.ALIKE**licenses.ROWS) ** licenses.BANDS >= licenses.MEET
    assert licenses.scan(documents(spark, rows), []).count() == 0


def test_awkward_rows(spark):
    text = "Released under the MIT License."
    rows = [*awkward(), (50, text), (50, text), (None, text), (51, text + " " + prose(1, 20_000, 2000))]
    got = licenses.scan(documents(spark, rows)).collect()
    assert sorted(((r.doc_id, r.license) for r in got), key=str) == [(50, "MIT"), (51, "MIT"), (None, "MIT")]
    assert licenses.scan(documents(spark, [])).count() == 0
