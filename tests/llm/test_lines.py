from tessera.llm import lines


def table(docs):
    rows = [(k, f"own line {k}\n boiler \nrare", f"s{k % 12}") for k in range(12)]
    rows += [(20, "boiler\n\nboiler", "s1"), (21, "nine", "s0"), *((30 + k, "nine", f"s{k}") for k in range(9)), (40, None, "s1"), (41, "", None), (None, "boiler\nx", "s2"), (12, "boiler", None)]
    return docs(rows)


def test_removes_beyond_the_first_place(docs):
    got = {(r["doc_id"], r["text"], r["_ld_lines"], r["_ld_removed"]) for r in lines.clean(table(docs)).collect()}
    assert (0, "own line 0\n boiler \nrare", 3, 0) in got
    assert (1, "own line 1", 3, 2) in got  # "rare" is on 12 sites too
    assert (20, "", 3, 2) in got and (None, "x", 2, 1) in got
    assert (21, "nine", 1, 0) in got and (30, "nine", 1, 0) in got  # nine sites are not ten
    assert (40, None, 0, 0) in got and (41, "", 1, 0) in got and (12, "", 1, 1) in got


def test_pipeline_form(docs):
    t = table(docs)
    out = lines.cleaned(t)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == t.columns and 20 not in rows and 12 not in rows and 40 in rows and 41 in rows
    assert rows[1]["n_chars"] == len(rows[1]["text"])


def test_exact_band_and_sketches_agree(docs, monkeypatch):
    t = table(docs)
    found = []
    for margin in (0.25, 5.0, 0.0):  # by both, by exact counts, by sketches alone
        monkeypatch.setattr(lines, "MARGIN", margin)
        found.append(sorted((r["doc_id"] or -1, r["text"] or "") for r in lines.clean(t).collect()))
    assert found[0] == found[1] == found[2]


def test_first_place_is_kept_once_within_a_document(docs):
    d = docs([(k, "same\nsame\nsame", f"s{k}") for k in range(10)])
    assert sorted(r["text"] for r in lines.clean(d).collect()) == [""] * 9 + ["same"]


def test_odd_rows(odd, empty):
    assert lines.clean(odd).count() == 10 and lines.cleaned(odd).count() == 10
    assert lines.clean(empty).count() == 0
