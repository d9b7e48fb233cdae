from tessera.llm import decontam


def test_containment_at_the_threshold(docs, spark):
    item = [f"w{k}" for k in range(24)]  # 20 shingles
    cases = {1: item, 2: item[:20], 3: item[:19], 4: item[:12] + ["x"] + item[12:], 5: ["z"] * 30 + item + ["y"] * 15000}
    d = docs([(k, " ".join(w).upper() if k == 2 else ", ".join(w)) for k, w in cases.items()] + [(None, " ".join(item)), (8, None), (9, ""), (10, "tiny item"), (11, "a tiny item")])
    b = spark.createDataFrame([(0, " ".join(item)), (1, "Tiny item!"), (2, None), (None, "w0 w1 w2 w3 w4")], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["containment"] for r in decontam.contained(d, b).collect()}
    assert got == {(1, 0): 1.0, (2, 0): 0.8, (4, 0): 0.8, (5, 0): 1.0, (10, 1): 1.0, (11, 1): 1.0}
    left = decontam.drop_contaminated(d, b)
    assert sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 3, 8, 9] and left.columns == d.columns


def test_shuffled_sketches_give_the_same(docs, spark, monkeypatch):
    words = [f"v{k}" for k in range(40)]
    d, b = docs([(1, " ".join(words)), (1, "other text of the same id")]), spark.createDataFrame([(0, " ".join(words[5:20]))], "item_id bigint, text string")
    one = decontam.contained(d, b).collect()
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    assert decontam.contained(d, b).collect() == one and len(one) == 1


def test_empty(odd, empty, spark):
    b = spark.createDataFrame([(0, "a b c d e f")], "item_id bigint, text string")
    assert decontam.contained(empty, b).count() == 0 and decontam.contained(odd, b.where("item_id > 3")).count() == 0
    assert decontam.contained(odd, b).count() == 0


def test_short_items_inside_long_documents(docs, spark):
    d = docs([(1, "x " * 500 + "one two three four" + " y" * 500), (2, "one two x three four"), (3, "four"), (4, "two three"), (5, "one two three four five six")])
    b = spark.createDataFrame([(0, "One two, three FOUR."), (1, "four"), (2, "two three"), (3, "one two three four five"), (4, "...")], "item_id bigint, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontam.contained(d, b).collect())
    assert got == [(1, 0), (1, 1), (1, 2), (2, 1), (3, 1), (4, 2), (5, 0), (5, 1), (5, 2), (5, 3)]


def test_shared_openings_make_no_candidates(docs, spark, monkeypatch):
    """400 items with one of four openings, documents with an opening alone: candidates follow items and documents, not their product."""
    openings = [" ".join(f"o{k}{j}" for j in range(8)) for k in range(4)]
    items = [(k, f"{openings[k % 4]} " + " ".join(f"i{k}w{j}" for j in range(10))) for k in range(400)]
    d = docs([(k, f"{openings[k % 4]} " + " ".join(f"d{k}w{j}" for j in range(30))) for k in range(200)] + [(1000 + k, "a b " + items[k][1] + " c") for k in range(0, 400, 40)])
    b = spark.createDataFrame(items, "item_id bigint, text string")
    seen, cut = [], decontam.cut

    def counted(df):
        out = cut(df)
        if out.columns == ["doc_id", "item_id"]:
            seen.append(out.count())
        return out

    monkeypatch.setattr(decontam, "cut", counted)
    got = sorted((r["doc_id"], r["item_id"]) for r in decontam.contained(d, b).collect())
    assert got == [(1000 + k, k) for k in range(0, 400, 40)] and seen == [10]
