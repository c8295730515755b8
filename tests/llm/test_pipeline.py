import corpus_pipeline as P
from lamella.session import cut, ship, table
from tests.conftest import SF
from tests.llm.brute import groups, shingle_set
from tests.llm.test_decontam import brute as contaminated
from tests.llm.test_lines import brute as repeated


def test_stages(spark):
    ship(spark)
    docs = table(spark, SF, "documents")
    labels = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    read = lambda df: {r.doc_id: r.text for r in df.collect()}
    before, made = read(docs), {}
    for name, stage in P.STAGES:
        docs = cut(stage(spark, docs, SF))
        if name == "packing":
            break
        assert docs.columns == table(spark, SF, "documents").columns
        after = read(docs)
        made[name] = (before, after)
        before = after
    first, kept = made["toxicity"]
    clean = [i for i in first if labels.get(i) == 0]
    assert sum(i not in kept for i in clean) <= 1 and sum(i not in kept for i in first if labels.get(i) == 1) >= 20
    first, kept = made["line_dedup"]
    gone = repeated(list(first.items()))
    assert kept.keys() == first.keys()
    assert sum(kept[i] != "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get(i, [])) for i, t in first.items()) <= 1
    first, kept = made["near_dedup"]
    root = groups({i: shingle_set(t) for i, t in first.items()}, 80)
    assert sorted(kept) == sorted(i for i in first if root[i] == i)
    first, kept = made["decontamination"]
    assert sorted(map(str, kept)) == sorted(i for i, _, n, _ in contaminated(list(first.items()), items) if not n)
    pieces = docs.toPandas()
    assert set(pieces["doc_id"]) == set(before) and pieces.groupby("sequence_id")["length"].sum().max() <= 4096


def test_odd_rows(spark):
    """Nulls, empty texts, repeats, repeated ids, an extra column with a clashing name, and an empty table, through all stages."""
    ship(spark)
    same = " ".join(f"w{n}" for n in range(40))
    rows = [(1, None), (2, ""), (3, " \n\t\n"), (4, same), (4, same), (5, same + " more"), (5, "five has another text as well"), (None, "no id here, but words enough"), (None, same), (6, "line one stands here\nline one stands here"), (7, "you idiot, you idiot, you moron!"), (8, "x" * 50_000)]
    # Ids without labels, so that the grammar's own weights judge.
    docs = spark.createDataFrame([(None if i is None else -i, t, "en", "web", len(t or ""), "clash") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, mark string")
    kept = {}
    for name, stage in P.STAGES:
        empty = stage(spark, docs.limit(0), SF)
        assert empty.count() == 0
        docs = cut(stage(spark, docs, SF))
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "mark"] == empty.columns
            kept[name] = [(str(r.doc_id).removeprefix("-"), r.text) for r in docs.collect()]
    texts = [(str(i), t) for i, t in rows]
    assert sorted(map(str, kept["toxicity"])) == sorted(str(r) for r in texts if r[0] != "7")
    lines = {"6": "line one stands here"}
    after = [(i, lines.get(i, t)) for i, t in texts if i != "7"]
    # The smaller id, -5, comes first.
    after = [("4", "") if r == ("4", same) else r for r in after]
    assert sorted(map(str, kept["line_dedup"])) == sorted(map(str, after))
    assert sorted(map(str, kept["near_dedup"])) == sorted(map(str, (r for r in after if r[0] != "None" or r[1] != same)))
    assert sorted(map(str, kept["decontamination"])) == sorted(map(str, kept["near_dedup"]))
    pieces = docs.collect()
    assert sorted(str(p.doc_id).removeprefix("-") for p in pieces if p.start == 0) == sorted(i for i, _ in kept["decontamination"])
