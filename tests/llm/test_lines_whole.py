from lamella.llm import lines
from lamella.session import ship
from tests.llm.test_lines import brute


def dropped(spark, rows):
    gone = lines.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    return {r.id: sorted(r.places) for r in gone.collect()}


def test_short_lines(spark):
    ship(spark)
    rows = [(1, "All rights reserved.\nok\n\n  \nseven77\na"), (2, " all RIGHTS reserved.\t\nOK\n\n\t\nseven78\nb"), (3, "é\nÉ\nok\nseven77\n12345678\n123456789"), (4, "é\n12345678\nko\n" + "z" * 23), (5, "\n"), (6, "z" * 22 + "\na")]
    got = dropped(spark, rows)
    assert got == brute(rows, least=1) == {2: [0, 1], 3: [2, 3], 4: [0, 1], 6: [0, 1]}


def test_only_short_lines(spark):
    ship(spark)
    assert dropped(spark, [(1, "ab\nab"), (2, "b\nab")]) == {1: [1], 2: [1]}


def test_repeating_content_of_different_lengths(spark):
    ship(spark)
    texts = ["-" * 40, "-" * 80, "the " * 20, "the " * 60, "=" * 30 + "\n" + "=" * 200, "ab" * 8 + "\n" + "ab" * 500]
    rows = list(enumerate(texts))
    assert dropped(spark, rows) == brute(rows, least=1) == {1: [0], 3: [0], 4: [1], 5: [1]}
