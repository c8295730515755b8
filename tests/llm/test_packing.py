import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lamella.llm import queries as Q
from lamella.llm.packing import ChunkTokenizer, pack_documents, shortest_pack_first
from lamella.session import ship
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def full():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(Q.tokenizer_path())


def fits(frame, sequence=4096):
    for _, own in frame.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert list(own["offset"]) == list(np.cumsum([0, *own["length"][:-1]]))
        assert own["length"].sum() <= sequence


def test_query(spark, full):
    ship(spark)
    got = Q.op9_packing(spark, SF_SMALL).toPandas()
    fits(got)
    for row in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect():
        ids = np.array([*full.encode(row.text or "", add_special_tokens=False).ids, 2], "<u4")
        own = got[got.doc_id == row.doc_id].sort_values("start")
        assert own["length"].sum() == len(ids) and (own["doc_tokens"] == len(ids)).all()
        for p in own.itertuples():
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    sequences = got["sequence_id"].nunique()
    assert sorted(got["sequence_id"].unique()) == list(range(sequences))
    assert got["length"].sum() > 0.97 * 4096 * (sequences - 1)


TEXTS = ["", " ", "It's 5 o'clock; don't!", "İstanbul ǅ ﬁ ½ x² Σας ΟΔΟΣ", "e\u0301te\u0301 \u0300x", "a\x1cb\u2028c\u00a0d\x0be\x85f", "<|endoftext|> a<|startoftext|>b", "naïve ÀÉÎ ß ×÷ ÿ", "日本語のテキスト 🤦🏼‍♂️", "x" * 5000, "'s 't 'sabc''d ..'ll", "\r\n\t mixed\tblanks \n"]


def test_tokens_of_odd_texts(full):
    import pyarrow as pa

    from lamella.llm.text import column_bytes

    ids, bounds = ChunkTokenizer(Q.tokenizer_path()).encode(*column_bytes(pa.array([*TEXTS, None])))
    for n, text in enumerate([*TEXTS, ""]):
        assert list(ids[bounds[n] : bounds[n + 1]]) == [*full.encode(text, add_special_tokens=False).ids, 2], text


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text(st.sampled_from("aBcé É'std.,!5<|>\n\tßſK½\u0301"), max_size=40), max_size=5))
def test_tokens(texts):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from lamella.llm.text import column_bytes

    whole = Tokenizer.from_file(Q.tokenizer_path())
    ids, bounds = ChunkTokenizer(Q.tokenizer_path()).encode(*column_bytes(pa.array(texts, pa.string())))
    for n, text in enumerate(texts):
        assert list(ids[bounds[n] : bounds[n + 1]]) == [*whole.encode(text, add_special_tokens=False).ids, 2]


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=20))
def test_patterns_place_every_piece_once(histogram):
    places = shortest_pack_first(histogram, 64)
    seen = {}
    spans = []
    for length, first, ranks, base, offset in places:
        assert offset + length <= 64
        seen.setdefault(length, []).append((first, first + ranks))
        spans.append((base, base + ranks, offset, offset + length))
    for length, own in seen.items():
        own.sort()
        assert [a for a, _ in own] == [0, *[z for _, z in own[:-1]]] and own[-1][1] == histogram[length]
    assert set(seen) == set(histogram)
    for i, (a, z, s, e) in enumerate(spans):
        assert all(z2 <= a or z <= a2 or e2 <= s or e <= s2 for a2, z2, s2, e2 in spans[:i])


def test_odd_rows_and_ids(spark):
    rows = [(1, None), (None, "word " * 50), (2, ""), (3, "again"), (3, "again"), (4, "long text of words " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as start", "2 as length")
    got = pack_documents(df, Q.tokenizer_path()).toPandas()
    fits(got)
    assert got.groupby("doc_id", dropna=False)["length"].sum().to_dict()[1] == 1
    assert len(got[got.doc_id == 3]) == 2
    for p in got.itertuples():
        assert zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), Q.tokenizer_path()).count() == 0


def test_equal_hashes_are_not_equal_chunks(full, monkeypatch):
    """Ids stay right if chunks of many kinds share a hash, within a block and in the cache."""
    import pyarrow as pa

    from lamella.llm import text as X

    monkeypatch.setattr(X, "hash_spans", lambda raw, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(3))
    tokenizer = ChunkTokenizer(Q.tokenizer_path())
    for texts in (TEXTS, ["one two six", "abc def one", "İst x²"], TEXTS):
        ids, bounds = tokenizer.encode(*X.column_bytes(pa.array(texts)))
        for n, text in enumerate(texts):
            assert list(ids[bounds[n] : bounds[n + 1]]) == [*full.encode(text, add_special_tokens=False).ids, 2], text
