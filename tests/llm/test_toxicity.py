import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from lamella.llm import queries as Q
from lamella.llm import toxicity as T
from lamella.session import ship, table

SF, SMALL = "/root/testdata/sf0.1", "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    ship(spark)
    got = Q.op4_toxicity(spark, SF)
    assert got.count() == table(spark, SF, "documents").count()
    both = got.join(table(spark, SF, "labels"), "doc_id").toPandas()
    assert (both["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in both["doc_id"]]).all()
    held = both[both["held_out"]]
    assert (held["predicted"] == held["toxic"]).mean() > 0.97
    assert held[held["toxic"] == 1]["predicted"].mean() > 0.9 and held[held["toxic"] == 0]["predicted"].mean() < 0.01
    assert both["score"].between(0, 1).all() and (both["predicted"] == (both["score"] >= 0.5)).all()


TAGS = {"idiot": T.INSULT, "kill": T.THREAT, "you": T.TARGET, "not": T.NEGATION, "said": T.REPORT}


def clause(*words):
    return [(n, TAGS[w], 1.0) for n, w in enumerate(words) if w in TAGS]


def test_grammar():
    mark = lambda *words: [f for _, f, _ in T.clause_matches(clause(*words))]
    assert mark("an", "idiot") == [0]
    assert mark("you", "idiot") == [T.TARGETED]
    assert mark("not", "an", "idiot") == [T.NEGATED]
    assert mark("not", "w", "w", "w", "an", "idiot") == [0]
    assert mark("said", "an", "idiot") == [T.REPORTED]
    assert mark("said", "you", "are", "not", "an", "idiot") == [T.TARGETED | T.NEGATED | T.REPORTED]
    assert mark("kill", "you", "idiot") == [8 | T.TARGETED, T.TARGETED]


def marks_by_rule(words):
    """What the grammar should find, by looking at each match alone."""
    out = []
    for n, w in enumerate(words):
        if w in ("idiot", "kill"):
            bits = T.NEGATED * ("not" in words[max(0, n - 3) : n]) | T.REPORTED * ("said" in words[:n]) | T.TARGETED * ("you" in words[max(0, n - 5) : n + 6])
            out.append(8 * (w == "kill") + bits)
    return out


def all_paths(machine, symbols):
    """Every way through one transducer, by trying all arcs."""
    ways = [(0, 0.0, ())]
    for s in symbols:
        ways = [(a.to, w + a.weight, (*out, a.write)) for state, w, out in ways for a in machine.arcs if a.source == state and a.read == s]
    return [(w, out) for state, w, out in ways if state in machine.ends]


def test_composition_against_paths_of_the_parts():
    """The composed machine has the one path that the transducers have one after the other, with the sum of their weights."""
    rng = random.Random(8)
    words = ["idiot", "kill", "you", "not", "said", "w"]
    parts = [T.weighing(T.INSULT, T.INSULT_WEIGHT), T.weighing(T.THREAT, T.THREAT_WEIGHT), T.negation(), T.reported_speech(), T.target()]
    for n in range(300):
        own = [rng.choice(words if n % 2 else ["idiot", "you", "w", "w", "w", "w"]) for _ in range(rng.randrange(1, 14))]
        ways = [(0.0, tuple(TAGS.get(w, T.OTHER) for w in own))]
        for part in parts:
            ways = [(w + more, out) for w, wrote in ways for more, out in all_paths(part, wrote)]
        got = T.grammar().paths(tuple(TAGS.get(w, T.OTHER) for w in own))
        assert len(ways) == len(got) == 1 and got[0][1] == ways[0][1] and abs(got[0][0] - ways[0][0]) < 1e-9
        found = [f for _, f, _ in T.clause_matches(clause(*own))]
        assert found == marks_by_rule(own)
        assert abs(got[0][0] - sum(T.PRIOR[f] for f in found)) < 1e-9


def test_long_clause():
    own = ["idiot", "w", "w"] * 20_000
    assert [f for _, f, _ in T.clause_matches(clause(*own, "you"))] == [0] * 19_999 + [T.TARGETED]


def test_one_bare_insult_never_decides():
    """Whatever the labels say, the fit stays below even for one insult, and above for two if the labels say so."""
    x = np.zeros((200, T.FEATURES))
    x[:100, 0] = [1.0] * 50 + [np.log2(3)] * 50
    w = T.fit(x, np.repeat([1.0, 0.0], 100))
    assert w[0] + w[-1] <= -T.MARGIN + 1e-6 and w[0] * np.log2(3) + w[-1] > 0
    assert T.PRIOR[0] + T.BIAS < 0 < T.PRIOR[T.TARGETED] + T.BIAS


def plain_scores(rows, model):
    """Scores by regular expressions and the rule for marks, word by word; no lower-casing beyond Python's."""
    out = []
    for text in rows:
        x = np.zeros(T.FEATURES)
        for part in re.split("[.!?;:\n]", (text or "").lower()):
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", part)
            tags, weights = [], []
            for w in words:
                fits = sorted((e.tag, -e.weight) for e in model.lexicon.entries if (w.encode() == e.word if e.whole else w.encode().startswith(e.word)))
                tags.append(fits[0][0] if fits else T.OTHER)
                weights.append(-fits[0][1] if fits else 0.0)
            names = ["idiot", "kill", "you", "not", "said", "w"]
            places = [n for n, t in enumerate(tags) if t in T.MATCHES]
            for n, f in zip(places, marks_by_rule([names[t] for t in tags])):
                x[f] += weights[n]
        z = model.weights[-1] + np.log2(1 + x) @ model.weights[:-1]
        out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
    return np.array(out)


def test_query_against_plain_scores(spark):
    """All documents, with the model that the query learns."""
    ship(spark)
    docs = table(spark, SMALL, "documents")
    model = T.train(docs, table(spark, SMALL, "labels"))
    got = Q.op4_toxicity(spark, SMALL).toPandas().sort_values("doc_id")
    rows = docs.select("doc_id", "text").toPandas().sort_values("doc_id")
    assert got["doc_id"].tolist() == rows["doc_id"].tolist()
    want = plain_scores(rows["text"], model)
    assert np.abs(got["score"] - want).max() < 1e-9 and (got["predicted"] == (want >= 0.5)).all()


def test_clauses_and_spans(spark):
    model = T.Model(T.Lexicon(T.seed_entries()), np.append(T.PRIOR, T.BIAS))
    rows = [(1, "He said so. You idiot!"), (2, "not here; an IDIOT there"), (3, None), (4, ""), (4, ""), (None, "clean words"), (5, "İ you MORON " + "x " * 50_000), (6, "one. " * 1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("lang", F.lit(None).cast("string"))
    got = {(r.doc_id, n): r for n, r in enumerate(T.score_toxicity(df, model).collect())}
    by = {i: r for (i, _), r in got.items()}
    assert len(got) == len(rows)
    for i, word in ((1, "idiot"), (2, "IDIOT"), (5, "MORON")):
        (m,) = by[i].matches
        assert dict(rows)[i][m.start : m.end] == word
    assert by[1].score >= 0.5 > by[2].score > by[3].score and by[3].score == by[4].score == by[6].score < 0.5
    assert by[None].held_out is False
    assert [r.doc_id for r in T.keep_below(df, model).collect()] == [2, 3, 4, 4, None, 6]
    assert T.score_toxicity(df.limit(0), model).count() == 0


def test_learns_unknown_stems(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(5))
    docs, labels = [], []
    for i in range(600):
        words = [word() for _ in range(30)]
        toxic = i % 8 == 0
        if toxic:
            for at in rng.sample(range(30), 3):
                words[at] = "grumph" + word()[:2]
        docs.append((i, " ".join(words)))
        labels.append((i, None, int(toxic)))
    labels += [(1, 0, None), (None, 1, 1), (2, 1, 0)]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = T.train(d, lab)
    assert any(e.word.startswith(b"grump") for e in model.lexicon.entries)
    got = {r.doc_id: r.predicted for r in T.score_toxicity(d, model).collect()}
    assert sum(got[i] != (i % 8 == 0) for i in got) <= 3
    assert T.train(d.limit(0), lab).lexicon and T.train(d, lab.limit(0)).weights[-1] < 0
