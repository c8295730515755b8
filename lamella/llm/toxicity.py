"""Toxicity by a weighted finite-state pattern grammar.

Words are tagged by small lexicons, insults also by stems learned from labels,
and a clause is the string of its words' tags. Five transducers read it: insult
and threat weigh the words that can be meant so, negation marks those in its
scope, reported speech those that someone else is said to have said, and target
those aimed at someone. Composed into one machine they rewrite a clause into its
matches; the weights of the arcs add up along the path. What is scored is the
marked match of a clause, not the word: an insult thrown at "you" and one quoted
or denied are different symbols. A logistic regression fits their weights on
labelled documents, drawn towards the machine's own, and such that one bare
insult never decides by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable, Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm import text as X
from lamella.session import cut

#: Labelled rows that stems and weights are learned from, at most; drawn by a hash of the id.
SAMPLE_ROWS = 10_000
#: Stems are so many bytes of a word's beginning; 0 is the whole word.
STEM_BYTES = (4, 5, 6, 7, 0)
#: Bits of the filter that tells workers which stems are counted.
FILTER_BITS = 1 << 24
#: A learned stem is in so many toxic documents and after so many different words at least.
LEAST_DOCS, LEAST_CONTEXTS, LEAST_LOG_ODDS = 5, 5, 3.0

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = range(6)

#: Seed lexicons, as whole words in lower case; labels confirm, weigh or drop the insults and threats.
SEEDS = {
    INSULT: "idiot idiots moron morons loser losers scum trash stupid worthless pathetic disgusting clown dumb imbecile bastard jerk vermin abschaum vollidiot dummkopf arschloch trottel crétin connard salaud ordure imbécile abruti estúpido basura imbécil idiota escoria",
    THREAT: "kill murder strangle destroy töten umbringen tuer étrangler matar matarte degollar",
    TARGET: "you your yours yourself he she him her they them everyone nobody du dich dir ihr euch sie tu toi vous ils tú usted ustedes ellos",
    NEGATION: "not never no isn't aren't nicht kein keine niemals pas jamais nunca jamás",
    REPORT: "said says called calls claimed wrote quoted reported sagte nannte schrieb dit appelé écrit dijo llamó escribió",
}

#: Marks of a match, as bits.
NEGATED, REPORTED, TARGETED = 1, 2, 4
NEGATION_SCOPE, TARGET_SCOPE = 3, 5
#: Weights of the transducers' arcs, and the score of a text without matches.
INSULT_WEIGHT, THREAT_WEIGHT, NEGATED_WEIGHT, REPORTED_WEIGHT, TARGETED_WEIGHT = 3.4, 2.0, -2.6, -2.2, 2.6
BIAS = -4.0
#: How far below an even score one bare insult stays.
MARGIN = 0.2
FEATURES = 16


@dataclass
class Entry:
    word: bytes
    whole: bool
    tag: int
    weight: float


class Lexicon:
    """Tries of the entries by length, laid out as sorted hashes, with a bit filter before them."""

    def __init__(self, entries: list[Entry]):
        self.entries = entries
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in {0 if e.whole else len(e.word) for e in entries}:
            own = [n for n, e in enumerate(entries) if (0 if e.whole else len(e.word)) == length]
            keys = np.array([X.hash_spans(np.frombuffer(entries[n].word, np.uint8), np.array([0]), np.array([len(entries[n].word)]))[0] for n in own], np.uint64)
            order = np.argsort(keys)
            seen = np.zeros(1 << 14, bool)
            seen[(keys & X.U((1 << 14) - 1)).astype(np.int64)] = True
            self.tables[length] = (keys[order], np.array(own)[order], seen)

    def tag(self, hasher, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers and entries that fit them, by word; a word can fit several."""
        words, fits = [], []
        for length, (keys, entry, seen) in self.tables.items():
            own = np.arange(len(starts)) if length == 0 else np.flatnonzero(ends - starts >= length)
            h = hasher(starts[own], ends[own] if length == 0 else starts[own] + length)
            maybe = np.flatnonzero(seen[(h & X.U((1 << 14) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
            same = keys[at] == h[maybe]
            words.append(own[maybe[same]])
            fits.append(entry[at[same]])
        words, fits = np.concatenate([*words, np.zeros(0, np.int64)]), np.concatenate([*fits, np.zeros(0, np.int64)])
        order = np.lexsort((fits, words))
        return words[order].astype(np.int64), fits[order].astype(np.int64)


def seed_entries() -> list[Entry]:
    return [Entry(w.encode(), True, tag, 1.0) for tag, words in SEEDS.items() for w in words.split()]


# The grammar. A symbol is a tag, with marks if it is an insult or a threat.


def symbol(tag: int, marks: int = 0) -> int:
    return tag | marks << 3


def tag_of(s: int) -> int:
    return s & 7


def feature(s: int) -> int:
    """Number of a match's kind and marks."""
    return (8 if tag_of(s) == THREAT else 0) + (s >> 3)


MATCHES = (INSULT, THREAT)
SYMBOLS = (*(symbol(t, m) for t in MATCHES for m in range(8)), TARGET, NEGATION, REPORT, OTHER)


@dataclass(frozen=True)
class Arc:
    source: int
    read: int
    write: int
    weight: float
    to: int


class Transducer:
    """States from 0, the start; arcs that read a symbol, write one and weigh; and the states a clause may end in."""

    def __init__(self, arcs: Iterable[Arc], ends: Iterable[int]):
        self.arcs, self.ends = tuple(arcs), frozenset(ends)
        self.out: dict[tuple[int, int], list[Arc]] = {}
        for arc in self.arcs:
            self.out.setdefault((arc.source, arc.read), []).append(arc)

    def paths(self, clause: Iterable[int]) -> list[tuple[float, tuple[int, ...]]]:
        """Weight and symbols written of the best path to each way of ending; max and plus for sum and product."""
        best: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        for s in clause:
            after: dict[int, tuple[float, tuple | None]] = {}
            for state, (total, before) in best.items():
                for arc in self.out.get((state, s), ()):
                    if arc.to not in after or total + arc.weight > after[arc.to][0]:
                        after[arc.to] = (total + arc.weight, (before, arc.write))
            best = after
        out = []
        for state, (total, wrote) in best.items():
            if state in self.ends:
                back = []
                while wrote is not None:
                    wrote, last = wrote
                    back.append(last)
                out.append((total, tuple(reversed(back))))
        return out


def built(start: Hashable, step: Callable[[Hashable, int], Iterable[tuple[int, float, Hashable]]], may_end: Callable[[Hashable], bool]) -> Transducer:
    """The transducer with a rule's states and arcs, as far as they can be reached and lead to an end."""
    number, queue, arcs = {start: 0}, [start], []
    for state in queue:
        for s in SYMBOLS:
            for write, weight, to in step(state, s):
                if to not in number:
                    number[to] = len(queue)
                    queue.append(to)
                arcs.append(Arc(number[state], s, write, weight, number[to]))
    ends = {number[state] for state in queue if may_end(state)}
    alive, grown = set(ends), True
    while grown:
        more = {arc.source for arc in arcs if arc.to in alive} - alive
        alive |= more
        grown = bool(more)
    return Transducer((arc for arc in arcs if arc.to in alive), ends)


def compose(one: Transducer, two: Transducer) -> Transducer:
    """The transducer that does what ``two`` does to what ``one`` writes; weights add up."""

    def step(state: tuple[int, int], s: int) -> Iterator[tuple[int, float, tuple[int, int]]]:
        for x in one.out.get((state[0], s), ()):
            for y in two.out.get((state[1], x.write), ()):
                yield y.write, x.weight + y.weight, (x.to, y.to)

    return built((0, 0), step, lambda state: state[0] in one.ends and state[1] in two.ends)


def weighing(tag: int, weight: float) -> Transducer:
    """Weighs the words of one tag."""
    return built(0, lambda state, s: [(s, weight if tag_of(s) == tag else 0.0, state)], lambda state: True)


def negation() -> Transducer:
    """Marks insults and threats up to three words after a negation; a state is the number of words that it still covers."""

    def step(left: int, s: int) -> list:
        if s == NEGATION:
            return [(s, 0.0, NEGATION_SCOPE)]
        if tag_of(s) in MATCHES and left:
            return [(s | symbol(0, NEGATED), NEGATED_WEIGHT, left - 1)]
        return [(s, 0.0, max(left - 1, 0))]

    return built(0, step, lambda state: True)


def reported_speech() -> Transducer:
    """Marks insults and threats after a verb of saying."""

    def step(said: bool, s: int) -> list:
        if tag_of(s) in MATCHES and said:
            return [(s | symbol(0, REPORTED), REPORTED_WEIGHT, said)]
        return [(s, 0.0, said or s == REPORT)]

    return built(False, step, lambda state: True)


def target() -> Transducer:
    """Marks insults and threats with a target within five words on either side.

    A state holds for how many words the last target reaches, within how many a
    target must still come, and for how many none may. A match out of the last
    one's reach goes both ways, and the way whose promise is broken ends.
    """

    def step(state: tuple[int, int, int], s: int) -> list:
        reach, due, none = state
        if s == TARGET:
            return [] if none else [(s, 0.0, (TARGET_SCOPE, 0, 0))]
        if due == 1:
            return []
        reach_, due_, none_ = max(reach - 1, 0), max(due - 1, 0), max(none - 1, 0)
        if tag_of(s) not in MATCHES:
            return [(s, 0.0, (reach_, due_, none_))]
        marked = s | symbol(0, TARGETED)
        if reach or due_:
            # What is due for a match before is in reach of this one too.
            return [(marked, TARGETED_WEIGHT, (reach_, due_, none_))]
        ways = [(s, 0.0, (reach_, 0, TARGET_SCOPE))]
        if none_ < TARGET_SCOPE:
            ways.append((marked, TARGETED_WEIGHT, (reach_, TARGET_SCOPE, none_)))
        return ways

    return built((0, 0, 0), step, lambda state: state[1] == 0)


@cache
def grammar() -> Transducer:
    """The five transducers as one."""
    out = weighing(INSULT, INSULT_WEIGHT)
    for more in (weighing(THREAT, THREAT_WEIGHT), negation(), reported_speech(), target()):
        out = compose(out, more)
    return out


#: Weight of each kind of match on the machine's path.
PRIOR = np.array([kind + sum(w for mark, w in ((NEGATED, NEGATED_WEIGHT), (REPORTED, REPORTED_WEIGHT), (TARGETED, TARGETED_WEIGHT)) if marks & mark) for kind in (INSULT_WEIGHT, THREAT_WEIGHT) for marks in range(8)])


def rewritten(clause: tuple[int, ...]) -> tuple[int, ...]:
    """The clause's matches as features, in order."""
    _, wrote = max(grammar().paths(clause))
    return tuple(feature(s) for s in wrote if tag_of(s) in MATCHES)


_remembered = lru_cache(1 << 14)(rewritten)


def clause_matches(tagged: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """(place, feature, weight) of each match among the tagged words (place, tag, weight) of a clause.

    The machine forgets in six untagged words whatever they follow, so longer stretches count as six.
    """
    tags, last = [], None
    for place, tag, _ in tagged:
        tags += [OTHER] * min(TARGET_SCOPE + 1, place - last - 1 if last is not None else 0)
        tags.append(tag)
        last = place
    found = [(place, weight) for place, tag, weight in tagged if tag in MATCHES]
    return [(place, f, weight) for (place, weight), f in zip(found, (_remembered if len(tags) <= 64 else rewritten)(tuple(tags)))]


_CLAUSE_END = np.zeros(256, bool)
_CLAUSE_END[[ord(c) for c in ".!?;:\n"]] = True


def matches(column: pa.Array, lexicon: Lexicon) -> Iterator[tuple[int, list[tuple[int, int, int, float]]]]:
    """For each row its matches (start, end, feature, weight) in bytes of the lower-cased text."""
    raw_all, offsets_all = X.column_bytes(pc.utf8_lower(column))
    for i, j in X.blocks(offsets_all):
        raw, offsets = raw_all[offsets_all[i] : offsets_all[j]], offsets_all[i : j + 1] - offsets_all[i]
        starts, ends, first = X.find_words(raw, offsets, X.BY_ALNUM)
        found: list[list[tuple[int, int, int, float]]] = [[] for _ in range(j - i)]
        if len(starts):
            words, fits = lexicon.tag(X.span_hasher(raw), starts, ends)
            tags = np.array([lexicon.entries[n].tag for n in fits], np.int64)
            rows = np.searchsorted(first, words, "right") - 1
            clause = np.cumsum(_CLAUSE_END[raw])[starts[words]] + rows
            hot = np.isin(clause, clause[(tags == INSULT) | (tags == THREAT)])
            by_clause: dict[int, dict[int, tuple[int, int, float]]] = {}
            for w, n, c, r in zip(words[hot].tolist(), fits[hot].tolist(), clause[hot].tolist(), rows[hot].tolist()):
                entry = lexicon.entries[n]
                old = by_clause.setdefault((c, r), {}).get(w)
                if old is None or (entry.tag, -entry.weight) < (old[0], -old[1]):
                    by_clause[c, r][w] = (entry.tag, entry.weight)
            for (_, r), own in by_clause.items():
                for w, f, weight in clause_matches([(w, tag, weight) for w, (tag, weight) in sorted(own.items())]):
                    a = offsets[r]
                    found[r].append((int(starts[w] - a), int(ends[w] - a), f, weight))
        yield from ((i + r, m) for r, m in enumerate(found))


def features(found: list[tuple[int, int, int, float]]) -> np.ndarray:
    """Summed weights of matches by feature, on a logarithmic scale."""
    x = np.zeros(FEATURES)
    for _, _, f, weight in found:
        x[f] += weight
    return np.log1p(x) / np.log(2)


def fit(x: np.ndarray, y: np.ndarray, pull: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights and bias of a logistic regression drawn towards the grammar's own; Newton's method.

    A match weighs 1 at most, so one bare insult scores the first weight plus
    the bias. Where that would come nearer to even than ``MARGIN``, the fit is
    made again along that bound.
    """
    goal = np.append(PRIOR, BIAS)
    x = np.column_stack([x.reshape(-1, FEATURES), np.ones(len(y))])
    stiff = np.append(np.full(FEATURES, pull), 0.01 * pull)
    bound = np.zeros(len(goal))
    bound[0] = bound[-1] = 1

    def newton(basis: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The least loss over at + basis @ v."""

        def loss(w: np.ndarray) -> float:
            z = x @ w
            return float(np.sum(np.logaddexp(0, z) - y * z) + 0.5 * np.sum(stiff * (w - goal) ** 2))

        w, now = at, loss(at)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
            slope = x.T @ (p - y) + stiff * (w - goal)
            bend = (x * (p * (1 - p))[:, None]).T @ x + np.diag(stiff)
            step = basis @ np.linalg.solve(basis.T @ bend @ basis, basis.T @ slope)
            size = 1.0
            while (after := loss(w - size * step)) > now and size > 1e-6:
                size /= 2
            if now - after < 1e-9:
                break
            w, now = w - size * step, after
        return w

    w = newton(np.eye(len(goal)), goal)
    if bound @ w > -MARGIN:
        basis = np.eye(len(goal))[:, 1:]
        basis[0, -1] = -1
        w = newton(basis, w - np.eye(len(goal))[0] * (bound @ w + MARGIN))
    return w


def _stem_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Numbers of the words that have a stem of each length, and where it ends."""
    for length in STEM_BYTES:
        own = np.arange(len(starts)) if length == 0 else np.flatnonzero(ends - starts > length)
        if length:
            # A stem ends between code points.
            own = own[(raw[starts[own] + length] & 0xC0) != 0x80]
        yield own, (ends[own] if length == 0 else starts[own] + length), length


def _stem_keys(hasher, raw, starts, ends) -> tuple[np.ndarray, np.ndarray]:
    keys, words = [], []
    for own, to, length in _stem_spans(raw, starts, ends):
        keys.append(hasher(starts[own], to) ^ X.U(length == 0))
        words.append(own)
    return np.concatenate(keys), np.concatenate(words)


def _per_block(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        labels = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), np.int64)
        raw_all, offsets_all = X.column_bytes(pc.utf8_lower(batch.column(0)))
        for i, j in X.blocks(offsets_all):
            raw, offsets = raw_all[offsets_all[i] : offsets_all[j]], offsets_all[i : j + 1] - offsets_all[i]
            starts, ends, first = X.find_words(raw, offsets, X.BY_ALNUM)
            if len(starts):
                yield raw, starts, ends, first, labels[i:j]


@X.lean
def _count_stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by stem, of toxic ones alone."""
    for raw, starts, ends, first, labels in _per_block(batches):
        keys, words = _stem_keys(X.span_hasher(raw), raw, starts, ends)
        rows = np.searchsorted(first, words, "right") - 1
        toxic = labels[rows] == 1
        pairs = np.unique(np.stack([keys[toxic], rows[toxic].astype(np.uint64)], axis=1), axis=0)
        stems, counts = np.unique(pairs[:, 0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(stems.view(np.int64)), pa.array(counts.astype(np.int64))], ["stem", "docs"])


def _weigh_stems(shared):
    @X.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = shared.value
        for raw, starts, ends, first, labels in _per_block(batches):
            hasher = X.span_hasher(raw)
            whole = hasher(starts, ends)
            found = []
            for own, to, length in _stem_spans(raw, starts, ends):
                keys = hasher(starts[own], to) ^ X.U(length == 0)
                hit = maybe[(keys % X.U(FILTER_BITS)).astype(np.int64)]
                own, to, keys = own[hit], to[hit], keys[hit]
                rows = np.searchsorted(first, own, "right") - 1
                before = np.where(own > first[rows], whole[np.maximum(own - 1, 0)], X.U(0))
                found.append((keys, rows, before, starts[own], to, np.full(len(own), length == 0)))
            keys, rows, before, s, e, entire = map(np.concatenate, zip(*found))
            stems, at, number = np.unique(keys, return_index=True, return_inverse=True)
            n = len(stems)
            # Documents of a stem, and the words before it in toxic ones, without repeats.
            docs = np.unique(number * (len(labels) + 1) + rows)
            toxic = labels[docs % (len(labels) + 1)] == 1
            docs = docs // (len(labels) + 1)
            bad = labels[rows] == 1
            order = np.lexsort((before[bad], number[bad]))
            stem, word = number[bad][order], before[bad][order]
            fresh = np.ones(len(stem), bool)
            fresh[1:] = (stem[1:] != stem[:-1]) | (word[1:] != word[:-1])
            stem, word = stem[fresh], word[fresh]
            contexts = X.long_lists(word, np.concatenate([[0], np.cumsum(np.bincount(stem, minlength=n))]))
            words = pa.array([raw[x:y].tobytes() for x, y in zip(s[at].tolist(), e[at].tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(stems.view(np.int64)), words, pa.array(entire[at]), pa.array(np.bincount(docs[toxic], minlength=n)), pa.array(np.bincount(docs[~toxic], minlength=n)), contexts], ["stem", "word", "whole", "toxic", "clean", "contexts"])

    return run


def learn_stems(sample: DataFrame) -> list[Entry]:
    """Insult stems from rows (text, toxic): frequent in toxic texts, rare in others, in ever new contexts."""
    spark = sample.sparkSession
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return []
    counted = sample.select("text", "toxic").mapInArrow(_count_stems, "stem long, docs long")
    often = counted.groupBy("stem").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCS)
    often = cut(often.select("stem"))
    wanted = often.count()
    if not wanted:
        return []
    # Workers know the stems by a filter of fixed size; what it lets through in error goes in the join.
    bit = F.pmod(F.col("stem"), F.lit(FILTER_BITS))
    words = often.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(stem, {FILTER_BITS}) % 64 as int))")).alias("bits")).collect()
    flags = np.zeros(FILTER_BITS // 64, np.int64)
    flags[[r["word"] for r in words]] = [r["bits"] for r in words]
    shared = spark.sparkContext.broadcast(np.unpackbits(flags.view(np.uint8), bitorder="little").astype(bool))
    weighed = sample.select("text", "toxic").mapInArrow(_weigh_stems(shared), "stem long, word binary, whole boolean, toxic long, clean long, contexts array<long>")
    summed = weighed.join(often, "stem", "left_semi").groupBy("stem").agg(F.min("word").alias("word"), F.min("whole").alias("whole"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.size(F.array_distinct(F.flatten(F.collect_list("contexts")))).alias("contexts"))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    rows = summed.withColumn("odds", odds).where((F.col("toxic") >= LEAST_DOCS) & (F.col("contexts") >= LEAST_CONTEXTS) & (F.col("odds") >= LEAST_LOG_ODDS)).collect()
    share = toxic / (toxic + clean)
    kept = {}
    for r in rows:
        both, p = r["toxic"] + r["clean"], r["toxic"] / (r["toxic"] + r["clean"])
        surprise = both * (p * np.log(p / share) + ((1 - p) * np.log((1 - p) / (1 - share)) if p < 1 else 0))
        if surprise > np.log(wanted) + 1:
            kept[bytes(r["word"]), r["whole"]] = r
    # The longest form that explains nearly all documents of a stem stands for it.
    out = []
    for (word, whole), r in kept.items():
        if not any(r2["toxic"] >= 0.9 * r["toxic"] for (w2, whole2), r2 in kept.items() if not whole and w2.startswith(word) and (w2 != word or whole2)):
            out.append(Entry(word, whole, INSULT, float(min(1.0, r["odds"] / 4))))
    return out


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Stems and weights from at most ``sample_rows`` labelled rows outside the held-out fifth."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col)).cast("int").alias("toxic"))
    few = known.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    # Bounded by sample_rows, so it can be broadcast.
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(few), "id").select("text", "toxic")
    sample = cut(own)
    lexicon = Lexicon([*seed_entries(), *learn_stems(sample)])
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    @X.lean
    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(m) for _, m in matches(batch.column(0), shared.value)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

    # Equal rows are counted, so few distinct ones come back.
    rows = sample.mapInArrow(featured, "x array<double>, toxic int").groupBy("x", "toxic").count().collect()
    x = np.array([r["x"] for r in rows], float).reshape(-1, FEATURES)
    y, many = np.array([r["toxic"] for r in rows], float), np.array([r["count"] for r in rows], int)
    return Model(lexicon, fit(np.repeat(x, many, axis=0), np.repeat(y, many)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


CLAUSES = "array<struct<start:long,end:long,weight:double>>"


def _scorer(shared):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("weight", pa.float64())]))

    @X.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores, spans = np.zeros(batch.num_rows), []
            lower = pc.utf8_lower(batch.column(1))
            for r, found in matches(batch.column(1), model.lexicon):
                total = model.weights[-1] + features(found) @ model.weights[:-1]
                scores[r] = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
                if found:
                    raw = np.frombuffer(lower[r].as_py().encode(), np.uint8)
                    at = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                    spans.append([{"start": int(at[s]), "end": int(at[e]), "weight": float(w * model.weights[f])} for s, e, f, w in sorted(found)])
                else:
                    spans.append([])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(spans, kind)], ["id", "score", "matches"])

    return run


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, held_out, score (0 to 1), predicted (1 from 0.5), matches.

    matches are the scored spans of the text in code points, with the weight of
    their match in its clause. A null text is as an empty one and gets the score
    of a text without matches. A null id isn't held out. Repeated rows get equal
    results; an empty table gives an empty result. Language, source and other
    columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = rows.mapInArrow(_scorer(shared), f"id {rows.schema['id'].dataType.simpleString()}, score double, matches {CLAUSES}")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "matches")


def keep_below(docs: DataFrame, model: Model, limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, with all their columns, that score below ``limit``; row by row, without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @X.lean
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights, found = shared.value.weights, matches(batch.column(at), shared.value.lexicon)
            keep = [1 / (1 + np.exp(-np.clip(weights[-1] + features(m) @ weights[:-1], -30, 30))) < limit for _, m in found]
            yield batch.filter(pa.array(keep, pa.bool_()))

    at = docs.columns.index(text_col)
    return docs.mapInArrow(kept, docs.schema)
