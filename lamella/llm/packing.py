"""Packing of token sequences: shortest-pack-first over the histogram of lengths.

Documents are tokenized and cut into pieces of a sequence's length at most. Only
the histogram of piece lengths, bounded by the sequence's length, goes to the
driver, where lengths are placed longest first, each into the packs with the
most room, for whole counts of equal packs at once. The packing patterns are
joined back to pieces by their rank among pieces of equal length.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.llm import text as X
from lamella.session import cut

SEQUENCE = 4096
END = 2
#: Ranks of one join key, and least number of parts in which ranks of a length are counted.
RANKS, PARTS = 512, 64

#: A chunk between blanks whose words this module can tell apart as the tokenizer does.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|[^a-zà-öø-ÿß0-9]+")
_BLANK = X.word_table((0x20, 0x20), (0x09, 0x0A), (0x0D, 0x0D))


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level BPE for the two bytes of each Latin-1 letter."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in stand):
        stand[b] = chr(256 + n)
    return {c: "".join(stand[b] for b in chr(c).encode()) for c in range(192, 256)}


class ChunkTokenizer:
    """Token ids of texts through a cache of their blank-separated chunks.

    The tokenizer drops white space and never looks across it, so a text's ids
    are those of its chunks in turn. A chunk in the cache is found by a 64-bit
    hash and then compared byte by byte. New chunks of plain words go straight to the tokenizer's BPE model,
    all others through the whole tokenizer. For a tokenizer of another build
    every new chunk goes through the whole of it.
    """

    #: Chunks kept, about 60 bytes each; the cache starts anew beyond.
    KEEP = 1 << 18

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        state = json.loads(self.full.to_str())
        pieces = (state.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        kinds = [n.get("type") for n in (state.get("normalizer") or {}).get("normalizers", [])]
        self.drops_blanks = pieces[0].get("behavior") == "Removed" and kinds == ["NFC", "Replace", "Lowercase"]
        known = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        self.plain = self.drops_blanks and pieces[0].get("pattern") == {"Regex": known}
        self.letters = _byte_letters()
        self.reset()

    def reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.data = np.zeros(0, np.uint8)
        self.from_ = np.zeros(0, np.int64)
        self.to = np.zeros(0, np.int64)

    def chunk(self, chunk: str) -> list[int]:
        if not self.plain or "<|" in chunk or not _PLAIN.fullmatch(chunk):
            return self.full.encode(chunk, add_special_tokens=False).ids
        model, out = self.full.model, []
        for piece in _PIECES.findall(chunk.lower()):
            out += [t.id for t in model.tokenize(piece if piece.isascii() else piece.translate(self.letters))]
        return out

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each row's followed by END, and bounds by row."""
        n = len(offsets) - 1
        if not self.drops_blanks:
            own = [self.full.encode(bytes(raw[offsets[r] : offsets[r + 1]]).decode(), add_special_tokens=False).ids + [END] for r in range(n)]
            return np.array([t for x in own for t in x], np.uint32), np.cumsum([0, *map(len, own)])
        starts, ends, first = X.find_words(raw, offsets, _BLANK)
        if not len(starts):
            return np.full(n, END, np.uint32), np.arange(n + 1)
        unique, where, inverse = np.unique(X.hash_spans(raw, starts, ends), return_index=True, return_inverse=True)
        first_of = where[inverse]
        other = np.flatnonzero(~X.same_spans(raw, starts, ends, raw, starts[first_of], ends[first_of]))
        at, size = self._found(unique, where, raw, starts, ends)
        if len(other):
            # Chunks of an equal hash but other bytes stand for themselves.
            at_, size_ = self._made(other, raw, starts, ends)
            inverse[other] = len(where) + np.arange(len(other))
            at, size = np.concatenate([at, at_]), np.concatenate([size, size_])
        at, size = at[inverse], size[inverse]
        before = np.concatenate([[0], np.cumsum(size)])
        bounds = before[first] + np.arange(n + 1)
        out = np.full(bounds[-1], END, np.uint32)
        source = np.repeat(at - before[:-1], size) + np.arange(before[-1])
        target = np.arange(before[-1]) + np.repeat(np.arange(n), np.diff(before[first]))
        out[target] = self.ids[source]
        return out, bounds

    def _made(self, where: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of the ids of chunks that are tokenized now."""
        data = raw.tobytes()
        found = [self.chunk(data[a:z].decode()) for a, z in zip(starts[where].tolist(), ends[where].tolist())]
        size = np.fromiter(map(len, found), np.int64, len(found))
        at = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, np.fromiter((t for x in found for t in x), np.uint32, int(size.sum()))])
        return at, size

    def _found(self, unique: np.ndarray, where: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of chunks by their hashes, from the cache or made and kept there."""
        if len(self.ids) > 4 * self.KEEP or len(self.keys) > self.KEEP:
            self.reset()
        at, size = np.empty(len(unique), np.int64), np.empty(len(unique), np.int64)
        place = np.searchsorted(self.keys, unique)
        there = place < len(self.keys)
        there[there] = self.keys[place[there]] == unique[there]
        hit, own = np.flatnonzero(there), place[there]
        same = X.same_spans(raw, starts[where[hit]], ends[where[hit]], self.data, self.from_[own], self.to[own])
        at[hit], size[hit] = self.at[own], self.size[own]
        if not same.all():
            at[hit[~same]], size[hit[~same]] = self._made(where[hit[~same]], raw, starts, ends)
        new = np.flatnonzero(~there)
        if len(new):
            at[new], size[new] = self._made(where[new], raw, starts, ends)
            a, n = starts[where[new]], (ends - starts)[where[new]]
            to = len(self.data) + np.cumsum(n)
            self.data = np.concatenate([self.data, raw[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())]])
            slot = np.searchsorted(self.keys, unique[new])
            for name, values in (("keys", unique[new]), ("at", at[new]), ("size", size[new]), ("from_", to - n), ("to", to)):
                setattr(self, name, np.insert(getattr(self, name), slot, values))
        return at, size


_TOKENIZERS: dict[str, ChunkTokenizer] = {}


@X.lean
def _cut_up(batches: Iterator[pa.RecordBatch], path: str, sequence: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkTokenizer(path)
    tokenizer = _TOKENIZERS[path]
    for batch in batches:
        raw, offsets = X.column_bytes(batch.column(1))
        for i, j in X.blocks(offsets):
            ids, bounds = tokenizer.encode(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            tokens = np.diff(bounds)
            many = -(-tokens // sequence)
            row = np.repeat(np.arange(j - i), many)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)) * sequence
            length = np.minimum(sequence, tokens[row] - start)
            a = bounds[:-1][row] + start
            little = ids.astype("<u4")
            crc = np.fromiter((zlib.crc32(little[x:y]) for x, y in zip(a.tolist(), (a + length).tolist())), np.int64, len(row))
            columns = [batch.column(0).take(pa.array(row + i)), pa.array(start), pa.array(length), pa.array(crc), pa.array(tokens[row])]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(a, bounds[-1]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)


def shortest_pack_first(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Places for pieces: (length, first rank, ranks, first sequence, offset), ranks counted from 0 by length.

    Packs are kept as patterns with counts: a pattern is a chain of lengths, and
    its packs have equal room. A length goes to the patterns with the most room
    first; one that is needed in part is split in two.
    """
    rooms: list[int] = []
    by_room: dict[int, list[tuple[int, tuple | None]]] = {}

    def put(room: int, count: int, chain: tuple) -> None:
        if room not in by_room:
            by_room[room] = []
            heapq.heappush(rooms, -room)
        by_room[room].append((count, chain))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            if not rooms or -rooms[0] < length:
                put(sequence - length, left, (length, None))
                break
            room = -rooms[0]
            count, chain = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                heapq.heappop(rooms)
            taken = min(left, count)
            if count > taken:
                put(room, count - taken, chain)
            put(room - length, taken, (length, chain))
            left -= taken
    places, ranks, base = [], dict.fromkeys(histogram, 0), 0
    for room in sorted(by_room):
        for count, chain in by_room[room]:
            end = sequence - room
            while chain is not None:
                length, chain = chain
                end -= length
                places.append((length, ranks[length], count, base, end))
                ranks[length] += count
            base += count
    return places


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents with their places in sequences of ``sequence`` tokens.

    Returns per piece: ``id_col``, start, length, ids_crc32 (of the ids as
    little-endian unsigned 32-bit), doc_tokens, sequence_id, offset and, with
    ``with_ids``, ids. A document is its ids and END; a null or empty text is
    END alone. Documents longer than a sequence are cut at its multiples.
    Repeated rows are packed each for itself, and so are rows without an id. An
    empty table gives an empty result. Other input columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else "")
    pieces = cut(rows.mapInArrow(partial(_cut_up, path=tokenizer, sequence=sequence, with_ids=with_ids), schema))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}

    # Rank among pieces of a length: by part, so that no length's pieces meet in one task.
    parts = max(PARTS, sum(histogram.values()) // 1_000_000)
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("id", "start"), F.lit(parts)))
    counts = pieces.groupBy("length", "part").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("length", "part").orderBy("id", "start", "ids_crc32")
    ranked = pieces.withColumn("own", F.row_number().over(own) - 1).join(first, ["length", "part"]).withColumn("rank", F.col("own") + F.col("first"))

    places = docs.sparkSession.createDataFrame(shortest_pack_first(histogram, sequence), "length long, lo long, many long, base long, offset long")
    slots = places.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("lo") / RANKS), F.floor((F.col("lo") + F.col("many") - 1) / RANKS))))
    ranked = ranked.withColumn("chunk", F.floor(F.col("rank") / RANKS))
    out = ranked.join(slots, ["length", "chunk"]).where("rank >= lo and rank < lo + many")
    columns = [F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset"]
    return out.select(*columns, *(["ids"] if with_ids else []))
