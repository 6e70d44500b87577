"""Encoding with a SentencePiece BPE model under seeded merge-dropout, and decoding.

The agenda of byte-pair merges is processed as the library does it: best score first, leftmost among equals.  Each
candidate merge is skipped with chance ``dropout`` when its turn comes, and stays skipped as long as the candidate exists.  Which turns
are skipped is drawn by a keyed hash of the seed, the document and the word's number, for every occurrence of a word on
its own, so a run can be repeated.

No piece of such a model joins a space to what stands before it, so words are segmented one by one.  The words of a slice of text are
numbered by a dictionary, and the skipped turns of an occurrence are the bits of a 64-bit mask, found one after the other: a segmentation is worked out
once for each word and mask that occur, many at a time in numpy with one turn per word and round, and kept in flat arrays; one gather puts the ids of all
occurrences in order.  Nothing is kept from slice to slice, and long texts are worked off in slices too, so memory has a bound that follows from the slice.  Words over
``LONG`` characters, whose turns may pass 64, are segmented by a heap, each occurrence by itself.

Decoding concatenates the pieces and is lossless for every text: characters outside the vocabulary, and the model's own
space mark, are spelled in byte pieces.

Defined cases: a null or empty text has no pieces and decodes to the empty text; rows of equal id and text are encoded
alike; an empty table gives an empty result.  Only the id, the text and the columns to keep are read.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlake.llm.common import gather, released, slices, table, utf8
from airlake.llm.registry import query
from airlake.llm.shingles import U, mix64

#: A word of so many characters has at most 60 turns: a merge makes two candidates at most.
LONG = 21
#: Words of text, and pairs of a word and a mask, that are worked on at a time.
UNITS, PAIRS = 200_000, 50_000
_NEVER = 1 << 40
SPACE_MARK = "▁"


class Pieces:
    """A BPE model: its pieces and the merges that make them."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        special = lambda i: m.is_control(i) or m.is_unknown(i) or m.is_unused(i) or m.is_byte(i)
        piece = {m.id_to_piece(i): i for i in range(n) if not special(i)}
        self.byte = [0] * 256
        self.text = [b""] * n
        for i in range(n):
            if m.is_byte(i):
                self.byte[int(m.id_to_piece(i)[3:5], 16)] = i
                self.text[i] = bytes([int(m.id_to_piece(i)[3:5], 16)])
        for p, i in piece.items():
            self.text[i] = p.replace(SPACE_MARK, " ").encode()
        self.code = np.full(0x110000, -1, np.int32)
        for p, i in piece.items():
            if len(p) == 1:
                self.code[ord(p)] = i
        self.code[ord(" ")], self.code[ord(SPACE_MARK)] = self.code[ord(SPACE_MARK)], -1
        places = {s: k for k, s in enumerate(sorted({m.get_score(i) for i in piece.values()}, reverse=True))}
        merges = {(piece[p[:k]] << 32) | piece[p[k:]]: (places[m.get_score(i)], i)
                  for p, i in piece.items() for k in range(1, len(p)) if p[:k] in piece and p[k:] in piece}
        keys = sorted(merges)
        self.rank = np.array([merges[k][0] for k in keys], np.int64)
        self.made = np.array([merges[k][1] for k in keys], np.int32)
        # an open table of the pairs, at most a quarter full; a key without a place goes on to the next
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.slots, self.entry = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        key, row = np.array(keys, np.int64), np.arange(len(keys))
        slot = self._slot(key)
        while len(key):
            free = self.slots[slot] == -1
            some, first = np.unique(slot[free], return_index=True)
            self.slots[some], self.entry[some] = key[free][first], row[free][first]
            out = self.slots[slot] != key
            key, row, slot = key[out], row[out], (slot[out] + 1) & ((1 << self.bits) - 1)
        self.merges = merges
        #: a line feed in a piece would make lines depend on each other
        assert not any("\n" in p or SPACE_MARK in p.lstrip(SPACE_MARK) for p in piece)


    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(U) * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Row of every pair among ``rank`` and ``made``, -1 for pairs that don't merge."""
        slot = self._slot(key)
        held, out = self.slots[slot], self.entry[slot]
        off = np.flatnonzero((held != key) & (held != -1))
        out[held != key] = -1
        slot = slot[off]
        while len(off):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            held = self.slots[slot]
            hit = held == key[off]
            out[off[hit]] = self.entry[slot[hit]]
            on = ~hit & (held != -1)
            off, slot = off[on], slot[on]
        return out


def gaps(stream: np.ndarray, seed: int, level: int | np.ndarray, dropout: float) -> np.ndarray:
    """How many turns pass between skipped turn number ``level`` of a stream and the one before it: geometric, by a keyed hash."""
    if dropout <= 0:
        return np.full(np.broadcast(stream, level).shape, _NEVER)
    h = mix64(mix64(stream.astype(U) ^ (U(seed % (1 << 16)) << U(48))) + np.asarray(level).astype(U) * U(0x9E3779B97F4A7C15))
    if dropout >= 1:
        return np.zeros(h.shape, np.int64)
    u = ((h >> U(11)).astype(np.float64) + 1) / float(1 << 53)
    return np.minimum(np.log(u) / np.log1p(-dropout), _NEVER).astype(np.int64)


def skipped(streams: list[int], seed: int, dropout: float, turns: int) -> np.ndarray:
    """The skipped turns of every stream, one row each, in order; those from ``turns`` on don't matter."""
    some = gaps(np.array(streams, U)[:, None], seed, np.arange(max(1, turns) if dropout > 0 else 1)[None], dropout)
    return np.minimum(np.cumsum(np.minimum(some, turns + 1) + 1, axis=1) - 1, _NEVER)


def by_heap(p: Pieces, unit: str, stream: int, seed: int, dropout: float) -> list[int]:
    """The agenda of one word, in so many words; ids, or -1 - code point for characters without a piece."""
    sym = [int(p.code[ord(c)]) for c in unit]
    prev, after = list(range(-1, len(unit) - 1)), [*range(1, len(unit)), -1]
    agenda: list[tuple[int, int, int, int, int, int]] = []

    def offer(fresh: list[tuple[int, int]]) -> None:
        for a, b in fresh:
            if a >= 0 and b >= 0 and sym[a] >= 0 and sym[b] >= 0 and (sym[a] << 32 | sym[b]) in p.merges:
                rank, made = p.merges[sym[a] << 32 | sym[b]]
                heapq.heappush(agenda, (rank, a, b, sym[a], sym[b], made))

    # every merge makes two candidates at most
    skip, turn = set(skipped([stream], seed, dropout, 3 * len(unit))[0].tolist()), -1
    offer([(i, i + 1) for i in range(len(unit) - 1)])
    while agenda:
        _, a, b, left, right, made = heapq.heappop(agenda)
        if sym[a] != left or sym[b] != right or after[a] != b:
            continue
        turn += 1
        if turn in skip:
            continue
        sym[a], sym[b] = made, -2
        after[a] = after[b]
        if after[a] >= 0:
            prev[after[a]] = a
        offer([(prev[a], a), (a, after[a])])
    out, i = [], 0 if unit else -1
    while i >= 0:
        out.append(sym[i] if sym[i] >= 0 else -1 - ord(unit[i]))
        i = after[i]
    return out


def _mask(streams: np.ndarray, seed: int, dropout: float) -> np.ndarray:
    """The skipped turns among the first 64 of every stream, as bits."""
    out = np.zeros(len(streams), U)
    for row, turns in enumerate(skipped(streams.tolist(), seed, dropout, 64) if len(streams) else ()):
        for t in turns[turns < 64].tolist():
            out[row] |= U(1 << t)
    return out


def many(p: Pieces, units: list[str], streams: list[int], seed: int, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """As ``by_heap`` for many short words: (all ids one after the other, their offsets by word)."""
    code = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
    return rounds(p, code, np.array([len(u) for u in units], np.int64), _mask(np.array(streams, U), seed, dropout))[:2]


def rounds(p: Pieces, code: np.ndarray, size: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all ids one after the other, their offsets by word, turns of every word), given code points, words' sizes and the bits of skipped turns.

    In each round every word takes its best candidate, or skips it; only the pairs on either side of a merge are judged anew.
    """
    words = len(size)
    unit = np.repeat(np.arange(words), size)
    start = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
    turns, turn = np.zeros(words, np.int64), 0
    sym = p.code[code].astype(np.int64)
    sym[sym < 0] = -1 - code[sym < 0].astype(np.int64)
    none = np.int64(1 << 40)
    rank, made = np.full(len(sym), none), np.zeros(len(sym), np.int64)

    def judge(i: np.ndarray) -> None:
        """Rank and product of the pairs (i, i + 1)."""
        i = i[(i >= 0) & (i + 1 < len(sym))]
        rank[i] = none
        i = i[(unit[i] == unit[i + 1]) & (sym[i] >= 0) & (sym[i + 1] >= 0)]
        at = p.find((sym[i] << 32) | sym[i + 1])
        good = at >= 0
        i, at = i[good], at[good]
        rank[i], made[i] = p.rank[at], p.made[at]

    judge(np.arange(len(sym) - 1))
    done = []
    while len(sym):
        n = len(sym)
        first = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
        # least rank, leftmost, of each word
        best = np.minimum.reduceat(rank * n + np.arange(n), first)
        live = best < none * n
        over = np.repeat(~live, np.diff(np.append(first, n)))
        if over.any():
            done.append((unit[over], start[over], sym[over]))
            turns[unit[first[~live]]] = turn
        i = best[live] % n
        rank[np.append(first[1:], n) - 1] = none
        hit = (mask[unit[i]] >> U(turn)) & U(1) > 0 if turn < 64 else np.zeros(len(i), bool)
        rank[i[hit]] = none
        i, turn = i[~hit], turn + 1
        sym[i] = made[i]
        keep = ~over
        keep[i + 1] = False
        at = (np.cumsum(keep) - 1)[i]
        sym, unit, start, rank, made = (x[keep] for x in (sym, unit, start, rank, made))
        if len(at):
            rank[at] = none
            judge(np.concatenate((at, at - 1)))
    unit, start, sym = (np.concatenate([d[k] for d in done]) if done else np.zeros(0, np.int64) for k in range(3))
    flat = sym[np.argsort(unit * (start.max(initial=0) + 1) + start, kind="stable")]
    return flat, np.concatenate(([0], np.cumsum(np.bincount(unit, minlength=words)))), turns


class Segments:
    """Segmentations of the words of a slice: ids in one run each, with the word, the skipped turns and the number of turns."""

    def __init__(self, encoder: Encoder, words: pa.Array):
        self.encoder, self.words = encoder, words
        self.code = np.frombuffer(utf8(words)[1].tobytes().decode().encode("utf-32-le"), np.uint32)
        self.size = np.asarray(pa.compute.utf8_length(words)).astype(np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.word, self.mask, self.turns = np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64)
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids: list[np.ndarray] = []
        self.held = 0

    def keep(self, ids: np.ndarray, upto: np.ndarray, word: np.ndarray, mask: np.ndarray, turns: np.ndarray) -> None:
        """More segmentations, numbered on."""
        ids, upto = self.encoder.spelled(ids, upto)
        self.start = np.concatenate((self.start, upto[:-1] + self.held))
        self.length = np.concatenate((self.length, np.diff(upto)))
        self.word, self.mask, self.turns = (np.concatenate(x) for x in ((self.word, word), (self.mask, mask), (self.turns, turns)))
        self.ids.append(ids)
        self.held += len(ids)

    def learn(self, word: np.ndarray, mask: np.ndarray) -> None:
        """Segment words under masks, many at a time."""
        for lo in range(0, len(word), PAIRS):
            w, m = word[lo:lo + PAIRS], mask[lo:lo + PAIRS]
            ids, upto, turns = rounds(self.encoder.pieces, self.code[gather(self.begin[w], self.size[w])], self.size[w], m)
            self.keep(ids, upto, w, m, turns)

    def known(self) -> dict[tuple[tuple[int, ...], str], tuple[bytes, int]]:
        """(skipped turns, word): its ids and how many turns it has."""
        flat, words = np.concatenate([*self.ids, np.zeros(0, np.int32)]), self.words.to_pylist()
        bits = ((tuple(t for t in range(64) if m >> t & 1)) for m in self.mask.tolist())
        return {(b, words[w]): (flat[s:s + n].tobytes(), t) for b, w, s, n, t in zip(bits, self.word.tolist(), self.start.tolist(), self.length.tolist(), self.turns.tolist())}


class Encoder:
    def __init__(self, path: str, seed: int, dropout: float):
        self.pieces, self.seed, self.dropout = Pieces(path), seed, dropout
        self._bytes_of = np.array(self.pieces.byte, np.int64)
        self.last: Segments | None = None

    @property
    def known(self) -> dict[tuple[tuple[int, ...], str], tuple[bytes, int]]:
        """The segmentations of the slice that was worked on last."""
        return self.last.known() if self.last else {}

    def spelled(self, ids: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece (-1 - code point) as the pieces of their bytes; 32-bit ids and their offsets."""
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids.astype("<i4"), upto
        raw = [chr(c).encode() for c in (-1 - ids[odd]).tolist()]
        more = np.ones(len(ids), np.int64)
        more[odd] = [len(r) for r in raw]
        at = np.concatenate(([0], np.cumsum(more)))
        out = np.repeat(ids, more)
        out[gather(at[odd], more[odd])] = self._bytes_of[np.frombuffer(b"".join(raw), np.uint8)]
        return out.astype("<i4"), at[upto]

    def _bytes(self, found: list[int]) -> bytes:
        return self.spelled(np.array(found, np.int64), np.array([0, len(found)]))[0].tobytes()

    def _slice(self, units: pa.Array, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units, their number by unit)."""
        coded = units.dictionary_encode()
        of = np.asarray(coded.indices).astype(np.int64)
        known = self.last = Segments(self, coded.dictionary)
        short = known.size <= LONG
        # one segmentation without skipped turns of every short word; its number is that of the word among them
        first = np.flatnonzero(short)
        known.learn(first, np.zeros(len(first), U))
        place = np.cumsum(short) - 1
        segment = place[of]
        live = np.flatnonzero(short[of])
        position, level = gaps(stream[live], self.seed, 0, self.dropout), 0
        while True:
            # who still has the turn that is to be skipped next
            still = position < known.turns[segment[live]]
            live, position = live[still], position[still]
            if not len(live):
                break
            pair, which = np.unique(segment[live] * 64 + position, return_inverse=True)
            parent, number = pair // 64, len(known.word)
            known.learn(known.word[parent], known.mask[parent] | (U(1) << (pair % 64).astype(U)))
            segment[live] = number + which
            level += 1
            position = position + 1 + gaps(stream[live], self.seed, level, self.dropout)
        for i in np.flatnonzero(~short[of]).tolist():
            found = by_heap(self.pieces, units[i].as_py(), int(stream[i]), self.seed, self.dropout)
            segment[i] = len(known.word)
            known.keep(np.array(found, np.int64), np.array([0, len(found)]), of[i:i + 1], np.zeros(1, U), np.full(1, _NEVER))
        flat, size = np.concatenate([*known.ids, np.zeros(0, "<i4")]), known.length[segment]
        return flat[gather(known.start[segment], size)], size

    def encode_all(self, keys: list[int], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(32-bit ids of all texts, their offsets by text); the key and a word's number pick the turns that it skips."""
        raw = [b" " + t.encode() if t else b"" for t in texts]
        edge = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
        data = pa.py_buffer(b"".join(raw))
        del raw
        b = np.frombuffer(data, np.uint8)
        # stretches that no piece crosses: spaces with the characters after them, and line feeds
        begins = np.zeros(len(b) + 1, bool)
        begins[edge] = True
        feed, space = b == 10, b == 32
        begins[:-1] |= feed
        begins[1:] |= feed
        begins[1:-1] |= space[1:] & ~space[:-1]
        at = np.flatnonzero(begins)
        first = np.searchsorted(at, edge)
        number = len(at) - 1
        out, upto = [], np.zeros(number + 1, np.int64)
        for lo in range(0, number, UNITS):
            hi = min(number, lo + UNITS)
            units = pa.LargeStringArray.from_buffers(hi - lo, pa.py_buffer(at[lo:hi + 1].astype(np.int64)), data)
            text = np.searchsorted(first, np.arange(lo, hi), "right") - 1
            base = np.array([(k ^ self.seed * 0x9E3779B97F4A7C15) % (1 << 64) for k in keys[text[0]:text[-1] + 1]], U)
            stream = mix64((np.arange(lo, hi) - first[text]).astype(U) * U(0xD1342543DE82EF95) + base[text - text[0]])
            ids, size = self._slice(units, stream)
            out.append(ids)
            upto[lo + 1:hi + 1] = size
        return np.concatenate([*out, np.zeros(0, "<i4")]), np.cumsum(upto)[first]

    def encode(self, keys: list[int], texts: list[str]) -> list[bytes]:
        """32-bit ids of every text."""
        ids, at = self.encode_all(keys, texts)
        return [ids[a:b].tobytes() for a, b in zip(at, at[1:])]


_ENCODERS: dict[tuple[str, int, float], Encoder] = {}


def _encoder(path: str, seed: int, dropout: float) -> Encoder:
    """One encoder, which is a model's pieces, for all tasks of a worker process."""
    key = (path, seed, dropout)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, seed, dropout)
    return _ENCODERS[key]


Batches = Iterator[pa.RecordBatch]


def _coded(batches: Batches, model: str, dropout: float, seed: int) -> Batches:
    """Batches of (text, id, others) as (others, ids)."""
    enc = _encoder(model, seed, dropout)
    for batch in batches:
        names = [*batch.schema.names[2:], "ids"]
        for part in slices(batch, 0, 1 << 20):
            texts = [t or "" for t in part.column(0).to_pylist()]
            keys = [((i or 0) * 0x9E3779B97F4A7C15 + zlib.crc32(t.encode())) % (1 << 64) for i, t in zip(part.column(1).to_pylist(), texts)]
            ids, at = enc.encode_all(keys, texts)
            yield pa.RecordBatch.from_arrays([*part.columns[2:], pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))], names=names)
    enc.last = None


def _decoded(batches: Batches, model: str, digest: bool, with_ids: bool = False) -> Batches:
    """Batches of (others, ids) as (others, ids if asked for, text or digests)."""
    text = _encoder(model, 0, 0.0).pieces.text.__getitem__
    for batch in batches:
        names = [*batch.schema.names[:None if with_ids else -1], *(["n_pieces", "ids_crc32", "text_sha256"] if digest else ["text"])]
        ids = batch.column(batch.num_columns - 1)
        at, flat = np.asarray(ids.offsets).tolist(), np.asarray(ids.values).astype("<i4", copy=False)
        parts = [flat[a:b] for a, b in zip(at[:-1], at[1:])]
        # the first byte is the space that encoding puts before a text
        raw = (b"".join(map(text, p.tolist()))[1:] for p in parts)
        if digest:
            made = [pa.array([len(p) for p in parts], pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                    pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string())]
        else:
            made = [pa.array([r.decode() for r in raw], pa.string())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:None if with_ids else -1], *made], names=names)


_DIGEST = "n_pieces long, ids_crc32 long, text_sha256 string"


def _mapped(d: DataFrame, run, keep: tuple[str, ...], made: str) -> DataFrame:
    own = ", ".join(f"_{i} {t}" for i, t in enumerate(dict(d.dtypes)[f"_{i}"] for i in range(len(keep))))
    return d.mapInArrow(run, (own + ", " if own else "") + made).withColumnsRenamed({f"_{i}": c for i, c in enumerate(keep)})


def _texts(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    return docs.select(F.col(text_col).cast("string").alias("_text"), F.col(id_col).cast("long").alias("_id"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)])


def encode(docs: DataFrame, model: str, dropout: float = 0.1, seed: int = 0, id_col: str = "doc_id", text_col: str = "text",
           keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``ids`` (array<int>) of every document."""
    return _mapped(_texts(docs, id_col, text_col, keep), lambda b: released(_coded(b, model, dropout, seed)), keep, "ids array<int>")


def decode(coded: DataFrame, model: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",), digest: bool = False) -> DataFrame:
    """The columns ``keep`` and ``text``, or with ``digest`` n_pieces, ids_crc32 and text_sha256, of encoded documents."""
    d = coded.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)], F.col(ids_col).alias("_ids"))
    return _mapped(d, lambda b: released(_decoded(b, model, digest)), keep, _DIGEST if digest else "text string")


def round_trip(docs: DataFrame, model: str, dropout: float = 0.1, seed: int = 0, id_col: str = "doc_id", text_col: str = "text",
               keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, ``ids`` and what ``decode`` tells of them with ``digest``: both halves in one pass through one worker."""
    run = lambda b: released(_decoded(_coded(b, model, dropout, seed), model, True, with_ids=True))
    return _mapped(_texts(docs, id_col, text_col, keep), run, keep, "ids array<int>, " + _DIGEST)


@query("op4_sentencepiece")
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents with merge-dropout and decode them: pieces, and the digest of the decoded text."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    return round_trip(table(spark, sf_dir, "documents"), model).drop("ids")
