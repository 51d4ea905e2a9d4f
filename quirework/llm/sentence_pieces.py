"""SentencePiece encoding and decoding that keeps the place of every piece in the original bytes.

A text is normalised by the longest prefix that the model's compiled character map knows at
each position; an alignment records from which original byte each normalised byte came.  Pieces
are merged on the normalised words, and every piece is projected back through the alignment.
Within this module a space stands for the model's space mark, one byte for three.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from . import common
from .token_counts import PRE_TOKENS, SPACE_MARK

#: Words whose pieces a worker keeps, in two generations.
CACHE_WORDS = 200_000
#: Words of more symbols are merged one by one with a heap, the others together in rounds.
LONG_WORD = 200
#: Space runs with what follows, and line ends with what follows.
LINE_TOKENS = re.compile(r" +[^ \n]*|\n[^ \n]*")
NO_RANK = np.int64(2**62)

# -- fixed values: field numbers and kinds of the public model format -----------------------------
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_KIND = 1, 2, 3
TRAINER_KIND, TRAINER_SPACE_SUFFIX, TRAINER_BYTES = 3, 24, 35
CHARACTER_MAP, DUMMY_PREFIX, TRIM_SPACES = 2, 3, 4
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2
UNKNOWN_SURFACE = " ⁇ "


def fields(data: bytes):
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + size]
        at += size


class CharacterMap:
    """A compiled map: a double-array trie of byte strings whose values point into a text pool."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.pool = blob[4 + size :]
        first = [b for b in range(256) if self.units and self._child(0, b) is not None]
        #: Bytes at which a known prefix may start; none at all for a map that changes nothing.
        self.starts = re.compile(b"[" + b"".join(re.escape(bytes([b])) for b in first) + b"]") if first else None

    def _child(self, at: int, byte: int) -> int | None:
        unit = self.units[at]
        to = at ^ ((unit >> 10) << ((unit & 512) >> 6)) ^ byte
        return to if to < len(self.units) and self.units[to] & 0x800000FF == byte else None

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of ``data`` from ``at``, and what it becomes."""
        node, found = 0, None
        for end in range(at, len(data)):
            if (node := self._child(node, data[end])) is None:
                break
            unit = self.units[node]
            if unit & 256:  # a key ends here: its value lies in the unit at the child without label
                value = self.units[node ^ ((unit >> 10) << ((unit & 512) >> 6))] & 0x7FFFFFFF
                found = end + 1 - at, self.pool[value : self.pool.index(b"\0", value)]
        return found


def char_size(first: int) -> int:
    """Bytes of the UTF-8 character that starts with this byte."""
    return 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


class Normalizer:
    def __init__(self, spec: bytes):
        values = {CHARACTER_MAP: b"", DUMMY_PREFIX: 1, TRIM_SPACES: 1} | dict(fields(spec))
        self.map = CharacterMap(values[CHARACTER_MAP])
        self.prefix, self.trim = bool(values[DUMMY_PREFIX]), bool(values[TRIM_SPACES])

    def plain(self, text: str) -> bool:
        """Whether the alignment is that of the added space alone."""
        return self.map.starts is None and not self.trim and self.prefix and SPACE_MARK not in text

    def align(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and the original byte of each of them and of their end."""
        data = text.encode("utf-8")
        out, places, at = [], [], 0
        mark = SPACE_MARK.encode()
        while at < len(data):
            hit = self.map.starts.search(data, at) if self.map.starts else None
            to = hit.start() if hit else len(data)
            if to > at:
                out.append(data[at:to])
                places.append(np.arange(at, to))
                at = to
            if at < len(data):
                size, made = self.map.longest(data, at) or (0, b"")
                if size:
                    out.append(made)
                    places.append(np.full(len(made), at))
                else:
                    size = char_size(data[at])
                    out.append(data[at : at + size])
                    places.append(np.arange(at, at + size))
                at += size
        made = b"".join(out)
        place = np.concatenate([*places, [len(data)]]).astype(np.int64)
        if self.trim and made:  # of a run of spaces the first stays, before any text none
            space = np.frombuffer(made, dtype=np.uint8) == 32
            kept = np.flatnonzero(~(space & np.r_[True, space[:-1]]))
            place = place[np.r_[kept, len(made)]] if len(kept) else place[:1]
            made = np.frombuffer(made, dtype=np.uint8)[kept].tobytes()
        if mark in made:  # the mark itself is a space to the model
            drop = np.zeros(len(place), dtype=bool)
            for m in re.finditer(mark, made):
                drop[m.start() + 1 : m.end()] = True
                place[m.start() : m.end()] = place[m.start()]
            made, place = made.replace(mark, b" "), place[~drop]
        if self.trim:
            made = made.rstrip(b" ")
            place = place[: len(made) + 1]
        if self.prefix and made:
            made, place = b" " + made, np.r_[place[0] if self.trim else 0, place]
        return made, place


class Pieces:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str, begin: str = "<s>", end: str = "</s>"):
        with open(path, "rb") as f:
            model = list(fields(f.read()))
        trainer = dict(fields(next(v for k, v in model if k == TRAINER)))
        self.normalizer = Normalizer(next((v for k, v in model if k == NORMALIZER), b""))
        self.text, self.kind, score = [], [], []
        for number, value in model:
            if number == PIECES:
                piece = {PIECE_SCORE: struct.pack("<f", 0), PIECE_KIND: NORMAL} | dict(fields(value))
                self.text.append(piece[PIECE_TEXT].decode("utf-8").replace(SPACE_MARK, " "))
                self.kind.append(piece[PIECE_KIND])
                score.append(struct.unpack("<f", piece[PIECE_SCORE])[0])
        if trainer.get(TRAINER_KIND) != BPE or not trainer.get(TRAINER_BYTES) or trainer.get(TRAINER_SPACE_SUFFIX) or set(self.kind) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only byte-pair models with byte fallback and no symbols of their own are read")
        normal = {t: i for i, t in enumerate(self.text) if self.kind[i] == NORMAL}
        if any(" " in t.lstrip(" ") for t in normal):
            raise ValueError("a piece of this model crosses a space; its texts cannot be encoded word by word")
        control = {t: i for i, t in enumerate(self.text) if self.kind[i] == CONTROL}
        self.lines = not any("\n" in t for t in normal)
        self.begin, self.end = control[begin], control[end]
        self.bytes = {int(t[3:5], 16): i for i, t in enumerate(self.text) if self.kind[i] == BYTE}
        self.of_byte = {i: b for b, i in self.bytes.items()}
        self.line_end = struct.pack("<I", self.bytes[10])
        #: Text of ids that need no neighbour to be read, and whether an id is none of them.
        self.plain = ["" if k == CONTROL else chr(self.of_byte[i]) if k == BYTE else t for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True))]
        self.odd = np.array([k == UNKNOWN or k == BYTE and (self.of_byte[i] > 127 or self.of_byte[i] == 32) for i, k in enumerate(self.kind)])
        #: Bytes that an id covers; less than none for the first byte of a longer character.
        self.sizes = np.array([len(t.encode("utf-8")) if k == NORMAL else (1 if (b := self.of_byte[i]) < 128 else 0 if b < 192 else -char_size(b)) if k == BYTE else 0 for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True))], dtype=np.int64)
        self._pairs(normal, score)
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def _pairs(self, normal: dict[str, int], score: list[float]) -> None:
        """Every way to make a piece of two symbols, ranked by the score of the piece."""
        self.symbol = dict(normal)
        for t in normal:
            for c in t:  # characters without a piece may still be parts of one
                self.symbol.setdefault(c, len(self.text) + len(self.symbol))
        self.base = len(self.text) + len(self.symbol) + 1
        places = {s: r for r, s in enumerate(sorted({-score[i] for i in normal.values()}))}
        rank = {i: places[-score[i]] for i in normal.values()}
        table = {}
        for t, i in normal.items():
            for k in range(1, len(t)):
                if (a := self.symbol.get(t[:k])) is not None and (b := self.symbol.get(t[k:])) is not None:
                    table[a * self.base + b] = (rank[i], i)
        self.table = table
        self.lone = {i: c for c, i in self.symbol.items() if i >= len(self.text)}
        self.of_char = np.arange(0x110000, dtype=np.int64) + self.base
        for t, i in self.symbol.items():
            if len(t) == 1:
                self.of_char[ord(t)] = i
        self.keys = np.array(sorted(table), dtype=np.int64)
        self.ranks = np.array([table[k][0] for k in self.keys.tolist()], dtype=np.int64)
        self.results = np.array([table[k][1] for k in self.keys.tolist()], dtype=np.int64)
        #: Pieces that open no merge of a lower rank: all their places can be merged in one round.
        self.safe = np.ones(self.base, dtype=bool)
        for k, (r, _) in table.items():
            for part in divmod(k, self.base):
                if rank.get(part, -1) > r:
                    self.safe[part] = False

    # -- merges -------------------------------------------------------------------------

    def _symbols(self, text: str) -> np.ndarray:
        """Symbols of the characters; a character that is in no piece has a number of its own."""
        return self.of_char[np.frombuffer(text.encode("utf-32-le"), dtype="<u4")]

    def _merge_one(self, word: str) -> list[int]:
        """Merges of one long word, by a heap of pairs."""
        symbols = self._symbols(word).tolist()
        n, base, table = len(symbols), self.base, self.table
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and symbols[i] < base and symbols[after[i]] < base and (known := table.get(symbols[i] * base + symbols[after[i]])):
                heapq.heappush(heap, (known[0], i, symbols[i], symbols[after[i]], known[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = made, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [s for s in symbols if s >= 0]

    def _merge_many(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Merges of many words at once: each round takes the lowest rank of every word.

        Returns the symbols of all words in their order, and where each word ends.
        """
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        symbols = self._symbols("".join(words))
        if not len(symbols):
            return symbols, np.cumsum(lengths)
        owner = np.repeat(np.arange(len(words)), lengths)
        rank, found = np.full(len(symbols), NO_RANK), np.zeros(len(symbols), dtype=np.int64)
        done_symbols, done_owner = [], []
        look = np.arange(len(symbols))  # places whose pair with the next symbol is not looked up yet
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(owner)])
            rank[look] = NO_RANK
            look = look[look < len(symbols) - 1]
            look = look[(owner[look + 1] == owner[look]) & (symbols[look] < self.base) & (symbols[look + 1] < self.base)]
            key = symbols[look] * self.base + symbols[look + 1]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[at] == key
            look, at = look[known], at[known]
            rank[look] = self.ranks[at]
            found[look] = at
            lowest = np.minimum.reduceat(rank, starts)
            more = lowest < NO_RANK
            if not more.all():
                keep = np.repeat(more, sizes)
                done_symbols.append(symbols[~keep])
                done_owner.append(owner[~keep])
                symbols, owner, rank, found = symbols[keep], owner[keep], rank[keep], found[keep]
                lowest, sizes = lowest[more], sizes[more]
                if not len(symbols):
                    break
            where = np.flatnonzero(rank == np.repeat(lowest, sizes))
            made = self.results[found[where]]
            first = np.r_[True, owner[where][1:] != owner[where][:-1]]
            run = np.r_[True, np.diff(where) != 1]  # of overlapping places every second one goes
            opened = np.maximum.accumulate(np.where(run, np.arange(len(where)), 0))
            take = first | (self.safe[made] & ((np.arange(len(where)) - opened) % 2 == 0))
            where, made = where[take], made[take]
            symbols[where] = made
            stay = np.ones(len(symbols), dtype=bool)
            stay[where + 1] = False
            symbols, owner, rank, found = symbols[stay], owner[stay], rank[stay], found[stay]
            look = where - np.arange(len(where))
            look = np.r_[look, look[look > 0] - 1]
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        return symbols[np.argsort(owner, kind="stable")], np.cumsum(np.bincount(owner, minlength=len(words)))

    def merge(self, words: list[str]) -> list[bytes]:
        """Per word its ids as little-endian 32-bit integers."""
        out = {}
        short = [w for w in words if len(w) <= LONG_WORD]
        if short:
            symbols, ends = self._merge_many(short)
            raw, ends = symbols.astype("<u4").tobytes(), (ends * 4).tolist()
            out = {w: raw[a:b] for w, a, b in zip(short, [0, *ends], ends)}
            owners = np.searchsorted(np.array(ends), np.flatnonzero(symbols >= len(self.text)) * 4, side="right")
            for k in np.unique(owners).tolist():
                out[short[k]] = self._fall_back(np.frombuffer(out[short[k]], dtype="<u4").tolist())
        return [out[w] if len(w) <= LONG_WORD else self._fall_back(self._merge_one(w)) for w in words]

    def _fall_back(self, symbols: list[int]) -> bytes:
        """A character without a piece gives the pieces of its bytes."""
        ids = []
        for s in symbols:
            if s < len(self.text):
                ids.append(s)
            else:
                ids += [self.bytes[b] for b in (chr(s - self.base) if s >= self.base else self.lone[s]).encode("utf-8")]
        return np.array(ids, dtype="<u4").tobytes()

    # -- texts --------------------------------------------------------------------------

    def learn(self, words: set[str]) -> None:
        """Encode the words that are new to this worker."""
        new = []
        for w in words:
            if (known := self.old.get(w)) is None:
                new.append(w)
            else:
                self.young[w] = known
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            bodies = [w[1:] if self.lines and w[:1] == "\n" else " " + w for w in part]
            for w, ids in zip(part, self.merge(bodies), strict=True):
                self.young[w] = self.line_end + ids if self.lines and w[:1] == "\n" else ids

    def words(self, text: str) -> list[str]:
        """Words of a normalised text that starts with a space, each without its first space.

        A line end that is in no piece parts words too; such a word keeps it in front.
        """
        if "  " not in text and text[-1] != " " and " \n" not in text:
            return (text.replace("\n", " \n") if self.lines else text).split(" ")[1:]
        return [p[1:] if p[0] == " " else p for p in (LINE_TOKENS if self.lines else PRE_TOKENS).findall(text)]

    def encode_texts(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per text: ids with the begin and end id, and the first and end bytes of each id."""
        split = []
        for t in texts:
            t = t or ""
            size = len(t.encode("utf-8"))
            if self.normalizer.plain(t):
                split.append((self.words(" " + t) if t else [], None, size))
            else:
                made, place = self.normalizer.align(t)
                lead = made.startswith(b" ")
                made = made.decode("utf-8")
                split.append((self.words(made if lead else " " + made) if made else [], (place, not lead), size))
        if len(self.young) > CACHE_WORDS:
            self.old, self.young = self.young, {}
        fresh: set[str] = set()
        for words, _, _ in split:
            fresh.update(words)
        self.learn(fresh - self.young.keys())
        young, out = self.young, []
        first, last = struct.pack("<I", self.begin), struct.pack("<I", self.end)
        for words, alignment, size in split:
            ids = np.frombuffer(b"".join([first, *[young[w] for w in words], last]), dtype="<u4")
            out.append((ids, *self._spans(ids, alignment, size)))
        return out

    def _spans(self, ids: np.ndarray, alignment, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of all ids in the original bytes; the begin and end ids are empty places.

        Of the bytes of a character without a piece, the last one stands for the character, as
        in the library, and the others are empty places before it.
        """
        sizes = self.sizes[ids]
        for lead in np.flatnonzero(sizes < 0).tolist():
            sizes[lead - sizes[lead] - 1] = -sizes[lead]
            sizes[lead] = 0
        ends = np.cumsum(sizes)
        begins = ends - sizes
        if alignment is None:
            begins, ends = np.maximum(begins - 1, 0), np.maximum(ends - 1, 0)
        else:
            place, no_lead = alignment
            begins, ends = place[np.maximum(begins - no_lead, 0)], place[np.maximum(ends - no_lead, 0)]
        begins[0] = ends[0] = 0
        begins[-1] = ends[-1] = size
        return begins, ends

    def decode(self, ids) -> str:
        """The text of any ids: control ids give nothing, byte runs are read as UTF-8."""
        ids = np.asarray(ids, dtype=np.int64)
        if not len(ids) or self.odd[ids].any():
            return self._decode_odd(ids.tolist())
        text = "".join(map(self.plain.__getitem__, ids.tolist()))
        return text[1:] if self.normalizer.prefix and text.startswith(" ") else text

    def _decode_odd(self, ids: list[int]) -> str:
        out: list[str] = []
        pending = bytearray()
        at_start = True

        def flush() -> None:
            nonlocal at_start
            if pending:
                out.append(self._utf8(bytes(pending)))
                pending.clear()
                at_start = False

        for i in ids:
            kind = self.kind[i]
            if kind == BYTE:
                pending.append(self.of_byte[i])
                continue
            flush()
            if kind == CONTROL:
                continue
            t = UNKNOWN_SURFACE if kind == UNKNOWN else self.text[i]
            if at_start and kind == NORMAL and self.normalizer.prefix and t.startswith(" "):
                t = t[1:]
            at_start = False
            out.append(t)
        flush()
        return "".join(out)

    @staticmethod
    def _utf8(data: bytes) -> str:
        """UTF-8 in which every byte that starts no character gives one replacement sign."""
        out, at = [], 0
        while at < len(data):
            try:
                out.append(data[at:].decode("utf-8"))
                break
            except UnicodeDecodeError as e:
                out.append(data[at : at + e.start].decode("utf-8") + "�")
                at += e.start + 1
        return "".join(out)


@lru_cache(maxsize=1)
def _load(path: str) -> Pieces:
    return Pieces(path)


def load(path: str) -> Pieces:
    common.hold_cache("sentence pieces", _load.cache_clear)
    return _load(path)


ADDED = ("ids", "begins", "ends")


def encode(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """``docs`` with ids, begins, ends (array<int>): the ids of ``text`` with the begin and end
    ids, and for each id the bytes [begin, end) of the text's UTF-8 that it came from.

    Null counts as empty (the begin and end ids alone).  Extra columns stay, columns named like
    an added one are replaced; repeated rows stay repeated; whole texts of any length; an empty
    table gives no rows.
    """
    kept = [c for c in docs.columns if c not in ADDED]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coded = load(vocabulary).encode_texts(batch.column(batch.schema.get_field_index(text)).to_pylist())
        arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept]
        values = [pa.array([c[k].astype(np.int32) for c in coded], type=pa.list_(pa.int32())) for k in range(3)]
        return pa.RecordBatch.from_arrays([*arrays, *values], names=[*kept, *ADDED])

    schema = StructType([docs.schema[c] for c in kept])
    for name in ADDED:
        schema = schema.add(name, ArrayType(IntegerType()))
    return common.map_batches(docs.select(*kept), run, schema)


def decode(coded: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``coded`` with ``text``: the decoded ids; null ids give an empty string, ids beyond the model nothing."""
    kept = [c for c in coded.columns if c != text]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = load(vocabulary)
        texts = [model.decode([i for i in x or [] if i is not None and 0 <= i < len(model.text)]) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
        arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(texts, type=pa.string())], names=[*kept, text])

    return common.map_batches(coded, run, StructType([coded.schema[c] for c in kept]).add(text, StringType()))


def round_trip_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers),
    decoded_sha256 (the decoded text), spans_sha256 (begins, then ends, in the same form).

    Null and empty texts have the begin and end ids alone; repeated rows give repeated results;
    columns besides doc_id and text are not read.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = load(vocabulary)
        coded = model.encode_texts(batch.column(1).to_pylist())
        digest = lambda x: hashlib.sha256(x).hexdigest()
        columns = [
            batch.column(0),
            pa.array([len(c[0]) for c in coded], type=pa.int64()),
            pa.array([digest(c[0]) for c in coded], type=pa.string()),
            pa.array([digest(model.decode(c[0]).encode("utf-8")) for c in coded], type=pa.string()),
            pa.array([digest(np.concatenate(c[1:]).astype("<u4").tobytes()) for c in coded], type=pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.map_batches(rows, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")
