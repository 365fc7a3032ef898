"""SentencePiece ids of whole texts, and texts of ids (op13).

A merge-type vocabulary is applied with an agenda of adjacent symbol pairs, the
best score first and the leftmost of equal ones: a popped pair becomes one
symbol, and its pairs with the two neighbours are entered.  Where no piece has
a space mark behind another character, no pair crosses the front of a space, so
a text is the concatenation of its units (a run of space marks and what
follows), and units seen before need not be merged again.

Short units share one agenda in numpy: a row of scores a unit, whose least entry
is the next pair of that unit, and all units of a length merge one pair a step.
Long ones have a heap and linked symbols, n log n in their length.  Every unit
that is learnt is compared with the sentencepiece library, batch by batch.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts_of

SPACE = "▁"
_BPE, _NORMAL, _UNKNOWN, _USER, _UNUSED, _BYTE = 2, 1, 2, 4, 5, 6  # fixed values of the model format
_NONE = np.iinfo(np.int32).max  # score of a pair that is no piece
_ROWS = 20_000  # units that are merged together
_UNITS = re.compile(f"{SPACE}+[^{SPACE}]*")


class PairTable:
    """Ranks and pieces of symbol pairs, looked up many at a time.

    A pair has a slot in the first of several layers in which it is free; each
    layer has four slots or more for each pair that is left.  A look-up goes on
    to the next layer only where the slot holds another pair.
    """

    def __init__(self, keys: np.ndarray, ranks: np.ndarray, pieces: np.ndarray):
        self.layers: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        while len(keys):
            bits = max(4, (4 * len(keys) - 1).bit_length())
            slots, first = np.unique(self._slot(keys, bits), return_index=True)
            layer = (np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int32), np.full(1 << bits, -1, np.int32))
            for array, values in zip(layer, (keys, ranks, pieces)):
                array[slots] = values[first]
            self.layers.append((bits, *layer))
            keys, ranks, pieces = (np.delete(a, first) for a in (keys, ranks, pieces))

    @staticmethod
    def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each key; a key that is not there has no rank."""
        ranks, pieces = np.full(keys.shape, _NONE, np.int32), np.full(keys.shape, -1, np.int32)
        flat_ranks, flat_pieces, left, at = ranks.reshape(-1), pieces.reshape(-1), keys.reshape(-1), None
        for bits, known, rank, piece in self.layers:
            slots = self._slot(left, bits)
            held = known[slots]
            hit = np.flatnonzero(held == left)
            where = hit if at is None else at[hit]
            flat_ranks[where], flat_pieces[where] = rank[slots[hit]], piece[slots[hit]]
            on = np.flatnonzero((held != left) & (held >= 0))
            if not len(on):
                break
            left, at = left[on], on if at is None else at[on]
        return ranks, pieces


class PieceEncoder:
    """Encodes texts to little-endian int32 ids.

    ``check``: compare what is learnt with the library and raise where it
    differs.  ``max_units`` bounds the units that are kept; ``long`` is the
    number of symbols from which a unit has a heap.
    """

    def __init__(self, path: str, check: bool = True, max_units: int = 500_000, long: int = 40):
        from sentencepiece import sentencepiece_model_pb2 as format

        with open(path, "rb") as file:
            proto = file.read()
        model = format.ModelProto.FromString(proto)
        kinds = [p.type for p in model.pieces]
        if model.trainer_spec.model_type != _BPE or _UNUSED in kinds:
            raise ValueError(f"{path}: not a merge-type vocabulary, or one with unused pieces")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.check, self.max_units, self.long = check, max_units, long
        names = [p.piece for p in model.pieces]
        self.n = len(names)
        self.symbols = {p: i for i, (p, kind) in enumerate(zip(names, kinds)) if kind in (_NORMAL, _USER)}
        self.unknown = kinds.index(_UNKNOWN)
        self.bytes = [names.index(f"<0x{b:02X}>") for b in range(256)] if model.trainer_spec.byte_fallback else None
        user = sorted((p for p, kind in zip(names, kinds) if kind == _USER), key=len, reverse=True)
        self.user = re.compile("|".join(map(re.escape, user))) if user else None
        spec = model.normalizer_spec
        self.plain = not spec.precompiled_charsmap and spec.add_dummy_prefix and not spec.remove_extra_whitespaces and spec.escape_whitespaces
        self.cuts = not any(a != SPACE and b == SPACE for p in self.symbols for a, b in zip(p, p[1:])) and spec.add_dummy_prefix and spec.escape_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix
        self.of_char = np.arange(0x110000, dtype=np.int64) + self.n  # a character without a piece stands for itself
        single = {ord(p): i for p, i in self.symbols.items() if len(p) == 1}
        self.of_char[list(single)] = list(single.values())
        self.base = self.n + 0x110000
        self.table = self._pairs([p.score for p in model.pieces])
        self.known = _Known()

    def _symbol(self, part: str) -> int | None:
        return int(self.of_char[ord(part)]) if len(part) == 1 else self.symbols.get(part)

    def _pairs(self, scores: list[float]) -> PairTable:
        """Every way to put a piece together from two symbols; equal scores
        have equal ranks."""
        found = []
        for piece, i in self.symbols.items():
            for k in range(1, len(piece)):
                a, b = self._symbol(piece[:k]), self._symbol(piece[k:])
                if a is not None and b is not None:
                    found.append((a * self.base + b, -scores[i], i))
        keys, cost, made = zip(*found) if found else ((), (), ())
        return PairTable(np.array(keys, np.int64), np.unique(np.array(cost, np.float32), return_inverse=True)[1].astype(np.int32), np.array(made, np.int64))

    def _ids(self, symbols: list[int]) -> bytes:
        """Ids of symbols: those that are no pieces become bytes, or, without
        byte pieces, a run of them becomes the unknown id."""
        out: list[int] = []
        for s in symbols:
            if s < self.n:
                out.append(s)
            elif self.bytes is not None:
                out += [self.bytes[b] for b in chr(s - self.n).encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return np.array(out, "<i4").tobytes()

    def _together(self, units: list[str]) -> list[bytes]:
        """Ids of units of one length: each step merges the first pair of the
        agenda of every unit that still has one."""
        width, out = len(units[0]), [b""] * len(units)
        symbols = self.of_char[np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(units), width)]
        rows = np.arange(len(units))
        ranks, pieces = self.table.find(symbols[:, :-1] * self.base + symbols[:, 1:])
        while True:
            width = symbols.shape[1]
            best = ranks.argmin(1) if width > 1 else np.zeros(len(rows), np.int64)
            each = np.arange(len(rows))
            done = ranks[each, best] == _NONE if width > 1 else np.ones(len(rows), bool)
            if done.any():
                ended, at = symbols[done], rows[done].tolist()
                raw = ended.astype("<i4").tobytes()
                for j, (row, odd) in enumerate(zip(at, (ended >= self.n).any(1).tolist())):
                    out[row] = self._ids(ended[j].tolist()) if odd else raw[4 * width * j : 4 * width * (j + 1)]
                rest = ~done
                if not rest.any():
                    return out
                symbols, ranks, pieces, rows, best = (a[rest] for a in (symbols, ranks, pieces, rows, best))
                each = np.arange(len(rows))
            symbols[each, best] = pieces[each, best]
            places = np.arange(width)
            symbols = symbols[places != best[:, None] + 1].reshape(len(rows), width - 1)
            kept = places[:-1] != best[:, None]
            ranks, pieces = (a[kept].reshape(len(rows), width - 2) for a in (ranks, pieces))
            for at, there in ((best - 1, best > 0), (best, best < width - 2)):  # pairs with the neighbours
                i, j = each[there], at[there]
                ranks[i, j], pieces[i, j] = self.table.find(symbols[i, j] * self.base + symbols[i, j + 1])

    def _alone(self, unit: str) -> bytes:
        """Ids of one long unit, by a heap over linked symbols.  User-defined
        pieces are cut out first and join no pair."""
        symbols: list[int] = []
        frozen: set[int] = set()
        end = 0
        for m in self.user.finditer(unit) if self.user else ():
            symbols += self.of_char[[ord(c) for c in unit[end : m.start()]]].tolist()
            frozen.add(len(symbols))
            symbols.append(self.symbols[m.group()])
            end = m.end()
        symbols += self.of_char[np.frombuffer(unit[end:].encode("utf-32-le", "surrogatepass"), "<u4")].tolist()
        n = len(symbols)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        at = np.array(symbols, np.int64)
        ranks, pieces = (a.tolist() for a in self.table.find(at[:-1] * self.base + at[1:]))
        agenda = [(r, i, symbols[i], symbols[i + 1], p) for i, (r, p) in enumerate(zip(ranks, pieces)) if r != _NONE and i not in frozen and i + 1 not in frozen]
        heapq.heapify(agenda)
        found: dict[int, tuple[int, int]] = {}

        def enter(i: int) -> None:
            j = after[i] if i >= 0 else -1
            if j < 0 or i in frozen or j in frozen:
                return
            key = symbols[i] * self.base + symbols[j]
            if key not in found:
                rank, piece = self.table.find(np.array([key]))
                found[key] = (int(rank[0]), int(piece[0]))
            rank, piece = found[key]
            if rank != _NONE:
                heapq.heappush(agenda, (rank, i, symbols[i], symbols[j], piece))

        while agenda:
            _, i, left, right, piece = heapq.heappop(agenda)
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue  # one of the two has become part of another symbol
            symbols[i], symbols[j] = piece, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            enter(before[i])
            enter(i)
        return self._ids([s for s in symbols if s >= 0])

    def merged(self, units: list[str]) -> list[bytes]:
        """Ids of each unit, space marks included."""
        out, lengths = [b""] * len(units), {}
        for i, unit in enumerate(units):
            if len(unit) >= self.long or self.user and self.user.search(unit):
                out[i] = self._alone(unit)
            elif unit:
                lengths.setdefault(len(unit), []).append(i)
        for of in lengths.values():
            for start in range(0, len(of), _ROWS):
                part = of[start : start + _ROWS]
                for i, ids in zip(part, self._together([units[i] for i in part])):
                    out[i] = ids
        return out

    def _learn(self, keys: list[str]) -> dict[str, bytes]:
        """Ids of units, which the keys name without their first space mark."""
        found = self.merged([SPACE + k for k in keys])
        if self.check and self.plain:
            asked = [i for i, k in enumerate(keys) if k]  # nothing in front of a text is its own mark
            self._compare([keys[i].replace(SPACE, " ") for i in asked], [found[i] for i in asked])
        return dict(zip(keys, found))

    def _compare(self, texts: list[str], found: list[bytes]) -> None:
        theirs = self.library.encode(texts, num_threads=1)
        if [len(f) // 4 for f in found] == list(map(len, theirs)) and np.array_equal(np.frombuffer(b"".join(found), "<i4"), np.fromiter(chain.from_iterable(theirs), "<i4")):
            return
        wrong = next(t for t, f, ids in zip(texts, found, theirs) if np.frombuffer(f, "<i4").tolist() != ids)
        raise ValueError(f"ids differ from the library's for {wrong[:200]!r}")

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.cuts:
            out = self.merged([self.library.normalize(t) for t in texts])
        else:
            out = self._by_units(texts)
        if self.check and not (self.plain and self.cuts):
            self._compare(texts, out)
        return out

    def _by_units(self, texts: list[str]) -> list[bytes]:
        split = []
        for text in texts:
            marked = text.replace(" ", SPACE) if self.plain else self.library.normalize(text)[1:]
            if not text or not (marked or self.plain):
                split.append([])
            elif SPACE * 2 in marked or marked.startswith(SPACE):
                split.append([u[1:] for u in _UNITS.findall(SPACE + marked)])
            else:
                split.append(marked.split(SPACE))
        known = self.known
        new = list({k for keys in split for k in keys if k not in known})
        found = self._learn(new) if new else {}
        if len(known) + len(found) <= self.max_units:
            known.update(found)  # full: what came first, thus the frequent units, stays
        known.found = found
        out = [b"".join(map(known.__getitem__, keys)) for keys in split]
        return out if self.bytes is not None else [self._joined(ids) for ids in out]

    def _joined(self, ids: bytes) -> bytes:
        """Runs of the unknown id as one, as a run may go over units."""
        a = np.frombuffer(ids, "<i4")
        again = np.zeros(len(a), bool)
        again[1:] = (a[1:] == self.unknown) & (a[:-1] == self.unknown)
        return a[~again].tobytes()


class _Known(dict):
    """Ids of units, by the unit; those of the batch's own units stand beside."""

    found: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        return self.found[key]


_ENCODERS: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(path: str, check: bool = True) -> PieceEncoder:
    """One encoder a Python worker; workers serve many tasks."""
    if (path, check) not in _ENCODERS:
        _ENCODERS[path, check] = PieceEncoder(path, check)
    return _ENCODERS[path, check]


_LIBRARIES: dict[str, sentencepiece.SentencePieceProcessor] = {}


def library(path: str) -> sentencepiece.SentencePieceProcessor:
    """The library's processor alone, one a Python worker."""
    if path not in _LIBRARIES:
        _LIBRARIES[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _LIBRARIES[path]


def default_model() -> str:
    """Where the public 32k merge-type model lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_pieces(docs: DataFrame, model: str, check: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every whole text, without begin or end
    ids, one row out for each row in and nothing shuffled.

    Null and empty texts have no ids; rows without an id and repeated rows stay.
    Memory holds a batch (1000 rows or 64 MB of text), the units kept and, for a
    text without spaces, about 200 bytes a character.  A model that is not of the
    merge type raises, as does an id that differs from the library's.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(model, check)
        for batch in batches:
            found = pieces.encode(texts_of(batch, "text"))
            ends = np.concatenate(([0], np.cumsum([len(f) // 4 for f in found], dtype=np.int64))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4"), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], schema=schema)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(narrow, rows, "doc_id long, ids array<int>")


def decode_pieces(tokens: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, ids and the text that the library's ``decode`` makes of them.

    Null ids have no text and no ids an empty one; an id beyond the vocabulary
    raises.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("text", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = library(model)
        for batch in batches:
            lists = batch.column("ids").to_pylist()
            texts = iter(processor.decode([x for x in lists if x is not None], num_threads=1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids").cast(schema.field("ids").type), pa.array([None if x is None else next(texts) for x in lists], pa.string())], schema=schema)

    narrow = tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return map_batches(narrow, rows, "doc_id long, ids array<int>, text string")
