"""Phrase collocations from Misra-Gries summaries and an exact second pass (op11).

Frequent words, then frequent phrases are found the same way.  Every task makes
a summary of the hashed n-grams it reads; summaries are dealt out by hash and
merged a hash partition at a time: counters of equal keys are added, and beyond
the capacity the greatest count that has no room is taken off all of them.  The
capacity exceeds the partition's occurrences divided by the threshold (ten times,
so that few others survive), so what has been taken off stays below the
threshold, and whatever is frequent keeps a counter that reaches the threshold
with what was taken off.  Hashes that fall together only add to a count.  What survives marks the bits of a filter of
bounded size; the second pass counts the words and phrases that the filter lets
through exactly, by their letters.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, saved, small

LONGEST = 5
#: Keys a task holds before it writes its summary, and counted phrases.
HELD_KEYS, HELD_PHRASES = 4_000_000, 500_000
#: Counters of a summary for each threshold's worth of occurrences: what is taken
#: off a counter stays below a tenth of the threshold.
ROOM = 10
#: Bits of a filter: so many for each survivor, within these bounds (32 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 64, 1 << 16, 1 << 28

_GAP, _BREAK = 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(b" \t")] = _GAP
_CLASS[list(b".,;:!?\n\v\f\r")] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class Words:
    """The words of a batch of texts: ``names`` has each distinct one, ``ids``
    and ``lang`` say which each is and the language it is in, and ``piece``
    numbers the pieces they stand in."""

    def __init__(self, batch: pa.RecordBatch):
        texts = batch.column("text").cast(pa.large_binary())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        kind = _CLASS[data]
        inside = kind == 0
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        within = ends[(ends > 0) & (ends < len(data))]
        first[within] = inside[within]  # a text's end ends its word
        last[within - 1] = inside[within - 1]
        starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
        offsets = np.concatenate(([0], np.cumsum(stops - starts)))
        letters = _LOWER[data[inside]]
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters)]).dictionary_encode()
        self.names: list[bytes] = words.dictionary.to_pylist()
        self.ids = words.indices.to_numpy().astype(np.int64)
        text = np.searchsorted(ends[1:], starts, "right")
        breaks = np.searchsorted(np.flatnonzero(kind == _BREAK), starts)
        self.piece = breaks + text  # neither falls, so equal sums mean that both are equal
        langs = batch.column("lang").dictionary_encode()
        self.langs: list[str] = langs.dictionary.to_pylist()
        self.lang = langs.indices.to_numpy().astype(np.int64)[text]

    def keys(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length: hashes of language and phrase, and where the phrase
        lies in one piece, by its first word."""
        hashed = np.fromiter(map(xxhash.xxh64_intdigest, self.names), np.uint64, len(self.names))[self.ids]
        key = _mixed(hashed + np.fromiter(map(xxhash.xxh64_intdigest, self.langs), np.uint64, len(self.langs))[self.lang])
        yield 1, key, np.ones(len(key), bool)
        for n in range(2, LONGEST + 1):
            if len(hashed) < n:
                return
            key = _mixed(key[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashed[n - 1 :])
            yield n, key, self.piece[n - 1 :] == self.piece[: 1 - n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


@dataclass
class Filter:
    """Bits of surviving keys.  A key has a hash partition (its upper 32 bits)
    and within that partition's ``span`` bits a place (its lower ones)."""

    parts: int
    span: int
    bits: Broadcast

    def holds(self, keys: np.ndarray) -> np.ndarray:
        bits = np.frombuffer(self.bits.value, np.uint8)
        part, rest = _placed(keys, self.parts)
        at = part * self.span + _spot(rest, self.span)
        return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _placed(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    return (((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64), keys & np.uint64(0xFFFFFFFF)


def _spot(rest: np.ndarray, span: int) -> np.ndarray:
    return ((rest.astype(np.uint64) * np.uint64(span)) >> np.uint64(32)).astype(np.int64)


def _windows(words: Words, known: list[Filter], longest: int = LONGEST) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length: hashes, and the places that ``known`` lets through.  The
    first filter judges words, the second pairs of words; a longer phrase
    passes if all its words and pairs do."""
    passed = None
    for n, keys, whole in words.keys():
        passed = whole if passed is None else passed[:-1] & passed[1:] & whole
        if n <= len(known):
            at = np.flatnonzero(passed)
            passed = np.zeros(len(keys), bool)
            passed[at] = known[n - 1].holds(keys[at])
        yield n, keys, passed
        if n == longest:
            return


class Summary:
    """A Misra-Gries summary of weighted keys; ``off`` is what has been taken
    off every counter."""

    def __init__(self, capacity: int):
        self.capacity, self.off = capacity, 0
        self.keys, self.counts = np.empty(0, np.uint32), np.empty(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Merge the counters of another summary that nothing was taken off."""
        self.waiting.append((keys, counts))
        self.n_waiting += len(keys)
        if self.n_waiting > max(self.capacity, 1 << 20):
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
        self.waiting, self.n_waiting = [], 0
        if not len(keys):
            return
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        self.keys, self.counts = keys[heads], np.add.reduceat(counts[order], heads)
        over = len(heads) - self.capacity
        if over > 0:
            least = int(np.partition(self.counts, over - 1)[over - 1])
            self.off += least
            kept = self.counts > least
            self.keys, self.counts = self.keys[kept], self.counts[kept] - least

    def survivors(self, threshold: int) -> np.ndarray:
        self.merge()
        return self.keys[self.counts + self.off >= threshold]


def _survivors(texts: DataFrame, lengths: range, known: list[Filter], threshold: int, parts: int) -> DataFrame:
    """part and keys (little-endian uint32) of what may reach the threshold."""
    partial = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("mass", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a task counts: for each hash partition the occurrences (kind 0),
        and the counters (kind 1)."""
        held: list[np.ndarray] = []

        def written() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            part, rest = _placed(keys, parts)
            there, heads = np.unique(part, return_index=True)
            mass = np.add.reduceat(counts, heads)
            raw, much = rest.astype("<u4"), counts.astype("<u4")
            cuts = [*heads.tolist(), len(keys)]
            blobs = [[a[i:j].tobytes() for i, j in zip(cuts, cuts[1:])] for a in (raw, much)]
            n, none = len(there), [None] * len(there)
            columns = [np.tile(there, 2), np.repeat([0, 1], n), np.concatenate([mass, np.zeros(n, np.int64)]), none + blobs[0], none + blobs[1]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, partial)], schema=partial)

        for batch in batches:
            if not batch.num_rows:
                continue
            for n, keys, passed in _windows(Words(batch), known, lengths[-1]):
                if n in lengths and passed.any():
                    held.append(keys[passed])
            if sum(map(len, held)) > HELD_KEYS:
                yield written()
        if held:
            yield written()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Occurrences of a partition stand in front of its counters."""
        schema = pa.schema([("part", pa.int32()), ("keys", pa.binary())])
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in partial.names)))
        for part, of in groupby(rows, key=lambda row: row[0]):
            mass, summary = 0, None
            for _, kind, more, keys, counts in of:
                if kind == 0:
                    mass += more
                    continue
                summary = summary or Summary(ROOM * mass // threshold + 1)
                summary.add(np.frombuffer(keys, "<u4"), np.frombuffer(counts, "<u4").astype(np.int64))
            if summary is not None:
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([summary.survivors(threshold).astype("<u4").tobytes()], pa.binary())], schema=schema)

    made = map_batches(texts, summaries, "part int, kind int, mass long, keys binary, counts binary")
    dealt = made.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "kind")
    return saved(map_batches(dealt, merged, "part int, keys binary"), "phrase-survivors")


def _filter(found: DataFrame, parts: int) -> Filter:
    """The bits of survivors: at most ``MOST_BITS``, whatever their number, so
    that they can be broadcast.  With more than a few survivors a bit they let
    more through, which costs work and no phrase."""
    n = found.agg(F.sum(F.length("keys"))).first()[0] or 0
    span = max(8, min(MOST_BITS, max(LEAST_BITS, BITS_EACH * n // 4)) // parts // 8 * 8)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for keys in batch.column("keys").to_pylist():
                marked = np.zeros(span, bool)
                marked[_spot(np.frombuffer(keys, "<u4"), span)] = True
                rows.append(np.packbits(marked, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(rows, pa.binary())], names=["part", "bits"])

    whole = bytearray(parts * span // 8)
    for row in found.mapInArrow(bits, "part int, bits binary").collect():
        whole[row.part * span // 8 : (row.part + 1) * span // 8] = row.bits
    return Filter(parts, span, found.sparkSession.sparkContext.broadcast(bytes(whole)))


def _counted(texts: DataFrame, known: list[Filter], longer: Filter, threshold: int, parts: int) -> DataFrame:
    """lang, size, phrase and n: exact occurrences of every word and phrase that
    the filters let through and that reach the threshold; size 0 has all words
    of a language.  A task tells each hash partition all its counts in one row."""
    counts = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])
    partial = pa.schema([("part", pa.int32()), ("counts", pa.list_(pa.struct(list(counts))))])

    def in_batch(words: Words) -> Iterator[tuple[tuple[int, str, int, bytes], int]]:
        many = max(len(words.names), 1)
        for lang, n in enumerate(np.bincount(words.lang, minlength=len(words.langs)).tolist()):
            yield (0, words.langs[lang], 0, b""), n
        for n, keys, passed in _windows(words, known):
            at = np.flatnonzero(passed)
            if n > len(known):
                at = at[longer.holds(keys[at])]
            code = words.lang[at] * many + words.ids[at]
            for j in range(1, n):  # equal codes mean equal phrases, not just equal hashes
                code = np.unique(code, return_inverse=True)[1] * many + words.ids[at + j]
            _, first, found = np.unique(code, return_index=True, return_counts=True)
            at = at[first]
            for i, part, count in zip(at.tolist(), _placed(keys[at], parts)[0].tolist(), found.tolist()):
                yield (part, words.langs[words.lang[i]], n, b" ".join(words.names[k] for k in words.ids[i : i + n].tolist())), count

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def written() -> pa.RecordBatch:
            each = sorted(held.items(), key=lambda e: e[0][0])
            held.clear()
            part, langs, sizes, phrases = zip(*(name for name, _ in each))
            there, heads = np.unique(part, return_index=True)
            flat = pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(sizes, pa.int32()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array([n for _, n in each], pa.int64())], fields=list(counts))
            lists = pa.ListArray.from_arrays(pa.array([*heads.tolist(), len(each)], pa.int32()), flat)
            return pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), lists.cast(partial.field("counts").type)], schema=partial)

        for batch in batches:
            if batch.num_rows:
                for name, n in in_batch(Words(batch)):
                    held[name] += n
            if len(held) > HELD_PHRASES:
                yield written()
        if held:
            yield written()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The counts of a partition stand side by side."""
        lists = ((part, batch.column("counts")[i].values) for batch in batches for i, part in enumerate(batch.column("part").to_pylist()))
        for _, of in groupby(lists, key=lambda x: x[0]):
            total: Counter = Counter()
            for _, flat in of:
                *names, n = (column.to_pylist() for column in flat.flatten())
                for name, k in zip(zip(*names), n):
                    total[name] += k
            kept = [(*name, n) for name, n in total.items() if n >= threshold or not name[1]]
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept), counts)], schema=counts)

    made = map_batches(texts, rows, "part int, counts array<struct<lang:string,size:int,phrase:string,n:long>>")
    dealt = made.repartitionById(parts, F.col("part")).sortWithinPartitions("part")
    return map_batches(dealt, summed, "lang string, size int, phrase string, n long")


def frequent_phrases(docs: DataFrame, threshold: int = 100, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, size, phrase and n of all words (size 1) and phrases (2 to 5 words)
    that occur ``threshold`` times or more, and of all words of a language
    together (size 0, an empty phrase).  See ``mine_collocations`` for odd rows."""
    if threshold < 1:
        raise ValueError("the threshold is a number of occurrences, 1 or more")
    spark = docs.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    known: list[Filter] = []
    for lengths in (range(1, 2), range(2, 3)):
        known.append(_filter(_survivors(texts, lengths, known, threshold, parts), parts))
    longer = _filter(_survivors(texts, range(3, LONGEST + 1), known, threshold, parts), parts)
    return saved(_counted(texts, known, longer, threshold, parts), "phrase-counts")


def _scored(counts: DataFrame) -> DataFrame:
    """Phrases of two words or more with a, l, r, n and the score of their
    lowest-scoring cut."""
    words = F.split("phrase", " ")
    joined = lambda start, length: F.array_join(F.slice(words, start, length), " ")
    cuts = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(k.alias("k"), joined(F.lit(1), k).alias("head"), joined(k + 1, F.col("size") - k).alias("tail")))
    phrases = counts.where("size >= 2").select("lang", "phrase", F.col("n").alias("a"), F.inline(cuts))
    part = lambda name, count: counts.where("size >= 1").select(F.col("lang"), F.col("phrase").alias(name), F.col("n").alias(count))
    both = phrases.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    totals = counts.where("size = 0").select("lang", "n")
    both = both.join(small(totals, totals.count()), "lang")
    score = F.expr("(1000 * cast(a as decimal(38, 0)) * cast(n as decimal(20, 0))) div (cast(l as decimal(20, 0)) * cast(r as decimal(18, 0)))")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return both.groupBy("lang", "phrase", "a", "n").agg(lowest).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def _covered(counts: DataFrame) -> DataFrame:
    """Phrases that no longer one holds each time they occur."""
    words = F.split("phrase", " ")
    inner = lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice(words, i, m), " "))
    shorter = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), inner))
    phrases = counts.where("size >= 2")
    own = phrases.select("lang", "phrase", F.col("n").alias("a"), F.lit(None).cast("long").alias("longer"))
    held = phrases.where("size >= 3").select("lang", F.explode(F.array_distinct(shorter)).alias("phrase"), F.lit(None).cast("long").alias("a"), F.col("n").alias("longer"))
    return own.union(held).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("longer").alias("longer")).where("a is not null and longer >= a").select("lang", "phrase")


def mine_collocations(docs: DataFrame, threshold: int = 100, most: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's ``most``
    best phrases of 2 to 5 words that occur ``threshold`` times or more.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line breaks,
    and those into words at spaces and tabs; no phrase goes over a piece.  A
    phrase occurs ``a`` times; of its cuts into a first part with ``l`` and a
    rest with ``r`` occurrences, the one with the lowest
    ``floor(1000 * a * n / (l * r))`` counts, ``n`` being all words of the
    language.  Phrases that a longer one holds at each occurrence are left out.

    A null text is empty, a null language ``und``; rows without words, and empty
    tables, add nothing; repeated rows count each time.  Memory holds a batch
    (1000 rows or 64 MB of text, or one longer text) some ten times over.
    """
    counts = frequent_phrases(docs, threshold, text_col, lang_col)
    ranked = _scored(counts).join(_covered(counts), ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = ranked.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    place = F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))
    best = salted.withColumn("place", place).where(F.col("place") <= most)  # all that can be among the best of the language
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return best.withColumn("rank", rank).where(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
