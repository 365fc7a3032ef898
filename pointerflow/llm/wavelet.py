"""Token ids on disk as wavelet matrices (op9).

The written form is a Parquet table, one file a shard, a shard being a range of
the order key.  Its wavelet matrix is kept in blocks, so that neither writing
nor reading holds a shard: a row is a block of whole consecutive documents with
about ``block_tokens`` ids, its bit-planes, their rank directories and the
directory of its documents.  What a token counts before a block is the sum of
the blocks ahead of it, and ``read_token_shards`` adds the ids ahead of it.

============ ======================================================
column       content
============ ======================================================
shard        number of the shard; shards ascend with the order key
block        number of the block in its shard
n_tokens     ids in the block
bits         bit-planes, the highest bit first
doc_ids      id of each document
doc_lengths  little-endian uint32, ids of each document
zeros        little-endian uint32 for each plane, its zero bits
ranks        for each plane, little-endian uint32: its ones before
             each run of 64 bytes, and all of its ones
planes       each plane zstandard-compressed, as a list
============ ======================================================
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, small, texts_of
from .ordered import Ranges
from .tokens import encoder

BLOCKS = "shard long, block long, n_tokens long, bits int, doc_ids array<long>, doc_lengths binary, zeros binary, ranks array<binary>, planes array<binary>"
_ARROW = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("n_tokens", pa.int64()), ("bits", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.binary()), ("zeros", pa.binary()), ("ranks", pa.list_(pa.binary())), ("planes", pa.list_(pa.binary()))])


class WaveletMatrix:
    """Access, count and occurrence lookup over a sequence of token ids.

    Plane ``l`` holds bit ``bits - 1 - l`` of all ids, in the order that stable
    partitions by the bits above it leave.  A plane is unpacked when it is first
    asked for: a lookup that ends early leaves the others alone.
    """

    STEP = 64  # bytes between the entries of a plane's rank directory

    def __init__(self, n: int, bits: int, plane: Callable[[int], np.ndarray], zeros: list[int], ranks: list[np.ndarray]):
        self.n, self.bits, self.zeros, self.ranks = n, bits, zeros, ranks
        self._plane, self._planes = plane, {}

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        if len(ids) and int(ids.max()) >> bits:
            raise ValueError(f"id {int(ids.max())} does not fit {bits} bit-planes")
        x = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros, ranks = [], [], []
        for bit in range(bits - 1, -1, -1):
            on = (x & x.dtype.type(1 << bit)) != 0
            plane = np.packbits(on)
            runs = np.add.reduceat(np.bitwise_count(plane), np.arange(0, len(plane), cls.STEP), dtype=np.uint32) if len(plane) else np.zeros(0, np.uint32)
            planes.append(plane), ranks.append(np.concatenate([[0], np.cumsum(runs)]).astype("<u4"))
            low = x.take(np.flatnonzero(~on))
            zeros.append(len(low))
            x = np.concatenate([low, x.take(np.flatnonzero(on))])
        return cls(len(ids), bits, planes.__getitem__, zeros, ranks)

    @classmethod
    def of_row(cls, n: int, bits: int, zeros: bytes, ranks: list[bytes], planes: list[bytes]) -> WaveletMatrix:
        unpack = zstandard.ZstdDecompressor().decompress
        return cls(n, bits, lambda level: np.frombuffer(unpack(planes[level]), np.uint8), np.frombuffer(zeros, "<u4").tolist(), [np.frombuffer(r, "<u4") for r in ranks])

    def plane(self, level: int) -> np.ndarray:
        if level not in self._planes:
            self._planes[level] = self._plane(level)
        return self._planes[level]

    def _bits_of(self, level: int) -> np.ndarray:
        return np.unpackbits(self.plane(level), count=self.n).view(bool)

    def decode(self) -> np.ndarray:
        """All ids: the stable partitions undone, the last one first."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        x = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            on = self._bits_of(level)
            y, z = np.empty_like(x), self.zeros[level]
            y[np.flatnonzero(~on)] = x[:z]
            y[np.flatnonzero(on)] = x[z:] | kind(1 << (self.bits - 1 - level))
            x = y
        return x

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        byte, bit = divmod(i, 8)
        run = byte // self.STEP
        if not bit and byte == run * self.STEP:
            return int(self.ranks[level][run])
        plane = self.plane(level)
        ones = int(self.ranks[level][run]) + int(np.bitwise_count(plane[run * self.STEP : byte]).sum())
        return ones + (int(plane[byte]) >> (8 - bit)).bit_count() if bit else ones

    def access(self, i: int) -> int:
        token = 0
        for level in range(self.bits):
            on = (int(self.plane(level)[i // 8]) >> (7 - i % 8)) & 1
            ones = self._ones(level, i)
            token, i = token << 1 | on, self.zeros[level] + ones if on else i - ones
        return token

    def _run(self, token: int, i: int) -> tuple[int, int]:
        """Where those of the first ``i`` ids that equal ``token`` stand after all
        partitions; ends with the first plane that leaves none."""
        lo, hi = 0, i
        if token >> self.bits:
            return 0, 0
        for level in range(self.bits):
            if lo == hi:
                break
            a, b = self._ones(level, lo), self._ones(level, hi)
            if token >> (self.bits - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """How often ``token`` stands among the first ``i`` ids."""
        lo, hi = self._run(token, i)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def places(self, token: int) -> np.ndarray:
        """Where ``token`` stands, ascending: its run, taken back up the planes."""
        lo, hi = self._run(token, self.n)
        at = np.arange(lo, hi)
        for level in range(self.bits - 1, -1, -1) if len(at) else ():
            on = self._bits_of(level)
            at = np.flatnonzero(on)[at - self.zeros[level]] if token >> (self.bits - 1 - level) & 1 else np.flatnonzero(~on)[at]
        return at

    def select(self, token: int, k: int) -> int:
        """Place of the ``k``-th (from 0) occurrence of ``token``, or -1."""
        lo, hi = self._run(token, self.n)
        if not 0 <= k < hi - lo:
            return -1
        at = lo + k
        for level in range(self.bits - 1, -1, -1):
            on = bool(token >> (self.bits - 1 - level) & 1)
            at = self._bit_place(level, on, at - self.zeros[level] if on else at)
        return at

    def _bit_place(self, level: int, want: bool, k: int) -> int:
        """Where the ``k``-th (from 0) bit equal to ``want`` stands: its run by the
        rank directory, then its place in the run."""
        ones = self.ranks[level].astype(np.int64)
        before = ones if want else np.minimum(np.arange(len(ones)) * self.STEP * 8, self.n) - ones
        run = int(np.searchsorted(before, k, side="right")) - 1
        part = np.unpackbits(self.plane(level)[run * self.STEP : (run + 1) * self.STEP]).view(bool)
        return run * self.STEP * 8 + int(np.flatnonzero(part == want)[k - int(before[run])])


def write_token_shards(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, block_tokens: int = 1 << 19, bits: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append ``end_id`` and write the ids in ascending
    ``id_col`` order to ``path``.

    Shards are ranges of ``id_col`` bounded by a quantile sketch; a task holds
    one block at a time, and a document's ids whatever its length.  There are as
    many bit-planes as the vocabulary and ``end_id`` need; an id beyond a given
    number of ``bits`` raises.  Null and empty texts are the end id alone; repeated
    ids, and rows without one, stay side by side, ordered by the hash of their
    text and divided among shards if they fill more than one; an empty table
    writes no blocks.
    """
    docs = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")
    docs = docs.withColumn("tie", F.xxhash64("text"))
    ranges = Ranges.of(docs, "doc_id")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, pack = encoder(vocabulary), np.array([end_id], "<u4").tobytes(), zstandard.ZstdCompressor(level=1)
        n_planes = bits or max(len(enc.opens) - 1, end_id, 1).bit_length()
        ids: list[int] = []
        parts: list[bytes] = []
        size = number = shard = 0

        def out() -> pa.RecordBatch:
            matrix = WaveletMatrix.build(np.frombuffer(b"".join(parts), "<u4"), n_planes)
            row = (shard, number, matrix.n, n_planes, list(ids), np.array([len(p) // 4 for p in parts], "<u4").tobytes(), np.array(matrix.zeros, "<u4").tobytes(), [r.tobytes() for r in matrix.ranks], [pack.compress(matrix.plane(level).data) for level in range(n_planes)])
            ids.clear(), parts.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _ARROW)], schema=_ARROW)

        for batch in batches:
            for at, doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), enc.encode(texts_of(batch, "text"))):
                if parts and (at != shard or size >= block_tokens):
                    yield out()
                    number, size = (number + 1 if at == shard else 0), 0
                shard = at
                ids.append(doc), parts.append(raw + end)
                size += len(raw) // 4 + 1
        if parts:
            yield out()

    placed = docs.select(ranges.number("doc_id", "tie").alias("shard"), "doc_id", "text", "tie").repartitionById(ranges.n, F.col("shard")).sortWithinPartitions("shard", "doc_id", "tie", "text").drop("tie")
    map_batches(placed, blocks, BLOCKS).write.option("compression", "none").parquet(path)


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``first``, the ids before each block in the whole corpus.

    What the driver sees is one total for each shard file.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("blocks")).orderBy("shard").collect()
    base, bases = 0, []
    for row in totals:
        bases.append((row.shard, base))
        base += row.n
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("shard", "block", "n_tokens").withColumn("inner", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    starts = starts.join(spark.createDataFrame(bases, "shard long, base long"), "shard").select("shard", "block", (F.col("base") + F.col("inner")).alias("first"))
    return blocks.join(small(starts, sum(r.blocks for r in totals)), ["shard", "block"])


def _matrices(batches: Iterator[pa.RecordBatch], *others: str) -> Iterator[tuple]:
    """The matrix of each block and the named columns of its row."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i].as_py() for name in (*others, "n_tokens", "bits", "zeros", "ranks", "planes")}
            yield WaveletMatrix.of_row(*(row[k] for k in ("n_tokens", "bits", "zeros", "ranks", "planes"))), *(row[name] for name in others)


def document_digests(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from blocks."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for matrix, first, doc_ids, lengths in _matrices(batches, "first", "doc_ids", "doc_lengths"):
            raw = matrix.decode().astype("<u4").tobytes()
            sizes = np.frombuffer(lengths, "<u4").astype(np.int64)
            ends = np.cumsum(sizes)
            crcs = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(first + ends - sizes), pa.array(sizes), pa.array(crcs, pa.int64())], schema=schema)

    return map_batches(blocks, digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def count_tokens(blocks: DataFrame, tokens: list[int]) -> DataFrame:
    """token, n: how often each of ``tokens`` stands in all blocks, by two ranks
    a plane.  Tokens that never stand there, or are repeated in the list, have a
    row each like others; without blocks there are no rows."""
    wanted = sorted(set(tokens))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = dict.fromkeys(wanted, 0)
        for (matrix,) in _matrices(batches):
            for token in wanted:
                total[token] += matrix.count(token)
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int64()), pa.array(total.values(), pa.int64())], names=["token", "n"])

    return map_batches(blocks, counts, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def locate_token(blocks: DataFrame, token: int) -> DataFrame:
    """position, doc_id, offset of each occurrence of ``token``: its place among
    all ids and in its document.  Blocks without it have one plane or a few read."""
    schema = pa.schema([("position", pa.int64()), ("doc_id", pa.int64()), ("offset", pa.int64())])

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for matrix, first, doc_ids, lengths in _matrices(batches, "first", "doc_ids", "doc_lengths"):
            at = matrix.places(token)
            ends = np.cumsum(np.frombuffer(lengths, "<u4").astype(np.int64))
            doc = np.searchsorted(ends, at, side="right")
            starts = np.concatenate([[0], ends[:-1]])
            yield pa.RecordBatch.from_arrays([pa.array(first + at), pa.array([doc_ids[k] for k in doc.tolist()], pa.int64()), pa.array(at - starts[doc] if len(at) else at)], schema=schema)

    return map_batches(blocks, occurrences, "position long, doc_id long, offset long")


def tokens_at(blocks: DataFrame, positions: DataFrame, cell: int = 1 << 19) -> DataFrame:
    """position, token for each distinct ``position`` of ``positions`` that some
    block holds; null ones and those beyond the ends give no row.

    A block is met through cells of ``cell`` positions that both sides fall in,
    by its directory alone; its planes are read once, for all its positions.
    """
    places = positions.select(F.col("position").cast("long").alias("position")).where("position is not null").distinct().withColumn("cell", F.expr(f"position div {cell}"))
    spans = blocks.select("shard", "block", "first", "n_tokens", F.explode(F.expr(f"sequence(first div {cell}, (first + n_tokens - 1) div {cell})")).alias("cell"))
    met = places.join(spans, "cell").where("position >= first and position < first + n_tokens")
    wanted = met.groupBy("shard", "block").agg(F.collect_list("position").alias("positions"))

    def access(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for matrix, first, at in _matrices(batches, "first", "positions"):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([matrix.access(p - first) for p in at], pa.int64())], names=["position", "token"])

    return map_batches(blocks.join(wanted, ["shard", "block"]), access, "position long, token long")
