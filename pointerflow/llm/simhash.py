"""Near-duplicates by SimHash, found with pivot distance tables (op10).

``near_duplicates`` links fingerprints with at most three differing bits.  Texts
that share four fifths of their shingles differ in about ten bits, which no keys
made of fingerprint bits find in a large corpus; ``similar_documents`` therefore
takes its keys from least shingle hashes, discards by the same pivot tables with
a wider radius and by the share of equal least hashes, and counts what is left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_batches, saved, texts_of
from .components import components

RADIUS = 3
#: Bit ranges [from, to) of five blocks; fingerprints within RADIUS differ in at
#: most three of them, so they agree in some pair of blocks.
BLOCKS = ((0, 13), (13, 26), (26, 39), (39, 52), (52, 64))
#: Reference fingerprints of the distance table: multiples of the golden ratio.
PIVOTS = np.arange(1, 17, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
#: Fingerprints that may share a key before it is divided further.
HOT = 2048
#: Texts of one key or class that a task compares at a time; those of larger ones
#: meet in blocks, so the number sets how work is dealt and not what is found.
PART = 512

#: Least hashes in a sketch, one byte kept of each (standard error 0.025 at 0.8).
MINIMA = 256
#: Least hashes a key is made of, and keys a text has.  At a similarity of 0.8
#: two texts share a key with probability 0.998, at 0.3 with 0.04.
BAND, KEYS = 5, 16
#: Bits in which texts with a similarity of 0.8 may differ (mean 10, error 3).
WIDE = 24
#: How far below the similarity sought a sketch may lie: four standard errors.
SLACK = 0.1


def shingle_hashes(text: str, words: int = 3) -> np.ndarray:
    """XXH64 of each shingle of ``words`` words, A-Z lower-cased, repeats
    included; fewer words make one shingle, no words none."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = list(accumulate((len(t) + 1 for t in tokens), initial=0))
    n = max(1, len(tokens) - words + 1)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a : b - 1], 42) for a, b in zip(ends, ends[min(words, len(tokens)) :])), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half the hashes have; zero for no hashes."""
    ones = np.unpackbits(hashes.view(np.uint8)).reshape(len(hashes), 64).sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes)).view(np.uint64)[0])


def simhash(text: str, words: int = 3) -> int:
    """64-bit SimHash over shingles of ``words`` words, A-Z lower-cased.

    Shingles count as often as they occur; fewer words make one shingle, no
    words the fingerprint zero.
    """
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (its 64 bits as a long) of every text."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(t, words) for t in texts_of(batch, "text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], schema=schema)

    return map_batches(docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text"), rows, "doc_id long, fp long")


def _bits(a: int, b: int) -> Column:
    return F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1))


def _keys() -> Column:
    """Ten keys: two blocks of the fingerprint and which two they are."""
    keys = [F.struct(F.lit(k).alias("pair"), (F.shiftleft(_bits(*x), 13) + _bits(*y)).alias("at")) for k, (x, y) in enumerate(combinations(BLOCKS, 2))]
    return F.explode(F.array(*keys))


def _parts() -> Column:
    """Four parts of the three blocks that a key leaves out, by pair.

    Fingerprints with equal keys and RADIUS other bits agree in one of them.
    """
    by_pair = []
    for pair in combinations(range(5), 2):
        rest = [i for k, (a, b) in enumerate(BLOCKS) if k not in pair for i in range(a, b)]
        cuts = [len(rest) * i // 4 for i in range(5)]
        parts = []
        for c, d in zip(cuts, cuts[1:]):
            mask = sum(1 << i for i in rest[c:d])
            parts.append(F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))
        by_pair.append(F.array(*parts))
    return F.posexplode(F.element_at(F.array(*by_pair), F.col("pair") + 1))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within runs of equal keys, as a spanning forest of each run."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held: pa.Table | None = None

    def out(table: pa.Table) -> pa.RecordBatch:
        pair, at, part, value, fp, rep = (table.column(i).to_numpy() for i in range(6))
        new = np.ones(len(fp), bool)
        new[1:] = (pair[1:] != pair[:-1]) | (at[1:] != at[:-1]) | (part[1:] != part[:-1]) | (value[1:] != value[:-1])
        a, b = links(np.cumsum(new), fp.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(rep[a], rep[b])), pa.array(np.maximum(rep[a], rep[b]))], schema=schema)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        keys = [table.column(i).to_numpy() for i in range(4)]
        same = np.logical_and.reduce([k == k[-1] for k in keys]) if table.num_rows else np.zeros(0, bool)
        cut = table.num_rows - int(same.sum())  # the last key may go on in the next batch
        if cut:
            yield out(table.slice(0, cut).combine_chunks())
        held = table.slice(cut)
    if held is not None and held.num_rows:
        yield out(held.combine_chunks())


def links(group: np.ndarray, fp: np.ndarray, radius: int = RADIUS, alike: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of linked fingerprints, a spanning forest for each group.

    Rows of a group are ordered by their distance to the first pivot.  Pairs at
    1, 2, ... places are tried together while that distance differs by
    ``radius`` at most; the greatest difference over all pivots discards.  What
    is left is verified by counting differing bits or, if given, by ``alike``.
    Rows of a group with equal ``known`` count as linked already.
    """
    table = np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    order = np.lexsort((table[:, 0], group))
    group, fp, table = group[order], fp[order], table[order]
    root = np.arange(len(fp))
    if known is not None and len(fp):
        _, first, inverse = np.unique(np.stack([group, known[order]]), axis=1, return_index=True, return_inverse=True)
        root = first[inverse.reshape(-1)]
    found_a, found_b = [], []
    left, step = np.arange(len(fp)), 0
    while len(left):
        step += 1
        left = left[left + step < len(fp)]
        right = left + step
        near = (group[left] == group[right]) & (table[right, 0] - table[left, 0] <= radius)
        left, right = left[near], right[near]
        open_ = root[left] != root[right]
        a, b = left[open_], right[open_]
        kept = np.abs(table[a] - table[b]).max(axis=1, initial=0) <= radius
        a, b = a[kept], b[kept]
        linked = alike(order[a], order[b]) if alike else np.bitwise_count(fp[a] ^ fp[b]) <= radius
        a, b = a[linked], b[linked]
        for x, y in zip(a.tolist(), b.tolist()):
            r, s = _top(root, x), _top(root, y)
            if r != s:
                root[max(r, s)] = min(r, s)
                found_a.append(x), found_b.append(y)
        if len(a):
            while not np.array_equal(up := root[root], root):
                root = up
    return order[np.array(found_a, np.int64)], order[np.array(found_b, np.int64)]


def _top(root: np.ndarray, x: int) -> int:
    while root[x] != x:
        x = int(root[x])
    return x


def near_duplicates(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every row.

    Fingerprints with at most RADIUS differing bits are linked, each to itself;
    a component is named by its least id.  Each distinct fingerprint is
    compared once, so copies cost nothing; hot keys are divided, not capped.
    Null and empty texts have the fingerprint zero and link like any other.
    Rows with a null id link and bridge like any other, but name a component
    only if nothing else does (then null).  An empty table gives no rows.  Of a
    very long text all words and the hashes of its shingles are in memory at once.
    """
    fps = saved(fingerprints(docs, words, id_col, text_col), "simhash")
    reps = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct").withColumn("rep", F.col("fp"))
    keyed = reps.select(_keys().alias("key"), "fp", "rep").select("key.pair", "key.at", "fp", "rep")
    hot = keyed.groupBy("pair", "at").count().where(F.col("count") > HOT).select("pair", "at")
    hot = saved(hot, "simhash-hot")
    cold = keyed.join(hot, ["pair", "at"], "left_anti").select("pair", "at", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("value"), "fp", "rep")
    split = keyed.join(hot, ["pair", "at"], "left_semi").select("pair", "at", _parts().alias("part", "value"), "fp", "rep")
    both = cold.unionByName(split).repartition("pair", "at", "part", "value").sortWithinPartitions("pair", "at", "part", "value", "fp")
    roots = components(both.mapInArrow(_forest, "a long, b long").distinct())
    named = saved(reps.join(roots, reps.rep == roots.node, "left").select("fp", F.coalesce("root", "rep").alias("root"), "least"), "simhash-named")
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _multipliers() -> np.ndarray:
    """Odd multiples of the golden ratio, mixed: one permutation each."""
    x = np.arange(1, MINIMA + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) | np.uint64(1)


def sketch(hashes: np.ndarray, multipliers: np.ndarray) -> tuple[bytes, list[int]]:
    """A byte of each least permuted hash, and the keys made of the first ones."""
    least = np.full(MINIMA, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 512):
        np.minimum(least, (multipliers[:, None] * hashes[None, at : at + 512]).min(axis=1), out=least)
    bands = least[: BAND * KEYS].reshape(KEYS, BAND)
    keys = [xxhash.xxh64_intdigest(band.tobytes(), k) - (1 << 63) for k, band in enumerate(bands)]
    return (least >> np.uint64(8)).astype(np.uint8).tobytes(), keys


def _row(docs: DataFrame) -> Column:
    """A hash of all columns and of which are null, by which a row is known, as
    ids may be null or repeated.  Equal rows share it."""
    columns = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]
    return F.xxhash64(*columns, *(c.isNull() for c in columns))


def sketches(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (see ``_row``), fingerprint, sketch and keys of every text."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("fp", pa.int64()), ("sketch", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers = _multipliers()
        for batch in batches:
            fps, marks, keys = [], [], []
            for text in texts_of(batch, "text"):
                hashes = shingle_hashes(text, words)
                mark, at = sketch(hashes, multipliers)
                fps.append(majority(hashes)), marks.append(mark), keys.append(at)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(marks, pa.binary()), pa.array(keys, schema.field("keys").type)], schema=schema)

    return map_batches(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), _row(docs).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text")), rows, "doc_id long, row long, fp long, sketch binary, keys array<long>")


def _similar(rows: DataFrame, similarity: float, words: int | None = None) -> DataFrame:
    """Links a, b among rows (key, salt, known, fp, sketch, rep) of equal key and
    salt; rows of equal ``known`` are linked already.

    Sketches decide, SLACK below ``similarity``; with ``words``, rows have a
    text as well, and what the sketches leave is counted exactly.  A task reads
    its rows in order and holds those of one key and salt, about PART.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    share = similarity - SLACK
    need = MINIMA * (share + (1 - share) / 256)  # bytes of different hashes agree once in 256

    def verifier(table: pa.Table) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        marks = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, MINIMA)
        sets: dict[int, np.ndarray] = {}

        def shingles(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = np.unique(shingle_hashes(table.column("text")[i].as_py() or "", words))
            return sets[i]

        def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            near = (marks[x] == marks[y]).sum(axis=1) >= need
            for k in np.flatnonzero(near) if words else ():
                near[k] = jaccard(shingles(int(x[k])), shingles(int(y[k]))) >= similarity
            return near

        return alike

    def linked(table: pa.Table) -> pa.RecordBatch:
        key, salt, known, fp, rep = (table.column(c).to_numpy() for c in ("key", "salt", "known", "fp", "rep"))
        new = np.ones(len(fp), bool)
        new[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])
        a, b = links(np.cumsum(new), fp.view(np.uint64), WIDE, verifier(table), known)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(rep[a], rep[b])), pa.array(np.maximum(rep[a], rep[b]))], schema=schema)

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of one key and salt so far
        for batch in batches:
            key, salt = batch.column("key").to_numpy(), batch.column("salt").to_numpy()
            if not len(key):
                continue
            last = len(key) - int(((key == key[-1]) & (salt == salt[-1])).sum())  # the last key may go on in the next batch
            if held and (held[-1].column("key")[0].as_py(), held[-1].column("salt")[0].as_py()) != (key[-1], salt[-1]) and not last:
                yield linked(pa.Table.from_batches(held).combine_chunks())
                held = []
            if last:
                yield linked(pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks())
                held = []
            held.append(batch.slice(last))
        if held:
            yield linked(pa.Table.from_batches(held).combine_chunks())

    ordered = rows.select("key", "salt", "known", "fp", "rep", "sketch", *(["text"] if words else [])).repartition("key", "salt").sortWithinPartitions("key", "salt", "fp", "rep")
    return map_batches(ordered, forest, "a long, b long").distinct()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets, each a sorted array; two empty sets are alike."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - common
    return common / union if union else 1.0


def _divided(members: DataFrame) -> DataFrame:
    """``members`` (rep, key, n) with a salt that gives parts of about PART rows,
    each key's in another way."""
    parts = F.ceil(F.col("n") / PART)
    return members.withColumn("salt", F.pmod(F.xxhash64("rep", "key"), parts)).withColumn("known", F.col("rep"))


def _crossed(hot: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (rep, key, salt, known) that bring together whatever parts of the
    hot keys kept apart: each two texts of a key that ``found`` does not link
    yet share a salt, whose rows are about PART.

    A component of more than half of PART texts of a key has blocks of its own, the
    others share blocks; a salt is a pair of blocks.  Pairs of blocks of one
    component are left out, so a key that is one component costs nothing.
    """
    half = max(1, PART // 2)
    roots = components(found)
    placed = hot.select("rep", "key").join(roots, F.col("rep") == F.col("node"), "left").select("rep", "key", F.coalesce("root", "rep").alias("known"))
    sizes = placed.groupBy("key", "known").agg(F.count("*").alias("m"))
    open_ = sizes.groupBy("key").agg(F.count("*").alias("parts"), F.sum(F.when(F.col("m") <= half, F.col("m")).otherwise(0)).alias("rest")).where("parts > 1").drop("parts")
    own = F.col("m") > half
    block = F.pmod(F.xxhash64("rep", "key"), F.ceil(F.when(own, F.col("m")).otherwise(F.col("rest")) / half))
    placed = placed.join(sizes, ["key", "known"]).join(open_, "key").select("rep", "key", "known", own.alias("own"), F.when(own, F.col("known")).otherwise(0).alias("whole"), block.alias("block"))
    placed = saved(placed, "sketch-blocks")
    blocks = placed.select("key", F.struct("own", "whole", "block").alias("x")).distinct()
    pairs = blocks.join(blocks.withColumnRenamed("x", "y"), "key").where("x <= y and not (x.own and y.own and x.whole = y.whole)")
    pairs = pairs.select("key", F.xxhash64("x.own", "x.whole", "x.block", "y.own", "y.whole", "y.block").alias("salt"), F.explode(F.array_distinct(F.array("x", "y"))).alias("x"))
    return placed.join(pairs.select("key", "salt", "x.*"), ["key", "own", "whole", "block"]).select("rep", "key", "salt", "known")


def _completed(found: DataFrame, hot: DataFrame, bodies: DataFrame, similarity: float, words: int | None = None) -> DataFrame:
    """``found`` and the links between parts of the hot keys, all members kept."""
    if hot.isEmpty():
        return found
    return found.unionByName(_similar(_crossed(hot, found).join(bodies, "rep"), similarity, words))


def _linked(docs: DataFrame, words: int, similarity: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Every text's sketch, and of each distinct one (fp, sketch) the component
    and its ``first`` row: (no id, doc_id, row), which rows with an id lead."""
    every = saved(sketches(docs, words, id_col, text_col), "sketches")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    reps = saved(every.groupBy("fp", "sketch").agg(F.min("row").alias("rep"), F.min(first).alias("first"), F.min("keys").alias("keys")), "sketches-distinct")
    keyed = reps.select("rep", F.explode("keys").alias("key"))
    shared = saved(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sketch-keys")
    members = saved(keyed.join(shared, "key"), "sketch-members")
    bodies = reps.select("rep", "fp", "sketch")
    found = saved(_similar(_divided(members).join(bodies, "rep"), similarity), "sketch-links")
    found = _completed(found, members.where(F.col("n") > PART), bodies, similarity)
    classes = saved(components(found).select(F.col("node").alias("rep"), F.col("root").alias("key")), "sketch-classes")

    sizes = classes.groupBy("key").agg(F.count("*").alias("n"))
    sized = saved(classes.join(sizes, "key").join(bodies, "rep"), "sketch-candidates")
    hot = sized.where(F.col("n") > PART)
    texts = docs.select(_row(docs).alias("rep"), F.col(f"`{text_col}`").cast("string").alias("text")).join(classes.select("rep"), "rep", "left_semi")
    texts = saved(texts.dropDuplicates(["rep"]), "sketch-texts")  # equal rows
    exact = saved(_similar(_divided(sized).join(texts, "rep"), similarity, words), "similar-links")
    roots = components(_completed(exact, hot, bodies.join(texts, "rep"), similarity, words))
    return every, saved(reps.join(roots, reps.rep == roots.node, "left").select("fp", "sketch", F.coalesce("root", "rep").alias("component"), "first"), "similar-linked")


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and component_id of every row; texts are linked if their sets of
    ``words``-word shingles have a Jaccard similarity of ``similarity``.

    Texts that share a key and whose sketches are alike within SLACK form
    candidate classes; within a class similarities are counted exactly, from
    whole texts.  Copies take part once: equal fingerprints and sketches are
    taken as copies.  Keys and classes of more than PART texts are divided by
    salts first; then every block of texts meets every other block of its key
    or class, unless they are linked as a whole, so that no task gets a hot
    one's rows at once and no pair is left out.  Texts without words are alike.  Rows with a null
    id take part, but name a component only if nothing else does (then null).  An empty table gives no rows.
    """
    every, linked = _linked(docs, words, similarity, id_col, text_col)
    named = linked.join(linked.groupBy("component").agg(F.min("first").alias("leader")), "component").select("fp", "sketch", F.col("leader.doc_id").alias("component_id"))
    return every.join(named, ["fp", "sketch"]).select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of ``docs`` for each component of ``similar_documents``: of the
    least id, then the least hash of the row; of rows without an id if there
    are no others.  Rows are told apart by all their columns, so different texts
    without an id, or with one id, stay."""
    _, linked = _linked(docs, words, similarity, "doc_id", "text")
    row = fresh(docs, "near_row")
    kept = linked.groupBy("component").agg(F.min("first").alias("leader")).select(F.col("leader.row").alias(row))
    rows = docs.withColumn(row, _row(docs))
    return rows.join(kept, row, "left_semi").dropDuplicates([row]).select(*(f"`{c}`" for c in docs.columns))
