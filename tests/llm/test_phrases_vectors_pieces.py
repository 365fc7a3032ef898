"""Collocations, centroids and SentencePiece ids against brute force and the library."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointerflow.llm import centroids, collocations, pieces, queries

HARD = [
    (1, None, "en"), (2, "", None), (3, "One two three.", "en"), (3, "One two three.", "en"), (4, "word " * 30_000, "de"), (5, " \n\t x  y\r\n", "fr"), (6, "<s> ß ▁中文▁ 😀 naïve\n\nend\x00 </s>  ", "en"),
    (None, "no id here. One two", None), (7, "x" * 5000 + "yz" * 3000, "en"), (8, "A\tB,c A b", "und"),
]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame([(*row, "x", 1.5) for row in HARD], "doc_id long, text string, lang string, phrase string, n double")


# -- collocations


def brute_collocations(rows, threshold, most):
    counts, totals = Counter(), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for n in range(1, 6):
                counts.update((lang or "und", *words[i : i + n]) for i in range(len(words) - n + 1))
    frequent = {k: a for k, a in counts.items() if a >= threshold}
    out = []
    for (lang, *words), a in frequent.items():
        if len(words) < 2:
            continue
        inside = lambda longer: any(longer[i : i + len(words)] == words for i in range(len(longer) - len(words) + 1))
        if any(len(k) - 1 > len(words) and k[0] == lang and f >= a and inside(list(k[1:])) for k, f in frequent.items()):
            continue
        n = totals[lang]
        score, k = min((1000 * a * n // (counts[lang, *words[:k]] * counts[lang, *words[k:]]), k) for k in range(1, len(words)))
        out.append((lang, -score, -a, " ".join(words).encode(), counts[lang, *words[:k]], counts[lang, *words[k:]], n))
    ranks, found = Counter(), []
    for lang, score, a, phrase, left, right, n in sorted(out):
        ranks[lang] += 1
        if ranks[lang] <= most:
            found.append((lang, ranks[lang], phrase.decode(), -a, left, right, n, -score))
    return found


def got_collocations(df, threshold, most):
    return sorted(map(tuple, collocations.mine_collocations(df, threshold, most).collect()))


def test_collocations_of_small_texts(spark, monkeypatch):
    """With summaries of few keys, so that counters are taken off and merged."""
    rnd = random.Random(5)
    vocabulary = ["The", "the", "of", "é", "cat", "sat", "on", "mat", "a-b", "x"]
    rows = []
    for i in range(120):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 40))]
        text = "".join(w + rnd.choice([" ", " ", " ", "\t", ", ", ".\n", "  "]) for w in words)
        rows.append((i, text + " new york stock exchange closed" * (i % 3), rnd.choice(["en", "de", None])))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    monkeypatch.setattr(collocations, "HELD_KEYS", 300)
    monkeypatch.setattr(collocations, "HELD_PHRASES", 20)
    for threshold, most in ((3, 50), (6, 7), (1, 100_000)):
        assert got_collocations(df, threshold, most) == brute_collocations([r[1:] for r in rows], threshold, most)


def test_collocations_of_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    assert got_collocations(df, 20, 100) == brute_collocations([tuple(r) for r in df.select("text", "lang").collect()], 20, 100)


def test_collocations_of_hard_rows(hard):
    assert got_collocations(hard, 2, 50) == brute_collocations([r[1:] for r in HARD], 2, 50)
    assert got_collocations(hard.where("false"), 2, 50) == []
    assert got_collocations(hard.where("length(text) = 0 or text is null"), 2, 50) == []
    with pytest.raises(ValueError, match="threshold"):
        collocations.mine_collocations(hard, 0)


def test_summaries_keep_what_is_frequent():
    rnd = np.random.default_rng(2)
    for trial in range(30):
        values = rnd.zipf(1.2 + trial / 30, 20_000).astype(np.uint32) % 5000
        threshold = 50
        summary = collocations.Summary(len(values) // threshold + 1)
        for part in np.array_split(values, 9):
            keys, counts = np.unique(part, return_counts=True)
            summary.add(keys, counts)
            summary.merge()
        keys, counts = np.unique(values, return_counts=True)
        assert summary.off < threshold and len(summary.keys) <= summary.capacity
        assert set(keys[counts >= threshold]) <= set(summary.survivors(threshold).tolist())


def test_products_beyond_a_long(spark):
    """a * n and l * r pass 64 bits; the score is exact."""
    rows = [("en", 0, "", 9 * 10**15), ("en", 1, "a", 3 * 10**12 + 1), ("en", 1, "b", 7 * 10**11), ("en", 2, "a b", 6 * 10**11 + 7)]
    counts = spark.createDataFrame(rows, "lang string, size int, phrase string, n long")
    (row,) = collocations._scored(counts).collect()
    assert row.score == 1000 * (6 * 10**11 + 7) * 9 * 10**15 // ((3 * 10**12 + 1) * 7 * 10**11)


# -- centroids


def brute_clusters(rows, k, rounds, size):
    kept = [(i, [int(np.floor(256.0 * x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    named = sorted(((hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "~", v) for i, v in kept))[:k]
    centres = [list(v) for _, v in named]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, vs in groups.items():
            centres[j] = [sum(c) // len(vs) for c in zip(*vs)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, j, d in found:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for i, j, d in found), key=str)


@pytest.mark.parametrize(("n", "k"), [(1, 4), (3, 4), (200, 7), (400, 40)])
def test_clusters(spark, n, k):
    rnd = random.Random(n)
    rows = [(rnd.randint(0, n), [rnd.randint(-2, 2) / 64 for _ in range(4)]) for _ in range(n)]  # ties and repeated ids
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(map(tuple, centroids.cluster_vectors(df, k, 5, size=4).collect()), key=str)
    assert got == brute_clusters(rows, k, 5, 4)


def test_clusters_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, 0.2]), (2, [0.1, None]), (3, [nan, 1.0]), (4, [1.0, inf]), (5, [1.0]), (6, None), (7, []), (None, [3.0, -0.001]), (None, [3.0, -0.001]), (1, [0.1, 0.2]), (9, [-1.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("x")).withColumn("c", F.lit(1))
    got = sorted(map(tuple, centroids.cluster_vectors(df, 2, 3, size=2).collect()), key=str)
    assert got == brute_clusters(rows, 2, 3, 2) and len(got) == 5
    assert centroids.cluster_vectors(df.where("false"), 2, 3, size=2).collect() == []
    big = spark.createDataFrame([(1, [1e300, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        centroids.cluster_vectors(big, 2, 1, size=2).collect()


def test_orchard_meets_ties_and_stops():
    rnd = np.random.default_rng(1)
    for _ in range(40):
        k, d = int(rnd.integers(1, 45)), int(rnd.integers(1, 6))
        centres, vectors = rnd.integers(-4, 5, (k, d)), rnd.integers(-6, 7, (300, d))
        apart = ((vectors[:, None] - centres[None]) ** 2).sum(2)
        cluster, distance = centroids.Orchard(centres).nearest(vectors)
        assert (cluster == apart.argmin(1)).all() and (distance == apart.min(1)).all()


# -- pieces


@pytest.fixture(scope="module")
def encoder():
    return pieces.PieceEncoder(pieces.default_model(), max_units=500)


def ids(raw):
    return np.frombuffer(raw, "<i4").tolist()


def test_ids_equal_the_library(encoder):
    rnd = random.Random(4)
    alphabet = "abcdetion  ▁é中😀\x00.,0123\n\t<>s"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 120))) for _ in range(3000)]
    texts += ["".join(rnd.choice("etaoinshr") for _ in range(n)) for n in (39, 40, 41, 4000)] + [" " * n for n in range(45)] + ["a" + " " * n + "b" for n in range(45)]
    for start in range(0, len(texts), 700):
        part = texts[start : start + 700]
        assert list(map(ids, encoder.encode(part))) == encoder.library.encode(part)


def test_heap_and_rows_agree(encoder):
    rnd = random.Random(6)
    units = ["▁" + "".join(rnd.choice("etaoinshrdlu▁ß中") for _ in range(rnd.randint(0, 38))) for _ in range(2000)]
    assert encoder.merged(units) == [encoder._alone(u) for u in units]


def test_a_difference_raises():
    encoder = pieces.PieceEncoder(pieces.default_model())
    encoder.table.layers[0][2][:] = pieces._NONE
    with pytest.raises(ValueError, match="differ from the library"):
        encoder.encode(["the quick brown fox"])


@pytest.fixture
def changed(tmp_path):
    """The public model with other settings; nothing is trained."""
    from sentencepiece import sentencepiece_model_pb2 as format

    def write(change):
        with open(pieces.default_model(), "rb") as f:
            model = format.ModelProto.FromString(f.read())
        change(model)
        path = tmp_path / "changed.model"
        path.write_bytes(model.SerializeToString())
        return str(path)

    return write


def no_bytes(m):
    m.trainer_spec.byte_fallback = False
    del m.pieces[3:259]


def no_prefix(m):
    m.normalizer_spec.add_dummy_prefix = False


def squeezed(m):
    m.normalizer_spec.remove_extra_whitespaces = True


def user_defined(m):
    m.pieces.add(piece="<tag> x", score=0, type=4)
    m.pieces.add(piece="tion", score=0, type=4)
    m.pieces.add(piece="<ta", score=0, type=4)


@pytest.mark.parametrize("change", [no_bytes, no_prefix, squeezed, user_defined])
def test_other_models(changed, change):
    encoder = pieces.PieceEncoder(changed(change))
    rnd = random.Random(7)
    parts = ["nation", "<tag> x", "the", " ", "  ", "中文", "😀", "a", "▁", "<ta", "\n", "stationary", "é"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(800)]
    assert list(map(ids, encoder.encode(texts))) == encoder.library.encode(texts)


def test_models_of_other_kinds_raise(changed):
    def unigram(m):
        m.trainer_spec.model_type = 1

    with pytest.raises(ValueError, match="merge-type"):
        pieces.PieceEncoder(changed(unigram))


def expected(rows, library):
    for doc_id, text, _ in rows:
        found = library.encode(text or "")
        digits, decoded = ",".join(map(str, found)), library.decode(found)
        yield (doc_id, len(found), hashlib.sha256(digits.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_op13(spark, sf, encoder):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted(map(tuple, queries.op13_sentencepiece(spark, sf).collect()))
    assert got == sorted(expected([tuple(r) for r in docs.select("doc_id", "text", "lang").collect()], encoder.library))


def test_pieces_of_hard_rows(spark, hard, encoder):
    model = pieces.default_model()
    tokens = pieces.encode_pieces(hard.withColumn("ids", F.lit("x")), model)
    got = pieces.decode_pieces(tokens, model).collect()
    want = [(i, encoder.library.encode(t or "")) for i, t, _ in HARD]
    assert sorted(((r.doc_id, r.ids, r.text) for r in got), key=str) == sorted(((i, x, encoder.library.decode(x)) for i, x in want), key=str)
    assert pieces.encode_pieces(hard.where("false"), model).count() == 0
    none = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [(r.doc_id, r.text) for r in pieces.decode_pieces(none, model).orderBy("doc_id").collect()] == [(1, None), (2, "")]
