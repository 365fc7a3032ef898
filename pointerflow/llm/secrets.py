"""Secret scans with corpus-wide ownership frequency (op5)."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_batches, saved, texts_of

#: Base kinds, in the order that settles equal starts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_HINTS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "key", "jwt", "prefixed", "opaque")
#: Further candidates, which only ownership makes secrets.  A signed token or a
#: prefixed key starts where no letter or digit stands before it.
LONG = re.compile(r"[A-Za-z0-9+/_.=-]{20,}")
_GAP = r"(?:\s|\\n)*+"
PRIVATE_KEY = re.compile(rf"-----BEGIN ([A-Z ]*PRIVATE KEY)-----((?:{_GAP}[A-Za-z0-9+/=]{{16,}}+)*+(?:{_GAP}[A-Za-z0-9+/=]++(?={_GAP}-----END))?+)(?:{_GAP}-----END \1-----)?+")
JWT = re.compile(r"(?<![A-Za-z0-9_=-])eyJ[A-Za-z0-9_=-]{8,}\.[A-Za-z0-9_=-]{8,}\.[A-Za-z0-9_+/=-]{8,}")
PREFIXED = re.compile(r"(?<![A-Za-z0-9])(?:ghp|gho|ghs|xoxb|xoxp|sk|pk|rk|glpat)[-_]([A-Za-z0-9_-]{16,})")
#: An opaque string has no ``/`` and no ``.``, and some part without ``-`` and
#: ``_`` in which digits and letters of both cases mix: words joined by marks,
#: as links and paths have them, are none.
OPAQUE = re.compile(r"[A-Za-z0-9+_=-]{24,}")
UNBROKEN = re.compile(r"[A-Za-z0-9+]{16,}")
#: Bits a character that an opaque token needs, and a prefixed key.
ENTROPY, KEY_ENTROPY = 3.5, 3.0

_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("digest", pa.string())])
_SPAN_SQL = "array<struct<kind:int,start:int,end:int,digest:string>>"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base patterns, ordered."""
    spans = []
    lower = text.lower()
    if any(h in lower for h in ASSIGN_HINTS):
        spans += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return spans


def _random(value: str, least: int, entropy: float) -> bool:
    """Letters and digits mixed, with the entropy of a random token."""
    if len(value) < least or not any(c.isdigit() for c in value) or not any(c.isalpha() for c in value):
        return False
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= entropy


def _opaque(value: str) -> bool:
    mixed = lambda part: any(map(str.isdigit, part)) and any(map(str.islower, part)) and any(map(str.isupper, part))
    return _random(value, 24, ENTROPY) and any(mixed(m[0]) for m in UNBROKEN.finditer(value))


def scan(text: str) -> tuple[list, list]:
    """Base spans and candidates for added ones, each ordered by start and kind.

    A candidate is left out if base spans cover it, or a private key does.  The
    value of a private key is its body, so that its header tells nothing.
    """
    base = base_spans(text)
    keys = [(m.start(), 3, m.end(), "".join(m[2].replace("\\n", " ").split())) for m in PRIVATE_KEY.finditer(text) if m[2]] if "PRIVATE KEY" in text else []
    more = []
    for run in LONG.finditer(text):
        a, b = run.span()
        base += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text, a, b)]
        found = [(m.start(), 4, m.end(), m[0]) for m in JWT.finditer(text, a, b)] if text.find("eyJ", a, b) >= 0 else []
        found += [(m.start(), 5, m.end(), m[0]) for m in PREFIXED.finditer(text, a, b) if _random(m[1], 16, KEY_ENTROPY)]
        if not found and run[0][0] != "/" and "//" not in run[0]:  # a link or a path is no secret
            found = [(m.start(), 6, m.end(), m[0]) for m in OPAQUE.finditer(text, a, b) if _opaque(m[0])]
        more += found
    base.sort()
    return base, sorted(keys + _uncovered(more, base + keys)) if more else keys


def _uncovered(spans: list, by: list) -> list:
    """Spans that do not lie within the joined spans of ``by``."""
    starts: list[int] = []
    ends: list[int] = []
    for a, _, b, _ in sorted(by):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a), ends.append(b)
    within = lambda a, b: (i := bisect_right(starts, a)) and b <= ends[i - 1]
    return [s for s in spans if not within(s[0], s[2])]


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """What ``scan`` finds in every whole text, saved; a row is known by its id
    and the hash of its text, as equal texts have equal spans."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("owner", pa.string()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("base", pa.list_(_SPAN)), ("more", pa.list_(_SPAN))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = lambda v: hashlib.sha256(v.encode()).hexdigest()[:32]
        for batch in batches:
            out = []
            for doc, th, owner, text in zip(*(batch.column(i).to_pylist() for i in range(3)), texts_of(batch, "text")):
                base, more = scan(text)
                kinds = Counter(s[1] for s in base)
                said = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in base)
                as_rows = lambda spans: [{"kind": k, "start": a, "end": b, "digest": digest(v)} for a, k, b, v in spans]
                out.append((doc, th, owner, kinds[0], kinds[1], kinds[2], hashlib.sha256(said.encode()).hexdigest(), as_rows(base), as_rows(more)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(owner_col).cast("string").alias("owner"), F.col(text_col).cast("string").alias("text"))
    return saved(map_batches(narrow, rows, f"doc_id long, text_hash long, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, base {_SPAN_SQL}, more {_SPAN_SQL}"), "secrets")


#: Parts that the spans of one value are dealt to where verdicts are joined.
SALTS = 16


def ownership(found: DataFrame) -> DataFrame:
    """digest, n_owners, n_repositories of every candidate in the corpus.

    An owner is a source; a repository is a text, of which copies count once, as
    the table names no other.  Counts are made by digest, owner and text first,
    so a value that fills a third of the rows is one row a task and owner.
    """
    each = found.select("owner", "text_hash", F.explode(F.concat("base", "more")).alias("s")).select("s.digest", "owner", "text_hash").distinct()
    by_owner = each.groupBy("digest", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("digest").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))


def _spans(found: DataFrame, max_owners: int, max_repositories: int) -> DataFrame:
    """doc_id, text_hash, spans (all that count, ordered), n_owned, n_shared."""
    each = found.where("size(base) + size(more) > 0").dropDuplicates(["doc_id", "text_hash"])
    with_base = lambda name, is_base: F.transform(name, lambda s: F.struct(F.lit(is_base).alias("base"), s.alias("s")))
    each = each.select("doc_id", "text_hash", F.explode(F.concat(with_base("base", True), with_base("more", False))).alias("x")).select("doc_id", "text_hash", "x.base", "x.s.*")
    each = each.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS)).cast("int"))
    verdicts = ownership(found).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    judged = each.join(verdicts, ["digest", "salt"]).withColumn("owned", (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories))
    kept = F.when(F.col("base") | F.col("owned"), F.struct("start", "kind", "end"))
    return judged.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(kept)).alias("spans"), F.count_if("owned").alias("n_owned"), F.count_if(~F.col("owned")).alias("n_shared"))


def _with_spans(rows: DataFrame, doc_id: Column, text_hash: Column, spans: DataFrame, *wanted: str) -> DataFrame:
    """Every row, as ``row``, with the wanted columns of its spans, null if it has none."""
    spans = spans.select(F.col("doc_id").alias("spans_doc"), F.col("text_hash").alias("spans_text"), *wanted)
    return rows.join(spans, doc_id.eqNullSafe(F.col("spans_doc")) & (text_hash == F.col("spans_text")), "left").select("row", *wanted)


def find_secrets(docs: DataFrame, max_owners: int = 2, max_repositories: int = 20, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """Secrets of every whole text, one row out for each row in.

    Base patterns always count.  Further token-like candidates (private keys,
    signed tokens, prefixed keys, opaque strings) count if at most
    ``max_owners`` owners and ``max_repositories`` different texts hold them;
    what many copy is an example.  ``n_owned`` and ``n_shared`` separate all
    candidates in that way.  Null and empty texts have no spans; a null owner is
    an owner like any other; repeated rows are scanned each.  A very long text
    is scanned whole, in time that follows its length.
    """
    found = scanned(docs, id_col, text_col, owner_col)
    spans = _spans(found, max_owners, max_repositories)
    kinds = F.array(*map(F.lit, KINDS))
    said = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", F.element_at(kinds, s.kind + 1), s.start, s.end)), ",")
    rows = found.select(F.struct("doc_id", "text_hash", "n_assign", "n_access", "n_hex", "base_sha256").alias("row"))
    marked = _with_spans(rows, F.col("row.doc_id"), F.col("row.text_hash"), spans, "spans", "n_owned", "n_shared")
    return marked.select("row.doc_id", "row.n_assign", "row.n_access", "row.n_hex", "row.base_sha256", F.coalesce(said, F.lit("")).alias("spans"), F.coalesce("n_owned", F.lit(0)).alias("n_owned"), F.coalesce("n_shared", F.lit(0)).alias("n_shared"))


def redact(text: str, spans: list[tuple[int, int]], mark: str = "[SECRET]") -> str:
    """Every span, or run of overlapping spans, replaced by ``mark``."""
    out, at = [], 0
    for a, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, max_owners: int = 2, max_repositories: int = 20) -> DataFrame:
    """``docs`` with the secrets of ``text`` replaced and ``n_chars``, if there
    is such a column of numbers, made anew.

    All rows and columns stay, whatever their names; texts without secrets are
    unchanged.
    """
    found = scanned(docs)
    spans = _spans(found, max_owners, max_repositories).where("size(spans) > 0").select("doc_id", "text_hash", F.transform("spans", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"))).alias("spans"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    marked = _with_spans(rows, F.col("row.doc_id").cast("long"), F.xxhash64("row.text"), spans, "spans")
    cut_at = fresh(docs, "spans")
    marked = marked.select("row.*", F.col("spans").alias(cut_at))
    text_at, spans_at = docs.columns.index("text"), len(docs.columns)
    kinds = dict(docs.dtypes)
    length_at = docs.columns.index("n_chars") if kinds.get("n_chars") in ("bigint", "int") else None

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns[:spans_at])
            cut = [(redact(t, [(s["start"], s["end"]) for s in ss]) if ss and t else t) for t, ss in zip(batch.column(text_at).to_pylist(), batch.column(spans_at).to_pylist())]
            columns[text_at] = pa.array(cut, pa.string())
            if length_at is not None:
                columns[length_at] = pa.array([len(t) if t is not None else None for t in cut], columns[length_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:spans_at])

    return map_batches(marked, replace, docs.schema)
