"""Personal data: pattern spans, and terms that disclose them by corpus co-occurrence.

Base spans are e-mail addresses, IPv4 addresses, card numbers (Luhn) and phone
numbers.  A secret is a run of ``SECRET_CHARS`` characters or more with letters and digits
whose characters carry ``SECRET_BITS`` bits each or more: text that no corpus predicts.  All five are
protected kinds.  Information-theoretic sanitisation adds terms: over all documents,
df(t) is the number that hold term t outside protected spans, both(t, kind) the number of
those with a span of the kind anywhere, df(kind) the number with the kind, N
all documents.  The information that t gives about the kind is
PMI = log2(both * N / (df(t) * df(kind))), and IC = log2(N / df(kind)) is all
there is to disclose.  A term discloses the kind if PMI >= ``disclosure`` * IC and
so many common documents are not chance: the Chernoff bound of a binomial tail,
2 ** -(df * KL(both / df, df(kind) / N)), is at most ``error`` over the number of
pairs of term and kind that share a document.  Every occurrence of a disclosing
term outside protected spans, in whatever document, is a span of kind ``term``.

``sanitise`` generalises protected spans to their kind, as [EMAIL], and removes terms as [TERM].

Defined cases: a null or empty text has no spans; a document is a row, so
repeated rows count each; columns other than id and text are ignored; with
no documents, or a kind in all of them (IC 0), nothing is added for it.  Very long
texts are searched whole, a text at a time.  Columns may have any names.
Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sentryflow.staging import spread, staged

KINDS = ("email", "ip", "card", "phone")
PROTECTED = (*KINDS, "secret")
SECRET_CHARS = 20
SECRET_BITS = 3.0
#: One shared document is no co-occurrence.
SUPPORT = 2
DISCLOSURE = 0.8
ERROR = 0.01
#: Terms counted in a Python worker before they are handed on.
COUNTED = 100_000
#: Disclosing terms that a worker holds at once; more are searched for in several passes.
HELD = 300_000

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match can only begin where a run of digits does; possessive runs keep the search linear
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def emails(text: str) -> list[tuple[int, int]]:
    out, end = [], 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, m.end()))
            end = m.end()
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    if not text:
        return []
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    if not _DIGITS.search(text):
        return out
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() and c.isascii() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# only where a run begins
_OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}+" % SECRET_CHARS)


def opaque(run: str) -> bool:
    """Letters and digits mixed, with the Shannon information of a key a character."""
    digits = sum(c.isdigit() for c in run)
    if not 2 <= digits <= len(run) - 2 or not any(c.isalpha() for c in run):
        return False
    n = len(run)
    return -sum(c / n * math.log2(c / n) for c in Counter(run).values()) >= SECRET_BITS


def protected_spans(text: str | None) -> list[tuple[str, int, int]]:
    """The base spans, then the secrets that overlap none of them."""
    out = base_spans(text)
    if text and _DIGITS.search(text):
        taken = [(a, z) for _, a, z in out]
        out += [("secret", m.start(), m.end()) for m in _OPAQUE.finditer(text) if opaque(m[0]) and not any(a < m.end() and m.start() < z for a, z in taken)]
    return out


_EDGE = ".,;:!?()[]{}\"'"


def term_of(word: str) -> str:
    """A word as a term: outer punctuation off, lower case; empty if no letter is left."""
    t = word.strip(_EDGE).lower()
    return t if any(c.isalpha() for c in t) else ""


def encoded_words(text: str) -> set[bytes]:
    """The distinct words of a text in UTF-8: bytes split at the same ASCII white space as ``_WORD``."""
    return set(text.encode("utf-8", "surrogatepass").split())


class Terms(dict):
    """Word in UTF-8 to its term (empty for none), or None if it is not in ``wanted``; emptied when it has grown to ``bound`` words."""

    def __init__(self, wanted=None, bound: int = 200_000):
        self.wanted, self.bound = wanted, bound

    def __missing__(self, word: bytes) -> str | None:
        t = term_of(word.decode("utf-8", "surrogatepass"))
        t = t if self.wanted is None or t in self.wanted else None
        if len(word) <= 64:
            if len(self) >= self.bound:
                self.clear()
            self[word] = t
        return t


def free_words(text: str, spans: list[tuple[str, int, int]]):
    """Matches of the words that overlap no span."""
    taken = sorted((s, e) for _, s, e in spans)
    at, reach = 0, 0
    for m in _WORD.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= m.start():
            yield m


def _scan(batches):
    for b in batches:
        base = [[{"kind": k, "start": s, "stop": e} for k, s, e in protected_spans(text.as_py())] for text in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(base, _BASE)], names=["row", "doc_id", "base"])


def _count(batches):
    """Documents that hold a term, and those of them with each kind, summed over what a worker has seen."""
    terms, counts = Terms(), {}

    def out():
        sums = zip(*counts.values()) if counts else [[]] * (1 + len(PROTECTED))
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array(c, pa.int64()) for c in sums)], names=["term", "df", *PROTECTED])

    for b in batches:
        for text in b.column(0):
            text = text.as_py() or ""
            spans = protected_spans(text)
            found = {terms[w] for w in ({m[0].encode("utf-8", "surrogatepass") for m in free_words(text, spans)} if spans else encoded_words(text))}
            found.discard("")
            has = {s[0] for s in spans}
            one = [1, *(int(k in has) for k in PROTECTED)]
            for t in found:
                c = counts.get(t)
                if c is None:
                    counts[t] = one.copy()
                elif spans:
                    counts[t] = [x + y for x, y in zip(c, one)]
                else:
                    c[0] += 1
            if len(counts) >= COUNTED:
                yield out()
                counts.clear()
    yield out()


def _search(wanted):
    """The occurrences of the terms of a broadcast set, for the rows that have any."""

    def run(batches):
        terms = Terms(wanted.value)
        for b in batches:
            at, found = [], []
            for i, text in enumerate(b.column(1)):
                text = text.as_py() or ""
                if any(terms[w] is not None for w in encoded_words(text)):
                    hits = [{"start": m.start(), "stop": m.end()} for m in free_words(text, protected_spans(text)) if terms[m[0].encode("utf-8", "surrogatepass")] is not None]
                    if hits:
                        at.append(i)
                        found.append(hits)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), pa.array(found, _TERMS)], names=["row", "doc_id", "terms"])

    return run


_BASE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
_TERMS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def disclosing_terms(docs: DataFrame, scanned: DataFrame, *, support: int = SUPPORT, disclosure: float = DISCLOSURE, error: float = ERROR) -> DataFrame:
    """kind, term, both, df, pmi, ic of the terms over the threshold; ``docs`` has text, ``scanned`` the base spans."""
    n = F.lit(float(scanned.count()))
    kinds = scanned.select(F.explode(F.array_distinct(F.transform("base", lambda s: s["kind"]))).alias("kind")).groupBy("kind").agg(F.count("*").alias("df_kind"))
    counts = docs.select("text").mapInArrow(_count, "term string, df long, " + ", ".join(f"{k} long" for k in PROTECTED))
    counts = counts.groupBy("term").agg(F.sum("df").alias("df"), *[F.sum(k).alias(k) for k in PROTECTED])
    pairs = staged(
        counts.select("term", "df", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("both")) for k in PROTECTED])).alias("x"))
        .select("x.kind", "term", "x.both", "df")
        .where("both > 0"),
        "terms",
    )
    tests = F.lit(float(max(pairs.count(), 1)))
    q, p = F.col("both") / F.col("df"), F.col("df_kind") / n
    rest = F.when(F.col("both") < F.col("df"), (1 - q) * F.log2((1 - q) / (1 - p))).otherwise(0.0)
    out = pairs.where(F.col("both") >= support).join(F.broadcast(kinds.where(F.col("df_kind") < n)), "kind")
    out = out.withColumn("pmi", F.log2(q / p)).withColumn("ic", -F.log2(p)).withColumn("bits", F.col("df") * (q * F.col("pmi") + rest))
    return out.where((F.col("pmi") >= disclosure * F.col("ic")) & (F.col("bits") >= F.log2(tests / error))).drop("bits", "df_kind")


def find_spans(docs: DataFrame, *, id_col="doc_id", text_col="text", support: int = SUPPORT, disclosure: float = DISCLOSURE, error: float = ERROR) -> DataFrame:
    """doc_id, t (hash of the text), base (protected spans) and terms (arrays of kind, start, stop) for each row."""
    sc = docs.sparkSession.sparkContext
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = spread(base.select(F.xxhash64("text").alias("row"), "text", "doc_id"))
    scanned = staged(texts.mapInArrow(_scan, "row long, doc_id long, base array<struct<kind:string,start:long,stop:long>>"), "spans")
    terms = staged(disclosing_terms(texts, scanned, support=support, disclosure=disclosure, error=error).select("term").distinct(), "disclosing")
    passes = max(1, -(-terms.count() // HELD))
    hit = None
    for i in range(passes):
        wanted = sc.broadcast(frozenset(r[0] for r in terms.where(F.pmod(F.xxhash64("term"), F.lit(passes)) == i).toLocalIterator()))
        some = texts.mapInArrow(_search(wanted), "row long, doc_id long, terms array<struct<start:long,stop:long>>")
        hit = some if hit is None else hit.unionByName(some)
    hit = hit.groupBy("doc_id", "row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms"))
    a, b = scanned.select("doc_id", "row", "base"), hit.withColumnsRenamed({"doc_id": "h_doc", "row": "h_row"})
    return a.join(b, a["doc_id"].eqNullSafe(b["h_doc"]) & (a["row"] == b["h_row"]), "left").select(
        "doc_id", F.col("row").alias("t"), "base", F.coalesce("terms", F.array().cast("array<struct<start:long,stop:long>>")).alias("terms")
    )


def sanitise(docs: DataFrame, *, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """doc_id and the sanitised text of each row."""
    found = find_spans(docs, id_col=id_col, text_col=text_col, **options).dropDuplicates(["doc_id", "t"]).withColumnRenamed("doc_id", "f_doc")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    joined = base.join(found, base["doc_id"].eqNullSafe(found["f_doc"]) & (F.xxhash64(base["text"]) == found["t"]))

    def run(batches):
        for b in batches:
            out = []
            for text, spans, terms in zip(*(c.to_pylist() for c in b.columns[1:])):
                marks = sorted([(s["start"], s["stop"], s["kind"]) for s in spans] + [(s["start"], s["stop"], "term") for s in terms])
                parts, at = [], 0
                for s, e, kind in marks:
                    if s >= at:
                        parts += [(text or "")[at:s], f"[{kind.upper()}]"]
                    at = max(at, e)
                out.append(None if text is None else "".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return joined.select("doc_id", "text", "base", "terms").mapInArrow(run, "doc_id long, text string")


def span_digests(found: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256, spans and flagged (any span) of what ``find_spans`` gave."""
    label = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))
    base = F.transform(F.filter("base", lambda s: s["kind"] != "secret"), label)
    term = F.transform("terms", lambda s: F.concat_ws(":", F.lit("term"), s["start"].cast("string"), s["stop"].cast("string")))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *map(count, PROTECTED),
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(F.transform("base", label), term), ",").alias("spans"),
        F.size("terms").cast("long").alias("n_term"),
        (F.size("base") + F.size("terms") > 0).alias("flagged"),
    )
