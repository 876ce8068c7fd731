"""Language identification by hyperdimensional profiles.

Every letter has a random +1/-1 vector drawn from its code point alone.  A
letter trigram is the element-wise product (binding) of its letters' vectors,
rolled (permuted) by two, one and no places; a text is the sum (bundle) of its
trigrams' vectors.  A language's prototype is the sum of the unit vectors of its
training texts, less the mean prototype of all languages.  A text gets the
language whose prototype has the largest cosine with it, ties to the smallest
language; the score is that cosine, clipped to 0..1.

Fitting takes at most ``per_language`` labelled rows of each language; this is
the only bound.  A row's level is the number of sixteenths of a halving that its
hash lies below the top; a language takes all rows from the lowest level on
whose rows together are within the bound.  Levels are counted first (a number
a language and level), so no row moves: texts are bundled where they are read.
Prediction reads whole texts, a batch at a time, and nothing but the text.

Defined cases: a null text, or one without a letter, gives ``und`` and score 0,
as does every text when no labelled row exists; rows with a null label or id
are not learned from; repeated rows each get a row and count each towards the
bound (rows alike in id and text that are more than it are not learned from);
equal cosines go to the smallest language; columns may have any names, but
``carry`` must not name ``lang_pred`` or ``score``.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from sentryflow.staging import spread

DIM = 1024
PER_LANGUAGE = 400
_VECTOR_BOUND = 8_192
#: A text of at least LETTERS letters is in no learned language below this cosine.
LEAST = 0.1
LETTERS = 60
#: Levels a halving of the hash; the taken rows are within 5 % of the bound.
_STEPS = 16


class Encoder:
    """Texts to bundled trigram vectors; holds at most ``_VECTOR_BOUND`` trigram vectors, a byte a dimension."""

    def __init__(self, dim: int = DIM):
        self.dim, self.letters = dim, {}
        self._reset()

    def _reset(self) -> None:
        self.index: dict[int, int] = {}
        self.rows = np.empty((0, self.dim), np.int8)

    def letter(self, cp: int) -> np.ndarray:
        v = self.letters.get(cp)
        if v is None:
            bits = np.random.Generator(np.random.Philox(key=cp)).integers(0, 2, self.dim)
            v = self.letters[cp] = (2 * bits - 1).astype(np.int8)
        return v

    def vector(self, gram: int) -> np.ndarray:
        a, b, c = gram >> 42, (gram >> 21) & 0x1FFFFF, gram & 0x1FFFFF
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def grams(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Distinct trigrams of the lower-cased letters, words set apart by one space, with counts."""
        if not text:
            return None
        cps = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = np.unique(cps)
        letters = kinds[[chr(c).isalpha() for c in kinds]]
        if not len(letters):
            return None
        is_letter = np.isin(cps, letters)
        cps = np.where(is_letter, cps, 32).astype(np.int64)
        keep = np.ones(len(cps), bool)
        keep[1:] = is_letter[1:] | is_letter[:-1]
        cps = cps[keep]
        cps = np.concatenate(([32], cps[int(cps[0] == 32) : len(cps) - int(cps[-1] == 32)], [32]))
        return np.unique(cps[:-2] << 42 | cps[1:-1] << 21 | cps[2:], return_counts=True)

    def encode(self, texts: list[str | None]) -> np.ndarray:
        """One row a text, unit length; a text without letters is the zero row."""
        found = [self.grams(t) for t in texts]
        out = np.zeros((len(texts), self.dim), np.float32)
        known = [(i, g) for i, g in enumerate(found) if g is not None]
        if not known:
            return out
        every = np.unique(np.concatenate([g[0] for _, g in known]))
        for lo in range(0, len(every), _VECTOR_BOUND // 2):
            part = every[lo : lo + _VECTOR_BOUND // 2]
            table = self._table(part)
            counts = np.zeros((len(known), len(part)), np.float32)
            for r, (_, (g, c)) in enumerate(known):
                at = np.searchsorted(part, g)
                hit = at < len(part)
                hit[hit] = part[at[hit]] == g[hit]
                counts[r, at[hit]] = c[hit]
            out[[i for i, _ in known]] += counts @ table
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    def _table(self, grams: np.ndarray) -> np.ndarray:
        new = [g for g in grams.tolist() if g not in self.index]
        if new:
            if len(self.index) + len(new) > _VECTOR_BOUND:
                self._reset()
                new = grams.tolist()
            if len(self.rows) < (need := len(self.index) + len(new)):
                grown = np.empty((min(_VECTOR_BOUND, max(need, 2 * len(self.rows))), self.dim), np.int8)
                grown[: len(self.index)] = self.rows[: len(self.index)]
                self.rows = grown
            for g in new:
                self.rows[len(self.index)] = self.vector(g)
                self.index[g] = len(self.index)
        return self.rows[[self.index[g] for g in grams.tolist()]].astype(np.float32)


@functools.lru_cache(maxsize=1)
def encoder(dim: int) -> Encoder:
    """One a worker process, whatever its number of tasks."""
    return Encoder(dim)


@dataclass(frozen=True)
class Profiles:
    languages: list[str]
    prototypes: np.ndarray
    dim: int = DIM

    def predict(self, texts: list[str | None], encoder: Encoder) -> tuple[list[str], np.ndarray]:
        x = encoder.encode(texts)
        known = np.abs(x).sum(axis=1) > 0
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        sims = x.astype(np.float64) @ self.prototypes.T
        best = sims.argmax(axis=1)
        score = np.where(known, np.clip(sims.max(axis=1), 0, 1), 0.0)
        return [self.languages[b] if k else "und" for b, k in zip(best, known)], score

    def predict_all(self, texts: pa.Array, encoder: Encoder, at_once: int = 64) -> tuple[list[str], np.ndarray]:
        langs, scores = [], [np.zeros(0)]
        for lo in range(0, len(texts), at_once):
            got = self.predict(texts.slice(lo, at_once).to_pylist(), encoder)
            langs += got[0]
            scores.append(got[1])
        return langs, np.concatenate(scores)


def lowest_level(counts: dict[int, int], bound: int) -> int | None:
    """The lowest level from which on all rows are within the bound; None if even the highest has more."""
    total, low = 0, None
    for at in sorted(counts, reverse=True):
        total += counts[at]
        if total > bound:
            break
        low = at
    return low


def fit(train: DataFrame, *, per_language: int = PER_LANGUAGE, dim: int = DIM, id_col="doc_id", text_col="text", lang_col="lang") -> Profiles:
    """``train``: labelled rows.  At most ``per_language`` of each language are learned from."""
    level = F.floor(-_STEPS * F.log2((F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(text_col)), 11) + 1) / F.lit(2.0**53))).cast("int")
    rows = train.select(F.col(lang_col).cast("string").alias("lang"), level.alias("level"), F.col(text_col).alias("text")).where(
        F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()
    )
    counts: dict[str, dict[int, int]] = {}
    # a language and level each: 53 * 16 numbers a language at most
    for lang, at, n in rows.groupBy("lang", "level").count().collect():
        counts.setdefault(lang, {})[at] = n
    lowest = {lang: low for lang, c in counts.items() if (low := lowest_level(c, per_language)) is not None}
    if not lowest:
        return Profiles([], np.zeros((0, dim)), dim)
    floor = F.create_map(*[F.lit(x) for pair in lowest.items() for x in pair])
    chosen = rows.where(F.col("level") >= F.element_at(floor, F.col("lang"))).select("lang", "text")

    def bundle(batches):
        enc, sums = encoder(dim), {}
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo in range(0, len(texts), 64):
                for lang, v in zip(langs[lo : lo + 64], enc.encode(texts[lo : lo + 64])):
                    sums[lang] = sums.get(lang, 0) + v.astype(np.float64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"]
        )

    total: dict[str, np.ndarray] = {}
    for lang, v in sorted(chosen.mapInArrow(bundle, "lang string, v array<double>").collect()):
        total[lang] = total.get(lang, 0) + np.array(v)
    languages = sorted(k for k, v in total.items() if np.linalg.norm(v) > 0)
    if not languages:
        return Profiles([], np.zeros((0, dim)), dim)
    protos = np.stack([total[k] / np.linalg.norm(total[k]) for k in languages])
    if len(languages) > 1:
        protos = protos - protos.mean(axis=0)
    norm = np.linalg.norm(protos, axis=1, keepdims=True)
    return Profiles(languages, protos / np.where(norm > 0, norm, 1), dim)


def predict(docs: DataFrame, profiles: Profiles, *, text_col: str = "text", carry: list[str] = ()) -> DataFrame:
    """The columns ``carry``, lang_pred and score for each row."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry], F.lit(0).alias("_")).alias("row"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        enc = encoder(profiles.dim)
        for b in batches:
            langs, scores = profiles.predict_all(b.column(1), enc)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["row", "lang_pred", "score"])

    out = spread(rows).mapInArrow(run, schema)
    return out.select(*[F.col("row").getField(c).alias(c) for c in carry], "lang_pred", "score")


def written_in(docs: DataFrame, profiles: Profiles, *, text_col: str = "text", least: float = LEAST, letters: int = LETTERS) -> DataFrame:
    """The rows of ``docs``, all columns, that are in a learned language.

    A text without a letter goes.  One of ``letters`` letters or more goes if its score is under ``least``; a
    shorter one is too little evidence against it and stays.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    at = docs.columns.index(text_col)

    def run(batches):
        enc = encoder(profiles.dim)
        for b in batches:
            texts = pc.struct_field(b.column(0), [at])
            langs, scores = profiles.predict_all(texts, enc)
            keep = [lang != "und" and (s >= least or few_letters(t.as_py(), letters)) for lang, s, t in zip(langs, scores, texts)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return spread(rows).mapInArrow(run, rows.schema).select("row.*")


def few_letters(text: str, bound: int) -> bool:
    n = 0
    for c in text:
        n += c.isalpha()
        if n >= bound:
            return False
    return True
