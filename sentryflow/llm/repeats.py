"""Repeated passages by sparse suffix sorting.

Texts are words (A-Z lower-cased, split at ASCII white space).  Of all suffixes only
those at minimiser positions are kept: in every window of ``min_words`` words,
the k-gram (k = min_words / 2) with the smallest hash.  Two equal
passages of ``min_words`` words select the same position.

1. The kept suffixes are sorted by the hash of their first k words over range partitions
   (ties by class and position, so that a passage found everywhere is many
   partitions, not one), and each is compared with its neighbours.  A partition's
   outer rows are compared across its edges by their keys, two rows a partition.
2. A suffix that agrees with a neighbour is extended left and right: each passage of
   ``min_words`` words that selected it runs from up to ``min_words - k`` words to its left on to
   words to its right.  Extended passages are sorted by the hash of all their words
   and compared with their neighbours in the same way.
3. Passages that agree are merged into spans, which is the extension to the full match.

The result is exact up to 64-bit hashes: a word is in a span if and only if it lies in a run of
``min_words`` words that occurs at two places or more, in other texts or the same.

Documents with equal words are one class with one representative; they are
repeated as a whole.

Defined cases: null, empty and short texts have no spans; a null doc_id is
carried; rows that repeat a doc_id or text are copies of each other; very long texts
are processed whole, one at a time; columns other than id and text are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sentryflow.llm.near_dedup import WordHash, mix
from sentryflow.staging import spread, staged

MIN_WORDS = 50
_M = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str | None, words: WordHash) -> np.ndarray:
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(words.__getitem__, w), np.uint64, len(w))


def class_of(h: np.ndarray) -> int:
    """64-bit name of a sequence of words."""
    return int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True)


def kgrams(h: np.ndarray, k: int) -> np.ndarray:
    acc = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        acc = mix(acc * _M + h[i : len(h) - k + 1 + i])
    return acc


def selected(grams: np.ndarray, window: int) -> np.ndarray:
    """For each window of ``window`` k-grams, the position of the smallest (the first of equals)."""
    return np.concatenate(
        [
            np.lib.stride_tricks.sliding_window_view(grams[lo : lo + 65536 + window - 1], window).argmin(axis=1) + np.arange(lo, min(lo + 65536, len(grams) - window + 1))
            for lo in range(0, len(grams) - window + 1, 65536)
        ]
    )


def passages(grams: np.ndarray, k: int, min_words: int) -> np.ndarray:
    """Hash of the ``min_words`` words from each position: two k-grams that cover them."""
    return mix(grams[: len(grams) - (min_words - k)] * _M + grams[min_words - k :])


def _scan(min_words: int):
    k = (min_words + 1) // 2

    def run(batches):
        words = WordHash()
        for b in batches:
            digest, n, pos, key = [], [], [], []
            for text in b.column(1):
                h = word_hashes(text.as_py(), words)
                n.append(len(h))
                digest.append(class_of(h))
                if len(h) >= min_words:
                    g = kgrams(h, k)
                    at = np.unique(selected(g, min_words - k + 1))
                    pos.append(at.astype(np.int32))
                    key.append(g[at].view(np.int64))
                else:
                    pos.append([])
                    key.append([])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(digest, pa.int64()), pa.array(n, pa.int64()), pa.array(pos, pa.list_(pa.int32())), pa.array(key, pa.list_(pa.int64()))],
                names=["doc_id", "t", "c", "n_words", "pos", "key"],
            )

    return run


def _extend(min_words: int):
    """Rows of a class (c), text and matched positions to the passages that selected them."""
    k = (min_words + 1) // 2

    def run(batches):
        words = WordHash()
        for b in batches:
            ids, starts, found = [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int64)]
            for c, text, hit in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                h = word_hashes(text.as_py(), words)
                g = kgrams(h, k)
                (start,) = np.nonzero(np.isin(selected(g, min_words - k + 1), hit.values.to_numpy()))
                ids.append(np.full(len(start), c, np.int64))
                starts.append(start.astype(np.int32))
                found.append(passages(g, k, min_words)[start].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, starts, found)], names=["c", "start", "passage"])

    return run


def _merge(min_words: int):
    def run(batches):
        for b in batches:
            spans = []
            for starts in b.column(1):
                s = np.sort(starts.values.to_numpy())
                cut = np.nonzero(np.diff(s) > min_words)[0]
                firsts, lasts = s[np.concatenate(([0], cut + 1))], s[np.concatenate((cut, [len(s) - 1]))]
                spans.append([{"start": int(a), "stop": int(z) + min_words} for a, z in zip(firsts, lasts)])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))], names=["c", "spans"]
            )

    return run


def _neighbours(batches):
    """Rows (key, c, at) of a sorted partition to (c, at, key, agrees, edge): those that agree with a neighbour, and the outer two."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    last = None  # the row before, with what is known of it: key, c, at, agrees, first

    def out(rows, edge):
        cols = [np.array([r[i] for r in rows], np.int64) for i in (1, 2, 0)]
        return pa.RecordBatch.from_arrays(
            [*map(pa.array, cols), pa.array([r[3] for r in rows], pa.bool_()), pa.array([edge] * len(rows), pa.bool_()), pa.array([part] * len(rows), pa.int32())],
            names=["c", "at", "key", "agrees", "edge", "part"],
        )

    first = None
    for b in batches:
        if not b.num_rows:
            continue
        key, c, at = (b.column(i).to_numpy() for i in range(3))
        same = key[1:] == key[:-1]
        agrees = np.zeros(len(key), bool)
        agrees[1:] |= same
        agrees[:-1] |= same
        if last is not None and last[0] == key[0]:
            agrees[0] = True
            last = (*last[:3], True)
        if first is None:
            first = (int(key[0]), int(c[0]), int(at[0]), bool(agrees[0]))
        elif first[0] == key[0] and first[1:3] == last[1:3]:
            first = (*first[:3], last[3])
        if last is not None:
            yield out([last] if last[3] else [], False)
        (keep,) = np.nonzero(agrees[:-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(c[keep]), pa.array(at[keep]), pa.array(key[keep]), pa.array(np.ones(len(keep), bool)), pa.array(np.zeros(len(keep), bool)), pa.array(np.full(len(keep), part, np.int32))],
            names=["c", "at", "key", "agrees", "edge", "part"],
        )
        last = (int(key[-1]), int(c[-1]), int(at[-1]), bool(agrees[-1]))
    if last is not None:
        yield out([last] if last[3] else [], False)
        yield out([first, last], True)


def agreeing(rows: DataFrame, name: str) -> DataFrame:
    """``rows``: key, c, at (longs, no two alike).  The (c, at) of rows whose key some other row has, by sorting and comparing neighbours."""
    found = staged(
        rows.select("key", "c", "at").repartitionByRange("key", "c", "at").sortWithinPartitions("key", "c", "at").mapInArrow(_neighbours, "c long, at long, key long, agrees boolean, edge boolean, part int"),
        name,
    )
    # two rows a partition: a row that agrees with none in its own may agree across the edge
    edges = found.where("edge")
    across = edges.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("key")
    late = edges.where("not agrees").join(across, "key", "left_semi").select("c", "at").distinct()
    return found.where("agrees and not edge").select("c", "at").unionByName(late)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_words, spans (array of start, stop in words) for each row."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t"))
    scanned = staged(spread(base).mapInArrow(_scan(min_words), "doc_id long, t long, c long, n_words long, pos array<int>, key array<long>"), "suffixes")
    long_enough = scanned.where(F.col("n_words") >= min_words)
    classes = long_enough.groupBy("c").agg(F.count("*").alias("copies"), F.min(F.struct("t", "doc_id")).alias("r"), F.first("pos").alias("pos"), F.first("key").alias("key"))
    classes = staged(classes.select("c", "copies", F.col("r.t").alias("r_t"), F.col("r.doc_id").alias("r_id"), "pos", "key"), "classes")
    suffixes = classes.select("c", F.explode(F.arrays_zip("pos", "key")).alias("x")).select(F.col("x.key").alias("key"), "c", F.col("x.pos").cast("long").alias("at"))
    matched = agreeing(suffixes, "sorted").groupBy("c").agg(F.collect_list(F.col("at").cast("int")).alias("hit"))
    placed = matched.join(classes.select("c", "r_t", "r_id"), "c")
    # one row of each class gives its text, however many repeat it
    chosen = base.join(placed.hint("merge"), (F.col("t") == F.col("r_t")) & F.col("doc_id").eqNullSafe(F.col("r_id")))
    chosen = chosen.select("c", "text", "hit").dropDuplicates(["c"])
    found = staged(chosen.mapInArrow(_extend(min_words), "c long, start int, passage long"), "passages")
    twice = agreeing(found.select(F.col("passage").alias("key"), "c", F.col("start").cast("long").alias("at")), "extended")
    spans = twice.groupBy("c").agg(F.collect_list(F.col("at").cast("int")).alias("starts")).mapInArrow(_merge(min_words), "c long, spans array<struct<start:long,stop:long>>")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("stop")))
    none = F.array().cast("array<struct<start:long,stop:long>>")
    known = classes.select("c", "copies").join(spans, "c", "left")
    out = scanned.select("doc_id", "c", "n_words").join(known, "c", "left")
    return out.select("doc_id", "n_words", F.when(F.col("copies") > 1, whole).otherwise(F.coalesce("spans", none)).alias("spans"))
