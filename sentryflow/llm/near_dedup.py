"""MinHash near-duplicate detection by a signature-coordinate inverted join.

1. One pass over whole texts makes each document's set of distinct word
   shingles (64-bit hashes), a 128-bit digest of the set and a signature of
   ``coords`` MinHash coordinates.
2. Documents with equal sets become one class with a node number of its own;
   one row of it stands for it from here on.
3. A class is posted under coordinate-value pairs.  Two classes with at least
   ``matches`` equal coordinates must share one of the first
   ``coords - matches + 1`` of their pairs under any order that is the same for
   all (prefix filter), so only those are posted, rarest first.  The order
   comes from a count table of fixed size (hash buckets), which need not be exact.
4. Posting lists are merged in sorted order: lists of one entry are skipped, as
   are pairs whose set sizes alone rule out the similarity; collisions are
   counted and pairs under ``matches`` dropped.  An entry is taken off the list with
   all it matches before the next is compared, so a list of copies costs one sweep.
   Lists over ``LIST_BLOCK`` are cut into blocks and compared block by block in
   separate tasks.  A task returns a spanning forest of the pairs it found,
   never all pairs of a group.
5. The pairs of the forest are confirmed on full shingle sets, a hub's in
   slices.  Candidate components that confirmed pairs do not hold together are then
   compared pair by pair, by blocks; both kinds of links give the components.

Step 5 sees every pair inside a candidate component that is still apart, so no
pair that the signatures retained is lost: a spanning forest keeps the component whole.

Defined cases: a null, empty or wordless text has an empty set (n_shingles 0)
and links with nothing.  ``near_duplicates`` works on doc_ids: rows that repeat a doc_id
are each judged by their own text and share the id as their node, so their
links add up; a row with null doc_id takes no part, keeps its n_shingles, and
has a null component_id and kept true.  ``keep_one`` works on rows: repeated or null
ids are no ids at all there.  Very long texts are processed whole, in memory of one text.
Columns beyond id and text are ignored or carried, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from sentryflow.llm.components import connected_components, sized
from sentryflow.llm.streams import sorted_groups
from sentryflow.staging import spread, staged

COORDS = 48
MATCHES = 28
LIST_BLOCK = 2048
SET_BLOCK = 1 << 20
BUCKET_BITS = 16
#: Candidates' keys are broadcast up to so many rows of 32 bytes; beyond, texts and keys meet by a shuffle.
BROADCAST_ROWS = 500_000
#: Leaves of a hub that are confirmed in one slice.
HUB_SLICE = 512
_M = np.uint64(0x9E3779B97F4A7C15)


class WordHash(dict):
    """Word bytes to 64-bit hash; emptied when it has grown to ``bound`` words.  Words over 64 bytes are not held."""

    def __init__(self, bound: int = 200_000):
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= self.bound:
                self.clear()
            self[word] = h
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: WordHash, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's k-word shingles (the whole sequence if it is shorter)."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(w)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, w), np.uint64, n)
    size = min(k, n)
    acc = np.full(n - size + 1, np.uint64(size))
    for i in range(size):
        acc = mix(acc * _M + h[i : n - size + 1 + i])
    return np.unique(acc)


def signature(s: np.ndarray, coords: int) -> np.ndarray:
    """MinHash of a set under ``coords`` fixed permutations; each value also names its coordinate."""
    seeds = mix(np.arange(1, coords + 1, dtype=np.uint64) * _M)[:, None]
    low = np.full(coords, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 4096):
        low = np.minimum(low, mix((s[None, at : at + 4096] ^ seeds) * _M).min(axis=1))
    return mix(low ^ seeds[:, 0])


def _sketch(coords: int, k: int):
    def run(batches):
        words = WordHash()
        for b in batches:
            out = {"n": [], "digest": [], "sig": []}
            for text in b.column(2):
                s = shingle_set(text.as_py(), words, k)
                out["n"].append(len(s))
                out["digest"].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                out["sig"].append(signature(s, coords).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(out["n"], pa.int64()), pa.array(out["digest"], pa.binary()), pa.array(out["sig"], pa.binary())],
                names=["doc_id", "t", "n", "digest", "sig"],
            )

    return run


def _bucket_counts(batches):
    total = np.zeros(1 << BUCKET_BITS, np.int64)
    for b in batches:
        for sig in b.column(0).to_pylist():
            total += np.bincount((np.frombuffer(sig, np.uint64) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(total))
    (at,) = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "c"])


def _post(counts: np.ndarray, prefix: int):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint64).reshape(b.num_rows, -1)
            order = np.lexsort((sig, counts[(sig >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]), axis=1)[:, :prefix]
            token = np.take_along_axis(sig, order, 1).view(np.int64).ravel()
            width = order.shape[1]
            small = (sig & np.uint64(255)).astype(np.uint8)
            sigs = pa.FixedSizeBinaryArray.from_buffers(pa.binary(small.shape[1]), b.num_rows, [None, pa.py_buffer(small.tobytes())])
            at = pa.array(np.repeat(np.arange(b.num_rows), width))
            yield pa.RecordBatch.from_arrays(
                [pa.array(token), b.column(0).take(at), b.column(1).take(at), sigs.cast(pa.binary()).take(at)],
                names=["token", "rep", "n", "sig"],
            )

    return run


class Forest:
    """Union-find over positions; ``tree`` holds the pairs that joined two parts."""

    def __init__(self, n: int):
        self.up, self.tree = list(range(n)), []

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.tree.append((i, j))


def swept(m: int, matching) -> list[tuple[int, int]]:
    """A spanning forest over 0..m-1 of the pairs that ``matching(i, rest)`` (an array of those of ``rest`` that match i) holds for.

    What matches is taken off ``rest`` at once and compared with the remainder in its turn.
    """
    out, rest = [], np.arange(m)
    while len(rest) > 1:
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            i = todo.pop()
            hit = matching(i, rest)
            if len(hit):
                out += [(i, int(j)) for j in hit]
                todo += hit.tolist()
                rest = np.setdiff1d(rest, hit, assume_unique=True)
    return out


def _merge(matches: int, percent: int):
    """Sorted postings of a token and tile to a spanning forest of pairs with enough equal coordinates."""

    def pairs(group: dict) -> list[tuple[int, int]]:
        order = np.argsort(group["rep"], kind="stable")
        rep, n = group["rep"][order], group["n"][order]
        sig = np.frombuffer(b"".join(group["sig"][i] for i in order), np.uint8).reshape(len(rep), -1)

        def matching(i, rest):
            near = rest[100 * np.minimum(n[i], n[rest]) >= percent * np.maximum(n[i], n[rest])]
            return near[(sig[near] == sig[i]).sum(axis=1) >= matches] if len(near) else near

        return [(int(rep[i]), int(rep[j])) for i, j in swept(len(rep), matching) if rep[i] != rep[j]]

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for group in sorted_groups(batches, ["token", "tile"], least=2):
            seen.update(pairs(group))
            if len(seen) >= 50_000:
                yield _edges(seen)
                seen = set()
        yield _edges(seen)

    return run


def _edges(pairs) -> pa.RecordBatch:
    pairs = list(pairs)
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])


def _sets(k: int):
    def run(batches):
        words = WordHash()
        for b in batches:
            sets = [shingle_set(t.as_py(), words, k).tobytes() for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()), *b.columns[1:]], names=["set", *b.schema.names[1:]])

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted distinct arrays, by blocks of an incidence matrix."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    values, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[at] > 1
    owner, at = owner[shared], at[shared]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out = np.zeros((m, m), np.float32)
    if len(at):
        at = np.concatenate(([0], np.cumsum(np.diff(at) > 0)))
        step = 4096
        edges = np.searchsorted(at, np.arange(0, at[-1] + 1 + step, step))
        for lo, hi in zip(edges[:-1], edges[1:]):
            if hi > lo:
                here, rows = np.unique(owner[lo:hi], return_inverse=True)
                a = np.zeros((len(here), step), np.float32)
                a[rows, at[lo:hi] % step] = 1
                out[np.ix_(here, here)] += a @ a.T
    return out


def _confirm(percent: int):
    """Rows of a candidate component and tile to a spanning forest of links confirmed on full sets, of those not yet joined."""

    def run(batches):
        for group in sorted_groups(batches, ["comp", "tile"], least=2):
            order = np.argsort(group["rep"], kind="stable")
            rep, sub = group["rep"][order], group["sub"][order]
            if (sub == sub[0]).all():
                continue
            sets = [np.frombuffer(group["set"][i], np.uint64) for i in order]
            n = np.array([len(s) for s in sets])
            inter = overlaps(sets).astype(np.int64)
            forest = Forest(len(rep))
            for i in range(len(rep) - 1):
                both = inter[i, i + 1 :]
                for j in np.nonzero((100 * both >= percent * (n[i] + n[i + 1 :] - both)) & (sub[i + 1 :] != sub[i]))[0]:
                    forest.join(i, i + 1 + int(j))
            yield _edges([(int(rep[i]), int(rep[j])) for i, j in forest.tree if rep[i] != rep[j]])

    return run


def _confirm_slices(percent: int):
    """Rows of a hub and slice, the hub's own set first (leaf 0), to the confirmed pairs."""

    def run(batches):
        for group in sorted_groups(batches, ["hub", "slice"], least=2):
            order = np.argsort(group["leaf"], kind="stable")
            own = np.frombuffer(group["set"][order[0]], np.uint64)
            out = []
            for i in order[1:]:
                other = np.frombuffer(group["set"][i], np.uint64)
                both = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(other) - both):
                    out.append((int(group["hub"][0]), int(group["rep"][i])))
            yield _edges(out)

    return run


def _tiles(df: DataFrame, blocks) -> DataFrame:
    """A row of a group of ``blocks`` blocks goes to the tiles of its own block with each; every pair of rows meets in a tile."""
    own = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    return (
        df.withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumn("tile", F.least("own", "other") * F.col("blocks") + F.greatest("own", "other"))
        .drop("blocks", "own", "other")
    )


def _classes(base: DataFrame, percent: int, shingle: int, coords: int, matches: int) -> tuple[DataFrame, DataFrame]:
    """``base``: doc_id, t, text.  Returns its rows as (doc_id, t, n, digest) and the classes as (digest, node, root)."""
    schema = "doc_id long, t long, n long, digest binary, sig binary"
    sketches = staged(spread(base).mapInArrow(_sketch(coords, shingle), schema), "sketch")
    # a node is a number of the class, given once when the table is written
    reps = staged(
        sketches.where("digest is not null")
        .groupBy("digest")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "t")).alias("r"), F.max("n").alias("n"), F.min("sig").alias("sig"))
        .select("digest", F.monotonically_increasing_id().alias("rep"), F.col("r.doc_id").alias("rep_doc"), F.col("r.t").alias("rep_t"), "n", "sig"),
        "reps",
    )
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    # at most 2 ** BUCKET_BITS rows, whatever the size of the input
    for bucket, c in reps.select("sig").mapInArrow(_bucket_counts, "bucket int, c long").groupBy("bucket").agg(F.sum("c")).collect():
        counts[bucket] = c
    posts = reps.select("rep", "n", "sig").mapInArrow(_post(counts, coords - matches + 1), "token long, rep long, n long, sig binary")
    long_lists = posts.groupBy("token").count().where(F.col("count") > LIST_BLOCK)
    tiled = _tiles(posts.join(long_lists, "token", "left"), F.coalesce(F.ceil(F.col("count") / LIST_BLOCK), F.lit(1)).cast("long"))
    candidates = staged(
        tiled.select("token", "tile", "rep", "n", "sig")
        .repartition("token", "tile")
        .sortWithinPartitions("token", "tile")
        .mapInArrow(_merge(matches, percent), "a long, b long")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(),
        "candidates",
    )
    total = reps.count()
    groups = connected_components(candidates, ready=True)
    members = groups.join(reps, F.col("node") == F.col("rep")).select("rep", F.col("root").alias("comp"), "n", "rep_doc", "rep_t")
    members = staged(sized(members, total), "members")
    sets = staged(member_sets(base, members, shingle), "sets")
    direct = staged(confirmed_pairs(candidates, sets, percent), "direct")
    joined = connected_components(direct, ready=True)
    parts = members.join(joined, F.col("node") == F.col("rep"), "left").select("rep", "comp", "n", F.coalesce("root", "rep").alias("sub"))
    parts = staged(sized(parts, total), "parts")
    apart = parts.groupBy("comp").agg(F.min("sub").alias("lo"), F.max("sub").alias("hi")).where("lo <> hi").select("comp")
    # links between parts join whole parts
    links = confirmed_links(parts.join(apart, "comp", "left_semi"), sets, percent)
    sub_of = lambda c: parts.select(F.col("rep").alias(c), F.col("sub").alias(f"{c}_sub"))
    merged = connected_components(links.join(sub_of("a"), "a").join(sub_of("b"), "b").select(F.col("a_sub").alias("a"), F.col("b_sub").alias("b")))
    roots = parts.join(merged, F.col("sub") == F.col("node"), "left").select("rep", F.coalesce("root", "sub").alias("root"))
    classes = reps.select("digest", "rep", "rep_doc").join(roots, "rep", "left")
    return sketches.select("doc_id", "t", "n", "digest"), classes.select("digest", "rep_doc", F.coalesce("root", "rep").alias("root"))


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    percent: int = 85,
    shingle: int = 5,
    coords: int = COORDS,
    matches: int = MATCHES,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    base = _base(docs, id_col, text_col)
    rows, classes = _classes(base.where("doc_id is not null"), percent, shingle, coords, matches)
    total = rows.count()
    classes = staged(sized(classes, total), "node_roots")
    label = classes.groupBy("root").agg(F.min("rep_doc").alias("label"))
    labels = staged(sized(classes.join(label, "root").select("digest", "label"), total), "labels")
    # ids with texts of several classes tie their classes together; the smallest id of a component stands for it
    several = rows.where("digest is not null").groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi")
    ties = rows.join(several.select("doc_id"), "doc_id", "left_semi").where("digest is not null").join(labels, "digest")
    tied = connected_components(ties.select(F.col("doc_id").alias("a"), F.col("label").alias("b")))
    ids = labels.join(tied, F.col("label") == F.col("node"), "left").select("digest", F.coalesce("root", "label").alias("component_id"))
    worded = rows.where("digest is not null").join(ids, "digest").select("doc_id", "n", "component_id")
    # a wordless row shares the node of its id, if other rows with that id have words
    bare = rows.where("digest is null").join(tied.withColumnRenamed("root", "component_id"), F.col("doc_id") == F.col("node"), "left")
    own = worded.select("doc_id", "component_id").join(rows.where("digest is null").select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("own"))
    bare = bare.join(own, "doc_id", "left").select("doc_id", "n", F.coalesce("component_id", "own", "doc_id").alias("component_id"))
    nameless = spread(base.where("doc_id is null")).mapInArrow(_sketch(coords, shingle), "doc_id long, t long, n long, digest binary, sig binary")
    nameless = nameless.select("doc_id", "n", F.lit(None).cast("long").alias("component_id"))
    return (
        worded.unionByName(bare)
        .unionByName(nameless)
        .select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    percent: int = 80,
    shingle: int = 5,
    coords: int = COORDS,
    matches: int = MATCHES,
) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns: of each group of texts that links join, one row of that with the smallest id (null last).

    Rows are judged by their texts alone.  Wordless texts all stay.
    """
    base = _base(docs, id_col, text_col)
    rows, classes = _classes(base, percent, shingle, coords, matches)
    total = rows.count()
    named = rows.where("digest is not null").join(classes.select("digest", "root"), "digest").groupBy("root", "doc_id", "t").agg(F.count("*").alias("c"))
    named = staged(sized(named, total), "named")
    first = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "t")).alias("r")).select(F.col("root").alias("f_root"), F.col("r.doc_id").alias("f_doc"), F.col("r.t").alias("f_t"))
    judged = named.join(first, F.col("root") == F.col("f_root")).withColumn("first", F.col("doc_id").eqNullSafe(F.col("f_doc")) & (F.col("t") == F.col("f_t")))
    judged = staged(sized(judged.select(F.col("doc_id").alias("__doc"), F.col("t").alias("__t"), "first", "c"), total), "judged")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(id_col).cast("long").alias("__id"), F.xxhash64(text_col).alias("__h"))
    same = F.col("__id").eqNullSafe(F.col("__doc")) & (F.col("__h") == F.col("__t"))
    left = d.join(judged.where("not first"), same, "left_anti")
    repeated = judged.where("first and c > 1")
    one = left.join(repeated, same, "left_semi").dropDuplicates(["__id", "__h"])
    return left.join(repeated, same, "left_anti").select("__row").unionByName(one.select("__row")).select("__row.*")


def member_sets(base: DataFrame, members: DataFrame, shingle: int) -> DataFrame:
    """rep, set: the shingle set of each member, made from one row's text."""
    placed = members.select("rep", "rep_doc", "rep_t")
    if members.count() <= BROADCAST_ROWS:
        placed = F.broadcast(placed)
    texts = base.join(placed, (F.col("t") == F.col("rep_t")) & F.col("doc_id").eqNullSafe(F.col("rep_doc"))).groupBy("rep").agg(F.min("text").alias("text"))
    return texts.select("text", "rep").mapInArrow(_sets(shingle), "set binary, rep long")


def confirmed_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that full sets confirm.  Pairs meet at the end with more of them, its hub, in slices of ``HUB_SLICE``."""
    degree = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    p = pairs.join(degree.select(F.col("node").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("node").alias("b"), F.col("d").alias("db")), "b")
    a_first = F.col("da") >= F.col("db")
    p = p.select(F.when(a_first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("rep"))
    slices = p.groupBy("hub").agg(F.ceil(F.count("*") / HUB_SLICE).cast("long").alias("slices"))
    p = p.join(slices, "hub").select("hub", "rep", F.pmod(F.xxhash64("rep"), F.col("slices")).alias("slice"))
    p = staged(sized(p, pairs.count()), "pairs")
    leaves = p.join(sets, "rep").select("hub", "slice", F.lit(1).alias("leaf"), "rep", "set")
    hubs = p.select("hub", "slice").distinct().join(sets.withColumnRenamed("rep", "hub"), "hub").select("hub", "slice", F.lit(0).alias("leaf"), F.col("hub").alias("rep"), "set")
    return leaves.unionByName(hubs).repartition("hub", "slice").sortWithinPartitions("hub", "slice").mapInArrow(_confirm_slices(percent), "a long, b long")


def confirmed_links(parts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``parts``: rep, comp, n, sub of components that are still in several parts; links between their parts."""
    sizes = parts.groupBy("comp").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    blocks = F.greatest(F.ceil(F.col("m") / LIST_BLOCK), F.ceil(F.col("total") / SET_BLOCK), F.lit(1)).cast("long")
    placed = _tiles(parts.join(sizes, "comp").select("rep", "comp", "sub", blocks.alias("b")), F.col("b"))
    return (
        placed.select("comp", "tile", "rep", "sub")
        .join(sets, "rep")
        .select("comp", "tile", "rep", "sub", "set")
        .repartition("comp", "tile")
        .sortWithinPartitions("comp", "tile")
        .mapInArrow(_confirm(percent), "a long, b long")
    )
