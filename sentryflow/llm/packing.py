"""Token ids to packed training rows by best-fit-decreasing.

Documents are tokenised (byte-level BPE, ids of a given vocabulary file), cut
into pieces of at most ``length`` ids, and packed into rows of ``length`` ids.
Pieces are placed longest first, each in the open row with the least room
that holds it; a segment tree over room sizes finds that row in log(length)
steps.  Packing works on blocks of ``block_tokens`` ids as they come in a partition, so
memory is bounded and nothing is shuffled; only a block's last rows are partly
filled.

A packed row has its ids, cumulative segment lengths (``cu_seqlens``, from 0),
position ids that restart at 0 with each segment, and per segment the doc_id and
the offset of the piece within its document, from which documents are restored
without loss.  ``write_packed`` writes them as flat binary files where the texts
are read, and ``read_matrix`` reads the files back as rows.

Files of a shard, little-endian, below a shared folder: ``ids-*.bin`` (matrix of
``length`` columns, padded; uint16 if the vocabulary fits, else uint32), ``rows-*.bin`` (int32: segments of each
row), ``cu-*.bin`` (int32: each row's cumulative lengths, from 0), ``reset-*.bin`` (int32: the column where
each segment begins and position ids start again at 0) and ``seg-*.bin`` (int64: for each segment 1 if it
has a doc_id, the doc_id or 0, and the offset).  A file is written under a name of its own and moved in place
when whole, so a task that is run again replaces its own files.

Defined cases: a null or empty text has no ids and no segment; a null doc_id is
carried as null; repeated rows are packed as often as they occur; a very long text is cut
into pieces, none lost; only the id and text columns are read; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sentryflow.staging import new_path, spread, staged

LENGTH = 2048
BLOCK_TOKENS = 1 << 22
#: Packed rows made or read at once.
_ROWS = 256
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern of this public vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts go to the encoder in parts of about so many characters: its list of ids takes some 36 bytes an id.
PART = 1 << 20
#: A space before anything but white space begins a token, so a text may be cut there.
_CUT = re.compile(r" (?=\S)")


class Tokenizer:
    """Texts to arrays of ids.

    Whole texts are encoded at once: where many words are rare, a call a word costs more than a cache of words saves.
    """

    def __init__(self, path: str = VOCABULARY):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.dtype = np.dtype("<u2") if max(ranks.values()) < 1 << 16 else np.dtype("<u4")

    def encode(self, text: str) -> np.ndarray:
        parts, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, at + PART)
            end = cut.start() if cut else len(text)
            ids = self.encoding.encode_ordinary(text[at:end])
            parts.append(np.fromiter(ids, self.dtype, len(ids)))
            at = end
        return np.concatenate(parts) if parts else np.empty(0, self.dtype)

    def decode(self, ids) -> str:
        return self.encoding.decode(list(ids))


@functools.lru_cache(maxsize=1)
def tokenizer(path: str) -> Tokenizer:
    """One a worker process, whatever its number of tasks."""
    return Tokenizer(path)


class Rooms:
    """Segment tree over room sizes 0..length; a leaf counts the open rows with that room."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.tree = [0] * (2 * self.size)
        self.rows: dict[int, list[int]] = {}

    def put(self, room: int, row: int) -> None:
        self.rows.setdefault(room, []).append(row)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of the smallest room of at least ``need``."""
        tree, at = self.tree, need + self.size
        while not tree[at]:
            while at & 1:  # a right child: what lies to its right is under a higher node
                at >>= 1
            if at == 0:
                return None
            at += 1
        while at < self.size:
            at = 2 * at if tree[2 * at] else 2 * at + 1
        room = at - self.size
        self._add(room, -1)
        return room, self.rows[room].pop()

    def _add(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.tree[at] += by
            at >>= 1


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of indexes into ``sizes`` (each 1..length)."""
    rooms, rows = Rooms(length), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = rooms.take(sizes[i])
        if found is None:
            room, row = length, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(i)
        if room > sizes[i]:
            rooms.put(room - sizes[i], row)
    return rows


SCHEMA = "shard int, row_no long, n_tokens int, doc_ids array<long>, doc_offsets array<long>, cu_seqlens array<int>, position_ids array<int>, ids array<int>"


def _blocks(batches, tok: Tokenizer, length: int, block_tokens: int):
    """Blocks of packed rows, each row a list of (doc_id, offset, ids)."""
    pieces: list[tuple[int | None, int, np.ndarray]] = []
    held = 0
    for b in batches:
        for doc, text in zip(b.column(0), b.column(1)):
            ids = tok.encode(text.as_py() or "")
            doc = doc.as_py()
            pieces += [(doc, lo, ids[lo : lo + length]) for lo in range(0, len(ids), length)]
            held += len(ids)
            if held >= block_tokens:
                yield [[pieces[i] for i in row] for row in best_fit_decreasing([len(p[2]) for p in pieces], length)]
                pieces, held = [], 0
    if pieces:
        yield [[pieces[i] for i in row] for row in best_fit_decreasing([len(p[2]) for p in pieces], length)]


def _pack(length: int, block_tokens: int, path: str):
    def run(batches):
        from pyspark import TaskContext

        shard, made = TaskContext.get().partitionId(), 0
        for rows in _blocks(batches, tokenizer(path), length, block_tokens):
            for lo in range(0, len(rows), _ROWS):
                part = rows[lo : lo + _ROWS]
                sizes = [np.array([len(s[2]) for s in row]) for row in part]
                yield _batch(
                    shard,
                    made,
                    np.concatenate([np.concatenate(([0], np.cumsum(n))) for n in sizes]),
                    np.array([len(n) for n in sizes]),
                    [[s[0] for s in row] for row in part],
                    [[s[1] for s in row] for row in part],
                    np.concatenate([np.arange(n) for row in sizes for n in row]),
                    np.concatenate([s[2] for row in part for s in row]),
                )
                made += len(part)

    return run


def _batch(shard: int, first: int, cu, segments, doc_ids, offsets, pos, ids) -> pa.RecordBatch:
    """A batch of packed rows; ``cu`` and ``segments`` give where rows and segments end in ``pos`` and ``ids``."""
    cu_at = np.concatenate(([0], np.cumsum(segments + 1)))
    total = cu[cu_at[1:] - 1]
    ends = pa.array(np.concatenate(([0], np.cumsum(total))), pa.int32())
    n = len(segments)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n, shard, np.int32)),
            pa.array(np.arange(first, first + n, dtype=np.int64)),
            pa.array(total, pa.int32()),
            pa.array(doc_ids, pa.list_(pa.int64())) if isinstance(doc_ids, list) else doc_ids,
            pa.array(offsets, pa.list_(pa.int64())) if isinstance(offsets, list) else offsets,
            pa.ListArray.from_arrays(pa.array(cu_at, pa.int32()), pa.array(cu, pa.int32())),
            pa.ListArray.from_arrays(ends, pa.array(pos, pa.int32())),
            pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32())),
        ],
        names=["shard", "row_no", "n_tokens", "doc_ids", "doc_offsets", "cu_seqlens", "position_ids", "ids"],
    )


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = LENGTH, block_tokens: int = BLOCK_TOKENS, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row a packed row; (shard, row_no) is its key."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return spread(base).mapInArrow(_pack(length, block_tokens, vocabulary), SCHEMA)


MANIFEST = "shard long, rows long, tokens long, length long, id_bytes long, folder string"
_PARTS = ("ids", "rows", "cu", "reset", "seg")


def write_packed(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", *, length: int = LENGTH, pad: int = 0, block_tokens: int = BLOCK_TOKENS, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pack ``docs`` and write the rows as binary files below ``path`` (a shared folder).  Returns the manifest, a row a shard."""
    path = path or new_path(docs.sparkSession, "matrix")

    def run(batches):
        import uuid

        from pyspark import TaskContext

        from sentryflow.llm.files import open_dir

        shard, rows, tokens, own, files = TaskContext.get().partitionId(), 0, 0, uuid.uuid4().hex, None
        fs = root = None
        tok = tokenizer(vocabulary)
        filler = np.full(length, pad, tok.dtype)
        for block in _blocks(batches, tok, length, block_tokens):
            if files is None:
                fs, root = open_dir(path)
                files = {k: fs.open_output_stream(f"{root}/{k}-{shard:05d}.bin.{own}", buffer_size=1 << 20) for k in _PARTS}
            for lo in range(0, len(block), _ROWS):
                part = block[lo : lo + _ROWS]
                cu = [np.cumsum([0, *(len(s[2]) for s in row)]) for row in part]
                tokens += sum(int(c[-1]) for c in cu)
                files["ids"].write(np.concatenate([x for row, c in zip(part, cu) for x in (*(s[2] for s in row), filler[c[-1] :])]).tobytes())
                files["rows"].write(np.array([len(row) for row in part], "<i4").tobytes())
                files["cu"].write(np.concatenate(cu).astype("<i4").tobytes())
                files["reset"].write(np.concatenate([c[:-1] for c in cu]).astype("<i4").tobytes())
                files["seg"].write(np.array([(s[0] is not None, s[0] or 0, s[1]) for row in part for s in row], "<i8").tobytes())
                rows += len(part)
        if files is not None:
            for k, f in files.items():
                f.close()
                fs.move(f"{root}/{k}-{shard:05d}.bin.{own}", f"{root}/{k}-{shard:05d}.bin")
            yield pa.RecordBatch.from_pylist([{"shard": shard, "rows": rows, "tokens": tokens, "length": length, "id_bytes": tok.dtype.itemsize, "folder": path}])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return staged(spread(base).mapInArrow(run, MANIFEST), "matrix_manifest")


def read_matrix(manifest: DataFrame) -> DataFrame:
    """The packed rows of the shards of a manifest, read from their files in parts."""

    def run(batches):
        from sentryflow.llm.files import open_dir

        for b in batches:
            for m in b.to_pylist():
                fs, root = open_dir(m["folder"], create=False)
                width, made, dtype = m["length"], 0, f"<u{m['id_bytes']}"
                files = {k: fs.open_input_stream(f"{root}/{k}-{m['shard']:05d}.bin", compression=None, buffer_size=1 << 20) for k in _PARTS}
                take = lambda k, n, dtype: np.frombuffer(files[k].read(n * np.dtype(dtype).itemsize), dtype)  # noqa: B023, E731
                while made < m["rows"]:
                    n = min(_ROWS, m["rows"] - made)
                    ids, segments = take("ids", n * width, dtype).reshape(n, width), take("rows", n, "<i4").astype(np.int64)
                    total = int(segments.sum())
                    cu, reset, seg = take("cu", total + n, "<i4"), take("reset", total, "<i4"), take("seg", 3 * total, "<i8").reshape(-1, 3)
                    used = cu[np.cumsum(segments + 1) - 1]
                    begin = reset + np.repeat(np.cumsum(used) - used, segments)
                    end = np.append(begin[1:], used.sum())
                    ends = pa.array(np.concatenate(([0], np.cumsum(segments))), pa.int32())
                    yield _batch(
                        m["shard"],
                        made,
                        cu,
                        segments,
                        pa.ListArray.from_arrays(ends, pa.array(seg[:, 1], mask=seg[:, 0] == 0)),
                        pa.ListArray.from_arrays(ends, pa.array(seg[:, 2])),
                        np.arange(end[-1], dtype=np.int32) - np.repeat(begin, end - begin).astype(np.int32),
                        ids[np.arange(width) < used[:, None]].astype(np.int32),
                    )
                    made += n
                for f in files.values():
                    f.close()

    return manifest.repartition(max(1, manifest.count())).mapInArrow(run, SCHEMA)
