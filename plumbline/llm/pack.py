"""Packing of documents into sequences of a fixed window by non-negative least squares over length combinations.

Method: every document is encoded, and an end id appended. Whole windows of it are sequences of their own. The rest, shorter
than a window, falls into a histogram of lengths (its size is the window, whatever the corpus). All combinations of up to
three lengths that fill the window exactly are enumerated; non-negative least squares gives the number of times to use each so
that the histogram is met; the numbers are rounded so that running totals stay right. Documents left over are packed
greedily, longest first, by counts per length; what still fills a window badly is laid end to end and cut at window borders,
so only the last sequence of all is padded.

Documents of one length are interchangeable in the plan: the document of rank r among them takes the r-th place for its
length. Ranks come from counts per (task, length), so no length, however frequent, is gathered in one task.

Defined results: null or empty text is a document of its end id only; repeated rows are documents of their own; an empty
table has no pieces; columns of other names are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.frames import slices, written
from plumbline.llm.tokens import default_vocabulary, encoder

WINDOW = 1024
#: A greedily packed sequence is accepted from this share of the window; shorter ones are cut to fit instead.
LEAST_FILL = 0.98

_PART = "id long, doc_tokens long, size int, part int, nth long, start long, crcs array<long>, ids binary"
PIECES = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encoded_parts(documents: DataFrame, id_col: str, text_col: str, window: int, vocabulary: str, end_id: int) -> DataFrame:
    """Rows of each document: its whole windows (``size`` 0, one checksum each), and its rest (``size`` ids, the ids themselves).

    ``nth`` counts, within the task, the whole windows or the rests of that size before this row.
    """
    rows = documents.select(documents[id_col].cast("long").alias("id"), documents[text_col].cast("string").alias("text"))
    end, step = np.array([end_id], "<u4").tobytes(), 4 * window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), [0] * window
        for batch in batches:
            for piece in slices(batch):
                out: list[tuple] = []
                for doc, ids in zip(piece.column("id").to_pylist(), encoder(vocabulary).encode(piece.column("text").to_pylist()), strict=True):
                    ids += end
                    n = len(ids) // 4
                    whole, rest = divmod(n, window)
                    if whole:
                        crcs = [zlib.crc32(ids[at : at + step]) for at in range(0, whole * step, step)]
                        out.append((doc, n, 0, part, seen[0], 0, crcs, None))
                        seen[0] += whole
                    if rest:
                        tail = ids[whole * step :]
                        out.append((doc, n, rest, part, seen[rest], whole * window, [zlib.crc32(tail)], _narrow(tail)))
                        seen[rest] += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in out], kind) for k, kind in enumerate(
                        (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()))],
                    names=["id", "doc_tokens", "size", "part", "nth", "start", "crcs", "ids"])

    return rows.mapInArrow(run, _PART)


def _narrow(ids: bytes) -> bytes:
    """Two bytes an id where they suffice, told apart from four by a leading mark."""
    wide = np.frombuffer(ids, "<u4")
    return b"2" + wide.astype("<u2").tobytes() if not len(wide) or wide.max() < 65536 else b"4" + ids


def _wide(stored: bytes) -> bytes:
    return np.frombuffer(stored[1:], "<u2").astype("<u4").tobytes() if stored[:1] == b"2" else stored[1:]


def combinations(window: int) -> np.ndarray:
    """All ways to fill the window with one to three lengths below it; zeros fill up a row, lengths descend."""
    rows = []
    for a in range(1, window):
        b = np.arange((window - a + 1) // 2, min(a, window - a) + 1)
        if len(b):
            rows.append(np.stack([np.full(len(b), a), b, window - a - b], 1))
    return np.concatenate(rows)


def least_squares(combos: np.ndarray, histogram: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that bring the lengths used close to the histogram, by multiplicative updates.

    The normal equations' matrix is never formed: both products are gathers over the combinations' lengths.
    """
    use = (combos > 0).astype(float)
    goal = (histogram[combos] * use).sum(1)
    x = np.where((histogram[combos] > 0) | (combos == 0), 1.0, 0.0).min(1) * goal
    flat = combos.ravel()
    for _ in range(rounds):
        made = np.bincount(flat, (x[:, None] * use).ravel(), len(histogram))
        back = (made[combos] * use).sum(1)
        x *= np.divide(goal, back, out=np.zeros_like(goal), where=back > 0)
    return x


@dataclass
class Plan:
    """Places by length: a document of rank r of a length stands in the place whose ``first`` is the last one <= r."""

    window: int
    first: dict[int, list[int]] = field(default_factory=dict)
    sequence: dict[int, list[int]] = field(default_factory=dict)
    offset: dict[int, list[int]] = field(default_factory=dict)
    loose: dict[int, tuple[int, int]] = field(default_factory=dict)  # length -> (rank, position) where the end-to-end part begins
    sequences: int = 0
    loose_base: int = 0

    def use(self, lengths: list[int], times: int, taken: np.ndarray) -> None:
        at = 0
        for n in lengths:
            self.first.setdefault(n, []).append(int(taken[n]))
            self.sequence.setdefault(n, []).append(self.sequences)
            self.offset.setdefault(n, []).append(at)
            taken[n] += times
            at += n
        self.sequences += times


def plan(histogram: np.ndarray, window: int) -> Plan:
    """Places for ``histogram[n]`` documents of each length n below the window."""
    out, taken = Plan(window), np.zeros(window, np.int64)
    combos = combinations(window)
    wanted = least_squares(combos, histogram.astype(float))
    steps = np.diff(np.floor(np.cumsum(wanted) + 0.5), prepend=0).astype(np.int64)
    for i in np.flatnonzero(steps):
        lengths = [int(n) for n in combos[i] if n]
        out_of = {n: lengths.count(n) for n in set(lengths)}
        times = min(int(steps[i]), *[int(histogram[n] - taken[n]) // k for n, k in out_of.items()])
        if times > 0:
            out.use(lengths, times, taken)
    left = histogram - taken
    loose = np.zeros(window, np.int64)
    for n in range(window - 1, 0, -1):
        while left[n] > 0:
            lengths, room, used = [n], window - n, {n: 1}
            for m in range(n, 0, -1):
                while m <= room and left[m] > used.get(m, 0):
                    lengths.append(m)
                    used[m] = used.get(m, 0) + 1
                    room -= m
            if window - room < LEAST_FILL * window:
                loose[n] += left[n]
                left[n] = 0
                break
            times = min(int(left[m]) // k for m, k in used.items())
            out.use(lengths, times, taken)
            for m, k in used.items():
                left[m] -= times * k
    at = 0
    for n in range(window - 1, 0, -1):
        if loose[n]:
            out.loose[n] = (int(taken[n]), at)
            at += n * int(loose[n])
    out.loose_base = out.sequences
    out.sequences += -(-at // window)
    return out


def pack(documents: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
         end_id: int = 0) -> DataFrame:
    """One row per piece: ``id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    spark = documents.sparkSession
    parts = written(encoded_parts(documents, id_col, text_col, window, vocabulary or default_vocabulary(), end_id), "pack-parts")
    counts = parts.groupBy("part", "size").agg(F.sum(F.when(F.col("size") == 0, F.size("crcs")).otherwise(1)).cast("long").alias("n"))
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "size", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = np.zeros(window, np.int64)
    for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect():
        histogram[r["size"]] = r["n"]
    histogram[0] = 0
    sent = spark.sparkContext.broadcast(plan(histogram, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("id", "doc_tokens", "size", "rank", "start", "crcs", "ids")), strict=True)
            out = [p for r in rows for p in _places(sent.value, *r)]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in range(7)],
                                             names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    ranked = parts.join(bases, ["part", "size"]).select("id", "doc_tokens", "size", (F.col("nth") + F.col("base")).alias("rank"), "start", "crcs", "ids")
    return ranked.mapInArrow(run, PIECES)


def _places(p: Plan, doc, doc_tokens: int, size: int, rank: int, start: int, crcs: list[int], ids: bytes | None) -> Iterator[tuple]:
    if size == 0:
        for k, crc in enumerate(crcs):
            yield doc, k * p.window, p.window, crc, doc_tokens, p.sequences + rank + k, 0
        return
    begin, position = p.loose.get(size, (rank + 1, 0))
    if rank < begin:
        at = int(np.searchsorted(p.first[size], rank, "right")) - 1
        yield doc, start, size, crcs[0], doc_tokens, p.sequence[size][at] + rank - p.first[size][at], p.offset[size][at]
        return
    position += (rank - begin) * size
    wide, done = _wide(ids), 0
    while done < size:
        sequence, offset = divmod(position + done, p.window)
        length = min(size - done, p.window - offset)
        yield (doc, start + done, length, zlib.crc32(wide[4 * done : 4 * (done + length)]), doc_tokens, p.loose_base + sequence, offset)
        done += length
