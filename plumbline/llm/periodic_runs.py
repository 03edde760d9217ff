"""Periodic runs: maximal stretches of words that repeat with a smallest period at least four times, found tile by tile and stitched.

A run of period q is a stretch of at least ``max(6, 4 q)`` words in which words q apart are equal, whose smallest period is q, and which no
neighbouring word extends.

Method. A document is cut into overlapping tiles, once for all short periods and once for every further octave [s, 2 s) of periods; a
tile of an octave is ``core`` times s words long and shares three of its longest periods with the next one, so each run is whole in a tile or shows at least three
of its periods in each of the tiles that it reaches into. Tiles are solved independently. Within one, boundaries stand every s words; a boundary is the
start of a square of period q if the q words before and after it agree, which the blocks of s words at its ends tell by their
hashes for all q of the octave in one comparison. Squares inside a stretch of a smaller period are no news and go; at most two per boundary
stay. From the outermost boundaries the Z-values to the left and right give the stretch within the tile, compared word by word.
Fragments are shuffled by (document, period), stitched where they touch, and measured there; of equal stretches the smallest period stays.

Scale. Documents that surely fit one tile are solved where they are read. Longer ones are cut into tiles of 4-byte word numbers that are dealt
out by (document, octave, tile), so one huge document occupies many tasks; only numbering its words is one task's work. Only fragments are
shuffled afterwards, few in ordinary text; equal ones (of rows that repeat) are folded in tasks.

Words are ``[^\\x20\\x09-\\x0D]+``, with upper and lower case apart, and compared by 64-bit hashes (by their numbers in long documents).

Defined results: null and empty texts have no words and no runs; the key of a text is its id (or null) and a 64-bit hash of it, so rows
that repeat have the same runs; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.frames import shared, slices, text_bytes
from plumbline.llm.words import SPACED, mix, words_of

#: Periods below are compared shift by shift; the first octave starts here.
FIRST = 8
FRAGMENT = "id long, t long, period long, start long, stop long"
_TILE = "id long, t long, low long, high long, start long, closed boolean, words binary"


@dataclass(frozen=True)
class Tiling:
    """Words of a tile of the short periods; these are below ``short``, a power of two; a tile of an octave [s, 2 s) has ``core`` times s words."""

    words: int = 16_384
    short: int = 512
    core: int = 32


def needed(period):
    """Number of equal pairs in a row that make a run."""
    return np.maximum(6 - period, 3 * period)


def _true_runs(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(np.concatenate([[0], equal.view(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _z_left(w: np.ndarray, at: int, period: int, least: int, step: int) -> int:
    """Start of the equal pairs that end at ``at``, not before ``least``."""
    while at > least:
        low = max(at - step, least)
        odd = np.flatnonzero(w[low:at] != w[low + period : at + period])
        if len(odd):
            return low + int(odd[-1]) + 1
        at = low
    return at


def _z_right(w: np.ndarray, at: int, period: int, most: int, step: int) -> int:
    """End of the equal pairs that start at ``at``, not beyond ``most``."""
    while at < most:
        high = min(at + step, most)
        odd = np.flatnonzero(w[at:high] != w[at + period : high + period])
        if len(odd):
            return at + int(odd[0])
        at = high
    return at


def solve(w: np.ndarray, first: np.ndarray, low: int = 1, high: int = 1 << 62, open_left: bool = False, open_right: bool = False) -> np.ndarray:
    """Rows (period, start, stop): stretches of equal pairs w[i] == w[i + period], start <= i < stop, within the texts that
    begin at ``first`` (with the end appended), for periods in [low, high). Those that are too short for a run are left out unless they touch an open end.
    """
    sizes = np.diff(first)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    longest = int(sizes.max(initial=0))
    found: list[np.ndarray] = []
    known: list[np.ndarray] = []  # word intervals with a smaller period

    def keep(q: int | np.ndarray, start: np.ndarray, stop: np.ndarray) -> None:
        enough = (stop - start) >= needed(q)
        period = np.broadcast_to(np.asarray(q, np.int64), start.shape)
        known.append(np.stack([start, stop + period], 1)[stop - start >= 3 * period])
        enough |= (open_left & (start == 0)) | (open_right & (stop + period == len(w)))
        enough &= (period >= low) & (period < high)
        found.append(np.stack([period, start, stop], 1)[enough])

    for q in range(1, min(FIRST, high, len(w))):
        start, stop = _true_runs((w[q:] == w[:-q]) & (doc[q:] == doc[:-q]))
        keep(q, start, stop)
    hashes, s = w, 1
    while 4 * s <= longest and s < high:
        if s >= FIRST:
            chains = _squares(w, first, doc, hashes, s, np.concatenate(known))
            if chains:
                keep(*np.array(chains, np.int64).T)
        hashes = mix(hashes[:-s] * np.uint64(0x9E3779B97F4A7C15) + hashes[s:])
        s *= 2
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def _squares(w, first, doc, hashes, s: int, known: np.ndarray) -> list[tuple[int, int, int]]:
    """(period, start, stop) of the stretches around boundaries that start a square with a period in [s, 2 s)."""
    m = len(hashes) // s
    if m < 2:
        return []
    blocks = hashes[: m * s].reshape(m, s)
    row, column = np.nonzero(blocks[1:] == blocks[:-1, :1])
    b, q = row * s, column + s
    inside = b + 2 * q <= len(w)
    b, q = b[inside], q[inside]
    square = (hashes[b + q - s] == hashes[b + 2 * q - s]) & (doc[b] == doc[b + 2 * q - 1])
    b, q = b[square], q[square]
    if len(known) and len(b):
        known = known[np.argsort(known[:, 0], kind="stable")]
        reach = np.maximum.accumulate(known[:, 1])
        before = np.searchsorted(known[:, 0], b, "right") - 1
        news = (before < 0) | (reach[np.maximum(before, 0)] < b + 2 * q)
        b, q = b[news], q[news]
    if not len(b):
        return []
    order = np.lexsort((b, q))
    b, q = b[order], q[order]
    heads = np.flatnonzero(np.concatenate([[True], (np.diff(q) != 0) | (np.diff(b) != s)]))
    tails = np.concatenate([heads[1:], [len(b)]]) - 1
    out = []
    for head, tail in zip(heads.tolist(), tails.tolist(), strict=True):
        period, left, right = int(q[head]), int(b[head]), int(b[tail])
        text = doc[left]
        start = _z_left(w, left, period, int(first[text]), s)
        stop = _z_right(w, left, period, int(first[text + 1]) - period, max(s, right + period - left))  # from the first square on, word by word
        if stop > start:
            out.append((period, start, stop))
    return out


def _fragments(id_: pa.Array, t: pa.Array, rows: np.ndarray, text: np.ndarray, shift: np.ndarray) -> pa.RecordBatch:
    take = pa.array(text)
    return pa.RecordBatch.from_arrays(
        [id_.take(take), t.take(take), pa.array(rows[:, 0]), pa.array(rows[:, 1] + shift), pa.array(rows[:, 2] + shift)],
        names=["id", "t", "period", "start", "stop"])


def _solve_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            words = words_of(*text_bytes(part.column("text")), SPACED, fold=False)
            rows = solve(words.hashes, words.first)
            text = np.searchsorted(words.first, rows[:, 1], "right") - 1
            yield _fragments(part.column("id"), part.column("t"), rows, text, -words.first[text])


def tiles_of(n: int, tiling: Tiling) -> Iterator[tuple[int, int, int, int]]:
    """(low, high, start, stop) of the tiles of a text of ``n`` words."""
    low, high = 1, tiling.short
    while low == 1 or 4 * low <= n:
        core, common = (tiling.words if low == 1 else max(tiling.words, tiling.core * low)), 3 * high
        if n <= core + common:  # one tile for this and all longer periods
            yield low, 1 << 62, 0, n
            return
        for start in range(0, n - common, core):
            yield low, high, start, min(n, start + core + common)
        low, high = high, 2 * high


def _cutter(tiling: Tiling):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                words = words_of(*text_bytes(part.column("text")), SPACED, fold=False)
                numbers = np.unique(words.hashes, return_inverse=True)[1].astype(np.int32)
                for low, high, start, stop in tiles_of(len(numbers), tiling):
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id"), part.column("t"), pa.array([low]), pa.array([high]), pa.array([start]), pa.array([stop == len(numbers)]),
                         pa.array([numbers[start:stop].tobytes()], pa.binary())],
                        names=["id", "t", "low", "high", "start", "closed", "words"])

    return cut


def _solve_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            part = batch.slice(i, 1)
            low, high, start, closed, words = (part.column(c)[0].as_py() for c in ("low", "high", "start", "closed", "words"))
            w = mix(np.frombuffer(words, np.int32).astype(np.uint64) + np.uint64(1))
            rows = solve(w, np.array([0, len(w)]), low, high, start > 0, not closed)
            yield _fragments(part.column("id"), part.column("t"), rows, np.zeros(len(rows), np.int64), np.full(len(rows), start))


def fragments(texts: DataFrame, tiling: Tiling = Tiling()) -> DataFrame:
    """Stretches of equal pairs of each text (id, t, text), as far as their tiles show them."""
    fits = F.length("text") <= 2 * tiling.words  # every word but the last is followed by white space
    tiles = texts.where(~fits).mapInArrow(_cutter(tiling), _TILE).repartition(shared(texts.sparkSession), "id", "t", "low", "start")
    return texts.where(fits).mapInArrow(_solve_texts, FRAGMENT).unionAll(tiles.mapInArrow(_solve_tiles, FRAGMENT))


def stitched(parts: DataFrame) -> DataFrame:
    """(id, t, start, length, period): runs, from fragments that meet or overlap within (text, period)."""
    key = ["id", "t", "period"]
    distinct = parts.groupBy(*key, "start").agg(F.max("stop").alias("stop"))
    by = Window.partitionBy(*key).orderBy("start")
    before = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    opens = distinct.withColumn("before", before).withColumn("island", F.sum(
        F.when(F.col("before").isNull() | (F.col("start") > F.col("before")), 1).otherwise(0)).over(by))
    whole = opens.groupBy(*key, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    runs = whole.select("id", "t", "period", "start", (F.col("stop") - F.col("start") + F.col("period")).alias("length"))
    return runs.where("length >= greatest(6, 4 * period)").groupBy("id", "t", "start", "length").agg(F.min("period").alias("period"))


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(docs[id_col].cast("long").alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))


def periodic_runs(docs: DataFrame, tiling: Tiling = Tiling(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All runs of all texts; ``t`` is a hash of the text, ``start`` and ``length`` count words."""
    return stitched(fragments(keyed_texts(docs, id_col, text_col), tiling))


def run_summary(runs: DataFrame) -> DataFrame:
    """One row per text with runs: number, the list, the run of greatest exact length / period, and the words that repeat an earlier period.

    ``flags`` has a byte per word up to the end of the last run: 1 for a word that stays, 0 for a word that some run contains after its first period.
    The list of a text is bounded by the text.
    """
    by = Window.partitionBy("id", "t").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    marked = runs.select("*", (F.col("start") + F.col("period")).alias("first"), (F.col("start") + F.col("length")).alias("last")).withColumn(
        "before", F.coalesce(F.max("last").over(by), F.lit(0).cast("long")))
    stay = F.greatest(F.lit(0), F.col("first") - F.col("before")).cast("int")
    go = F.greatest(F.lit(0), F.col("last") - F.greatest("before", "first")).cast("int")
    whole, rest = F.expr("length div period"), F.expr("(cast(length % period as decimal(20, 0)) * 1000000000000000000) div period")
    best = F.struct(whole.alias("whole"), rest.alias("rest"), (-F.col("start")).alias("start"), (-F.col("period")).alias("period"), "length")
    flags = F.struct("first", "last", F.concat(F.call_function("repeat", F.lit("1"), stay), F.call_function("repeat", F.lit("0"), go)).alias("bits"))
    listed = marked.groupBy("id", "t").agg(
        F.count("*").alias("n_runs"), F.max(best).alias("best"),
        F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"), F.sort_array(F.collect_list(flags)).alias("flags"))
    return listed.select(
        "id", "t", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"), "runs",
        F.array_join(F.transform("flags", lambda f: f["bits"]), "").cast("binary").alias("flags"))


def _words() -> Column:
    """Words of the column ``text``; one empty word if there is none."""
    return F.split(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+")


def with_runs(docs: DataFrame, tiling: Tiling = Tiling(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_runs, start, length, period, runs, collapsed): each row of ``docs`` with its runs and its text without repeated periods.

    The collapsed text is the words that stay, joined by single spaces.
    """
    texts = keyed_texts(docs, id_col, text_col)
    summary = run_summary(stitched(fragments(texts, tiling))).withColumnRenamed("id", "run_id").withColumnRenamed("t", "run_t")
    met = texts.join(summary, F.col("id").eqNullSafe(F.col("run_id")) & (F.col("t") == F.col("run_t")), "left")
    words = _words()
    kept = F.filter(words, lambda _, i: (i >= F.length("flags")) | (F.substring(F.col("flags"), i + 1, F.lit(1)) == F.lit(b"1")))
    return met.select("id", "text", F.coalesce("n_runs", F.lit(0).cast("long")).alias("n_runs"), "start", "length", "period", "runs",
                      F.array_join(F.when(F.col("flags").isNull(), words).otherwise(kept), " ").alias("collapsed"))


def looped(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, by a checksum h of the id, get a periodic tail.

    With g = h div 10 and n words, word i from a = g % n on becomes word a + (i - a) % p, p = 1 + (n - a) div (3 + g % 8).
    """
    text = docs["text"].cast("string")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.crc32(docs["doc_id"].cast("string")).alias("h"))
    rows = rows.select("doc_id", "text", F.expr("h div 10").alias("g"), (F.col("h") % 10 == 0).alias("chosen"))
    words = _words()
    n = F.size(words).cast("long")
    a = F.col("g") % n
    p = F.call_function("div", n - a, 3 + F.col("g") % 8) + 1
    head, loop = F.slice(words, F.lit(1), a.cast("int")), F.slice(words, (a + 1).cast("int"), p.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(loop, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    loops = F.col("chosen") & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return rows.select("doc_id", F.when(loops, F.array_join(F.concat(head, tail), " ")).otherwise(F.col("text")).alias("text"))


def looped_runs(docs: DataFrame, tiling: Tiling = Tiling()) -> DataFrame:
    """One row per document after ``looped``: number of runs, the best one, and digests of all runs and of the collapsed text."""
    listed = F.array_join(F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return with_runs(looped(docs), tiling).select(
        F.col("id").alias("doc_id"), "n_runs", "start", "length", "period", F.expr("(1000 * length) div period").alias("exponent_milli"),
        F.sha2(F.coalesce(listed, F.lit("")).cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
