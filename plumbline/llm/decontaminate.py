"""Benchmark decontamination: a hash set of the benchmark's word windows, scanned over all training text.

Method: the benchmark (small next to the corpus, its size is checked) is cut into windows of consecutive words. Their
64-bit hashes go to every task as one sorted array. A task hashes the windows of its documents with numpy, looks them
up, and compares the words of every hit with the words of the benchmark window, so that a hash collision cannot count.
No shuffle; each document is read once, whole.

A benchmark of more than ``MAX_WINDOWS`` windows is cut into parts by a hash of the window and the documents are scanned once for each part, so what
a task holds has a bound whatever the size of the benchmark. The hits of a text in the parts, keyed by 128 bits of the text, are merged: places are
united and items are listed once.

Words: A-Z are lower-cased; a word is a run of digits, letters and non-ASCII characters (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``).

Defined results: null or empty text has no words and no hits; repeated rows give repeated result rows; an empty
benchmark hits nothing; benchmark rows with null text or without words have no windows; item ids that repeat count once
(null ids as the string ``null``); columns of other names are ignored (``scan``) or kept (``remove``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.frames import slices, text_bytes, written
from plumbline.llm.words import ALNUM, _LOWER, Words, windows_of, words_of

WINDOW = 13
#: Most windows that are sent to every task at once; a larger benchmark is scanned in parts.
MAX_WINDOWS = 400_000
#: A document is contaminated when hit words are at least one in so many of its words.
SHARE = 20

_FIELDS = "id long, n_words long, n_hit long, items array<string>, spans array<struct<start:int,stop:int,first:int,last:int>>"


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(hash, item, words): one row per distinct window of each item; words joined by one space."""
    rows = benchmark.select(benchmark[item_col].cast("string").alias("item"), benchmark[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                raw, offsets = text_bytes(part.column("text"))
                words = words_of(raw, offsets, ALNUM)
                hashes, heads = windows_of(words, window)
                text = np.searchsorted(words.first, heads, "right") - 1
                low = _LOWER[raw].tobytes()
                items = part.column("item").to_pylist()
                found = {(int(h), items[d], _joined(low, words, i, min(i + window, int(words.first[d + 1]))))
                         for h, i, d in zip(hashes.view(np.int64), heads, text, strict=True)}
                yield pa.RecordBatch.from_pydict(
                    {"hash": [x[0] for x in found], "item": [x[1] for x in found], "words": [x[2] for x in found]},
                    pa.schema([("hash", pa.int64()), ("item", pa.string()), ("words", pa.binary())]))

    return rows.mapInArrow(run, "hash long, item string, words binary")


def _joined(low: bytes, words: Words, first: int, last: int) -> bytes:
    return b" ".join(low[words.starts[i] : words.ends[i]] for i in range(first, last))


class WindowSet:
    """Sorted hashes of the benchmark's windows with a bit table in front of them."""

    def __init__(self, rows: list) -> None:
        self.owners: dict[int, dict[bytes, list[str]]] = {}
        for h, item, words in rows:
            self.owners.setdefault(h & (2**64 - 1), {}).setdefault(bytes(words), []).append("null" if item is None else item)
        self.hashes = np.array(sorted(self.owners), np.uint64)
        self.sizes = sorted({bytes(words).count(b" ") + 1 for _, _, words in rows})
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self.hashes & np.uint64((1 << 22) - 1)] = True

    def candidates(self, hashes: np.ndarray) -> np.ndarray:
        """Positions whose hash is in the set."""
        maybe = np.flatnonzero(self.bits[hashes & np.uint64((1 << 22) - 1)])
        if not len(maybe) or not len(self.hashes):
            return maybe[:0]
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        return maybe[self.hashes[at] == hashes[maybe]]


def _parts(benchmark: DataFrame, window: int) -> list:
    """Window sets on every executor, each of ``MAX_WINDOWS`` windows or little more; the windows of equal hash share a part."""
    rows = written(benchmark_windows(benchmark, window=window), "windows")
    n = max(1, -(-rows.count() // MAX_WINDOWS))
    part = F.pmod(F.xxhash64("hash"), F.lit(n))
    sets = (rows.where(part == i).collect() for i in range(n))
    return [benchmark.sparkSession.sparkContext.broadcast(WindowSet([(r["hash"], r["item"], r["words"]) for r in own])) for own in sets]


def _scan_slice(part: pa.RecordBatch, known: WindowSet, window: int) -> dict[str, list]:
    raw, offsets = text_bytes(part.column("text"))
    words = words_of(raw, offsets, ALNUM)
    counts = np.diff(words.first)
    # A window of all words of a shorter item may stand anywhere in a text, so every such length is tried too.
    hits: dict[int, list[tuple[int, int, list[str]]]] = {}
    low = None
    for size in known.sizes:
        hashes, heads = windows_of(words, size)
        for c in known.candidates(hashes):
            first = int(heads[c])
            d = int(np.searchsorted(words.first, first, "right")) - 1
            last = min(first + size, int(words.first[d + 1]))
            low = low or _LOWER[raw].tobytes()
            owners = known.owners[int(hashes[c])].get(_joined(low, words, first, last))
            if owners:
                hits.setdefault(d, []).append((first, last, owners))
    n_hit, items, spans = np.zeros(len(counts), np.int64), [], []
    for d in range(len(counts)):
        merged = _united([(first, last) for first, last, _ in hits.get(d, ())])
        n_hit[d] = sum(b - a for a, b in merged)
        items.append(sorted({o for _, _, owners in hits.get(d, ()) for o in owners}))
        base = offsets[d]
        spans.append([{"start": int(words.starts[a] - base), "stop": int(words.ends[b - 1] - base), "first": a - int(words.first[d]), "last": b - int(words.first[d])}
                      for a, b in merged])
    return {"id": part.column("id").to_pylist(), "n_words": counts.tolist(), "n_hit": n_hit.tolist(), "items": items, "spans": spans}


def _united(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that meet or overlap as one."""
    merged: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if merged and first <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(last, merged[-1][1]))
        else:
            merged.append((first, last))
    return merged


def _scanned(rows: DataFrame, sent, window: int) -> DataFrame:
    """``rows(id, text, ...)`` scanned for one part; the columns after the first two are kept."""
    schema = pa.schema([
        ("id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("first", pa.int32()), ("last", pa.int32())])))])
    more = rows.columns[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = pa.RecordBatch.from_pydict(_scan_slice(part, sent.value, window), schema)
                yield pa.RecordBatch.from_arrays([*found.columns, *[part.column(c) for c in more]], names=[*schema.names, *more])

    return rows.mapInArrow(run, _FIELDS + "".join(f", {c} long" for c in more))


def _merged(found: DataFrame) -> DataFrame:
    """One row per text with hits in some part: ``h1, h2, n_words, n_hit, items, spans``. What is gathered is the hits of one text."""
    hits = found.where("n_hit > 0").groupBy("h1", "h2").agg(
        F.max("n_words").alias("n_words"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.flatten(F.collect_set("spans")).alias("spans"))
    kinds = hits.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_hit, spans = [], []
            for own in batch.column("spans").to_pylist():
                starts, stops = {s["first"]: s["start"] for s in own}, {s["last"]: s["stop"] for s in own}
                ranges = _united([(s["first"], s["last"]) for s in own])
                n_hit.append(sum(b - a for a, b in ranges))
                spans.append([{"start": starts[a], "stop": stops[b], "first": a, "last": b} for a, b in ranges])
            at = batch.schema.get_field_index("spans")
            columns = [pa.array(spans, c.type) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_hit, pa.int64())], names=[*batch.schema.names, "n_hit"])

    return hits.mapInArrow(run, type(kinds)([*kinds]).add("n_hit", "long"))


def _text_key(text: F.Column) -> list:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("text"), text).alias("h2")]


def scan(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document: ``id, n_words, n_hit, items`` (sorted) and ``spans`` that are hit (byte ranges of the UTF-8 text, word ranges)."""
    text = documents[text_col].cast("string")
    rows = documents.select(documents[id_col].cast("long").alias("id"), text.alias("text"))
    sets = _parts(benchmark, window)
    if len(sets) == 1:
        return _scanned(rows, sets[0], window)
    keyed = rows.select("id", "text", *_text_key(F.col("text")))
    first = _scanned(keyed, sets[0], window)
    found = first.drop("id")
    for sent in sets[1:]:
        found = found.unionByName(_scanned(keyed, sent, window).drop("id"))
    hits = written(_merged(found), "hits")
    counts = _scanned(keyed, benchmark.sparkSession.sparkContext.broadcast(WindowSet([])), window).select("id", "n_words", "h1", "h2")
    none = F.array().cast("array<string>"), F.array().cast(hits.schema["spans"].dataType)
    return counts.join(hits.drop("n_words"), ["h1", "h2"], "left").select(
        "id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none[0]).alias("items"), F.coalesce("spans", none[1]).alias("spans"))


def contaminated(n_hit: F.Column | str = "n_hit", n_words: F.Column | str = "n_words", share: int = SHARE):
    hit, words = (F.col(c) if isinstance(c, str) else c for c in (n_hit, n_words))
    return (hit > 0) & (hit * share >= words)


def remove(documents: DataFrame, benchmark: DataFrame, mode: str = "document", id_col: str = "doc_id", text_col: str = "text",
           window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """The documents without contamination, all their columns kept.

    ``document`` drops contaminated documents; ``span`` cuts the hit words out of them (joined by one space).
    """
    if mode not in ("document", "span"):
        raise ValueError(f"unknown mode '{mode}'")
    sets = _parts(benchmark, window)
    if len(sets) > 1:
        return _remove_in_parts(documents, sets, mode, text_col, window, share)
    sent = sets[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column(text_col)
                keyed = pa.RecordBatch.from_arrays([pa.nulls(part.num_rows, pa.int64()), texts], ["id", "text"])
                got = _scan_slice(keyed, sent.value, window)
                bad = [h > 0 and share * h >= n for h, n in zip(got["n_hit"], got["n_words"], strict=True)]
                if mode == "document":
                    yield part.filter(pa.array([not b for b in bad], pa.bool_()))
                    continue
                new = [_without(t, s) if b else t for t, s, b in zip(texts.to_pylist(), got["spans"], bad, strict=True)]
                at = part.schema.get_field_index(text_col)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(new, texts.type) if i == at else part.column(i) for i in range(part.num_columns)], schema=part.schema)

    return documents.mapInArrow(run, documents.schema)


def _remove_in_parts(documents: DataFrame, sets: list, mode: str, text_col: str, window: int, share: int) -> DataFrame:
    """The same for a benchmark in parts: the hits of all parts are merged by text before a text is judged."""
    text = documents[text_col].cast("string")
    keyed = documents.select(F.lit(None).cast("long").alias("id"), text.alias("text"), *_text_key(text))
    found = _scanned(keyed, sets[0], window).drop("id")
    for sent in sets[1:]:
        found = found.unionByName(_scanned(keyed, sent, window).drop("id"))
    bad = written(_merged(found).where(contaminated(share=share)).select(F.col("h1").alias("bad 1"), F.col("h2").alias("bad 2"), F.col("spans").alias("bad spans")), "hits")
    own = [F.xxhash64(text) == F.col("bad 1"), F.xxhash64(F.lit("text"), text) == F.col("bad 2")]
    if mode == "document":
        return documents.join(bad, own, "left_anti")
    cleaned = F.pandas_udf(lambda t, spans: t.combine(spans, lambda x, s: x if s is None else _without(x, s)), "string")
    kept = F.when(F.col("bad spans").isNull(), text).otherwise(cleaned(text, F.col("bad spans")))
    return documents.join(bad, own, "left").select(*[kept.alias(c) if c == text_col else documents[f"`{c}`"] for c in documents.columns])


def _without(text: str, spans: list[dict]) -> str:
    raw, kept, at = text.encode(), [], 0
    for s in spans:
        kept.append(raw[at : s["start"]].strip())
        at = s["stop"]
    kept.append(raw[at:].strip())
    return b" ".join(k for k in kept if k).decode()


def decontamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The scan in digest form: counts, number of items, sha256 of the item list, and the verdict."""
    found = scan(documents, benchmark)
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )
