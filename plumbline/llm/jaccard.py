"""N-gram Jaccard join: a grouped prefix join over the word shingles of whole texts, and the components of its links.

Method. A document is the set of its distinct shingles (64-bit hashes), put in one global order: shingles of rare count
buckets first. Two sets as similar as asked share a shingle among their first ``n - ceil(t * n) + 1``. Documents with
equal sets are one class; classes with the same size and prefix are one group, and only groups go into the inverted
lists. Groups that meet in a list are filtered by size, expanded to their members, filtered by a lower bound of the
symmetric difference (a histogram of the set in 256 cells), and what is left is verified on the shingles themselves.

Large lists. Pairs are not made where they can add nothing. First each group is verified against two others only: the one
before it in order of size and the one in the middle (whose prefix is shared most), of all lists the one it meets most
often; and against the leader of its own group. The components of those links are
computed; after that only members of different components that meet in a list are compared, in blocks of bounded size.
A crowd of near copies is one component by then, so its pairs are never formed, and no link between components is lost.

Defined results: null or empty text, or text without words, is an empty set, linked with nothing; fewer words than a
shingle are one shingle of all words; repeated rows are one class; rows that repeat an id with other text share their
links; a null id takes no part and has a null component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.components import components
from plumbline.llm.frames import keyed_text, make_room, slices, text_bytes, written
from plumbline.llm.words import SPACED, mix, windows_of, words_of

SHINGLE = 3
PERCENT = 90
BUCKET_BITS = 18
#: Bits of the filter in front of a join with texts; at most 2**FILTER_BITS / 64 rows are broadcast.
FILTER_BITS = 23
CELLS = 256
#: Rows of one inverted list that a task compares at once; longer lists are compared block by block.
BLOCK = 512
#: Pairs that a comparing task remembers having sent, 16 bytes each.
REMEMBERED = 1 << 18


def _shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, and the borders between texts."""
    raw, offsets = text_bytes(column)
    words = words_of(raw, offsets, SPACED)
    hashes, heads = windows_of(words, size)
    doc = np.searchsorted(words.first, heads, "right") - 1
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    if len(hashes):
        keep = np.append(True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1]))
        hashes, doc = hashes[keep], doc[keep]
    return hashes, np.searchsorted(doc, np.arange(len(column) + 1))


def bucket_counts(texts: DataFrame, size: int, bits: int) -> np.ndarray:
    """How many shingles of all texts fall in each of ``2**bits`` hash buckets: a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for part in slices(batch):
                hashes, _ = _shingles(part.column(0), size)
                total += np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(1 << bits, np.int64)
    for r in texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["bucket"]] = r["n"]
    return out


def features(docs: DataFrame, size: int, percent: int, bits: int) -> DataFrame:
    """(id, n, s1, s2, prefix, cells): set size, two sums that identify the set, its prefix and its histogram."""
    counts = docs.sparkSession.sparkContext.broadcast(bucket_counts(docs.select("text"), size, bits))
    schema = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("s1", pa.int64()), ("s2", pa.int64()),
                        ("prefix", pa.list_(pa.int64())), ("cells", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for batch in batches:
            for part in slices(batch):
                hashes, first = _shingles(part.column("text"), size)
                n = np.diff(first)
                doc = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((hashes, counts.value[(hashes >> np.uint64(64 - bits)).astype(np.int64)], doc))
                rank = np.arange(len(hashes)) - first[doc]
                long = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
                prefix = hashes[order][rank < long[doc]].view(np.int64)
                sums = [np.zeros(len(n), np.uint64) for _ in range(2)]
                for s, salt in zip(sums, (0x1234567, 0x89ABCDEF), strict=True):
                    np.add.at(s, doc, mix(hashes ^ np.uint64(salt)))
                cells = np.minimum(np.bincount(doc * CELLS + (hashes & np.uint64(CELLS - 1)).astype(np.int64), minlength=len(n) * CELLS), 255)
                raw = cells.astype(np.uint8).tobytes()
                ends = np.concatenate([[0], np.cumsum(long)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(n, pa.int32()), *[pa.array(s.view(np.int64)) for s in sums],
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(prefix)),
                     pa.array([raw[i * CELLS : (i + 1) * CELLS] for i in range(len(n))], pa.binary())], schema=schema)

    return docs.mapInArrow(run, "id long, n int, s1 long, s2 long, prefix array<long>, cells binary")


def _far(na: np.ndarray, nb: np.ndarray, gap: np.ndarray, percent: int) -> np.ndarray:
    """True where a symmetric difference of ``gap`` or more rules the link out: 100 * (na + nb - gap) < percent * (na + nb + gap)."""
    total = na.astype(np.int64) + nb
    return 100 * (total - gap) < percent * (total + gap)


def _cells(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16)


def _screen(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose histograms leave a link possible."""
    side = classes.select("rep", "n", "cells")
    wide = pairs.join(side.toDF("a", "na", "ca"), "a").join(side.toDF("b", "nb", "cb"), "b").select("a", "b", "na", "nb", "ca", "cb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for batch in batches:
            for part in slices(batch):
                gap = np.abs(_cells(part.column("ca")) - _cells(part.column("cb"))).sum(1)
                near = ~_far(part.column("na").to_numpy(), part.column("nb").to_numpy(), gap, percent)
                yield part.select(["a", "b"]).filter(pa.array(near))

    return wide.mapInArrow(run, "a long, b long")


def _verify(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs whose shingle sets are as similar as asked, judged on the whole sets."""
    pairs = written(pairs, "jaccard-pairs")
    texts = _probably_in(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")))
    wide = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for batch in batches:
            for part in slices(batch):
                ha, fa = _shingles(part.column("ta"), size)
                hb, fb = _shingles(part.column("tb"), size)
                keep = []
                for i in range(part.num_rows):
                    x, y = ha[fa[i] : fa[i + 1]], hb[fb[i] : fb[i + 1]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return wide.mapInArrow(run, "a long, b long").distinct()


def _probably_in(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is in ``ids``, and some others: a bit table of fixed size spares most of the traffic of a join to come."""
    at = F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS))
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {1 << FILTER_BITS}) % 64 as int))")
    table = ids.select(F.floor(at / 64).alias("slot"), bit.alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits"))
    return docs.where("id is not null").withColumn("slot", F.floor(at / 64)).withColumn("bit", bit).join(
        F.broadcast(table), "slot").where(F.col("bits").bitwiseAND(F.col("bit")) != 0).select("id", "text")


def _meetings(rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of different components that meet in a list and pass the filters of size and histogram.

    A list is cut into blocks in order of size; each tile holds two blocks, so a task never holds more than 2 * BLOCK rows of a list.
    """
    order = Window.partitionBy("token").orderBy("n", "rep")
    blocks = written(rows.withColumn("block", F.floor((F.row_number().over(order) - 1) / BLOCK).cast("int")), "jaccard-blocks")
    spans = blocks.groupBy("token", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    tiles = spans.alias("x").join(spans.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.block") <= F.col("y.block")) &
                                  (F.col("y.low") * percent <= F.col("x.high") * 100)).select(
        F.col("x.token").alias("token"), F.col("x.block").alias("i"), F.col("y.block").alias("j"))
    wanted = tiles.select("token", "i", "j", F.col("i").alias("block"), F.lit(0).alias("side")).unionAll(
        tiles.where("i < j").select("token", "i", "j", F.col("j").alias("block"), F.lit(1).alias("side")))
    dealt = blocks.join(wanted, ["token", "block"]).select("token", "i", "j", "side", "rep", "n", "comp").join(
        classes.select("rep", "n", "cells"), ["rep", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        held: list[pa.RecordBatch] = []
        sent = np.zeros((REMEMBERED, 2), np.int64)  # pairs meet in many lists; a task sends them once, unless another has taken their place; a < b, so zeros are none

        def compare(part: pa.Table) -> pa.RecordBatch:
            key = np.stack([part.column(c).to_numpy().astype(np.int64) for c in ("token", "i", "j")], 1)
            cut = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
            n, comp, rep, side = (part.column(c).to_numpy().astype(np.int64) for c in ("n", "comp", "rep", "side"))
            cells = _cells(part.column("cells"))
            found: set[tuple[int, int]] = set()
            for lo, hi in zip(cut, np.append(cut[1:], len(key)), strict=True):
                if comp[lo:hi].min() == comp[lo:hi].max():
                    continue
                tile = key[lo, 1] != key[lo, 2]
                split = lo + int(np.searchsorted(side[lo:hi], 1)) if tile else hi
                for k in range(lo, split):
                    other = np.arange(split, hi) if tile else np.arange(k + 1, hi)
                    other = other[(comp[other] != comp[k]) & (100 * np.minimum(n[other], n[k]) >= percent * np.maximum(n[other], n[k]))]
                    if len(other):
                        gap = np.abs(cells[other] - cells[k]).sum(1)
                        for o in other[~_far(n[other], n[k], gap, percent)]:
                            found.add((min(int(rep[k]), int(rep[o])), max(int(rep[k]), int(rep[o]))))
            pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
            slot = (mix(pairs.view(np.uint64)[:, 0] ^ mix(pairs.view(np.uint64)[:, 1])) % np.uint64(len(sent))).astype(np.int64)
            pairs, slot = (x[(sent[slot] != pairs).any(1)] for x in (pairs, slot))
            sent[slot] = pairs
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:  # a tile may go on in the next batch: hold back the last one
            held.append(batch)
            part = pa.Table.from_batches(held)
            same = np.ones(part.num_rows, bool)
            for c in ("token", "i", "j"):
                v = part.column(c).to_numpy()
                same &= v == v[-1]
            last = int(np.flatnonzero(~same)[-1]) + 1 if (~same).any() else 0
            if last:
                yield compare(part.slice(0, last))
            held = part.slice(last).to_batches()
        if held:
            yield compare(pa.Table.from_batches(held))

    keyed = dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "side", "n", "rep")
    return keyed.mapInArrow(run, "a long, b long").distinct()


def jaccard_components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT,
                       bits: int = BUCKET_BITS) -> DataFrame:
    """Per document row: ``id, n_shingles, component_id`` (smallest id reachable by links of at least ``percent`` / 100)."""
    docs = keyed_text(documents, id_col, text_col)
    known = written(features(docs, size, percent, bits), "jaccard-features")
    joined = known.where("id is not null and n > 0")
    classes = written(joined.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.first("prefix").alias("prefix"), F.first("cells").alias("cells")),
                      "jaccard-classes")
    groups = classes.groupBy("n", "prefix").agg(F.min("rep").alias("gid"))
    members = written(classes.join(groups, ["n", "prefix"]).select("gid", "rep", "n"), "jaccard-members")

    by_token = Window.partitionBy("token")
    lists = groups.select("gid", "n", F.explode("prefix").alias("token")).withColumn("met", F.count("*").over(by_token)).withColumn(
        "before", F.lag("gid").over(by_token.orderBy("n", "gid"))).withColumn("size_before", F.lag("n").over(by_token.orderBy("n", "gid")))
    lists = written(lists.where("met > 1").drop("met"), "jaccard-lists")
    # The group of a list whose prefix is shared most is likely the text that the others were made from.
    shared = lists.groupBy("gid").agg(F.count("*").alias("shared"))
    middle = lists.join(shared, "gid").groupBy("token").agg(F.max_by(F.struct("gid", "n"), F.struct("shared", -F.col("gid"))).alias("m"))
    to_middle = lists.join(middle, "token").select("gid", "n", F.col("m.gid").alias("other"), F.col("m.n").alias("size"), F.lit(1).alias("how"))
    to_before = lists.select("gid", "n", F.col("before").alias("other"), F.col("size_before").alias("size"), F.lit(0).alias("how"))
    next_to = to_middle.unionAll(to_before).where("gid <> other").where(
        F.greatest("n", "size") * percent <= F.least("n", "size") * 100).groupBy("gid", "how", "other").count()
    first = next_to.groupBy("gid", "how").agg(F.max_by("other", F.struct("count", "other")).alias("other")).select(
        F.least("gid", "other").alias("a"), F.greatest("gid", "other").alias("b"))
    first = first.unionAll(members.where("gid <> rep").select(F.col("gid").alias("a"), F.col("rep").alias("b")))
    links = written(_verify(_screen(first.distinct(), classes, percent), docs, size, percent), "jaccard-links")

    found = components(links)
    placed = written(members.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "gid", "rep", "n", F.coalesce("component", "rep").alias("comp")), "jaccard-placed")
    spread = placed.groupBy("gid").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    # Lists of several components; of lists with the same groups, one.
    open_lists = lists.join(spread, "gid").groupBy("token").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("k"), F.bit_xor(F.xxhash64("gid")).alias("h1"),
        F.bit_xor(F.xxhash64("gid", F.lit(1))).alias("h2")).where("low <> high").groupBy("k", "h1", "h2").agg(F.min("token").alias("token")).select("token")
    # A group of several members meets itself, whether or not it meets others.
    own = placed.join(spread.where("low <> high").select("gid"), "gid").select(F.xxhash64(F.lit("group"), "gid").alias("token"), "rep", "n", "comp")
    rows = lists.select("token", "gid").join(open_lists, "token").join(placed, "gid").select("token", "rep", "n", "comp").unionAll(own)
    more = written(_verify(_meetings(rows, classes, percent), docs, size, percent), "jaccard-links")
    final = components(links.unionAll(more))

    reps = classes.select("n", "s1", "s2", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left").select(
        "n", "s1", "s2", F.coalesce("component", "rep").alias("component"))
    placed_rows = known.select("id", "n", "s1", "s2").join(reps, ["n", "s1", "s2"], "left")
    return placed_rows.select("id", F.col("n").cast("long").alias("n_shingles"),
                              F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
