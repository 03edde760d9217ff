"""Line de-duplication: lines that many documents share stay in one of them only.

Method: whole texts are split into lines and exploded; long enough lines are reduced to the position and a 128-bit hash of their
normalised key. Distinct documents are counted per hash, by document first, so that a line of a third of all documents is
added up in tasks. Hashes over the threshold name the positions to drop. Those with at least one of
``HOT_KEYS`` equal shares of all lines, ``HOT_KEYS`` by proof at most, meet the lines by broadcast, all others by a join whose
keys are bounded by that share. Positions are gathered per document, and the document is put together from the lines between them.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. Only functions of the JVM are used. Text moves once, for
the join with the positions; counting moves hashes. Two keys count as one only if 128 bits agree.

Defined results: null text is empty, and an empty text is one empty line; documents are counted by id, so rows that repeat an id are one
document and are treated alike; rows without an id do not count as documents and lose every line that is dropped
elsewhere; of the documents that hold a line the one with the largest id keeps all its copies; a text whose lines all go is empty; an empty
table gives no rows; all other columns stay, and columns named as the two counts are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.frames import written

WHITE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: So many keys are broadcast at most: each holds at least this share of all long lines.
HOT_KEYS = 10_000


def long_lines(rows: DataFrame, least_chars: int) -> DataFrame:
    """(id, t, pos, h1, h2) of every line of ``rows(id, t, lines)`` whose key has enough code points."""
    lines = rows.select("id", "t", F.posexplode("lines").alias("pos", "line"))
    keys = lines.select("id", "t", "pos", F.btrim("line", F.lit(WHITE)).alias("line")).where(F.length("line") >= least_chars)
    key = F.translate("line", _UPPER, _LOWER)
    return keys.select("id", "t", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"))


def common_lines(lines: DataFrame, least_docs: int) -> DataFrame:
    """(h1, h2, keep, found): keys found in enough documents, the largest id that holds each, and the number of such lines."""
    by_doc = lines.groupBy("h1", "h2", "id").agg(F.count("*").alias("found"))
    return by_doc.groupBy("h1", "h2").agg(F.count("id").alias("docs"), F.max("id").alias("keep"), F.sum("found").alias("found")).where(
        F.col("docs") >= least_docs).drop("docs")


def dropped_positions(lines: DataFrame, common: DataFrame) -> DataFrame:
    """(id, t, gone): the sorted line numbers that a text loses."""
    share = F.lit(lines.count())
    hot = common.where(F.col("found") * HOT_KEYS >= share).select("h1", "h2", F.col("keep").alias("hot_keep"))
    met = lines.join(F.broadcast(hot), ["h1", "h2"], "left")
    rest = common.where(F.col("found") * HOT_KEYS < share).select("h1", "h2", "keep")
    lost = met.where("hot_keep is not null").select("id", "t", "pos", F.col("hot_keep").alias("keep")).unionAll(
        met.where("hot_keep is null").drop("hot_keep").join(rest, ["h1", "h2"]).select("id", "t", "pos", "keep")).where("id is null or id <> keep")
    return lost.groupBy("id", "t").agg(F.sort_array(F.collect_set("pos")).alias("gone"))


def _between(lines: Column, gone: Column) -> Column:
    """The lines before, between and after the sorted positions, in order. Both arguments are plain columns, so nothing is made twice."""
    def piece(to: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(-1)).otherwise(F.get(gone, i - 1))
        return F.slice(lines, before + 2, to - before - 1)

    return F.flatten(F.transform(F.concat(gone, F.array(F.size(lines))), piece))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 40, least_docs: int = 5,
                count_cols: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with the kept text, its number of lines before and the number of dropped lines."""
    others = [c for c in docs.columns if c not in (text_col, *count_cols)]
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(
        docs[id_col].cast("long").alias("id"), F.xxhash64(text).alias("t"), F.split(text, "\n", -1).alias("lines"),
        F.struct(F.lit(None).alias("_"), *[docs[f"`{c}`"].alias(c) for c in others]).alias("row"))
    lines = written(long_lines(rows, least_chars), "line-keys")
    common = written(common_lines(lines, least_docs), "common-lines")
    gone = dropped_positions(lines, common).toDF("gone_id", "gone_t", "gone")
    met = rows.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("t") == F.col("gone_t")), "left")
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(_between(F.col("lines"), F.col("gone")))
    values = {c: F.col("row").getField(c) for c in others} | {text_col: F.array_join(kept, "\n")}
    return met.select(
        *[values[c].alias(c) for c in docs.columns if c in values],
        F.size("lines").cast("long").alias(count_cols[0]), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias(count_cols[1]))
