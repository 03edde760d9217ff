"""Language identification: word-first backoff.

Method: a text's words are looked up in per-language frequency lists. A word known to any language scores
``-log(count / total)`` in each, with a fixed penalty where a language lacks it. A word that no language knows is scored
by its character n-grams instead, the longest length of which any n-gram is known, averaged over those n-grams. A
text's score per language is the mean over its words; the lowest wins, ties go to the language that sorts first.

Training reads only texts and their languages. It is fitted on at most ``sample_rows`` labelled rows per language (in
expectation; rows are chosen by a hash of their id), and the model holds at most ``MAX_WORDS`` words and ``MAX_GRAMS``
n-grams over all languages, shared out evenly and taken by frequency; so what is sent to tasks has a fixed bound and
does not grow with the corpus. Every text to be predicted is read whole.

Words: maximal runs of letters and combining marks that begin with a letter, lower-cased.

Defined results: null text or one without a letter is ``und`` with score 0; so is every text when nothing could be
learned. Rows without a language or an id take no part in training. Repeated rows count, and are predicted, as often as
they occur. Long texts and long words are used whole. Columns of other names are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.frames import make_room, slices, written

SAMPLE_ROWS = 10_000
MAX_WORDS, WORDS_PER_LANGUAGE = 300_000, 50_000
MAX_GRAMS, GRAMS_PER_LENGTH = 300_000, 20_000
LENGTHS = (5, 4, 3, 2, 1)
PENALTY = 16.0
UNKNOWN = "und"

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_HELD = 250_000  # distinct entries a task counts or remembers at once


def words_in(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_in(word: str, n: int) -> list[str]:
    padded = f"^{word}$" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def held_out(id_col, folds: int = 5):
    """True where crc32 of the id's text is divisible by ``folds``; a null id is never held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(False))


def word_counts(labelled: DataFrame) -> DataFrame:
    """(lang, word, n) from rows (lang, text), counted inside tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        raw: dict[str, Counter] = {}

        def flush():
            out: dict[tuple[str, str], int] = {}
            for lang, counts in raw.items():
                for token, n in counts.items():
                    for w in words_in(token):
                        out[lang, w] = out.get((lang, w), 0) + n
            raw.clear()
            keys = list(out)
            for i in range(0, len(keys), 50_000):
                part = keys[i : i + 50_000]
                yield pa.RecordBatch.from_pydict(
                    {"lang": [k[0] for k in part], "word": [k[1] for k in part], "n": [out[k] for k in part]},
                    pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]))

        for batch in batches:
            for part in slices(batch):
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                    raw.setdefault(lang, Counter()).update(text.split())
                if sum(map(len, raw.values())) > _HELD:
                    yield from flush()
        yield from flush()

    return labelled.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame) -> DataFrame:
    """(lang, size, gram, n): n-grams of the distinct words, weighted by how often each word occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        held: Counter = Counter()
        schema = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("gram", pa.string()), ("n", pa.int64())])

        def flush():
            keys = list(held)
            for i in range(0, len(keys), 50_000):
                part = keys[i : i + 50_000]
                yield pa.RecordBatch.from_pydict(
                    {"lang": [k[0] for k in part], "size": [k[1] for k in part], "gram": [k[2] for k in part],
                     "n": [held[k] for k in part]}, schema)
            held.clear()

        for batch in batches:
            for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
                for size in LENGTHS:
                    for g in grams_in(word, size):
                        held[lang, size, g] += n
                if len(held) > _HELD:
                    yield from flush()
        yield from flush()

    return words.mapInArrow(run, "lang string, size int, gram string, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


def _most_frequent(counts: DataFrame, by: list[str], key: str, limit: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("n"), key)
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("rank")


class Model:
    """Frequency lists of all languages; remembers the scores of whitespace-separated pieces of text it has met."""

    def __init__(self, langs: list[str], words: dict, grams: dict[int, dict]) -> None:
        self.langs, self.words, self.grams = langs, words, grams

    def __getstate__(self):
        return self.langs, self.words, self.grams

    def __setstate__(self, state):
        self.langs, self.words, self.grams = state

    def add(self, out: list[float], word: str) -> None:
        """Add a word's score, less the penalty, to each language's sum."""
        entry = self.words.get(word)
        if entry:
            for lang, value in entry:
                out[lang] += value - PENALTY
            return
        for n in LENGTHS:
            known = self.grams[n]
            found = [known[g] for g in grams_in(word, n) if g in known]
            if found:
                for entry in found:
                    for lang, value in entry:
                        out[lang] += (value - PENALTY) / len(found)
                return

    def piece(self, token: str) -> list[float]:
        """Sums of the scores of the words in a piece of text by language, less their penalties, and the number of words."""
        out = [0.0] * (len(self.langs) + 1)
        for w in words_in(token):
            self.add(out, w)
            out[-1] += 1
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not hasattr(self, "seen"):
            self.seen, self.table = {}, np.zeros((1 << 16, len(self.langs) + 1))
        seen = self.seen
        tokens = [(t or "").split() for t in texts]
        new = list(set().union(*tokens).difference(seen))
        at = len(seen)
        if at + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(len(new), len(self.table)), self.table.shape[1]))])
        table = self.table
        if new:
            table[at : at + len(new)] = [self.piece(w) for w in new]
            seen.update(zip(new, range(at, at + len(new)), strict=True))
        langs, scores = [], []
        for ts in tokens:
            total = table[np.fromiter(map(seen.__getitem__, ts), np.int64, len(ts))].sum(axis=0)
            if total[-1] == 0 or not self.langs:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            mean = PENALTY + total[:-1] / total[-1]
            best = int(np.argmin(mean))
            langs.append(self.langs[best])
            scores.append(float(1 / np.exp(mean[best] - mean).sum()))
        if len(seen) > _HELD:  # room for no more: the newest are met again or not
            for w in new:
                del seen[w]
        return langs, scores


def fit(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from the rows given; the languages are the distinct non-null values of ``lang_col``."""
    rows = documents.select(documents[id_col].alias("id"), documents[lang_col].cast("string").alias("lang"),
                            documents[text_col].cast("string").alias("text")).where("id is not null and lang is not null and text is not null")
    sizes = rows.groupBy("lang").count().orderBy("lang").collect()
    langs = [r["lang"] for r in sizes]
    if not langs:
        return Model([], {}, {n: {} for n in LENGTHS})
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, sample_rows / r["count"]))])
    drawn = rows.where(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    counts = written(word_counts(drawn.select("lang", "text")), "langid-words")
    grams = gram_counts(counts)
    return Model(langs, _listed(counts, langs, ["lang"], "word", min(WORDS_PER_LANGUAGE, MAX_WORDS // len(langs))),
                 _listed(grams, langs, ["lang", "size"], "gram", min(GRAMS_PER_LENGTH, MAX_GRAMS // len(LENGTHS) // len(langs))))


def _listed(counts: DataFrame, langs: list[str], by: list[str], key: str, limit: int) -> dict:
    """Entries of the most frequent keys: key -> [(language, -log share)], below the n-gram size if ``by`` has one."""
    index = {x: i for i, x in enumerate(langs)}
    totals = {tuple(r[c] for c in by): r["n"] for r in counts.groupBy(*by).agg(F.sum("n").alias("n")).collect()}
    sized = len(by) > 1
    out: dict = {n: {} for n in LENGTHS} if sized else {}
    for r in _most_frequent(counts, by, key, limit).collect():
        into = out[r["size"]] if sized else out
        into.setdefault(r[key], []).append((index[r["lang"]], float(min(PENALTY, np.log(totals[tuple(r[c] for c in by)] / r["n"])))))
    # rare keys of equal count have equal entries: each is held once, here and, since pickling keeps it so, in every task
    held: dict = {}
    for into in out.values() if sized else (out,):
        for k, entry in into.items():
            entry = tuple(held.setdefault(e, e) for e in entry)
            into[k] = held.setdefault(entry, entry)
    return out


def predict(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The input's rows with ``lang_pred`` and ``score`` (share of the winner in a softmax of the mean scores) added; columns of these names are replaced."""
    documents = documents.drop("lang_pred", "score")
    sent = documents.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*documents.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for batch in batches:
            for part in slices(batch):
                langs, scores = sent.value.predict(part.column(text_col).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                    names=[*part.schema.names, "lang_pred", "score"])

    return documents.mapInArrow(run, schema)


def keep_identified(documents: DataFrame, model: Model, min_score: float = 0.0, text_col: str = "text") -> DataFrame:
    """The rows, with their own columns, whose text has a language and reaches ``min_score``."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for batch in batches:
            for part in slices(batch):
                langs, scores = sent.value.predict(part.column(text_col).to_pylist())
                keep = [x != UNKNOWN and s >= min_score for x, s in zip(langs, scores, strict=True)]
                yield part.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def identify(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5,
             sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Fit on the rows that are not held out and predict every row: ``id, held_out, lang_pred, score``."""
    rows = documents.select(documents[id_col].alias("id"), documents[text_col].cast("string").alias("text"),
                            documents[lang_col].alias("lang"))
    model = fit(rows.where(~held_out(F.col("id"), folds)), "id", "text", "lang", sample_rows)
    found = predict(rows.select("id", "text"), model)
    return found.select("id", held_out(F.col("id"), folds).alias("held_out"), "lang_pred", "score")
