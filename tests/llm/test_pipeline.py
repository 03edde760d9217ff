"""The stages on a small corpus with planted cases, and the registered queries on given tables."""

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as pipeline
from cases import docs, prose

import __spark_entry__ as entry

EN = "the house and the river under a bridge with many people who walk along it every day of the year and talk"
DE = "das haus und der fluss unter einer brücke mit vielen leuten die dort jeden tag im jahr gehen und reden"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    test_item = "quick " + " ".join(f"exam{i}" for i in range(20))
    spark.createDataFrame([(1, test_item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, EN, "en"), (2, DE, "de"), (3, EN, "en"), (4, "12 34 %%", "en"), (5, None, None), (6, f"the house {test_item}", "en"),
            (7, "the people under the bridge write to jane.roe@mail.example.com every day", "en"), (7, "the people under the bridge write to jane.roe@mail.example.com every day", "en"),
            (None, "the river", "en"), (None, "the river", "en")]
    data = docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    kept = []
    for n, (name, stage) in enumerate(pipeline.STAGES):
        path = str(tmp_path / name)
        stage(spark, data, str(tmp_path)).write.parquet(path)
        data = spark.read.parquet(path)
        if n < 4:
            assert data.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append(sorted(str(r.doc_id) for r in data.collect()))
    assert kept == [sorted(x) for x in (["1", "2", "3", "6", "7", "7", "None", "None"], ["1", "2", "6", "7", "None", "None"], ["1", "2", "7", "None", "None"],
                                        ["1", "2", "7", "None", "None"], ["1", "2", "7", "None", "None"])]
    assert "jane" not in spark.read.parquet(str(tmp_path / "surrogates")).where("doc_id = 7").first().text


def test_near_copies_by_five_words_and_80_percent(spark):
    def shingles(text):
        w = text.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    rng = random.Random(7)
    texts = []
    for base in (prose(rng, n, 10**6).split() for n in (50, 50, 60, 120, 400)):
        texts.append(base)
        for changes in (1, 1, 2, 3, 4, 8):  # before the last copy or the base: chains occur, too
            texts.append(copy := list(rng.choice([base, texts[-1]])))
            for at in rng.sample(range(5, len(copy) - 5), changes):
                copy[at] = f"v{rng.randrange(10**6)}"
    texts += [texts[0][:3], texts[0][:4], texts[0][:3], prose(rng, 50, 10**6).split()]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets, least = [shingles(t) for _, t in rows], list(range(len(rows)))
    near = [(i, j, len(a & b), len(a | b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j]
    for _ in rows:
        for i, j, both, either in near:
            if 100 * both >= 80 * either:
                least[i] = least[j] = min(least[i], least[j])
    want = [i for i, k in enumerate(least) if i == k]
    got = sorted(r.doc_id for r in pipeline.drop_near_copies(spark, docs(spark, rows), "").collect())
    assert got == want and {i for i, j, both, either in near if either == 51 and both == 41}


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).collect() == []


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
