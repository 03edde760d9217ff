import hashlib
import random

import pytest
from cases import ALNUM, docs, lower, prose

from plumbline.llm import decontaminate as D
from plumbline.llm.decontaminate import decontamination, remove, scan


def brute(texts, items, window=13):
    out = []
    for text in texts:
        w = ALNUM.findall(lower(text))
        hit, found = set(), set()
        for item, t in items:
            iw = ALNUM.findall(lower(t))
            k = min(window, len(iw))
            for j in range(len(iw) - k + 1) if iw else ():
                for i in range(len(w) - k + 1):
                    if w[i : i + k] == iw[j : j + k]:
                        hit |= set(range(i, i + k))
                        found.add(str(item))
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("most", [400_000, 70])
def test_scan_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(D, "MAX_WINDOWS", most)  # at once, or in parts
    rng = random.Random(7)
    items = [(i, prose(rng, rng.choice([1, 3, 12, 13, 14, 40]), 6 if i % 2 else 300)) for i in range(12)] + [(99, None), (98, ""), (10, "Ünï Code"), (3, "ünï code")]
    texts = [None, "", "  ,", "ÜNÏ code", "x ünï CODE y"]
    for _ in range(30):
        text = prose(rng, rng.randrange(80), 6) + " " + prose(rng, 30)
        item = rng.choice(items)[1] or ""
        texts.append(text[:40] + " " + item.upper().replace(" ", ", ") + " " + text)
    texts += [texts[7]] * 2 + ["long " * 50_000 + (items[5][1] or "")]
    df = decontamination(docs(spark, list(enumerate(texts))), spark.createDataFrame(items, "item_id long, text string"))
    got = {r[0]: tuple(r)[1:] for r in df.collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, items)


def test_empty_tables_and_null_ids(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination(docs(spark, []), bench).collect() == []
    row = decontamination(docs(spark, [(None, "a b c")]), none).first()
    assert (row.doc_id, row.n_words, row.n_hit, row.contaminated) == (None, 3, 0, False)


@pytest.mark.parametrize("most", [400_000, 1])
def test_remove_documents_or_spans(spark, monkeypatch, most):
    monkeypatch.setattr(D, "MAX_WINDOWS", most)
    bench = spark.createDataFrame([(1, "one two three four"), (2, "nowhere to be found"), (3, "nor this")], "item_id long, text string")
    data = docs(spark, [(1, "Keep é: One two, three four! tail"), (2, "clean text"), (3, None), (4, "one two three four " + "w " * 100)])
    assert [r.doc_id for r in remove(data, bench).orderBy("doc_id").collect()] == [2, 3, 4]
    cut = {r.doc_id: r.text for r in remove(data, bench, "span").collect()}
    assert cut[1] == "Keep é: ! tail" and cut[2] == "clean text" and cut[3] is None and cut[4].startswith("one")
    assert remove(data, bench).columns == data.columns
    with pytest.raises(ValueError):
        remove(data, bench, "words")
    assert scan(data, bench).where("id = 1").first().spans[0].start == 9
