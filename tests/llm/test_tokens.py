import random
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import docs

from plumbline.llm import pack as P
from plumbline.llm.token_files import read_token_files, token_file_digest, write_token_files
from plumbline.llm.tokens import Encoder, default_vocabulary

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def plain():
    return tokenizers.Tokenizer.from_file(default_vocabulary())


def ids_of(plain, text, end):
    return np.array(plain.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_encoder_equals_the_library(plain):
    rng = random.Random(1)
    bits = ["a", " ", "\n", "\t", "'s", "é", "9", "<|endoftext|>", "\x85", "\x1f", ".", "word ", " Two,", "\r\n", "　"]
    texts = ["", " ", "a  b", "a\n\n\nb", "\na ", "x." * 2000] + ["".join(rng.choices(bits, k=rng.randrange(14))) for _ in range(3000)]
    e = Encoder(default_vocabulary())
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert e.encode([None]) == [b""]


TEXTS = [None, "", "short text", "mid " * 300, "A much longer text, with é. " * 700, "mid " * 300, "mid " * 300]


def test_token_files_round_trip(spark, plain, tmp_path):
    rows = [(i * 3, t) for i, t in enumerate(TEXTS)] + [(6, "short text"), (None, "nobody's")]
    got = sorted((r.start, r.n_tokens, r.ids_crc32, r.doc_id) for r in token_file_digest(docs(spark, rows), partitions=3).collect())
    at = 0
    for start, n, crc, doc in got:
        assert start == at
        at += n
        assert (n, crc) in {(len(x), zlib.crc32(x.tobytes())) for d, t in rows if d == doc for x in [ids_of(plain, t, 2)]}
    keys = [-1 if d is None else d for *_, d in got]
    assert keys == sorted(keys) and len(got) == len(rows)
    path = str(tmp_path / "ids")
    write_token_files(docs(spark, rows), path)
    assert read_token_files(spark, path, [9]).first().n_tokens == len(ids_of(plain, TEXTS[3], 2))
    assert token_file_digest(docs(spark, [])).collect() == []


def check_packing(plain, rows, found, window):
    by_doc: dict = {}
    for r in found:
        by_doc.setdefault((r.id, r.doc_tokens), []).append(r)
    sizes = Counter((d, len(ids_of(plain, t, 0))) for d, t in rows)
    assert {k: sum(p.length for p in ps) for k, ps in by_doc.items()} == {k: k[1] * n for k, n in sizes.items()}
    for d, t in rows:
        ids = ids_of(plain, t, 0)
        assert all(p.ids_crc32 in {zlib.crc32(ids_of(plain, u, 0)[p.start : p.start + p.length].tobytes()) for e, u in rows if e == d}
                   for p in by_doc[d, len(ids)])
    fill: dict = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0) and r.length > 0
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values(), default=0) <= window and sorted(fill) == list(range(len(fill)))
    return sum(fill.values()), len(fill)


def test_packing_places_every_id_once(spark, plain):
    rng = random.Random(3)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "x y")] + [(100 + i, "tok " * rng.randrange(200)) for i in range(60)]
    found = P.pack(docs(spark, rows).repartition(3), 64).collect()
    total, sequences = check_packing(plain, rows, found, 64)
    assert sequences <= total / 64 * 1.03 + 1
    assert P.pack(docs(spark, [])).collect() == []


def test_one_length_for_all(spark, plain):
    rows = [(i, "mid " * 39) for i in range(50)]
    total, sequences = check_packing(plain, rows, P.pack(docs(spark, rows), 64).collect(), 64)
    assert sequences == -(-total // 64)


def test_plan_never_places_more_than_there_are():
    rng = np.random.default_rng(4)
    for histogram in (np.zeros(128, int), np.append(0, rng.integers(0, 50, 127)), np.eye(128, dtype=int)[100] * 7):
        p = P.plan(histogram, 128)
        placed = {n: p.loose.get(n, (histogram[n], 0))[0] for n in range(1, 128)}
        assert all(placed[n] <= histogram[n] for n in placed)
    assert (P.combinations(20).sum(1) == 20).all() and len(P.combinations(4)) == 3


def test_words_of_letters_skip_the_splitting(monkeypatch):
    from plumbline.llm.tokens import Encoder, default_vocabulary

    texts = ["Straße größer Ñandú naïve", "слово и ещё слово", "λόγος ΛΌΓΟΣ x", "ﬁ ℵ 漢字 don't a1 b.", "Žluťoučký kůň"]
    coder = Encoder(default_vocabulary())
    wanted = [np.array(coder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    seen = []
    raw = coder._raw

    class Watched:
        model = coder.tokenizer.model

        def encode_batch_fast(self, parts, **named):
            seen.extend(" ".join(parts).split())
            return coder_tokenizer.encode_batch_fast(parts, **named)

    coder_tokenizer = coder.tokenizer
    monkeypatch.setattr(coder, "tokenizer", Watched())
    assert coder.encode(texts) == wanted and raw is not None
    assert "слово" not in seen and "größer" not in seen  # letters only: straight to the merges
    assert "漢字" in seen and "don't" in seen


def test_a_process_keeps_one_large_table_at_a_time():
    from plumbline.llm.frames import make_room, resident

    first = resident("first", list)
    assert resident("first", list) is first
    resident("second", list)
    assert resident("first", list) is not first
    again = resident("first", list)
    make_room()
    assert resident("first", list) is not again
