import random
import re

import numpy as np
import pyarrow as pa

from plumbline.llm import words as W
from plumbline.llm.frames import slices, text_bytes

TEXTS = ["", None, "a", "A b", "  Één  zwei\tdrei\n", "x" * 5000, "1,2;3", "\x00\x01", "a b c d e f", "日本 語"]


def test_words_and_windows_are_those_of_the_patterns():
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choices("aB é9,\n\t\x0b\x1f", k=rng.randrange(60))) for _ in range(300)]
    raw, offsets = text_bytes(pa.array(texts, pa.string()))
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for member, pattern in ((W.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (W.SPACED, r"[^\x20\x09-\x0D]+")):
        want = [re.findall(pattern, (t or "").translate(low)) for t in texts]
        got = W.words_of(raw, offsets, member)
        assert np.diff(got.first).tolist() == [len(w) for w in want]
        seen: dict = {}
        for h, w in zip(got.hashes.tolist(), [w for ws in want for w in ws], strict=True):
            assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)
        hashes, heads = W.windows_of(got, 3)
        windows = [tuple(ws[i : i + 3]) for ws in want for i in (range(len(ws) - 2) if len(ws) > 3 else range(bool(ws)))]
        by: dict = {}
        assert len(hashes) == len(windows)
        for h, w in zip(hashes.tolist(), windows, strict=True):
            assert by.setdefault(w, h) == h
        assert len(set(by.values())) == len(by)


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    raw, offsets = text_bytes(pa.array(["alpha beta gamma " * 50]))
    whole = W.words_of(raw, offsets, W.ALNUM).hashes
    monkeypatch.setattr(W, "PIECE", 7)
    assert (W.words_of(raw, offsets, W.ALNUM).hashes == whole).all()


def test_slices_keep_every_row_once():
    batch = pa.RecordBatch.from_pydict({"t": ["x" * n for n in (1, 10_000, 3, 70_000, 0, 5)]})
    assert [r for s in slices(batch, 9_000) for r in s.column("t").to_pylist()] == batch.column("t").to_pylist()


def test_tables_of_powers_stay_small():
    W._powers.cache_clear()
    for size in (10, 5_000, 70_000, 3_000_000):
        raw = np.frombuffer(b"abcdefg " * (size // 8 + 1), np.uint8)
        W.words_of(raw, np.array([0, len(raw)]), W.SPACED)
    assert W._powers.cache_info().currsize == 1
    assert sum(x.nbytes for x in W._powers(W._BASE, W._pow2(W.PIECE))) <= 8 << 20
