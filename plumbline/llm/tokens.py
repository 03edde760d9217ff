"""Token ids of whole texts with a vocabulary file of the ``tokenizers`` library, made once per distinct word.

The byte-level vocabulary splits a text before every single space that a non-space follows, and around a line break
between two non-spaces, before it merges anything. So the pieces between those places can be encoded apart and their
ids joined. A task remembers the ids of pieces it has met, up to ``HELD`` of them. Texts with other runs of white space
(repeated spaces, indents, empty lines) are cut only where a space stands alone before a non-space. A piece of letters only
is one word to the vocabulary's own splitting, so it goes straight to the merges.
"""

from __future__ import annotations

import json
import os
import re
from itertools import islice
from string import punctuation
from struct import pack

import numpy as np

from plumbline.llm.frames import resident

HELD = 550_000
#: Pieces longer than this are not remembered.
LONGEST = 64

_BEFORE_WORD = re.compile(r"(?= \S)")
#: Letters below are letters to every version of Unicode in use.
_SETTLED = "\u0500"


class _Spelling(dict):
    """How a byte-level vocabulary spells characters: printable bytes as they are, the others from U+0100 on."""

    _printed = {*range(33, 127), *range(161, 173), *range(174, 256)}
    _bytes = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - _printed))}

    def __missing__(self, character: str) -> str:
        self[character] = "".join(self._bytes.get(b, chr(b)) for b in character.encode())
        return self[character]


_SPELT = _Spelling()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.heads: dict[str, bytes | None] = {}  # pieces at a line's begin; None: cannot stand alone
        self.tails: dict[str, bytes | None] = {}  # pieces after a space
        self.units: dict[str, bytes | None] = {}  # pieces of irregular texts
        self.line_break = self._raw(["\n"])[0]
        added = "".join(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.ends = "".join(c for c in punctuation if c not in added)
        made = json.loads(self.tokenizer.to_str())
        split = made["pre_tokenizer"] or {}
        lettered = any(c.isalpha() for t in self.tokenizer.get_added_tokens_decoder().values() for c in t.content[:1])
        self.straight = not made["normalizer"] and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"] and not lettered
        self.marks: dict[str, bytes] = {}
        self.break_id = int(np.frombuffer(self.line_break, "<u4")[0])

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, known: dict, fresh: list[str], prefix: str) -> None:
        """Encode new pieces: words of letters by the merges, others many at once as lines of one text, each line break being one id."""
        alone, lines, pointed = [], [], []
        for p in fresh:
            if not p or "\n" in p or p[-1].isspace() or p[0].isspace() and (p[0] != " " or p[1].isspace()):
                alone.append(p)
            elif (base := p.rstrip(self.ends)) != p and base[-1:].isalpha():
                pointed.append((p, base))  # punctuation after a letter is encoded apart from it
            else:
                lines.append(p)
        known.update(zip(alone, self._raw([prefix + p for p in alone]), strict=True))
        have = set(lines)
        lines += [b for b in {b for _, b in pointed} if b not in known and b not in have]
        if self.straight:
            words, others = [], []
            for p in lines:
                (words if p.isalpha() and (p.isascii() or max(p) < _SETTLED) else others).append(p)
            tokenize, spelt, before = self.tokenizer.model.tokenize, _SPELT.__getitem__, _SPELT[prefix]
            for p in words:
                ids = [t.id for t in tokenize(before + (p if p.isascii() else "".join(map(spelt, p))))]
                known[p] = pack(f"<{len(ids)}I", *ids)
            lines = others
        for at in range(0, len(lines), 5_000):
            part = lines[at : at + 5_000]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join([prefix + p for p in part])], add_special_tokens=False)[0].ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self.break_id), len(ids)).tolist()
            raw, first = ids.tobytes(), 0
            for p, end in zip(part, ends, strict=True):
                known[p] = raw[4 * first : 4 * end]
                first = end + 1
        for p, base in pointed:
            marks = p[len(base) :]
            if marks not in self.marks:
                self.marks[marks] = self._raw([marks])[0]
            known[p] = known[base] + self.marks[marks]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null is empty."""
        heads, tails = set(), set()
        sizes = len(self.heads), len(self.tails), len(self.units)
        head, tail = self.heads.get, self.tails.get
        out: list[bytes | None] = []
        unsettled = []  # texts with pieces not met before: their place, pieces, ids so far and the gaps among these
        for text in texts:
            lines = [line.split(" ") for line in (text or "").split("\n")]
            if [""] in lines:
                out.append(self._irregular(text or ""))
                continue
            pieces: list[str] = []
            got: list[bytes | None] = []
            for parts in lines:
                pieces.append("\n")
                pieces += parts
                got.append(self.line_break)
                got.append(head(parts[0]))
                got.extend(map(tail, parts[1:]))
            if None not in got:
                out.append(b"".join(got[1:]))
                continue
            gaps = [i for i, ids in enumerate(got) if ids is None]
            at_head = [i for i in gaps if pieces[i - 1] == "\n"]
            at_tail = [i for i in gaps if pieces[i - 1] != "\n"] if len(at_head) < len(gaps) else []
            new_heads, new_tails = {pieces[i] for i in at_head}, {pieces[i] for i in at_tail}
            if any(p and p[0].isspace() for p in new_heads) or any(not p or p[0].isspace() for p in new_tails):
                out.append(self._irregular(text))
                continue
            heads |= new_heads
            tails |= new_tails
            unsettled.append((len(out), pieces, got, at_head, at_tail))
            out.append(None)
        self._learn(self.heads, list(heads), "")
        self._learn(self.tails, list(tails), " ")
        for place, pieces, got, at_head, at_tail in unsettled:
            for i in at_head:
                got[i] = self.heads[pieces[i]]
            for i in at_tail:
                got[i] = self.tails[pieces[i]]
            out[place] = b"".join(got[1:])
        room = sum(sizes) < HELD
        for known, size in zip((self.heads, self.tails, self.units), sizes, strict=True):
            _forget(known, size, room)
        return out

    def _irregular(self, text: str) -> bytes:
        units = [u for u in _BEFORE_WORD.split(text) if u]
        self._learn(self.units, list(set(units).difference(self.units)), "")
        return b"".join(map(self.units.__getitem__, units))


def _forget(known: dict, size: int, room: bool) -> None:
    """Of the entries after the first ``size``, keep short ones while there is room."""
    fresh = list(islice(reversed(known), len(known) - size))
    for p in [p for p in fresh if len(p) > LONGEST] if room else fresh:
        del known[p]


def encoder(path: str) -> Encoder:
    """One encoder per task process, kept until a task of another kind needs the room."""
    return resident(f"encoder {path}", lambda: Encoder(path))
