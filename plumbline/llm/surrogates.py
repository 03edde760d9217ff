"""Personal data replaced by keyed surrogates of the same type, format, script and gender.

Method: entities are found by patterns (e-mail, phone, IPv4 and IPv6, payment card, IBAN, social security number, credentials,
names after a title or a label, listed given names before a surname). A name that is found is looked for in its whole document: the full name,
the surname or the given name alone, with an initial, in the possessive or in capitals, so all mentions get the same surrogate. A value's surrogate is its successor in a keyed cyclic order of all values of the same
form: characters change only within their class (digits, vowels, consonants, accented letters, by script), and check
digits are computed anew. That map is a permutation without fixed points, so two values of a type never share a
surrogate, none keeps its own, and one value has one surrogate wherever and in whatever spelling (case, separators) it
occurs, without a table that would grow with the corpus. Given names in the lists change places with others of their
gender and script. The collision check counts, over the distinct entities of all documents, surrogates that stand for
two values, and refuses the result if there is one.

The map is a permutation, so whoever has the key can undo it: the key is an argument without a default and has to be kept secret.

Defined results: null text stays null, text without entities stays as it is, byte for byte; repeated rows are rewritten
alike; an empty table stays empty; all other columns are kept as they are (``n_chars`` only if asked for). Overlapping
finds: the one that begins first, then the type listed first. A column named as ``count_col`` is replaced; ``length_col`` has to exist.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.frames import slices, written

_ROUNDS = 6

#: Characters that may stand for one another.
CLASSES = (
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóúàèìòùâêîôûäëïöü", "ñçšžčćđ",
    "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ",
)
_CLASS_OF = {c: k for k in CLASSES for c in k}
#: Given names by script and gender; each list is permuted in itself.
GIVEN = {
    ("latin", "m"): "adam albert carlos daniel david felix frank hugo james john jorge karl louis luis marc martin michael paul peter pierre robert stefan thomas walter".split(),
    ("latin", "f"): "alice ana anna carmen claire elena emma eva helen ines julia karin laura lucia maria marie martha monika nina olivia petra sarah sofia sylvie".split(),
    ("cyrillic", "m"): "алексей андрей борис виктор дмитрий иван игорь михаил николай олег павел сергей".split(),
    ("cyrillic", "f"): "анна вера галина елена ирина людмила мария наталья ольга светлана татьяна юлия".split(),
}
_TITLES = {"m": "Mr Mister Sir Herr Herrn Monsieur Señor Господин".split(), "f": "Mrs Ms Miss Madam Frau Madame Mme Mlle Señora Señorita Госпожа".split(),
           "": "Dr Prof Doctor Professor Doktor".split()}
_GENDER_OF = {t: g for g, ts in _TITLES.items() for title in ts for t in (title, title.upper())}
_PLAIN_LABELS = frozenset("com net org edu gov ac co example".split())

_EMAIL = re.compile(r"(?<![\w.%+-])([A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?)@((?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,})(?![\w-])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_CARD = re.compile(r"(?<![\w+.-])(?:\d[ -]?){12,18}\d(?![\w-])")
_SSN = re.compile(r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])")
_IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d)")
_IP6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])|(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![\w:])")
_LABELLED_SSN = re.compile(r"(?i:\bssn|social security(?: number| no\.?)?)[ :#]{1,3}((?!000|666|9)\d{3} (?!00)\d{2} (?!0000)\d{4})(?![\w-])")
_PHONE = re.compile(r"(?<![\w+])(?:(?:\+?1[ .-]?)?(?:\([2-9]\d\d\) ?|[2-9]\d\d[ .-])\d{3}[ .-]\d{4}|\+\d{1,3}(?:[ .-]?\(?\d{1,5}\)?){2,6}|0\d{2,4} \d{3,4} \d{3,4})(?!\w)")
_SECRET = re.compile(r"(?<!\w)(?:(AKIA)([0-9A-Z]{16})|((?i:password|passwd|secret|token|api[_-]?key)\s*[=:]\s*[\"']?)([A-Za-z0-9_-]{8,}))(?!\w)")
_NAME_PART = r"[^\W\d_a-zа-яα-ω][^\W\d_]+(?:['’-][^\W\d_]+)*"
_NAME = re.compile(rf"(?<!\w)(?:({'|'.join(sorted(_GENDER_OF, key=len, reverse=True))})\.? |((?i:name)(?: is|:) ))({_NAME_PART})(?: ({_NAME_PART}))?(?!\w)")
_GENDER_OF_GIVEN = {n: g for (_, g), ns in GIVEN.items() for n in ns}
_LISTED = re.compile(rf"(?<!\w)({'|'.join(sorted({n.title() for n in _GENDER_OF_GIVEN}, key=len, reverse=True))}) ({_NAME_PART})(?!\w)")
_SOME_GIVEN = tuple(sorted({n.title() + " " for n in _GENDER_OF_GIVEN}))
_DIGIT = re.compile(r"\d")


def _number(key: bytes, tweak: str, n: int, v: int, back: bool) -> int:
    """A keyed permutation of 0..n-1 (balanced Feistel network, walked until inside), or its inverse."""
    half = max(1, (max(1, (n - 1).bit_length()) + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = v >> half, v & mask
        for r in reversed(range(_ROUNDS)) if back else range(_ROUNDS):
            seen = left if back else right
            word = hashlib.blake2b(f"{tweak}|{n}|{r}|{seen}".encode(), key=key[:64], digest_size=max(8, half // 8 + 1)).digest()
            mask_bits = int.from_bytes(word, "big") & mask
            left, right = (right ^ mask_bits, left) if back else (right, left ^ mask_bits)
        v = left << half | right
        if v < n:
            return v


def successor(key: bytes, tweak: str, n: int, v: int, group: Callable[[int], object] = lambda v: True) -> int:
    """The next value after v, among those of v's own ``group``, in a keyed cyclic order of 0..n-1: one-to-one for every v."""
    at, own = _number(key, tweak, n, v, True), group(v)
    for _ in range(n):
        at = (at + 1) % n
        found = _number(key, tweak, n, at, False)
        if group(found) == own:
            return found
    return v


def reform(key: bytes, kind: str, value: str, group: Callable[[str], object] = lambda s: True) -> str:
    """A value of the same form and ``group``: every character of a class becomes another of that class; the rest, and case, stay."""
    low = [c.lower() if len(c.lower()) == 1 else c for c in value]
    classes = [_CLASS_OF.get(c) for c in low]
    shape = "".join(str(CLASSES.index(k)) if k else c for c, k in zip(low, classes, strict=True))
    n, v = 1, 0
    for c, k in zip(low, classes, strict=True):
        if k:
            n, v = n * len(k), v * len(k) + k.index(c)
    if n < 2:
        return value

    def spell(x: int) -> str:
        out = []
        for c, k in zip(reversed(low), reversed(classes), strict=True):
            if k:
                x, at = divmod(x, len(k))
                c = k[at]
            out.append(c)
        return "".join(reversed(out))

    new = spell(successor(key, f"{kind}|{shape}", n, v, lambda x: group(spell(x))))
    return "".join(c.upper() if old != old.lower() else c for c, old in zip(new, value, strict=True))


def _luhn(digits: str) -> int:
    """The check digit that ``digits`` asks for."""
    total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    return -total % 10


def _refill(value: str, digits: str) -> str:
    """``value`` with its letters and digits replaced in turn; separators stay."""
    fresh = iter(digits)
    return "".join(next(fresh) if c.isalnum() else c for c in value)


def _email(key: bytes, local: str, domain: str) -> str:
    *labels, top = domain.split(".")
    labels = [x if x.lower() in _PLAIN_LABELS else reform(key, "host", x, lambda s: s not in _PLAIN_LABELS) for x in labels]
    return f"{reform(key, 'mailbox', local)}@{'.'.join([*labels, top])}"


def _card(key: bytes, value: str) -> str:
    d = re.sub(r"\D", "", value)
    off = (int(d[-1]) - _luhn(d[:-1])) % 10
    body = d[0] + reform(key, "card", d[1:-1])
    return _refill(value, body + str((_luhn(body) + off) % 10))


def _iban(key: bytes, value: str) -> str:
    d = value.replace(" ", "")
    body = reform(key, f"iban{d[:2]}", d[4:])
    as_digits = "".join(str(int(c, 36)) for c in body + d[:2] + "00")
    return _refill(value, f"{d[:2]}{98 - int(as_digits) % 97:02d}{body}")


def _is_iban(value: str) -> bool:
    d = value.replace(" ", "")
    return 15 <= len(d) <= 34 and int("".join(str(int(c, 36)) for c in d[4:] + d[:4])) % 97 == 1


def _ip(key: bytes, value: str) -> str:
    v = int(ipaddress.IPv4Address(value))
    for net in map(ipaddress.IPv4Network, ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "0.0.0.0/8", "224.0.0.0/4", "240.0.0.0/4")):
        if ipaddress.IPv4Address(v) in net:
            base = int(net.network_address)
            return str(ipaddress.IPv4Address(base + successor(key, f"ip{base}", net.num_addresses, v - base)))
    return str(ipaddress.IPv4Address(successor(key, "ip", 1 << 32, v, _public)))


def _public(v: int) -> bool:
    a, b = v >> 24, v >> 16 & 255
    return 0 < a < 224 and a not in (10, 127) and not (a == 172 and 16 <= b < 32) and not (a == 192 and b == 168)


def _ip6(key: bytes, value: str) -> str:
    """Another address below the same sixteen leading bits."""
    v, low = int(ipaddress.IPv6Address(value)), 1 << 112
    new = str(ipaddress.IPv6Address(v // low * low + successor(key, f"ip6{v // low}", low, v % low)))
    return new.upper() if value.isupper() else new


def _phone(key: bytes, value: str) -> str:
    d = re.sub(r"\D", "", value)
    if len(d) == 11 and d[0] == "1" or len(d) == 10 and not value.startswith("+"):  # +1 is understood where it is left out
        return _refill(value, d[:-10] + reform(key, "phone1", d[-10:], lambda s: (s[0] > "1", s[3] > "1")))
    return _refill(value, d[:2] + reform(key, f"phone{d[:2]}", d[2:]))


def _given(key: bytes, name: str, gender: str) -> str:
    low = name.lower()
    for (script, g), names in GIVEN.items():
        if low in names and gender in ("", g):
            new = names[successor(key, f"given{script}{g}", len(names), names.index(low))]
            return new.upper() if name.isupper() else new.title()
    taken = {n for (_, g), names in GIVEN.items() if gender in ("", g) for n in names}
    return reform(key, "given", name, lambda s: s not in taken)


@lru_cache(maxsize=100_000)
def surrogate(key: bytes, kind: str, value: str) -> str:
    """The replacement of a value as found; ``kind`` of a given name carries its gender after a colon."""
    if kind == "email":
        return _email(key, *value.rsplit("@", 1))
    if kind == "ssn":
        return _refill(value, reform(key, kind, re.sub("[ -]", "", value), lambda s: s[:3] not in ("000", "666") and s[0] < "9" and s[3:5] != "00" and s[5:] != "0000"))
    if kind.startswith("given"):
        return _given(key, value, kind.partition(":")[2])
    if kind.startswith("initial"):
        _, gender, name = kind.split(":")
        return _given(key, name, gender)[0].upper()
    by = {"card": _card, "iban": _iban, "ip": _ip, "ip6": _ip6, "phone": _phone}.get(kind)
    return by(key, value) if by else reform(key, kind, value)


def canonical(kind: str, value: str) -> str:
    """What two spellings of one value have in common."""
    if kind in ("card", "ssn", "phone", "iban"):
        plain = re.sub(r"[\W_]", "", value)
        return plain[1:] if kind == "phone" and len(plain) == 11 and plain[0] == "1" else plain
    return ipaddress.IPv6Address(value).exploded if kind == "ip6" else value.lower()


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, stop, kind, value) in order of place, without overlaps."""
    found: list[tuple[int, int, int, str]] = []

    def add(m: re.Match, rank: int, kind: str, group: int = 0) -> None:
        if m.group(group):
            found.append((m.start(group), rank, m.end(group), kind))

    if "@" in text:
        for m in _EMAIL.finditer(text):
            add(m, 0, "email")
    for m in _SECRET.finditer(text) if "AKIA" in text or "=" in text or ":" in text else ():
        add(m, 1, "secret", 2 if m[2] else 4)
    if _DIGIT.search(text):
        for m in _IBAN.finditer(text):
            if _is_iban(m[0]):
                add(m, 2, "iban")
        for m in _CARD.finditer(text):
            d = re.sub(r"\D", "", m[0])
            if _luhn(d[:-1]) == int(d[-1]) or len(d) in (15, 16) and d[0] in "23456":
                add(m, 3, "card")
        for rank, kind, pattern in ((4, "ssn", _SSN), (5, "ip", _IP)):
            for m in pattern.finditer(text):
                add(m, rank, kind)
        for m in _LABELLED_SSN.finditer(text):
            add(m, 4, "ssn", 1)
        for m in _IP6.finditer(text) if ":" in text else ():
            try:
                ipaddress.IPv6Address(m[0])
            except ValueError:
                continue
            if m[0].count(":") > 2 and _DIGIT.search(m[0]):
                add(m, 5, "ip6")
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                add(m, 6, "phone")
    names: dict[str, str] = {}  # parts of names in lower case, and their kind
    whole: dict[str, tuple[str, str]] = {}  # surname: given name and its gender

    def name(m: re.Match, gender: str, given: int, last: int) -> None:
        if given and m[given]:
            add(m, 7, f"given:{gender}", given)
            names.setdefault(m[given].lower(), f"given:{gender}")
            whole.setdefault(m[last].lower(), (m[given], gender))
        add(m, 7, "surname", last)
        names.setdefault(m[last].lower(), "surname")

    if any(t in text for t in _MARKS):
        for m in _NAME.finditer(text):
            name(m, _GENDER_OF.get(m[1] or "", ""), 3 if m[4] else 0, 4 if m[4] else 3)
    if any(t in text for t in _SOME_GIVEN):
        for m in _LISTED.finditer(text):
            if len(m[2]) > 2:
                name(m, names.get(m[1].lower(), "given:" + _GENDER_OF_GIVEN[m[1].lower()]).partition(":")[2], 1, 2)
    if names:  # every further mention in this text, in either spelling
        for m in _mentions(tuple(sorted(names))).finditer(text):
            add(m, 8, names[m[2].lower()], 2)
            given, gender = whole.get(m[2].lower(), ("", ""))
            if m[1] and given[:1].lower() == m[1].lower():
                add(m, 8, f"initial:{gender}:{given.lower()}", 1)
    out, at = [], 0
    for start, _, stop, kind in sorted(found):
        if start >= at:
            out.append((start, stop, kind, text[start:stop]))
            at = stop
    return out


@lru_cache(maxsize=1_000)
def _mentions(names: tuple[str, ...]) -> re.Pattern:
    """Names as they are written: with a capital or in capitals, perhaps after an initial."""
    forms = {form for n in names for form in (n.title(), n.capitalize(), n.upper())}
    return re.compile(rf"(?<!\w)(?:([^\W\d_])\.(?: |(?=\S)))?({'|'.join(map(re.escape, sorted(forms, key=len, reverse=True)))})(?!\w)")


_MARKS = tuple(f"{t}{mark}" for t in _GENDER_OF for mark in (" ", ". ")) + ("ame: ", "ame is ", "AME: ")


def rewrite(text: str, key: bytes) -> tuple[str, int]:
    """The text with surrogates, and the number of entities replaced."""
    found = entities(text)
    if not found:
        return text, 0
    out, at = [], 0
    for start, stop, kind, value in found:
        out += [text[at:start], surrogate(key, kind, value)]
        at = stop
    return "".join([*out, text[at:]]), len(found)


def entity_table(documents: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """Distinct ``kind, value, surrogate`` (in canonical spelling) of all documents; tasks send each value once."""
    schema = pa.schema([("kind", pa.string()), ("value", pa.string()), ("surrogate", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = {(kind, value) for part in slices(batch) for t in part.column(0).to_pylist() if t for _, _, kind, value in entities(t)}
            rows = {(k.partition(":")[0], canonical(k, v), canonical(k, surrogate(key, k, v))) for k, v in seen if not k.startswith("initial")}
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], schema=schema)

    return documents.select(documents[text_col].cast("string").alias("text")).mapInArrow(run, "kind string, value string, surrogate string").distinct()


def collisions(table: DataFrame) -> DataFrame:
    """Surrogates that stand for more than one value, or values with more than one surrogate, or equal to their own value.

    A given name whose gender is not told (``Dr``) may have a surrogate for each gender; it is left out of the second rule.
    """
    shared = table.groupBy("kind", "surrogate").agg(F.count_distinct("value").alias("n")).where("n > 1").select("kind", F.col("surrogate").alias("what"))
    split = table.where("kind <> 'given'").groupBy("kind", "value").agg(F.count("*").alias("n")).where("n > 1").select("kind", F.col("value").alias("what"))
    same = table.where("value = surrogate").select("kind", F.col("value").alias("what"))
    return shared.unionAll(split).unionAll(same)


def pseudonymise(documents: DataFrame, key: bytes, text_col: str = "text", count_col: str | None = None, length_col: str | None = None,
                 check: bool = True) -> DataFrame:
    """The documents with surrogates in ``text_col``; ``count_col`` adds the number of entities, ``length_col`` is set to the new length.

    ``check`` first runs the collision check over all documents and raises if it finds anything.
    """
    if not key:
        raise ValueError("surrogates need a key")
    if length_col is not None and length_col not in documents.columns:
        raise ValueError(f"no column {length_col}")
    if count_col is not None:
        documents = documents.drop(count_col)
    if check:
        found = collisions(written(entity_table(documents, key, text_col), "entities")).limit(5).collect()
        if found:
            raise ValueError(f"surrogates collide, use another key: {[tuple(r) for r in found]}")
    schema = documents.schema if count_col is None else type(documents.schema)([*documents.schema, *documents.sparkSession.createDataFrame([], f"`{count_col}` long").schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                at, done = part.schema.get_field_index(text_col), [(None, 0) if t is None else rewrite(t, key) for t in part.column(text_col).to_pylist()]
                columns = [pa.array([d[0] for d in done], part.schema.field(at).type) if i == at else c for i, c in enumerate(part.columns)]
                if length_col is not None:
                    i = part.schema.get_field_index(length_col)
                    old = part.column(i).to_pylist()
                    columns[i] = pa.array([len(d[0]) if d[1] else o for d, o in zip(done, old, strict=True)], part.schema.field(i).type)
                names = part.schema.names
                if count_col is not None:
                    columns, names = [*columns, pa.array([d[1] for d in done], pa.int64())], [*names, count_col]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return documents.mapInArrow(run, schema)
