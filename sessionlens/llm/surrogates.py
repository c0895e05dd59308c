"""Personal data and secrets, replaced by surrogates of the same kind.

Entities are found by their form and written in one canonical way, so that all mentions of one entity, in whatever
layout, get the same surrogate, and different entities different ones. A surrogate comes from a keyed hash of the
entity: digits for digits, letters of the same script and case for letters, valid addresses and check digits, names
of the same gender and script. Each mention is then written in its own layout.

Out of reach are names without a title that no titled mention in the same document gives away, the gender of names
but for that of their title, postal addresses and dates of birth, unquoted secrets after a colon that have no digit
and fewer than 16 characters, and secrets that no key, prefix or hexadecimal form tells.

The distinct entities of the whole corpus are checked against each other: a surrogate that another entity has, or
that is itself an entity of the corpus, is drawn again, in rounds of joins, until none is. Spaces grow with the
attempts, so that this ends however many entities there are: see ``surrogate``. Documents are rewritten
where they are read; only those that mention an entity that was drawn again meet a table of new draws.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlens.llm.common import keyed, same_document, slices, text_key, unpacked
from sessionlens.sources.sinks import drop_staged, staged

# Titles and the gender of the name after them (u: unknown).
TITLES = {
    "Mr": "m", "Herr": "m", "Monsieur": "m", "Sr": "m", "Señor": "m", "г-н": "m", "κ": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Sra": "f", "Srta": "f", "Señora": "f",
    "г-жа": "f", "κα": "f", "Dr": "u", "Prof": "u",
}

_SECRET_WORD = r"api[_-]?key|access[_-]?key|secret(?:[_-]?key)?|auth(?:[_-]?token)?|token|passw(?:or)?d|pwd"
_PATTERNS = [
    ("secret", ("PRIVATE KEY",), re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(.*?)-----END [A-Z ]*PRIVATE KEY-----", re.S)),
    ("secret", ('"',), re.compile(rf'\b(?:{_SECRET_WORD})\b["\']?\s*[:=]\s*"(?=[^"\n]*[^\W_])([^"\n]+)"', re.I)),
    ("secret", ("'",), re.compile(rf"\b(?:{_SECRET_WORD})\b[\"']?\s*[:=]\s*'(?=[^'\n]*[^\W_])([^'\n]+)'", re.I)),
    ("secret", ("=",), re.compile(rf"\b(?:{_SECRET_WORD})\b[\"']?\s*=(?!=)\s*(?=[^\s\"',;<>&]*[^\W_])([^\s\"',;<>&]+)", re.I)),
    ("weak secret", ("=", ":"), re.compile(rf"\b(?:{_SECRET_WORD})\b[\"']?\s*[:=]\s*[\"']?([^\s\"',;<>]{{8,}})", re.I)),
    ("secret", ("AKIA", "gh", "xox", "sk-", "eyJ"), re.compile(r"\b(AKIA[0-9A-Z]{16}|gh[pousr]_\w{36,}|xox[abprs]-[\w-]{10,}|sk-[\w-]{20,}|eyJ[\w-]+\.[\w-]+\.[\w-]+)")),
    ("email", ("@",), re.compile(r"([\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,})")),
    ("iban", (), re.compile(r"\b([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?)\b")),
    ("secret", (), re.compile(r"\b([0-9a-f]{32,}|[0-9A-F]{32,})\b")),
    ("ipv6", (":",), re.compile(r"(?<![\w:.])((?:[0-9a-fA-F]{0,4}:){2,8}(?:(?:\d{1,3}\.){3}\d{1,3}|[0-9a-fA-F]{1,4})?)(?![\w:]|\.\d)")),
    ("ipv4", (".",), re.compile(r"(?<![\w.])((?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?!\w|\.\d)")),
    ("card", (), re.compile(r"(?<![\w+])(\d(?:[ -]?\d){12,18})(?![\w-])")),
    ("ssn", ("-",), re.compile(r"(?<![\w-])(\d{3}-\d{2}-\d{4})(?![\w-])")),
    ("phone", (), re.compile(r"(?<![\w+])(\+?\(?\d[\d ()./-]{5,22}\d)(?!\w)")),
]
_DATE = re.compile(r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}|\d{4}\s*[-/]\s*\d{4}")
_DIGIT = re.compile(r"\d")
_NAME = re.compile(r"(?<!\w)(" + "|".join(sorted(TITLES, key=len, reverse=True)) + r")(?:\.\s*|\s+)([^\W\d_][\w'’-]+(?:[ \t]+[^\W\d_][\w'’-]+){0,2})")
GROW = 4  # draws from one space, before it grows
DIGITS = frozenset({"card", "ssn", "phone"})

_ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω")
_SYLLABLES = (("bdfgklmnprstv", "aeiou"), ("бвгдклмнпрст", "аеиоу"), ("βγδκλμνπρστφ", "αειοη"))


def canonical(kind: str, mention: str) -> str:
    """How an entity is written for comparison, whatever the layout of a mention."""
    if kind in DIGITS:
        return re.sub(r"\D", "", mention)
    if kind == "iban":
        return mention.replace(" ", "")
    if kind == "ipv6":
        return str(ipaddress.IPv6Address(int(ipaddress.IPv6Address(mention))))
    return mention if kind == "secret" else mention.lower()


def _ipv6(mention: str) -> bool:
    """Whether it is an address, in any of its forms; words of a to f alone, as in add::bad, are none."""
    try:
        ipaddress.IPv6Address(mention)
    except ValueError:
        return False
    return _DIGIT.search(mention) is not None or "::" not in mention


def _card(mention: str) -> bool:
    """Whether the check digit fits; 13 digits only as the first issuer of such cards has them (others are article and order numbers)."""
    digits = re.sub(r"\D", "", mention)
    return _luhn(digits) == 0 and (len(digits) > 13 or digits[0] == "4")


def _phone(mention: str) -> bool:
    digits = re.sub(r"\D", "", mention)
    n = len(digits)
    if mention.isdecimal() and n > 11 or n == 13 and digits[:3] in ("978", "979"):  # running, order and book numbers
        return False
    laid_out = mention[0] in "+(" or n >= 9 or re.fullmatch(r"\d{3}[-. ]\d{4}", mention)
    return bool(laid_out) and 7 <= n <= 15 and not _DATE.fullmatch(mention.strip())


def mentions(text: str) -> list[tuple[int, int, str]]:
    """(start, stop, kind) of the entities in a text, in order, without overlaps; earlier patterns go first."""
    found: list[tuple[int, int, str]] = []
    taken = bytearray()

    def add(start: int, stop: int, kind: str) -> None:
        nonlocal taken
        taken = taken or bytearray(len(text))
        if stop > start and not any(taken[start:stop]):
            taken[start:stop] = b"\1" * (stop - start)
            found.append((start, stop, kind))

    digits = _DIGIT.search(text) is not None
    for kind, signs, pattern in _PATTERNS:
        if any(s in text for s in signs) if signs else digits:
            for m in pattern.finditer(text):
                value = m[1]
                if kind == "card" and not _card(value) or kind == "phone" and not _phone(value) or kind == "ipv6" and not _ipv6(value) or kind == "weak secret" and not (_DIGIT.search(value) or len(value) >= 16):
                    continue
                add(*m.span(1), kind.removeprefix("weak "))
    families, given = set(), {}
    if any(t in text for t in TITLES):
        for m in _NAME.finditer(text):
            parts = [p for p in re.finditer(r"\S+", m[2])]
            names = []
            for p in parts:
                if not p[0][0].isupper():
                    break
                names.append(p)
            for i, p in enumerate(names):
                kind = "given_" + TITLES[m[1]] if i == 0 and len(names) > 1 else "family"
                stop = p.end() - len(p[0]) + len(p[0].rstrip("'’-"))
                add(m.start(2) + p.start(), m.start(2) + stop, kind)
                if kind == "family":
                    families.add(p[0].rstrip("'’-"))
                elif kind != "given_u":
                    given.setdefault(p[0].rstrip("'’-").lower(), kind)
    for name in families:  # later mentions without a title
        for m in re.finditer(rf"(?<!\w){re.escape(name)}(?!\w)", text):
            add(*m.span(), "family")
    if given:  # a title that says nothing of the gender: as elsewhere in the text
        found = [(a, b, given.get(text[a:b].lower(), k) if k == "given_u" else k) for a, b, k in found]
    return sorted(found)


class _Stream:
    """Whole numbers below a bound, one after another, from a keyed hash."""

    def __init__(self, key: bytes, *parts: object):
        self.key, self.seed, self.at, self.pool = key, "\x1f".join(map(str, parts)).encode(), 0, 1
        self.rest = 0

    def below(self, n: int) -> int:
        if self.pool < n << 64:
            block = hashlib.blake2b(self.seed + self.at.to_bytes(8, "big"), key=self.key, digest_size=64).digest()
            self.rest, self.pool, self.at = int.from_bytes(block, "big"), 1 << 512, self.at + 1
        self.rest, value = divmod(self.rest, n)
        self.pool //= n
        return value


def _script(letter: str) -> int:
    return 1 if "Ѐ" <= letter <= "ӿ" else 2 if "Ͱ" <= letter <= "Ͽ" else 0


def _same_shape(value: str, stream: _Stream) -> str:
    """Digits for digits, letters of the same script and case for letters, all else as it is; hex stays hex."""
    hexadecimal = len(value) >= 16 and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value)
    out = []
    for c in value:
        if hexadecimal:
            out.append("0123456789ABCDEF"[stream.below(16)] if value.upper() == value else "0123456789abcdef"[stream.below(16)])
        elif c.isdecimal():
            out.append(str(stream.below(10)))
        elif c.isalpha():
            alphabet = _ALPHABETS[_script(c.lower())]
            new = alphabet[stream.below(len(alphabet))]
            out.append(new.upper() if c.isupper() else new)
        else:
            out.append(c)
    return "".join(out)


def _luhn(digits: str) -> int:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10


def _digits(entity: str, kind: str, stream: _Stream) -> str:
    out = [str(stream.below(10)) for _ in entity]
    if entity[0] != "0":
        out[0] = str(1 + stream.below(9))
    if kind == "card":  # a valid number stays valid, another stays invalid
        valid = _luhn(entity) == 0
        fitting = [d for d in "0123456789" if (_luhn("".join(out[:-1]) + d) == 0) == valid]
        out[-1] = fitting[stream.below(len(fitting))]
    return "".join(out)


def _ipv4(entity: str, stream: _Stream, attempt: int) -> str:
    """Private addresses stay private: in their network at first, in 10.0.0.0/8 from draw GROW on.

    From draw 2 * GROW on, any address there or, of a public one, below 224; when those are full too, in 0.0.0.0/0.
    """
    own = [int(x) for x in entity.split(".")]
    if attempt >= 4 * GROW:
        return ".".join(str(stream.below(256)) for _ in own)
    keep = 1 if own[0] in (10, 127) else 2 if own[:2] == [192, 168] or own[0] == 172 and 16 <= own[1] < 32 else 0
    if keep and attempt >= GROW and own[0] != 127:
        own, keep = [10], 1
    new = [1 + stream.below(254) if attempt < 2 * GROW else stream.below(256) for _ in range(4)]
    if not keep:
        public = [x for x in range(1, 224) if x not in (10, 127, 172, 192)]
        new[0] = public[stream.below(len(public))]
    return ".".join(map(str, own[:keep] + new[keep:]))


def _name(entity: str, kind: str, stream: _Stream, attempt: int) -> str:
    """Syllables in the script of the name, one more every GROW draws; a vowel at the end for women, a consonant for men."""
    consonants, vowels = _SYLLABLES[_script(entity[0])]
    out = "".join(consonants[stream.below(len(consonants))] + vowels[stream.below(5)] for _ in range(2 + (kind == "family") + attempt // GROW + stream.below(2)))
    if kind == "given_f":
        return out[:-1] + vowels[0]
    return out + consonants[stream.below(len(consonants))] if kind in ("given_m", "family") else out


def surrogate(kind: str, entity: str, key: bytes, attempt: int = 0) -> str:
    """The surrogate of a canonical entity; another one for each attempt.

    Names and IPv4 addresses are drawn from a larger space every GROW attempts. What else is written in digits and
    letters keeps its length for 4 * GROW attempts (GROW if shorter than 8) and then gets one digit more every GROW.
    """
    more = max(0, attempt // GROW - (3 if len(entity) >= 8 else 0))
    stream = _Stream(key, kind, entity, attempt)
    if kind == "email":
        local, domain = entity.rsplit("@", 1)
        host, _, top = domain.rpartition(".")
        return f"{_same_shape(local + '0' * more, stream)}@{_same_shape(host, _Stream(key, 'domain', domain))}.{top}"
    if kind in DIGITS:
        return _digits(entity + "0" * more, kind, stream)
    if kind == "ipv4":
        return _ipv4(entity, stream, attempt)
    if kind == "ipv6":
        new = ":".join(f"{1 + stream.below(65535):x}" for _ in range(8))
        local = re.match(r"fe80:|f[cd]..:", entity)  # link-local and private networks stay so
        return local[0] + new.split(":", 1)[1] if local else new
    if kind == "iban":
        return entity[:2] + _same_shape(entity[2:] + "0" * more, stream)
    return _same_shape(entity + "0" * more, stream) if kind == "secret" else _name(entity, kind, stream, attempt)


def laid_out(kind: str, mention: str, new: str) -> str:
    """A surrogate in the layout of a mention."""
    if kind in DIGITS or kind == "iban":
        rest = iter(new)
        return "".join([next(rest) if c.isdecimal() or kind == "iban" and c != " " else c for c in mention] + list(rest))
    if kind == "email":
        return "".join(n.upper() if c.isupper() else n for c, n in zip(mention, new)) + new[len(mention) :]
    if kind.startswith(("given", "family")):
        return new.upper() if mention.isupper() and len(mention) > 1 else new.capitalize()
    return new


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1024):
        found = set()
        for doc_id, key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "text"))):
            found |= {(doc_id, key, kind, canonical(kind, text[a:b])) for a, b, kind in mentions(text or "")}
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.string(), pa.string()))], ["doc_id", "key", "kind", "entity"])


def settled_surrogates(entities: DataFrame, key: bytes) -> DataFrame:
    """kind, entity, attempt, surrogate: distinct surrogates within a kind, none of them an entity of it."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            new = [surrogate(r["kind"], r["entity"], key, r["attempt"]) for r in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("kind", "entity", "attempt")), pa.array(new, pa.string())], ["kind", "entity", "attempt", "surrogate"])

    taken = entities.select("kind", F.col("entity").alias("surrogate"))
    open_, kept = entities.withColumn("attempt", F.lit(0)), None
    while True:
        drawn = staged(open_.mapInArrow(draw, "kind string, entity string, attempt int, surrogate string"))
        free = drawn.join(taken, ["kind", "surrogate"], "left_anti")
        if kept is not None:
            free = free.join(kept.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        first = free.groupBy("kind", "surrogate").agg(F.min(F.struct("entity", "attempt")).alias("x"))
        won = first.select("kind", "x.entity", "x.attempt", "surrogate")
        onward = staged(won if kept is None else kept.union(won))
        open_ = staged(drawn.join(onward, ["kind", "entity"], "left_anti").select("kind", "entity", (F.col("attempt") + 1).alias("attempt")))
        drop_staged(drawn, *([kept] if kept is not None else []))
        kept = onward
        if open_.isEmpty():
            return kept


def _rewrite(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            texts, counts = [], []
            for text, again in zip(batch.column("text").to_pylist(), batch.column("again").to_pylist()):
                attempts = {(a["kind"], a["entity"]): a["attempt"] for a in again or ()}
                out, at, found = [], 0, mentions(text or "")
                for start, stop, kind in found:
                    entity = canonical(kind, text[start:stop])
                    new = surrogate(kind, entity, key, attempts.get((kind, entity), 0))
                    out += [text[at:start], laid_out(kind, text[start:stop], new)]
                    at = stop
                texts.append("".join([*out, text[at:]]) if found else text)
                counts.append(len(found))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], ["row", "text", "replaced"])

    return run


def replace_personal_data(docs: DataFrame, key: bytes, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with surrogates in ``text``, and ``replaced``, how many mentions that were.

    Null texts stay null, texts without entities stay as they are. Equal entities have equal surrogates in all
    rows, repeated rows included, and for every run with the same ``key`` over the same corpus. All columns are
    kept, whatever their names, but for one named ``replaced``. An empty table gives an empty result.
    """
    rows = keyed(docs, text, doc_id).withColumn("text", F.col("row").getField(text))
    only = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_key(F.col(text)).alias("key"), F.col(text).alias("text"))
    found = staged(only.mapInArrow(_entities, "doc_id long, key long, kind string, entity string"))
    settled = settled_surrogates(staged(found.select("kind", "entity").distinct()), key)
    moved = staged(settled.where("attempt > 0").select("kind", "entity", "attempt"))
    if moved.isEmpty():
        rows = rows.withColumn("again", F.lit(None).cast("array<struct<kind: string, entity: string, attempt: int>>"))
    else:
        again = found.distinct().join(moved, ["kind", "entity"]).groupBy("doc_id", "key").agg(F.collect_set(F.struct("kind", "entity", "attempt")).alias("again"))
        again = staged(again)
        rows = rows.join(again, same_document(rows, again), "left").select("row", "text", "again")
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("text", T.StringType()), T.StructField("replaced", T.LongType())])
    out = rows.select("row", "text", "again").mapInArrow(_rewrite(key), schema)
    return unpacked(out, **{text: F.col("text"), "replaced": F.col("replaced")})
