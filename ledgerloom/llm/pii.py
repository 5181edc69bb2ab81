"""Keyed surrogates for personal data.

Entities (e-mail addresses, secrets, account numbers, IP addresses, card, phone
and national numbers, persons after a title) are found by pattern; a person's
names are then found without a title too, in the same text. A keyed hash of an
entity's normal form draws a surrogate of the same type and format: signs stay
in place, digits stay digits, letters keep their case, country codes stay, check
digits stay right or wrong as they were, a person's name parts keep script and the
gender that titles tell. The same entity has the same surrogate everywhere,
however it is written and whatever the title: a name's gender is what all titles
of the corpus tell of it together, and none if they disagree.

A name is all capitalised words that follow a title, with hyphens, apostrophes,
initials and particles between them. Particles, initials and prefixes such as O'
stay; words after the first are given names up to the last, or to a particle, and family
names from there on. A capitalised word right after a name counts as part of it,
unless it is a title or a common short word.

A check over all distinct entities of the corpus draws anew wherever two of
them would share a surrogate, or a surrogate is itself an entity of the corpus,
so different entities stay different. Spaces grow from draw to draw, so that it
ends however crowded a format is.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

KINDS = ("email", "secret", "iban", "ip", "card", "national", "phone", "person")
#: Draws after which surrogates grow by a syllable or sign, so that a crowded format never runs out.
GROW_EVERY = 3

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: From where a run of signs begins, so that long runs without @ are read once; letters of any script, marks on them too.
_EMAIL = re.compile(r"(?<![\w\u0300-\u036f.%+-])[._%+-]*([^\W_][\w\u0300-\u036f.%+-]*@[\w\u0300-\u036f-]+(?:\.[\w\u0300-\u036f-]+)*\.[^\W\d_]{2,})")
_SECRET = re.compile(r"(?i)\b(?:token|secret|password|passwd|api[_-]?key)\b\s*[:=]\s*[\"']?([A-Za-z0-9_+/=-]{12,})|(?<![A-Za-z0-9])([0-9a-f]{32,})(?![A-Za-z0-9])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_IP = re.compile(rf"(?<![0-9.])({_OCTET}(?:\.{_OCTET}){{3}})(?![0-9]|\.[0-9])")
_IP6 = re.compile(r"(?<![\w:.])(?=[A-Fa-f:]*[0-9])((?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{0,4})(?![\w:.])")
_CARD = re.compile(r"(?<![\w.+-])(?!00)([0-9](?:[ -]?[0-9]){12,18})(?![\w-])")
#: Social security numbers of the USA, and national insurance numbers of the United Kingdom.
_NATIONAL = re.compile(r"(?<![\w-])((?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}|[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z](?: ?[0-9]{2}){3} ?[A-D])(?![\w-])")
_PHONE = re.compile(r"(?<![\w.])((?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4})(?![\w-])")
#: Numbers with a country code, in groups of any lengths.
_ABROAD = re.compile(r"(?<![\w.+])((?:\+|00)[1-9][0-9]{0,2}[ .-](?:\(?[0-9]{1,5}\)?[ .-]?){1,4}[0-9]{2,5})(?![\w-])")
#: Country codes of one and of two digits; all others have three.
_CODE_1, _CODE_2 = "17", "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
#: Titles that tell a gender, and titles that do not.
_MALE = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "Господин", "Κύριος")
_FEMALE = ("Mrs", "Ms", "Miss", "Lady", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Sra", "Señorita", "Doña", "Госпожа", "Κυρία")
_EITHER = ("Dr", "Prof", "Professor", "Доктор", "Профессор")
_TITLES = frozenset((*_MALE, *_FEMALE, *_EITHER))
#: Words within names that are written small, and capitalised words that end a name.
_PARTICLES = frozenset("van von der den ter ten zu zum zur vom am de del della di da do dos das du des la le los las y e bin ibn bint ben al el d l af av".split())
_STOPS = frozenset("The An And Or But Of In On At To For From With By As Is Was Are Were Has Had Have Will Said Who He She It They We You His Her My Our Und Oder Im Am Ist War Et Ou Est Dans El En Los И В На".split())
_TITLE = re.compile(rf"\b({'|'.join(sorted(_TITLES, key=len, reverse=True))})\b\.?(?=[ \u00a0])")
_PIECE = re.compile(r"([ \u00a0'’-])([^\W\d_]+)")
_WORD = re.compile(r"(?<![^\W_])[^\W\d_]{2,}(?![^\W_])")
_DIGIT = re.compile("[0-9]")


def _luhn(digits: str) -> int:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _ip6(text: str) -> str | None:
    """All 32 digits of an address of version 6, in groups; None for other texts and for addresses that belong to nobody."""
    try:
        address = ipaddress.IPv6Address(text)
    except ValueError:
        return None
    return None if address.is_loopback or address.is_unspecified or address.is_multicast else address.exploded


def _role(roles: set[str]) -> str:
    """One role of a name that was seen in these: m or f if titles agree, u if none tells or they don't, s if it is only a family name."""
    given = roles - {"s"}
    return "u" if {"m", "f"} <= given else next((r for r in "mfu" if r in given), "s")


def _after(text: str, at: int, gender: str) -> tuple[list[tuple[str, str]], int]:
    """((name, role) of the name that stands from a place on, where it ends)."""
    groups: list[list[str]] = []
    family = None  # the group that follows the first particle
    while m := _PIECE.match(text, at):
        sign, word = m[1], m[2]
        apart = sign not in "-'’"
        if apart and word in _TITLES:
            if groups:
                break
            gender = "m" if word in _MALE else "f" if word in _FEMALE else gender
            at = m.end() + (text[m.end() : m.end() + 1] == ".")
        elif word in _PARTICLES:
            family = len(groups) if family is None else family
            at = m.end()
        elif word[0].islower() or (apart and word in _STOPS):
            break
        elif len(word) == 1 and word.isupper():
            at = m.end() + (text[m.end() : m.end() + 1] == ".")
            if not apart:
                continue
        else:
            if apart or not groups:
                groups.append([])
            groups[-1].append(word.casefold())
            at = m.end()
    last = len(groups) - 1 if family is None else max(0, min(family, len(groups) - 1))
    return [(word, "s" if i >= last else gender) for i, group in enumerate(groups) for word in group], at


def _persons(text: str) -> list[tuple[int, int, str, str]]:
    """Names after titles, and the same names elsewhere in the text."""
    roles: dict[str, set[str]] = {}
    at = 0
    while m := _TITLE.search(text, at):
        found, at = _after(text, m.end(), "m" if m[1] in _MALE else "f" if m[1] in _FEMALE else "u")
        for name, role in found:
            roles.setdefault(name, set()).add(role)
    if not roles:
        return []
    words = ((m, m[0].casefold()) for m in _WORD.finditer(text) if not m[0][0].islower())
    return [(*m.span(), "person", f"{_role(roles[name])}:{name}") for m, name in words if name in roles and m[0] not in _TITLES]


def _small(c: str) -> str:
    """A sign in lower case, if that is one sign too."""
    return c.lower() if len(c.lower()) == 1 else c


def _number(text: str) -> str:
    """Digits of a phone number, after a + if it has a country code."""
    digits = re.sub("[^0-9]", "", text)
    return "+" + digits if text[0] == "+" else "+" + digits[2:] if text[:2] == "00" else digits


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form) of the entities of a text, in order, none overlapping; earlier kinds win."""
    found: list[tuple[int, int, str, str]] = []
    if "@" in text:
        found += [(*m.span(1), "email", "".join(map(_small, m[1]))) for m in _EMAIL.finditer(text)]
    for m in _SECRET.finditer(text):
        g = 1 if m[1] else 2
        found.append((*m.span(g), "secret", m[g]))
    if _DIGIT.search(text):
        ibans = ((m, m[1].replace(" ", "")) for m in _IBAN.finditer(text))
        found += [(*m.span(1), "iban", x) for m, x in ibans if 15 <= len(x) <= 34 and _mod97(x) == 1]
        found += [(*m.span(1), "ip", m[1]) for m in _IP.finditer(text)]
        found += [(*m.span(1), "card", re.sub("[^0-9]", "", m[1])) for m in _CARD.finditer(text)]
        found += [(*m.span(1), "national", re.sub("[ -]", "", m[1])) for m in _NATIONAL.finditer(text)]
        found += [(*m.span(1), "phone", x) for p in (_ABROAD, _PHONE) for m in p.finditer(text) if 7 <= len(x := _number(m[1])) <= 16]
    if "::" in text or text.count(":") > 6:
        found += [(*m.span(1), "ip", x) for m in _IP6.finditer(text) if (x := _ip6(m[1]))]
    found += _persons(text)
    out: list[tuple[int, int, str, str]] = []
    taken = bytearray(len(text))
    for e in sorted(found, key=lambda e: (KINDS.index(e[2]), e[0])):
        a, b = e[:2]
        if taken.find(1, a, b) < 0:
            taken[a:b] = b"\x01" * (b - a)
            out.append(e)
    return sorted(out)


class _Draw:
    """A stream of small numbers from a keyed hash."""

    def __init__(self, key: bytes, kind: str, normal: str, attempt: int):
        self.seed = hmac.new(key, f"{kind}\x00{normal}\x00{attempt}".encode(), hashlib.sha256).digest()
        self.pool, self.n = b"", 0

    def below(self, limit: int) -> int:
        if len(self.pool) < 4:
            self.pool += hashlib.sha256(self.seed + self.n.to_bytes(4, "big")).digest()
            self.n += 1
        x, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return x % limit


#: Script to (onsets, vowels, endings of male, female, and family names, and of names that tell no gender).
_SYLLABLES = {
    "LATIN": ("b d f g k l m n p r s t v".split(), "a e i o u".split(), ("n", "r", "s"), ("a", "ia", "ina"), ("er", "man", "son"), ("le", "ry", "kie")),
    "CYRILLIC": ("б в г д з к л м н п р с т".split(), "а е и о у".split(), ("н", "р", "с"), ("а", "ия", "ина"), ("ов", "ин", "ко"), ("ли", "ше", "ню")),
    "GREEK": ("β γ δ κ λ μ ν π ρ σ τ".split(), "α ε ι ο υ".split(), ("ος", "ης", "ας"), ("α", "η", "ια"), ("ου", "ης", "ιδης"), ("λι", "νω", "φυ")),
}


def _name(draw: _Draw, role: str, original: str, more: int = 0) -> str:
    script = next((s for c in original for s in _SYLLABLES if unicodedata.name(c, "").startswith(s)), None)
    if script is None:  # another script: each letter becomes another of its block
        return "".join(chr(ord(c) - ord(c) % 16 + draw.below(16)) if c.isalpha() else c for c in original + original[-1:] * more)
    onsets, vowels, male, female, family, either = _SYLLABLES[script]
    n = max(2, min(4, (len(original) + 1) // 3)) + more
    body = "".join(onsets[draw.below(len(onsets))] + vowels[draw.below(len(vowels))] for _ in range(n))
    endings = {"m": male, "f": female, "s": family, "u": either}[role]
    if role == "f":
        body = body[:-1]
    return body + endings[draw.below(len(endings))]


def surrogate(key: bytes, kind: str, normal: str, attempt: int = 0) -> str:
    """The surrogate's normal form; later attempts draw from larger spaces."""
    draw, more = _Draw(key, kind, normal, attempt), attempt // GROW_EVERY
    late = max(0, more - 2)  # card and national numbers keep their length longer
    if kind == "person":
        role, _, name = normal.partition(":")
        return f"{role}:{_name(draw, role, name, more)}"
    if kind == "iban":
        # longer numbers keep their country and stay within 34 signs, in groups of four
        body = "".join(str(draw.below(10)) if c.isdigit() else chr(65 + draw.below(26)) for c in normal[4:] + "0" * min(4 * more, (34 - len(normal)) // 4 * 4))
        return f"{normal[:2]}{98 - _mod97(normal[:2] + '00' + body):02d}{body}"
    if kind == "national" and normal[0].isdigit():
        area = 1 + draw.below(897)  # 666 is given to nobody
        return f"{area + (area >= 666):03d}{1 + draw.below(99):02d}{1 + draw.below(9999):04d}" + "".join(str(draw.below(10)) for _ in range(late))
    if kind == "national":
        letters = ("ABCEGHJKLMNOPRSTWXYZ", "ABCEGHJKLMNPRSTWXYZ", "ABCD")
        one, two, end = (x[draw.below(len(x))] for x in letters)
        return one + two + "".join(str(draw.below(10)) for _ in range(6 + late)) + end
    if kind == "ip" and ":" in normal:
        # groups keep their number of digits but grow, from the last, when crowded; zeros stay
        groups = [g.lstrip("0") for g in normal.split(":")]
        for i in range(min(more, 8)):
            groups[-1 - i] = "ffff"
        return ":".join(("123456789abcdef"[draw.below(15)] + "".join("0123456789abcdef"[draw.below(16)] for _ in g[1:])).rjust(4, "0") if g else "0000" for g in groups)
    if kind == "ip" and more:
        return ".".join(str(draw.below(256) if i else 1 + draw.below(223)) for i in range(4))
    if kind == "ip":
        # octets keep their number of digits, and the first stays clear of 0 and 224 up
        low, most = {1: 1, 2: 10, 3: 100}, {1: 9, 2: 90, 3: 124}
        return ".".join(str(low[len(p)] + draw.below(most[len(p)])) for p in normal.split("."))
    if kind == "email":
        user, _, domain = normal.partition("@")
        head, _, top = domain.rpartition(".")
        return "".join(_sign(draw, c) for c in user + "x" * more) + "@" + "".join(_sign(draw, c) for c in head) + "." + top
    if kind == "secret":
        if not any(map(str.isalnum, normal)):
            return "".join("_+/=-"[draw.below(5)] for _ in normal + "x" * more)
        digits = "0123456789abcdef" if re.fullmatch("[0-9a-f]+", normal) else None
        return "".join(digits[draw.below(16)] if digits else _sign(draw, c) for c in normal + "x" * more)
    kept = 1 if kind == "phone" else 0
    if normal[0] == "+":
        kept = 2 if normal[1] in _CODE_1 else 3 if normal[1:3] in _CODE_2 else 4
    check = _luhn(normal) if kind == "card" else 0
    normal += "0" * late if kind == "card" else ""
    out = normal[:kept] + "".join(str(draw.below(10)) for _ in normal[kept:])
    if kind == "phone":
        out += "".join(str(draw.below(10)) for _ in range(more))
    if kind == "card":
        out = str(1 + draw.below(9)) + out[1:]
        # the last digit makes the check sum right if it was, and wrong by as much if not
        out = out[:-1] + str((int(out[-1]) + check - _luhn(out)) % 10)
    return out


def _sign(draw: _Draw, c: str) -> str:
    if c.isdigit():
        return str(draw.below(10))
    if c.isalpha() and (c.isascii() or unicodedata.name(c, "").startswith("LATIN")):
        return chr((97 if c.islower() else 65) + draw.below(26))
    if c.isalpha() or unicodedata.combining(c):
        return _other(draw, c)
    return c


def _other(draw: _Draw, c: str) -> str:
    """Another letter of the same script; of scripts without lists, and of marks, another sign of the same block of 16 that is one too."""
    lists = next((x for s, x in _SYLLABLES.items() if unicodedata.name(c, "").startswith(s)), None)
    if lists:
        signs = [*lists[0], *lists[1]]
    else:
        block = ord(c) - ord(c) % 16
        signs = [x for x in map(chr, range(block, block + 16)) if (x.isalpha(), unicodedata.category(x)) == (c.isalpha(), unicodedata.category(c))]
    return signs[draw.below(len(signs))]


def written(original: str, kind: str, replacement: str) -> str:
    """A surrogate's normal form in the format of one occurrence."""
    if kind == "person":
        name = replacement.partition(":")[2]
        return name.upper() if original.isupper() else name.capitalize()
    if kind in ("card", "phone", "iban", "national"):
        abroad = original[:2] == "00" and replacement[0] == "+"
        original, before = (original[2:], "00") if abroad else (original, "")
        signs = iter(replacement.removeprefix("+"))
        return before + "".join(next(signs) if c.isalnum() else c for c in original) + "".join(signs)
    if kind == "ip" and ":" in replacement:
        new = ipaddress.IPv6Address(replacement).compressed if "::" in original else ":".join(g.lstrip("0") or "0" for g in replacement.split(":"))
        new = replacement if len(original) == len(replacement) else new
        return new.upper() if original.isupper() else new
    if kind == "email":
        user, at = original.index("@"), replacement.index("@")
        original = original[:user] + "x" * (at - user) + original[user:]
        return "".join(r.upper() if o.isupper() and len(r.upper()) == 1 else r for o, r in zip(original, replacement, strict=True))
    return replacement


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(t, *e) for t, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for e in sorted({e[2:] for e in find(text or "")})]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.record_batch(
            [pa.array(columns[0], b.schema.field(0).type), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())],
            names=["t", "kind", "normal"],
        )


def _drawn(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, normal, attempt = (b.column(c).to_pylist() for c in ("kind", "normal", "attempt"))
            s = [surrogate(key, *x) for x in zip(kind, normal, attempt, strict=True)]
            yield pa.record_batch([b.column("kind"), b.column("normal"), b.column("attempt"), pa.array(s, pa.string())], names=["kind", "normal", "attempt", "surrogate"])

    return run


def _shown(normal: Column) -> Column:
    """What readers see of a normal form: two names that differ in their role alone look the same."""
    return F.when(F.col("kind") == "person", F.substring_index(normal, ":", -1)).otherwise(normal)


def redrawn(entities: DataFrame, key: bytes, scratch: Scratch) -> DataFrame:
    """(kind, normal, attempt) of the distinct entities whose first surrogate is taken.

    Of entities that draw one surrogate the first in order keeps it; the others,
    and those that draw an entity of the corpus, draw again against all that is
    kept. Each round handles only what is left, and spaces grow, so that rounds end.
    """
    real = scratch.save(entities.select("kind", "normal").distinct(), "real")
    names = scratch.save(real.select("kind", _shown(F.col("normal")).alias("shown")).distinct(), "names")
    open_, kept = real.withColumn("attempt", F.lit(0)), None
    for n in count():
        drawn = open_.select("kind", "normal", "attempt").mapInArrow(_drawn(key), "kind string, normal string, attempt int, surrogate string")
        drawn = scratch.save(drawn.withColumn("shown", _shown(F.col("surrogate"))), f"drawn-{n}")
        first = drawn.groupBy("kind", "shown").agg(F.min("normal").alias("normal"))
        # a surrogate that is real, or that an earlier round gave away, has no owner
        first = first.join(names, ["kind", "shown"], "left_anti")
        if kept is not None:
            first = first.join(kept.select("kind", "shown"), ["kind", "shown"], "left_anti")
        owners = scratch.save(first.select("kind", "normal"), f"owners-{n}")
        good = scratch.save(drawn.join(owners, ["kind", "normal"], "left_semi").select("kind", "normal", "attempt", "shown"), f"kept-{n}")
        kept = good if kept is None else kept.unionByName(good)
        open_ = scratch.save(drawn.join(owners, ["kind", "normal"], "left_anti").select("kind", "normal", F.lit(n + 1).alias("attempt")), f"open-{n}")
        scratch.drop(f"drawn-{n}", f"owners-{n}", f"open-{n - 1}")
        if open_.isEmpty():
            return kept.where("attempt > 0").select("kind", "normal", "attempt")


def canonical(entities: DataFrame, scratch: Scratch) -> DataFrame:
    """(kind, normal, canon) of the distinct entities: a name has one canonical form, with the role that all its titles tell together."""
    spelt = scratch.save(entities.select("kind", "normal").distinct(), "spelt")
    names = spelt.where("kind = 'person'").select("normal", F.substring_index("normal", ":", 1).alias("role"), F.substring_index("normal", ":", -1).alias("name"))
    m, f, u = (F.max(F.col("role") == r) for r in "mfu")
    role = F.when(m & f, "u").when(m, "m").when(f, "f").when(u, "u").otherwise("s")
    names = names.join(names.groupBy("name").agg(role.alias("one")), "name").select(F.lit("person").alias("kind"), "normal", F.concat_ws(":", "one", "name").alias("canon"))
    return scratch.save(names.unionByName(spelt.where("kind <> 'person'").withColumn("canon", F.col("normal"))), "canon")


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def _replaced(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, spans = [], []
            for text, changed in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                ways = {(c["kind"], c["normal"]): (c["canon"], c["attempt"]) for c in changed or []}
                drawn: dict[tuple[str, str], str] = {}
                parts, at, out, mine = [], 0, 0, []
                for start, end, kind, normal in find(text or ""):
                    one = (kind, normal)
                    if one not in drawn:
                        drawn[one] = surrogate(key, kind, *ways.get(one, (normal, 0)))
                    new = written(text[start:end], kind, drawn[one])
                    parts += [text[at:start], new]
                    out += start - at
                    mine.append({"start": out, "end": out + len(new), "kind": kind})
                    out, at = out + len(new), end
                texts.append(text if text is None else "".join([*parts, text[at:]]))
                spans.append(mine)
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string()), pa.array(spans, _SPANS)], names=["doc_id", "text", "spans"])

    return run


def surrogates(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """doc_id, text with surrogates, spans (start, end, kind in the new text) of every document.

    Null texts stay null, empty ones empty. Equal texts come back alike, whatever
    their ids; ids may be null, repeated, and of any type. An empty table gives an
    empty one; other columns are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession, "pii")
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.struct(F.xxhash64(text).alias("h"), F.hash(text).alias("g")).alias("t"))
    entities = scratch.save(texts.select("t", "text").mapInArrow(_listed, "t struct<h:bigint,g:int>, kind string, normal string"), "entities")
    canon = canonical(entities, scratch)
    again = scratch.save(redrawn(canon.select("kind", F.col("canon").alias("normal")), key, scratch), "again")
    ways = canon.join(again.select("kind", F.col("normal").alias("canon"), "attempt"), ["kind", "canon"], "left").withColumn("attempt", F.coalesce("attempt", F.lit(0)))
    ways = scratch.save(ways.where("attempt > 0 OR canon <> normal").select("kind", "normal", "canon", "attempt"), "ways")
    changed = entities.join(ways, ["kind", "normal"]).groupBy("t").agg(F.collect_set(F.struct("kind", "normal", "canon", "attempt")).alias("changed"))
    changed = scratch.save(changed, "changed")
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.join(changed, "t", "left").select("doc_id", "text", "changed").mapInArrow(
        _replaced(key), f"doc_id {kind}, text string, spans array<struct<start:bigint,end:bigint,kind:string>>",
    )
