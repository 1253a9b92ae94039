"""Surrogates for personal data: keyed, type-consistent replacements.

Detected entities (mail addresses, phone and card numbers, IP and MAC addresses,
bank and social security numbers, keys, assigned secrets, names after one or more
titles, with their initials and particles)
are replaced by values of the same format: digits stay digits, letters stay
letters of their case and script, separators stay, check digits of cards and
bank accounts stay as right or wrong as they were, an address stays public or
private, and a first name keeps the gender of its title.

A surrogate is a keyed permutation, without fixed points, of all values of its
format.  So equal entities get equal surrogates in every document (coreference),
different ones different surrogates (distinctness), and none its own; tasks need
no table of what others have given out.  Values of different formats can't read
the same either: a format keeps its separators and letter classes, a value that
is hexadecimal is permuted among those, and names of different alphabets and
genders are spelled so that they can be told apart.  `collisions` checks that
over a whole corpus.

Detection takes time in proportion to the text: no pattern can begin inside a run
that it has already looked through.  A name found after a title is looked for in
the rest of its text too, unless its word also stands there in lower case.  The
gender is the title's; a first name with none (Dr., or untitled only) has the
gender that its ending suggests.

Defined cases: null text stays null and has no entities; text without entities
comes back unchanged; equal texts give equal results; repeated rows are replaced
alike; where two finds overlap, the one that begins first counts, then the
earlier pattern; other columns are passed on; an empty table gives an empty
table.  Whole texts are read, however long; a value of more than CHUNK characters
is permuted piece by piece.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches as B

# Titles by gender.
MALE = "Mr Mister Sir Herr Monsieur Señor Sr".split()
FEMALE = "Mrs Ms Miss Madam Frau Madame Mme Mlle Señora Señorita Sra Doña".split()
NEUTRAL = "Dr Prof Professor".split()

# Small words that belong to a last name.
PARTICLES = "van von de der den del della di da du la le el al bin ibn ten ter zu zur dos das".split()

_NAME = r"[^\W\d_]++(?:[-'’](?!s\b)[^\W\d_]++)?"  # without the 's of "Smith's"
# What every address and every account number has in it.
_LOCAL_HEAD = re.compile(r"\b0[0-9]{2,4} [0-9]{3}")
_DOTTED, _IBAN_HEAD = re.compile(r"[0-9]\.[0-9]{1,3}\.[0-9]"), re.compile(r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}")
_ASSIGNED = r"(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth)"
_PATTERNS: list[tuple[str, re.Pattern, Callable[[str], bool]]] = [
    ("secret", re.compile(rf"(?i)\b{_ASSIGNED}\b[\"']?(?P<gap>\s{{0,8}}[:=]\s{{0,8}})(?P<v>\"[^\"\s]{{4,}}+\"|'[^'\s]{{4,}}+'|[\w+/.=!#$%&*@^~-]{{6,}}+)"), lambda t: "=" in t or ":" in t),
    ("key", re.compile(r"\b(?P<p>AKIA|ASIA|ghp_|gho_|sk-|xoxb-|AIza)(?P<v>[A-Za-z0-9_-]{16,}+)"), lambda t: any(x in t for x in ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "xoxb-", "AIza"))),
    ("email", re.compile(r"(?<![\w.%+-])(?P<v>[\w.%+-]++@[\w-]++(?:\.[\w-]++)++)"), lambda t: "@" in t),
    ("ip", re.compile(r"(?<![\w.])(?P<v>(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9]))(?![\w]|\.[0-9])"), lambda t: "." in t and bool(_DOTTED.search(t))),
    ("ipv6", re.compile(r"(?<![\w:.])(?P<v>[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,8})(?![\w:.]*[\w:])"), lambda t: "::" in t or t.count(":") >= 7),
    ("iban", re.compile(r"\b[A-Z]{2}(?P<v>[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)\b"), lambda t: bool(_IBAN_HEAD.search(t))),
    ("mac", re.compile(r"\b(?P<v>(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2})\b"), lambda t: ":" in t or "-" in t),
    ("ssn", re.compile(r"(?<![\w-])(?P<v>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![\w-])"), lambda t: "-" in t),
    ("card", re.compile(r"(?<![\w.+-])(?P<v>[0-9](?:[ -]?[0-9]){12,18})(?![\w-]|\.[0-9])"), lambda t: True),
    ("phone", re.compile(r"(?<![\w+])(?P<v>\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}|0[0-9]{2,4}[ -][0-9]{3,4}[ -][0-9]{3,4})(?!\w|\.[0-9])"), lambda t: "+" in t or "-" in t or "." in t or bool(_LOCAL_HEAD.search(t))),
]
# Social security and card numbers always have so many digits close together; the other kinds need not.
_DIGITS = re.compile(r"[0-9](?:[^0-9]{0,3}[0-9]){6}")
_NEED_DIGITS = frozenset("ssn card".split())
_TITLES = {t: g for g, titles in (("m", MALE), ("f", FEMALE), ("", NEUTRAL)) for x in titles for t in (x, x.upper())}
_LAST = rf"(?:(?:{'|'.join(PARTICLES)}) ){{0,3}}{_NAME}"
_PERSON = re.compile(rf"\b(?P<title>{'|'.join(_TITLES)})\b\.? (?P<v>{_LAST}(?: [^\W\d_]\.){{0,3}}(?: {_LAST})?)")
_WORDS = re.compile(r"[^\W\d_]+")
_DOMAIN_END = re.compile(r"[^\W\d_]{2,}")

_DIGIT, _LOWER, _UPPER, _HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
_ASCII = {"digit": _DIGIT, "lower": _LOWER, "upper": _UPPER, "hex": _HEX}
_HEXLIKE = re.compile(r"[0-9a-f:-]{12,}")
_ROUNDS = 8
#: Characters of a value that are permuted as one number, and that are permuted at all (the rest are shifted).
CHUNK, PERMUTED = 64, 1024


def _class(c: str) -> str:
    """Script and kind of a character: ASCII digits and letters, or letters and digits of one Unicode script and block."""
    if c in _DIGIT or c in _LOWER or c in _UPPER:
        return "digit" if c in _DIGIT else "lower" if c in _LOWER else "upper"
    kind = unicodedata.category(c)
    if c < "\x80" or kind not in ("Lu", "Ll", "Lo", "Nd"):
        return ""
    return f"{unicodedata.name(c, '?').split(' ')[0]} {kind} {ord(c) >> 8}"


@cache
def _alphabet(name: str) -> str:
    """All characters of a class in order of code point."""
    if name in _ASCII:
        return _ASCII[name]
    block = int(name.rsplit(" ", 1)[1]) << 8
    if name.startswith("any "):
        return "".join(c for c in map(chr, range(block, block + 256)) if c.isprintable() and not c.isspace() and (block or not c.isalnum()))
    if name.startswith("raw "):
        return "".join(map(chr, range(block, block + 256)))
    return "".join(c for c in map(chr, range(block, block + 256)) if _class(c) == name)


@cache
def _class_of(c: str) -> str:
    """The class of a character, "" if it is the only one of it or none."""
    name = _class(c)
    return name if name and len(_alphabet(name)) > 1 else ""


@dataclass(frozen=True)
class Entity:
    kind: str
    value: str
    start: int
    end: int
    gender: str = ""


def _number_kind(value: str) -> str:
    """hex for 12 or more hexadecimal signs with a digit and a letter among them, digits for as many digits, else nothing."""
    if not _HEXLIKE.fullmatch(value):
        return ""
    digit, letter = any(c in _DIGIT for c in value), any(c in _LOWER for c in value)
    return "hex" if digit and letter else "digits" if digit else ""


class Permutation:
    """Keyed permutations of the whole numbers below any n, without fixed points for n > 1."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: bytes, k: int, half: int, bits: int) -> int:
        size = (bits + 7) // 8
        out = b""
        while len(out) < size:
            out += hmac.digest(self.key, b"%d|%d|%d|%d|" % (k, bits, half, len(out)) + tweak, "sha256")
        return int.from_bytes(out[:size], "big") & ((1 << bits) - 1)

    def _network(self, x: int, bits: int, tweak: bytes, back: bool) -> int:
        a, b = x >> bits, x & ((1 << bits) - 1)
        if back:
            for k in reversed(range(_ROUNDS)):
                a, b = b ^ self._round(tweak, k, a, bits), a
            return (a << bits) | b
        for k in range(_ROUNDS):
            a, b = b, a ^ self._round(tweak, k, b, bits)
        return (a << bits) | b

    def _walk(self, x: int, n: int, tweak: bytes, back: bool) -> int:
        bits = max(1, ((n - 1).bit_length() + 1) // 2)
        x = self._network(x, bits, tweak, back)
        while x >= n:
            x = self._network(x, bits, tweak, back)
        return x

    def __call__(self, x: int, n: int, tweak: bytes) -> int:
        """A shift by a keyed amount (odd where n is even, so that its cycles are long), seen through a keyed permutation."""
        if n < 2:
            return x
        shift = int.from_bytes(hmac.digest(self.key, b"shift|%d|" % n + tweak, "sha256"), "big")
        shift = 1 + 2 * (shift % (n // 2)) if n % 2 == 0 else 1 + shift % (n - 1)
        return self._walk((self._walk(x, n, tweak, False) + shift) % n, n, tweak, True)


def _luhn(digits: str) -> int:
    """The check digit of `digits`."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 - k % 2)
        total += d - 9 if d > 9 else d
    return -total % 10


def _iban_check(country: str, account: str) -> int:
    """The two check digits of an account number."""
    return 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97


#: Ranges of addresses that keep to themselves: (first, number), the rest are public.
_RANGES = [(int(ipaddress.ip_address(first)), 1 << bits) for first, bits in (("0.0.0.0", 24), ("10.0.0.0", 24), ("127.0.0.0", 24), ("172.16.0.0", 20), ("192.168.0.0", 16), ("224.0.0.0", 28), ("240.0.0.0", 28))]


def _range(x: int) -> tuple[int, int] | None:
    return next(((first, n) for first, n in _RANGES if first <= x < first + n), None)


# How names are spelled: syllables, and endings that begin with a vowel, so that they can be told from a syllable.
_CONSONANTS, _VOWELS, _ACCENTED = "bcdfghklmnprstvz", "aeiou", "áéíóú"
_ENDINGS = {"f": ("a", "ia", "ina", "elle"), "m": ("o", "us", "en", "ard"), "": ("",)}
_FEMALE_END = re.compile(r"(?:a|ah|ie|ette|elle|ine|lyn)\Z")


class Surrogates:
    def __init__(self, key: bytes):
        self.permute = Permutation(key)

    def _shape(self, kind: str, value: str) -> str:
        """A value of the same classes of characters; a hexadecimal one is permuted among those.

        A long one goes in pieces, each permuted as those before it say; behind
        PERMUTED characters each is shifted in its class by a stream that hangs on
        those.  Either way different values stay different.
        """
        own = _number_kind(value)
        if len(value) <= CHUNK:
            return self._piece(kind, value, own == "hex", own)
        out, before = [], hashlib.sha256(kind.encode())
        for k in range(0, min(len(value), PERMUTED), CHUNK):
            piece = value[k : min(k + CHUNK, PERMUTED)]
            out.append(self._piece(f"{kind}|{k}|{len(value)}|{before.hexdigest()}", piece, own == "hex"))
            before.update(piece.encode())
        tail = value[PERMUTED:]
        stream = hashlib.shake_256(self.permute.key + before.digest()).digest(2 * len(tail))
        for k, c in enumerate(tail):
            name = "hex" if own == "hex" and c in _HEX else _class_of(c)
            if name:
                alphabet = _alphabet(name)
                c = alphabet[(alphabet.index(c) + stream[2 * k] + 256 * stream[2 * k + 1]) % len(alphabet)]
            out.append(c)
        return "".join(out)

    def _piece(self, kind: str, value: str, hexadecimal: bool = False, own: str | None = None) -> str:
        """`own`: the kind of number that the result must be as well (None: any).

        A hexadecimal value is permuted in the hexadecimal alphabet and most of its
        permutations have a digit and a letter too, and most permutations of another
        value are not hexadecimal, so few steps are taken.
        """
        classes = ["hex" if hexadecimal and c in _HEX else _class_of(c) for c in value]
        if not any(classes):  # signs only: any others of their blocks
            if not value or kind.count("|") > 1:
                return value
            classes = [f"{'any' if c.isprintable() and (c > 'ÿ' or not c.isalnum()) else 'raw'} {ord(c) >> 8}" for c in value]
        alphabets = [_alphabet(x) if x else "" for x in classes]
        fixed = "".join(c for c, a in zip(value, alphabets, strict=True) if not a)
        tweak = f"{kind}|{','.join(classes)}|{fixed}".encode("utf-8", "surrogatepass")
        x, n = 0, 1
        for c, a in zip(value, alphabets, strict=True):
            if a:
                x, n = x * len(a) + a.index(c), n * len(a)
        while True:
            x = self.permute(x, n, tweak)
            out, rest = [], x
            for c, a in zip(reversed(value), reversed(alphabets), strict=True):
                if a:
                    rest, k = divmod(rest, len(a))
                    c = a[k]
                out.append(c)
            new = "".join(reversed(out))
            # signs stay without white space
            if (own is None or _number_kind(new) == own) and not any(c.isspace() or "\ud800" <= c <= "\udfff" for c in new):
                return new

    def _spelled(self, lower: str, gender: str) -> str:
        """A pronounceable name piece: syllables that spell the permuted letters, and an ending of the gender."""
        accented = not lower.isascii()
        letters = _LOWER + (_alphabet(_class("ö")) + _alphabet(_class("ő")) if accented else "")
        x, n = 0, 1
        for c in lower:
            x, n = x * len(letters) + letters.index(c), n * len(letters)
        x = self.permute(x, n, f"name|{accented}|{len(lower)}".encode()) + (n - 1) // (len(letters) - 1)  # after all shorter ones
        ends = _ENDINGS[gender]
        x, k = divmod(x, len(ends))
        out, total = "", x + 1
        while total > 0:
            total, j = divmod(total - 1, 80)  # every number of syllables spells numbers of its own
            vowels = _ACCENTED if accented and not out else _VOWELS
            out += _CONSONANTS[j // 5] + vowels[j % 5]
        return out + ends[k]

    def _name(self, part: str, gender: str) -> str:
        if part in PARTICLES:
            return part
        lower = part.lower()
        known = set(_LOWER + _alphabet(_class("ö")) + _alphabet(_class("ő")))
        out = self._spelled(lower, gender) if len(lower) <= CHUNK and set(lower) <= known else self._shape("name", lower)
        if part.isupper() and len(part) > 1:
            return out.upper()
        return out[:1].upper() + out[1:] if part[:1].isupper() else out

    def name(self, value: str, gender: str = "") -> str:
        """Hyphens and apostrophes stay; only the first piece has an ending of the gender."""
        pieces = re.split(r"([-'’])", value)
        return "".join(p if k % 2 or not p else self._name(p, gender if k == 0 else "") for k, p in enumerate(pieces))

    def of(self, e: Entity) -> str:
        v = e.value
        if e.kind == "name":
            parts = v.split(" ")
            return " ".join(self.name(p, e.gender if k == 0 else "") for k, p in enumerate(parts))
        if e.kind == "email":
            local, domain = v.lower().rsplit("@", 1)
            host, _, top = domain.rpartition(".")
            return self._shape("local", local) + "@" + self._shape("host", host) + "." + top
        if e.kind == "ip":
            x = int.from_bytes(bytes(map(int, v.split("."))), "big")
            own = _range(x)
            if own:
                x = own[0] + self.permute(x - own[0], own[1], b"ip|%d" % own[0])
            else:
                x = self.permute(x, 2**32, b"ip")
                while _range(x):  # on to the next public one
                    x = self.permute(x, 2**32, b"ip")
            return ".".join(map(str, x.to_bytes(4, "big")))
        if e.kind == "ipv6":
            x = int(ipaddress.IPv6Address(v))
            head, rest = x >> 112, x & (2**112 - 1)
            new = ipaddress.IPv6Address(head << 112 | self.permute(rest, 2**112, b"ipv6|%d" % head))
            return str(new).upper() if v.upper() == v and v.lower() != v else str(new)
        if e.kind == "iban":
            country, digits = e.gender, re.sub(" ", "", v)
            body = self._shape(f"iban{country}", digits[2:])
            new = f"{(int(digits[:2]) - _iban_check(country, digits[2:]) + _iban_check(country, body) - 2) % 97 + 2:02d}" + body
        elif e.kind in ("card", "phone", "ssn"):
            digits = re.sub("[^0-9]", "", v)
            if e.kind == "card":
                body = digits[0] + self._shape("card" + digits[0], digits[1:-1])  # the issuer's digit stays
                new = body + str((int(digits[-1]) - _luhn(digits[:-1]) + _luhn(body)) % 10)
            else:
                keep = re.match(r"\+([0-9]{1,3})[ .(-]", v)
                head = keep.group(1) if keep else ""
                new = head + self._shape(e.kind + head, digits[len(head) :])
        elif e.kind == "mac":
            digits = v.lower().replace(":", "").replace("-", "")
            new = f"{self.permute(int(digits, 16), 2**48, b'mac'):012x}"
            new = new.upper() if v.upper() == v and v.lower() != v else new
        else:
            return self._shape(e.kind, v)
        it = iter(new)
        return "".join(next(it) if c.isalnum() else c for c in v)


def first_gender(name: str, gender: str) -> str:
    """The title's gender, or the one that a Latin first name's ending suggests."""
    return gender or ("f" if _FEMALE_END.search(name.lower()) else "m")


def _found(kind: str, m: re.Match, text: str) -> Entity | None:
    """The entity of a match, None if the value is not one after all."""
    start, end = m.span("v")
    gender = ""
    if kind == "secret":
        quoted = text[start] in "\"'"
        if quoted:
            start, end = start + 1, end - 1
        else:
            end = start + len(text[start:end].rstrip(".!="))
            # after a word of prose ("secret: everyone") a plain word is none; right behind "=" it is
            plain = text[start:end].isalpha() and text[start:end].islower()
            if end - start < 6 or (plain and m.group("gap") != "="):
                return None
    elif kind == "email":
        at = text.index("@", start, end)
        labels, last, n = text[at + 1 : end].split("."), 0, at + 1
        for k, label in enumerate(labels):
            top = _DOMAIN_END.match(label)
            if k and top:
                last = n + top.end()
            n += len(label) + 1
        if not last or not any(c.isalnum() for c in text[start:at]):
            return None
        end = last
    elif kind == "ipv6":
        try:
            if int(ipaddress.IPv6Address(text[start:end])) >> 16 == 0:
                return None  # the unspecified and the local address
        except ValueError:
            return None
    elif kind == "iban":
        gender = text[start - 2 : start]
        digits = text[start:end].replace(" ", "")
        if sum(c in _DIGIT for c in digits[2:]) < 4 and int(digits[:2]) != _iban_check(gender, digits[2:]):
            return None
    elif kind == "card":
        digits = re.sub("[^0-9]", "", text[start:end])
        if _luhn(digits[:-1]) != int(digits[-1]):
            return None
    return Entity(kind, text[start:end], start, end, gender)


def _people(text: str) -> list[Entity]:
    """Names after a title, and the same words elsewhere in the text."""
    found, gender_of, at = [], {}, 0
    while m := _PERSON.search(text, at):
        at = m.start("v")  # a title may stand right behind a title, or behind a small word
        own, parts = [], m.group("v").split(" ")
        for k, part in enumerate(parts):
            if part in _TITLES or (part[0].islower() and not (part in PARTICLES and any(not p[0].islower() for p in parts[k:]))):
                break
            own.append(part)
        while own and own[-1] in PARTICLES:
            own.pop()
        if not own:
            continue
        at += len(" ".join(own))
        gender = _TITLES[m.group("title")]
        found.append((m.start("v"), own, gender))
        if len(own) > 1 and gender and own[0] not in PARTICLES:
            gender_of.setdefault(own[0], gender)
    if not found:
        return []
    firsts = {own[0] for _, own, _ in found if len(own) > 1 and own[0] not in PARTICLES}
    lasts = {own[-1] for _, own, _ in found if own[-1][-1] != "."}
    out = []
    for at, own, _ in found:
        # a first name has a gender wherever it stands; a lone name after a title is a last name unless known as a first one only
        value, first = " ".join(own), own[0] in firsts and (len(own) > 1 or own[0] not in lasts)
        out.append(Entity("name", value, at, at + len(value), first_gender(own[0], gender_of.get(own[0], "")) if first else ""))
    words = list(_WORDS.finditer(text))
    plain = {m.group() for m in words}
    for m in words:
        part = m.group()
        if part not in firsts and part not in lasts:
            continue
        if not (part.lower() != part and part.lower() in plain):  # also an ordinary word of this text
            first = part in firsts and part not in lasts
            out.append(Entity("name", part, m.start(), m.end(), first_gender(part, gender_of.get(part, "")) if first else ""))
    return out


def detect(text: str) -> list[Entity]:
    """Entities of a text in order; where two overlap, the one that begins first, then the earlier pattern, counts."""
    found: list[Entity] = []
    digits: bool | None = None
    for kind, pattern, gate in _PATTERNS:
        if not gate(text):
            continue
        if kind in _NEED_DIGITS:
            if digits is None:
                digits = bool(_DIGITS.search(text))
            if not digits:
                continue
        found += [e for m in pattern.finditer(text) if (e := _found(kind, m, text))]
    found += _people(text)
    found.sort(key=lambda e: e.start)  # a titled name comes before its own words
    out: list[Entity] = []
    for e in found:
        if not out or e.start >= out[-1].end:
            out.append(e)
    return out


def replace(text: str, surrogates: Surrogates) -> tuple[str, list[tuple[Entity, str]]]:
    """The text with surrogates, and each entity with its own."""
    entities = detect(text)
    if not entities:
        return text, []
    given: dict[tuple[str, str, str], str] = {}
    out, at, pairs = [], 0, []
    for e in entities:
        who = (e.kind, e.gender, e.value)
        if who not in given:
            given[who] = surrogates.of(e)
        out += [text[at : e.start], given[who]]
        at = e.end
        pairs.append((e, given[who]))
    return "".join(out) + text[at:], pairs


def _key(secret: str) -> bytes:
    return hashlib.sha256(secret.encode()).digest()


def anonymize(docs: DataFrame, secret: str, text: str = "text") -> DataFrame:
    """All columns of `docs` with surrogates in the text, and last n_entities and kinds (the kinds found, sorted, comma-separated).

    The last two have _ behind their name where `docs` has a column of that name.
    """
    names = docs.columns
    added = B.free_names(names, ["n_entities", "kinds"])
    at = names.index(text)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(_key(secret))
        for part in parts:
            for k in range(0, part.num_rows, 2000):
                cut = part.slice(k, 2000)
                texts, counts, kinds = [], [], []
                for one in cut.column(at).to_pylist():
                    new, pairs = replace(one, surrogates) if one else (one, [])
                    texts.append(new)
                    counts.append(len(pairs))
                    kinds.append(",".join(sorted({e.kind for e, _ in pairs})))
                arrays = [pa.array(texts, pa.string()) if i == at else cut.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(counts, pa.int64()), pa.array(kinds, pa.string())], [*names, *added])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, `{added[0]}` long, `{added[1]}` string")


def entities(docs: DataFrame, secret: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, kind, value, start, end, surrogate: one row per entity occurrence."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(_key(secret))
        for part in parts:
            rows = [(i, e.kind, e.value, e.start, e.end, new) for i, one in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for e, new in replace(one or "", surrogates)[1]]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [part.schema.field(0).type, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [key, "kind", "value", "start", "end", "surrogate"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, kind string, value string, start long, end long, surrogate string")


def collisions(found: DataFrame) -> DataFrame:
    """kind, surrogate and the number of values of every surrogate that stands for more than one value."""
    return found.groupBy("kind", F.lower("surrogate").alias("surrogate")).agg(F.count_distinct(F.lower("value")).alias("n_values")).where("n_values > 1")
