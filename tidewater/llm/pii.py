"""Personal data replaced by keyed, type-consistent surrogates.

Detected entities are e-mail addresses, telephone numbers, payment cards (with a valid
check digit), IP addresses, bank account numbers, national numbers and names.  A name is
found by a title before it; then every other mention of one of its parts in the same text,
with or without title, whole or partial, is found too.  A surrogate is drawn from a keyed
hash of type and canonical value, so that the same entity gets the same surrogate in every
document.  It keeps the kind: an e-mail address has the shape of its local part and the
script of its letters, a number its separators, country code and valid check digits, an
address of a private network stays private.  Names are replaced part by part, so that "Mr
John Smith", "John Smith" and "Smith" stay one person; a given name keeps the gender of its
title, every part its script and case, and particles ("von", "de la") stay.

Distinct entities are gathered once, without texts.  A surrogate that two entities draw,
or that is itself a value in the corpus, is drawn again by all but one, round by round,
until the check finds none; a range of addresses or numbers of which a quarter is in use is
permuted.  Occurrences then take their surrogates in a join on the entity, so an entity
that a third of all rows mention is one row of the map.

Cases: null texts stay null, empty and clean texts pass unchanged and without Python;
whole texts are scanned; overlapping finds go to the earlier and then the longer; repeated
rows give repeated rows; other columns pass through, whatever their names.  The key is the
caller's: who has it can compute surrogates again.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import materialise, release

TYPES = ("email", "card", "iban", "ip", "national", "phone", "name")
#: Titles by gender; what follows them is a name.
TITLES = {"f": "Mrs Ms Miss Frau Madame Mme Señora Sra", "m": "Mr Herr Monsieur Señor Sr", "n": "Dr Prof"}
#: Words inside names that are no names; they stay.
PARTICLES = "von van de der den del della di da dos du la le el al bin ibn ter ten zu zur zum y".split()
#: Country calling codes of one digit, and those of two; all others have three.
CODES = ("1 7".split(), "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_GENDER = {t: g for g, ts in TITLES.items() for t in ts.split()}
#: Syllables that surrogate names are made of, by gender of the given name; family names take the last.
_SYLLABLES = {
    "f": ("ma li an so el ro ka vi no ju", "na ra la ri sa ne mi lia da ta"),
    "m": ("ja to pe al lu ma fe vi ro he", "kob mas ter ric kas rin lix tor land nus"),
    "n": ("al ro sa mi ka ju lo te ri no", "ex in sha ka im le ren ri an el"),
    "": ("wal hol ber stein lin kar mor ves tal bran", "ler man dorf son berg ton ley nik tov dal"),
}

_PATTERNS = [
    ("email", re.compile(r"(?<![\w.%+-])[\w.%+-]*[\w%+-]@(?:[^\W_](?:[\w-]*[^\W_])?\.)+(?:[^\W\d_]{2,}|xn--[A-Za-z0-9-]*[A-Za-z0-9])(?![\w-])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("ip", re.compile(r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])")),
    ("ip", re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{1,4}:|:(?=:)){1,7}(?:(?<=::)|:(?<=::))?[0-9A-Fa-f:]*(?![\w:])")),
    ("card", re.compile(r"(?<![0-9-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9]|-[0-9])")),
    ("national", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])")),
    (
        "phone",
        re.compile(
            r"(?<![\w+])(?<![0-9][.,])(?:"
            r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,14}(?:[ .-][0-9]{2,10}){0,5}"
            r"|\([0-9]{1,6}\)[ .-]?[0-9]{1,8}(?:[ .-][0-9]{2,8}){0,5}"
            r"|0[0-9]{1,5}(?: ?/ ?|[ .-])[0-9]{2,8}(?:[ .-][0-9]{2,8}){0,4}"
            r"|00[1-9][0-9]{0,2}(?:[ .-][0-9]{2,10}){1,5}"
            r"|0[1-9][0-9]{8,10}|00[1-9][0-9]{9,12}"
            r"|[0-9]{1,4}(?:[ .-][0-9]{2,4}){1,5}"
            r")(?![\w]|[.-][0-9])"
        ),
    ),
]
_CAPITAL = r"(?:[^\W\d_a-zà-öø-ÿа-я][^\W\d_]+)"
_TITLE = r"\b((?:(?:" + "|".join(_GENDER) + r")\b\.? )+)"
_NAME = re.compile(_TITLE + r"((?:(?:" + "|".join(PARTICLES) + r") |[^\W\d_a-z]\. ?){0,4}" + _CAPITAL + r"(?:(?: (?:" + "|".join(PARTICLES) + r")){0,3}[ -](?:[^\W\d_a-z]\. ?)?" + _CAPITAL + r"){0,3})")
_PART = re.compile(r"[^\W\d_]+")
_GROUPS = re.compile("[0-9]+")
#: A text in which this finds nothing has no entity: every pattern needs a sign of it.  Most
#: characters can't begin one, which is looked at first.
TRIGGER = r"(?=[@:0-9" + "".join(sorted({t[0] for t in _GENDER})) + r"])(?:@|:[0-9A-Fa-f]{0,4}:|[0-9][0-9)(. -]*[0-9]|(?:" + "|".join(_GENDER) + r")\.? )"


def check_digit_ok(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban_ok(value: str) -> bool:
    moved = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


#: A date with a valid month and day, or years.
_MONTH, _DAY, _YEAR = "(?:0?[1-9]|1[0-2])", "(?:0?[1-9]|[12][0-9]|3[01])", "(?:1[0-9]|2[01])[0-9]{2}"
_DATE = re.compile(rf"(?:{_YEAR}([ .-]){_MONTH}\1{_DAY}|{_DAY}([ .-]){_MONTH}\2{_YEAR}|{_MONTH}([ .-]){_DAY}\3{_YEAR}|{_YEAR}(?:[ .-]{_YEAR})+)(?![0-9])[ .-]?")


def _is_phone(value: str, digits: str) -> bool:
    groups = re.findall("[0-9]+", value)
    if value[0] == "+":
        return True
    if value[0] == "(":
        return digits[0] == "0" or (len(groups) > 2 and max(map(len, groups)) <= 4) or (len(groups[0]) == 3 and len(digits) == 10)
    # without country code or brackets: as long as a whole number, and neither a date nor years
    return len(digits) >= 9 and not _DATE.match(value) and (digits[0] == "0" or max(map(len, groups)) <= 4)


def phones_of(text: str, addresses: list[int]) -> Iterator[tuple[int, int]]:
    """Places that may be a telephone number: dates before one, and a number or one of the
    ``addresses`` (where they start) after one, are cut off."""
    pattern, at = dict(_PATTERNS)["phone"], 0
    while m := pattern.search(text, at):
        start, end = m.span()
        at = end
        if text[start] not in "+(" and (date := _DATE.match(text, start, end)):
            at = date.end()
            continue
        for ip in addresses[bisect_right(addresses, start) : bisect_left(addresses, end)]:
            if sum(map(str.isdigit, text[start:ip])) >= 7:
                end = at = start + len(text[start:ip].rstrip(" .-/("))
                break
        if text[start] in "+(0" and sum(map(str.isdigit, text[start:end])) > 15:
            before, cut, last = 0, None, None
            for g in _GROUPS.finditer(text[start:end]):
                if before >= 7 and len(g[0]) >= 3 and g[0][0] == "0":
                    cut = last
                    break
                before += len(g[0])
                if before <= 15:
                    last = g.end()
            if (cut := cut or last) is not None:
                end = at = start + cut
        yield start, end


def canonical(kind: str, value: str) -> str | None:
    """What makes two mentions the same entity; None if it isn't one after all."""
    if kind == "email":
        return value.lower()
    if kind == "name":
        return value.lower()
    if kind == "iban":
        plain = value.replace(" ", "")
        return plain if 15 <= len(plain) <= 34 and iban_ok(plain) else None
    if kind == "ip":
        if ":" not in value:
            return ".".join(str(int(x)) for x in value.split("."))
        try:
            return str(ipaddress.IPv6Address(value)) if sum(map(bool, value.split(":"))) > 1 else None
        except ValueError:
            return None
    if kind == "phone" and (value.startswith("+") or re.match("00[1-9]", value)):
        digits = re.sub(r"\D", "", value.replace("(0)", "")).removeprefix("00")
        return "+" + digits if 7 <= len(digits) <= 15 else None
    digits = re.sub(r"\D", "", value)
    if kind == "card":
        return digits if 13 <= len(digits) <= 19 and check_digit_ok(digits) and len(set(digits)) > 1 else None
    if kind == "phone":
        return digits if 7 <= len(digits) <= 15 and _is_phone(value, digits) else None
    return digits


def names_of(text: str) -> Iterator[tuple[int, int, str, str]]:
    """The parts of names after titles, then every other mention of one: place, value, gender
    (of a given name that of its title, of a family name none)."""
    known: dict[str, str] = {}
    for m in _NAME.finditer(text):
        genders = {_GENDER[t] for t in re.findall(r"\w+", m[1])}
        gender = next((g for g in "fm" if g in genders), "n")
        parts = [p for p in _PART.finditer(text, m.start(2), m.end(2)) if len(p[0]) > 1 and p[0] not in PARTICLES]
        for k, p in enumerate(parts):
            role = "" if k == len(parts) - 1 else gender
            value = p[0].lower()
            known[value] = known.get(value) or role
            yield p.start(), p.end(), value, role
    if known:
        for p in _PART.finditer(text):
            value = p[0].lower()
            if value in known and p[0][0].isupper() and (len(value) > 2 or not value.isascii()):
                yield p.start(), p.end(), value, known[value]


def entities_of(text: str) -> list[tuple[int, int, str, str, str]]:
    """Start, end, type, canonical value, gender; in order, without overlap.  A name's parts
    are entities of their own."""
    found = [(a, b, "name", value, gender) for a, b, value, gender in names_of(text)]
    for kind, pattern in _PATTERNS:
        if kind == "phone":
            found += [(a, b, kind, value, "") for a, b in phones_of(text, [x[0] for x in found if x[2] == "ip"]) if (value := canonical(kind, text[a:b])) is not None]
            continue
        for m in pattern.finditer(text):
            value = canonical(kind, m[0])
            if value is not None:
                found.append((m.start(), m.end(), kind, value, ""))
    out: list[tuple[int, int, str, str, str]] = []
    for x in sorted(found, key=lambda x: (x[0], -x[1], TYPES.index(x[2]))):
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


class Stream:
    """Numbers from a keyed hash."""

    def __init__(self, key: str, *what: object):
        self.key, self.what, self.block, self.rest = key.encode(), "\x1f".join(map(str, what)).encode(), 0, 0

    def below(self, n: int) -> int:
        if self.rest < n << 64:
            digest = hmac.new(self.key, self.what + b"\x1f%d" % self.block, hashlib.sha256).digest()
            self.block, self.rest = self.block + 1, int.from_bytes(digest, "big")
        self.rest, x = divmod(self.rest, n)
        return x


_ALPHABETS: dict[str, str] = {}


def alphabet(letter: str) -> str:
    """The lower-case letters of the script that a letter belongs to."""
    name = unicodedata.name(letter, "LATIN SMALL").split(" ")[0]
    if name not in _ALPHABETS:
        if name == "LATIN":
            _ALPHABETS[name] = "abcdefghijklmnopqrstuvwxyz"
        else:
            start = ord(letter) & ~0x3F
            near = (chr(c) for c in range(start, start + 0x80))
            _ALPHABETS[name] = "".join(c for c in near if c.isalpha() and c == c.lower() and unicodedata.name(c, "").startswith(name)) or letter
    return _ALPHABETS[name]


def surrogate(kind: str, value: str, gender: str, attempt: int, key: str) -> str:
    """The canonical value that stands for another."""
    s = Stream(key, kind, value, gender, attempt)
    digit = lambda c: str(s.below(10)) if c.isdigit() else c
    if kind == "email":
        local, domain = value.split("@")
        drawn = "".join(digit(c) if c.isdigit() else alphabet(c)[s.below(len(alphabet(c)))] if c.isalpha() else c for c in local)
        if attempt > 1:  # a shape with too few members is made longer
            drawn += "".join("abcdefghijklmnopqrstuvwxyz"[s.below(26)] for _ in range(min(attempt, 12)))
        *hosts, _ = domain.split(".")[:-1] or [""]
        top = domain.split(".")[-1]
        return f"{drawn}@{'.'.join([*(f'h{s.below(1000)}' for _ in hosts), 'example', top if top in ('com', 'net', 'org') else 'org'])}"  # names kept for examples
    if kind == "ip" and ":" in value:
        local, unique = (ipaddress.IPv6Address(value) in ipaddress.IPv6Network(n) for n in ("fe80::/10", "fc00::/7"))
        first, bits = (0xFE80 << 112, 64) if local else (0xFD << 120, 120) if unique else (0x20010DB8 << 96, 96)  # the last is kept for examples
        return str(ipaddress.IPv6Address(first + s.below(1 << bits)))
    if kind == "ip":
        a, b, *_ = map(int, value.split("."))
        if a == 10:
            return f"10.{s.below(256)}.{s.below(256)}.{1 + s.below(254)}"
        if (a, b) == (192, 168):
            return f"192.168.{s.below(256)}.{1 + s.below(254)}"
        if a == 172 and 16 <= b < 32:
            return f"172.{16 + s.below(16)}.{s.below(256)}.{1 + s.below(254)}"
        first = [x for x in range(11, 223) if x not in (127, 169, 172, 192, 198, 203)]
        return f"{first[s.below(len(first))]}.{s.below(256)}.{s.below(256)}.{1 + s.below(254)}"
    if kind == "card":
        drawn = value[0] + "".join(str(s.below(10)) for _ in value[1:-1])
        return next(drawn + str(d) for d in range(10) if check_digit_ok(drawn + str(d)))
    if kind == "iban":
        body = "".join(digit(c) if c.isdigit() else chr(65 + s.below(26)) for c in value[4:])
        rest = int("".join(str(int(c, 36)) for c in body + value[:2] + "00")) % 97
        return f"{value[:2]}{98 - rest:02d}{body}"
    if kind == "name":
        if unicodedata.name(value[0], "LATIN").startswith("LATIN"):
            head, tail = (x.split() for x in _SYLLABLES[gender])
            middle = "".join(head[s.below(10)] for _ in range(attempt + (gender == "")))
            return head[s.below(10)] + middle + tail[s.below(10)]
        drawn = "".join(alphabet(c)[s.below(len(alphabet(c)))] if c.isalpha() else c for c in value)
        more = alphabet(value[0])
        return drawn + "".join(more[s.below(len(more))] for _ in range(attempt - 1))  # few short names
    if kind == "national":
        return f"{900 + s.below(100)}{1 + s.below(99):02d}{1 + s.below(9999):04d}"  # numbers that are never given out
    if value[0] == "+":
        keep = 1 + next((k for k, codes in enumerate(CODES, 1) if value[1 : k + 1] in codes), 3)
    else:
        keep = max(len(value) - 10, len(value) - len(value.lstrip("0")))  # what a trunk takes
    more = min(attempt // 8, 15 - len(value.lstrip("+")))  # numbers of a short length may be used up
    return value[:keep] + str(2 + s.below(8)) + "".join(str(s.below(10)) for _ in range(len(value) - keep - 1 + more))


#: Ranges of numbers that surrogates are drawn from: what they begin with, and how many they are.
POOLS = {"10": (10 << 24, 1 << 24), "172": (172 << 24 | 16 << 16, 1 << 20), "192": (192 << 24 | 168 << 16, 1 << 16), "public": (0, 1 << 32), "national": (0, 10**9)}
#: A range of which more than this share is in the corpus is assigned by a permutation.
CROWDED = 0.25


def pool_of(kind: str, value: str) -> str | None:
    if kind == "national":
        return kind
    if kind != "ip" or ":" in value:
        return None
    a, b, *_ = map(int, value.split("."))
    if a == 10:
        return "10"
    if (a, b) == (192, 168):
        return "192"
    return "172" if a == 172 and 16 <= b < 32 else "public"


def permuted(kind: str, value: str, key: str) -> str:
    """The value that stands for one of a crowded range: of a keyed order of the whole range,
    which is a cycle, the next.  No two share one and none stays as it is."""
    pool = pool_of(kind, value)
    first, size = POOLS[pool]
    half = ((size - 1).bit_length() + 1) // 2
    mask = (1 << half) - 1
    shown = lambda n: f"{n:09d}" if kind == "national" else str(ipaddress.IPv4Address(first + n))
    turn = lambda k, x: int.from_bytes(hmac.new(key.encode(), b"%s|%d|%d" % (pool.encode(), k, x), hashlib.sha256).digest()[:4], "big") & mask
    at = int(value) if kind == "national" else int(ipaddress.IPv4Address(value)) - first
    while True:
        left, right = at >> half, at & mask
        for k in range(4):
            left, right = right, left ^ turn(k, right)
        at = ((left << half | right) + 1) & ((1 << 2 * half) - 1)
        left, right = at >> half, at & mask
        for k in reversed(range(4)):
            left, right = right ^ turn(k, left), left
        at = left << half | right
        if at < size and pool_of(kind, shown(at)) == pool:  # others of the cycle are passed over
            return shown(at)


def formatted(kind: str, original: str, value: str) -> str:
    """A canonical surrogate in the format of the mention that it stands for."""
    if kind == "email":
        return value.upper() if original.isupper() else value
    if kind == "name":
        return value.upper() if len(original) > 1 and original.isupper() else value[:1].upper() + value[1:]
    if kind == "phone" and value[0] == "+":  # a country code's zeros and a trunk's in brackets stay
        head = "00" if original.startswith("00") else ""
        rest, before, trunk, after = iter(value[1:]), *original.removeprefix(head).partition("(0)")
        fill = lambda t: "".join(next(rest, "") if c.isdigit() else c for c in t)
        return head + fill(before) + trunk + fill(after) + "".join(rest)
    if kind == "ip":
        return value
    rest = iter(value)
    return "".join(next(rest, "") if c.isalnum() else c for c in original) + "".join(rest)


ENTITY = T.StructType([T.StructField(n, t) for n, t in (("start", T.IntegerType()), ("end", T.IntegerType()), ("kind", T.StringType()), ("value", T.StringType()), ("gender", T.StringType()))])
_ENTITY = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string()), ("gender", pa.string())])
_NAMES = [f.name for f in ENTITY.fields]


@F.arrow_udf(T.ArrayType(ENTITY))
def detect(texts: pa.Array) -> pa.Array:
    return pa.array([[dict(zip(_NAMES, e, strict=True)) for e in entities_of(t)] if t else [] for t in texts.to_pylist()], pa.list_(_ENTITY))


def surrogate_map(entities: DataFrame, key: str) -> DataFrame:
    """``kind``, ``value``, ``surrogate``: one row for each entity (``kind``, ``value``,
    ``gender``, distinct by the first two), no two of a kind with the same surrogate, and no
    surrogate that is a value of the corpus, but in ranges that are so crowded that they are
    permuted."""

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            drawn = pa.array([permuted(k, v, key) for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), drawn, b.column(1)], ["kind", "surrogate", "value"])

    def draw(attempt: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = zip(*(c.to_pylist() for c in b.columns), strict=True)
                drawn = pa.array([surrogate(k, v, g, attempt, key) for k, v, g in rows], pa.string())
                yield pa.RecordBatch.from_arrays([*b.columns, drawn], ["kind", "value", "gender", "surrogate"])

        return run

    schema = "kind string, value string, gender string, surrogate string"
    values = entities.select("kind", F.col("value").alias("surrogate"))
    first, second = (F.substring_index(F.substring_index("value", ".", k), ".", -1).try_cast("int") for k in (1, 2))
    private = F.when(first == 10, "10").when((first == 192) & (second == 168), "192").when((first == 172) & second.between(16, 31), "172").otherwise("public")
    pool = F.when(F.col("kind") == "national", "national").when((F.col("kind") == "ip") & ~F.col("value").contains(":"), private)
    crowded = [r.pool for r in entities.groupBy(pool.alias("pool")).count().collect() if r.pool and r["count"] > CROWDED * POOLS[r.pool][1]]
    left, settled = entities, []
    if crowded:
        inside = F.coalesce(pool.isin(crowded), F.lit(False))
        settled = [materialise(entities.where(inside).select("kind", "value").mapInArrow(permute, "kind string, surrogate string, value string"), "permuted")]
        left = entities.where(~inside)
    for attempt in count():
        drawn = materialise(left.select("kind", "value", "gender").mapInArrow(draw(attempt), schema), "surrogates")
        fresh = drawn.join(values, ["kind", "surrogate"], "left_anti")
        for before in settled:
            fresh = fresh.join(before.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        settled.append(materialise(fresh.groupBy("kind", "surrogate").agg(F.min("value").alias("value")), "settled"))
        behind, left = left, materialise(drawn.join(settled[-1], ["kind", "value"], "left_anti").select("kind", "value", "gender"), "unsettled")
        release(drawn, *([behind] if attempt else []))
        if left.isEmpty():
            break
    made = settled[0]
    for more in settled[1:]:
        made = made.unionByName(more)
    return made


def rewrite(docs: DataFrame, key: str, text_col: str = "text", n_chars_col: str | None = None, found_col: str | None = None) -> DataFrame:
    """``docs`` with surrogates in its texts, in whatever order.  ``n_chars_col``, if given and
    there, is brought in line with the new text; ``found_col``, if given, is added: an array
    of the entities with their places in the new text."""
    text = F.col(text_col).cast("string")
    may = F.coalesce(text.rlike(TRIGGER), F.lit(False))
    empty = F.array().cast(T.ArrayType(ENTITY))
    clean = docs.where(~may)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    marked = docs.where(may).select(F.struct(*columns).alias("row"), text.alias("text")).withColumn("entities", detect("text"))
    marked = materialise(marked.withColumn("key", F.monotonically_increasing_id()), "pii-marked")
    each = marked.where(F.size("entities") > 0).select("key", F.posexplode("entities").alias("at", "e")).select("key", "at", "e.kind", "e.value", "e.gender")
    # a part of a name that is a given name somewhere, with a gender somewhere, is that wherever it comes
    of = lambda *which: F.max(F.when(F.col("gender").isin(*which), F.col("gender")))
    distinct = each.groupBy("kind", "value").agg(F.coalesce(of("f", "m"), of("n"), F.lit("")).alias("gender"))
    made = materialise(surrogate_map(materialise(distinct, "pii-entities"), key), "pii-map")
    mapped = each.select("key", "at", "kind", "value").join(made, ["kind", "value"]).groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "surrogate"))), lambda x: x["surrogate"]).alias("new"))

    @F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("entities", T.ArrayType(ENTITY))]))
    def apply(texts: pa.Array, found: pa.Array, new: pa.Array) -> pa.Array:
        out = []
        for t, es, values in zip(texts.to_pylist(), found.to_pylist(), new.to_pylist(), strict=True):
            parts, at, length, placed = [], 0, 0, []
            for e, v in zip(es, values or [], strict=True):
                shown = formatted(e["kind"], t[e["start"] : e["end"]], v)
                length += e["start"] - at
                parts += [t[at : e["start"]], shown]
                placed.append(e | {"start": length, "end": length + len(shown), "value": shown})
                at, length = e["end"], length + len(shown)
            out.append({"text": "".join([*parts, t[at:]]), "entities": placed})
        return pa.array(out, pa.struct([("text", pa.string()), ("entities", pa.list_(_ENTITY))]))

    done = marked.join(mapped, "key", "left").withColumn("new", F.coalesce("new", F.array().cast("array<string>"))).withColumn("out", apply("text", "entities", "new"))

    def column(c: str):
        if c == text_col:
            return F.col("out.text").alias(c)
        if c == n_chars_col:
            return F.char_length("out.text").cast(docs.schema[c].dataType).alias(c)
        return F.col("row").getField(c).alias(c)

    changed = done.select(*map(column, docs.columns), *([F.col("out.entities").alias(found_col)] if found_col else []))
    if found_col:
        clean = clean.withColumn(found_col, empty)
    return clean.unionByName(changed)


def report(docs: DataFrame, key: str) -> DataFrame:
    """Per document the rewritten text, its digest, and what was replaced where."""
    out = rewrite(docs.select("doc_id", "text"), key, found_col="entities")
    spans = F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["kind"], e["start"].cast("string"), e["end"].cast("string"))), ",")
    return out.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.size("entities").cast("long").alias("n_entities"), spans.alias("spans"))
