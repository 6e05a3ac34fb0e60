"""PII: numbers, dates and addresses that pass their checks are swapped for keyed pseudonyms of the same form."""

from __future__ import annotations

import functools
import hashlib
import hmac
import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm._shared import table

ROUNDS = 10
FIRST_DAY, DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days
#: A key for tests and the query. A deployment passes its own; whoever holds it can undo the pseudonyms.
KEY = b"glyphmill example key"


class Feistel:
    """Keyed permutations of 0..n-1, one for each n and kind of value (the tweak)."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: str, n: int, r: int, half: int) -> int:
        return int.from_bytes(hmac.digest(self.key, f"{tweak}|{n}|{r}|{half}".encode(), "sha256")[:16], "big")

    def _once(self, x: int, n: int, a: int, tweak: str, inverse: bool) -> int:
        b = -(-n // a)  # x is a pair: below a, below b
        left, right = x % a, x // a
        for r in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
            sign = -1 if inverse else 1
            if r % 2:
                right = (right + sign * self._round(tweak, n, r, left)) % b
            else:
                left = (left + sign * self._round(tweak, n, r, right)) % a
        return left + a * right

    def permute(self, x: int, n: int, tweak: str, inverse: bool = False) -> int:
        """The place of x in the permutation of 0..n-1; walks on while it falls outside."""
        if n < 2:
            return x
        a = max(2, int(n**0.5))
        x = self._once(x, n, a, tweak, inverse)
        while x >= n:
            x = self._once(x, n, a, tweak, inverse)
        return x


def luhn(digits: str) -> int:
    """The check digit that completes digits."""
    total = sum(sum(divmod(2 * int(d), 10)) if k % 2 == 0 else int(d) for k, d in enumerate(reversed(digits)))
    return -total % 10


def _refill(shape: str, digits: str) -> str:
    """shape with its digits replaced in order."""
    it = iter(digits)
    return re.sub(r"[0-9]", lambda _: next(it), shape)


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def _card(f: Feistel, s: str, inverse: bool) -> str | None:
    d = _digits(s)
    if not 13 <= len(d) <= 19 or luhn(d[:-1]) != int(d[-1]):
        return None
    body = str(f.permute(int(d[:-1]), 10 ** (len(d) - 1), f"card{len(d)}", inverse)).zfill(len(d) - 1)
    return _refill(s, body + str(luhn(body)))


def _long_number(f: Feistel, s: str, inverse: bool) -> str | None:
    """A number that looks like a card's and fails its check: its pseudonym fails it too."""
    d = _digits(s)
    x = int(d)
    while True:
        x = f.permute(x, 10 ** len(d), f"number{len(d)}", inverse)
        out = str(x).zfill(len(d))
        if luhn(out[:-1]) != int(out[-1]):
            return _refill(s, out)


# How many digits follow a country code that fixes it; the length of an IBAN by country.
PHONE_DIGITS = {"1": (10, 10), "7": (10, 10), "33": (9, 9), "34": (9, 9), "39": (6, 11), "44": (9, 10), "49": (6, 11), "55": (10, 11), "61": (9, 9), "81": (9, 10), "86": (11, 11), "91": (10, 10)}
OTHER_PHONES = (7, 14)
IBAN_LENGTHS = dict(
    AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BR=29, CH=21, CR=22, CY=28, CZ=24, DE=22, DK=18, DO=28, EE=20, ES=24, FI=18, FO=18, FR=27, GB=22,
    GE=22, GI=23, GL=18, GR=27, GT=28, HR=21, HU=28, IE=22, IL=23, IS=26, IT=27, JO=30, KW=30, KZ=20, LB=28, LI=21, LT=20, LU=20, LV=21, MC=27, MD=24, ME=22, MK=19,
    MR=27, MT=31, MU=30, NL=18, NO=15, PK=24, PL=28, PS=29, PT=25, QA=29, RO=24, RS=22, SA=24, SE=24, SI=19, SK=24, SM=27, TN=24, TR=26, UA=29, VG=24, XK=20,
)


def _phone(f: Feistel, s: str, inverse: bool) -> str | None:
    """+, a country code that stays, and further digits, as many as the code asks for."""
    head = re.match(r"\+[0-9]{1,3}(?=[ .(-])|\+1|\+", s)[0]
    rest = s[len(head) :]
    d = _digits(rest)
    least, most = PHONE_DIGITS.get(head[1:], OTHER_PHONES)
    if not least <= len(d) <= most:
        return None
    return head + _refill(rest, str(f.permute(int(d), 10 ** len(d), f"phone{head}{len(d)}", inverse)).zfill(len(d)))


def _local_phone(f: Feistel, s: str, inverse: bool) -> str | None:
    """Three, three and four digits, as phones are written without a country code."""
    return _refill(s, str(f.permute(int(_digits(s)), 10**10, "local", inverse)).zfill(10))


def _ssn_ok(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _ssn(f: Feistel, s: str, inverse: bool) -> str | None:
    d = _digits(s)
    if not _ssn_ok(d):
        return None
    x = int(d)
    while True:
        x = f.permute(x, 10**9, "ssn", inverse)
        if _ssn_ok(out := str(x).zfill(9)):
            return _refill(s, out)


def _ipv4(f: Feistel, s: str, inverse: bool) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = f.permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ipv4", inverse)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _iban(f: Feistel, s: str, inverse: bool) -> str | None:
    """Valid by its remainder mod 97; country, length, letters' places and check digits' rule stay."""
    bare = s.replace(" ", "")
    if IBAN_LENGTHS.get(bare[:2], len(bare)) != len(bare):
        return None
    number = lambda t: int("".join(str(int(c, 36)) for c in t))
    if not 15 <= len(bare) <= 34 or number(bare[4:] + bare[:4]) % 97 != 1:
        return None
    body = bare[4:]
    d = _digits(body)
    body = _refill(body, str(f.permute(int(d), 10 ** len(d), f"iban{bare[:2]}{re.sub('[0-9]', '9', body)}", inverse)).zfill(len(d)))
    it = iter(bare[:2] + f"{98 - number(body + bare[:2] + '00') % 97:02d}" + body)
    return re.sub(r"[^ ]", lambda _: next(it), s)


def _date(f: Feistel, s: str, inverse: bool) -> str | None:
    """Year first, or day and month either way (day first if both can be) with a four-digit year, in 1900 to 2099."""
    m = re.fullmatch(r"([0-9]{1,4})([-./])([0-9]{1,2})\2([0-9]{1,4})", s)
    if not m:
        return None
    a, sep, b, c = m[1], m[2], m[3], m[4]
    orders = ["ymd"] if len(a) == 4 and len(c) <= 2 else ["mdy", "dmy"] if sep == "/" and int(b) > 12 else ["dmy"] if len(c) == 4 and len(a) <= 2 else []
    for order in orders:
        v = dict(zip(order, (a, b, c), strict=True))
        try:
            day = (date(int(v["y"]), int(v["m"]), int(v["d"])) - FIRST_DAY).days
        except ValueError:
            continue
        if not 0 <= day < DAYS:
            continue

        def fits(t: date, order: str = order, v: dict[str, str] = v) -> bool:
            """Whether t can be written with as many digits, and is read back in the same order."""
            short = all(len(str(n)) <= len(v[k]) for k, n in (("d", t.day), ("m", t.month)))
            return short and (order != "mdy" or t.day > 12)

        while True:
            day = f.permute(day, DAYS, f"date{order}{sep}{len(v['d'])}{len(v['m'])}", inverse)
            t = FIRST_DAY + timedelta(days=day)
            if fits(t):
                break
        parts = {k: str(n).zfill(len(v[k])) for k, n in (("y", t.year), ("m", t.month), ("d", t.day))}
        return sep.join(parts[k] for k in order)
    return None


def _same_kinds(f: Feistel, s: str, tweak: str, inverse: bool) -> str:
    """Letters a-z stay letters in their case, digits digits, other signs themselves. Case changes nothing else."""
    kinds = ["abcdefghijklmnopqrstuvwxyz" if c.isalpha() else "0123456789" for c in s if c.isalnum()]
    x, n = 0, 1
    for c, signs in zip((c for c in s.lower() if c.isalnum()), kinds, strict=True):
        x, n = x * len(signs) + signs.index(c), n * len(signs)
    x = f.permute(x, n, tweak + "".join(signs[0] for signs in kinds), inverse)
    out = []
    for signs in reversed(kinds):
        x, k = divmod(x, len(signs))
        out.append(signs[k])
    new = (out.pop() if c.isalnum() else c for c in s)
    return "".join(c.upper() if old.isupper() else c for c, old in zip(new, s, strict=True))


def _email(f: Feistel, s: str, inverse: bool) -> str | None:
    """The part before @ as _same_kinds() has it; the domain stays."""
    local, _, domain = s.rpartition("@")
    return f"{_same_kinds(f, local, 'email', inverse)}@{domain}"


def _secret(f: Feistel, s: str, inverse: bool) -> str | None:
    """An access key behind its mark of four letters, or a hexadecimal or other value that a name of its kind stands before."""
    if s.startswith("AKIA"):
        return "AKIA" + _same_kinds(f, s[4:], "access", inverse)
    return _same_kinds(f, s, "secret", inverse)


_DATES = "|".join(f"[0-9]{{4}}{sep}[0-9]{{1,2}}{sep}[0-9]{{1,2}}|[0-9]{{1,2}}{sep}[0-9]{{1,2}}{sep}[0-9]{{4}}" for sep in ("-", r"\.", "/"))
#: Kinds by name, in the order of preference where two could begin at one place.
KINDS: dict[str, tuple[str, Callable[[Feistel, str, bool], str | None]]] = {
    "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9][A-Za-z0-9-]{0,62}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24}", _email),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban),
    "secret": (r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?<=password=)[A-Za-z0-9]{8,128}(?![A-Za-z0-9])|(?<=[\"'])[0-9a-f]{32,64}(?=[\"'])", _secret),
    "phone": (r"(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,5}\)?){2,5}(?![0-9])", _phone),
    "ipv4": (r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])", _ipv4),
    "date": (rf"(?<![0-9./-])(?:{_DATES})(?![0-9]|[./-][0-9])", _date),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])", _ssn),
    "card": (r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z]|[-][0-9])", _card),
    "local": (r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])", _local_phone),
}
_EACH = {k: re.compile(p) for k, (p, _) in KINDS.items()}
_ANY = re.compile("|".join(f"(?:{p})" for p, _ in KINDS.values()))
_HINT = re.compile(r"[0-9@]|password=")


@functools.cache
def _feistel(key: bytes) -> Feistel:
    return Feistel(key)


@functools.lru_cache(maxsize=65_536)
def _pseudonym(key: bytes, kind: str, value: str, inverse: bool) -> str | None:
    f = _feistel(key)
    out = KINDS[kind][1](f, value, inverse)
    if out is None and kind == "card" and len(_digits(value)) == len(value):
        out = _long_number(f, value, inverse)
    return out


def _valid_at(text: str, at: int, key: bytes, inverse: bool) -> tuple[str, int, str] | None:
    """The kind, end and pseudonym of the value that begins here, if one does.

    An IBAN or phone whose pattern takes words or numbers that follow it is
    tried again without its last groups.
    """
    for kind, pattern in _EACH.items():
        if m := pattern.match(text, at):
            ends = [len(m[0])]
            if kind in ("iban", "phone"):
                ends += [k.start() for k in re.finditer("[ .-]", m[0])][::-1]
            for n in ends:
                if (out := _pseudonym(key, kind, m[0][:n], inverse)) is not None:
                    return kind, at + n, out
    return None


def pseudonymise(text: str, key: bytes = KEY, inverse: bool = False) -> tuple[str, dict[str, int]]:
    """The text with valid values permuted within their form, and how many of each kind; inverse undoes it.

    Equal values become equal pseudonyms in every text. Values that fail their
    check (no such day, an octet over 255, ...) stay; unbroken runs of 13 to
    19 digits that fail the card check are permuted among such runs.
    """
    counts: dict[str, int] = {}
    if not _HINT.search(text):
        return text, counts
    out, done, at = [], 0, 0
    while m := _ANY.search(text, at):
        found = _valid_at(text, m.start(), key, inverse)
        if not found:
            at = m.start() + 1
            continue
        kind, end, new = found
        out += [text[done : m.start()], new]
        counts[kind] = counts.get(kind, 0) + 1
        done = at = end
    return "".join([*out, text[done:]]), counts


def _run(key: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = sorted(KINDS)
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            texts, counts = [], []
            for text in part.column(1).to_pylist():
                out, n = (None, {}) if text is None else pseudonymise(text, key)
                texts.append(out)
                counts.append([n.get(k, 0) for k in kinds])
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(kinds))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), *columns], ["doc_id", "text", *(f"n_{k}" for k in kinds)])


def mask_documents(documents: DataFrame, key: bytes = KEY) -> DataFrame:
    """doc_id, text (pseudonymised) and n_<kind> of every row of documents (doc_id, text).

    Null texts stay null, empty ones empty; each row is treated by itself, so
    repeated rows and null doc_ids are returned like any other.
    """
    schema = "doc_id long, text string, " + ", ".join(f"n_{k} long" for k in sorted(KINDS))
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(functools.partial(_run, key), schema)


def fingerprint(key: bytes) -> str:
    """Names a key without giving it away, for records of which key made a table."""
    return hashlib.sha256(b"glyphmill pii key:" + key).hexdigest()[:12]


def query(spark, sf_dir: str) -> DataFrame:
    return mask_documents(table(spark, sf_dir, "documents"))
