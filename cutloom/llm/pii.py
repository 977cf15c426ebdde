"""Format-preserving pseudonyms for personal numbers and dates, by keyed Feistel permutations.

A found value is validated (check digits, ranges, calendar), turned into a number of its format's domain,
permuted there under the key, and written back in the same format; steps that leave the valid set are
repeated (cycle walking), so the map is a bijection of each format's valid values. It depends on the key, the kind and
the value alone: equal values get equal pseudonyms in every document, whatever stands beside them. The spans that come with a text say
where its pseudonyms are, since formats and so lengths are kept: with them and the key every text can be undone exactly.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
import secrets
from bisect import bisect_left
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from cutloom.llm._tables import documents, picked

KEY_CONF = "spark.cutloom.pii.key"
ROUNDS = 10
KINDS = ("email", "secret", "iban", "card", "ssn", "phone", "ip", "date")

#: The shapes. Each value starts where no letter, digit or value sign stands before it, so a long run is read once.
_SHAPES = re.compile(
    r"""(?P<email>(?<![.%+-])(?<!(?u:\w))(?u:[\w.%+-])++@(?:[A-Za-z0-9-]++\.)++[A-Za-z]{2,24}\b)
    |(?P<secret>(?i:\b(?:password|passwd|secret|token|api[_-]?key|access[_-]?key)\b["']?[ ]{0,3}[=:][ ]{0,3}["']?)(?P<value>[^\x00-\x20"'\x7f]{5,}[^\x00-\x20"'\x7f.,;:!?)\]}])|\b(?:AKIA|ASIA)(?P<key_id>[A-Z0-9]{16})\b)
    |(?P<iban>\b(?:[A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]{4}){2,7}(?:[ -]?[A-Z0-9]{1,4})?+|[a-z]{2}[0-9]{2}(?:[ -]?[a-z0-9]{4}){2,7}(?:[ -]?[a-z0-9]{1,4})?+)\b)
    |(?P<phone>(?<![\w+])\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?){2,5}+(?![0-9])|(?<![\w+.-])\([2-9][0-9]{2}\)[ ]?[0-9]{3}[ .-][0-9]{4}(?![\w-])|(?<![\w+.-])[2-9][0-9]{2}(?P<dot>[.-])[2-9][0-9]{2}(?P=dot)[0-9]{4}(?![\w-]))
    |(?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9]))
    |(?P<date>(?<![\w/.-])(?:[0-9]{4}(?P<y>[/.-])[0-9]{2}(?P=y)[0-9]{2}|[0-9]{2}(?P<d>[/.-])[0-9]{2}(?P=d)[0-9]{4})(?=T[0-9]{2}:|(?!\w|[/.-][0-9])))
    |(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))
    |(?P<card>(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-]))""",
    re.X | re.A,
)
_WORTH = re.compile(r"[0-9@]|(?i:password|passwd|secret|token|api[_-]?key|access[_-]?key)|A[KS]IA")


def permute(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of range(size): a Feistel network on pairs below ceil(sqrt(size)), walked until it lands inside."""
    if size < 2:
        return value
    side = math.isqrt(size - 1) + 1

    def turn(k: int, half: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{tweak}|{size}|{k}|{half}".encode(), key=key[:64], digest_size=16).digest(), "big") % side

    while True:
        left, right = divmod(value, side)
        for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = (right - turn(k, left)) % side, left
            else:
                left, right = right, (left + turn(k, right)) % side
        value = left * side + right
        if value < size:
            return value


def luhn_digit(payload: str) -> str:
    total = sum(d if k % 2 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(payload))))
    return str(-total % 10)


def iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


_CLASSES = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7), "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7)]


def _like(shape: str, symbols: str, wanted: Callable[[str], bool]) -> str:
    """shape with its wanted characters replaced, in order, by symbols."""
    left = iter(symbols)
    return "".join(next(left) if wanted(c) else c for c in shape)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _mixed(text: str, key: bytes, kind: str, back: bool, hexadecimal: bool = False) -> str:
    """Each letter or digit to one of its class (lower case, capital, digit, both cases of Latin-1's other letters; or hexadecimal digit), all together as one mixed-radix number."""
    classes = ["0123456789abcdef"] if hexadecimal else _CLASSES
    value, size, places = 0, 1, []
    for at, c in enumerate(text):
        own = next((x for x in classes if c in x), None)
        if own:
            value, size = value * len(own) + own.index(c), size * len(own)
            places.append((at, own))
    value, out = permute(value, size, key, kind, back), list(text)
    for at, own in reversed(places):
        value, digit = divmod(value, len(own))
        out[at] = own[digit]
    return "".join(out)


def _is_card(text: str) -> bool:
    digits = _digits(text)
    return luhn_digit(digits[:-1]) == digits[-1] and len(set(digits)) > 1


def _card(text, key, back):
    if not _is_card(text):
        return None
    digits = _digits(text)
    middle = permute(int(digits[1:-1]), 10 ** (len(digits) - 2), key, "card", back)
    payload = digits[0] + str(middle).zfill(len(digits) - 2)
    return _like(text, payload + luhn_digit(payload), str.isdigit)


def _iban(text, key, back):
    plain = text.translate({32: None, 45: None}).upper()
    country, check, rest = plain[:2], plain[2:4], plain[4:]
    if not 15 <= len(plain) <= 34 or iban_check(country, rest) != check:
        return None
    rest = _mixed(rest, key, "iban", back)
    new = country + iban_check(country, rest) + rest
    return _like(text, new.lower() if text[0].islower() else new, lambda c: c not in " -")


def _ssn(text, key, back):
    area, group, serial = map(int, text.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    value = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    value, serial = divmod(permute(value, 898 * 99 * 9999, key, "ssn", back), 9999)
    area, group = divmod(value, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _phone(text, key, back):
    digits = _digits(text)
    if text[0] != "+":
        national, kept = digits, ""
    elif digits[0] == "1":
        national, kept = digits[1:], "1"
    else:
        if not 8 <= len(digits) <= 15 or digits[0] == "0":
            return None
        kept, rest = digits[:3], digits[3:]
        return _like(text, kept + str(permute(int(rest), 10 ** len(rest), key, f"phone{kept}", back)).zfill(len(rest)), str.isdigit)
    if len(national) != 10 or national[0] < "2" or national[3] < "2":
        return None
    value = (int(national[:3]) - 200) * 800 + int(national[3:6]) - 200
    value, last = divmod(permute(value * 10_000 + int(national[6:]), 6_400_000_000, key, "phone", back), 10_000)
    area, exchange = divmod(value, 800)
    return _like(text, f"{kept}{area + 200}{exchange + 200}{last:04d}", str.isdigit)


def _ip(text, key, back):
    parts = text.split(".")
    if any(len(p) > 1 and p[0] == "0" or int(p) > 255 for p in parts):
        return None
    value, usual = int.from_bytes(bytes(map(int, parts)), "big"), (1 << 24, 224 << 24)
    if usual[0] <= value < usual[1]:
        value = usual[0] + permute(value - usual[0], usual[1] - usual[0], key, "ip", back)
    else:  # first number 0 or over 223
        high = value >= usual[1]
        start, size = (usual[1], (1 << 32) - usual[1]) if high else (0, usual[0])
        value = start + permute(value - start, size, key, f"ip{high}", back)
    return ".".join(map(str, value.to_bytes(4, "big")))


#: The days of 1900 to 2099 up to the twelfth of their months, and later ones. Only the latter can be written month first without being read day first,
#: so each kind is permuted in itself: a day's pseudonym is the same in every order of its parts.
_DAYS = [[n for n in range(datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal()) if (datetime.date.fromordinal(n).day > 12) == late] for late in (False, True)]


def _date_parts(text: str) -> tuple[str, datetime.date] | None:
    """The order in which the parts stand and the date. Two-digit parts first are day, month unless that is no date."""
    a, b, c = (int(x) for x in re.split(r"[/.-]", text))
    orders = [("ymd", a, b, c)] if text[4:5] in "/.-" else [("dmy", c, b, a), ("mdy", c, a, b)]
    for order, year, month, day in orders:
        try:
            return order, datetime.date(year, month, day)
        except ValueError:
            continue
    return None


def _date(text, key, back):
    known = _date_parts(text)
    if not known or not 1900 <= known[1].year <= 2099:
        return None
    order, day = known
    late = day.day > 12
    days, sign = _DAYS[late], next(c for c in text if c in "/.-")
    new = datetime.date.fromordinal(days[permute(bisect_left(days, day.toordinal()), len(days), key, f"date{late}", back)])
    return new.strftime({"ymd": f"%Y{sign}%m{sign}%d", "dmy": f"%d{sign}%m{sign}%Y", "mdy": f"%m{sign}%d{sign}%Y"}[order])


def _email(text, key, back):
    local, _, domain = text.rpartition("@")
    return f"{_mixed(local, key, 'email', back)}@{domain}"


def _secret(value, key, back):
    hexadecimal = lambda v: bool(re.fullmatch("[0-9a-f]+", v))
    new = _mixed(value, key, "secret", back, hexadecimal(value))
    while hexadecimal(new) != hexadecimal(value):
        new = _mixed(new, key, "secret", back)
    return new


_MAPS = {"email": _email, "secret": _secret, "iban": _iban, "card": _card, "ssn": _ssn, "phone": _phone, "ip": _ip, "date": _date}


_CARD_LIKE = re.compile(r"[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5}", re.A)


_MORE = re.compile(r"(?:[ -]?[0-9])*+", re.A)
_PART = re.compile(r"[\w-]")
_CARD_RUN = re.compile(r"[0-9](?:[ -]?[0-9]){12,18}(?![\w-])", re.A)


def _readings(kind: str, text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Where the value may stand, the likeliest place first.

    As numbers or words may stand beside a card or IBAN, its parts between blanks and hyphens count too. Of a card, also those that begin in the match
    and end behind it: those that are grouped like one and begin with a digit of the large issuers first, then those grouped like one, then the earliest and longest.
    Grouping and first digit stay in a pseudonym. A phone number ends before the last valid card, grouped like one, that begins inside the match.
    """
    if kind == "phone":
        for gap in (k for k in range(end - 1, start, -1) if text[k] in " -"):
            m = _CARD_RUN.match(text, gap + 1)
            if m and any(a == gap + 1 and _CARD_LIKE.fullmatch(text, a, z) and _is_card(text[a:z]) for a, z in _readings("card", text, *m.span())):
                return [(start, gap), (start, end)]
        return [(start, end)]
    if kind not in ("card", "iban"):
        return [(start, end)]
    if kind == "iban":
        ends = [end, *[k for k in range(end - 1, start, -1) if text[k] in " -"]]
        return [(start, z) for z in ends if sum(c.isalnum() for c in text[start:z]) >= 15]
    starts = [start, *[k + 1 for k in range(start, end) if text[k] in " -"]]
    run = _MORE.match(text, end, end + 24).end()
    ends = [k for k in range(run, start, -1) if k == end or text[k - 1] in "0123456789" and (text[k : k + 1] in (" ", "-") or k == run and not _PART.match(text, k))]
    parts = [(a, z) for a in starts for z in ends if 13 <= sum(c.isdigit() for c in text[a:z]) <= 19]
    like = {p: bool(_CARD_LIKE.fullmatch(text, *p)) for p in parts}
    return sorted(parts, key=lambda p: (not (like[p] and text[p[0]] in "3456"), not like[p]))


def _next(text: str, at: int, key: bytes, back: bool) -> tuple[str, int, int, str] | None:
    """The first valid value from ``at`` on: kind, start, end, pseudonym."""
    while m := _SHAPES.search(text, at):
        kind = next(k for k in KINDS if m.group(k) is not None)
        start, end = m.span(kind if kind != "secret" else "value" if m["value"] else "key_id")
        for first, stop in _readings(kind, text, start, end):
            new = _MAPS[kind](text[first:stop], key, back)
            if new is not None:
                return kind, first, stop, new
        at = m.start() + 1
    return None


def pseudonymise(text: str, key: bytes, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with every valid value replaced, and (kind, start, length) of each.

    back undoes the values that it finds: all, unless a pseudonym and the numbers beside it happen to read as another valid value. restored() needs no luck.
    """
    found: list[tuple[str, int, int]] = []
    if not _WORTH.search(text):
        return text, found
    out, at = [], 0
    while hit := _next(text, at, key, back):
        kind, start, end, new = hit
        out += [text[at:start], new]
        found.append((kind, start, end - start))
        at = end
    return "".join([*out, text[at:]]), found


def restored(text: str, spans: list[tuple[str, int, int]], key: bytes) -> str:
    """The text before pseudonymise() gave it these spans."""
    out, at = [], 0
    for kind, start, length in spans:
        out += [text[at:start], _MAPS[kind](text[start : start + length], key, True)]
        at = start + length
    return "".join([*out, text[at:]])


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))


def _replaced(batches, key: bytes, back: bool):
    for batch in batches:
        texts, spans = [], []
        for text in batch.column(1).to_pylist():
            new, found = (None, []) if text is None else pseudonymise(text, key, back)
            texts.append(new)
            spans.append([{"kind": k, "start": s, "length": n} for k, s, n in found])
        counts = [pa.array([sum(x["kind"] == kind for x in row) for row in spans], pa.int64()) for kind in KINDS]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([len(x) for x in spans], pa.int64()), *counts, pa.array(spans, SPANS)], ["doc_id", "text", "n_pii", *[f"n_{k}" for k in KINDS], "spans"])


def pseudonyms(docs: DataFrame, key: bytes, id_col="doc_id", text_col="text", back: bool = False) -> DataFrame:
    """doc_id, text with pseudonyms, n_pii, a count for each kind, spans (kind, start and length in code points of the input).

    Kinds: payment cards (Luhn), IBANs (mod 97), US social security numbers, phone numbers (+country or
    North American), IPv4 addresses, calendar dates 1900-2099, local parts of e-mail addresses, and
    values of password, token, secret and key assignments (up to white space, a quote or closing punctuation), and access key ids. What fails its validation
    stays, as do letters outside ASCII and Latin-1. Equal days written in different orders get equal days. One row per
    input row, repeated rows and null ids too; a null text stays null with no spans, an empty one empty, long ones are read whole; an empty table gives an
    empty one; other columns are ignored. No shuffle. Whoever has the key can undo it, by restore(): keep it out of the code.
    back: undo the values that are found in the texts, where the spans are lost; see pseudonymise().
    """
    rows = picked(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    counts = "".join(f", n_{k} long" for k in KINDS)
    return rows.mapInArrow(lambda b: _replaced(b, key, back), f"doc_id {kind}, text string, n_pii long{counts}, spans array<struct<kind:string,start:int,length:int>>")


def restore(pseudonymous: DataFrame, key: bytes, id_col="doc_id", text_col="text", spans_col="spans") -> DataFrame:
    """doc_id and the original text of every row that pseudonyms() gave, by its spans. Null texts stay null."""
    rows = picked(pseudonymous, doc_id=id_col, text=text_col, spans=spans_col)

    def run(batches):
        for batch in batches:
            pairs = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            texts = [text and restored(text, [(x["kind"], x["start"], x["length"]) for x in spans], key) for text, spans in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def query(spark, sf_dir: str) -> DataFrame:
    """The key is hexadecimal in spark.cutloom.pii.key; without one, a random key is drawn that nobody keeps, so that the pseudonyms of two runs have nothing in common."""
    given = spark.conf.get(KEY_CONF, None)
    return pseudonyms(documents(spark, sf_dir), bytes.fromhex(given) if given else secrets.token_bytes(32))
