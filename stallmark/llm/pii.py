"""Personal information in free text: find it, replace it with typed placeholders, keep the rest.

Mentions are found in a fixed order, a later kind never looking into what an earlier one took: email addresses, numbers
that are no personal ones (device, bill, order, ticket and part numbers), identity numbers, phone numbers, addresses,
names. Numbers are validated by their format, a bare run of twelve digits by its check digit, names by the words around
them.

Validated numbers (and dates, where asked for) become format-preserving pseudonyms: the characters are permuted within their
alphabets by a keyed Feistel network, so equal values stay linked across documents, the format stays readable and the
holder of the key can turn them back. Numbers are canonical first: spelled-out, full-width and look-alike digits and
country codes make no difference.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import hmac
import secrets
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallmark.session import spread

KINDS = ("email", "phone", "id_number", "address", "name")
ROUNDS = 10


# --- Feistel permutation -------------------------------------------------------------------------------------------


def _round(key: bytes, tweak: bytes, i: int, x: int, bits: int) -> int:
    d = hmac.new(key, tweak + bytes([i]) + x.to_bytes(16, "big"), hashlib.sha256).digest()
    return int.from_bytes(d[:16], "big") & ((1 << bits) - 1)


def permute(x: int, size: int, key: bytes, tweak: bytes = b"", back: bool = False) -> int:
    """Keyed permutation of range(size): a balanced Feistel network, walked until it lands in the range again."""
    if not 0 <= x < size:
        raise ValueError("value out of range")
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        a, b = x >> half, x & mask
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                a, b = b ^ _round(key, tweak, i, a, half), a
            else:
                a, b = b, a ^ _round(key, tweak, i, b, half)
        x = a << half | b
        if x < size:
            return x


def pseudonym(value: str, key: bytes, kind: str = "", fixed: int = 0, back: bool = False) -> str:
    """Permute the letters and digits of a value within their alphabets, keeping all else and the first ``fixed`` characters."""
    where = [i for i, c in enumerate(value) if i >= fixed and c.isascii() and c.isalnum()]
    x, size = 0, 1
    for i in where:
        c = value[i]
        n, v = (10, ord(c) - 48) if c.isdigit() else (26, ord(c.upper()) - 65)
        x, size = x * n + v, size * n
    if size == 1:
        return value
    y = permute(x, size, key, kind.encode() + b"|" + value[:fixed].encode(), back)
    out = list(value)
    for i in reversed(where):
        n = 10 if value[i].isdigit() else 26
        y, v = divmod(y, n)
        out[i] = chr(48 + v) if n == 10 else chr((65 if value[i].isupper() else 97) + v)
    return "".join(out)


def pseudonym_date(day: dt.date, key: bytes, first: dt.date = dt.date(1900, 1, 1), last: dt.date = dt.date(2099, 12, 31), back: bool = False) -> dt.date:
    """A date of the same span of years; dates outside of it stay."""
    if not first <= day <= last:
        return day
    return first + dt.timedelta(days=permute((day - first).days, (last - first).days + 1, key, b"date", back))


def verhoeff(digits: str) -> bool:
    """Whether the last digit is the check digit of the others, in the dihedral group of order ten."""

    def times(a: int, b: int) -> int:
        turn = (a + b) % 5 if a < 5 else (a - b) % 5
        return turn + 5 * ((a >= 5) ^ (b >= 5))

    shift, x = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4), 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        for _ in range(i % 8):
            d = shift[d]
        x = times(x, d)
    return x == 0


_MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
_DATE = regex.compile(r"(?<![\d/.-])(?:(?P<y>\d{4})-(?P<m>\d{2})-(?P<d>\d{2})|(?P<d>\d{1,2})(?P<sep>[/.-])(?P<m>\d{1,2})(?P=sep)(?P<y>\d{4})|(?P<d>\d{1,2})\s(?P<name>\p{L}{3,9})\s(?P<y>\d{4}))(?![\d/-])")


def find_dates(text: str) -> list[tuple[int, int, dt.date]]:
    """Start, end and day of each valid date: 2023-05-13, 13/05/2023 (or with . or -), 13 May 2023."""
    out = []
    for m in _DATE.finditer(text):
        month = _MONTHS.get(m["name"][:3].lower(), 0) if m["name"] else int(m["m"])
        try:
            out.append((m.start(), m.end(), dt.date(int(m["y"]), month, int(m["d"]))))
        except ValueError:
            continue
    return out


def date_like(day: dt.date, written: str) -> str:
    """A day written as another date was written."""
    if regex.fullmatch(r"\d{4}-\d{2}-\d{2}", written):
        return day.isoformat()
    m = regex.fullmatch(r"\d{1,2}([/.-])\d{1,2}\1\d{4}", written)
    if m:
        return f"{day.day:02d}{m[1]}{day.month:02d}{m[1]}{day.year}"
    return f"{day.day} {list(_MONTHS)[day.month - 1].capitalize()} {day.year}"


# --- finding -------------------------------------------------------------------------------------------------------

_WIDE = {0xFF10 + i: 48 + i for i in range(10)} | {0x0966 + i: 48 + i for i in range(10)} | {0xFF0B: ord("+"), 0xFF20: ord("@"), 0xFF0E: ord("."), 0x00A0: 32, 0x2011: ord("-"), 0x2013: ord("-"), 0x2019: ord("'")}
_I = regex.IGNORECASE
_SPELLED = "zero|one|two|three|four|five|six|seven|eight|nine"
_DIGIT_WORDS = {w: str(i) for i, w in enumerate(_SPELLED.split("|"))}

_EMAIL = regex.compile(
    r"(?<![\w.+-])[a-z0-9](?:[\w.+-]*[a-z0-9])?"
    r"(?:\s?@\s?|\s*[(\[{<]\s*(?:at|@)\s*[)\]}>]\s*)"
    r"[a-z0-9-]+(?:(?:\.|\s*[(\[{<]\s*(?:dot|\.)\s*[)\]}>]\s*|\s+dot\s+)[a-z][a-z0-9-]*)+"
    r"|(?<![\w.+-])[a-z0-9](?:[\w.+-]*[a-z0-9])?\s+at\s+[a-z0-9-]+(?:\s+dot\s+[a-z][a-z0-9-]*)+",
    _I,
)
_OTHER = regex.compile(
    r"\b(?:imei|serial|s/n|invoice|bill|order|ticket|part|batch|docket|awb|tracking|gst(?:in)?|meid|receipt|model|policy|challan)\b(?:\s+(?:no|id|number|code)\b)?\s*[.:#-]*\s*(?:is\s+|ends\s+)?[a-z]{0,4}-?\d[\w-]*(?:[ -]\d+)*"
    r"|\b\d{10,}(?=\s+dated\b)|(?<!\d)\d{15}(?!\d)|(?<![\d-])\d{3}-\d{7}-\d{7}(?![\d-])",
    _I,
)
_ID_LABEL = r"(?:aadhaa?r|adhaa?r|uid(?:ai)?)(?:\s+card)?(?:\s*(?:no|number|id))?"
_ID = regex.compile(
    rf"\b{_ID_LABEL}(?:\s*[.:#-]|\s+is\b)*\s*(?P<n>\d{{4}}(?:[ -]?\d{{4}}){{2}})(?!\d)"
    r"|\bpassport(?:\s*(?:no|number))?(?:\s*[.:#-]|\s+is\b)*\s*(?P<n>[a-z]\s?\d{7})(?!\d)"
    r"|(?<![\d-])(?P<n>\d{4}([ -])\d{4}\2\d{4})(?![\d-])"
    r"|\b(?P<n>[a-z]{5}\d{4}[a-z])\b"
    r"|\b(?P<n>[a-z]{2}[ -]?\d{2}[ -]?(?:19|20)\d{2}[ -]?\d{7})(?!\d)"
    r"|\b(?P<n>[a-z]{3}\d{7})(?!\w)"
    r"|(?<![\d+-])(?P<n>(?P<bare>(?!91[6-9])[2-9]\d{11}))(?!\d)",
    _I,
)
_PHONE = regex.compile(
    r"(?<![\w.,/-])(?<!\d[ ])(?:\(?\+?91\)?[ -]*|0)?[6-9](?:[ .-]?\d){9}(?![.,-]?\d)(?!\w)"
    r"|(?<![\w.,/-])0\d{2,4}[ -]\d{6,8}(?![\w-])"
    r"|(?<![\w-])(?=(?:[OolI]*\d){5})[6-9OolI][0-9OolI]{9}(?!\w)",
    _I,
)
_PHONE_SPELLED = regex.compile(rf"\b(?:(?:plus\s+)?(?:nine\s+one\s+))?(?:(?:{_SPELLED})\b[ ,-]*){{9}}(?:{_SPELLED})\b", _I)
_STREET = r"(?:lane|road|rd|street|st|marg|gali|avenue|ave|cross|path|salai|sarani|row|chowk|bazaa?r)"
_STREET_WORD = regex.compile(rf"\b{_STREET}\b", _I)
_HOUSE = r"(?:(?:h\.?\s?no|house(?:\s*no)?|flat(?:\s*no)?|plot(?:\s*no)?|door(?:\s*no)?|shop(?:\s*no)?|unit|room(?:\s*no)?)\b\.?\s*[#:-]?\s*|#\s*)"
_PART = r"[\p{L}\d.'-]+(?:[ ][\p{L}\d.'-]+){0,2}"
_ADDRESS = regex.compile(
    rf"\b(?:{_HOUSE}\d+[a-z]?(?:\s?[-/]\s?\d+[a-z]?)?|(?<![\w.,/-])\d{{1,4}}[a-z]?(?:\s?[-/]\s?\d{{1,4}}[a-z]?)?)"
    rf"(?:,?\s+(?:\d{{1,2}}(?:st|nd|rd|th)\s+floor|(?!\d)[\p{{L}}.'-]+(?:\s(?!\d)[\p{{L}}.'-]+)?\s*)(?=[,\s])){{0,3}}?,?\s+(?:(?!{_STREET}\b)[\p{{L}}.'-]+\s+){{1,2}}(?:main\s+)?{_STREET}\b\.?"
    rf"(?:,\s*(?:near|opp|opposite|behind|beside)\b\.?\s+(?:[\p{{L}}]+\s?){{1,3}}(?=[.,\n]|$)|,\s*(?!(?:evenings?|mornings?|weekends?|only|any|before|after|call|come|ask)\b)[\p{{L}}'-]+(?:\s?-\s?\d{{6}}|\s\d{{6}})?(?=\W|$)){{0,3}}",
    _I,
)

_TITLE = r"(?:dr|mr|mrs|ms|miss|shri|smt|sri|prof|er|adv)\b\.?"
#: Words that never begin or continue a name after a cue.
_NOT = (
    r"(?:the|a|an|any|more|me|us|my|our|your|you|it|this|that|only|brand|seller|owner|original|genuine|sales|team|care|store|shop|service|support|helpdesk|customer|"
    r"in|on|at|for|and|or|with|of|from|to|by|is|was|will|be|i|we|he|she|they|before|after|here|please|thanks|first|call|contact|details|specs|"
    r"aadhaa?r|adhaa?r|uid|pan|passport|driving|voter|licen[cs]e|number|no|person|chat|price|pics|photos|directly|bill|box|invoice|warranty|not|very|still|all)\b"
)
_W = rf"(?!{_NOT})\p{{L}}[\p{{L}}\p{{M}}]+"
_FULL = rf"(?<![\p{{L}}])(?:{_TITLE}\s+)?(?:\p{{L}}\.\s*)?{_W}(?:\s(?:\p{{L}}\.\s*)?{_W})?"
_ONE = rf"(?<![\p{{L}}])(?:{_TITLE}\s+)?(?:\p{{L}}\.\s*)?{_W}"
_KIN = r"(?:brother|sister|father|mother|son|daughter|wife|husband|uncle|aunt|cousin|friend|nephew|niece|neighbour|colleague|dad|mom)"
_GAP = r"[ \t]+"
#: Cue (a plain string that must occur in the lower-case text), how many words before it the name may begin (0: the name
#: follows the cue), whether the rule is for titles only, and the pattern.
_NAME_RULES = [
    (cue, before, title, regex.compile(p, _I))
    for cue, before, title, p in (
        ("name of", 0, False, rf"\b(?:in|under){_GAP}the{_GAP}name{_GAP}of{_GAP}(?P<n>{_FULL})"),
        ("k to ", 0, False, rf"\b(?:speak|talk){_GAP}to{_GAP}(?:my{_GAP}{_KIN}{_GAP})?(?P<n>{_FULL})(?={_GAP}(?:for|at|on|about)\b|[.,\n]|$)"),
        ("write to", 0, False, rf"\bwrite{_GAP}to{_GAP}(?P<n>{_FULL})(?={_GAP}(?:at|on)\b)"),
        ("deal ", 0, False, rf"\bdeal{_GAP}(?:directly{_GAP})?with{_GAP}(?P<n>{_FULL})(?=\s*[,.\n\x01]|$)"),
        ("this is ", 0, False, rf"\bthis{_GAP}is{_GAP}(?P<n>{_FULL})(?=\s*,)"),
        (":", 0, False, rf"\b(?:contact{_GAP}person|contact{_GAP}name|name|owner|seller{_GAP}name)\s*:\s*(?P<n>{_FULL})"),
        ("contact ", 0, False, rf"\bcontact{_GAP}(?P<n>{_FULL})(?={_GAP}(?:on|at|for)\b|{_GAP}?\x01)"),
        ("contact ", 0, True, rf"\bcontact{_GAP}(?P<n>{_FULL})"),
        ("seller ", 0, True, rf"\bseller{_GAP}(?P<n>{_FULL})"),
        ("ask for ", 0, True, rf"\bask{_GAP}for{_GAP}(?P<n>{_FULL})"),
        (" here", 8, False, rf"(?:^|(?<=[\n.!?\x01\x02])\s*)(?P<n>{_FULL})(?={_GAP}here\s*,)"),
        ("- ", 0, False, rf"(?:^|(?<=[\n.!?\x01\x02])[ \t]*|\n)[-–—~][ \t]*(?P<n>{_FULL})(?=\s*(?:\n|$|[.!])|{_GAP}\p{{Lu}})"),
        (" - \x01p", 8, False, rf"(?:^|(?<=[\n.!?)\x01\x02])\s*)(?P<n>{_FULL})(?=[ ]-[ ]\x01P)"),
        ("regards", 0, False, rf"\bregards\b[ ,]*\n?(?P<n>{_FULL})(?!{_GAP}?(?:sales|team|care|store|shop|support|traders|electronics|mobiles))(?![\p{{L}}])"),
        ("it was ", 0, False, rf"\bit{_GAP}was{_GAP}(?P<n>{_FULL})(?='s\b)"),
        ("pay to ", 0, False, rf"\bpay{_GAP}to{_GAP}(?P<n>{_FULL})(?={_GAP}only\b|[.,\n]|$)"),
        ("yours ", 0, False, rf"\byours{_GAP}(?:truly|faithfully|sincerely)[ ,]*\n?(?P<n>{_FULL})"),
        (" will be ", 8, False, rf"(?P<n>{_FULL})(?={_GAP}will{_GAP}be{_GAP}(?:at{_GAP}home|there|available))"),
        ("ask for ", 0, False, rf"\bask{_GAP}for{_GAP}(?P<n>{_FULL})(?={_GAP}(?:at|on|in)\b|\s*[.,\n]|$)"),
        ("name is ", 0, False, rf"\bmy{_GAP}name{_GAP}is{_GAP}(?P<n>{_FULL})"),
        ("meet ", 0, False, rf"\bmeet{_GAP}(?P<n>{_FULL})(?={_GAP}(?:for|at|on|in)\b|{_GAP}?\x01)"),
        *((t, 0, False, rf"\b(?P<n>{_TITLE}\s+(?:\p{{L}}\.\s*)?{_W}(?:\s{_W})?)(?=\W|$)") for t in ("dr", "mr", "ms", "miss ", "shri", "smt", "sri ", "prof")),
    )
]


_AT = regex.compile(r"[(\[{<]\s*at\s*[)\]}>]")
_SPELLED_TWO = regex.compile(rf"\b(?:{_SPELLED})[ ,-]+(?:{_SPELLED})\b")


@dataclass(frozen=True)
class Mention:
    kind: str
    start: int
    end: int
    value: str  # canonical


def _blank(text: list[str], start: int, end: int, sign: str) -> None:
    """Cover a mention: a start sign, its kind and fillers, as long as it was."""
    text[start:end] = ["\x01", sign, *["\x02"] * (end - start)][: end - start]


def canonical_phone(raw: str) -> str:
    """Ten digits (eleven with area code) of a phone number however it is written."""
    words = regex.findall(rf"\b(?:{_SPELLED})\b", raw.lower())
    if words:
        digits = "".join(_DIGIT_WORDS[w] for w in words)
    else:
        digits = "".join({"O": "0", "o": "0", "l": "1", "I": "1"}.get(c, c) for c in raw if c.isdigit() or c in "OolI")
    if len(digits) == 12 and digits.startswith("91"):
        digits = digits[2:]
    return digits[1:] if len(digits) == 11 and digits[0] == "0" and digits[1] in "6789" else digits


def _back(text: str, at: int, words: int) -> int:
    """Start of the text ``words`` words before a position, however long the words are: no pattern reaches further."""
    inside = False
    while at > 0:
        blank = text[at - 1].isspace()
        if inside and blank:
            words -= 1
            if words == 0:
                return at
        inside = not blank
        at -= 1
    return 0


def _ahead(text: str, at: int, words: int) -> int:
    """End of the text ``words`` words after a position."""
    inside = False
    while at < len(text):
        blank = text[at].isspace()
        if inside and blank:
            words -= 1
            if words == 0:
                return at
        inside = not blank
        at += 1
    return len(text)


def find_mentions(text: str | None, title: bool = False) -> list[Mention]:
    """All mentions of a text in order; none for null and empty texts."""
    if not text:
        return []
    t = text.translate(_WIDE)
    chars = list(t)
    out: list[Mention] = []

    def take(kind: str, start: int, end: int, value: str, sign: str) -> None:
        out.append(Mention(kind, start, end, value))
        _blank(chars, start, end, sign)

    low = t.lower()
    digits = sum(c.isdigit() for c in t)
    if "@" in t or "dot" in low or _AT.search(low):
        for m in _EMAIL.finditer(t):
            v = regex.sub(r"\s*[(\[{<]?\s*\b(?:at)\b\s*[)\]}>]?\s*", "@", m[0].lower(), count=1) if "@" not in m[0] else m[0].lower()
            v = regex.sub(r"\s*[(\[{<]?\s*\bdot\b\s*[)\]}>]?\s*", ".", v)
            take("email", m.start(), m.end(), regex.sub(r"\s", "", v), "E")
    if digits >= 4:
        for m in _ID.finditer("".join(chars)):
            s, e = m.span("n")
            if m["bare"] and not verhoeff(m["bare"]):
                continue  # neither named nor grouped: only the check digit tells
            before = low[max(0, s - 14) : s]
            if regex.search(r"(?:serial|imei|order|invoice|bill|part|model|ticket)\b[^.]*$", before):
                continue
            take("id_number", s, e, regex.sub(r"[^A-Za-z0-9]", "", t[s:e]).upper(), "I")
        for m in _OTHER.finditer("".join(chars)):
            if regex.search(r"\d", m[0]):
                _blank(chars, m.start(), m.end(), "X")
    if digits >= 5:
        for m in _PHONE.finditer("".join(chars)):
            take("phone", m.start(), m.end(), canonical_phone(t[m.start() : m.end()]), "P")
    if _SPELLED_TWO.search(low):
        for m in _PHONE_SPELLED.finditer("".join(chars)):
            take("phone", m.start(), m.end(), canonical_phone(t[m.start() : m.end()]), "P")
    if digits:
        line, done = "".join(chars), 0
        for w in _STREET_WORD.finditer(line):
            if w.start() < done:
                continue
            m = _ADDRESS.search(line, max(done, _back(line, w.start(), 16)), _ahead(line, w.end(), 24))
            if m and m.end() >= w.end() and "\x01" not in m[0]:
                take("address", m.start(), m.end(), m[0].lower(), "A")
                done = m.end()
    line = "".join(chars)
    low = line.lower()
    for cue, before, only_title, p in _NAME_RULES:
        if cue not in low or (only_title and not title):
            continue
        if before:
            spans, at = [], low.find(cue)
            while at >= 0:
                m = p.search(line, _back(line, at, before), _ahead(line, at + len(cue), 8))
                if m:
                    spans.append(m.span("n"))
                at = low.find(cue, at + 1)
        else:
            spans = [m.span("n") for m in p.finditer(line)]
        for s, e in spans:
            if not any(c in "\x01\x02" for c in chars[s:e]):
                take("name", s, e, regex.sub(r"\s+", " ", t[s:e]).lower(), "N")
        if spans:
            line = "".join(chars)
            low = line.lower()
    return sorted(out, key=lambda x: x.start)


def placeholder(m: Mention, key: bytes) -> str:
    if m.kind == "phone":
        return f"[PHONE {pseudonym(m.value, key, 'phone')}]"
    if m.kind == "id_number":
        return f"[ID_NUMBER {pseudonym(m.value, key, 'id')}]"
    return f"[{m.kind.upper()}]"


def redact(text: str | None, key: bytes, title: bool = False, dates: bool = False) -> tuple[str | None, list[Mention]]:
    """Text with placeholders, and the mentions; null stays null. ``dates``: valid dates outside of mentions become pseudonyms too."""
    found = find_mentions(text, title)
    if text is None:
        return text, found
    parts = [(m.start, m.end, placeholder(m, key)) for m in found]
    if dates:
        parts += [(s, e, f"[DATE {date_like(pseudonym_date(day, key), text[s:e])}]") for s, e, day in find_dates(text) if all(e <= m.start or s >= m.end for m in found)]
    out, at = [], 0
    for s, e, sign in sorted(parts):
        out += [text[at:s], sign]
        at = e
    return "".join([*out, text[at:]]), found


def session_key(spark: SparkSession) -> str:
    """The key of the pseudonyms that the session sets as stallmark.pii.key; else one drawn at random for this session."""
    key = spark.conf.get("stallmark.pii.key", "")
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set("stallmark.pii.key", key)
    return key


def redact_table(df: DataFrame, ident: str, fields: dict[str, bool], key: str, dates: bool = False) -> DataFrame:
    """``record_id``, ``field``, ``redacted``, ``mentions`` (array of pii_kind, occurrence) for every row and field.

    ``fields`` names the text columns and whether each is a title; ``key`` is the secret of the pseudonyms and must not be
    empty. Rows stay rows; nothing is shuffled; null and empty texts stay as they are.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    src = df.select(F.col(ident).cast("bigint").alias("record_id"), *[F.col(c).alias(f"f{i}") for i, c in enumerate(fields)])
    secret, names = key.encode(), list(fields.items())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, (name, title) in enumerate(names):
                for rid, text in zip(pdf["record_id"], pdf[f"f{i}"]):
                    red, found = redact(text, secret, title, dates)
                    seen: dict[str, int] = {}
                    cases = []
                    for m in found:
                        seen[m.kind] = seen.get(m.kind, 0) + 1
                        cases.append({"pii_kind": m.kind, "occurrence": seen[m.kind]})
                    rows.append((rid, name, red, cases))
            yield pd.DataFrame(rows, columns=["record_id", "field", "redacted", "mentions"])

    return spread(src).mapInPandas(run, "record_id bigint, field string, redacted string, mentions array<struct<pii_kind:string,occurrence:bigint>>")
