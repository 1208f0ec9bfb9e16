"""Format-preserving pseudonyms: validated numbers and dates are permuted within their format under a key.

DataFrame functions only.  A value's symbols are split in two halves that change in turn (an alternating
Feistel network of ``ROUNDS`` rounds): each half is shifted by a SHA-512 of the key, the kind, the round and
the other half.  Each round can be undone, so every kind's values are permuted one to one; equal values
have equal pseudonyms in all documents (however they are punctuated), and the key's holder can restore
them (``reverse=True``).

==========  =====================================================  ==========================================
kind        found and validated                                    permuted
==========  =====================================================  ==========================================
card        13 to 19 digits (or groups of 4, or 4-6-5)             all digits but the last, which is set anew
            with a valid Luhn check digit                          to a valid check digit
iban        country, check digits, 11 to 30 capitals or digits     letters and digits of the account within
            (also printed in groups of 4) with a valid             their class; check digits are set anew
            remainder of 97
phone       ``+`` and 8 to 15 digits (spaces, dots, hyphens,       the last digits, up to ten; the country
            brackets between)                                      code stays
ssn         ddd-dd-dddd with a valid area, group and serial        the number among all valid ones
ip          four numbers of 0 to 255                               the 32-bit number
date        yyyy-mm-dd, dd.mm.yyyy or mm/dd/yyyy that exists,      the day among the 73,441 of that time
            1900-01-01 to 2101-01-27
email       local part of letters, digits and ``._+-``             letters and digits of the local part within
                                                                   their class; the domain stays
==========  =====================================================  ==========================================

A number may follow a value after a space.  A card in groups of 4 ends after 16 digits if these are valid, an
IBAN at its country's length, a phone at its country's length if all numbers there have the same (``PLANS``);
other phones end at the last separator within 15 digits, so a short number behind one of these may be taken
for a part of it.  What follows a value stays as text.

Numbers that fail their check stay as they are.  A text without matches is returned unchanged.

Defined results: null text stays null; empty text stays empty; repeated rows give repeated rows; an empty
table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthkit.llm.common import free_name

ROUNDS = 8
KINDS = ("email", "iban", "ip", "date", "ssn", "phone", "card")
DAYS = 271 * 271  # from 1900-01-01 to 2101-01-27
_DAY = "(?:0[1-9]|[12][0-9]|3[01])"
_MONTH = "(?:0[1-9]|1[0-2])"
_YEAR = "(?:19|20|21)[0-9][0-9]"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Country codes with one length for all numbers -> digits after the code.
PLANS = {"1": 10, "7": 10, "30": 10, "31": 9, "33": 9, "34": 9, "41": 9, "45": 8, "47": 8, "48": 9, "52": 10, "61": 9, "91": 10,
         "351": 9, "420": 9}
_PLANNED = "|".join(rf"\+{c}(?:[ .-]?\(?[0-9]\)?){{{n}}}(?![0-9])" for c, n in PLANS.items())
#: Country codes of one and of two digits; all others have three.
_CODE_1 = "^[17]"
_CODE_2 = "^(?:2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
#: Length of a country's IBANs.
IBANS = {c: int(n) for c, n in (x.split(":") for x in (
    "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BI:27 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DJ:27 DK:18 DO:28 "
    "EE:20 EG:29 ES:24 FI:18 FK:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 "
    "JO:30 KW:30 KZ:20 LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 LY:25 MC:27 MD:24 ME:22 MK:19 MN:20 MR:27 MT:31 MU:30 NI:28 NL:18 "
    "NO:15 OM:23 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 RU:33 SA:24 SC:31 SD:18 SE:24 SI:19 SK:24 SM:27 SO:23 ST:25 SV:28 "
    "TL:23 TN:24 TR:26 UA:29 VA:22 VG:24 XK:20 YE:30").split())}
#: Shapes of the kinds, as whole values; the first that fits decides.
SHAPES = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "iban": r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}|[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?",
    "ip": rf"{_OCTET}(?:\.{_OCTET}){{3}}",
    "date": rf"{_YEAR}-{_MONTH}-{_DAY}|{_DAY}\.{_MONTH}\.{_YEAR}|{_MONTH}/{_DAY}/{_YEAR}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "phone": _PLANNED + r"|\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?){2,5}",
    "card": r"[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -]?[0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}",
}
#: No letter, digit or dot with a digit may stand beside a value.
FIND = r"(?<![A-Za-z0-9])(?<![0-9][.])(?:" + "|".join(f"(?:{SHAPES[k]})" for k in KINDS) + r")(?![A-Za-z0-9@])(?![.-][0-9])"

_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _named(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once (a let-binding by way of a one-element array)."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _digest(key: str, kind: str, number: Column, other: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), number.cast("string"), other), 512)


def _hex_number(hexes: Column, at: Column, width: int) -> Column:
    return F.conv(F.substring(hexes, at * width + 1, F.lit(width)), 16, 10).cast("bigint")


def _rounds(reverse: bool) -> Column:
    return F.array(*[F.lit(i) for i in (reversed(range(ROUNDS)) if reverse else range(ROUNDS))])


def permute_number(value: Column, low: int, high: int, key: str, kind: str, reverse: bool = False) -> Column:
    """Permutation of 0 .. ``low * high`` - 1 (halves of those moduli); null stays null."""
    start = F.struct(F.floor(value / high).cast("bigint").alias("a"), F.pmod(value, F.lit(high)).cast("bigint").alias("b"))

    def step(s, i):
        sign = F.lit(-1 if reverse else 1)
        by_b = _hex_number(_digest(key, kind, i, s["b"].cast("string")), F.lit(0), 12) * sign
        by_a = _hex_number(_digest(key, kind, i, s["a"].cast("string")), F.lit(0), 12) * sign
        return F.when(i % 2 == 0, F.struct(F.pmod(s["a"] + by_b, F.lit(low)).alias("a"), s["b"].alias("b"))).otherwise(
            F.struct(s["a"].alias("a"), F.pmod(s["b"] + by_a, F.lit(high)).alias("b")))

    return F.when(value.isNotNull(), F.aggregate(_rounds(reverse), start, step, lambda s: s["a"] * F.lit(high) + s["b"]))


def _shift(c: Column, by: Column) -> Column:
    """A symbol moved on within its class (digit, lower-case or capital letter); others stay."""
    out = c
    for symbols in (_UPPER, _LOWER, "0123456789"):
        n, at = len(symbols), F.instr(F.lit(symbols), c)
        moved = F.substring(F.lit(symbols), F.pmod(at - 1 + by, F.lit(n)).cast("int") + 1, F.lit(1))
        out = F.when((at > 0) & (c != ""), moved).otherwise(out)
    return out


def permute_symbols(value: Column, key: str, kind: str, reverse: bool = False) -> Column:
    """Permutation of strings in which each symbol keeps its place's class.

    The digest depends on the other half, so both halves are needed whole; a value of one symbol is shifted.
    """
    half = F.floor(F.char_length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), half).alias("a"), F.substring(value, half + 1, F.char_length(value)).alias("b"))

    def moved(part, other, i):
        def shifted(hexes):
            chars = F.split(part, "")
            return F.array_join(F.transform(chars, lambda c, j: _shift(
                c, _hex_number(hexes, F.pmod(j, F.lit(21)), 6) * F.lit(-1 if reverse else 1))), "")
        return F.when(part == "", part).otherwise(_named(_digest(key, kind, i, other), shifted))

    def step(s, i):
        return F.when(i % 2 == 0, F.struct(moved(s["a"], s["b"], i).alias("a"), s["b"].alias("b"))).otherwise(
            F.struct(s["a"].alias("a"), moved(s["b"], s["a"], i).alias("b")))

    return F.aggregate(_rounds(reverse), start, step, lambda s: F.concat(s["a"], s["b"]))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _put_digits(shape: Column, digits: Column) -> Column:
    """The digits of ``shape`` replaced in turn by ``digits``."""
    def char(c, i):
        seen = F.char_length(_digits(F.substring(shape, F.lit(1), i + 1)))
        return F.when(c.rlike("[0-9]"), F.substring(digits, seen, F.lit(1))).otherwise(c)
    return F.array_join(F.transform(F.split(shape, ""), char), "")


def luhn_sum(digits: Column, doubled_last: bool) -> Column:
    """Luhn sum of a string of digits; ``doubled_last``: the last digit is one of those doubled."""
    n = F.char_length(digits)

    def add(acc, c, i):
        d = c.cast("int")
        double = F.pmod(n - 1 - i, F.lit(2)) == (0 if doubled_last else 1)
        return acc + F.when(double, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    terms = F.transform(F.split(digits, ""), lambda c, i: add(F.lit(0), c, i))
    return F.aggregate(terms, F.lit(0), lambda a, x: a + x)


def _mod97(c: Column) -> Column:
    """Remainder by 97 of an IBAN's letters (A = 10 ...) and digits."""
    def add(acc, ch):
        at = F.instr(F.lit("0123456789" + _UPPER), ch) - 1
        return F.pmod(acc * F.when(at > 9, 100).otherwise(10) + at, F.lit(97))
    return F.aggregate(F.split(c, ""), F.lit(0), add)


def _compact(value: Column) -> Column:
    return F.translate(value, " ", "")


def _iban_valid(value: Column) -> Column:
    compact = _compact(value)
    return _mod97(F.concat(F.substring(compact, 5, 40), F.substring(compact, 1, 4))) == 1


def _card_valid(digits: Column) -> Column:
    return (F.pmod(luhn_sum(digits, False), F.lit(10)) == 0) & ~digits.rlike("^0+$")


def head_of(match: Column) -> Column:
    """What of a match of ``FIND`` is the value: all, or its beginning up to a separator."""
    country = F.substring(match, 1, 2)
    lengths = F.create_map(*[F.lit(x) for pair in IBANS.items() for x in pair])

    def printed(n):  # an IBAN of n symbols in groups of four
        return F.substring(match, F.lit(1), n + F.floor((n - 1) / 4).cast("int"))

    n = F.char_length(_compact(match))
    known = printed(F.element_at(lengths, country))
    known = F.when(F.substring(match, F.char_length(known) + 1, F.lit(1)).isin("", " "), known)
    ends = F.filter(F.sequence(n, F.lit(15), F.lit(-1)), lambda k: (k == n) | (F.pmod(k, F.lit(4)) == 0))
    first_valid = F.get(F.filter(F.transform(ends, printed), _iban_valid), F.lit(0))
    iban = F.when(F.map_contains_key(lengths, country), F.coalesce(known, match)).otherwise(F.coalesce(first_valid, match))
    phone = F.regexp_extract(match, r"^\+(?:[ .()-]*[0-9]){8,15}\)?(?=[ .-])", 0)
    card = F.substring(match, 1, 19)
    return (F.when(match.rlike("^[A-Z]{2}[0-9]{2} [A-Z0-9 ]+$") & (n >= 15), iban)
            .when(match.startswith("+") & (F.char_length(_digits(match)) > 15) & (phone != ""), phone)
            .when(match.rlike("^[0-9]{4}(?:[ -][0-9]{4}){3}[ -][0-9]{1,3}$"),
                  F.when(_card_valid(_digits(card)), card).otherwise(match))
            .otherwise(match))


def kind_of(value: Column) -> Column:
    """The validated kind of a value, or null."""
    digits = _digits(value)
    checks = {
        "email": F.lit(True),
        "iban": _iban_valid(value),
        "ip": F.lit(True),
        "date": _day_number(value).between(0, DAYS - 1),
        "ssn": ~digits.rlike("^(000|666|9)") & ~digits.rlike("^...00") & ~digits.rlike("0000$"),
        "phone": F.char_length(digits).between(8, 15),
        "card": _card_valid(digits),
    }
    out = F.lit(None).cast("string")
    for kind in reversed(KINDS):
        out = F.when(value.rlike(f"^(?:{SHAPES[kind]})$"), F.when(checks[kind], F.lit(kind))).otherwise(out)
    return out


def _day_number(value: Column) -> Column:
    day = F.coalesce(F.try_to_date(value, "yyyy-MM-dd"), F.try_to_date(value, "dd.MM.yyyy"), F.try_to_date(value, "MM/dd/yyyy"))
    return F.datediff(day, F.lit("1900-01-01").cast("date"))


def pseudonym(value: Column, kind: Column, key: str, reverse: bool = False) -> Column:
    """The value's pseudonym in its own format (``reverse``: the value of a pseudonym)."""
    digits, n = _digits(value), F.char_length(_digits(value))

    # beyond 16 digits, the 16th keeps the Luhn sum of the first 16, which says where a card in groups ends
    shuffled = F.when(n > 16, F.concat(F.substring(digits, 1, 15), F.substring(digits, F.lit(17), n - 17))).otherwise(
        F.substring(digits, F.lit(1), n - 1))

    def card(p):
        kept = F.pmod(luhn_sum(F.substring(digits, 1, 16), False) - luhn_sum(F.substring(p, 1, 15), True), F.lit(10))
        body = F.when(n > 16, F.concat(F.substring(p, 1, 15), kept.cast("string"), F.substring(p, 16, 4))).otherwise(p)
        return _named(body, lambda q: _put_digits(value, F.concat(q, F.pmod(-luhn_sum(q, True), F.lit(10)).cast("string"))))

    def phone(k):
        return _named(permute_symbols(F.substring(digits, n - k + 1, k), key, "phone", reverse),
                      lambda p: _put_digits(value, F.concat(F.substring(digits, F.lit(1), n - k), p)))

    def iban(p):
        country = F.substring(value, 1, 2)
        check = F.lit(98) - _mod97(F.concat(p, country, F.lit("00")))
        new = F.concat(country, F.lpad(check.cast("string"), 2, "0"), p)
        return F.when(value.contains(" "), F.rtrim(F.regexp_replace(new, "(.{4})", "$1 "))).otherwise(new)

    code = F.when(digits.rlike(_CODE_1), 1).when(digits.rlike(_CODE_2), 2).otherwise(3)

    def ip(v):
        return F.concat_ws(".", *[F.shiftright(v, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])

    octets = F.transform(F.split(value, r"\."), lambda x: x.cast("bigint"))
    number = F.aggregate(octets, F.lit(0).cast("bigint"), lambda a, x: a * 256 + x)
    # valid SSNs in order: 898 areas (001-665, 667-899) x 99 groups x 9999 serials
    area, group, serial = (F.substring(digits, a, b).cast("bigint") for a, b in ((1, 3), (4, 2), (6, 4)))
    place = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1

    def ssn(v):
        a = F.floor(v / (99 * 9999))
        return F.concat_ws("-", F.lpad((a + F.when(a >= 665, 2).otherwise(1)).cast("string"), 3, "0"),
                           F.lpad((F.pmod(F.floor(v / 9999), F.lit(99)) + 1).cast("string"), 2, "0"),
                           F.lpad((F.pmod(v, F.lit(9999)) + 1).cast("string"), 4, "0"))

    def date(v):
        day = F.date_add(F.lit("1900-01-01").cast("date"), v.cast("int"))
        return (F.when(F.substring(value, 5, 1) == "-", F.date_format(day, "yyyy-MM-dd"))
                .when(F.substring(value, 3, 1) == ".", F.date_format(day, "dd.MM.yyyy")).otherwise(F.date_format(day, "MM/dd/yyyy")))

    local = F.substring_index(value, "@", 1)
    made = {
        "card": _named(permute_symbols(shuffled, key, "card", reverse), card),
        "phone": _named(F.least(n - code, F.lit(10)), phone),
        "iban": _named(permute_symbols(F.substring(_compact(value), 5, 40), key, "iban", reverse), iban),
        "ip": _named(permute_number(number, 65536, 65536, key, "ip", reverse), ip),
        "ssn": _named(permute_number(place, 898 * 99, 9999, key, "ssn", reverse), ssn),
        "date": _named(permute_number(_day_number(value), 271, 271, key, "date", reverse), date),
        "email": F.concat(permute_symbols(local, key, "email", reverse), F.substring(value, F.char_length(local) + 1, F.char_length(value))),
    }
    out = value
    for k, c in made.items():
        out = F.when(kind == k, c).otherwise(out)
    return out


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", reverse: bool = False) -> DataFrame:
    """``docs`` with every validated value replaced by its pseudonym, plus ``kinds`` (array, one entry per value).

    The text is cut at the values (``split`` and ``regexp_extract_all`` by the same pattern) and put together
    again; texts without a digit that could start a value are passed on as they are.
    """
    text = F.col(f"`{text_col}`")
    found, parts, kinds = (free_name(docs, n) for n in ("_found", "_parts", "kinds"))
    values = F.transform(F.transform(F.regexp_extract_all(text, F.lit(FIND), F.lit(0)), lambda m: F.struct(m.alias("m"), head_of(m).alias("v"))),
                         lambda x: F.struct(x["v"].alias("v"), kind_of(x["v"]).alias("k"),
                                            F.substring(x["m"], F.char_length(x["v"]) + 1, F.char_length(x["m"])).alias("tail")))
    some = docs.withColumn(found, F.when(text.rlike("[0-9@]"), values))
    changed = F.transform(F.col(found), lambda x: F.concat(
        F.when(x["k"].isNull(), x["v"]).otherwise(pseudonym(x["v"], x["k"], key, reverse)), x["tail"]))
    some = some.withColumn(parts, F.when(F.exists(found, lambda x: x["k"].isNotNull()), F.arrays_zip(
        F.split(text, FIND).alias("gap"), changed.alias("new"))))
    new = F.array_join(F.transform(F.col(parts), lambda p: F.concat(p["gap"], F.coalesce(p["new"], F.lit("")))), "")
    listed = F.coalesce(F.filter(F.transform(F.col(found), lambda x: x["k"]), lambda k: k.isNotNull()), F.array().cast("array<string>"))
    return some.select(*[F.coalesce(new, text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], listed.alias(kinds))
