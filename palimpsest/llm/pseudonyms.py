"""Format-preserving pseudonyms for personal data, in DataFrame operations only.

One pattern finds candidates; each is validated by kind, and what fails stays as it is: e-mail addresses, secrets that are
assigned to a name (token, key, password; of eight characters, or of four with a digit and a letter), IPv4 (octets to 255) and
IPv6 addresses (a digit and two to seven groups about "::", or eight groups), telephone numbers, payment card numbers (issuer
ranges, their lengths, and Luhn), bank account numbers (IBAN, modulo 97), social security numbers (issued ranges, ddd-dd-dddd)
and calendar dates of 1900 to 2099, in the layouts yyyy-mm-dd, dd.mm.yyyy, mm/dd/yyyy and, where the first number is above 12,
dd/mm/yyyy. Other spellings stay: blanks in social security numbers, telephone numbers without any separator, yyyy/mm/dd, "::1".

A card is bare, in groups of four, or as 4-6-5 or 4-6-4, with one kind of separator. A longer row of groups of four is cut
where cards begin, from the left; in one of more than TABLE groups, which is a table of numbers rather than cards, a card counts only
beside another. Numbers that pass Luhn by chance in an issuer's range are taken for cards; there is no telling.

A value is a row of symbols, each with the size of its own alphabet, and nothing but what varies is a symbol: a digit has
10, a letter 26 (or what its script has, in the local part of an address), an octet 256; a date is its day number as two
symbols of 17 and 4297; dd/mm/yyyy keeps to such days. Ten keyed Feistel rounds add to one half of the symbols, modulo their
sizes, what SHA-512 makes of the key, the tweak, the round and the other half, in blocks of 16 symbols with a hash each. A value of
one symbol is split into two factors first. The tweak is the kind, the sizes and what stays of the value: an address's
domain, a number's country code, a card's issuer. That permutes the values of a format, so the format holds, equal values stay equal in all
documents and different ones stay different; blanks and hyphens are no part of a number, which stays linked across its
spellings. Check digits of cards and accounts are computed anew, so they stay valid.

Fixed characters (punctuation, letters of scripts not listed in LETTERS) stay. A secret of 16 or more hexadecimal
characters stays hexadecimal; that one of other letters becomes such a row by chance is possible, and back then fails.

Defined results: a null text stays null with counts of 0; empty texts and texts without candidates stay as they are.
Equal texts stay equal. Repeated rows repeat. An empty table gives an empty result. The columns pii_... replace input
columns of these names. A very long text or value is handled whole.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "secret", "ip", "phone", "card", "iban", "ssn", "date")
ROUNDS, BLOCK = 10, 16
#: Days from 1900-01-01 to 2099-12-31, and their two factors.
DAYS, DATE_SIZES = 73049, (17, 4297)
#: First code point and number of neighbouring letters of one case or script.
LETTERS = ((0x61, 26), (0x41, 26), (0xDF, 24), (0xF8, 8), (0xC0, 23), (0xD8, 7), (0x100, 128), (0x3B1, 25), (0x430, 48), (0x400, 48), (0x5D0, 27), (0x621, 26), (0x641, 10), (0x904, 54), (0x3041, 86), (0x30A1, 90), (0x4E00, 20992), (0xAC00, 11172))

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HEX = "[0-9A-Fa-f]{1,4}"
#: The public issuer ranges of cards, by length; of 16 digits by the first four, with what an issuer is known by.
_BARE = (
    r"4\d{12}(?:\d{3}(?:\d{3})?)?|(?:5[1-5]\d\d|222[1-9]|22[3-9]\d|2[3-6]\d\d|27[01]\d|2720)\d{12}|3[47]\d{13}|3(?:0[0-5]\d|095|[689]\d\d)\d{10}"
    r"|(?:6011|64[4-9]\d|65\d\d|35(?:2[89]|[3-8]\d)|62\d\d|220[0-4])\d{12,15}|(?:5018|5020|5038|5893|6304|6759|676[1-3])\d{9,15}"
)
_SIX = r"3[47]\d\d(?: \d{6} \d{5}|-\d{6}-\d{5})|3(?:0[0-5]\d|095|[689]\d\d)(?: \d{6} \d{4}|-\d{6}-\d{4})"
_ISSUER = r"(?:4\d{3}|5[1-5]\d\d|222[1-9]|22[3-9]\d|2[3-6]\d\d|27[01]\d|2720|6011|64[4-9]\d|65\d\d|35(?:2[89]|[3-8]\d)|62\d\d|220[0-4]|5018|5020|5038|5893|6304|6759|676[1-3])"
_NETWORK = r"^(?:4|5[1-5]|2\d{3}|3[47]|30[0-5]|3095|3[689]|6011|64[4-9]|65|62|35\d\d|5018|5020|5038|5893|6304|6759|676[1-3])"
#: Four or more groups of four digits and one of up to three, none of which goes on as another number.
_GROUPS = r"\d{{4}}(?:{sep}\d{{4}}(?!\d|[{stop}]\d)){{3,}}+(?:{sep}\d{{1,3}}(?!\d|[{stop}]\d))?"
#: By kind, as found in a text and, between anchors, as a value.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}][\p{L}\p{N}\-]*+(?:\.[\p{L}\p{N}\-]++)+",
    "secret": r"(?i:token|secret|password|passwd|api[_\-]?key|access[_\-]?key|auth)[\"']?\s*+[:=]\s*+[\"']?(?:[A-Za-z0-9_\-+/=]{8,}+|(?=[A-Za-z_\-+/=]*+\d)(?=[\d_\-+/=]*+[A-Za-z])[A-Za-z0-9_\-+/=]{4,7}+)(?:\.[A-Za-z0-9_\-+/=]++)*+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z]{4})?(?: (?=[A-Z]*\d)[A-Z0-9]{4}){2,7}(?: (?=[A-Z]*\d)[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ip6": rf"(?<![\w:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}(?::{_HEX}){{0,6}})?::(?:{_HEX}(?::{_HEX}){{0,6}})?)(?![\w:])",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)",
    "phone": r"(?:(?<![\d\w])\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|(?<!\d)\d{3}[.\-])\d{3}[ .\-]\d{4}(?!\d)|(?<![\d\w])\+\d{1,3}(?:[ .\-]?\d{2,4}){2,4}(?!\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "date": r"(?<![\d.\-/])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\d\-/])",
    "card": rf"(?<!\d)(?<!\d[.,])(?:(?:{_BARE}|{_SIX})(?!\d|[.,]\d)|(?={_ISSUER})(?:{_GROUPS.format(sep=' ', stop='.,/-')}|{_GROUPS.format(sep='-', stop='.,/')}))",
}
#: What a candidate of these kinds begins with; it is looked at first.
STARTS = {r"(?=[A-Z])": ("iban",), r"(?=[0-9A-Fa-f]{0,4}:)": ("ip6",), r"(?=[\d+(])": ("ip", "phone", "ssn", "date", "card")}


def _any_of(*kinds: str) -> str:
    """One pattern of several kinds, the earlier first."""
    led = ["|".join(f"(?:{PATTERNS[k]})" for k in ("email", "secret"))]
    return "|".join(led + [f"{s}(?:" + "|".join(f"(?:{PATTERNS[k]})" for k in own if k in kinds) + ")" for s, own in STARTS.items()])


ANY = _any_of(*PATTERNS)
#: A row of more groups of four than a card has; as many groups as a single card may stand in; a card's groups.
LONG_ROW, TABLE, FOUR = r"^\d{4}([ \-])\d{4}\1\d{4}\1\d{4}\1\d", 12, 4
#: A value that is a card by its layout: not a longer row of groups.
LAYOUT = rf"^(?:{_BARE}|{_SIX}|{_ISSUER}(?:[ \-]\d{{4}}){{3}}(?:[ \-]\d{{1,3}})?)$"
#: A text without any of these characters has no candidate.
HINT = "[0-9@=:]"
#: One character that varies, by kind.
VARIES = {"email": "[0-9" + "".join(f"{chr(a)}-{chr(a + n - 1)}" for a, n in LETTERS) + "]", "hex": "[0-9A-Fa-f]", "other": "[0-9A-Za-z]"}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column, doubled: int) -> Column:
    """The Luhn sum; doubled: 0 if the last digit is doubled, 1 if the one before it is."""

    def add(total: Column, k: Column) -> Column:
        d = F.substring(digits, F.length(digits) - k, F.lit(1)).cast("int")
        return total + F.when(k % 2 == doubled, (d * 2) % 10 + F.floor(d / 5).cast("int")).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def _mod97(account: Column, lead: Column) -> Column:
    """An account number behind the check digits, then its country and check digits, modulo 97; letters count from 10."""

    def add(total: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), total * 10 + c.cast("int")).otherwise(total * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(F.regexp_extract_all(F.concat(account, lead), F.lit("[0-9A-Z]"), F.lit(0)), F.lit(0), add)


def _is(value: Column, kind: str) -> Column:
    return value.rlike(f"^(?:{PATTERNS[kind]})$")


def _date(value: Column) -> Column:
    """The calendar date of a value in one of the first three layouts, else null."""
    layout = F.when(value.contains("-"), F.try_to_date(value, "yyyy-MM-dd")).when(value.contains("."), F.try_to_date(value, "dd.MM.yyyy")).otherwise(F.try_to_date(value, "MM/dd/yyyy"))
    return F.when(F.year(layout).between(1900, 2099), layout)


def _day_first(value: Column) -> Column:
    """The calendar date of dd/mm/yyyy with a day above 12, else null."""
    layout = F.when(value.rlike(r"^(?:1[3-9]|[23]\d)/"), F.try_to_date(value, "dd/MM/yyyy"))
    return F.when(F.year(layout).between(1900, 2099), layout)


def _part(value: Column, k: int) -> Column:
    return F.split(value, "[.-]")[k].cast("int")


def kind_of(value: Column) -> Column:
    """The kind of a candidate that passes validation, else null; "day" is a date whose day comes first."""
    area, group, serial = (_part(value, k) for k in range(3))
    groups = F.size(F.regexp_extract_all(value, F.lit(_HEX), F.lit(0)))
    check = F.substring(value, 3, 2).cast("int")
    return (
        F.when(_is(value, "email"), "email")
        .when(_is(value, "secret"), "secret")
        .when(_is(value, "iban"), F.when(check.between(2, 98) & (_mod97(F.substring(value, 5, 1 << 20), F.substring(value, 1, 4)) == 1), "iban"))
        .when(_is(value, "ip6"), F.when(value.rlike(r"\d") & (groups >= 2) & ((groups <= 7) | ~value.contains("::")), "ip6"))
        .when(_is(value, "ip"), "ip")
        .when(_is(value, "ssn"), F.when((area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0), "ssn"))
        .when(_is(value, "date"), F.when(_date(value).isNotNull(), "date").when(_day_first(value).isNotNull(), "day"))
        .when(value.rlike(LAYOUT) & (_luhn(_digits(value), 1) % 10 == 0), "card")
        .when(_is(value, "phone"), "phone")
    )


def _with(once: Column, use: Callable[[Column], Column]) -> Column:
    """use(once), where once is computed a single time and not for each element that use goes through."""
    return F.transform(F.array(once), use)[0]


def _ints(*columns: Column) -> Column:
    return F.array(*[c.cast("int") for c in columns])


def _parts(x: Column) -> Column:
    """What stays in front, what varies, what stays behind, and the pattern of a character that varies."""
    kind, value = x["kind"], x["value"]
    local = F.substring_index(value, "@", 1)
    code = F.regexp_extract(value, r"^\+\d{1,3}(?=\D)|^\+\d", 0)
    name = F.regexp_extract(value, r"^.*?[:=]\s*[\"']?", 0)
    head = F.when(kind == "phone", code).when(kind == "secret", name).when(kind == "iban", F.substring(value, 1, 4)).when(kind == "card", F.regexp_extract(value, _NETWORK, 0)).otherwise("")
    tail = F.when(kind == "email", F.substring(value, F.length(local) + 1, F.length(value))).when(kind == "card", F.substring(value, -1, 1)).otherwise("")
    body = F.substring(value, F.length(head) + 1, F.length(value) - F.length(head) - F.length(tail))
    sixteen = (kind == "ip6") | ((kind == "secret") & body.rlike("^(?:[0-9a-f]{16,}|[0-9A-F]{16,})$"))
    varies = F.when(kind == "email", VARIES["email"]).when(sixteen, VARIES["hex"]).otherwise(VARIES["other"])
    return F.struct(kind.alias("kind"), value.alias("value"), head.alias("head"), body.alias("body"), tail.alias("tail"), varies.alias("varies"))


def _letter(c: Column, wide: Column) -> tuple[Column, Column]:
    """The first code point and the size of a character's alphabet."""
    at = F.ascii(c)
    pick = lambda few, i: reduce(lambda w, r: w.when(at.between(r[0], r[0] + r[1] - 1), r[i]), few, F.when(at < 58, (0x30, 10)[i]))
    first, size = (F.when(at < 128, pick(LETTERS[:2], i)).otherwise(F.when(wide, pick(LETTERS[2:], i))) for i in (0, 1))
    return first, size


def _spelt(x: Column) -> Column:
    """The symbols (value, size, first code point, 0 for hexadecimal ones) of the characters that vary."""
    def symbol(c: Column) -> Column:
        first, size = _letter(c, x["kind"] == "email")
        sixteen = x["varies"] == VARIES["hex"]
        return F.struct(
            F.when(sixteen, F.instr(F.lit("0123456789abcdef"), F.lower(c)) - 1).otherwise(F.ascii(c) - first).cast("int").alias("v"),
            F.when(sixteen, 16).otherwise(size).cast("int").alias("n"),
            F.when(sixteen, F.lit(0)).otherwise(first).cast("int").alias("first"),
        )

    return F.transform(F.regexp_extract_all(x["body"], x["varies"], F.lit(0)), symbol)


def _numbers(x: Column) -> Column:
    """(symbols, sizes) of a value; a single symbol comes as two factors."""
    value, kind = x["value"], x["kind"]
    day, first = F.datediff(_date(value), F.lit("1900-01-01").cast("date")), _day_first(value)
    area = _part(value, 0)
    year, month, of = F.year(first) - 1900, F.month(first), F.dayofmonth(first)
    short, long = of <= 28, of == 31
    spelt, sizes = F.transform(x["spelt"], lambda s: s["v"]), F.transform(x["spelt"], lambda s: s["n"])
    # of the months with a 31st, and of those but February
    nth31, nth30 = F.floor((month + F.when(month > 7, 1).otherwise(0)) / 2).cast("int"), month - F.when(month > 2, 2).otherwise(1)
    factor = F.when(F.element_at(sizes, 1) % 13 == 0, 13).when(F.element_at(sizes, 1) % 8 == 0, 8).when(F.element_at(sizes, 1) % 5 == 0, 5).when(F.element_at(sizes, 1) % 7 == 0, 7).when(F.element_at(sizes, 1) % 3 == 0, 3).otherwise(1)
    one = F.size(spelt) == 1
    struct = lambda s, n: F.struct(s.alias("s"), n.alias("n"))
    return (
        F.when(kind == "ip", struct(_ints(*[_part(value, k) for k in range(4)]), F.array(*[F.lit(256)] * 4)))
        .when(kind == "date", struct(_ints(F.floor(day / DATE_SIZES[1]), day % DATE_SIZES[1]), F.array(*map(F.lit, DATE_SIZES))))
        .when((kind == "day") & short, struct(_ints(year, month - 1, of - 13), F.array(F.lit(200), F.lit(12), F.lit(16))))
        .when((kind == "day") & long, struct(_ints(year, nth31), F.array(F.lit(200), F.lit(7))))
        .when((kind == "day") & (month == 2), struct(_ints(F.floor((year - 4) / 28), F.floor((year - 4) / 4) % 7), F.array(F.lit(7), F.lit(7))))
        .when(kind == "day", struct(_ints(year, nth30, of - 29), F.array(F.lit(200), F.lit(11), F.lit(2))))
        .when(kind == "ssn", struct(_ints(area - 1 - (area > 666).cast("int"), _part(value, 1) - 1, _part(value, 2) - 1), F.array(F.lit(898), F.lit(99), F.lit(9999))))
        .when(one, _with(factor, lambda f: struct(_ints(F.floor(spelt[0] / f), spelt[0] % f), _ints(F.floor(sizes[0] / f), f))))
        .otherwise(struct(spelt, sizes))
    )


def feistel(symbols: Column, sizes: Column, tweak: Column, key: str, *, back: bool = False) -> Column:
    """The symbols permuted; back undoes it. Even rounds change the first half, odd ones the second."""
    half = F.floor(F.size(symbols) / 2).cast("int")

    def turn(now: Column, k: Column) -> Column:
        first = F.slice(now, F.lit(1), half)
        second = F.slice(now, half + 1, F.size(now))
        even = k % 2 == 0
        seed = F.sha2(F.concat_ws("|", F.lit(key), tweak, k.cast("string"), F.array_join(F.when(even, second).otherwise(first).cast("array<string>"), ",")), 512)
        blocks = F.floor((F.size(now) - half + BLOCK - 1) / BLOCK).cast("int")
        noise = _with(seed, lambda s: F.when(blocks <= 1, F.array(s)).otherwise(F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: F.when(b == 0, s).otherwise(F.sha2(F.concat_ws("|", s, b.cast("string")), 512)))))

        def moved(v: Column, i: Column, noise: Column) -> Column:
            ours = F.when(even, i < half).otherwise(i >= half)
            at = F.when(even, i).otherwise(i - half)
            block = F.element_at(noise, F.floor(at / BLOCK).cast("int") + 1)
            add = F.conv(F.substring(block, (at % BLOCK) * 8 + 1, F.lit(7)), 16, 10).cast("int")
            size = F.element_at(sizes, i + 1)
            return F.when(ours, F.pmod(v - add if back else v + add, size)).otherwise(v)

        return _with(noise, lambda x: F.transform(now, lambda v, i: moved(v, i, x)))

    steps = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(steps, symbols, turn)


def tweak(x: Column) -> Column:
    """What must differ for equal symbols to get other pseudonyms: kind, sizes, domain, country code or issuer."""
    stays = F.when(x["kind"] == "email", F.lower(x["tail"])).when(x["kind"].isin("phone", "card"), x["head"]).when(x["kind"] == "iban", F.substring(x["head"], 1, 2)).otherwise("")
    return F.concat_ws("|", x["kind"], stays, F.array_join(x["n"].cast("array<string>"), ","))


def _written(x: Column) -> Column:
    """The value with new symbols, in its own layout."""
    kind, value, moved, n = x["kind"], x["value"], x["moved"], x["n"]
    date = F.date_add(F.lit("1900-01-01").cast("date"), moved[0] * DATE_SIZES[1] + moved[1])
    upper = x["body"].rlike("^[^a-z]*[A-F][^a-z]*$")
    last = F.when(F.size(x["spelt"]) == 1, F.array(moved[0] * F.element_at(n, -1) + F.element_at(moved, -1))).otherwise(moved)

    def character(s: Column, v: Column) -> Column:
        sixteen = F.substring(F.when(upper, F.lit("0123456789ABCDEF")).otherwise(F.lit("0123456789abcdef")), v + 1, F.lit(1))
        point = s["first"] + v
        return F.when(s["first"] == 0, sixteen).when(point < 128, F.char(point)).otherwise(F.decode(F.unhex(F.lpad(F.hex(point), 4, "0")), "UTF-16BE"))

    characters = F.zip_with(x["spelt"], last, character)
    plain = F.array_join(F.zip_with(F.split(x["body"], x["varies"], -1), characters, lambda p, c: F.concat(p, F.coalesce(c, F.lit("")))), "")
    check = F.pmod(-_luhn(_digits(F.concat(x["head"], plain)), 0), F.lit(10)).cast("string")
    country = F.substring(x["head"], 1, 2)
    checks = F.lpad((98 - _mod97(plain, F.concat(country, F.lit("00")))).cast("string"), 2, "0")
    area = moved[0] + 1
    # a day-first date: its day, month and year
    three = F.size(n) == 3
    leap, long = n[0] == 7, (n[0] == 200) & (n[1] == 7)
    day = F.when(leap, 29).when(long, 31).when(n[2] == 2, moved[2] + 29).otherwise(moved[2] + 13)
    month = F.when(leap, 2).when(long, moved[1] * 2 + 1 - F.when(moved[1] > 3, 1).otherwise(0)).when(n[2] == 2, moved[1] + F.when(moved[1] > 0, 2).otherwise(1)).otherwise(moved[1] + 1)
    year = F.when(leap, 1904 + moved[0] * 28 + moved[1] * 4).otherwise(1900 + moved[0])
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return (
        F.when(kind.isNull() | (F.size(moved) == 0), value)
        .when(kind == "ip", F.array_join(moved.cast("array<string>"), "."))
        .when(kind == "date", F.when(value.contains("-"), F.date_format(date, "yyyy-MM-dd")).when(value.contains("."), F.date_format(date, "dd.MM.yyyy")).otherwise(F.date_format(date, "MM/dd/yyyy")))
        .when(kind == "day", F.concat_ws("/", two(day), two(month), year.cast("string")))
        .when(kind == "ssn", F.concat_ws("-", F.lpad((area + (area >= 666).cast("int")).cast("string"), 3, "0"), two(moved[1] + 1), F.lpad((moved[2] + 1).cast("string"), 4, "0")))
        .when(kind == "card", F.concat(x["head"], plain, check))
        .when(kind == "iban", F.concat(country, checks, plain))
        .otherwise(F.concat(x["head"], plain, x["tail"]))
    )


def pseudonyms(values: Column, key: str, *, back: bool = False) -> Column:
    """array<string> to array<struct<kind, value, written>>."""
    kept = lambda x, *names: [x[c].alias(c) for c in names]
    parts = F.transform(F.transform(values, lambda v: F.struct(kind_of(v).alias("kind"), v.alias("value"))), _parts)
    names = ("kind", "value", "head", "body", "tail", "varies")
    by_letter = lambda x: ~F.coalesce(x["kind"].isin("ip", "date", "day", "ssn"), F.lit(True))
    spelt = F.transform(parts, lambda x: F.struct(*kept(x, *names), F.when(by_letter(x), _spelt(x)).alias("spelt")))
    numbers = F.transform(spelt, lambda x: F.struct(*kept(x, *names, "spelt"), F.when(x["kind"].isNotNull(), _numbers(x)).alias("numbers")))
    flat = F.transform(numbers, lambda x: F.struct(*kept(x, *names, "spelt"), x["numbers"]["s"].alias("s"), x["numbers"]["n"].alias("n")))
    moved = F.transform(flat, lambda x: F.struct(*kept(x, *names, "spelt", "n"), F.when(x["kind"].isNotNull(), feistel(x["s"], x["n"], tweak(x), key, back=back)).alias("moved")))
    named = F.transform(moved, lambda x: F.struct(*kept(x, *names, "spelt", "n", "moved"), _written(x).alias("written")))
    shown = lambda kind: F.when(kind == "ip6", "ip").when(kind == "day", "date").otherwise(kind)
    return F.transform(named, lambda x: F.struct(shown(x["kind"]).alias("kind"), x["value"].alias("value"), x["written"].alias("written")))


def _cut(row: Column) -> Column:
    """A row of groups of four, cut into what is between cards, a card, and so on, from the left."""

    def sound(groups: Column) -> Column:
        card = lambda d: F.coalesce((F.length(d) == 16) & d.rlike(f"^{_ISSUER}") & (_luhn(d, 1) % 10 == 0), F.lit(False))
        return F.transform(groups, lambda _, i: _with(F.concat(*[F.get(groups, i + k) for k in range(FOUR)]), card))

    def marked(groups: Column, sound: Column) -> Column:
        beside = lambda i: F.coalesce(F.get(sound, i - FOUR), F.lit(False)) | F.coalesce(F.get(sound, i + FOUR), F.lit(False))
        begins = F.transform(sound, lambda s, i: s & ((F.size(sound) <= TABLE) | beside(i)))
        return F.array_join(F.zip_with(groups, begins, lambda g, s: F.concat(F.when(s, "V").otherwise("."), g)), " ")

    row_ = _with(F.split(row, "[ \\-]"), lambda g: _with(sound(g), lambda s: marked(g, s)))
    # the pattern goes from the left and takes what does not overlap
    set_off = F.translate(F.regexp_replace(row_, r"V(\d{4}) [V.](\d{4}) [V.](\d{4}) [V.](\d{4})", "|$1 $2 $3 $4|"), "V.", "")
    return F.split(F.when(F.substring(row, 5, 1) == "-", F.translate(set_off, " ", "-")).otherwise(set_off), r"\|", -1)


def _of(kind: str) -> Callable[[Column], Column]:
    return lambda x: F.coalesce(x["kind"] == kind, F.lit(False))


def pseudonymise(docs: DataFrame, text_col: str = "text", *, key: str | None = None, back: bool = False) -> DataFrame:
    """docs with its personal data replaced, and pii_<kind>, the number of values replaced, for each kind.

    key: the secret; if not given, the session's palimpsest.pseudonym.key. There is no default. It is part of the plan,
    so event logs must be guarded like the key. back restores the values."""
    key = key or docs.sparkSession.conf.get("palimpsest.pseudonym.key", None)
    if not key:
        raise ValueError("pseudonyms need a key: give key or set palimpsest.pseudonym.key")
    outs = {f"pii_{k}" for k in KINDS}
    kept = [c for c in docs.columns if c.lower() not in outs]
    text = F.col(f"`{text_col}`")
    names = [F.col(f"`{c}`") for c in kept]
    values, parts = F.col("pii__values"), F.col("pii__parts")
    candidate = text.rlike(HINT)
    found = docs.select(*names, *[F.when(candidate, f).alias(c) for c, f in (("pii__values", F.regexp_extract_all(text, F.lit(ANY), F.lit(0))), ("pii__parts", F.split(text, ANY, -1)))])
    # a long row of groups becomes several values; what stands before a value is its part
    rows = F.exists(values, lambda v: v.rlike(LONG_ROW))
    cut = found.withColumn("pii__cut", F.when(rows, F.transform(values, lambda v: F.when(v.rlike(LONG_ROW), _cut(v)).otherwise(F.array(v)))))
    before = F.flatten(F.zip_with("pii__cut", F.slice(parts, F.lit(1), F.size("pii__cut")), lambda c, p: F.transform(c, lambda _, i: F.when(i == 0, p).otherwise(""))))
    found = cut.select(*names, F.when(rows, F.flatten("pii__cut")).otherwise(values).alias("pii__values"), F.when(rows, F.concat(before, F.array(F.element_at(parts, -1)))).otherwise(parts).alias("pii__parts"))
    changed = found.select(*names, "pii__parts", F.when(F.size("pii__values") > 0, pseudonyms(F.col("pii__values"), key, back=back)).alias("pii__values"))
    new = F.col("pii__values")
    joined = F.array_join(F.zip_with("pii__parts", F.transform(new, lambda x: x["written"]), lambda p, r: F.concat(p, F.coalesce(r, F.lit("")))), "")
    texts = F.when(new.isNotNull(), joined).otherwise(text)
    tally = [F.when(new.isNull(), 0).otherwise(F.size(F.filter(new, _of(k)))).alias(f"pii_{k}") for k in KINDS]
    return changed.select(*[texts.alias(c) if c == text_col else F.col(f"`{c}`") for c in kept], *tally)
