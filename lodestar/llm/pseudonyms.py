"""Format-preserving pseudonyms for personal numbers, dates and addresses, with DataFrame expressions only.

One pattern finds candidates; each is validated by its kind and then permuted by a keyed Feistel network within its own
format, so equal values have equal pseudonyms in every document, different values different ones, and separators and
checksums stay valid:

* card numbers of 13 to 19 digits, whole or in groups of four and more, that pass the Luhn test: all digits but the last
  are permuted, the last is recomputed;
* bank account numbers (IBAN) that pass the test modulo 97: letters and digits of the account are permuted, the check
  digits recomputed, the country stays;
* telephone numbers of 8 to 15 digits with a country code, and of three, three and four digits without one: all digits
  but the country code, which is known by its first digits, so a number is linked whatever separates its digits;
* social security numbers of valid area, group and serial: permuted among the valid ones;
* IPv4 addresses: the 32 bits;
* dates from 1900 to 2099, in figures (year first or last, one or two digits for day and month; month first only where the
  second number cannot be a month) or with an English, French, German or Spanish month name. One permutation serves all
  forms, so a date is linked however it is written. It keeps days up to the 12th, up to the 28th and later ones among
  themselves, so that a pseudonym is read in the same order as the date. Two-digit years are no dates here, as lists and
  versions look alike;
* e-mail addresses of at most ten labels: letters and digits of the local part, as it is written; addresses that differ in
  capital letters are different ones.

A round adds, to one half, a keyed hash of the other half. Every kind is numbered without gaps and its number permuted
within two factors of the kind's size, so no result falls outside the valid values and nothing has to be tried again.

Defined results. A null or empty text stays as it is; values that fail validation stay as they are; a text may hold any
number of values; all columns of the input are carried, whatever their names, and only ``text`` is changed. No shuffle,
so hot sources and repeated rows are of no effect.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Names of the months.
MONTHS = {
    "en": "January February March April May June July August September October November December".split(),
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(),
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
}
#: Days after the 28th, as month and day, but the 29th of February; (160, 180), (192, 200), (58, 100) and (7, 7) are factors
#: of the numbers of dates of the four classes in 200 years.
LATE = [100 * m + d for m in range(1, 13) for d in (29, 30, 31) if m != 2 and not (d == 31 and m in (4, 6, 9, 11))]

#: Telephone country codes of one and of two digits; all others have three.
COUNTRY_CODES = {
    1: ["1", "7"],
    2: "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split(),
}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_DAY, _MONTH, _YEAR = r"(?:0[1-9]|[12]\d|3[01]|[1-9])", r"(?:0[1-9]|1[0-2]|[1-9])", r"(?:19|20)\d\d"
_NAME = "(?:" + "|".join(sorted({n for names in MONTHS.values() for m in names for n in (m, m.capitalize())}, key=lambda n: (-len(n), n))) + ")"
EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+){0,8}\.[A-Za-z]{2,}"
IP = rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)"
YEAR_FIRST = rf"(?<!\d)(?<!\d\.){_YEAR}([/.\-]){_MONTH}\1{_DAY}(?!\.?\d)"
YEAR_LAST = rf"(?<!\d)(?<!\d\.){_DAY}([/.\-]){_DAY}\2{_YEAR}(?!\.?\d)"
DAY_NAMED = rf"(?<!\d)(?<!\d\.){_DAY}(?:st|nd|rd|th|er|\.)? (?:de )?{_NAME} (?:de )?{_YEAR}(?!\d)"
NAME_FIRST = rf"(?<![A-Za-z]){_NAME} {_DAY}(?:st|nd|rd|th)?,? {_YEAR}(?!\d)"
SSN = r"(?<![\d\-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\d\-])"
PHONE = (
    r"\+[1-9]\d{0,2}[ .\-]?\(?\d{2,4}\)?[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?!\d)"
    r"|\+[1-9]\d{0,2}[ .\-]?\(?\d\d\)?[ .\-]?\d{5}[ .\-]?\d{4}(?!\d)"
    r"|\+[1-9]\d{0,2}[ .\-]\d(?:[ .\-]\d\d){4}(?!\d)"
    r"|\+[1-9]\d{7,14}(?!\d)"
    r"|(?<!\d)(?:\(\d{3}\) ?|\d{3}[.\-])\d{3}[.\-]\d{4}(?!\d)"
)
CARD = r"(?<!\d)\d{13,19}(?!\d)|(?<!\d)\d{4}([ \-])\d{4,6}(?:\3\d{3,7}){1,3}(?!\d)"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
CANDIDATE = f"{EMAIL}|(?=[\\d+(])(?:{IP}|{YEAR_FIRST}|{YEAR_LAST}|{DAY_NAMED}|{SSN}|{PHONE}|{CARD})|(?=[A-Z]{{2}}\\d){IBAN}|{NAME_FIRST}"


def _hash(key: str, kind: Column | str, turn: Column, other: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind) if isinstance(kind, str) else kind, turn.cast("string"), other.cast("string")), 512)


def _number(digest: Column, place: Column | int = 1, hexes: int = 15) -> Column:
    return F.conv(digest.substr(F.lit(place) if isinstance(place, int) else place, F.lit(hexes)), 16, 10).cast("long")


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _feistel(left: Column, right: Column, step: Callable[[Column, Column, Column, bool], Column]) -> Column:
    """Rounds that change the halves ``l`` and ``r`` in turn; ``step(half, other, turn, is_left)`` is the new half."""
    start = F.struct(left.alias("l"), right.alias("r"))
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)),
        start,
        lambda s, i: F.when(i % 2 == 0, F.struct(step(s["l"], s["r"], i, True).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), step(s["r"], s["l"], i, False).alias("r"))),
    )


def permute_string(value: Column, key: str, kind: str) -> Column:
    """Letters become letters of the same case and digits digits; everything else stays."""

    def turn(c: Column, k: Column) -> Column:
        code = F.ascii(c)
        moved = lambda base, n: F.chr(F.lit(base) + (code - base + k) % n)
        return F.when(c.between("0", "9"), moved(48, 10)).when(c.between("a", "z"), moved(97, 26)).when(c.between("A", "Z"), moved(65, 26)).otherwise(c)

    def step(half: Column, other: Column, i: Column, _: bool) -> Column:
        return _with(_hash(key, kind, i, other), lambda digest: F.array_join(F.transform(F.split(half, ""), lambda c, at: turn(c, _number(digest, 1 + at % 32 * 4, 4))), ""))

    cut = F.floor(F.length(value) / 2).cast("int")
    return _with(_feistel(F.substring(value, 1, cut), value.substr(cut + 1, F.length(value)), step), lambda s: F.concat(s["l"], s["r"]))


def permute_number(value: Column, high: Column | int, low: Column | int, key: str, kind: Column | str) -> Column:
    """A permutation of 0 to ``high * low`` - 1."""
    high, low = (F.lit(x) if isinstance(x, int) else x for x in (high, low))
    step = lambda half, other, i, is_left: (half + _number(_hash(key, kind, i, other))) % (high if is_left else low)
    return _with(_feistel(F.floor(value / low).cast("long"), (value % low).cast("long"), step), lambda s: s["l"] * low + s["r"])


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """A permutation of the strings of as many digits, up to 19."""
    cut = F.floor(F.length(digits) / 2).cast("int")
    power = lambda n: F.pow(F.lit(10.0), n).cast("long")
    of = F.concat(F.lit(kind), F.length(digits).cast("string"))
    step = lambda half, other, i, is_left: (half + _number(_hash(key, of, i, other))) % power(cut if is_left else F.length(digits) - cut)
    number = lambda text: F.coalesce(F.nullif(text, F.lit("")), F.lit("0")).cast("long")
    halves = _feistel(number(F.substring(digits, 1, cut)), number(digits.substr(cut + 1, F.length(digits))), step)
    left = lambda s: F.when(cut > 0, F.lpad(s["l"].cast("string"), cut, "0")).otherwise("")
    return _with(halves, lambda s: F.concat(left(s), F.lpad(s["r"].cast("string"), F.length(digits) - cut, "0")))


def _with_digits(value: Column, digits: Column, of: str = r"\d") -> Column:
    """``value`` with its digits, or what ``of`` fits, replaced in order."""
    start = F.struct(F.lit("").alias("out"), digits.alias("rest"))
    step = lambda s, c: F.when(c.rlike(of), F.struct(F.concat(s["out"], F.substring(s["rest"], 1, 1)).alias("out"), F.substring(s["rest"], 2, 99).alias("rest"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["rest"].alias("rest")))
    return F.aggregate(F.split(value, ""), start, step, lambda s: s["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _card(value: Column, key: str) -> Column:
    def permuted(digits: Column) -> Column:
        payload = permute_digits(digits.substr(F.lit(1), F.length(digits) - 1), key, "card")
        checked = lambda p: F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(p, d.cast("string"))), lambda n: F.call_function("luhn_check", n))[0]
        return F.when(F.length(digits).between(13, 19) & F.call_function("luhn_check", digits), _with_digits(value, _with(payload, checked))).otherwise(value)

    return _with(_digits(value), permuted)


def _phone(value: Column, key: str) -> Column:
    def permuted(digits: Column) -> Column:
        one, two = F.substring(digits, 1, 1).isin(*COUNTRY_CODES[1]), F.substring(digits, 1, 2).isin(*COUNTRY_CODES[2])
        size = F.when(~value.startswith("+"), 0).when(one, 1).when(two, 2).otherwise(3)
        code, rest = digits.substr(F.lit(1), size), digits.substr(size + 1, F.length(digits))
        return F.when(F.length(digits).between(8, 15), _with_digits(value, F.concat(code, permute_digits(rest, key, "phone")))).otherwise(value)

    return _with(_digits(value), permuted)


def _mod97(text: Column) -> Column:
    """Letters and digits as one number, letters from 10 on, modulo 97."""
    return F.aggregate(F.split(text, ""), F.lit(0), lambda n, c: F.when(c.between("0", "9"), (n * 10 + F.ascii(c) - 48) % 97).otherwise((n * 100 + F.ascii(c) - 55) % 97))


def _iban(value: Column, key: str) -> Column:
    bare = F.replace(value, F.lit(" "), F.lit(""))
    country, account = F.substring(bare, 1, 2), F.substring(bare, 5, 99)
    valid = _mod97(F.concat(account, F.substring(bare, 1, 4))) == 1
    check = lambda new: F.lpad((98 - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
    whole = _with(permute_string(account, key, "iban"), lambda new: F.concat(country, check(new), new))
    return F.when(valid, _with_digits(value, whole, "[A-Z0-9]")).otherwise(value)


def _ssn(value: Column, key: str) -> Column:
    area, group, serial = (value.substr(F.lit(a), F.lit(n)).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    number = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1
    written = lambda x, n: F.lpad(x.cast("string"), n, "0")

    def put(new: Column) -> Column:
        place = F.floor(new / (99 * 9999)).cast("long")
        return F.concat_ws("-", written(place + F.when(place >= 665, 2).otherwise(1), 3), written(F.floor(new / 9999).cast("long") % 99 + 1, 2), written(new % 9999 + 1, 4))

    return _with(permute_number(number, 898 * 99, 9999, key, "ssn"), put)


def _ip(value: Column, key: str) -> Column:
    part = F.split(value, r"\.")
    octet = lambda i: part[i].cast("long")
    number = permute_number(octet(0) * (1 << 24) + octet(1) * (1 << 16) + octet(2) * 256 + octet(3), 1 << 16, 1 << 16, key, "ip")
    return _with(number, lambda n: F.concat_ws(".", *(F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0))))


def permute_date(year: Column, month: Column, day: Column, key: str) -> Column:
    """Struct ``y``, ``m``, ``d`` of the date's pseudonym; null where there is no such day from 1900 to 2099."""
    since = year - 1900
    late = F.array(*map(F.lit, LATE))
    made = lambda y, m, d: F.struct(y.cast("int").alias("y"), m.cast("int").alias("m"), d.cast("int").alias("d"))

    def days(n: Column, first: int, many: int) -> Column:
        return made(1900 + F.floor(n / (12 * many)), F.floor(n / many) % 12 + 1, n % many + first)

    place = F.array_position(late, month * 100 + day)
    leap = (year % 4 == 0) & (year != 1900)
    of_month = lambda first, many: (since * 12 + month - 1) * many + day - first
    end = lambda n: late[(n % len(LATE)).cast("int")]
    permuted = (
        F.when(day <= 12, _with(permute_number(of_month(1, 12), 160, 180, key, "date to 12"), lambda n: days(n, 1, 12)))
        .when(day <= 28, _with(permute_number(of_month(13, 16), 192, 200, key, "date to 28"), lambda n: days(n, 13, 16)))
        .when((month == 2) & (day == 29) & leap, _with(permute_number(F.floor((year - 1904) / 4), 7, 7, key, "leap day"), lambda n: made(1904 + 4 * n, F.lit(2), F.lit(29))))
        .when(place > 0, _with(permute_number(since * len(LATE) + place - 1, 58, 100, key, "date from 29"), lambda n: made(1900 + F.floor(n / len(LATE)), F.floor(end(n) / 100), end(n) % 100)))
    )
    return F.when(year.between(1900, 2099) & month.between(1, 12) & day.between(1, 31), permuted)


def _date(value: Column, key: str) -> Column:
    number = lambda i: F.split(value, r"\D")[i].cast("int")
    sign = F.regexp_extract(value, r"\d(\D)", 1)
    year_first, day_first = value.rlike(r"^\d{4}"), number(1) <= 12
    pick = lambda first, eu, us: F.when(year_first, number(first)).when(day_first, number(eu)).otherwise(number(us))
    short = value.rlike(r"(?:^|\D)\d(?:\D|$)")
    two = lambda x: F.when(short, x.cast("string")).otherwise(F.lpad(x.cast("string"), 2, "0"))

    def put(t: Column) -> Column:
        y, m, d = t["y"].cast("string"), two(t["m"]), two(t["d"])
        return F.when(year_first, F.concat(y, sign, m, sign, d)).when(day_first, F.concat(d, sign, m, sign, y)).otherwise(F.concat(m, sign, d, sign, y))

    return F.coalesce(_with(permute_date(pick(0, 2, 2), pick(1, 1, 0), pick(2, 0, 1), key), put), value)


def _named_date(value: Column, key: str) -> Column:
    name = F.regexp_extract(value, _NAME, 0)
    lists = [names for own in MONTHS.values() for names in {tuple(own): 0, tuple(m.capitalize() for m in own): 0}]
    own = F.filter(F.array(*(F.array(*map(F.lit, x)) for x in lists)), lambda names: F.array_contains(names, name))[0]
    year, day = F.regexp_extract(value, r"(\d{4})$", 1), F.regexp_extract(value, r"(?<!\d)(\d\d?)(?!\d)", 1)

    def put(t: Column) -> Column:
        number = F.when(F.length(day) == 2, F.lpad(t["d"].cast("string"), 2, "0")).otherwise(t["d"].cast("string"))
        new = lambda names: F.regexp_replace(F.regexp_replace(F.regexp_replace(value, F.lit(r"\d{4}$"), t["y"].cast("string")), F.lit(r"(?<!\d)\d\d?(?!\d)"), number), name, names[t["m"] - 1])
        return _with(own, new)

    return F.coalesce(_with(permute_date(year.cast("int"), F.array_position(own, name).cast("int"), day.cast("int"), key), put), value)


def _email(value: Column, key: str) -> Column:
    at = F.instr(value, "@")
    return F.concat(permute_string(value.substr(F.lit(1), at - 1), key, "email"), value.substr(at, F.length(value)))


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one candidate, or the candidate itself if it isn't valid."""
    return (
        F.when(value.contains("@"), _email(value, key))
        .when(value.rlike(r"^\d+(\.\d+){3}$"), _ip(value, key))
        .when(value.rlike(r"^(\d{4}([/.\-])\d\d?\2\d\d?|\d\d?([/.\-])\d\d?\3\d{4})$"), _date(value, key))
        .when(value.rlike(r"^\d{3}-\d\d-\d{4}$"), _ssn(value, key))
        .when(value.rlike(r"^[A-Z]{2}\d\d"), _iban(value, key))
        .when(value.rlike(r"\p{L}{3}"), _named_date(value, key))
        .when(value.rlike(r"^(\d{13,19}|\d{4}([ \-])\d{4,6}(\2\d{3,7}){1,3})$"), _card(value, key))
        .otherwise(_phone(value, key))
    )


def pseudonymise(documents: DataFrame, key: str, column: str = "text", changed: str | None = None) -> DataFrame:
    """``documents`` with all valid values of ``column`` replaced; ``changed`` names a column for their number."""
    text = F.col(f"`{column}`")
    spare = [f"__{name}{max(map(len, documents.columns)) * '_'}" for name in ("found", "new")]  # names that no column has
    held = documents.withColumn(spare[0], F.when(text.rlike("[0-9]|@"), F.regexp_extract_all(text, F.lit(CANDIDATE), 0)))
    held = held.withColumn(spare[1], F.transform(spare[0], lambda v: pseudonym(v, key)))
    between = F.split(text, CANDIDATE, -1)
    tail = F.array_join(F.zip_with(spare[1], F.slice(between, 2, F.greatest(F.size(between) - 1, F.lit(0))), lambda v, rest: F.concat(v, rest)), "")
    holds = F.coalesce(F.size(spare[0]) > 0, F.lit(False))
    out = {column: F.when(holds, F.concat(between[0], tail)).otherwise(text)}
    if changed:
        differ = F.size(F.filter(F.arrays_zip(F.col(spare[0]).alias("a"), F.col(spare[1]).alias("b")), lambda p: p["a"] != p["b"]))
        out[changed] = F.when(holds, differ).otherwise(0).cast("long")
    return held.withColumns(out).drop(*spare)
