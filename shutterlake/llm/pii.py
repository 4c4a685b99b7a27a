"""Format-preserving pseudonyms for personal data. DataFrame functions only.

A text is split at the matches of one pattern (e-mail addresses, phone, card, social security and account numbers, network
addresses, dates); each match that is valid as what it looks like is replaced by a keyed permutation of itself within its own
format, so equal values stay equal in all documents, different ones stay different, and nobody without the key can go back. The
key is an argument; ``key_of`` reads it from the session's setting KEY_SETTING.

The permutations are Feistel networks: a value is a pair (x, y) of Z_a x Z_b, and rounds add, in turn, a keyed hash of the one
to the other (``paired``). What its pair is:
- card numbers (Luhn valid, 13 to 19 digits): the digits before the check digit, halved; the check digit follows anew
- phone numbers: the digits after the country code (of one to three digits: ``CODES``), halved; numbers without one: all digits
- IPv4 addresses: the two halves of the 32 bits
- social security numbers: area (898 valid ones), and group with serial
- dates (valid ones; ISO with - / or ., day or month first with / . or -): the day within its 400-year cycle, as 189 x 773; of
  those without the year first, days up to the 12th and later ones keep among themselves, so that a date that reads one way
  only never becomes one that reads both ways
- account numbers (IBAN, mod-97 valid) and the local part of e-mail addresses: strings whose characters move within their
  kind (digit, small or large letter), halves being strings; the IBAN's check digits follow anew, domains stay.

Defined results: a null text stays null; a text without matches stays as it is; look-alikes that are not valid (a failed check
digit, 2023-02-30, 300.1.1.1) stay and are not counted; rows repeated or without id are rewritten each; all other columns stay
as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm.common import free_names

KEY_SETTING, TEST_KEY = "spark.shutterlake.pii.key", "for tests only"
ROUNDS = 8

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
PHONE = r"(?<![0-9+])\+[1-9](?:[ ./-]?\(?[0-9]\)?){5,13}[0-9](?![0-9])"
LOCAL_PHONE = r"(?<![0-9])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2,3}(?:[ -][0-9]{1,3})?)(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9./-])(?:[0-9]{4}[-/.][0-9]{2}[-/.][0-9]{2}|[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{4})(?![0-9]|[./-][0-9])"
PATTERNS = {"email": EMAIL, "iban": IBAN, "phone": PHONE, "local_phone": LOCAL_PHONE, "ssn": SSN, "card": CARD, "ip": IP, "date": DATE}
ANY = "|".join(PATTERNS.values())


def _with(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` worked out once, however often ``f`` names it."""
    return F.transform(F.array(x), f)[0]


def _hash(key: str, *parts: Column) -> Column:
    """60 bits of a keyed SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *parts), 256), 1, 15), 16, 10).cast("bigint")


def paired(x: Column, y: Column, a: Column, b: Column, tweak: Column, key: str, back: bool = False) -> Column:
    """struct(x, y) permuted within Z_a x Z_b; ``back`` undoes it."""
    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))

    def step(s: Column, i: Column) -> Column:
        fx = _hash(key, tweak, i.cast("string"), s["y"].cast("string"))
        fy = _hash(key, tweak, i.cast("string"), s["x"].cast("string"))
        even = i % 2 == 0
        sign = F.lit(-1 if back else 1)
        return F.struct(F.when(even, F.pmod(s["x"] + sign * F.pmod(fx, a), a)).otherwise(s["x"]).alias("x"), F.when(even, s["y"]).otherwise(F.pmod(s["y"] + sign * F.pmod(fy, b), b)).alias("y"))

    start = F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"))
    return F.aggregate(F.reverse(rounds) if back else rounds, start, step)


def _ten(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("bigint")


def digits(d: Column, tweak: str, key: str, back: bool = False) -> Column:
    """A string of 2 to 18 digits as another of its length."""
    def of(d: Column) -> Column:
        n = F.length(d)
        left = F.floor(n / 2).cast("int")
        x, y = d.substr(F.lit(1), left).cast("bigint"), d.substr(left + 1, n - left).cast("bigint")
        out = paired(x, y, _ten(left), _ten(n - left), F.concat(F.lit(tweak), n.cast("string")), key, back)
        return _with(out, lambda s: F.concat(F.lpad(s["x"].cast("string"), left, "0"), F.lpad(s["y"].cast("string"), n - left, "0")))

    return _with(d, of)


_SMALL, _LARGE = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _moved(c: Column, by: Column) -> Column:
    out = c
    for kind, n, first in (("0123456789", 10, 48), (_SMALL, 26, 97), (_LARGE, 26, 65)):
        place = F.ascii(c) - first
        out = F.when((place >= 0) & (place < n) & (F.length(c) == 1), F.lit(kind).substr(F.pmod(place + by, F.lit(n)) + 1, F.lit(1))).otherwise(out)
    return out


def _shifted(s: Column, other: Column, i: Column, tweak: Column, key: str, sign: int) -> Column:
    """Each letter and digit of ``s`` moved within its kind by a keyed hash of ``other``."""
    by = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), other), 512)
    at = F.sequence(F.lit(1), F.length(s))
    one = F.transform(at, lambda p: _moved(s.substr(p, F.lit(1)), sign * F.conv(by.substr(F.pmod(p - 1, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")))
    return F.when(F.length(s) > 0, F.array_join(one, "")).otherwise(s)


def string(s: Column, tweak: str, key: str, back: bool = False) -> Column:
    """A string as another whose characters are of the same kinds, place by place; marks stay."""
    n = F.length(s)
    left = F.floor(n / 2).cast("int")
    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    sign, named = (-1 if back else 1), F.lit(tweak)

    def step(p: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, _shifted(p["x"], p["y"], i, named, key, sign)).otherwise(p["x"]).alias("x"), F.when(even, p["y"]).otherwise(_shifted(p["y"], p["x"], i, named, key, sign)).alias("y"))

    out = F.aggregate(F.reverse(rounds) if back else rounds, F.struct(s.substr(F.lit(1), left).alias("x"), s.substr(left + 1, n - left).alias("y")), step)
    return _with(out, lambda s: F.concat(s["x"], s["y"]))


def only_digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def laid_out(m: Column, chars: Column, kind: str) -> Column:
    """``m`` with its characters of ``kind`` (a regular class) replaced by those of ``chars`` in turn; all else stays."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def filled(chars: Column) -> Column:
        return F.aggregate(F.split(m, ""), start, lambda s, c: F.when(c.rlike(kind), F.struct(F.concat(s["out"], chars.substr(s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))))["out"]

    return _with(chars, filled)


def luhn_sum(d: Column, doubled: int) -> Column:
    """Sum of digits from the right, each second one doubled, beginning with the first if ``doubled`` is 1."""
    each = F.transform(F.split(F.reverse(d), ""), lambda c, i: F.when(i % 2 == 1 - doubled, 2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda s, v: s + v)


def mod97(s: Column) -> Column:
    """An account number's remainder: its first four characters at the end, letters as 10 to 35."""
    turned = F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4))
    return F.aggregate(F.split(turned, ""), F.lit(0).cast("bigint"), lambda r, c: F.pmod(F.when(c.rlike("[0-9]"), r * 10 + F.ascii(c) - 48).otherwise(r * 100 + F.ascii(c) - 55), F.lit(97)).cast("bigint"))


def _card(m: Column, key: str, back: bool) -> Column:
    def of(d: Column) -> Column:
        whole = _with(digits(d.substr(F.lit(1), F.length(d) - 1), "card", key, back), lambda body: F.concat(body, F.pmod(-luhn_sum(body, 1), F.lit(10)).cast("string")))
        return F.when(F.length(d).between(13, 19) & (luhn_sum(d, 0) % 10 == 0), laid_out(m, whole, "[0-9]"))

    return _with(only_digits(m), of)


#: First digits of country codes (E.164): 1 and 7 are whole, those of ``_TWO`` take two digits, all others three.
_TWO = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def code_length(d: Column) -> Column:
    """How many of an international number's digits are its country code."""
    return F.when(d.rlike("^[17]"), 1).when(F.substring(d, 1, 2).isin(_TWO), 2).otherwise(3)


def _phone(m: Column, key: str, back: bool) -> Column:
    def moved(s: Column) -> Column:
        d, code = s["d"], s["code"]
        return F.concat(d.substr(F.lit(1), code), digits(d.substr(code + 1, F.length(d) - code), "phone", key, back))

    coded = _with(only_digits(m), lambda d: F.struct(d.alias("d"), F.when(m.startswith("+"), code_length(d)).otherwise(0).alias("code")))
    return laid_out(m, _with(coded, moved), "[0-9]")


def _ip(m: Column, key: str, back: bool) -> Column:
    p = F.split(m, r"\.")
    part = [p[i].cast("bigint") for i in range(4)]
    valid = F.forall(p, lambda x: (x.cast("int") <= 255) & (x.cast("int").cast("string") == x))
    half = F.lit(1 << 16)
    out = paired(part[0] * 256 + part[1], part[2] * 256 + part[3], half, half, F.lit("ip"), key, back)
    return F.when(valid, _with(out, lambda s: F.concat_ws(".", *(F.pmod(F.floor(v / w), F.lit(256)).cast("string") for v in (s["x"], s["y"]) for w in (256, 1)))))


def _ssn(m: Column, key: str, back: bool) -> Column:
    p = F.split(m, "-")
    area, group, serial = (p[i].cast("bigint") for i in range(3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = area - 1 - F.when(area > 666, 1).otherwise(0)
    out = paired(place, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), F.lit("ssn"), key, back)

    def shown(s: Column) -> Column:
        parts = [(s["x"] + 1 + F.when(s["x"] >= 665, 1).otherwise(0), 3), (F.floor(s["y"] / 9999) + 1, 2), (F.pmod(s["y"], F.lit(9999)) + 1, 4)]
        return F.concat_ws("-", *(F.lpad(v.cast("bigint").cast("string"), n, "0") for v, n in parts))

    return F.when(valid, _with(out, shown))


#: A Gregorian cycle of 400 years has 146,097 = 189 * 773 days; day 0 here is 1600-01-01.
_CYCLE, _DATE_A, _DATE_B, _DAY_0 = 146_097, 189, 773, -135_140
#: 88,497 = 3 * 29,499 of them are later in their month than the 12th, 221 a year and one in leap years.
_LATE_A, _LATE_B, _LATE_A_YEAR = 3, 29_499, 221
_LATE_BEFORE = [0, 19, 35, 54, 72, 91, 109, 128, 147, 165, 184, 202]


def _late_before(year: Column) -> Column:
    """Days later than the 12th in the cycle's years before ``year`` (0 to 400)."""
    return year * _LATE_A_YEAR + F.floor((year + 3) / 4) - F.floor((year + 99) / 100) + F.floor((year + 399) / 400)


def _late_in(year: Column) -> Column:
    """Days later than the 12th before each month of ``year``."""
    leap = F.when((year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0)), 1).otherwise(0)
    return _with(leap, lambda x: F.array(*(F.lit(n) + (x if k > 1 else 0) for k, n in enumerate(_LATE_BEFORE))))


def _late_place(date: Column) -> Column:
    """The place of a date later than the 12th of its month among such dates of its cycle."""
    return _with(F.pmod(F.year(date), F.lit(400)), lambda y: _late_before(y) + F.element_at(_late_in(y), F.month(date)) + F.dayofmonth(date) - 13)


def _late_date(era: Column, place: Column) -> Column:
    """``_late_place`` undone, in the cycle ``era``."""

    def dated(s: Column) -> Column:
        """Of struct(year, days before its months, place in the year)."""
        month = F.size(F.filter(s["before"], lambda n: n <= s["left"]))
        return F.make_date((era * 400 + s["year"]).cast("int"), month, (s["left"] - F.element_at(s["before"], month) + 13).cast("int"))

    def in_year(y: Column, place: Column) -> Column:
        return _with(F.struct(y.alias("year"), _late_in(y).alias("before"), (place - _late_before(y)).alias("left")), dated)

    def placed(s: Column) -> Column:
        """Of struct(place, a year that is the right one or next to it)."""
        near = s["near"]
        year = F.when(_late_before(near + 1) <= s["place"], near + 1).when(_late_before(near) <= s["place"], near).otherwise(near - 1)
        return _with(year, lambda y: in_year(y, s["place"]))

    return _with(place, lambda p: _with(F.struct(p.alias("place"), F.floor(p * 400 / (_LATE_A * _LATE_B)).alias("near")), placed))


def _read(m: Column) -> Column:
    """struct(form, date) of a date as written: year first (0), month first (1) or day first (2)."""
    read = lambda y, mo, d: F.try_to_timestamp(F.concat_ws("-", y, mo, d), F.lit("yyyy-MM-dd")).cast("date")
    both = lambda p: F.struct(read(p[2], p[1], p[0]).alias("day_first"), read(p[2], p[0], p[1]).alias("month_first"))
    shown = lambda form, date: F.struct(F.lit(form).alias("form"), date.alias("date"))

    def short(s: Column) -> Column:
        # with / the month comes first where it can, with . and - the day
        us = F.when(m.contains("/"), s["month_first"].isNotNull()).otherwise(s["day_first"].isNull())
        return F.when(us, shown(1, s["month_first"])).otherwise(shown(2, s["day_first"]))

    return _with(F.split(m, "[-/.]"), lambda p: F.when(m.rlike("^[0-9]{4}"), shown(0, read(p[0], p[1], p[2]))).otherwise(_with(both(p), short)))


def _date(m: Column, key: str, back: bool) -> Column:
    """Days up to the 12th and later ones keep among themselves if the year is last: what could be read both ways still can."""
    same = F.regexp_replace(m, "[0-9]", "").rlike(r"^(--|//|\.\.)$")

    def permuted(x: Column, a: int, b: int, tweak: str, then: Callable[[Column], Column]) -> Column:
        whole = lambda x: paired(F.floor(x / b), F.pmod(x, F.lit(b)), F.lit(a), F.lit(b), F.lit(tweak), key, back)
        return _with(_with(x, whole), lambda s: then(s["x"] * b + s["y"]))

    def moved(s: Column) -> Column:
        d = s["date"]
        day = F.datediff(d, F.lit("1970-01-01").cast("date")) - _DAY_0
        era = F.floor(F.year(d) / 400)
        any_ = permuted(F.pmod(day, F.lit(_CYCLE)), _DATE_A, _DATE_B, "date", lambda x: F.date_add(F.lit("1970-01-01").cast("date"), (F.floor(day / _CYCLE) * _CYCLE + x + _DAY_0).cast("int")))
        early = permuted(F.pmod(F.year(d), F.lit(400)) * 144 + (F.month(d) - 1) * 12 + F.dayofmonth(d) - 1, 400, 144, "date, early", lambda x: F.make_date((era * 400 + F.floor(x / 144)).cast("int"), (F.floor(F.pmod(x, F.lit(144)) / 12) + 1).cast("int"), (F.pmod(x, F.lit(12)) + 1).cast("int")))
        late = permuted(_late_place(d), _LATE_A, _LATE_B, "date, late", lambda x: _late_date(era, x))
        return F.struct(s["form"].alias("form"), F.when(s["form"] == 0, any_).when(F.dayofmonth(d) <= 12, early).otherwise(late).alias("date"))

    def digits_of(s: Column) -> Column:
        shown = [F.date_format(s["date"], f) for f in ("yyyyMMdd", "MMddyyyy", "ddMMyyyy")]
        return F.when(s["form"] == 0, shown[0]).when(s["form"] == 1, shown[1]).otherwise(shown[2])

    return _with(_read(m), lambda s: F.when(same & s["date"].isNotNull(), laid_out(m, _with(moved(s), digits_of), "[0-9]")))


def _email(m: Column, key: str, back: bool) -> Column:
    at = F.instr(m, "@")
    return F.concat(string(m.substr(F.lit(1), at - 1), "email", key, back), m.substr(at, F.length(m)))


def _iban(m: Column, key: str, back: bool) -> Column:
    s = F.regexp_replace(m, " ", "")
    checked = lambda body: F.concat(F.substring(s, 1, 2), F.lpad((98 - mod97(F.concat(F.substring(s, 1, 2), F.lit("00"), body))).cast("string"), 2, "0"), body)
    whole = _with(string(F.substring(s, 5, 64), "iban", key, back), checked)
    return F.when(F.length(s).between(15, 34) & (mod97(s) == 1), laid_out(m, whole, "[A-Z0-9]"))


_KINDS: dict[str, Callable[[Column, str, bool], Column]] = {"email": _email, "iban": _iban, "phone": _phone, "local_phone": _phone, "ssn": _ssn, "card": _card, "ip": _ip, "date": _date}


def key_of(spark: SparkSession) -> str:
    """The key that the session's setting KEY_SETTING names. Where none is set (tests), a key that everybody knows."""
    return spark.conf.get(KEY_SETTING, TEST_KEY)


def pseudonym(m: Column, key: str, back: bool = False) -> Column:
    """struct(kind, value) of one match: its pseudonym, or null for what is not valid. A number that is not a valid account
    number may yet be a valid card number, so kinds are tried in their order."""
    return F.coalesce(*(F.when(m.rlike(f"^(?:{PATTERNS[k]})$"), F.struct(F.lit(k).alias("kind"), f(m, key, back).alias("value"))) for k, f in _KINDS.items()))


def rewritten(docs: DataFrame, key: str | None = None, back: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and an array of struct(kind, value) as last column: the values now in the text, in
    order. It is named ``found``, or alike if that is taken. ``key`` None: ``key_of`` the session; ``back`` undoes it."""
    key = key or key_of(docs.sparkSession)
    matches = F.regexp_extract_all(F.col("text"), F.lit(ANY), F.lit(0))
    found, has, was, between, made = free_names(docs, "found", "__has", "__matches", "__between", "__made")
    # one projection each, or the arrays would be worked out once per use
    one = docs.withColumn(has, F.coalesce(F.col("text").rlike("[0-9@]") & F.col("text").rlike(ANY), F.lit(False)))
    two = one.withColumn(was, F.when(F.col(has), matches)).withColumn(between, F.when(F.col(has), F.split("text", ANY, -1)))
    three = two.withColumn(made, F.transform(was, lambda m: F.struct(m.alias("was"), pseudonym(m, key, back).alias("now"))))
    kept = F.transform(F.filter(made, lambda s: s["now"]["value"].isNotNull()), lambda s: s["now"])
    parts = F.zip_with(between, made, lambda a, s: F.concat(a, F.coalesce(s["now"]["value"], s["was"], F.lit(""))))
    four = three.withColumn("text", F.when(F.col(has), F.array_join(parts, "")).otherwise(F.col("text")))
    five = four.withColumn(found, F.coalesce(kept, F.expr("cast(array() as array<struct<kind: string, value: string>>)")))
    return five.drop(has, was, between, made)
