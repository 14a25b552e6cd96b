"""Operator 5: personal data replaced by format-preserving Feistel pseudonyms."""

from __future__ import annotations

import secrets
import warnings
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ROUNDS = 10
#: Where the key of the pseudonyms is configured, and the key of tests, which anyone can read here.
KEY_SETTING = "spark.skein.pseudonym.key"
TEST_KEY = "key for tests only"
#: Steps that a permutation is walked on for, at most, until it meets a valid value.
WALK = 64
#: Country calling codes of one and of two digits; others have three.
ONE_DIGIT = "1 7".split()
TWO_DIGITS = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()

_EDGE = r"(?<![\p{L}\p{N}])"
_END = r"(?![\p{L}\p{N}])"
#: Kind -> what such a value looks like; the first that fits a place is taken. An unbounded repeated group is possessive, as
#: Java's other ones recurse once for each repetition.
FORMS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)++",
    "ip": r"(?<![\p{L}\p{N}.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\p{L}\p{N}]|\.[0-9])",
    "iban": _EDGE + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _END,
    "iso_date": _EDGE + r"[0-9]{4}-[0-9]{2}-[0-9]{2}" + _END,
    "day_date": _EDGE + r"[0-9]{2}[/.][0-9]{2}[/.][0-9]{4}" + _END,
    "ssn": _EDGE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _END,
    "card": _EDGE + r"[0-9](?:[ -]?[0-9]){12,18}" + _END,
    "phone": r"(?:(?<![\p{L}\p{N}+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,5}){1,5}|(?<![\p{L}\p{N}])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|(?<![\p{L}\p{N}-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})" + _END,
}
ANY = "|".join(f"(?:{x})" for x in FORMS.values())
KINDS = ("email", "ip", "iban", "date", "ssn", "card", "phone")


def _prf(key: str, label: Column, i: Column, x: Column) -> Column:
    """A keyed 60-bit number."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), label, i.cast("string"), x.cast("string")), 256), 1, 15), 16, 10).cast("long")


def feistel(key: str, label: Column, left: Column, right: Column, m: Column, n: Column) -> Column:
    """The pair (l, r) permuted within m x n values, m and n of any size: an alternating
    (unbalanced) Feistel network whose rounds add a keyed number to one half modulo its size."""
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)),
        F.struct(left.try_cast("long").alias("l"), right.try_cast("long").alias("r")),
        lambda a, i: F.struct(
            F.when(i % 2 == 0, F.pmod(a["l"] + _prf(key, label, i, a["r"]), m.cast("long"))).otherwise(a["l"]).alias("l"),
            F.when(i % 2 == 1, F.pmod(a["r"] + _prf(key, label, i, a["l"]), n.cast("long"))).otherwise(a["r"]).alias("r"),
        ),
    )


def permute_digits(key: str, kind: str, digits: Column) -> Column:
    """A string of 2 to 36 digits permuted among those of its length."""
    a = F.floor(F.length(digits) / 2).cast("int")
    b = F.length(digits) - a
    ten = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    halves = feistel(key, F.concat(F.lit(kind), F.length(digits).cast("string")), F.substr(digits, F.lit(1), a), F.substr(digits, a + 1, b), ten(a), ten(b))
    joined = F.transform(F.array(halves), lambda h: F.concat(F.lpad(h["l"].cast("string"), a, "0"), F.lpad(h["r"].cast("string"), b, "0")))
    return joined[0]


def walked(start: Column, step: Callable[[Column], Column], valid: Callable[[Column], Column]) -> Column:
    """The first valid value after `start` along a permutation: a permutation of the valid values, if start is one."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, lambda a, i: F.when((i > 1) & valid(a), a).otherwise(step(a)))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column, odd: int) -> Column:
    """The Luhn sum; digits at odd (1) or even (0) distances from the last are doubled."""
    n = F.length(digits)
    value = lambda i: F.substr(digits, n - i, F.lit(1)).try_cast("int")
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == odd, doubled(value(i))).otherwise(value(i)))


def _laid_out(like: Column, digits: Column) -> Column:
    """digits put in the places of the digits of `like`, one for one."""
    between = F.split(like, "[0-9]", -1)
    return F.array_join(F.zip_with(between, F.concat(F.split(digits, ""), F.array(F.lit(""))), lambda x, d: F.concat(F.coalesce(x, F.lit("")), F.coalesce(d, F.lit("")))), "")


def _date(s: Column, form: str) -> Column:
    return F.try_to_timestamp(s, F.lit(form)).cast("date")


def _days_of(year: Column, month: Column) -> Column:
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    return F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def permute_date(key: str, year: Column, month: Column, day: Column) -> Column:
    """(year, month, day) permuted among real dates of its cycle of 400 years, which keeps years at four digits.

    Days up to 12 and later ones are permuted apart, so that whatever order of day and month is read
    from a date as it is written, different ones stay different."""
    early, cycle = day <= 12, F.floor(year / 400) * 400
    slots = F.when(early, F.lit(144)).otherwise(F.lit(228)).cast("long")
    first = F.when(early, F.lit(1)).otherwise(F.lit(13)).cast("long")
    state = F.struct((year % 400).cast("long").alias("l"), ((day - first) * 12 + month - 1).cast("long").alias("r"))
    of = lambda a: (cycle + a["l"], a["r"] % 12 + 1, F.floor(a["r"] / 12) + first)
    label = F.when(early, F.lit("early")).otherwise(F.lit("late"))

    def valid(a: Column) -> Column:
        y, m, d = of(a)
        return (y > 0) & (d <= _days_of(y, m))

    found = walked(state, lambda a: feistel(key, label, a["l"], a["r"], F.lit(400), slots), valid)
    y, m, d = of(found)
    return F.struct(y.alias("year"), m.alias("month"), d.alias("day"))


def _written_date(key: str, s: Column) -> Column:
    """A date as it is written, with its pseudonym's digits in its places; read day first if it can be."""
    part = lambda i: F.get(F.split(s, "[^0-9]"), F.lit(i)).try_cast("int")
    iso = s.rlike("^[0-9]{4}-")
    month_first = ~iso & (part(1) > 12)
    day = F.when(iso, part(2)).when(month_first, part(1)).otherwise(part(0))
    month = F.when(iso | ~month_first, part(1)).otherwise(part(0))
    year = F.when(iso, part(0)).otherwise(part(2))
    two, four = (lambda c: F.lpad(c.cast("string"), 2, "0")), (lambda c: F.lpad(c.cast("string"), 4, "0"))
    put = lambda p: F.when(iso, F.concat(four(p["year"]), two(p["month"]), two(p["day"]))).when(month_first, F.concat(two(p["month"]), two(p["day"]), four(p["year"]))).otherwise(F.concat(two(p["day"]), two(p["month"]), four(p["year"])))
    return _laid_out(s, F.transform(F.array(permute_date(key, year, month, day)), put)[0])


def _remainder_97(s: Column) -> Column:
    """The number modulo 97 that letters and digits stand for, A being 10 and Z 35."""
    return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _iban(key: str, s: Column) -> Column:
    """An IBAN of the same country and layout whose account digits are permuted; its check digits hold."""
    plain = F.replace(s, F.lit(" "), F.lit(""))
    country, account = F.left(plain, F.lit(2)), F.substr(plain, F.lit(5))
    other = _laid_out(account, permute_digits(key, "iban", _digits(account)))
    check = lambda o: F.lpad((98 - _remainder_97(F.concat(o, country, F.lit("00")))).cast("string"), 2, "0")
    whole = F.transform(F.array(other), lambda o: F.concat(country, check(o), o))[0]
    gaps = F.split(s, "[A-Z0-9]", -1)
    return F.array_join(F.zip_with(gaps, F.concat(F.split(whole, ""), F.array(F.lit(""))), lambda x, c: F.concat(F.coalesce(x, F.lit("")), F.coalesce(c, F.lit("")))), "")


def _ssn(key: str, digits: Column) -> Column:
    """Nine digits permuted among those of no reserved group."""
    return walked(digits, lambda d: permute_digits(key, "ssn", d), lambda d: ~d.rlike("^(?:000|666|9|...00|.....0000)"))


def _fits(form: str, s: Column) -> Column:
    return s.rlike(f"^(?:{FORMS[form]})$")


def _judged(s: Column) -> Column:
    """The kind of a matched string if it is valid, else null."""
    digits = _digits(s)
    n = F.length(digits)
    return (
        F.when(s.contains("@"), F.lit("email"))
        .when(_fits("ip", s), F.when(F.forall(F.split(s, r"\."), lambda o: o.try_cast("int") <= 255), F.lit("ip")))
        .when(_fits("iban", s), F.when((_remainder_97(F.concat(F.substr(F.replace(s, F.lit(" "), F.lit("")), F.lit(5)), F.left(s, F.lit(4)))) == 1) & (F.length(_digits(F.substr(s, F.lit(5)))) >= 2), F.lit("iban")))
        .when(_fits("iso_date", s), F.when(_date(s, "yyyy-MM-dd").isNotNull(), F.lit("date")))
        .when(_fits("day_date", s), F.when(F.coalesce(_date(F.translate(s, ".", "/"), "dd/MM/yyyy"), _date(F.translate(s, ".", "/"), "MM/dd/yyyy")).isNotNull(), F.lit("date")))
        .when(_fits("ssn", s), F.when(~s.rlike("^(?:000|666|9)|-00-|-0000$"), F.lit("ssn")))
        .when(_fits("card", s) & n.between(13, 19) & (_luhn(digits, 1) % 10 == 0), F.lit("card"))
        .when(_fits("phone", s) & n.between(7, 15), F.lit("phone"))
    )


def _pseudonym(key: str, kind: Column, s: Column) -> Column:
    digits = _digits(s)
    email = lambda: F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(s)), 256), 1, 16), F.lit("@mail.invalid"))
    octet = lambda i: F.get(F.split(s, r"\."), F.lit(i)).try_cast("long")
    halves = feistel(key, F.lit("ip"), octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), F.lit(65536), F.lit(65536))
    ip = F.transform(F.array(halves), lambda h: F.concat_ws(".", F.floor(h["l"] / 256), h["l"] % 256, F.floor(h["r"] / 256), h["r"] % 256))[0]
    body = permute_digits(key, "card", F.substr(digits, F.lit(1), F.length(digits) - 1))
    card = F.transform(F.array(body), lambda b: F.concat(b, F.pmod(-_luhn(b, 0), F.lit(10)).cast("string")))[0]
    code = F.when(~s.startswith("+"), 0).when(F.left(digits, F.lit(1)).isin(*ONE_DIGIT), 1).when(F.left(digits, F.lit(2)).isin(*TWO_DIGITS), 2).otherwise(3)
    phone = F.concat(F.left(digits, code), permute_digits(key, "phone", F.substr(digits, code + 1)))
    return (
        F.when(kind == "email", email())
        .when(kind == "ip", ip)
        .when(kind == "iban", _iban(key, s))
        .when(kind == "date", _written_date(key, s))
        .when(kind == "ssn", _laid_out(s, _ssn(key, digits)))
        .when(kind == "card", _laid_out(s, card))
        .when(kind == "phone", _laid_out(s, phone))
        .otherwise(s)
    )


@cache
def _key_of_application(application: str) -> str:
    """A random key of 256 bits for one Spark application; nothing but its plans holds it."""
    return secrets.token_hex(32)


def configured_key(spark: SparkSession) -> str:
    """The key that KEY_SETTING names; without it, where all runs on one machine (a local master), the key of tests, and on a
    cluster a random one: pseudonyms are then the same within the application and cannot be made again after it."""
    key = spark.conf.get(KEY_SETTING, None)
    if key:
        return key
    if not spark.sparkContext.master.startswith("local"):
        warnings.warn(f"{KEY_SETTING} is not set: pseudonyms are made with a random key that ends with this application", stacklevel=3)
        return _key_of_application(spark.sparkContext.applicationId)
    warnings.warn(f"{KEY_SETTING} is not set: pseudonyms are made with a key that is no secret", stacklevel=3)
    return TEST_KEY


def pseudonymise(docs: DataFrame, key: str | None = None, found: str = "pii") -> DataFrame:
    """docs with text rewritten, and a column `found`: an array of (kind, original length) of what was replaced.

    Recognised: e-mail addresses, IPv4 addresses (octets up to 255), IBANs (check digits hold), dates
    (real days, as yyyy-MM-dd, dd/MM/yyyy, MM/dd/yyyy, with / or .), US social security numbers (no
    reserved groups), payment cards of 13 to 19 digits (Luhn sum) and phone numbers (7 to 15 digits,
    grouped or with a country code). Strings that look alike but do not validate stay.

    Numbers and dates are permuted by a keyed Feistel network within their format: the same
    length, separators and country, valid check digits, a real day, no reserved group (the permutation is
    walked on until it meets such a value); so equal values have equal pseudonyms in all documents and
    different values of one format different ones. A phone number is told by its digits: how they are
    grouped does not matter. A date that can be read day first is. E-mail addresses become keyed
    hashes in a reserved domain. The key is the caller's, or that of the session; see configured_key().

    A text is split once at all recognised places and joined again, so nothing is replaced
    twice. All expressions are Spark's own; rows are not shuffled.

    Cases: null and empty texts stay as they are, with nothing found; all other columns stay, but for one
    named `found`, which is replaced.
    """
    key = key or configured_key(docs.sparkSession)
    text = F.col("text")
    matches = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    judged = F.transform(matches, lambda s: F.struct(s.alias("s"), _judged(s).alias("kind")))
    replaced = F.transform(judged, lambda m: F.struct(_pseudonym(key, m["kind"], m["s"]).alias("t"), m["kind"].alias("kind"), F.length(m["s"]).alias("length")))
    some = text.rlike("[0-9]|@")
    none = F.array().cast("array<struct<t:string,kind:string,length:int>>")
    marked = docs.withColumn(found, F.when(some, replaced).otherwise(none))
    pieces = F.zip_with(F.split(text, ANY, -1), F.col(f"`{found}`"), lambda g, r: F.concat(g, F.coalesce(r["t"], F.lit(""))))
    return marked.withColumn("text", F.when(F.size(f"`{found}`") > 0, F.array_join(pieces, "")).otherwise(text)).withColumn(
        found, F.transform(F.filter(f"`{found}`", lambda r: r["kind"].isNotNull()), lambda r: F.struct(r["kind"].alias("kind"), r["length"].alias("length")))
    )
