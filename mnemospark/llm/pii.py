"""Format-preserving pseudonyms of personal data, by keyed Feistel permutations, with built-in functions only.

One pattern finds candidates; each is validated by its own rules (check digits, ranges, calendar) and its
value is permuted within its format: a card number becomes another with a right check digit and the same
first digit, a date another date in the same notation, an e-mail address one with other letters and digits at
the same places. The permutation depends on the key and the value alone, so equal values stay equal in every
document and different ones of a printed form stay different; with the key it can be undone. Where the values of
a form are an odd subset of a domain, the permutation is repeated until it meets one (cycle walking).

Two networks: ``permute_int`` over a domain of a x b numbers, and ``permute_text`` over strings, which adds a
key stream of one half to the other character by character within digits, small and capital letters.

No pattern repeats a group without a bound, so texts of any length pass. A host has at most 127 labels of 63
characters, and 64 stand before it; what is longer is no address.

Defined results: a null text stays null, with no findings; what fails validation stays as it is; repeated
rows give repeated results; an empty table gives an empty result; columns of the input with the names that
are added are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

ROUNDS = 8

# The formats, most specific first.
FORMATS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,125}\.[A-Za-z]{2,63}(?![A-Za-z0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![A-Za-z0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "iso_date": r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])",
    "day_date": r"(?<![0-9/.-])[0-9]{1,2}(?:/[0-9]{1,2}/|\.[0-9]{1,2}\.)[0-9]{4}(?![0-9/-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4})(?![0-9A-Za-z])",
}
#: The report's names; both date notations are dates.
KINDS = ("email", "iban", "ip", "date", "ssn", "card", "phone")
#: Dates of 1900-01-01 to 2100-01-01 are 73,050 = 150 x 487 days.
FIRST_DAY, DAYS = "1900-01-01", (150, 487)
#: Steps of a walk along a cycle. One in four or five days fits the rarest form, so a walk that is longer is out of reach.
WALK = 256


def _round_hash(key: str, tag: Column, i: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), tag, i.cast("string"), half), 256)


def _number(hashed: Column, start: int = 1, digits: int = 15) -> Column:
    return F.conv(F.substring(hashed, start, digits), 16, 10).cast("long")


def permute_int(x: Column, a: int, b: int, key: str, tag: str) -> Column:
    """A permutation of 0 to a*b - 1 (longs): an alternating Feistel network over x div b and x mod b."""
    start = F.struct(F.floor(x / F.lit(b)).cast("long").alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))

    def step(s, i):
        even = F.pmod(i, F.lit(2)) == 0
        h = lambda half: _number(_round_hash(key, F.lit(tag), i, half.cast("string")))
        left = F.when(even, F.pmod(s["l"] + h(s["r"]), F.lit(a))).otherwise(s["l"]).cast("long")
        right = F.when(even, s["r"]).otherwise(F.pmod(s["r"] + h(s["l"]), F.lit(b))).cast("long")
        return F.struct(left.alias("l"), right.alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * F.lit(b) + s["r"])


def _shifted(text: Column, hashed: Column) -> Column:
    """Each character moved on within its class by a byte of the hash; others stay."""

    def one(c, i):
        by = F.conv(F.substr(hashed, F.pmod(2 * i, F.lit(64)) + 1, F.lit(2)), 16, 10).cast("int")
        code = F.ascii(c)
        move = lambda first, n: F.char(F.lit(first) + F.pmod(code - first + by, F.lit(n)))
        return F.when(c.rlike("[0-9]"), move(48, 10)).when(c.rlike("[a-z]"), move(97, 26)).when(c.rlike("[A-Z]"), move(65, 26)).otherwise(c)

    return F.when(F.length(text) > 0, F.array_join(F.transform(F.split(text, ""), one), "")).otherwise(text)


def permute_text(x: Column, key: str, tag: str) -> Column:
    """A permutation of the strings of x's length and classes of characters; punctuation stays in place."""
    n = F.floor(F.length(x) / 2).cast("int")
    start = F.struct(F.substr(x, F.lit(1), n).alias("l"), F.substr(x, n + 1, F.length(x)).alias("r"))

    def step(s, i):
        even = F.pmod(i, F.lit(2)) == 0
        left = F.when(even, _shifted(s["l"], _round_hash(key, F.lit(tag), i, s["r"]))).otherwise(s["l"])
        right = F.when(even, s["r"]).otherwise(_shifted(s["r"], _round_hash(key, F.lit(tag), i, s["l"])))
        return F.struct(left.alias("l"), right.alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["l"], s["r"]))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _into(x: Column, plain: Column) -> Column:
    """plain's characters at the places of x's digits."""
    return F.array_join(F.zip_with(F.split(x, "[0-9]"), F.split(plain, ""), lambda gap, c: F.concat(gap, F.coalesce(c, F.lit("")))), "")


def luhn_sum(digits: Column) -> Column:
    """The check sum of a digit string whose last digit counts once."""
    doubled = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(F.pmod(i, F.lit(2)) == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda s, d: s + d)


def mod97(rearranged: Column) -> Column:
    """The remainder by 97 of a string of digits and capitals (A is 10)."""

    def step(s, c):
        v = F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.pmod(s * F.when(v < 10, 10).otherwise(100) + v, F.lit(97)).cast("long")

    return F.aggregate(F.split(rearranged, ""), F.lit(0).cast("long"), step)


def _card(m: Column, key: str) -> Column:
    d = _digits(m)
    body = F.concat(F.substring(d, 1, 1), permute_text(F.substr(d, F.lit(2), F.length(d) - 2), key, "card"))
    check = F.pmod(10 - luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    return F.when(F.pmod(luhn_sum(d), F.lit(10)) == 0, _into(m, F.concat(body, check)))


def _iban(m: Column, key: str) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    bank = permute_text(F.substr(plain, F.lit(5), F.length(plain)), key, "iban")
    country = F.substring(plain, 1, 2)
    check = F.lpad((98 - mod97(F.concat(bank, country, F.lit("00")))).cast("string"), 2, "0")
    new = F.concat(country, check, bank)
    spaced = F.array_join(F.zip_with(F.split(m, "[A-Z0-9]"), F.split(new, ""), lambda gap, c: F.concat(gap, F.coalesce(c, F.lit("")))), "")
    return F.when(mod97(F.concat(F.substr(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1, spaced)


def _ip(m: Column, key: str) -> Column:
    p = F.split(m, r"\.")
    x = F.aggregate(p, F.lit(0).cast("long"), lambda s, o: s * 256 + o.cast("long"))
    y = permute_int(x, 1 << 16, 1 << 16, key, "ip")
    octets = F.transform(F.array(*[F.lit(s) for s in (24, 16, 8, 0)]), lambda s: F.pmod(F.floor(y / F.pow(F.lit(2), s)), F.lit(256)).cast("int").cast("string"))
    return F.array_join(octets, ".")


def _moved_day(day: Column, key: str, fits=None) -> Column:
    """Another day; fits: what the days of the form have in common, which day has too."""
    a, b = DAYS
    first = F.lit(FIRST_DAY).cast("date")
    n = F.datediff(day, first).cast("long")
    date = lambda x: F.date_add(first, x.cast("int"))
    moved = permute_int(n, a, b, key, "date")
    if fits is not None:
        moved = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), moved, lambda x, _: F.when(fits(date(x)), x).otherwise(permute_int(x, a, b, key, "date")))
    return F.when((n >= 0) & (n < a * b), date(moved))


def _iso_date(m: Column, key: str) -> Column:
    return F.date_format(_moved_day(F.try_to_date(m, "yyyy-MM-dd"), key), "yyyy-MM-dd")


def _day_date(m: Column, key: str) -> Column:
    """Day first where that is a date, else month first; both numbers keep their width. A form's days: those that
    fit the widths and, month first, have no reading with the day first (they are after the 12th)."""
    mark = F.when(F.contains(m, F.lit("/")), "/").otherwise(".")
    p = F.split(m, "[/.]")
    day_first = F.try_to_date(F.concat_ws("-", p[2], p[1], p[0]), "yyyy-M-d")
    month_first = F.try_to_date(F.concat_ws("-", p[2], p[0], p[1]), "yyyy-M-d")
    plain = day_first.isNotNull()
    wide = [F.length(p[0]) == 2, F.length(p[1]) == 2]

    def fits(day: Column) -> Column:
        d, month = F.dayofmonth(day), F.month(day)
        one, two = F.when(plain, d).otherwise(month), F.when(plain, month).otherwise(d)
        return (wide[0] | (one < 10)) & (wide[1] | (two < 10)) & (plain | (d > 12))

    new = _moved_day(F.coalesce(day_first, month_first), key, fits)
    d, month = F.dayofmonth(new), F.month(new)
    one, two = F.when(plain, d).otherwise(month), F.when(plain, month).otherwise(d)
    part = lambda x, i: F.when(wide[i], F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))
    return F.when(new.isNotNull() & fits(new), F.concat(part(one, 0), mark, part(two, 1), mark, F.date_format(new, "yyyy")))


def _ssn(m: Column, key: str) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    p = F.transform(F.split(m, "-"), lambda s: s.cast("long"))
    area, group, serial = p[0], p[1], p[2]
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    x = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1
    y = permute_int(x, 898 * 99, 9999, key, "ssn")
    a = F.floor(y / (99 * 9999))
    out = F.format_string("%03d-%02d-%04d", a + F.when(a >= 665, 2).otherwise(1), F.pmod(F.floor(y / 9999), F.lit(99)) + 1, F.pmod(y, F.lit(9999)) + 1)
    return F.when(valid, out)


def _phone(m: Column, key: str) -> Column:
    """The country code stays. Ten digits of the North American plan (no area or exchange below 200) stay in it, and
    other ten digits stay outside."""
    code = F.regexp_extract(m, r"^\+(?:1(?=[^0-9]?\(?[2-9][0-9]{2})|[0-9]{1,3}(?=[ .(-])|[0-9]{2})", 0)
    rest = F.substr(m, F.length(code) + 1, F.length(m))
    d = _digits(rest)
    ten = (F.length(d) == 10) & code.isin("", "+1")
    n = d.cast("long")
    area, exchange, line = F.floor(n / 10_000_000), F.pmod(F.floor(n / 10_000), F.lit(1000)), F.pmod(n, F.lit(10_000))
    number = lambda a, e, x: F.lpad((a * 10_000_000 + e * 10_000 + x).cast("long").cast("string"), 10, "0")
    y = permute_int(((area - 200) * 800 + exchange - 200) * 10_000 + line, 80_000, 80_000, key, "phone")
    inside = number(F.floor(y / 8_000_000) + 200, F.pmod(F.floor(y / 10_000), F.lit(800)) + 200, F.pmod(y, F.lit(10_000)))
    # outside the plan: 200 areas with 1,000 exchanges each, then 800 areas with 200
    z = permute_int(F.when(area < 200, n).otherwise(2_000_000_000 + ((area - 200) * 200 + exchange) * 10_000 + line), 60_000, 60_000, key, "phone")
    more = z - 2_000_000_000
    outside = F.when(more < 0, F.lpad(z.cast("string"), 10, "0")).otherwise(number(F.floor(more / 2_000_000) + 200, F.pmod(F.floor(more / 10_000), F.lit(200)), F.pmod(more, F.lit(10_000))))
    plain = F.when(ten & (area >= 200) & (exchange >= 200), inside).when(ten, outside).otherwise(permute_text(d, key, "phone"))
    return F.when((F.length(d) >= 7) & (F.length(d) <= 14), F.concat(code, _into(rest, plain)))


def _email(m: Column, key: str) -> Column:
    at = F.instr(m, "@")
    host = F.substr(m, at + 1, F.length(m))
    name = F.regexp_extract(host, r"^(.*)\.[A-Za-z]+$", 1)
    local = permute_text(F.substr(m, F.lit(1), at - 1), key, "local")
    return F.concat(local, F.lit("@"), permute_text(name, key, "host"), F.substr(host, F.length(name) + 1, F.length(host)))


_MAKERS = {"email": _email, "iban": _iban, "ip": _ip, "iso_date": _iso_date, "day_date": _day_date, "ssn": _ssn, "card": _card, "phone": _phone}


def pseudonym(m: Column, key: str) -> Column:
    """A struct of kind and new for a candidate: the first format that it has as a whole and that is valid."""
    tried = []
    for name, pattern in FORMATS.items():
        new = F.when(m.rlike(rf"\A(?:{pattern})\z"), _MAKERS[name](m, key))
        kind = "date" if name.endswith("date") else name
        tried.append(F.when(new.isNotNull(), F.struct(F.lit(kind).alias("kind"), new.alias("new"))))
    return F.coalesce(*tried, F.struct(F.lit(None).cast("string").alias("kind"), m.alias("new")))


def _is(kind: str):
    return lambda x: x == F.lit(kind)


def pseudonymised(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with text's values replaced, and n_pseudonyms and n_<kind> of what was. Nothing is shuffled.

    Texts without a digit or an at sign pass by the pattern.
    """
    pattern = "|".join(FORMATS.values())
    names = [*(f"n_{k}" for k in KINDS), "n_pseudonyms"]
    found = F.when(F.col(text).rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    seen = unused(docs, "found")
    out = docs.drop(*names).withColumn(seen, F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda m: pseudonym(m, key)))
    new = F.array_join(F.zip_with(F.split(F.col(text), pattern, -1), F.transform(seen, lambda f: f["new"]), lambda gap, m: F.concat(gap, F.coalesce(m, F.lit("")))), "")
    out = out.withColumn(text, F.when(F.size(seen) > 0, new).otherwise(F.col(text)))
    counts = {f"n_{k}": F.size(F.filter(F.transform(seen, lambda f: f["kind"]), _is(k))).cast("long") for k in KINDS}
    out = out.withColumns(counts)
    return out.withColumn("n_pseudonyms", F.size(F.filter(seen, lambda f: f["kind"].isNotNull())).cast("long")).drop(seen)
