"""Format-preserving pseudonyms for personal data, by SQL functions only (operator 2).

Card numbers, IBANs, social-security numbers, phone numbers, IP addresses and
dates that pass their own checks are permuted within their format by a keyed
Feistel network: two parts of the value take turns at adding a keyed hash of the
other one, modulo their sizes. Check digits are set anew. The same key maps
equal values to equal pseudonyms in every document, and different ones apart.
E-mail addresses have no bounded format; theirs are a keyed hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9A-Za-z-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9A-Za-z]|-[0-9])"
DAY_FIRST = r"(?<![0-9A-Za-z./])[0-9]{2}(?<dot>[./])[0-9]{2}\k<dot>[0-9]{4}(?![0-9A-Za-z]|[./][0-9])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
PHONE = r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?|00[0-9]{1,3}[ -])(?:\(0\)[ .-]?)?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])"
#: National numbers of the countries with code 1: area and exchange start with 2 to 9.
NATIONAL = r"(?<![0-9A-Za-z+(.-])(?:1[ .-])?(?:\([2-9][0-9]{2}\)[ -]?[2-9][0-9]{2}-[0-9]{4}|[2-9][0-9]{2}(?<npa>[.-])[2-9][0-9]{2}\k<npa>[0-9]{4})(?![0-9A-Za-z]|[.-][0-9])"
#: Eight groups, or fewer with a double colon and at least one decimal digit, as names in programs have double colons too.
IPV6 = (
    r"(?<![0-9A-Za-z:.])(?=[A-Fa-f:]{0,36}[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}"
    r"|(?:[0-9A-Fa-f]{1,4}:){1,7}:|:(?::[0-9A-Fa-f]{1,4}){1,7})(?![0-9A-Za-z:]|\.[0-9])"
)
CARD = r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?<gap>[ -])[0-9]{4}\k<gap>[0-9]{4}\k<gap>[0-9]{1,7}|[0-9]{4}(?<slot>[ -])[0-9]{6}\k<slot>[0-9]{5})(?![0-9A-Za-z])"
ANY = "|".join((EMAIL, IBAN, IP, IPV6, DATE, DAY_FIRST, SSN, PHONE, NATIONAL, CARD))
#: A quick test that any of the above implies.
HINT = "@|[0-9]{4}|[0-9]{1,3}[.][0-9]{1,3}[.]|[0-9]{2}[./ -][(]?[0-9]|[+][0-9]|::|:[0-9A-Fa-f]{1,4}:"

#: Days that are permuted among themselves: from this one, 250 times 292; other dates stay in their year.
FIRST_DAY, DAY_PARTS = "1900-01-01", (250, 292)


def feistel(a: Column, b: Column, m, n, tweak: Column, key: str) -> Column:
    """struct(a, b) permuted, with 0 <= a < m and 0 <= b < n."""

    def keyed(x: Column, i: Column) -> Column:
        text = F.concat_ws("|", F.lit(key), tweak, i.cast("string"), x.cast("string"))
        return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("long")

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        f = keyed(F.when(even, s["b"]).otherwise(s["a"]), i)
        return F.struct(
            F.when(even, (s["a"] + f % m) % m).otherwise(s["a"]).alias("a"),
            F.when(even, s["b"]).otherwise((s["b"] + f % n) % n).alias("b"),
        )

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _padded(x: Column, width) -> Column:
    return F.lpad(x.cast("string"), width, "0")


def _power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def permuted_digits(digits: Column, kind: str, key: str) -> Column:
    """As many digits, from 2 to 36 of them."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    s = feistel(F.substring(digits, F.lit(1), u), F.substring(digits, u + 1, n - u), _power(u), _power(n - u), F.concat(F.lit(kind), n.cast("string")), key)
    return F.transform(F.array(s), lambda x: F.concat(_padded(x["a"], u), _padded(x["b"], n - u)))[0]


def refilled(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced one by one."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def put(s: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(s["out"], F.when(digit, F.substring(digits, s["k"], F.lit(1))).otherwise(c)).alias("out"), (s["k"] + digit.cast("int")).alias("k"))

    return F.aggregate(F.split(value, ""), start, put, lambda s: s["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _card(value: Column, key: str) -> Column:
    """All but the last digit permuted; the last one makes the sum right again."""
    d = _digits(value)
    body = permuted_digits(F.substring(d, F.lit(1), F.length(d) - 1), "card", key)
    whole = F.transform(F.array(body), lambda b: F.concat(b, F.filter(F.array(*(F.lit(str(i)) for i in range(10))), lambda c: _luhn(F.concat(b, c)))[0]))[0]
    return F.when((F.length(d) >= 13) & _luhn(d), refilled(value, whole))


def _mod97(text: Column) -> Column:
    """Of the number that letters (A is 10) and digits make."""

    def add(s: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (s * 100 + code - 55) % 97).otherwise((s * 10 + code - 48) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0).cast("int"), add)


def _iban(value: Column, key: str) -> Column:
    """The account's digits permuted, its letters kept, the check digits set anew."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    country = F.substring(plain, 1, 2)
    account = F.substring(plain, F.lit(5), F.length(plain) - 4)
    valid = F.length(plain).between(15, 34) & (_mod97(F.concat(account, F.substring(plain, 1, 4))) == 1) & (F.length(_digits(account)) >= 2)
    moved = refilled(account, permuted_digits(_digits(account), "iban", key))
    whole = F.transform(F.array(moved), lambda a: F.concat(country, _padded(F.lit(98) - _mod97(F.concat(a, country, F.lit("00"))), 2), a))[0]
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def put(s: Column, c: Column) -> Column:
        gap = c == " "
        return F.struct(F.concat(s["out"], F.when(gap, c).otherwise(F.substring(whole, s["k"], F.lit(1)))).alias("out"), (s["k"] + (~gap).cast("int")).alias("k"))

    return F.when(valid, F.aggregate(F.split(value, ""), start, put, lambda s: s["out"]))


def _ssn(value: Column, key: str) -> Column:
    """Area 001-899 without 666, group 01-99, serial 0001-9999, permuted among all such."""
    area, group, serial = (F.substring(value, *x).cast("long") for x in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group >= 1) & (serial >= 1)
    index = F.when(area > 666, area - 2).otherwise(area - 1)
    s = feistel(index * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), F.lit("ssn"), key)

    def shown(x: Column) -> Column:
        i = F.floor(x["a"] / 99)
        return F.concat_ws("-", _padded(F.when(i >= 665, i + 2).otherwise(i + 1), 3), _padded(x["a"] % 99 + 1, 2), _padded(x["b"] + 1, 4))

    return F.when(valid, F.transform(F.array(s), shown)[0])


#: The country calling codes of two digits; of the others, those that start with 1 or 7 have one digit and the rest three.
TWO_DIGIT_CODES = (
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
).split()


def _phone(value: Column, key: str) -> Column:
    """The digits after the country's, 8 to 15 in all; what is written for dialling (00, a zero in brackets) isn't part of the number."""
    d = _digits(value)
    dialled = F.when(value.startswith("00"), "00").otherwise("")
    whole = F.substring(d, F.length(dialled) + 1, F.length(d))
    size = F.when(whole.rlike("^[17]"), 1).when(F.substring(whole, 1, 2).isin(TWO_DIGIT_CODES), 2).otherwise(3)
    code = F.substring(whole, F.lit(1), size)
    zero = F.when(value.contains("(0)") & (F.substring(whole, size + 1, F.lit(1)) == "0"), "0").otherwise("")
    rest = F.substring(whole, size + F.length(zero) + 1, F.length(whole))
    return F.when(F.length(whole).between(8, 15), refilled(value, F.concat(dialled, code, zero, permuted_digits(rest, "phone", key))))


def _national(value: Column, key: str) -> Column:
    """As with the country code 1 before it, which may stand there already."""
    d = _digits(value)
    code = F.when(F.length(d) == 11, "1").otherwise("")
    return refilled(value, F.concat(code, permuted_digits(F.substring(d, F.length(code) + 1, F.lit(10)), "phone", key)))


def _ipv6(value: Column, key: str) -> Column:
    """Each half permuted, the second by a key of its own for each first one; eight groups in lower case, however it was written."""
    sides = F.transform(F.split(value, "::"), lambda s: F.filter(F.split(s, ":"), lambda g: g != ""))
    left, right = sides[0], F.coalesce(F.get(sides, F.lit(1)), F.array().cast("array<string>"))
    missing = F.lit(8) - F.size(left) - F.size(right)
    valid = F.when(value.contains("::"), missing >= 1).otherwise(missing == 0)
    group = F.transform(F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right), lambda g: F.conv(g, 16, 10).cast("long"))
    pair = lambda i: F.get(group, F.lit(i)) * 65536 + F.get(group, F.lit(i + 1))
    size = F.lit(1 << 32)
    first = feistel(pair(0), pair(2), size, size, F.lit("ip6"), key)
    second = feistel(pair(4), pair(6), size, size, F.concat_ws("|", F.lit("ip6"), pair(0).cast("string"), pair(2).cast("string")), key)
    shown = lambda x: [F.lower(F.hex(f(x[p]).cast("long"))) for p in "ab" for f in (lambda y: F.floor(y / 65536), lambda y: y % 65536)]
    halves = F.transform(F.array(first, second), lambda x: F.concat_ws(":", *shown(x)))
    return F.when(valid, F.concat_ws(":", halves))


def _ip(value: Column, key: str) -> Column:
    part = F.transform(F.split(value, "[.]"), lambda x: x.cast("long"))
    valid = ~F.exists(part, lambda x: x > 255)
    s = feistel(part[0] * 256 + part[1], part[2] * 256 + part[3], F.lit(65536), F.lit(65536), F.lit("ip"), key)
    return F.when(valid, F.transform(F.array(s), lambda x: F.concat_ws(".", *(f(x[p]).cast("long").cast("string") for p in "ab" for f in (lambda y: F.floor(y / 256), lambda y: y % 256))))[0])


def _day(date: Column, key: str) -> Column:
    """Another day: within the common range, or in the same year, where a leap year's last day stays."""
    first, (m, n) = F.to_date(F.lit(FIRST_DAY)), DAY_PARTS
    at = F.datediff(date, first).cast("long")
    s = feistel(F.floor(at / n), at % n, F.lit(m), F.lit(n), F.lit("date"), key)
    near = F.transform(F.array(s), lambda x: F.date_add(first, (x["a"] * n + x["b"]).cast("int")))[0]
    day = F.dayofyear(date).cast("long") - 1
    t = feistel(F.floor(day / 73), day % 73, F.lit(5), F.lit(73), F.concat(F.lit("year"), F.year(date).cast("string")), key)
    far = F.transform(F.array(t), lambda x: F.date_add(F.trunc(date, "year"), (x["a"] * 73 + x["b"]).cast("int")))[0]
    return F.when(at.between(0, m * n - 1), near).when(day < 365, far).otherwise(date)


def _date(value: Column, key: str) -> Column:
    date = F.try_to_date(value, "yyyy-MM-dd")
    return F.when(date.isNotNull(), F.date_format(_day(date, key), "yyyy-MM-dd"))


def _day_first(value: Column, key: str) -> Column:
    """Day first, or month first where it can only be that."""
    plain = F.translate(value, ".", "/")
    date, other = F.try_to_date(plain, "dd/MM/yyyy"), F.try_to_date(plain, "MM/dd/yyyy")
    moved = _day(F.coalesce(date, other), key)
    return F.when(date.isNotNull() | other.isNotNull(), refilled(value, F.when(date.isNotNull(), F.date_format(moved, "ddMMyyyy")).otherwise(F.date_format(moved, "MMddyyyy"))))


def _email(value: Column, key: str) -> Column:
    """Equal up to case, equal pseudonym."""
    h = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(value)).cast("binary"), 256)
    return F.concat(F.lit("u"), F.substring(h, 1, 16), F.lit("@x"), F.substring(h, 17, 8), F.lit(".example"))


#: Kind -> pattern of a whole match and pseudonym; the first that fits.
KINDS = {
    "email": ("@", _email),
    "iban": ("^[A-Z]", _iban),
    "ip": (r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$", _ip),
    "ipv6": (":", _ipv6),
    "date": ("^[0-9]{4}-[0-9]{2}-[0-9]{2}$", _date),
    "day_first": ("^[0-9]{2}[./][0-9]{2}[./][0-9]{4}$", _day_first),
    "ssn": ("^[0-9]{3}-[0-9]{2}-[0-9]{4}$", _ssn),
    "phone": (r"^(?:\+|00[0-9]{1,3}[ -])", _phone),
    "national": (r"^(?:1[ .-])?(?:\(|[2-9][0-9]{2}[.-])", _national),
    "card": (".", _card),
}


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of a match of ``ANY``, or null if its own check fails."""
    out = None
    for pattern, made in KINDS.values():
        out = (F if out is None else out).when(value.rlike(pattern), made(value, key))
    return out


def pseudonymised(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_found, n_emails, n_dates, n_numbers, text): each whole text with pseudonyms for what was found.

    A null text stays null and an empty one empty, with counts of zero. What
    looks like personal data but fails its check stays. Repeated rows are
    treated each; an empty table gives an empty one; texts are treated whole,
    whatever their length. Other columns are left out, whatever their names.
    """
    text = F.col("text")
    # what a pattern matches and what stands between, in turn; the patterns never match nothing
    hits = F.when(text.rlike(HINT), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("hits", F.coalesce(hits, F.array().cast("array<string>")))
    rows = rows.withColumn("made", F.transform("hits", lambda h: pseudonym(h, key)))
    found = F.filter(F.arrays_zip("hits", "made"), lambda p: p["made"].isNotNull())
    rows = rows.withColumn("found", F.transform(found, lambda p: p["hits"]))
    between = F.split(text, ANY, -1)
    filled = F.array_join(F.transform(F.sequence(F.lit(0), F.size("hits")), lambda i: F.concat(between[i], F.when(i < F.size("hits"), F.coalesce(F.get("made", i), F.get("hits", i))).otherwise(""))), "")
    emails = F.size(F.filter("found", lambda h: h.contains("@"))).cast("long")
    dates = F.size(F.filter("found", lambda h: h.rlike(f"{KINDS['date'][0]}|{KINDS['day_first'][0]}"))).cast("long")
    n = F.size("found").cast("long")
    return rows.select(
        "doc_id", n.alias("n_found"), emails.alias("n_emails"), dates.alias("n_dates"), (n - emails - dates).alias("n_numbers"),
        F.when(F.size("found") == 0, text).otherwise(filled).alias("text"),
    )
