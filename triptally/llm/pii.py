"""Pseudonyms of personal data that keep their format: keyed permutations by a Feistel network.

Everything here is SQL functions of Spark. A value is split in two halves that take turns in being
shifted by a keyed hash of the other, which is a permutation of all values of the format: equal
values get equal pseudonyms in all documents, different values different ones, and whoever has the
key can go back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triptally.llm.tables import unused

ROUNDS = 8

# The formats. No letter or digit may touch a value.
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
EMAIL = r"(?<![._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"
ISO_DATE = r"(?<!-)\d{4}-\d{2}-\d{2}(?!-)"
SLASH_DATE = r"(?<!/)\d{2}/\d{2}/\d{4}(?!/)"
DOT_DATE = r"(?<!\.)\d{2}\.\d{2}\.\d{4}(?!\.\d)"
SOCIAL = r"(?<!-)(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?!-)"
ADDRESS = rf"(?<!\.){OCTET}(?:\.{OCTET}){{3}}(?!\.\d)"
PHONE = r"\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,3}"
LOCAL_PHONE = r"(?:\(\d{3}\) ?|(?<!-)\d{3}[-.])\d{3}[-.]\d{4}(?!-)"
CARD = r"(?<!-)\d(?:[ -]?\d){12,18}(?!-)"
ANY = (
    rf"(?<![A-Za-z0-9])(?:{EMAIL}|{ISO_DATE}|{SLASH_DATE}|{DOT_DATE}|{SOCIAL}|{ADDRESS}|{PHONE}"
    rf"|{LOCAL_PHONE}|{CARD})(?![A-Za-z0-9])"
)
# The days of 400 years repeat; 146,097 = 189 * 773.
FIRST_DAY, WEEKS_A, DAYS_B = "1800-01-01", 189, 773


def _whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def _noise(key: str, kind: str, turn: Column, other: Column) -> Column:
    """48 keyed bits of the other half."""
    text = F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), other.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long")


def _feistel(left: Column, right: Column, a: Column, b: Column, key: str, kind: str) -> Column:
    """A permutation of pairs (l below a, r below b), as a struct."""
    begin = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def turn(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        l_new = (s["l"] + _noise(key, kind, i, s["r"])) % a
        r_new = (s["r"] + _noise(key, kind, i, s["l"])) % b
        return F.struct(
            F.when(odd, s["l"]).otherwise(l_new).alias("l"),
            F.when(odd, r_new).otherwise(s["r"]).alias("r"),
        )

    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), begin, turn)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _refill(shape: Column, digits: Column) -> Column:
    """The digits of `shape` replaced one by one, everything else kept."""
    def place(c: Column, i: Column) -> Column:
        nth = F.length(_digits(F.substring(shape, F.lit(1), i + 1)))
        return F.when(c.rlike(r"^\d$"), F.substring(digits, nth, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(shape, ""), place), "")


def _permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """A string of up to 36 digits, permuted among those of its length."""
    half = (F.length(digits) / 2).cast("int")
    left, right = F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, F.lit(36))
    size = F.length(digits)

    def joined(s: Column) -> Column:
        return F.concat(
            F.when(half > 0, F.lpad(s["l"].cast("string"), half, "0")).otherwise(""),
            F.lpad(s["r"].cast("string"), size - half, "0"),
        )

    ten = F.lit(10.0)
    return _let(
        _feistel(
            F.when(half > 0, left.cast("long")).otherwise(F.lit(0).cast("long")),
            right.cast("long"),
            F.pow(ten, half).cast("long"), F.pow(ten, size - half).cast("long"),
            key, f"{kind}",
        ),
        joined,
    )


def _luhn(digits: Column) -> Column:
    """The sum of the Luhn rule; the last digit counts once, the one before twice and so on."""
    def weigh(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when((F.length(digits) - i) % 2 == 1, d).otherwise(twice)

    parts = F.transform(F.split(digits, ""), weigh)
    return F.aggregate(parts, F.lit(0), lambda x, y: x + y)


def _card(value: Column, key: str) -> Column:
    """A number that passes the Luhn rule becomes another that does; others stay."""
    def permuted(digits: Column) -> Column:
        size = F.length(digits)
        body = _permuted_digits(F.substring(digits, F.lit(1), size - 1), key, "card")
        def closed(new: Column) -> Column:
            rest = (10 - _luhn(F.concat(new, F.lit("0"))) % 10) % 10
            return F.concat(new, rest.cast("string"))
        return F.when(_luhn(digits) % 10 == 0, _refill(value, _let(body, closed))).otherwise(value)

    return _let(_digits(value), permuted)


def _phone(value: Column, key: str) -> Column:
    """Keeps the country code and the first and fourth digit behind it, by which numbers are valid."""
    code = F.regexp_extract(value, r"^\+(\d{1,3})", 1)
    known = F.length(code)

    def permuted(digits: Column) -> Column:
        own = F.substring(digits, known + 1, F.lit(20))
        free = F.concat(F.substring(own, 2, 2), F.substring(own, 5, 20))
        def back(new: Column) -> Column:
            return F.concat(
                code, F.substring(own, 1, 1), F.substring(new, 1, 2), F.substring(own, 4, 1),
                F.substring(new, 3, 20),
            )
        return _refill(value, _let(_permuted_digits(free, key, "phone"), back))

    # A code that runs into the number cannot be told apart: then one digit is the code.
    return _let(_digits(value), permuted)


def _social(value: Column, key: str) -> Column:
    area = F.substring(value, 1, 3).cast("long")
    index = area - 1 - (area > 666).cast("long")
    rest = (F.substring(value, 5, 2).cast("long") - 1) * 9999 + F.substring(value, 8, 4).cast("long") - 1

    def written(s: Column) -> Column:
        new = s["l"] + 1
        return F.concat_ws(
            "-",
            F.lpad((new + (new > 665).cast("long")).cast("string"), 3, "0"),
            F.lpad(((s["r"] / 9999).cast("long") + 1).cast("string"), 2, "0"),
            F.lpad((s["r"] % 9999 + 1).cast("string"), 4, "0"),
        )

    a, b = F.lit(898).cast("long"), F.lit(99 * 9999).cast("long")
    return _let(_feistel(index, rest, a, b, key, "social"), written)


def _address(value: Column, key: str) -> Column:
    part = F.split(value, r"\.")
    number = lambda i: part[i].cast("long") * 256 + part[i + 1].cast("long")

    def written(s: Column) -> Column:
        octets = [x for c in ("l", "r") for x in ((s[c] / 256).cast("long"), s[c] % 256)]
        return F.concat_ws(".", *[x.cast("string") for x in octets])

    size = F.lit(65536).cast("long")
    return _let(_feistel(number(0), number(2), size, size, key, "address"), written)


def _date(value: Column, form: str, key: str) -> Column:
    """A date from 1800 to 2199 becomes another of these; what is no date stays."""
    day = F.try_to_timestamp(value, F.lit(form)).cast("date")

    def permuted(n: Column) -> Column:
        def written(s: Column) -> Column:
            at = (s["l"] * DAYS_B + s["r"]).cast("int")
            return F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), at), form)
        a, b = F.lit(WEEKS_A).cast("long"), F.lit(DAYS_B).cast("long")
        new = _let(_feistel((n / DAYS_B).cast("long"), n % DAYS_B, a, b, key, "date"), written)
        return F.when((n >= 0) & (n < WEEKS_A * DAYS_B), new).otherwise(value)

    return F.coalesce(_let(F.date_diff(day, F.lit(FIRST_DAY).cast("date")), permuted), value)


def _shifted(half: Column, noise: Column) -> Column:
    """Letters and digits moved within their kind, each by its own part of the noise (hex)."""
    def move(c: Column, i: Column) -> Column:
        by = F.conv(F.substring(noise, (i % 15) * 4 + 1, F.lit(4)), 16, 10).cast("int")
        code = F.ascii(c)
        turn = lambda base, n: F.chr((code - base + by) % n + base)
        return (
            F.when((code >= 97) & (code <= 122), turn(97, 26))
            .when((code >= 65) & (code <= 90), turn(65, 26))
            .when((code >= 48) & (code <= 57), turn(48, 10))
            .otherwise(c)
        )

    return F.when(F.length(half) == 0, half).otherwise(
        F.array_join(F.transform(F.split(half, ""), move), "")
    )


def _email(value: Column, key: str) -> Column:
    """The part before the sign, letter by letter and digit by digit; the domain stays."""
    name = F.substring_index(value, "@", 1)
    half = (F.length(name) / 2).cast("int")
    begin = F.struct(
        F.substring(name, F.lit(1), half).alias("l"), F.substring(name, half + 1, F.lit(64)).alias("r")
    )

    def noise(i: Column, other: Column) -> Column:
        return F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), i.cast("string"), other), 256)

    def turn(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(
            F.when(odd, s["l"]).otherwise(_shifted(s["l"], noise(i, s["r"]))).alias("l"),
            F.when(odd, _shifted(s["r"], noise(i, s["l"]))).otherwise(s["r"]).alias("r"),
        )

    folded = F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), begin, turn)
    return _let(
        folded, lambda s: F.concat(s["l"], s["r"], F.lit("@"), F.substring_index(value, "@", -1))
    )


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one value of a known format; a value that is not valid stays as it is."""
    return (
        F.when(value.contains("@"), _email(value, key))
        .when(value.rlike(_whole(ISO_DATE)), _date(value, "yyyy-MM-dd", key))
        .when(value.rlike(_whole(SLASH_DATE)), _date(value, "MM/dd/yyyy", key))
        .when(value.rlike(_whole(DOT_DATE)), _date(value, "dd.MM.yyyy", key))
        .when(value.rlike(_whole(SOCIAL)), _social(value, key))
        .when(value.rlike(_whole(ADDRESS)), _address(value, key))
        .when(value.rlike(_whole(f"{PHONE}|{LOCAL_PHONE}")), _phone(value, key))
        .otherwise(_card(value, key))
    )


def pseudonymize(
    docs: DataFrame, key: str, text: str = "text", count: str | None = None
) -> DataFrame:
    """`docs` with the personal data in `text` replaced; `count` names a column for how many.

    Found are e-mail addresses, dates (year-month-day, month/day/year, day.month.year), numbers of
    the form of US social security numbers, IPv4 addresses, telephone numbers and card numbers that
    pass the Luhn rule. Null and empty texts stay, their count is 0. Nothing is shuffled; a row
    depends on no other. A column named as `count` is replaced. Dates of other forms or years stay, as do numbers that fail their check.
    """
    docs = docs.drop(count) if count else docs
    columns = docs.columns
    values, new = unused(columns, "__values"), unused(columns, "__new")
    none = F.array().cast("array<string>")
    found = F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0))
    marked = docs.withColumn(
        values, F.when(F.col(text).rlike("[0-9@]"), found).otherwise(none)
    ).withColumn(new, F.transform(values, lambda v: pseudonym(v, key)))
    woven = F.array_join(
        F.zip_with(
            F.split(F.col(text), ANY, -1), F.col(new),
            lambda gap, other: F.concat(gap, F.coalesce(other, F.lit(""))),
        ),
        "",
    )
    replaced = F.when(F.size(values) > 0, woven).otherwise(F.col(text))
    changed = F.size(F.filter(
        F.zip_with(values, new, lambda a, b: a != b), lambda different: different
    ))
    more = [changed.cast("long").alias(count)] if count else []
    return marked.select(*[replaced.alias(c) if c == text else F.col(f"`{c}`") for c in columns], *more)
