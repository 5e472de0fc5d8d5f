"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

A value is split in two; each round adds to one part what a keyed digest of the other part
says, so the whole is a permutation of the values of its format that the key can undo. Equal
values get equal pseudonyms in every document. Numbers are validated before they are touched
and stay valid: card numbers and account numbers get a new check digit, dates stay dates,
addresses stay addresses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: days of 400 years, as a product of the sizes of two parts
DAYS = (189, 773)
#: of these, days of a month after the twelfth
LATE_DAYS = (9, 9833)
FIRST_DAY = "1800-01-01"

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
SECRET = r"(?<![A-Za-z0-9])(?=[A-Fa-f]*+[0-9])[A-Fa-f0-9]{32,}+(?![A-Za-z0-9])"
ACCOUNT = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"
DATE = (r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}"
        r"|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|[./-][0-9])")
ADDRESS = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])"
PHONE = (r"(?<![0-9])(?:\+[0-9]{1,3}[ -]?\(?[0-9]{2,4}\)?[ -]?[0-9]{3,4}[ -]?[0-9]{3,4}"
         r"|\(?[0-9]{3}\)?[ -][0-9]{3}-[0-9]{4})(?![0-9])")
PERSON = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
ANY = "|".join([EMAIL, SECRET, ACCOUNT, DATE, ADDRESS, PERSON, CARD, PHONE])


def _digest(key: Column, *parts: Column) -> Column:
    """A number below 2^48 from the key and the parts."""
    text = F.concat_ws("|", key, *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long")


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _rounds(left: Column, right: Column, step: Callable[[Column, Column, Column, int], Column],
            ) -> tuple[Column, Column]:
    """Run the rounds: ``step(part, other, round, which)`` gives the new part."""
    state = F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(left.alias("a"), right.alias("b")),
        lambda s, r: F.struct(
            F.when(r % 2 == 1, step(s["a"], s["b"], r, 0)).otherwise(s["a"]).alias("a"),
            F.when(r % 2 == 0, step(s["b"], s["a"], r, 1)).otherwise(s["b"]).alias("b")))
    return state["a"], state["b"]


PLAIN, HEXADECIMAL = ("09", "AZ", "az"), ("09", "AF", "af")


def permute_text(text: Column, key: Column, undo: bool = False,
                 ranges: tuple[str, ...] = PLAIN) -> Column:
    """Permutes digits among digits and letters among letters; other signs stay."""
    def moved(c: Column, by: Column) -> Column:
        out = c
        for first, last in ranges:
            size = ord(last) - ord(first) + 1
            shift = F.pmod(-by if undo else by, F.lit(size))
            out = F.when(c.between(first, last), F.char(
                (F.pmod(F.ascii(c) - ord(first) + shift, F.lit(size)) + ord(first)))).otherwise(out)
        return out

    def step(part: Column, other: Column, r: Column, which: int) -> Column:
        r = F.lit(ROUNDS + 1) - r if undo else r
        return F.array_join(F.transform(_characters(part), lambda c, i: moved(
            c, _digest(key, r, i, other))), "")

    half = F.floor(F.length(text) / 2).cast("int")
    left, right = F.substr(text, F.lit(1), half), F.substr(text, half + 1)
    if undo:  # the last round changed the right part
        right, left = _rounds(right, left, step)
        return F.concat(left, right)
    return F.concat(*_rounds(left, right, step))


def permute_number(high: Column, low: Column, sizes: tuple[int, int], key: Column,
                   undo: bool = False) -> tuple[Column, Column]:
    """Permutes pairs of numbers below ``sizes``."""
    def add(part: Column, other: Column, r: Column, size: int) -> Column:
        by = _digest(key, F.lit(ROUNDS + 1) - r if undo else r, other)
        return F.pmod(part - by if undo else part + by, F.lit(size))

    if undo:
        low, high = _rounds(low, high, lambda p, o, r, w: add(p, o, r, sizes[1 - w]))
        return high, low
    return _rounds(high, low, lambda p, o, r, w: add(p, o, r, sizes[w]))


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    def worth(c: Column, i: Column) -> Column:
        n = F.ascii(c) - 48
        return F.when(i % 2 == 0, n).otherwise(2 * n - F.when(n > 4, 9).otherwise(0))

    return F.aggregate(F.transform(_characters(F.reverse(digits)), worth), F.lit(0),
                       lambda a, n: a + n)


def rest_of_97(text: Column) -> Column:
    """Rest of an account number, letters read as 10 to 35, divided by 97."""
    def more(a: Column, c: Column) -> Column:
        n = F.ascii(c)
        return F.when(n >= 65, (a * 100 + n - 55) % 97).otherwise((a * 10 + n - 48) % 97)

    return F.aggregate(_characters(text), F.lit(0), more)


def refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by ``digits``."""
    return F.array_join(F.transform(_characters(shape), lambda c, i: F.when(
        c.between("0", "9"), F.substr(digits, F.length(digits_of(F.substr(shape, F.lit(1), i + 1))),
                                      F.lit(1))).otherwise(c)), "")


def card_pseudonym(value: Column, key: Column) -> Column:
    digits = digits_of(value)
    body = permute_text(F.substr(digits, F.lit(1), F.length(digits) - 1), key)
    check = F.pmod(-luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    return refill(value, F.concat(body, check))


def account_pseudonym(value: Column, key: Column) -> Column:
    land, body = F.substring(value, 1, 2), permute_text(F.substr(value, F.lit(5)), key)
    check = F.lit(98) - rest_of_97(F.concat(body, land, F.lit("00")))
    return F.concat(land, F.lpad(check.cast("string"), 2, "0"), body)


def phone_pseudonym(value: Column, key: Column) -> Column:
    """The country code stays."""
    code = F.regexp_extract(value, r"^(\+[0-9]{1,3})[ (-]", 1)
    rest = F.substr(value, F.length(code) + 1)
    return F.concat(code, refill(rest, permute_text(digits_of(rest), key)))


def email_pseudonym(value: Column, key: Column) -> Column:
    """The domain stays."""
    return F.concat(permute_text(F.substring_index(value, "@", 1), key), F.lit("@"),
                    F.substring_index(value, "@", -1))


def address_pseudonym(value: Column, key: Column) -> Column:
    part = F.transform(F.split(value, r"\."), lambda c: c.cast("long"))
    high, low = (part[i] * 256 + part[i + 1] for i in (0, 2))
    high, low = permute_number(high, low, (65536, 65536), key)
    return F.concat_ws(".", *[n.cast("string") for x in (high, low)
                              for n in (F.floor(x / 256), x % 256)])


def _let(value: Column, result: Callable[[Column], Column]) -> Column:
    """``result`` of a value that it uses more than once."""
    return F.element_at(F.transform(F.array(value), result), 1)


def _first() -> Column:
    return F.lit(FIRST_DAY).cast("date")


def _day_number(day: Column) -> Column:
    return F.datediff(day, _first()).cast("long")


def date_pseudonym(value: Column, pattern: str, key: Column, undo: bool = False) -> Column:
    """Days are permuted among all days of 400 years."""
    days = _day_number(F.try_to_date(value, pattern))
    high, low = permute_number(F.floor(days / DAYS[1]), days % DAYS[1], DAYS, key, undo)
    return F.date_format(F.date_add(_first(), (high * DAYS[1] + low).cast("int")), pattern)


def late_date_pseudonym(value: Column, pattern: str, key: Column, undo: bool = False) -> Column:
    """The 13th and later days of months are permuted among each other.

    These are the dates that are no dates when read with the day first, and so are their
    pseudonyms; the number of such a day leaves out twelve for each month up to its own.
    """
    day = F.try_to_date(value, pattern)
    month = (F.year(day) - int(FIRST_DAY[:4])) * 12 + F.month(day) - 1
    number = _day_number(day) - 12 * (month + 1)
    high, low = permute_number(F.floor(number / LATE_DAYS[1]), number % LATE_DAYS[1], LATE_DAYS, key, undo)

    def before(month: Column) -> Column:
        """Late days before a month."""
        return _day_number(F.add_months(_first(), month)) - 12 * month

    def dated(number: Column) -> Column:
        # months of equal length would begin at most two months off
        guess = F.floor(number * 4800 / (LATE_DAYS[0] * LATE_DAYS[1])).cast("int")
        near = F.sequence(F.greatest(F.lit(0), guess - 2), F.least(F.lit(4799), guess + 2))
        month = F.array_max(F.filter(near, lambda m: before(m) <= number))
        return _let(month, lambda m: F.date_add(F.add_months(_first(), m), (number - before(m) + 12).cast("int")))

    return F.date_format(_let(high * LATE_DAYS[1] + low, dated), pattern)


def pseudonym(value: Column, key: Column) -> Column:
    """The pseudonym of a match of ``ANY``; null where it is no valid value."""
    def whole(pattern: str) -> Column:
        return value.rlike(f"^(?:{pattern})$")

    def day(pattern: str) -> Column:
        d = F.try_to_date(value, pattern)
        return d.between(F.lit(FIRST_DAY).cast("date"), F.lit("2199-12-31").cast("date"))

    digits = digits_of(value)
    out = F.when(whole(EMAIL), email_pseudonym(value, key)).when(
        whole(ADDRESS), F.when(F.forall(F.split(value, r"\."), lambda c: c.cast("int") <= 255),
                               address_pseudonym(value, key)))
    for shape, pattern in ((r"\d{4}-\d{2}-\d{2}", "yyyy-MM-dd"), (r"\d{2}\.\d{2}\.\d{4}", "dd.MM.yyyy"),
                           (r"\d{2}/\d{2}/\d{4}", "dd/MM/yyyy")):
        out = out.when(whole(shape) & day(pattern), date_pseudonym(value, pattern, key))
        if "/" in pattern:  # the month first, where that alone makes a date
            other = "MM/dd/yyyy"
            out = out.when(whole(shape) & day(other) & (F.substring(value, 4, 2) > "12"),
                           late_date_pseudonym(value, other, key))
        out = out.when(whole(shape), F.lit(None))
    return (out.when(whole(SECRET), permute_text(value, key, ranges=HEXADECIMAL))
            .when(whole(ACCOUNT), F.when(rest_of_97(F.concat(
                F.substr(value, F.lit(5)), F.substring(value, 1, 4))) == 1,
                account_pseudonym(value, key)))
            .when(whole(PERSON), refill(value, permute_text(digits, key)))
            .when(whole(CARD), F.when(luhn_sum(digits) % 10 == 0, card_pseudonym(value, key)))
            .otherwise(phone_pseudonym(value, key)))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """One row per document row: doc_id, text, n_found (values replaced).

    Found are e-mail addresses, secrets of 32 hexadecimal digits and more, account numbers,
    dates from 1800 to 2199, IPv4 addresses, personal numbers, card numbers and telephone
    numbers. What fails its check stays as it is. Null text stays null with 0 found; text
    without values stays as it is; repeated rows give equal rows; other columns are not
    looked at.
    """
    found = F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
    listed = docs.select("doc_id", "text", F.coalesce(found, F.array()).alias("found"))
    # as rows of an array of one, so that matches are replaced once though they are used twice
    replaced = F.transform("found", lambda v: F.struct(v.alias("old"), pseudonym(v, F.lit(key)).alias("new")))
    done = listed.select("doc_id", "text", F.inline(F.array(F.struct(
        F.when(F.size("found") > 0, replaced).alias("pairs")))))
    put = F.array_append(F.transform("pairs", lambda p: F.coalesce(p["new"], p["old"])), F.lit(""))
    text = F.array_join(F.zip_with(F.split("text", ANY, -1), put, lambda a, b: F.concat(a, b)), "")
    return done.select(
        "doc_id", F.when(F.col("pairs").isNull(), F.col("text")).otherwise(text).alias("text"),
        F.coalesce(F.size(F.filter("pairs", lambda p: p["new"].isNotNull())), F.lit(0))
        .cast("long").alias("n_found"))
