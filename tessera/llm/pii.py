"""Format-preserving pseudonyms for personal data.

Main path: DataFrame functions only. Personal data is found by patterns and, where a format has a check,
validated (Luhn for card numbers, ranges for addresses, months and days for dates). Each find is replaced
by a keyed permutation of itself within its format: a balanced Feistel network over the digits, with
rounds keyed by SHA-256, so equal values have equal pseudonyms in every document, different values have
different ones, and a card number's pseudonym passes Luhn again. A number keeps its shape, and equal
phones or days have equal pseudonyms in different shapes. Names in mail addresses and the
characters of secrets, which have no number to permute, get keyed hashes in the same shape (96 bits for a
name). Whoever has the key can undo the permutations, so it is the caller's, and has no default; it is
part of the query's plan, so event logs are as secret as it is.

Of the Feistel network over [0, a*b): (l, r) -> (r, (l + F(r)) mod size); with a = b every round is a
bijection. Numbers whose range isn't a square (days, addresses' octets) are permuted by walking the cycle
until the value lies in the range again.

Cards: 13, 14, 15, 16 and 19 digits that pass Luhn, whatever the issuer, in one run or in the usual groups.
Phones: with '+' and country code, ten digits in groups of 3, 3 and 4, or grouped with a leading 0. Dates:
days of 1900 to 2099 in numbers, year first or last, with '-', '/' or '.'; of day and month the month comes
first, but after '.' the day, unless only the other reading is a date. Not found: phones without '+' or
groups, cards of 12, 17 or 18 digits, dates with names of months or years of two digits. All days in such
shapes are moved, whatever they date. Account numbers: IBANs with right check digits, in one run or groups of
four; country and letters stay, digits are permuted, the check is right again. Addresses: IPv4, and IPv6 with
a digit in it, full or with '::', whose pseudonym is spelled in full. Secrets: 32 to 64 hexadecimal digits,
and keys that begin as those of well-known services do. Very long texts are treated whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 6
# fixed patterns; a find is never part of a longer run of digits
CARD = r"(?<![\d])\d{4}(?:[ -]?\d{4}){3}(?![\d])"
CARD_MORE = r"(?<!\d)(?:\d{4}(?:[ -]\d{4}){3}[ -]\d{3}|\d{6}[ -]\d{13}|\d{4}[ -]\d{6}[ -]\d{4,5}|\d{4}(?:[ -]\d{3}){3}|\d{13,15}|\d{19})(?!\d)"
PHONE = r"\+\d{1,3} ?\(\d{3}\) ?\d{3}-\d{4}(?!\d)"
ADDRESS = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"
SOCIAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
DATE = r"(?<![\d-])(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?![\d-])"
_DAY, _YEAR = r"(?:0?[1-9]|[12]\d|3[01])", r"(?:19|20)\d\d"
DATE_MORE = r"(?<!\d)(?<!\d[/.\-])(?:" + "|".join(f"{_DAY}{s}{_DAY}{s}{_YEAR}|{_YEAR}{s}{_DAY}{s}{_DAY}" for s in ("/", r"\.", "-")) + r")(?!\d|[/.\-]\d)"
PHONE_MORE = "|".join((
    r"(?<![\w+])\+1[ .\-]?(?:\(\d{3}\) ?|\d{3}[ .\-]?)\d{3}[ .\-]?\d{4}(?!\d)",
    r"(?<![\w+])\+[1-9](?:[ .\-/]?\(?\d\)?){7,14}(?!\d)",
    r"(?<![\d+])(?<!\d[.\-])(?:1[ .\-])?(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?!\d|-\d)",
    r"(?<![\d+])(?<!\d[.\-/])(?:\(0\d{1,4}\) ?|0\d{1,4}[ \-/])(?:\d{3}[ \-]\d{3}[ \-]\d{3,4}|\d{3,4}[ \-]\d{3,4}|\d{6,8})(?!\d|[/.\-]\d)",
    r"(?<![\d+])(?<!\d[.\-/])0\d(?:[ .\-]\d\d){4}(?!\d|[/.\-]\d)",
))
# country codes of one and two digits; all others have three
COUNTRY = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
MAIL = r"(?<![A-Za-z0-9._%+\-À-ɏ])[A-Za-z0-9._%+\-À-ɏ]++@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){1,8}"
SECRET = r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,64}(?![0-9A-Za-z])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2} ?[A-Z0-9]{4}(?: ?(?=[A-Z]{0,3}\d)[A-Z0-9]{4}){1,7}(?: ?(?=[A-Z]{0,2}\d)[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
ADDRESS6 = r"(?<![0-9A-Za-z:.])(?=[a-fA-F:]*\d)[0-9a-fA-F]{0,4}(?:::?[0-9a-fA-F]{1,4}){1,7}(?:::)?(?![0-9A-Za-z:]|\.\d)"
VENDOR_FRONT = r"(?:A[KS]IA|gh[pousr]_|AIza|xox[abprs]-|[sr]k_(?:live|test)_|sk-)"
VENDOR = r"(?<![0-9A-Za-z_\-])(?:A[KS]IA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|AIza[0-9A-Za-z_\-]{35}|xox[abprs]-[0-9A-Za-z\-]{10,72}|[sr]k_(?:live|test)_[0-9A-Za-z]{16,64}|sk-[0-9A-Za-z_\-]{20,64})(?![0-9A-Za-z_\-])"
ANY = "|".join((MAIL, VENDOR, IBAN, SECRET, CARD_MORE, CARD, PHONE, ADDRESS, ADDRESS6, SOCIAL, DATE, DATE_MORE, PHONE_MORE))
HINT = "[0-9@]|AIza|A[KS]IA|xox|gh[pousr]_|sk-|[sr]k_"


def keyed(key: str, *parts: Column) -> Column:
    """A number below 2**60 from SHA-256 of the key and the parts."""
    text = F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def feistel(number: Column, half: int | Column, key: str, tweak: str | Column) -> Column:
    """A keyed permutation of [0, half * half)."""
    half = F.lit(half)
    start = F.struct(F.call_function("div", number, half).cast("long").alias("l"), (number % half).cast("long").alias("r"))
    rounds = F.array(*[F.lit(k) for k in range(ROUNDS)])
    end = F.aggregate(
        rounds, start,
        lambda s, k: F.struct(s["r"].alias("l"), F.pmod(s["l"] + keyed(key, F.lit(tweak), k, s["r"]), half).cast("long").alias("r")),
    )
    return _of(end, lambda e: e["l"] * half + e["r"])


def _of(value: Column, what) -> Column:
    """what(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), what), 1)


def walk(
    number: Column, size: int | Column, half: int | Column, key: str, tweak: str | Column, steps: int = 48, among: Callable[[Column], Column] | None = None,
) -> Column:
    """A keyed permutation of [0, size): apply ``feistel`` again until below ``size``.

    With ``among``, a condition that holds for ``number``, a permutation of the numbers for which it holds. After ``steps`` the number itself would be kept; with size over 0.7 of half**2 the chance is below
    0.3**steps.
    """
    done = lambda n: n < size if among is None else (n < size) & among(n)
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)), feistel(number, half, key, tweak),
        lambda n, _: F.when(done(n), n).otherwise(feistel(n, half, key, tweak)),
    )


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def permuted(d: Column, key: str, tweak: Column) -> Column:
    """Up to 18 digits permuted among those of their length."""
    n = F.length(d)
    pick = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), n)
    sizes = [10**k for k in range(1, 19)]
    halves = [math.isqrt(size - 1) + 1 for size in sizes]
    each = F.struct(d.cast("long").alias("d"), n.alias("n"), pick(sizes).alias("size"), pick(halves).alias("half"))
    return _of(each, lambda s: F.lpad(walk(s["d"], s["size"], s["half"], key, tweak).cast("string"), s["n"], F.lit("0")))


def luhn_sum(d: Column, places: int = 16) -> Column:
    """Luhn's sum of 16 digits, or another even number: those at even places from the left are doubled."""
    total = F.lit(0)
    for k in range(places):
        n = F.substring(d, k + 1, 1).cast("int")
        total = total + (n if k % 2 else F.when(n > 4, n * 2 - 9).otherwise(n * 2))
    return total


def refill(shape: Column, new_digits: Column) -> Column:
    """``shape`` with its digits replaced in order by ``new_digits``."""
    chars = F.split(shape, "")
    start = F.struct(F.lit("").alias("t"), F.lit(1).alias("k"))
    end = F.aggregate(
        chars, start,
        lambda s, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(s["t"], F.substring(new_digits, s["k"], F.lit(1))).alias("t"), (s["k"] + 1).alias("k")))
        .otherwise(F.struct(F.concat(s["t"], c).alias("t"), s["k"].alias("k"))),
    )
    return end["t"]


def luhn_any(d: Column) -> Column:
    """Luhn's sum of at most 20 digits."""
    return luhn_sum(F.lpad(d, 20, "0"), 20)


def grouped_16(found: Column) -> Column:
    """A find of 19 digits in groups is a card of 16 and another number."""
    return F.length(found).eqNullSafe(23) & (luhn_any(digits(found)) % 10 != 0)


def new_card(found: Column, key: str) -> Column:
    """Of 16 digits as ``new_card_16``; else all but the last permuted, the last so that Luhn holds."""
    bare = after_word(found)  # what looks like an account number may be a word before a card
    return F.concat(F.regexp_extract(found, WORD, 0), _of(bare, lambda c: _new_card(c, key)))


def _new_card(found: Column, key: str) -> Column:
    d = digits(found)
    body = permuted(F.left(d, F.length(d) - 1), key, F.concat(F.lit("card"), F.length(d).cast("string")))
    full = _of(body, lambda b: F.concat(b, ((10 - luhn_any(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
    return (
        F.when(F.length(d) == 16, new_card_16(found, key))
        .when(grouped_16(found), F.concat(new_card_16(F.substring(found, 1, 19), key), F.substring(found, 20, 4)))
        .otherwise(refill(found, full))
    )


def new_card_16(found: Column, key: str) -> Column:
    """The first 14 digits permuted, the 15th shifted by a keyed digit, the 16th so that Luhn holds."""
    d = digits(found)
    head = F.lpad(feistel(F.substring(d, 1, 14).cast("long"), 10**7, key, "card").cast("string"), 14, "0")
    fifteen = _of(head, lambda h: F.concat(h, ((F.substring(d, 15, 1).cast("int") + keyed(key, F.lit("card15"), h)) % 10).cast("string")))
    full = _of(fifteen, lambda f: F.concat(f, ((10 - luhn_sum(F.concat(f, F.lit("0"))) % 10) % 10).cast("string")))
    return refill(found, full)


def new_phone(found: Column, key: str) -> Column:
    """Country code, or 0 or 1 in front of a national number, kept; the other digits permuted."""
    d = digits(found)
    front = F.when(F.startswith(found, F.lit("+")), F.regexp_extract(d, COUNTRY, 0)).when(F.startswith(d, F.lit("0")) | (F.length(d) == 11), F.left(d, F.lit(1))).otherwise("")
    more = _of(front, lambda c: _of(
        F.substring(d, F.length(c) + 1, F.length(d)),
        lambda rest: F.concat(c, permuted(rest, key, F.when(F.length(rest) == 10, "phone").otherwise(F.concat(F.lit("phone"), F.length(rest).cast("string"))))),
    ))
    return F.when(found.rlike(f"^(?:{PHONE})$"), new_phone_10(found, key)).otherwise(refill(found, more))


def new_phone_10(found: Column, key: str) -> Column:
    """Country code kept; the ten digits permuted."""
    d = digits(found)
    size = F.length(d)
    ten = F.lpad(feistel(F.substring(d, size - 9, F.lit(10)).cast("long"), 10**5, key, "phone").cast("string"), 10, "0")
    return refill(found, F.concat(F.substring(d, F.lit(1), size - 10), ten))


def new_address(found: Column, key: str) -> Column:
    """The four octets as one 32-bit number, permuted."""
    octets = F.split(found, r"\.")
    number = sum((octets[k].cast("long") * 256 ** (3 - k) for k in range(4)), F.lit(0).cast("long"))
    return _of(feistel(number, 2**16, key, "address"), lambda n: F.concat_ws(".", *[F.pmod(F.floor(n / 256**k), F.lit(256)).cast("string") for k in (3, 2, 1, 0)]))


def new_social(found: Column, key: str) -> Column:
    """Nine digits, permuted by cycle walking below 10**9."""
    return refill(found, F.lpad(walk(digits(found).cast("long"), 10**9, 31623, key, "social").cast("string"), 9, "0"))


def readings(found: Column) -> Column:
    """struct(first, second): the date of a find as usual and, where the year is last, with day and month swapped."""
    p = F.split(found, r"[/.\-]")
    day = lambda y, m, d: F.try_to_date(F.concat_ws("-", F.get(p, F.lit(y)), F.lpad(F.get(p, F.lit(m)), 2, "0"), F.lpad(F.get(p, F.lit(d)), 2, "0")), "yyyy-MM-dd")
    year_first, dots = found.rlike("^[0-9]{4}"), F.contains(found, F.lit("."))
    first = F.when(year_first, day(0, 1, 2)).when(dots, day(2, 1, 0)).otherwise(day(2, 0, 1))
    return F.struct(first.alias("first"), F.when(~year_first, F.when(dots, day(2, 0, 1)).otherwise(day(2, 1, 0))).alias("second"))


def new_date(found: Column, key: str) -> Column:
    """A day of 1900 to 2099, permuted by cycle walking among its 73,049 days.

    Dates that have only the second reading are permuted among the days after a month's 12th, which are those.
    """
    zero = F.lit("1900-01-01").cast("date")
    at = lambda n: F.date_add(zero, n.cast("int"))
    number = lambda date: F.datediff(date, zero).cast("long")
    late = lambda n: F.dayofmonth(at(n)) > 12

    def spell(date: Column, swapped: Column) -> Column:
        short = found.rlike(r"(?<!\d)\d(?!\d)")
        y, mark = F.date_format(date, "yyyy"), F.regexp_extract(found, r"[/.\-]", 0)
        m = F.when(short, F.date_format(date, "M")).otherwise(F.date_format(date, "MM"))
        d = F.when(short, F.date_format(date, "d")).otherwise(F.date_format(date, "dd"))
        day_first = F.contains(found, F.lit(".")) != swapped
        return F.when(found.rlike("^[0-9]{4}"), F.concat(y, mark, m, mark, d)).when(day_first, F.concat(d, mark, m, mark, y)).otherwise(F.concat(m, mark, d, mark, y))

    def moved(r: Column) -> Column:
        swapped = r["first"].isNull()
        n = F.when(swapped, walk(number(r["second"]), 73049, 271, key, "date", among=late)).otherwise(walk(number(r["first"]), 73049, 271, key, "date"))
        return _of(F.struct(at(n).alias("date"), swapped.alias("swapped")), lambda s: spell(s["date"], s["swapped"]))

    return _of(readings(found), moved)


def new_mail(found: Column, key: str) -> Column:
    """A keyed name at a reserved domain."""
    return F.concat(F.lit("user"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("mail"), F.lower(found)), 256), 1, 24), F.lit("@example.invalid"))


def new_secret(found: Column, key: str) -> Column:
    """As many hexadecimal digits of a keyed hash, in the same case; what a service's keys begin with stays."""
    text = F.concat_ws("|", F.lit(key), F.lit("secret"), found)
    front = F.regexp_extract(found, f"^{VENDOR_FRONT}", 0)
    rest = _of(front, lambda f: F.concat(f, F.substring(F.sha2(text, 512), F.lit(1), F.length(found) - F.length(f))))
    h = F.when(F.length(front) > 0, rest).otherwise(F.substring(F.sha2(text, 256), F.lit(1), F.length(found)))
    return F.when((F.upper(found) == found) & (F.length(front).isin(0, 4)), F.upper(h)).otherwise(h)


def mod_97(text: Column) -> Column:
    """The remainder of an account number's digits and letters (A is 10), read as one number."""
    step = lambda r, c: F.when(c.rlike("^[0-9]$"), (r * 10 + c.cast("int")) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), step)


def is_iban(found: Column) -> Column:
    return _of(F.replace(found, F.lit(" "), F.lit("")), lambda bare: mod_97(F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.left(bare, F.lit(4)))) == 1)


def new_iban(found: Column, key: str) -> Column:
    """The account's first 18 digits permuted, those after them by a permutation that depends on the first; then the check."""
    bare = F.replace(found, F.lit(" "), F.lit(""))
    body = F.substring(bare, F.lit(5), F.length(bare))
    d = digits(body)
    tweak = lambda part, before: F.concat_ws("|", F.lit("iban"), F.length(part).cast("string"), before)
    moved = lambda part, before: F.when(F.length(part) > 0, permuted(part, key, tweak(part, before))).otherwise("")
    head = moved(F.left(d, F.lit(18)), F.lit(""))
    new = _of(head, lambda h: F.concat(h, moved(F.substring(d, F.lit(19), F.length(d)), h)))
    check = lambda n: F.lpad((98 - mod_97(F.concat(refill(body, n), F.left(bare, F.lit(2)), F.lit("00")))).cast("string"), 2, "0")
    return refill(found, _of(new, lambda n: F.concat(check(n), n)))


def groups_6(found: Column) -> Column:
    """The groups of an IPv6 address that are spelled, as struct(left, right) of the '::'."""
    part = lambda k: F.filter(F.split(F.substring_index(found, "::", k), ":"), lambda g: g != "")
    return F.struct(part(1).alias("left"), F.when(F.contains(found, F.lit("::")), part(-1)).otherwise(F.array().cast("array<string>")).alias("right"))


def is_address6(found: Column) -> Column:
    n = _of(groups_6(found), lambda g: F.size(g["left"]) + F.size(g["right"]))
    doubles = F.size(F.split(found, "::")) - 1
    return F.when(doubles == 0, n == 8).otherwise((doubles == 1) & (n < 8))


def new_address6(found: Column, key: str) -> Column:
    """128 bits, permuted by a Feistel network over two halves of 64, each as two numbers of 32."""
    spelled = _of(groups_6(found), lambda g: F.concat(g["left"], F.array_repeat(F.lit("0"), 8 - F.size(g["left"]) - F.size(g["right"])), g["right"]))
    hexes = F.array_join(F.transform(spelled, lambda g: F.lpad(g, 4, "0")), "")
    number = lambda text, at: F.conv(F.substring(text, at, 8), 16, 10).cast("long")
    start = _of(hexes, lambda h: F.struct(*[number(h, 8 * k + 1).alias(n) for k, n in enumerate(("l1", "l2", "r1", "r2"))]))

    def turn(s: Column, k: Column) -> Column:
        h = F.sha2(F.concat_ws("|", F.lit(key), F.lit("address6"), k.cast("string"), s["r1"].cast("string"), s["r2"].cast("string")), 256)
        return _of(h, lambda x: F.struct(s["r1"].alias("l1"), s["r2"].alias("l2"), s["l1"].bitwiseXOR(number(x, 1)).alias("r1"), s["l2"].bitwiseXOR(number(x, 9)).alias("r2")))

    end = F.aggregate(F.array(*[F.lit(k) for k in range(ROUNDS)]), start, turn)
    full = _of(end, lambda e: F.concat(*[F.lpad(F.lower(F.hex(e[n])), 8, "0") for n in ("l1", "l2", "r1", "r2")]))
    return _of(full, lambda t: F.concat_ws(":", *[F.substring(t, 4 * k + 1, 4) for k in range(8)]))


HEXES = "^[0-9a-fA-F]{32,64}$"
WORD = "^[A-Z]{2}[0-9]{2} ?"


def after_word(found: Column) -> Column:
    return F.regexp_replace(found, WORD, "")


def kind_of(found: Column) -> Column:
    """The kind of a find, or null where validation fails."""
    whole = lambda p: found.rlike(f"^(?:{p})$")
    return (
        F.when(F.contains(found, F.lit("@")), F.lit("mail"))
        .when(whole(VENDOR), F.lit("secret"))
        # an account number with a wrong check may be a word before a card
        .when(whole(IBAN), F.when(is_iban(found), F.lit("iban")).when(_of(after_word(found), lambda c: c.rlike(f"^(?:{CARD})$") & (luhn_sum(digits(c)) % 10 == 0)), F.lit("card")).when(found.rlike(HEXES), F.lit("secret")))
        .when(whole(ADDRESS6), F.when(is_address6(found), F.lit("address6")).otherwise(F.lit(None)))
        .when(whole(PHONE), F.lit("phone"))
        .when(whole(ADDRESS), F.lit("address"))
        .when(whole(CARD), F.when(luhn_sum(digits(found)) % 10 == 0, F.lit("card")).otherwise(F.lit(None)))
        .when(whole(SOCIAL), F.lit("social"))
        .when(whole(DATE) | whole(DATE_MORE), F.when(_of(readings(found), lambda r: F.coalesce(r["first"], r["second"])).isNotNull(), F.lit("date")).otherwise(F.lit(None)))
        .when(whole(CARD_MORE), F.when((luhn_any(digits(found)) % 10 == 0) | grouped_16(found) & (luhn_sum(F.left(digits(found), F.lit(16))) % 10 == 0), F.lit("card")).otherwise(F.lit(None)))
        .when(whole(PHONE_MORE), F.lit("phone"))
        .when(found.rlike("[0-9]") & found.rlike(HEXES), F.lit("secret"))
    )


NEW = {
    "mail": new_mail, "phone": new_phone, "address": new_address, "card": new_card, "social": new_social, "date": new_date, "secret": new_secret,
    "iban": new_iban, "address6": new_address6,
}


def pseudonym(found: Column, key: str) -> Column:
    """The pseudonym of a find; the find itself where validation fails."""

    def choose(kind: Column) -> Column:
        out = found
        for name, make in NEW.items():
            out = F.when(kind == name, make(found, key)).otherwise(out)
        return out

    return _of(F.struct(kind_of(found).alias("k")), lambda s: choose(s["k"]))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with its text replaced and ``__finds`` added: an array of struct(kind, value, pseudonym).

    key: a secret of the caller; equal values have equal pseudonyms under one key.

    Null text stays null, with no finds; so does a text without finds. Rows and other columns are kept;
    a column ``__finds`` of the input is replaced. Finds that fail validation stay as they are and aren't
    listed.
    """
    text = F.col(text_col)
    finds = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    found = docs.withColumn("__finds", finds)
    listed = F.transform("__finds", lambda f: F.struct(kind_of(f).alias("kind"), f.alias("value"), pseudonym(f, key).alias("pseudonym")))
    out = found.withColumn("__finds", listed)
    joined = F.array_join(
        F.zip_with(F.split(text, ANY, -1), F.transform("__finds", lambda f: f["pseudonym"]), lambda gap, new: F.concat(gap, F.coalesce(new, F.lit("")))), ""
    )
    out = out.withColumn(text_col, F.when(F.size("__finds") == 0, text).otherwise(joined))
    return out.withColumn("__finds", F.filter("__finds", lambda f: f["kind"].isNotNull()))
