"""Pseudonyms for personal data by keyed permutation within the format.

Values are found by pattern and validated (checksums, octet ranges, calendar
dates); each is replaced by its image under a keyed Feistel permutation of the
values of its format.  Equal values get equal pseudonyms in all documents,
different values different ones, and whoever has the key can invert them.

* Cards, telephone numbers and bank accounts: what is permuted is the bare number, which
  is then laid out as the original was; so spellings of one number stay linked.
* Payment cards: the digits between the first and the last are permuted; the check digit is computed anew.
* Bank accounts (IBAN): the country stays, the account is permuted, the check digits are computed anew.
* Telephone numbers: the country code stays; of an undivided number that is all before the last ten digits.
* US social security numbers: a permutation of the 898 * 99 * 9,999 numbers that may be issued.
* IPv4 addresses: a permutation of the 2^32 addresses.
* Dates: a permutation of the 146,097 days of 1700-2099, which is one whole cycle of the
  calendar; the layout and order of the parts stay.  The first twelve days of all months and the later ones are permuted
  apart, so a date that can only be read day first still can only be read so, and one date has one pseudonym in all layouts.
* Secrets: a word before one, or the known beginning of a key, stays.
* E-mail addresses: the part before the @ and the labels before the last two of the domain.
* Strings of digits and letters: each character moves within its class (digit,
  lower case, upper case) and everything else stays, so the layout is the same;
  hexadecimal strings stay hexadecimal.  Spellings in other case stay linked.

All of it is column expressions; a text without a match passes unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrybook.plans.names import own_names

ROUNDS = 6
#: First year and months of a whole Gregorian cycle, and its days after the twelfth of a month; fixed values.
FIRST_YEAR, MONTHS, LATE_DAYS = 1700, 4800, 88_497
#: The first twelve days of all months as a product, and the least larger product of near numbers for the later days.
EARLY_FACTORS, LATE_FACTORS = (240, 240), (297, 298)
#: Area and group, and serial, of the social security numbers that may be issued; the area 666 is not; fixed values.
SSN_FACTORS = (898 * 99, 9999)
#: Digits of a telephone number without its country code, where nothing divides them.
NATIONAL = 10

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: What follows one of these words and a sign is a secret.
_BEFORE_SECRET = r"(?:token|secret|password|passwd|api_key|apikey)\s{0,2}[=:]\s{0,2}[\"']?"
#: Keys that are known by how they begin, and the least that follows; fixed values.
_KEY_BEGINS = r"(?:AKIA|ASIA)(?=[0-9A-Z]{16}\b)|sk-(?=[A-Za-z0-9_-]{20})|gh[pousr]_(?=[A-Za-z0-9]{36})"
#: What is looked for, in order of precedence; each pattern stands for itself inside the joint pattern.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}",
    "secret": rf"\b(?:{_KEY_BEGINS})[A-Za-z0-9_-]++|{_BEFORE_SECRET}[A-Za-z0-9_/+=-]{{8,}}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)",
    "date": r"(?<![\d/.-])(?:(?:1[7-9]|20)\d\d(?:-\d\d-\d\d|/\d\d/\d\d)|\d\d(?:\.\d\d\.|/\d\d/|-\d\d-)(?:1[7-9]|20)\d\d)(?![\d/-]|\.\d)",
    "ssn": r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\d-])",
    "card": r"(?<!\d)[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\d)",
    "phone": r"(?<![\d.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|(?<=\+\d{1,3}[ .-])\d{2,4}[ .-]|\d{3}[.-])\d{3,4}[ .-]\d{4}(?!\d)|(?<![\d+])\+\d{11,15}(?!\d)",
}
#: The kinds that begin with a digit, a plus sign or a bracket are tried only there.
NUMBERS = ("ip", "date", "ssn", "card", "phone")
JOINT = "|".join([*(p for k, p in PATTERNS.items() if k not in NUMBERS), rf"(?=[\d+(])(?:{'|'.join(PATTERNS[k] for k in NUMBERS)})"])
#: Set around matches; a text that holds it already is searched twice instead.
MARK = "\x01"


def _draw(secret: str, label: str, *parts: Column) -> Column:
    """64 hexadecimal digits that only the key's holder can foretell."""
    return F.sha2(F.concat_ws("|", F.lit(f"{secret}|{label}"), *parts), 256)


def _number(digest: Column, place: Column | int) -> Column:
    """The 28-bit number at a place of a digest."""
    start = (place * 7) % 57 + 1 if isinstance(place, Column) else F.lit(place * 7 % 57 + 1)
    return F.conv(F.substr(digest, start.cast("int"), F.lit(7)), 16, 10).cast("long")


def _once(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _rounds(inverse: bool) -> Column:
    return F.array(*map(F.lit, range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)))


def _shift(character: Column, by: Column) -> Column:
    """Move a character within its class by ``by`` places."""
    code = F.ascii(character)

    def turned(first: int, size: int) -> Column:
        return F.char(F.lit(first) + F.pmod(code - first + by, F.lit(size)))

    return (
        F.when((code >= 48) & (code <= 57), turned(48, 10))
        .when((code >= 65) & (code <= 90), turned(65, 26))
        .when((code >= 97) & (code <= 122), turned(97, 26))
        .otherwise(character)
    )


def _shift_hex(character: Column, by: Column) -> Column:
    """The same among the sixteen lower-case hexadecimal digits."""
    return F.lower(F.conv(F.pmod(F.conv(character, 16, 10).cast("long") + by, F.lit(16)).cast("string"), 10, 16))


def permute_characters(value: Column, secret: str, label: str, shift=_shift, inverse: bool = False) -> Column:
    """A Feistel network on the two halves of the characters; the class of each character stays."""
    chars = F.split(value, "")
    half = F.floor(F.size(chars) / 2).cast("int")
    start = F.struct(F.slice(chars, 1, half).alias("a"), F.slice(chars, half + 1, F.size(chars) - half).alias("b"))
    sign = -1 if inverse else 1

    def turn(moving: Column, still: Column, step: Column) -> Column:
        digest = _draw(secret, label, step.cast("string"), F.size(moving).cast("string"), F.lower(F.array_join(still, "")))
        return F.transform(moving, lambda c, i: shift(c, sign * _number(F.sha2(F.concat(digest, F.floor(i / 8).cast("string")), 256), i % 8)))

    def step(acc: Column, k: Column) -> Column:
        even = k % 2 == 0
        moved = turn(F.when(even, acc["a"]).otherwise(acc["b"]), F.when(even, acc["b"]).otherwise(acc["a"]), k)
        return F.struct(F.when(even, moved).otherwise(acc["a"]).alias("a"), F.when(even, acc["b"]).otherwise(moved).alias("b"))

    done = F.aggregate(_rounds(inverse), start, step)
    return F.when(value == "", value).otherwise(F.concat(F.array_join(done["a"], ""), F.array_join(done["b"], "")))


def _permute_pair(a: Column, b: Column, size_a: int, size_b: int, secret: str, label: str, inverse: bool) -> Column:
    """A permutation of the pairs below (size_a, size_b); struct<a, b>."""
    sign = -1 if inverse else 1

    def step(acc: Column, k: Column) -> Column:
        even = k % 2 == 0
        other = F.when(even, acc["b"]).otherwise(acc["a"])
        drawn = sign * _number(_draw(secret, label, k.cast("string"), other.cast("string")), 0)
        return F.struct(F.when(even, F.pmod(acc["a"] + drawn, F.lit(size_a))).otherwise(acc["a"]).alias("a"), F.when(even, acc["b"]).otherwise(F.pmod(acc["b"] + drawn, F.lit(size_b))).alias("b"))

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(_rounds(inverse), start, step)


def _laid_out(value: Column, kept: str, bare: Column) -> Column:
    """The characters of ``bare`` in the places of ``value`` whose characters are in the class ``kept``."""
    place = lambda i: F.length(F.regexp_replace(F.substr(value, F.lit(1), i + 1), f"[^{kept}]", ""))
    return F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike(f"[{kept}]"), F.substr(bare, place(i), F.lit(1))).otherwise(c)), "")


def pseudonym_ip(value: Column, secret: str, inverse: bool = False) -> Column:
    octets = F.split(value, r"\.")

    def pair(k: int) -> Column:
        return octets[k].cast("long") * 256 + octets[k + 1].cast("long")

    def dotted(done: Column) -> Column:
        return F.concat_ws(".", *[F.floor(done[side] / by).cast("long").bitwiseAND(F.lit(255)).cast("string") for side in ("a", "b") for by in (256, 1)])

    return _once(_permute_pair(pair(0), pair(2), 1 << 16, 1 << 16, secret, "ip", inverse), dotted)


def pseudonym_ssn(value: Column, secret: str, inverse: bool = False) -> Column:
    area, group, serial = (F.substring(value, start, n).cast("long") for start, n in ((1, 3), (5, 2), (8, 4)))
    place = (area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1

    def written(done: Column) -> Column:
        area = F.floor(done["a"] / 99) + 1
        area = area + F.when(area >= 666, 1).otherwise(0)
        return F.format_string("%03d-%02d-%04d", area, done["a"] % 99 + 1, done["b"] + 1)

    return _once(_permute_pair(place, serial - 1, *SSN_FACTORS, secret, "ssn", inverse), written)


def _date_parts(value: Column) -> tuple[Column, Column, Column]:
    """(yyyy-mm-dd or null, whether the year leads, whether the month leads the day)."""
    year_first = F.substring(value, 5, 1).isin("-", "/")
    one, two = F.substring(value, 1, 2), F.substring(value, 4, 2)
    # 13/01/2020 can only be day first; with slashes the month leads where both readings are dates
    month_first = F.substring(value, 3, 1).isin("/", "-") & (one <= "12") & (two <= "31")
    iso = (
        F.when(year_first, F.concat_ws("-", F.substring(value, 1, 4), F.substring(value, 6, 2), F.substring(value, 9, 2)))
        .when(month_first, F.concat_ws("-", F.substring(value, 7, 4), one, two))
        .otherwise(F.concat_ws("-", F.substring(value, 7, 4), two, one))
    )
    return iso, year_first, month_first


def _late_before(month: Column) -> Column:
    """How many days after the twelfth lie before a month of the cycle, counted from 0."""
    return F.datediff(F.make_date(F.floor(month / 12).cast("int") + FIRST_YEAR, F.pmod(month, F.lit(12)).cast("int") + 1, F.lit(1)), F.lit(f"{FIRST_YEAR}-01-01").cast("date")) - 12 * month


def _permute_late(place: Column, secret: str, inverse: bool) -> Column:
    """A permutation of the numbers below ``LATE_DAYS``: that of the larger product, followed on while it leaves them."""
    a, b = LATE_FACTORS

    def follow(at: Column, k: Column) -> Column:
        moved = _once(_permute_pair(F.floor(at / b), at % b, a, b, secret, "late", inverse), lambda done: done["a"] * b + done["b"])
        return F.when((k > 0) & (at < LATE_DAYS), at).otherwise(moved)

    # a walk meets each of the places outside at most once
    return F.aggregate(F.sequence(F.lit(0), F.lit(a * b - LATE_DAYS)), place.cast("long"), follow)


def pseudonym_date(value: Column, secret: str, inverse: bool = False) -> Column:
    """A calendar date in the same layout; null if the value is no date."""
    iso, year_first, month_first = _date_parts(value)
    date = F.try_to_date(iso, "yyyy-MM-dd")
    month, day = ((F.year(date) - FIRST_YEAR) * 12 + F.month(date) - 1).cast("long"), F.dayofmonth(date)
    mark = F.when(year_first, F.substring(value, 5, 1)).otherwise(F.substring(value, 3, 1))
    rows, columns = EARLY_FACTORS

    def early(done: Column) -> Column:
        return _once(done["a"] * columns + done["b"], lambda place: F.struct(F.floor(place / 12).alias("month"), (place % 12 + 1).alias("day")))

    def late(place: Column) -> Column:
        # months have about equally many late days, so the month is the estimated one or one beside it
        near = F.floor(place * MONTHS / LATE_DAYS)
        month = F.array_max(F.filter(F.sequence(near - 1, near + 1), lambda m: _late_before(m) <= place))
        return _once(month, lambda m: F.struct(m.alias("month"), (place - _late_before(m) + 13).alias("day")))

    def laid_out(new: Column) -> Column:
        y, m, d = F.format_string("%04d", F.floor(new["month"] / 12) + FIRST_YEAR), F.format_string("%02d", new["month"] % 12 + 1), F.format_string("%02d", new["day"])
        return F.when(year_first, F.concat_ws("", y, mark, m, mark, d)).when(month_first, F.concat_ws("", m, mark, d, mark, y)).otherwise(F.concat_ws("", d, mark, m, mark, y))

    number = month * 12 + day - 1
    moved = F.when(day <= 12, _once(_permute_pair(F.floor(number / columns), number % columns, rows, columns, secret, "early", inverse), early))
    moved = moved.otherwise(_once(_permute_late(_late_before(month) + day - 13, secret, inverse), late))
    return F.when(date.isNotNull(), _once(moved, laid_out))


def pseudonym_card(value: Column, secret: str, inverse: bool = False) -> Column:
    """The first digit, the permuted ones, then the check digit that makes the number valid; null if the value is not."""
    digits = F.regexp_replace(value, "[ -]", "")
    valid = F.call_function("luhn_check", digits) & F.length(digits).between(13, 19)

    def checked(body: Column) -> Column:
        tries = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(body, d.cast("string")))
        return F.element_at(F.filter(tries, lambda n: F.call_function("luhn_check", n)), 1)

    inner = permute_characters(F.substr(digits, F.lit(2), F.length(digits) - 2), secret, "card", inverse=inverse)
    new = _once(F.concat(F.substring(digits, 1, 1), inner), checked)
    return F.when(valid, _once(new, lambda n: _laid_out(value, "0-9", n)))


def _mod_97(text: Column) -> Column:
    """Letters count as 10 to 35."""

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c).cast("long")
        return F.when(code < 65, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0).cast("long"), step)


def pseudonym_iban(value: Column, secret: str, inverse: bool = False) -> Column:
    """Null if the check digits are wrong."""
    bare = F.replace(value, F.lit(" "), F.lit(""))
    country, account = F.substring(bare, 1, 2), F.substr(bare, F.lit(5))
    valid = F.length(bare).between(15, 34) & (_mod_97(F.concat(account, F.substring(bare, 1, 4))) == 1)

    def checked(new: Column) -> Column:
        return F.concat(country, F.format_string("%02d", 98 - _mod_97(F.concat(new, country, F.lit("00")))), new)

    new = _once(permute_characters(account, secret, "iban", inverse=inverse), checked)
    return F.when(valid, _once(new, lambda n: _laid_out(value, "0-9A-Z", n)))


def pseudonym_email(value: Column, secret: str, inverse: bool = False) -> Column:
    name, host = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    site = F.substring_index(host, ".", -2)
    labels = F.substr(host, F.lit(1), F.length(host) - F.length(site))
    return F.concat(permute_characters(F.concat(name, F.lit("@"), labels), secret, "email", inverse=inverse), site)


def pseudonym_phone(value: Column, secret: str, inverse: bool = False) -> Column:
    """The country code stays."""
    undivided = value.rlike(r"^\+\d+$")
    code = F.when(undivided, F.substr(value, F.lit(1), F.length(value) - NATIONAL)).otherwise(F.regexp_extract(value, r"^\+\d{1,3}?(?=[ .(-]|\d{3}[.-])", 0))
    rest = F.substr(value, F.length(code) + 1)
    digits = permute_characters(F.regexp_replace(rest, "[^0-9]", ""), secret, "phone", inverse=inverse)
    return F.concat(code, _once(digits, lambda d: _laid_out(rest, "0-9", d)))


def pseudonym_secret(value: Column, secret: str, inverse: bool = False) -> Column:
    """The word before it stays, or the known beginning of a key."""
    before = F.regexp_extract(value, f"^(?:{_BEFORE_SECRET}|{_KEY_BEGINS})", 0)
    bare = F.substr(value, F.length(before) + 1)
    moved = F.when(bare.rlike("^[0-9a-f]+$"), permute_characters(bare, secret, "hex", _shift_hex, inverse)).otherwise(permute_characters(bare, secret, "string", inverse=inverse))
    return F.concat(before, moved)


_PSEUDONYMS = {"email": pseudonym_email, "iban": pseudonym_iban, "ip": pseudonym_ip, "date": pseudonym_date, "ssn": pseudonym_ssn, "card": pseudonym_card, "phone": pseudonym_phone, "secret": pseudonym_secret}


def _kind(match: Column) -> Column:
    kind = F.when(match.rlike(f"^(?:{PATTERNS['email']})$"), F.lit("email"))
    for name in ("iban", *NUMBERS):
        kind = kind.when(match.rlike(f"^(?:{PATTERNS[name]})$"), F.lit(name))
    return kind.otherwise(F.lit("secret"))


def _replaced(match: Column, kind: Column, secret: str, inverse: bool) -> Column:
    """The pseudonym; null where the value is not valid and stays."""
    return F.coalesce(*[F.when(kind == name, pseudonym(match, secret, inverse)) for name, pseudonym in _PSEUDONYMS.items()])


def pseudonymise(docs: DataFrame, secret: str, text_col: str = "text", out_col: str = "text", kinds_col: str = "kinds", inverse: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``out_col`` and the kinds of the replaced values, in order, in ``kinds_col``.

    Null and empty texts stay as they are, with no kinds.  Values that match a
    pattern but are not valid stay.  Whole texts are read; nothing is shuffled.  Columns
    of the names ``out_col`` and ``kinds_col`` are replaced, all others stay.  ``inverse``
    gives the original values of pseudonyms back to the holder of the same secret.
    """
    text = F.col(text_col)
    pieces_col, done_col = own_names(docs, "pieces", "done")
    marked = F.split(F.regexp_replace(text, f"(?:{JOINT})", f"{MARK}$0{MARK}"), MARK)
    twice = F.flatten(F.zip_with(F.split(text, JOINT), F.regexp_extract_all(text, F.lit(JOINT), F.lit(0)), lambda rest, m: F.when(m.isNull(), F.array(rest)).otherwise(F.array(rest, m))))
    # text and matches in turn; the matches have odd places
    pieces = F.when(text.rlike(r"\d|@|[=:]|sk-|gh[pousr]_"), F.when(text.contains(MARK), twice).otherwise(marked))
    found = docs.withColumn(pieces_col, pieces)
    some = F.coalesce(F.size(pieces_col) > 1, F.lit(False))
    matches = F.transform(F.filter(pieces_col, lambda p, i: i % 2 == 1), lambda m: F.struct(m.alias("old"), _kind(m).alias("kind")))
    done = F.transform(matches, lambda v: v.withField("new", _replaced(v["old"], v["kind"], secret, inverse)))
    found = found.withColumn(done_col, F.when(some, done))
    new_at = lambda i: F.coalesce(F.get(done_col, (i / 2).cast("int"))["new"], F.get(done_col, (i / 2).cast("int"))["old"])
    joined = F.array_join(F.transform(pieces_col, lambda p, i: F.when(i % 2 == 1, new_at(i)).otherwise(p)), "")
    kinds = F.coalesce(F.transform(F.filter(done_col, lambda v: v["new"].isNotNull()), lambda v: v["kind"]), F.array().cast("array<string>"))
    return found.withColumns({out_col: F.when(some, joined).otherwise(text), kinds_col: kinds}).drop(pieces_col, done_col)
