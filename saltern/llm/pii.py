"""Personal data replaced by format-preserving pseudonyms, with DataFrame expressions only.

Numbers that pass their validation, and dates that exist, are permuted by a keyed Feistel network within their format:
every pseudonym is valid in turn, and equal values get equal pseudonyms in all documents. What has no numeric format
(addresses of mail, hexadecimal secrets) gets a keyed digest of the same kind of characters.

| kind | validated by | kept |
| --- | --- | --- |
| card | 13 to 19 digits, unbroken or in groups of four or 4-6-5 or 4-6-4, Luhn sum | separators, length, a valid check digit |
| iban | two letters, two digits and 11 to 30 more characters, unbroken or in groups of four, rest 1 by 97 | country, letters, groups, valid check digits |
| phone | + with a country code and 8 to 15 digits in any groups of two to four, or ten digits in groups | code, separators |
| ssn | no excluded area, group or serial | hyphens |
| ip | four numbers up to 255 | a valid address |
| date | exists, from 1900-01-01 on for 73,000 days (to 2099); year first, or the day first unless only the month can be | order, separators, and whether one digit may do |
| email | address form | address form |
| secret | 32 to 64 hexadecimal digits with a digit and a letter | length and case |

In a run of groups of digits the longest part of whole groups with a Luhn sum is the card, from the left, so digits beside
a card don't hide it, and a date after a card is no part of it. Groups are parted by a space (also one that doesn't break), a hyphen or a dot.

Edge cases: a null text stays null; texts without personal data stay as they are; repeated rows give equal rows; null ids
stay; an empty table gives no rows. ``mask`` keeps all columns but the text as they are, and
fails on a table that has a column ``_pii``, which it adds; ``masked_documents`` takes columns of any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A parameter: production runs pass their own secret.
DEFAULT_KEY = "saltern"
ROUNDS = 8
#: Days of the permuted range of dates and its two factors; the Feistel network works on their product.
FIRST_DAY, DAY_LEFT, DAY_RIGHT = "1900-01-01", 250, 292

#: What may stand between the groups of a number.
GAP = r"[ .\u00A0\u202F-]"
_DATE = r"(?:(?:19|20)[0-9]{2}(?:-[0-9]{2}-|/[0-9]{2}/)[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./](?:19|20)[0-9]{2})(?![0-9])"
#: Patterns of each kind, tried in this order at each place. A match must pass its validation to be replaced.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "secret": r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,64}(?![0-9A-Za-z])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:[ \u00A0\u202F-][A-Z0-9]{4}){2,7}(?:[ \u00A0\u202F-][A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "date": rf"(?<![0-9/.-]){_DATE}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    # not where a card follows the code
    "phone": rf"(?<![0-9+])(?!\+[0-9]{{1,3}}(?:{GAP}[0-9]{{4}}){{3}}{GAP}[0-9])(?:\+[0-9]{{1,3}}{GAP}?\(?[0-9]{{3}}\)?{GAP}?[0-9]{{3}}{GAP}?[0-9]{{4}}(?![0-9])|\+[1-9][0-9]{{7,14}}(?![0-9])|\+[1-9][0-9]{{0,2}}(?:{GAP}[0-9]{{2,4}}|{GAP}\([0-9]{{2,4}}\)|{GAP}[0-9](?={GAP}[0-9]{{2}})){{2,5}}(?![0-9]))|\([0-9]{{3}}\) ?[0-9]{{3}}-[0-9]{{4}}(?![0-9])|(?<![0-9-])[0-9]{{3}}-[0-9]{{3}}-[0-9]{{4}}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": rf"(?<![0-9])(?:[0-9]{{13,19}}|[0-9]{{4}}{GAP}[0-9]{{6}}{GAP}[0-9]{{4,5}}|[0-9]{{4}}(?:{GAP}(?!{_DATE})[0-9]{{4}}){{3,99}}(?:{GAP}(?!{_DATE})[0-9]{{1,3}})?)(?![0-9])",
}
#: Country codes of one and of two digits; all others have three.
CODES = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _noise(key: str, tweak: str, i: Column, x: Column) -> Column:
    """A keyed number below 2**60 for round ``i`` and half ``x``."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(key), F.lit(tweak), i.cast("string"), x.cast("string"))), 1, 15), 16, 10).cast("long")


def feistel(u: Column, v: Column, left: Column, right: Column, key: str, tweak: str) -> Column:
    """A keyed permutation of pairs (u below ``left``, v below ``right``), as a struct (u, v)."""

    def step(acc: Column, i: Column) -> Column:
        size = F.when(i % 2 == 0, left).otherwise(right)
        return F.struct(acc["v"].alias("u"), F.pmod(acc["u"] + F.pmod(_noise(key, tweak, i, acc["v"]), size), size).alias("v"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(u.cast("long").alias("u"), v.cast("long").alias("v")), step)


def permute_digits(digits: Column, key: str, tweak: str) -> Column:
    """The digits, at least two and at most 30, keyed-permuted among all digit strings of their length."""
    n = F.length(digits)
    a = F.floor(n / 2).cast("int")
    power = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    out = feistel(F.substr(digits, F.lit(1), a), F.substr(digits, a + 1), power(a), power(n - a), key, f"digits-{tweak}")
    return F.concat(F.lpad(out["u"].cast("string"), a, "0"), F.lpad(out["v"].cast("string"), n - a, "0"))



def luhn_sum(digits: Column) -> Column:
    """The Luhn sum with the last digit undoubled."""
    d = F.transform(F.reverse(F.split(digits, "")), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(F.floor(x.cast("int") / 5) + 2 * (x.cast("int") % 5)).cast("int"))
    return F.aggregate(d, F.lit(0), lambda s, x: s + x)


def _only_digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _refill(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced, in order, by ``digits``."""
    parts = F.split(m, "[0-9]", -1)  # what stands before, between and after the digits
    return F.array_join(F.zip_with(parts, F.split(F.concat(digits, F.lit(" ")), ""), lambda p, d: F.concat(F.coalesce(p, F.lit("")), F.when(d == " ", "").otherwise(F.coalesce(d, F.lit(""))))), "")


def _groups(m: Column) -> Column:
    """The groups of digits, each with the separator before it."""
    return F.regexp_extract_all(m, F.lit(f"{GAP}?[0-9]+"), F.lit(0))


def _card_ends(groups: Column, i: Column) -> Column:
    """The lengths, in groups, of the cards that start with group ``i``, ascending."""
    part = lambda n: _only_digits(F.array_join(F.slice(groups, i + 1, n), ""))
    good = lambda n: F.length(part(n)).between(13, 19) & (luhn_sum(part(n)) % 10 == 0)
    return F.filter(F.sequence(F.lit(1), F.least(F.lit(5), F.size(groups) - i)), good)


def _account(m: Column) -> Column:
    """What looks like the country and check digits of an account number, in front of a match that is none."""
    return F.regexp_extract(m, "^[A-Z]{2}[0-9]{2}", 0)


def _has_card(m: Column) -> Column:
    groups = _groups(F.substr(m, F.length(_account(m)) + 1))
    return F.exists(F.sequence(F.lit(0), F.size(groups) - 1), lambda i: F.size(_card_ends(groups, i)) > 0)


def _cards(m: Column, key: str) -> Column:
    """``m`` with its cards permuted: from the left, the longest card that starts at each group."""
    groups = _groups(F.substr(m, F.length(_account(m)) + 1))

    def step(acc: Column, i: Column) -> Column:
        n = F.coalesce(F.try_element_at(_card_ends(groups, i), F.lit(-1)), F.lit(0))
        new = F.when(n > 0, _card(F.array_join(F.slice(groups, i + 1, n), ""), key)).otherwise(F.get(groups, i))
        skip = i < acc["next"]
        return F.struct(F.when(skip, acc["next"]).otherwise(i + F.greatest(n, F.lit(1))).alias("next"), F.when(skip, acc["out"]).otherwise(F.concat(acc["out"], new)).alias("out"))

    start = F.struct(F.lit(0).alias("next"), _account(m).alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.size(groups) - 1), start, step, lambda acc: acc["out"])


def _card(m: Column, key: str) -> Column:
    digits = _only_digits(m)
    body = permute_digits(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card")
    check = F.pmod(F.lit(10) - luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10))
    return _refill(m, F.concat(body, check.cast("string")))


def _plain(m: Column) -> Column:
    return F.regexp_replace(m, "[^A-Z0-9]", "")


def rest_by_97(account: Column) -> Column:
    """The rest by 97 of an account number (without gaps): its first four characters go last, letters count from 10."""
    turned = F.split(F.concat(F.substr(account, F.lit(5)), F.substring(account, 1, 4)), "")
    value = lambda c: F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    return F.aggregate(turned, F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(F.ascii(c) >= 65, 100).otherwise(10) + value(c)) % 97))


def _iban(m: Column, key: str) -> Column:
    """Digits behind the check digits are permuted in their places; letters stay."""
    plain = _plain(m)
    tail = F.substr(plain, F.lit(5))
    digits = _only_digits(tail)
    new = _refill(tail, F.when(F.length(digits) > 1, permute_digits(digits, key, "iban")).otherwise(digits))
    check = F.lpad((98 - rest_by_97(F.concat(F.substring(plain, 1, 2), F.lit("00"), new))).cast("string"), 2, "0")
    filled = F.split(F.concat(F.substring(plain, 1, 2), check, new), "")
    gaps = F.split(m, "[A-Z0-9]", -1)  # what stands before, between and after the characters
    return F.array_join(F.zip_with(gaps, filled, lambda g, c: F.concat(F.coalesce(g, F.lit("")), F.coalesce(c, F.lit("")))), "")


def _phone(m: Column, key: str) -> Column:
    digits = _only_digits(m)
    code = F.when(F.substring(m, 1, 1) == "+", F.regexp_extract(digits, f"^(?:{CODES}|[0-9]{{3}})", 0)).otherwise("")
    return _refill(m, F.concat(code, permute_digits(F.substr(digits, F.length(code) + 1), key, "phone")))


def _ssn(m: Column, key: str) -> Column:
    """Areas 1 to 899 without 666, groups 1 to 99, serials 1 to 9999: mixed radix numbers of exactly the valid values."""
    area = F.substring(m, 1, 3).cast("int")
    u = area - 1 - (area > 666).cast("int")
    v = (F.substring(m, 5, 2).cast("int") - 1) * 9999 + F.substring(m, 8, 4).cast("int") - 1
    out = feistel(u, v, F.lit(898), F.lit(99 * 9999), key, "ssn")
    new = out["u"] + 1 + (out["u"] >= 665).cast("int")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return F.concat_ws("-", pad(new, 3), pad(F.floor(out["v"] / 9999) + 1, 2), pad(out["v"] % 9999 + 1, 4))


def _ip(m: Column, key: str) -> Column:
    p = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    out = feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], F.lit(65536), F.lit(65536), key, "ip")
    return F.concat_ws(".", *[x.cast("string") for h in ("u", "v") for x in (F.floor(out[h] / 256), out[h] % 256)])


def _date_parts(m: Column) -> tuple[Column, Column, Column]:
    """The three numbers of a date, whether the year is first, and whether the month is before the day."""
    parts = F.split(m, "[./-]")
    year_first = F.length(parts[0]) == 4
    return parts, year_first, year_first | (parts[1].cast("int") > 12)


def _as_date(m: Column) -> Column:
    """Null if the date does not exist or lies outside the permuted range."""
    parts, year_first, month_first = _date_parts(m)
    two = lambda c: F.lpad(c, 2, "0")
    iso = F.when(year_first, F.concat_ws("-", *[parts[k] for k in range(3)])).otherwise(F.concat_ws("-", parts[2], two(F.when(month_first, parts[0]).otherwise(parts[1])), two(F.when(month_first, parts[1]).otherwise(parts[0]))))
    day = F.try_to_date(iso, "yyyy-MM-dd")
    at = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
    return F.when((at >= 0) & (at < DAY_LEFT * DAY_RIGHT), day)


def _date(m: Column, key: str) -> Column:
    at = F.datediff(_as_date(m), F.lit(FIRST_DAY).cast("date"))
    out = feistel(F.floor(at / DAY_RIGHT), at % DAY_RIGHT, F.lit(DAY_LEFT), F.lit(DAY_RIGHT), key, "date")
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), (out["u"] * DAY_RIGHT + out["v"]).cast("int"))
    parts, year_first, month_first = _date_parts(m)
    short = (F.length(parts[0]) == 1) | (F.length(parts[1]) == 1)
    number = lambda f: F.when(short, F.date_format(day, f)).otherwise(F.date_format(day, f * 2))
    gap = F.regexp_extract_all(m, F.lit("[./-]"), F.lit(0))
    first, second = F.when(month_first, number("M")).otherwise(number("d")), F.when(month_first, number("d")).otherwise(number("M"))
    return F.when(year_first, F.concat(F.date_format(day, "yyyy"), gap[0], F.date_format(day, "MM"), gap[1], F.date_format(day, "dd"))).otherwise(F.concat(first, gap[0], second, gap[1], F.date_format(day, "yyyy")))


def _email(m: Column, key: str) -> Column:
    low = F.lower(m)
    local, host = F.substring_index(low, "@", 1), F.substring_index(low, "@", -1)
    digest = lambda c, n: F.substring(F.sha2(F.concat_ws("|", F.lit(key), c), 256), 1, n)
    return F.concat(F.lit("user"), digest(F.concat(local, F.lit("@"), host), 12), F.lit("@host"), digest(host, 8), F.lit(".example"))


def _secret(m: Column, key: str) -> Column:
    new = F.substr(F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), F.lower(m)), 256), F.lit(1), F.length(m))
    return F.when(m == F.upper(m), F.upper(new)).otherwise(new)


def kind(m: Column) -> Column:
    """The kind of a match that passes its validation; null for others."""
    digits = _only_digits(m)
    whole = lambda k: F.regexp_like(m, F.lit(f"^(?:{PATTERNS[k]})$"))
    octets = F.forall(F.split(m, r"\."), lambda x: x.cast("int") <= 255)
    ssn = ~F.substring(m, 1, 3).isin("000", "666") & (F.substring(m, 1, 1) != "9") & (F.substring(m, 5, 2) != "00") & (F.substring(m, 8, 4) != "0000")
    return (
        F.when(F.contains(m, F.lit("@")), "email")
        .when(whole("secret") & F.regexp_like(m, F.lit("[0-9]")) & F.regexp_like(m, F.lit("[A-Fa-f]")), "secret")
        .when(whole("iban"), F.when(rest_by_97(_plain(m)) == 1, "iban").when(~F.regexp_like(F.substr(m, F.lit(5)), F.lit("[A-Z]")) & _has_card(m), "card"))
        .when(whole("date"), F.when(_as_date(m).isNotNull(), "date"))
        .when(whole("ip"), F.when(octets, "ip"))
        .when(whole("phone"), F.when(F.length(digits).between(8, 15), "phone"))
        .when(whole("ssn"), F.when(ssn, "ssn"))
        .when(whole("card") & _has_card(m), "card")
    )


def pseudonym(m: Column, what: Column, key: str) -> Column:
    out = F.when(what == "email", _email(m, key))
    for name, f in (("secret", _secret), ("iban", _iban), ("date", _date), ("ip", _ip), ("phone", _phone), ("ssn", _ssn), ("card", _cards)):
        out = out.when(what == name, f(m, key))
    return out.otherwise(m)


def find(docs: DataFrame, text_col: str = "text", key: str = DEFAULT_KEY) -> DataFrame:
    """``docs`` with ``_pii``: an array of (found, kind, pseudonym), in the order of the text; kind is null if invalid."""
    # most texts have neither a digit nor an @ and skip the search
    some = F.col(text_col).rlike("[0-9@]")
    found = F.when(some, F.regexp_extract_all(F.col(text_col), F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    kinds = docs.withColumn("_pii", F.transform(found, lambda m: F.struct(m.alias("found"), kind(m).alias("kind"))))
    return kinds.withColumn("_pii", F.transform("_pii", lambda x: F.struct(x["found"], x["kind"], pseudonym(x["found"], x["kind"], key).alias("pseudonym"))))


def mask(docs: DataFrame, text_col: str = "text", key: str = DEFAULT_KEY) -> DataFrame:
    """``docs`` with pseudonyms in the text and one more column, ``_pii`` (see ``find``)."""
    if "_pii" in docs.columns:
        raise ValueError("the table has a column _pii already")
    parts = F.split(F.col(text_col), ANY, -1)
    new = F.array_join(F.zip_with(parts, F.col("_pii"), lambda p, x: F.concat(p, F.coalesce(x["pseudonym"], F.lit("")))), "")
    return find(docs, text_col, key).withColumn(text_col, F.when(F.size("_pii") > 0, new).otherwise(F.col(text_col)))


def report(masked: DataFrame) -> DataFrame:
    """doc_id, the text with pseudonyms, and how many values of each kind were replaced."""
    count = lambda k: F.size(F.filter("_pii", lambda x: x["kind"] == k)).cast("long")
    return masked.select("doc_id", "text", *[count(k).alias(f"n_{k}") for k in PATTERNS])


def masked_documents(docs: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """``docs`` with masked texts; ``n_chars`` follows the text where the table has it. All other columns, whatever their
    names, stay as they are: they travel beside the text as one struct."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    out = mask(docs.select(F.col("text").alias("text"), row.alias("row")), key=key)
    length = lambda c: F.length("text").cast(docs.schema[c].dataType)
    new = {"text": F.col("text"), "n_chars": length("n_chars") if "n_chars" in docs.columns else None}
    return out.select(*[(F.col("row").getField(c) if new.get(c) is None else new[c]).alias(c) for c in docs.columns])
