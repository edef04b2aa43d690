import hashlib
import re
from datetime import date

from saltern.llm import pii


def luhn(s):
    t = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (2 if i % 2 else 1)
        t += d - 9 * (d > 9)
    return t % 10 == 0


def masked(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in pii.report(pii.mask(df)).collect()}


CASES = [
    "card 4539578763621486 here",
    "spaced 4539 5787 6362 1486, hyphens 4539-5787-6362-1486!!",
    "not a card 4539578763621487",
    "call +1 (521) 555-2373 or (521) 555-2373 or 521-555-2373###",
    "ssn 123-45-6789, invalid 000-12-3456 666-11-1111 900-11-1111",
    "ip 97.51.17.173 and 256.1.1.1 and version 1.2.3.4.5 and CC 4.0.",
    "born 1984-02-29, not 1983-02-29; 31.12.1999 and 05/11/2020",
    "mail und.34@mail7.example.com### UND.34@MAIL7.EXAMPLE.COM!!",
    'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"',
    "nothing at all, version 3.",
    "",
    None,
    "4539578763621486",
    "both 4539578763621486 4539578763621486",
    "1" * 5000 + " " + "a1." * 3000 + "@",
]


def test_kinds_formats_and_links(spark):
    got = masked(spark, CASES)
    text = {k: r.text for k, r in got.items()}
    for k in (2, 9, 10, 11, 14):
        assert text[k] == CASES[k]
    a = re.fullmatch(r"card (\d{16}) here", text[0])[1]
    assert luhn(a) and a != "4539578763621486"
    b = re.fullmatch(r"spaced (\d{4} \d{4} \d{4} \d{4}), hyphens (\d{4}-\d{4}-\d{4}-\d{4})!!", text[1])
    assert re.sub(r"\D", "", b[1]) == re.sub(r"\D", "", b[2]) == a == text[12] and text[13] == f"both {a} {a}"
    p = re.fullmatch(r"call \+1 (\(\d{3}\) \d{3}-\d{4}) or (\(\d{3}\) \d{3}-\d{4}) or (\d{3}-\d{3}-\d{4})###", text[3])
    assert p[1] == p[2] != "(521) 555-2373" and re.sub(r"\D", "", p[1]) == re.sub(r"\D", "", p[3])
    s = re.fullmatch(r"ssn (\d{3})-(\d\d)-(\d{4}), invalid 000-12-3456 666-11-1111 900-11-1111", text[4])
    assert s[1] not in ("000", "666") and s[1] < "900" and s[2] != "00" and s[3] != "0000" and s.groups() != ("123", "45", "6789")
    i = re.fullmatch(r"ip (\d+)\.(\d+)\.(\d+)\.(\d+) and 256.1.1.1 and version 1.2.3.4.5 and CC 4.0.", text[5])
    assert all(int(x) < 256 for x in i.groups()) and i.groups() != ("97", "51", "17", "173")
    d = re.fullmatch(r"born (\d{4}-\d\d-\d\d), not 1983-02-29; (\d\d)\.(\d\d)\.(\d{4}) and (\d\d)/(\d\d)/(\d{4})", text[6])
    assert date.fromisoformat(d[1]) and date(int(d[4]), int(d[3]), int(d[2])) and date(int(d[7]), int(d[6]), int(d[5]))
    m = re.fullmatch(r"mail (user\w+@host\w+\.example)### (user\w+@host\w+\.example)!!", text[7])
    assert m[1] == m[2]
    t = re.fullmatch(r'token = "([0-9a-f]{40})" TOKEN = "([0-9A-F]{40})"', text[8])
    assert t[1] != CASES[8][9:49]
    assert [got[k].n_card for k in (0, 1, 2, 13)] == [1, 2, 0, 2] and got[4].n_ssn == 1 and got[5].n_ip == 1 and got[6].n_date == 3


def test_permutations_are_one_to_one(spark):
    df = spark.range(1000).selectExpr("id", "lpad(cast(id as string), 3, '0') as d")
    out = [r.p for r in df.select(pii.permute_digits(df["d"], "k", "t").alias("p")).collect()]
    assert sorted(out) == [f"{k:03d}" for k in range(1000)]
    days = spark.range(73000).selectExpr("cast(date_add(date'1900-01-01', cast(id as int)) as string) as d")
    assert days.select(pii._date(days["d"], "k").alias("p")).distinct().count() == 73000
    ssns = spark.range(898).selectExpr("lpad(cast(id + 1 + int(id >= 665) as string), 3, '0') || '-01-0001' as s")
    assert ssns.select(pii._ssn(ssns["s"], "k").alias("p")).where("p rlike '^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$'").distinct().count() == 898


def test_plan_is_native_and_columns_stay(spark):
    df = spark.createDataFrame([(1, "ip 1.2.3.4", 10, "x")], "doc_id long, text string, n_chars int, kind string")
    out = pii.masked_documents(df)
    assert out.columns == df.columns and out.schema["n_chars"].dataType == df.schema["n_chars"].dataType
    assert "Python" not in out._jdf.queryExecution().toString()
    assert pii.masked_documents(df.where("false")).count() == 0


def permuted(digits, tweak, key=pii.DEFAULT_KEY):
    """The Feistel network in plain Python."""
    n = len(digits)
    a = n // 2
    u, v = int(digits[:a]), int(digits[a:])
    for i in range(8):
        size = 10 ** (a if i % 2 == 0 else n - a)
        u, v = v, (u + int(hashlib.md5(f"{key}|digits-{tweak}|{i}|{v}".encode()).hexdigest()[:15], 16) % size) % size
    return f"{u:0{a}d}{v:0{n - a}d}"


def card(digits):
    body = permuted(digits[:-1], "card")
    return next(body + c for c in "0123456789" if luhn(body + c))


def test_cards_and_phones_equal_plain_python(spark):
    c, d = "4539578763621486", "378282246310005"
    new, amex = card(c), card(d)
    four = lambda x, s: s.join(x[k : k + 4] for k in range(0, 16, 4))
    de, es = permuted("612345678", "phone"), permuted("5215552373", "phone")
    cases = {
        f"{c} 12/27": f"{new} 12/27",
        f"at {c} 123 Main St": f"at {new} 123 Main St",
        f"2 {c}": f"2 {new}",
        f"{four(c, ' ')} 12/27": f"{four(new, ' ')} 12/27",
        f"1234 {four(c, ' ')} {four(c, '-')}-2024": f"1234 {four(new, ' ')} {four(new, '-')}-2024",
        f"{d[:4]} {d[4:10]} {d[10:]} {d}": f"{amex[:4]} {amex[4:10]} {amex[10:]} {amex}",
        "+34 612 345 678, +34612345678": f"+34 {de[:3]} {de[3:6]} {de[6:]}, +34{de}",
        "+33 6 12 34 56 78.": f"+33 {de[0]} {de[1:3]} {de[3:5]} {de[5:7]} {de[7:]}.",
        "+1 (521) 555-2373": f"+1 ({es[:3]}) {es[3:6]}-{es[6:]}",
        "2024 2023 2022 2021 2020 2019": "2024 2023 2022 2021 2020 2019",
    }
    got = masked(spark, list(cases))
    assert [got[k].text for k in range(len(cases))] == list(cases.values())


def test_month_first_dates(spark):
    got = masked(spark, ["05/22/1990", "22/05/1990", "13/13/1990"])
    m, d = got[0].text.split("/"), got[1].text.split("/")
    assert m == [d[1], d[0], d[2]] and date(int(d[2]), int(d[1]), int(d[0])) and got[2].text == "13/13/1990"


def test_columns_of_any_name_stay(spark):
    df = spark.createDataFrame([(1, "ip 1.2.3.4", "mine", "r", None), (None, None, None, None, 3)], "doc_id long, text string, _pii string, row string, n_chars long")
    rows = sorted(pii.masked_documents(df).collect(), key=lambda r: r.doc_id is None)
    assert rows[0]._pii == "mine" and rows[0].row == "r" and rows[0].n_chars == len(rows[0].text) and rows[0].text != "ip 1.2.3.4"
    assert rows[1]._pii is None and rows[1].text is None and rows[1].n_chars is None


def rest_by_97(account):
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def test_cards_beside_codes_and_dates(spark):
    c = "4539578763621486"
    new = card(c)
    four = lambda x, s: s.join(x[k : k + 4] for k in range(0, 16, 4))
    got = masked(spark, [f"+1 {four(c, ' ')}", f"card {four(c, ' ')} 2025-05-12", f"card {four(c, ' ')} 12.05.1990", four(c, "."), four(c, "\u00a0"), f"AB12 {four(c, ' ')}", f"AB12 {four('4539578763621487', ' ')}"])
    assert got[0].text == f"+1 {four(new, ' ')}" and got[3].text == four(new, ".") and got[4].text == four(new, "\u00a0")
    day = re.fullmatch(rf"card {four(new, ' ')} (\d{{4}}-\d\d-\d\d)", got[1].text)[1]
    other = re.fullmatch(rf"card {four(new, ' ')} (\d\d)\.(\d\d)\.(\d{{4}})", got[2].text).groups()
    assert date.fromisoformat(day) and day != "2025-05-12" and date(int(other[2]), int(other[1]), int(other[0])) and other != ("12", "05", "1990")
    assert got[5].text == f"AB12 {four(new, ' ')}" and got[6].text == f"AB12 {four('4539578763621487', ' ')}" and got[5].n_card == 1


def test_account_numbers(spark):
    one, two = "DE89370400440532013000", "GB82WEST12345698765432"
    four = lambda x: " ".join(x[k : k + 4] for k in range(0, len(x), 4))
    got = masked(spark, [f"to {four(one)}, {one}.", four(two), "DE88 3704 0044 0532 0130 00", "XDE89370400440532013000", "MT84MALT011000012345MTLCAST001S"])
    a, b = re.fullmatch(r"to (.*), (.*)\.", got[0].text).groups()
    digits = permuted(one[4:], "iban")
    assert b[:2] == "DE" and b[4:] == digits and rest_by_97(b) == 1 and a == four(b) and got[0].n_iban == 2
    g = got[1].text.replace(" ", "")
    assert g[:2] == "GB" and g[4:8] == "WEST" and rest_by_97(g) == 1 and g != two and four(g) == got[1].text
    assert got[2].text == "DE88 3704 0044 0532 0130 00" and got[3].text == "XDE89370400440532013000"
    m = got[4].text
    assert rest_by_97(m) == 1 and re.sub(r"\d", "", m) == re.sub(r"\d", "", "MT84MALT011000012345MTLCAST001S") and m != "MT84MALT011000012345MTLCAST001S"


def test_dates_of_one_digit_and_of_slashes(spark):
    cases = ["5/22/1990", "05/22/1990", "1.2.1990", "01.02.1990", "1990/05/22", "1990-05-22", "31/2/1990", "1.2.3.1990", "7/4/2150"]
    found = masked(spark, cases)
    got = [found[k].text for k in range(len(cases))]
    m, d, y = map(int, got[0].split("/"))
    assert got[1] == f"{m:02d}/{d:02d}/{y}" and got[0] == f"{m}/{d}/{y}" and got[4] == got[5].replace("-", "/") == f"{y}/{m:02d}/{d:02d}"
    day = [int(x) for x in got[2].split(".")]
    assert got[2] == ".".join(map(str, day)) and got[3] == f"{day[0]:02d}.{day[1]:02d}.{day[2]}" and date(*day[::-1])
    assert got[6:] == cases[6:]


def test_a_column_of_its_own_name_is_refused(spark):
    df = spark.createDataFrame([(1, "ip 1.2.3.4", "mine")], "doc_id long, text string, _pii string")
    try:
        pii.mask(df)
    except ValueError as e:
        assert "_pii" in str(e)
    else:
        raise AssertionError
