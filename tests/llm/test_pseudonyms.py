import hashlib
import re
from datetime import date, timedelta

from pyspark.sql import functions as F

from lodestar.llm import pseudonyms as S


def run(spark, texts, key="k"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [(r.text, r.n) for r in S.pseudonymise(df, key, changed="n").orderBy("doc_id").collect()]


def test_formats_and_links(spark):
    texts = ["card 4041894974608795, 4041-8949-7460-8795.", "x 4041894974608795", "mail a.b42@x.example.com!", "ip 42.144.35.254. +1 (269) 555-3296 4041894974608795", "1984-02-29 29/02/1984 12/25/1999", "ssn 123-45-6789"]
    out = run(spark, texts)
    plain, dashed = re.search(r"card (\d{16}), ([\d-]{19})\.$", out[0][0]).groups()
    assert plain == dashed.replace("-", "") and plain != "4041894974608795"
    assert out[1][0] == f"x {plain}" and out[3][0].endswith(plain)
    digits = [int(c) for c in reversed(plain)]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    assert re.fullmatch(r"mail [a-z]\.[a-z]\d\d@x\.example\.com!", out[2][0]) and out[2][0] != texts[2]
    iso, euro, us = out[4][0].split()
    assert date.fromisoformat(iso).strftime("%d/%m/%Y") == euro and int(us[3:5]) > 12 and iso[5:] == "02-29"
    assert re.fullmatch(r"ssn (?!000|666|9)\d{3}-\d\d-\d{4}", out[5][0])
    assert [n for _, n in out] == [2, 1, 1, 3, 3, 1]


def test_a_date_is_linked_in_every_form(spark):
    texts = ["1999-12-25 1999.12.25 1999/12/25", "25/12/1999 25.12.1999 25-12-1999 12/25/1999", "25 December 1999, December 25, 1999", "25 décembre 1999; 25. Dezember 1999; 25 de diciembre de 1999"]
    out = " ".join(t for t, _ in run(spark, texts))
    iso = date.fromisoformat(out[:10])
    assert iso != date(1999, 12, 25) and iso.day in range(13, 29)
    y, m, d = iso.year, iso.month - 1, iso.day
    names = {k: v[m] for k, v in S.MONTHS.items()}
    assert out == (
        f"{iso:%Y-%m-%d} {iso:%Y.%m.%d} {iso:%Y/%m/%d} {iso:%d/%m/%Y} {iso:%d.%m.%Y} {iso:%d-%m-%Y} {iso:%m/%d/%Y} "
        f"{d} {names['en']} {y}, {names['en']} {d}, {y} {d} {names['fr']} {y}; {d}. {names['de']} {y}; {d} de {names['es']} de {y}"
    )
    short = run(spark, ["3/7/1984 1984-07-03 3 May 1984"])[0][0].split(" ", 2)
    there = date.fromisoformat(short[1])
    assert short[0] == f"{there.day}/{there.month}/{there.year}" and there.day <= 12


def mod97(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def test_accounts_phones_and_cards_in_groups(spark):
    texts = ["GB82 WEST 1234 5698 7654 32 and GB82WEST12345698765432.", "GB83WEST12345698765432 DE00123", "+33 1 23 45 67 89, +55 11 91234-5678, +4930123456", "3056 930902 5904"]
    out = run(spark, texts)
    spaced, plain = re.search("(GB.{25}) and (GB.{20})\\.", out[0][0]).groups()
    assert spaced.replace(" ", "") == plain != "GB82WEST12345698765432" and mod97(plain) == 1 and re.fullmatch(r"GB\d\d[A-Z]{4}\d{14}", plain)
    assert out[1] == (texts[1], 0)
    assert re.fullmatch(r"\+33 \d \d\d \d\d \d\d \d\d, \+55 \d\d \d{5}-\d{4}, \+49\d{8}", out[2][0]) and out[2][1] == 3
    assert re.fullmatch(r"\d{4} \d{6} \d{4}", out[3][0]) and out[3][1] == 1


def test_equals_a_plain_feistel(spark):
    """The network and the walk-free numbering against the same steps in Python."""

    def number(value, high, low, kind):
        left, right = divmod(value, low)
        for i in range(S.ROUNDS):
            told = int(hashlib.sha512(f"k|{kind}|{i}|{right if i % 2 == 0 else left}".encode()).hexdigest()[:15], 16)
            left, right = ((left + told) % high, right) if i % 2 == 0 else (left, (right + told) % low)
        return left * low + right

    values = list(range(0, 40_000, 37))
    df = spark.createDataFrame([(v,) for v in values], "v long").select(S.permute_number(F.col("v"), 200, 201, "k", "t").alias("x"))
    assert [r.x for r in df.collect()] == [number(v, 200, 201, "t") for v in values]
    numbers = [f"{a:03d}-{g:02d}-{s:04d}" for a, g, s in ((1, 1, 1), (665, 99, 9999), (667, 1, 1), (899, 99, 9999), (123, 45, 6789))]

    def plain(ssn):
        a, g, s = map(int, ssn.split("-"))
        n = number(((a - (2 if a > 666 else 1)) * 99 + g - 1) * 9999 + s - 1, 898 * 99, 9999, "ssn")
        a = n // (99 * 9999)
        return f"{a + (2 if a >= 665 else 1):03d}-{n // 9999 % 99 + 1:02d}-{n % 9999 + 1:04d}"

    assert [t for t, _ in run(spark, numbers)] == [plain(x) for x in numbers]


def test_very_long_text(spark):
    long = "word. 12 " * 200_000
    out = run(spark, [f"{long}42.144.35.254 {long}a@b.cd", "x@" + "a." * 50_000 + "1", "1-" * 50_000])
    assert len(out[0][0]) > 3_600_000 and out[0][1] == 2 and out[0][0].startswith(long) and out[1][1] == out[2][1] == 0


def test_all_days_are_permuted(spark):
    days = [(date(1900, 1, 1) + timedelta(days=i)) for i in range(73049)]
    df = spark.createDataFrame([(d.year, d.month, d.day) for d in days], "y int, m int, d int")
    got = df.select(S.permute_date(F.col("y"), F.col("m"), F.col("d"), "k").alias("t")).select("t.*").collect()
    assert {date(r.y, r.m, r.d) for r in got} == set(days)


def test_leaves_invalid_and_clean(spark):
    texts = [None, "", "no numbers", "4041894974608796", "30/02/2001", "1.2.3", "999.1.1.1", "000-12-3456", "year 1999", "a@b", "29/02/2001", "31 April 2001", "1.2.1999.4", "1234 5678 9012 3456 7890"]
    assert [t for t, _ in run(spark, texts)] == texts


def test_key_matters(spark):
    assert run(spark, ["42.144.35.254"], "k") != run(spark, ["42.144.35.254"], "other")


def test_permutations(spark):
    small = spark.range(72).select(S.permute_number(F.col("id"), 9, 8, "k", "t").alias("x"))
    assert sorted(r.x for r in small.collect()) == list(range(72))
    strings = spark.range(1000).select(S.permute_string(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "t").alias("x"))
    assert len({r.x for r in strings.collect()}) == 1000
    days = [(date(1999, 1, 1) + timedelta(days=i)).isoformat() for i in range(400)]
    moved = [t for t, _ in run(spark, days)]
    assert len(set(moved)) == 400 and all(date(1900, 1, 1) <= date.fromisoformat(d) <= date(2099, 12, 31) for d in moved)


def test_columns_and_native_plan(spark):
    df = spark.createDataFrame([(1, "x 42.144.35.254", "y")], "doc_id long, text string, `be tween` string")
    out = S.pseudonymise(df, "k")
    assert out.columns == df.columns and out.first()["be tween"] == "y"
    assert "Python" not in out._jdf.queryExecution().toString()
    assert S.pseudonymise(df.where("false"), "k").count() == 0


def test_telephone_numbers_are_linked_in_all_forms(spark):
    forms = ["+1 555 123 4567", "+15551234567", "+1 (555) 123-4567", "+1-555-123-4567", "(555) 123-4567", "+33 1 23 45 67 89", "+33123456789", "+55 11 91234-5678", "+5511912345678", "+351 21 345 6789", "+351213456789"]
    df = spark.createDataFrame(list(enumerate(forms)), "doc_id long, text string")
    got = [r.text for r in S.pseudonymise(df, key="k").orderBy("doc_id").collect()]
    digits = ["".join(c for c in t if c.isdigit()) for t in got]
    assert all(len(a) == len(b) and [c.isdigit() for c in a] == [c.isdigit() for c in b] and a != b for a, b in zip(got, forms, strict=True))
    assert len(set(digits[:4])) == 1 and digits[0] == "1" + digits[4]
    assert digits[5] == digits[6] and digits[5][:2] == "33" and digits[7] == digits[8] and digits[7][:2] == "55" and digits[9] == digits[10] and digits[9][:3] == "351"
