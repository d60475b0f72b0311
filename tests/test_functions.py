import duckdb
import pytest

from tessera.functions import matching as M
from tessera.functions import normalize as N
from tessera.functions import similarity as S


@pytest.mark.parametrize(
    ("raw", "region", "value"),
    [
        ("+1 415 555 0101", None, "+14155550101"),
        ("555-0188", None, None),
        ("(20) 7946 0958", "GB", "+442079460958"),
        ("020 7946 0958", "GB", "+442079460958"),
        ("+44 7911 123456", None, "+447911123456"),
        ("192.168.10.20", None, None),
        ("2020-07-15", None, None),
        ("4111 1111 1111 1111", "US", None),
        ("", "US", None),
        (None, None, None),
        ("+380 44 123 4567", None, "+380441234567"),
        ("+234 803 123 4567", None, "+2348031234567"),
        ("+84 91 234 5678", None, "+84912345678"),
        ("081 234 5678", "TH", "+66812345678"),
        ("+1 415 555 0101 x12", None, "+14155550101"),
        ("+1 415 555 0101 ext. 7", None, "+14155550101"),
        ("+999 12345678", None, None),
    ],
)
def test_phone(raw, region, value):
    got = N.phone(raw, region)
    assert got[0] == value
    if value is None:
        assert got[2] == ("e164_invalid" if region else "e164_no_region")


def test_names():
    assert N.name("  josé  GARCÍA ")[0] == "Jose Garcia"
    assert N.name("x")[:2] == ("X", 1.0)
    assert N.name("o'brien-smith")[0] == "O'Brien-Smith"
    assert N.name("Иван")[1] == 0.85
    assert N.name(" ") == (None, 0.0, "name_empty")


def test_dates():
    assert N.year_month("March 5, 2021")[0] == "2021-03"
    assert N.year_month("2019") == ("2019", 0.85, "year_only")
    assert N.year_month("2020-07")[0] == "2020-07"
    assert N.year_month("not a date")[2] == "yyyymm"


def test_skills():
    assert N.skill("Postgres") == ("PostgreSQL", 1.0, None)
    assert N.skill("k8s")[0] == "Kubernetes"
    assert N.skill("Underwater Basket Weaving") == ("Underwater Basket Weaving", 0.85, None)
    assert N.skill("Carpentry")[1] == 0.85
    assert N.skill(None) == ("", 0.85, None)


def test_emails(spark):
    from pyspark.sql import functions as F

    raw = ["  Jon.Park@Example.COM ", "not-an-email", "a@@b", "a..b@c.de", None, "jörg@exämple.de", "x@host.test", "x@printer.local", "x@a.onion", "x@-a.de", "用户@例子.中国", "x@xn--fsqu00a.xn--fiqs8s"]
    rows = spark.createDataFrame([(x,) for x in raw], "raw string")
    got = [r["value"] for r in rows.select(N.email_column(F.col("raw"))["value"].alias("value")).collect()]
    assert got == ["jon.park@example.com", None, None, None, None, "jörg@exämple.de", None, None, None, None, "用户@例子.中国", "x@xn--fsqu00a.xn--fiqs8s"]


def test_countries(spark):
    known = {r["term"]: r["iso"] for r in N.countries(spark).collect()}
    official = {"russian federation": "RU", "united states of america": "US", "viet nam": "VN", "czech republic": "CZ", "republic of india": "IN", "korea, republic of": "KR"}
    assert {name: known.get(name) for name in official} == official
    assert known["united kingdom"] == "GB" and known["usa"] == "US" and known["us"] == "US" and "atlantis" not in known


def test_jaro_winkler_is_duckdbs():
    words = ["jonathan park", "jon park", "michael smith", "micheal smyth", "robert chen", "r chen", "dana lee", "a", "", "martha", "marhta", "dixon", "dicksonx"]
    for a in words:
        for b in words:
            if a and b:
                want = duckdb.execute("select jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0]
                assert S.jaro_winkler(a, b) == pytest.approx(want, abs=1e-9), (a, b)


def test_token_set_ratio():
    assert S.token_set_ratio("ruby on rails", "rails ruby on") == 100
    assert S.token_set_ratio("a b", "a b c") == 100
    assert S.token_set_ratio("", "a") == 0
    assert S.token_set_ratio("abc", "abd") == pytest.approx(200 * 2 / 6)


def test_match_names():
    assert M.match_name("Park, Jonathan") == "jonathan park"
    assert M.match_name("John Q. Smith Jr") == "john smith"
    assert M.sound_key(M.match_name("Park, Jonathan")) == M.sound_key("jonathan park")
    assert M.match_name("Иван") == "" and M.sound_key("") is None
    assert not M.alike("", "") and M.alike("jon park", "jon park")


def test_sql_names(spark):
    from tessera.functions.register import register

    assert "jaro_winkler" in register(spark)
    row = spark.sql("select jaro_winkler('martha', 'marhta') a, token_set_ratio('b a', 'a b') b, e164('020 7946 0958', 'GB') c, strip_accents('é') d, skill_canonical('k8s') e, jaro_winkler(null, 'x') f, match_name('Park, Jonathan') g").first()
    assert row["a"] == pytest.approx(0.9611, abs=1e-4) and (row["b"], row["c"], row["d"], row["e"], row["f"], row["g"]) == (100.0, "+442079460958", "e", "Kubernetes", None, "jonathan park")


@pytest.mark.parametrize(
    ("word", "code"),
    [
        ("Thomas", "TMS"),
        ("Tomas", "TMS"),
        ("Michael", "MKL"),
        ("Mikael", "MKL"),
        ("Knight", "NT"),
        ("Night", "NT"),
        ("Wright", "RT"),
        ("Right", "RT"),
        ("Smith", "SM0"),
        ("Schmidt", "XMT"),
        ("Catherine", "K0RN"),
        ("Kathryn", "K0RN"),
        ("Knox", "NKS"),
        ("Phillip", "FLP"),
        ("Xavier", "SF"),
        ("Jose", "HS"),
        ("Caesar", "SSR"),
        ("Bacchus", "PKS"),
        ("Filipowicz", "FLPTS"),
        ("Breaux", "PR"),
        ("Hugh", "H"),
        ("Cough", "KF"),
        ("Edge", "AJ"),
        ("Edgar", "ATKR"),
        ("Island", "ALNT"),
        ("Zhao", "J"),
        ("Schermerhorn", "XRMRRN"),
        ("", ""),
        ("123", ""),
    ],
)
def test_sound_codes(word, code):
    from tessera.functions.phonetic import sound_code

    assert sound_code(word) == code


def test_names_that_sound_alike_meet_in_a_block():
    for a, b in (("Thomas Muller", "Tomas Muller"), ("Michael Wright", "Right, Mikael"), ("Anna Knight", "Anna Night")):
        assert M.sound_key(M.match_name(a)) == M.sound_key(M.match_name(b))
    assert M.sound_key("person 12") == "N:12|PRSN"
