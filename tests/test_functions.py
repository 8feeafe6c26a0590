import unicodedata

from pyspark.sql import functions as F

from ledgerloom.functions import dates, scores, text
from ledgerloom.functions.language import with_language, with_script


def column(spark, values, expression, kind="string"):
    """Results of an expression over a one-column table, in input order."""
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[0] for r in rows.select(expression(F.col("v")).alias("x"), "i").orderBy("i").collect()]


def test_parse_amount(spark):
    cases = {"1234.56": 1234.56, "$1,234.56": 1234.56, "1.234,56": 1234.56, "€ 500.00": 500.0, "": None, None: None,
             "  2 500.00  ": 2500.0, "1.234": 1234.0, "1234,56": 123456.0, "5-3": None, "-50": -50.0, "١٢٣.٥": 123.5}
    assert column(spark, list(cases), text.parse_amount) == list(cases.values())


def test_parse_int(spark):
    assert column(spark, ["-1.5", "abc", "", None, "12 a 3"], text.parse_int) == [15, None, None, None, 123]


def test_parse_date(spark):
    cases = {"2024-01-15": "2024-01-15", "15/01/2024": "2024-01-15", "01/15/2024": "2024-01-15",
             "January 15, 2024": "2024-01-15", "15 Jan 2024": "2024-01-15", "JAN 5, 2024": "2024-01-05",
             "not-a-date": None, "": None, "20240115": "2024-01-15", "2024115": None, "15-01-24": "2015-01-24",
             "15/01/70": "1970-01-15", "15/01/68": "2068-01-15", "30.02.2024": None, "15.01.24": "2024-01-15",
             "15 Jan 24": "2024-01-15", "1/2/2024": "2024-02-01", "  15  Jan   2024 ": "2024-01-15"}
    read = lambda c: dates.parse_date(c).cast("string")
    assert column(spark, list(cases), read) == list(cases.values())


def test_format_date_iso(spark):
    assert column(spark, ["15/01/2024", "garbage"], dates.format_date_iso) == ["2024-01-15", "garbage"]


def test_squeeze_and_clean(spark):
    assert column(spark, ["hello   world", "hello\t\nworld", "  hi  ", "a  b"], text.squeeze) == [
        "hello world", "hello world", "hi", "a b"]
    raw = ["a\rb", "ﬁn\x00e ① x", "plain\ttext", "Ａ１　b", None]
    want = []
    for t in raw:
        if t is None:
            want.append(None)
            continue
        n = unicodedata.normalize("NFKC", t)
        want.append(" ".join("".join(c for c in n if unicodedata.category(c) != "Cc" or c in "\n\t").split()))
    assert column(spark, raw, text.clean_text) == want


def test_confidence(spark):
    got = column(spark, [0.90, 0.70, 0.45, 0.20], scores.confidence_label, "double")
    assert got == ["High", "Medium", "Low", "Very Low"]
    assert column(spark, [0.9, 0.6, 0.1, None], scores.confidence_badge, "double") == ["High 90%", "Med 60%", "Low 10%", ""]
    maps = spark.createDataFrame([({"a": 0.85, "b": 0.4},), ({},)], "m map<string,double>")
    assert [r[0] for r in maps.select(scores.average_confidence(F.col("m"))).collect()] == [0.625, 0.0]


def test_matches_keep_pattern_order(spark):
    patterns = [r"b(\d+)", r"a(\d+)"]
    assert column(spark, ["a1 b2 b3 b2", "x"], lambda c: text.first_match(c, patterns)) == ["2", ""]
    assert column(spark, ["a1 b2 b3 b2", "x"], lambda c: text.all_matches(c, patterns)) == [["2", "3", "1"], []]


def test_supported_files(spark):
    names = ["a.JPG", "dir.pdf/b.txt", "c.webp", "noext", "/x/.pdf"]
    assert column(spark, names, text.is_supported_file) == [True, False, True, False, False]


def test_language(spark):
    texts = ["This is an invoice for the services that we have rendered to you", "فاتورة ضريبية رقم واحد للشركة", "", "hi",
             "Это счёт за оказанные услуги номер один", "請求書の番号は次のとおりです。よろしくお願いします", None,
             "12345678901234567890123", "La facture est pour les services de la société dans une ville"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = [r[0] for r in with_language(rows).orderBy("i").select("lang_code").collect()]
    assert got == ["en", "ar", "en", "en", "ru", "ja", "en", "en", "fr"]


def test_script_tie_goes_to_the_first_seen(spark):
    rows = spark.createDataFrame([(1, "абвгде عربيتن"), (2, "عربيتن абвгде"), (3, "абв")], "i int, text string")
    got = [r[0] for r in with_script(rows, "text", "s").orderBy("i").select("s").collect()]
    assert got == ["ru", "ar", ""]
