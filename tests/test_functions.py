"""Column functions against their Python definitions."""
import json
import math

from pyspark.sql import functions as F

from pathweave.functions.identity import json_quote
from pathweave.functions.normal import cohens_h, norm_cdf, power_at_n, required_n, two_sided_p, z_quantile
from pathweave.functions.text import approx_tokens, py_strip, verdict

# Reply texts and the outcome each must give.
VERDICTS = [("Yes.", 1), ("\n no, because", 0), ("Nope", 0), ("NO!", 0), ("yesterday", 1), ('"yes"', None),
            ("**Yes**", None), ("", None), ("   ", None), ("No", 0), ("yes, certainly", 1), ("Not sure", 0),
            ("maybe yes", None), ("\t Yes", 1)]


def test_verdict_rules(spark):
    df = spark.createDataFrame([(t,) for t, _ in VERDICTS], "t string")
    got = [r.v for r in df.select(verdict(F.col("t")).alias("v")).collect()]
    assert got == [v for _, v in VERDICTS]


def test_strict_verdicts(spark):
    cases = [("Yes.", 1), ("no, thanks", 0), ("Nope", None), ("yesterday", None), ("NO!", None), ("yes;", 1)]
    df = spark.createDataFrame([(t,) for t, _ in cases], "t string")
    got = [r.v for r in df.select(verdict(F.col("t"), strict=True).alias("v")).collect()]
    assert got == [v for _, v in cases]


def test_strip_like_python(spark):
    texts = [" a ", "\t\nb\r\n", "\x0b\x0cc\x1c", " d ", " e ", "f", "", "  ", "\x85g\x1f"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.s for r in df.select(py_strip(F.col("t")).alias("s")).collect()]
    assert got == [t.strip() for t in texts]


def test_approx_tokens_counts_code_points(spark):
    texts = ["", "abc", "abcd", "é" * 9, "😀" * 8, "x" * 401]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.n for r in df.select(approx_tokens(F.col("t")).alias("n")).collect()]
    assert got == [max(1, len(t) // 4) for t in texts]


def test_json_quote_matches_json_dumps(spark):
    texts = ["plain", 'q"uote', "back\\slash", "new\nline\ttab\r\b\f", "\x01\x1f\x7f", "é ü ß", "中文",
             "emoji 😀 and 𝄞", "mixed \"é\"\n", "", "abc\n", "abc\u2028", "a\u0085b", "\u2029", "abc\r", "\n", "a\u2028b\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.q for r in df.select(json_quote(F.col("t")).alias("q")).collect()]
    assert got == [json.dumps(t) for t in texts]


def test_normal_tail_and_power(spark):
    zs = [-6.0, -3.2, -1.96, -0.5, 0.0, 0.3, 1.0, 1.6449, 2.5758, 4.0, 7.5]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    rows = df.select("z", two_sided_p(F.col("z")).alias("p"), norm_cdf(F.col("z")).alias("c")).collect()
    for r in rows:
        assert abs(r.p - math.erfc(abs(r.z) / math.sqrt(2))) < 2e-7
        assert abs(r.c - 0.5 * math.erfc(-r.z / math.sqrt(2))) < 2e-7
    pairs = [(0.5, 0.6), (0.2, 0.5), (0.9, 0.95), (0.0, 0.1)]
    df = spark.createDataFrame(pairs, "a double, b double")
    h = cohens_h(F.col("a"), F.col("b"))
    rows = df.select("a", "b", h.alias("h"), required_n(h).alias("n"), power_at_n(h, 30).alias("pw")).collect()
    za, zb = z_quantile(0.975), z_quantile(0.8)
    for r in rows:
        hh = abs(2 * math.asin(math.sqrt(r.a)) - 2 * math.asin(math.sqrt(r.b)))
        assert abs(r.h - hh) < 1e-12
        assert r.n == math.ceil(2 * ((za + zb) / hh) ** 2)
        shift = hh * math.sqrt(30 / 2)
        exact = 0.5 * math.erfc(-(shift - za) / math.sqrt(2)) + 0.5 * math.erfc(-(-shift - za) / math.sqrt(2))
        assert abs(r.pw - exact) < 3e-7
