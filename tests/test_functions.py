"""Values the domain rules state, column by column."""
import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from lineweave.functions import features as P
from lineweave.functions import scores as D
from lineweave.functions import text as T


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_cleaner(spark):
    got = column(spark, ["FVM - Tubo PVC Sold 25mm - NBR 5648", "JOE 90 CPVC DN100", None], T.clean_for_match)
    assert got == ["TUBO PVC SOLDAVEL 25 MM", "JOELHO 90 ULTRATERM DN 100", ""]


def test_codes(spark):
    assert column(spark, ["0024", "", "000"], lambda c: T.norm_code(c, "zeros")) == ["24", "0", "0"]
    assert column(spark, ["24.0", "A1"], lambda c: T.norm_code(c, "int")) == ["24", "A1"]
    assert column(spark, ["O3I2", "12"], T.ocr_code) == ["0312", None]


def test_numbers(spark):
    assert column(spark, ["1.234,56", "7"], lambda c: T.br_number(c, "dot")) == [1234.56, 7.0]
    assert column(spark, ["1.508", "0,652"], lambda c: T.br_number(c, "lone")) == [1508.0, 0.652]
    assert column(spark, ["12,34", "1234"], T.ocr_price) == [12.34, 12.34]


def test_category_is_the_earliest(spark):
    assert column(spark, ["LUVA P/TUBO 25MM", "TUBO C/ CURVA", "CURVA 90", "nada"], P.category) == ["LUVA", "TUBO", "JOELHO", None]
    assert column(spark, ["LUVA CORRER P/TUBO", "TUBO PVC", "CAIXA"], P.is_tube) == [False, True, False]


def test_diameters_leave_angles_out(spark):
    assert column(spark, ["JOELHO 90X25MM", "TE 90 X 50", "BUCHA 60X50", "DN 100 X 50", "TUBO 6M 25MM"], P.diameters) == [[25], [50], [50, 60], [50, 100], [25]]


def test_fractions_and_gauges(spark):
    assert [[(x.n, x.d) for x in r] for r in column(spark, ["LUVA 1/2 X 3/4", "4/3"], P.fractions)] == [[(1, 2), (3, 4)], []]
    assert [tuple(r) for r in column(spark, ["25 x 20", '3/4"', '25 x 3/4"', "GRANDE"], P.gauge)] == [(25, 20, "mm"), (None, None, "pol"), (25, None, "mm_pol"), (None, None, "texto")]


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_lcs_equals_brute_force():
    rnd = random.Random(7)
    word = lambda n: "".join(rnd.choice("ABCÇ 12") for _ in range(n))
    a = [word(rnd.randint(0, 90)) for _ in range(200)] + ["", "X" * 64, "Y" * 65]
    b = [word(rnd.randint(0, 90)) for _ in range(200)] + ["A", "X" * 64, "Y" * 70]
    assert D.lcs_lengths(a, b).tolist() == [slow_lcs(x, y) for x, y in zip(a, b)]


def test_ratios(spark):
    df = spark.createDataFrame([("TUBO PVC 25", "25 PVC TUBO"), ("A B", "A B C"), ("ABC", "XYZ")], "a string, b string")
    r = df.select(D.token_sort_ratio(F.col("a"), F.col("b")), D.token_set_ratio(F.col("a"), F.col("b")), D.indel_ratio(F.col("a"), F.col("b")), D.sequence_ratio(F.col("a"), F.col("b"))).collect()
    assert r[0][0] == 1.0 and r[0][1] == 1.0 and r[1][1] == 1.0 and r[2][2] == 0.0
    assert abs(r[0][3] - SequenceMatcher(None, "TUBO PVC 25", "25 PVC TUBO").ratio()) < 1e-12


def test_money(spark):
    df = spark.createDataFrame([("11.0", "10.0"), ("10.0", "10.0"), ("9", "10")], "q string, o string")
    assert [float(r[0]) for r in df.select(D.discount(F.col("q"), F.col("o"))).collect()] == [9.09091, 0.0, 0.0]
    one = spark.createDataFrame([("0.879", "0.879")], "c string, o string")
    assert float(one.select(D.safe_price(F.col("c").cast("decimal(18,6)"), F.col("o").cast("decimal(18,6)"))).first()[0]) == 0.87
    assert spark.range(1).select(D.return_discount(F.lit(0.652), F.lit(0.58))).first()[0] == 11.04
