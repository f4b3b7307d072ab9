"""Words that stay whole, and white space between wide characters."""

from feedloom.functions import segments as S


def test_protected_words(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("佐々木寿人は94%勝利」を23,550件データベース野球セ・リーグとa-b/c",)], "t string")
    assert row.select(S.protected_words(F.col("t"), ("佐々木寿人",), ("%", "件")).alias("w")).first()["w"] == ["佐々木寿人", "94%", "勝利", "23,550件", "データベース", "野球", "セ・リーグ", "a-b/c"]


def test_wide_spaces(spark):
    from pyspark.sql import functions as F

    rows = [(["書く。", "\n  次の ", "語 と a 字 "],), ([],), ([" "],), (["あ  い う", "", "え"],), (["字" + " " * 500, " " * 90, "字 x"],)]
    got = [r["x"] for r in spark.createDataFrame(rows, "n array<string>").select(S.joined_wide(F.col("n")).alias("x")).collect()]
    assert got == [["書く。", "次の", "語と a 字 "], [""], [" "], ["あいう", "", "え"], ["字", "", "字 x"]]
