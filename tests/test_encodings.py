from pyspark.sql import functions as F

from palimpsest.functions import encodings
from palimpsest.plans.binaries import keyed


def first(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_decimal_lists(spark):
    codes = ",".join(str(ord(c)) for c in "hello, world")
    assert first(spark, f"x={codes};", encodings.decimal_texts) == ["hello, world"]  # a separator at the end doesn't count
    assert first(spark, codes.replace(",", ";", 1), encodings.decimal_texts) == []  # two kinds of separator
    assert first(spark, f"x=[{codes}]", encodings.decimal_texts) == ["hello, world"]
    assert first(spark, codes.replace(",", ";"), encodings.decimal_texts) == ["hello, world"]
    assert first(spark, codes.replace("104", "304"), encodings.decimal_texts) == []
    assert first(spark, "1,2,3", encodings.decimal_texts) == []
    assert first(spark, ",".join(["65"] * 200_000), encodings.decimal_texts) == ["A" * 200_000]
    assert first(spark, None, encodings.decimal_texts) is None


def test_long_runs_do_not_exhaust_the_stack(spark):
    assert len(first(spark, "&H41, " * 200_000, encodings.amp_blobs)[0]) == 200_000
    assert first(spark, "\\u" + "0041" + "\\u0041" * 99_999, encodings.unicode_texts) == ["A" * 100_000]
    assert first(spark, "array(" + "1, " * 100_000 + "2) xor 3", encodings.xored_arrays)[0].endswith("01")


def test_macro_literals(spark):
    assert first(spark, 'StrReverse("cba") & environ("TEMP")', encodings.reversed_literals) == ["abc"]
    assert first(spark, 'x = Environ$("TEMP")', encodings.environ_markers) == ["VBA-ENVIRON %TEMP%"]
    assert first(spark, 'Replace("a#b", "#", "") Replace("q", "", "z")', encodings.replaced_literals) == ["ab", "q"]


def test_keyed_digits_are_divided_exactly(spark):
    key = 10_000_001
    one = lambda v: f"{v:015d}Z"
    t = one(65 * key - 1) + str(key).rjust(16, "K") + one(66 * key + 5)  # the first is 64 and a remainder of key - 1
    run = "pad0" + t[:24] + "05" + "21" + t[24:] + "end0"
    assert first(spark, f'x = "{run}"', encodings.keyed_digits) == ["@B"]


def test_all_keyed_runs_of_a_text_count(spark):
    texts = [f"run {i}." for i in range(100)]
    body = " ".join(keyed(t.encode()).decode() for t in texts)
    assert first(spark, body, encodings.keyed_digits) == [" " * (len(t) % 2) + t for t in texts]


def test_keyed_groups_of_letters_alone_give_nothing(spark):
    run = keyed(b"abcdef").decode()
    assert first(spark, run, encodings.keyed_digits) == ["abcdef"]
    assert first(spark, run.replace(run[-15:-9], "LLLLLL"), encodings.keyed_digits) == []
