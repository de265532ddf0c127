from pyspark.sql import functions as F

from corpusloom.functions import text as T


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_lexical_tokens(spark):
    assert one(spark, T.lexical_tokens(F.col("t")), t="QLoRA's 4-bit NF4, a é x2!") == ["qlora", "4-bit", "nf4", "x2"]


def test_clean_text(spark):
    assert one(spark, T.clean_text(F.col("t")), t=" a  b ![i](x)\n\n\n\nc\t") == "a b \n\nc"


def test_chunk_clean_keeps_formulas_and_drops_scraps(spark):
    text = "## Head\nSee [this](http://x) and [12] \\frac{a}{b} $x$.\n| a | b |\n|---|---|\n!!!###\n\n\n\nEnd _ab_ ."
    got = one(spark, T.clean_chunk_text(F.col("t")), t=text)
    assert got.startswith("Head\nSee this and  \\frac{a}{b} $x$.".replace("and  ", "and "))
    assert "|" not in got and "!!!" not in got and got.endswith("End .") or got.endswith("End  .")


def test_line_filter(spark):
    rows = spark.createDataFrame([("a1!!",), ("a1b!",), ("",)], "t string").select("t", T.readable_line(F.col("t")).alias("k"))
    assert {r["t"]: r["k"] for r in rows.collect()} == {"a1!!": False, "a1b!": True, "": True}


def test_strip_references(spark):
    assert one(spark, T.strip_references(F.col("t")), t="body\n# References\nx") == "body"
    assert one(spark, T.strip_references(F.col("t")), t="  no heading ") == "  no heading "


def citation(spark, text):
    return one(spark, T.is_citation(F.col("t")), t=text)


def test_citations(spark):
    assert citation(spark, "") and citation(spark, "doi.org x doi.org") and citation(spark, "In Proc x In Proc y")
    few = " ".join(["word"] * 20)
    assert not citation(spark, few + " 2001" * 8) and citation(spark, few + " 2001" * 9)
    many = " ".join(["word"] * 400)
    assert not citation(spark, many + " 2001" * 15) and citation(spark, many + " 2001" * 16)


def test_quality(spark):
    good = lambda t: one(spark, T.is_quality(F.col("t")), t=t)
    assert not good("word " * 29) and good("word " * 30)
    assert good("word " * 18 + "1 " * 12) and not good("word " * 17 + "1 " * 13)


def test_thinking_and_json(spark):
    assert one(spark, T.strip_thinking(F.col("t")), t="<think>a\nb</think>X<think>zz") == "X"
    assert one(spark, T.json_between_braces(F.col("t")), t='x{"a":{"b":1}}y') == '{"a":{"b":1}}'
    assert one(spark, T.json_between_braces(F.col("t")), t="no braces") is None


def test_topics(spark):
    topic = lambda t: one(spark, T.topic_of(F.col("t")), t=t)
    assert topic("QLoRA for all") == "parameter-efficient fine-tuning"
    assert topic("Storage engines") == "retrieval-augmented generation"
    assert topic("Prompt X") == "prompt engineering" and topic("Other") == "machine learning"


def test_distance(spark):
    assert spark.range(1).select(T.score_distance(F.lit(0.0)).alias("x")).first()["x"] == 0.5
