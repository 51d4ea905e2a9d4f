"""Rules that are data: overlays, deletes, cached work."""

from pyspark.sql import functions as F

from quirework.functions import records


def test_rules_fit_by_code_and_tokens(spark):
    docs = spark.createDataFrame([(1, "A-1", "has Alpha and BETA", None), (2, "A-2", "alpha beta", None), (3, "A-1", "alpha", "own"), (4, None, "gamma", None), (5, "A-1", None, None)], "i int, code string, t string, tag string")
    rules = spark.createDataFrame([(1, "A-1", ["alpha", "beta"], "both"), (2, None, ["gamma"], "any"), (3, "A-1", ["alpha"], "one"), (4, "A-2", ["delta"], "no")], "rule_id int, code string, tokens array<string>, tag string")
    got = {r["i"]: r["tag"] for r in records.apply_rules(docs, rules, "t", ["tag"], code="code").collect()}
    assert got == {1: "both", 2: None, 3: "one", 4: "any", 5: None}


def test_repeated_rows_keep_their_number(spark):
    docs = spark.createDataFrame([("x alpha", None)] * 3, "t string, tag string")
    rules = spark.createDataFrame([(1, None, ["alpha"], "hit")], "rule_id int, code string, tokens array<string>, tag string")
    assert [r["tag"] for r in records.apply_rules(docs, rules, "t", ["tag"]).collect()] == ["hit"] * 3


def test_pruned_maps_and_numbers(spark):
    df = spark.createDataFrame([({"a": " ", "b": "x"}, 3)], "m map<string,string>, n int")
    r = df.select(records.prune(F.col("m"), df.schema["m"].dataType).alias("m"), records.prune(F.col("n"), df.schema["n"].dataType).alias("n")).first()
    assert r["m"] == {"b": "x"} and r["n"] == 3


def test_spacing_may_rise_for_codes_that_were_seen_to(spark):
    from pyspark.sql import functions as F

    from quirework.operators import completeness

    rising = '"mechanical_key":{"spacing":{"1":".4","2":".45","3":".5","4":".55","5":".6","6":".65","7":".7","8":".75"}}'
    rows = [("EIGHT SPACES", f'{{"code":"HON-R15",{rising}}}'), ("EIGHT SPACES", f'{{"code":"HON-R14",{rising}}}'), ("EIGHT SPACES", f'{{"code":"HON-R15",{rising.replace(".75", ".1")}}}')]
    got = spark.createDataFrame(rows, "s string, r string").select(completeness.issues(F.col("s"), F.col("r")).alias("i")).collect()
    assert ["eight spaces out of order" in r["i"] for r in got] == [False, True, True]
