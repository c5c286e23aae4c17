from pyspark.sql import functions as F

from medloom.operators.units import convert, read_quantities
from medloom.plans import units


def read(spark, rows):
    df = spark.createDataFrame(rows, "id string, dosage string, notes string, brand string, unit string")
    return read_quantities(df, "t", "id", "dosage", beside=("brand",), named=("notes",))


def test_reading(spark):
    got = read(spark, [("1", "5mg/10mg", None, None, "x"), ("2", "750", "(mg)", None, "x"), ("3", "62,5", None, "Abc 62,5 mg", "x"), ("4", "40", "sau ăn", None, "x"), ("5", None, None, None, "x"), (None, "5mg", None, None, "x"), ("6", "", None, None, None)])
    rows = sorted((r.row_key, r.part_no, r.unit, r.amount, r.value, r.evidence) for r in got.collect())
    assert rows == [("1", 1, "ug", 5000, None, None), ("1", 2, "ug", 10000, None, None), ("2", 1, None, None, 750.0, "mg"), ("3", 1, None, None, 62.5, "mg"), ("4", 1, None, None, 40.0, None)]


def test_a_quantity_in_the_notes_is_no_evidence(spark):
    got = read(spark, [("1", "200", "uống với 200ml nước", None, None), ("2", "200mg", "uống với 200ml nước", None, None)]).collect()
    assert {(r.row_key, r.evidence, r.aside) for r in got} == {("1", None, "ml"), ("2", None, "ml")}


def test_conversion_and_review(spark):
    rows = [(f"m{i}", f"{100 + i % 50 * 10}mg", None, None, None) for i in range(300)] + [(f"i{i}", f"{100000 + i % 7 * 1000} IU", None, None, None) for i in range(100)]
    rows += [(f"v{i}", f"{100 + i % 15 * 30}ml", None, None, None) for i in range(15)]
    rows += [("bare", "250", None, None, None), ("told", "250", "đơn vị ml", None, None), ("told", "250", "đơn vị ml", None, None)]
    got = {r.row_key: r for r in convert(read(spark, rows), ["t"]).collect()}
    assert (got["bare"].status, got["bare"].unit, got["bare"].amount) == ("predicted", "ug", 250000)
    assert (got["told"].status, got["told"].unit, got["told"].amount, got["told"].evidence) == ("predicted", "ul", 250000, "ml")
    assert len(got) == 417


def test_the_model_alone_decides(spark, monkeypatch):
    """Learned the other way round, bare numbers have the other unit, whatever their neighbours say."""
    rows = [(f"m{i}", f"{100 + i % 50 * 10}mg", None, None, None) for i in range(300)] + [(f"v{i}", f"{100 + i % 50 * 10}ml", None, None, None) for i in range(300)]
    rows += [("told", "250", "đơn vị mg", None, None)]
    parsed = read(spark, rows)
    flip = F.when(F.col("written") == "mg", "ml").when(F.col("written") == "ml", "mg")
    turned = parsed.withColumn("evidence", F.when(F.col("written").isNotNull(), F.col("written")).otherwise(F.col("evidence"))).withColumn("written", flip)
    straight, other = (convert(p, ["t"]).where("row_key = 'told'").first() for p in (parsed, turned))
    assert straight.unit == "ug" and other.unit != "ug"


def test_without_labels_everything_goes_to_review(spark):
    got = convert(read(spark, [("a", "250", None, None, None)]), ["t"]).collect()
    assert [(r.status, r.unit) for r in got] == [("review", None)]
    assert convert(read(spark, []), ["t"]).count() == 0


def test_unit_model_on_held_out_rows(spark, data):
    """The prediction alone, evidence hidden, against written units of rows it was not fitted on."""
    from medloom.operators.units import predict_units
    from medloom.runtime import table

    folder = data.replace("sf0.001", "sf0.01")
    parsed = read_quantities(table(spark, folder, "prescription_plan_drugs"), "prescription_plan_drugs", "id", "dosage", named=("notes",))
    test = F.pmod(F.xxhash64("row_key", "part_no"), F.lit(5)) == 0
    hidden = parsed.where(test & F.col("written").isNotNull()).withColumns({"unit": F.lit(None).cast("string"), "evidence": F.lit(None).cast("string")})
    both = parsed.where(~test & F.col("unit").isNotNull()).unionByName(hidden.withColumns({"truth": F.col("written"), "written": F.lit(None).cast("string")}).drop("truth"))
    truth = hidden.select("row_key", "part_no", F.col("written").alias("truth"))
    scored = predict_units(both, ["prescription_plan_drugs"]).join(truth, ["row_key", "part_no"])
    sure = scored.where("confidence >= 0.9")
    assert sure.count() > 0
    assert sure.where("predicted = truth").count() >= 0.9 * sure.count()


def test_found(spark, data):
    df = units.p5_found(spark, data)
    assert df.columns == ["tbl", "row_key", "part_no", "unit", "amount"]
    assert df.count() == df.distinct().count() > 0
    assert {r.unit for r in df.select("unit").distinct().collect()} <= {"ug", "ul", "iu", "ug/ml", "iu/ml"}
