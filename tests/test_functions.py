"""Values that functions must give, re-created from the meaning of the inputs."""

import datetime

import pytest
from pyspark.sql import functions as F

from medlattice.functions import codes, dates, fuzzy, keys, nested, records, text


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def lit(x):
    return F.lit(x)


def test_canonical_drops_suffixes_and_punctuation(spark):
    r = one(spark, text.canonical(lit("  Acme Labs Pvt. Ltd., Unit-2 ")), text.canonical(lit(None).cast("string")), text.canonical(lit("")))
    assert list(r) == ["acme labs unit 2", "", ""]


def test_organization_and_address(spark):
    r = one(spark, text.organization_and_address(lit("M/s. Sun Pharma, D- 1651, Some Road")).alias("a"), text.organization_and_address(lit("Alpha, Beta Labs")).alias("b"), text.organization_and_address(lit("")).alias("c"))
    assert (r.a.name, r.a.address) == ("Sun Pharma", "D- 1651, Some Road")
    assert (r.b.name, r.b.address) == ("Alpha, Beta Labs", "")
    assert (r.c.name, r.c.address) == ("", "")


def test_combined_batch_cell(spark):
    b = one(spark, text.batch_details(lit("B.No: RT220651 Mfg Date 08/2022 Exp date: 07/2024 Mfd by: Acme Labs, Pune")).alias("b")).b
    assert tuple(b) == ("RT220651", "08/2022", "07/2024", "Acme Labs, Pune")


def test_formulation(spark):
    r = one(spark, text.formulation(lit("Paracetamol Tablets IP 500 mg")).alias("a"), text.formulation(lit("Drug A + Drug B")).alias("b"), text.formulation(lit("Tablets")).alias("c"), text.formulation(lit(None).cast("string")).alias("d"))
    assert [i.name for i in r.a.ingredients] == ["Paracetamol"] and r.a.dosage_form == "TABLETS" and r.a.strength == "500 mg"
    assert [(i.name, i.strength) for i in r.b.ingredients] == [("Drug A", ""), ("Drug B", "")]
    assert r.c.ingredients == [] and r.d.ingredients == []


@pytest.mark.parametrize("value,cas", [("CAS 103-90-2 pure", "103-90-2"), ("unknown", ""), (None, "")])
def test_cas(spark, value, cas):
    assert one(spark, text.cas_number(lit(value).cast("string")))[0] == cas


def test_notification_repairs_product(spark):
    r = one(spark, text.product_with_notification(lit(""), lit("3) Nimesulide S.O. 123(E)")), text.product_with_notification(lit("X"), lit("")), text.product_with_notification(lit("Nimesulide"), lit("Nimesulide G.S.R. NO. 5")))
    assert list(r) == ["Nimesulide", "X", "Nimesulide"]


@pytest.mark.parametrize("value,loaded,strict", [("2024-02-29", datetime.date(2024, 2, 29), datetime.date(2024, 2, 29)), ("2024-02-31", None, None), ("08/2022", datetime.date(2022, 8, 1), None), ("2022/08", datetime.date(2022, 8, 1), None), ("31/02/2020", None, None), ("15-03-2021", datetime.date(2021, 3, 15), datetime.date(2021, 3, 15)), ("exp 07/2024 approx", datetime.date(2024, 7, 1), None), ("1/2/2020", datetime.date(2020, 2, 1), None), ("", None, None), ("13/2020", None, None)])
def test_stored_dates(spark, value, loaded, strict):
    r = one(spark, dates.load_date(lit(value)), dates.strict_date(lit(value)))
    assert (r[0], r[1]) == (loaded, strict)


@pytest.mark.parametrize("value,day", [("2022-Jan-05", datetime.date(2022, 1, 5)), ("2022-JANUARY-05", datetime.date(2022, 1, 5)), ("May 2021", datetime.date(2021, 5, 1)), ("MAY 2021", datetime.date(2021, 5, 1)), ("03/2020", datetime.date(2020, 3, 1)), ("2019", datetime.date(2019, 1, 1)), ("soon", None)])
def test_release_dates(spark, value, day):
    assert one(spark, dates.release_date(lit(value)))[0] == day


def test_periods_and_times(spark):
    r = one(spark, dates.period_of_file(lit("nsq_May_2022.json")).alias("a"), dates.period_of_file(lit("x.json")).alias("b"), F.date_format(dates.utc_time(lit("2024-01-01T10:00:00+05:30")), "HH:mm").alias("c"), dates.barcode_date(lit("250500")).alias("d"), dates.barcode_date(lit("991231")).alias("e"), dates.month_or_text(lit("Mar 2020")).alias("f"), dates.month_or_text(lit("x")).alias("g"))
    assert tuple(r.a) == ("2022-05-01", "May 2022") and tuple(r.b) == ("", "")
    assert (r.c, r.d, r.e, r.f, r.g) == ("04:30", "2025-05", "1999-12-31", "2020-03-01", "x")


def test_keys_change_only_with_their_parts(spark):
    k = lambda n: keys.batch_key(lit("p"), lit("o"), lit(n))
    r = one(spark, k("B 1"), k("b-1"), k("B 2"), keys.organization_key(lit("Acme Ltd"), lit("Goa")), keys.organization_key(lit("ACME"), lit("goa")), keys.organization_key(lit("Acme"), lit("")))
    assert r[0] == r[1] != r[2] and r[3] == r[4] != r[5]


def test_source_record_id(spark):
    assert one(spark, keys.source_record_id(lit("d"), lit(0), lit(2), lit("abcdef012345"), lit(1)))[0] == "d:P01:T02:abcdef01:01"


def test_codes(spark):
    r = one(spark, codes.gtin14(lit("4006381333931")), codes.gtin14(lit("4006381333932")), codes.decoded_number(F.base64(lit("123").cast("binary"))), codes.decoded_number(lit("!!")), codes.bracketed_elements(lit("(01)04006381333931(10)AB12(17)250500")), codes.element_string(lit("010400638133393110AB12\x1d17250500")))
    assert r[0] == "04006381333931" and r[1] is None and r[2] == 123 and r[3] is None
    assert r[4] == {"01": "04006381333931", "10": "AB12", "17": "250500"}
    assert [(e.id, e.value) for e in r[5]] == [("01", "04006381333931"), ("10", "AB12"), ("17", "250500")]


def test_similarities():
    assert 0.6 < fuzzy.word_similarity_of("paracetmol", "Paracetamol 500 mg") < 0.8
    assert fuzzy.word_similarity_of("", "x") == 0
    assert fuzzy.word_similarity_of("word", "two words") == pytest.approx(0.8)
    assert fuzzy.indel_ratio_of("abc", "abd") == pytest.approx(66.6667, abs=1e-3)
    assert fuzzy.token_sort_ratio_of("b a", "a b") == 100


def test_json_repair(spark):
    r = one(spark, nested.repaired_json(lit("{source: aws.ecs, detail: {status: RUNNING, n: 3}}")), nested.repaired_json(lit("{'a': None, 'b': True}")), nested.repaired_json(lit("nonsense")), nested.first_json_object(lit('x {bad {"a": "}"} z')))
    assert r[0] == '{"detail": {"n": 3, "status": "RUNNING"}, "source": "aws.ecs"}'
    assert r[1] == '{"a": null, "b": true}' and r[2] is None and r[3] == '{"a": "}"}'


def test_run_ids(spark):
    r = one(spark, nested.run_id(lit("aws.ecs"), lit('{"containers":[{"command":["--x","1","--run-id","r7"]}]}')), nested.run_id(lit("aws.states"), lit('{"input":"{\\"run_id\\":\\"r8\\"}"}')), nested.run_id(lit("aws.states"), lit('{"executionArn":"a:b:r9"}')), nested.run_id(lit("other"), lit("{}")))
    assert list(r) == ["r7", "r8", "r9", None]


def test_field_tiers(spark):
    m = F.create_map(lit("Dru g Name"), lit(" Aspirin "), lit("BATCH NO"), lit("B1"), lit("Name of maker firm"), lit("Acme"), lit("empty"), lit(" "))
    e = m
    r = one(spark, records.field(e, ["drug name"]), records.field(e, ["batch no"]), records.field(e, ["maker"]), records.field(e, ["empty"]), records.field(e, ["drug name"], loose=False))
    assert list(r) == ["Aspirin", "B1", "Acme", "", ""]
    # names decide between exact keys, a blank value gives way, and loose fits come last
    m = F.create_map(lit("batch"), lit(" "), lit("lot no"), lit("L7"), lit("batch no"), lit("B2"), lit("x batch x"), lit("B3"))
    r = one(spark, records.field(m, ["batch no", "batch", "lot no"]), records.field(m, ["batch", "lot no"]), records.field(m, ["batch"]), records.candidates(F.map_keys(m), ["batch"]))
    assert list(r) == ["B2", "L7", "B2", ["batch", "batch no", "x batch x"]]


def test_records_of(spark):
    r = one(spark, records.records_of(lit('{"a":1,"rows":[{"x":"1"},{"x":2}]}')), records.records_of(lit('[{"x":"1"}]')), records.records_of(lit('{"x":"1"}')))
    assert r[0] == [{"x": "1"}, {"x": "2"}] and r[1] == [{"x": "1"}] and r[2] == [{"x": "1"}]


def test_plain_texts_skip_the_patterns(spark):
    """What the shortcuts tell to be plain gives what the patterns give."""
    for t, name in (("acme labs", "acme labs"), ("co", ""), ("acme co", "acme"), ("co op", "op"), ("cold ring", "cold ring"), ("a  b ", "a b"), ("9", "9")):
        assert one(spark, text.canonical(lit(t)).alias("c")).c == name, t
    for t, name in (("Supplier#01", "Supplier#01"), ("M/s Acme", "Acme"), ("Acme batch no 4", "Acme"), ("A  B", "A B"), ("", "")):
        assert tuple(one(spark, text.organization_and_address(lit(t)).alias("c")).c) == (name, ""), t
    for t, items, form in (("large ring", ["large ring"], ""), ("ring syrup", ["ring"], "SYRUP"), ("ring and bolt", ["ring", "bolt"], ""), ("ring 5 mg", ["ring"], ""), ("500", [], "")):
        r = one(spark, text.formulation(lit(t)).alias("c")).c
        assert ([i.name for i in r.ingredients], r.dosage_form) == (items, form), t


def test_trim_space_leaves_only_the_middle(spark):
    assert list(one(spark, text.trim_space(lit(" \t\n\x0b\f\r a  b  \n")), text.trim_space(lit("  ")))) == ["a  b", ""]


def test_plain_texts_of_any_length(spark):
    """Java's matcher took a frame of its stack for each word of a plain text, and died of it."""
    long = " ".join(f"w{i}" for i in range(100_000))
    r = one(spark, text.canonical(lit(long)).alias("a"), text.organization_and_address(lit(long)).alias("b"), text.formulation(lit(long)).alias("c"), text.canonical(lit(long + " ")).alias("d"), text.canonical(lit(long + " co")).alias("e"))
    assert r.a == r.d == r.e == long and r.b.name == long and [i.name for i in r.c.ingredients] == [long]
