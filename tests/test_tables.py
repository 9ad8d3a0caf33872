"""Tables, parts, payloads and sinks on small cases."""

import pytest
from pyspark.sql import functions as F

from medlattice.operators import ingest, parts, scanned, sinks, tables
from medlattice.sources import payload
from medlattice.sources.snapshots import Conflict, Snapshots

ROWS = "array<array<string>>"


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_header_scores(spark):
    rows = [(1, 0, ["Report of May", ""]), (1, 1, ["S. No.", "Name of drug", "Batch", "Reason"]), (1, 2, ["1.", "Aspirin", "B-1", "failed", ""]), (2, 0, ["x"]), (3, 0, ["drug name", "drug name"]), (3, 1, ["name", "batch"])]
    df = spark.createDataFrame(rows, "t int, idx int, cells array<string>")
    out = {r.t: (r.idx, r.header, r.first_row) for r in tables.best_header(df, "t", tables.table_header_score(F.col("cells")), 12).collect()}
    assert out == {1: (1, ["S. No.", "Name of drug", "Batch", "Reason"], ["1.", "Aspirin", "B-1", "failed"]), 3: (0, ["drug name", "drug name"], ["name", "batch"])}
    text = {r.t: r.idx for r in tables.best_header(df, "t", tables.paragraph_header_score(F.col("cells")), 10).collect()}
    assert text == {1: 1, 3: 0}


def test_carried_headers_and_gates(spark):
    made = [(1, 0, [["Report"], ["S. No.", "Product", "Batch"], ["1", "a", "b"]]), (1, 1, [["s no", "product", "batch no"], ["2", "c", "d"]]), (1, 2, [["3", "e", "f"]]), (1, 3, [])]
    out = {r.position: (r.header, r.data) for r in tables.carried_headers(spark.createDataFrame(made, f"doc int, position int, rows {ROWS}"), "doc").collect()}
    header = ["S. No.", "Product", "Batch"]
    assert out == {0: (header, [["1", "a", "b"]]), 1: (header, [["2", "c", "d"]]), 2: (header, [["3", "e", "f"]])}
    t = lambda rows: F.array(*[F.array(*map(F.lit, r)) for r in rows])
    r = one(spark, tables.is_table(t([["a", "b"], ["c", "d"]])), tables.is_table(t([["a", ""], ["c", "d"]])), tables.is_text_table(t([["a", "b"]] * 3)), tables.is_text_table(t([["End.", "b"], ["a", "b"], ["a", "b"]])), tables.is_text_table(t([["a", "x" * 201]] * 3)))
    assert list(r) == [True, False, True, False, False]


def test_json_profile(spark):
    got = [tuple(one(spark, tables.json_profile(F.lit(b)))[0] or ()) for b in ('{"a": [{}], "rows": []}', '["x", 1]', "null", "{")]
    assert got == [("object", "a|rows", "a|rows", 1, "object", "object-with-record-arrays"), ("array", "", "", 2, "value", "value-array"), ("null", "", "", 0, "", "json-scalar"), ()]


def test_english_blocks_and_signals(spark):
    r = one(spark, parts.english_block(F.lit("Take  two दवा\n\n daily ")), parts.english_block(F.lit("दवा दवा two")), parts.english_block(F.lit("12")), parts.is_boilerplate(F.lit("Page 3 of 9")), parts.is_boilerplate(F.lit("a page that speaks of many things")))
    assert r[0] is None or r[0] == "Take two\ndaily"
    assert r[1] is None and r[2] is None and r[3] and not r[4]
    s = one(spark, parts.field_signals(F.lit("Product name: X tablet. Batch No 12; recall."), F.lit("12")))[0].asDict()
    assert {k for k, v in s.items() if v} == {"product_name", "batch_no", "specific_batch", "specific_product", "action_verb", "specific_action"}


def test_signals_of_folded_words(spark):
    said = lambda t, b=None: {k for k, v in one(spark, parts.field_signals(F.lit(t), F.lit(b)))[0].asDict().items() if v}
    assert "alert_format" in said("Suspected drug X caused an adverse reaction in patients.")
    assert {"batch_no", "specific_batch", "action_verb", "specific_action"} <= said("BatchNo12 tablet recall")
    assert "operative_prohibition" in said("Pröhibited") and "suspected_drug" in said("SuspectedDrug")
    assert said(None) == said("") == set() and said("", "7") == {"batch_no", "specific_batch"}
    assert one(spark, parts.is_boilerplate(F.lit("Püblished by theController")), parts.is_boilerplate(F.lit("pageOf of 3")))[0]


def test_quality_window_is_computed_from_the_text(spark):
    text = "Product name X tablet, batch no 9, manufactured by Y, failed in assay"
    far = text.replace(", failed", " far" * 60 + ", failed")
    late = "x" * 480 + text
    found = [one(spark, parts.quality_window(F.lit(t), parts.field_signals(F.lit(t))))[0] for t in (text, far, late, text.replace("batch no 9", ""), "", None)]
    assert found == [True, False, False, False, False, False]
    assert one(spark, *[parts.batch_of(F.lit(t)) for t in ("Lot No. AB-1/2 x", "B. No: 7", "batch 7", None)]) == ("AB-1/2", "7", None, None)


def test_archetypes_need_their_least_and_types_override(spark):
    table = {"A": ("batch no", "s no"), "B": ("batch no", "nsq result")}
    assert one(spark, *[scanned.archetype(F.lit(t), table, 2) for t in ("S. No Batch No", "batch no, NSQ-Result", "batch no", None)]) == ("A", "B", None, None)
    assert one(spark, *[scanned.product_type(F.lit(t)) for t in ("Remote-Controller", "a vet", "vets", "Animal use of stents", "cosmetics", None)]) == ("device", "veterinary", "medicine", "veterinary", "cosmetic", "medicine")


def test_same_window(spark):
    near, far = F.lit("batch 1 recall"), F.lit("batch 1 " + "x " * 120 + "recall")
    assert list(one(spark, parts.same_window(near, (parts.BATCH, parts.ACTION)), parts.same_window(far, (parts.BATCH, parts.ACTION)), parts.same_window(F.lit("recall"), (parts.BATCH, parts.ACTION)))) == [True, False, False]


def test_payloads(spark):
    def broken(content):
        raise ValueError("no such format")

    files = spark.createDataFrame([("a", bytearray(b"hello\fx\ty\n\f")), ("b", None)], "path string, content binary")
    out = {(r.path, r.page): (r.type, r.text, r.tables) for r in payload.payloads(files).collect()}
    assert out == {("a", 1): ("text", "hello", []), ("a", 2): ("table", "", [[["x", "y"]]]), ("a", 3): ("empty", "", []), ("b", 1): ("empty", "", [])}
    assert {(r.path, r.type, r.error) for r in payload.payloads(files, broken).collect()} == {(p, "failed", "ValueError: no such format") for p in "ab"}


def test_api_records(spark):
    files = spark.createDataFrame([("a", '{"aaData": [{"x": 1}, 3, null]}'), ("b", '{"aaData": 4}'), ("c", None), ("d", "[]")], "path string, content string")
    out = [(r.path, r.record, r.error is None) for r in payload.api_records(files).orderBy("path").collect()]
    assert out == [("a", {"x": "1"}, True), ("b", None, False), ("c", None, False), ("d", None, False)]


def failing(spark):
    """A DataFrame whose writer fails in its tasks."""
    return spark.range(5).select(F.when(F.col("id") < 9, F.raise_error(F.lit("writer died")).cast("long")).alias("id"))


def counts(spark, folder, version=None):
    store = Snapshots(spark, folder)
    return {n: store.read(n, version).count() for n in store.parts(version)}


def test_replace_is_checked_first(spark, tmp_path):
    rows, none = {"a": spark.range(3), "b": spark.range(2)}, spark.createDataFrame([], "f string")
    with pytest.raises(PermissionError):
        sinks.replace_all(rows, str(tmp_path), none, False, rows)
    with pytest.raises(ValueError):
        sinks.replace_all(rows, str(tmp_path), spark.createDataFrame([("x",)], "f string"), True, rows)
    assert not list(tmp_path.iterdir())
    assert sinks.replace_all(rows, str(tmp_path), none, True, rows) == [("a", 0, 3), ("b", 0, 2)]
    assert sinks.replace_all({"a": spark.range(1), "b": spark.range(1)}, str(tmp_path), none, True, rows) == [("a", 3, 1), ("b", 2, 1)]
    assert counts(spark, str(tmp_path)) == {"a": 1, "b": 1} and counts(spark, str(tmp_path), 1) == {"a": 3, "b": 2}


def test_failed_writer_and_failed_swap_leave_all_relations(spark, tmp_path, monkeypatch):
    none, folder = spark.createDataFrame([], "f string"), str(tmp_path)
    rows = {"a": spark.range(3), "b": spark.range(2)}
    sinks.replace_all(rows, folder, none, True, rows)
    with pytest.raises(Exception, match="writer died"):
        sinks.replace_all({"a": spark.range(7), "b": failing(spark)}, folder, none, True, rows)
    assert counts(spark, folder) == {"a": 3, "b": 2}

    def lost(self, beside, pointer):
        raise OSError("store is gone")

    with monkeypatch.context() as m:
        m.setattr(Snapshots, "_swap", lost)
        with pytest.raises(OSError):
            sinks.replace_all({"a": spark.range(7), "b": spark.range(7)}, folder, none, True, rows)
    store = Snapshots(spark, folder)
    assert counts(spark, folder) == {"a": 3, "b": 2} and store.versions() == [1]
    assert not [n for n in store._names("versions") if not n.endswith(".json")]
    assert len(store.vacuum()) == 2 and counts(spark, folder) == {"a": 3, "b": 2}
    assert sinks.replace_all({"a": spark.range(7)}, folder, none, True, ["a"]) == [("a", 3, 7)] and counts(spark, folder) == {"a": 7}


def test_two_writers_and_old_versions(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    assert store.current() == 0 and store.parts() == {} and store.read("a") is None and store.vacuum() == []
    first, second = (store.write(t, "a", spark.range(n)) for t, n in (("t1", 1), ("t2", 2)))
    assert store.publish({"a": [first]}, 0) == 1
    with pytest.raises(Conflict):
        store.publish({"a": [second]}, 0)
    assert store.read("a").count() == 1 and store.publish({"a": [first, second]}, 1) == 2
    assert store.read("a").count() == 3 and store.read("a", 1).count() == 1
    store.replace({"a": spark.range(9)})
    assert store.vacuum(1) and store.versions() == [3] and store.read("a").count() == 9


def test_rewrite_reads_its_own_table(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.stored(spark, path) is None and sinks.rewrite(spark.range(4), path, "x") is None
    backup = sinks.rewrite(sinks.stored(spark, path).filter("id > 1"), path, "y")
    assert sinks.stored(spark, path).count() == 2 and sinks.stored(spark, path, backup).count() == 4
    with pytest.raises(Exception, match="writer died"):
        sinks.rewrite(failing(spark), path, "z")
    assert sinks.stored(spark, path).count() == 2


def test_load_twice_adds_nothing(spark, tmp_path):
    products = spark.createDataFrame([("p1", "A"), ("p2", "B")], "product_key string, product_name string")
    batches = spark.createDataFrame([("b1", "p1"), ("b2", "p2"), ("b3", "gone")], "batch_key string, product_key string")
    folder = str(tmp_path)
    assert ingest.load({"products": products, "batches": batches}, folder) == {"products": 2, "batches": 3}
    assert ingest.load({"products": products, "batches": batches}, folder) == {"products": 0, "batches": 0}
    assert Snapshots(spark, folder).versions() == [1]
    more = products.unionByName(spark.createDataFrame([("p3", "C")], products.schema))
    assert ingest.load({"products": more}, folder) == {"products": 1}
    stored = ingest.loaded(spark, folder, "products")
    assert stored.select("id").distinct().count() == 3
    ids = {r.product_key: r.id for r in stored.collect()}
    assert {r.batch_key: r.product_key_id for r in ingest.loaded(spark, folder, "batches").collect()} == {"b1": ids["p1"], "b2": ids["p2"], "b3": None}
    # a load that dies at its second relation adds nothing to the first
    lost = failing(spark).select(F.col("id").cast("string").alias("batch_key"), F.lit("p1").alias("product_key"))
    again = more.unionByName(spark.createDataFrame([("p4", "D")], products.schema))
    with pytest.raises(Exception, match="writer died"):
        ingest.load({"products": again, "batches": lost}, folder)
    assert ingest.loaded(spark, folder, "products").count() == 3
    new = spark.createDataFrame([("b4", "p4")], batches.schema)
    assert ingest.load({"products": again, "batches": new}, folder) == {"products": 1, "batches": 1}
    by_key = {r.product_key: r.id for r in ingest.loaded(spark, folder, "products").collect()}
    assert ingest.loaded(spark, folder, "batches").filter("batch_key = 'b4'").first().product_key_id == by_key["p4"] and len(set(by_key.values())) == 4


def test_dead_clients_are_dropped():
    got = []

    def gone(_):
        raise ConnectionError

    clients = {"a": got.append, "b": gone}
    assert sinks.deliver(["x", "y"], clients) == ["b"] and got == ["x", "y"] and list(clients) == ["a"]


def test_entities_are_judged_by_their_own_place(spark):
    from medlattice.operators import classify

    text = "AB1234 " + "x" * 60 + " CD5678 batch"
    e = one(spark, classify.entities(F.lit(text)), classify.entities(F.lit("éAB1234 batch Acme Pharma ibuprofen")), classify.entities(F.lit(None).cast("string")))
    assert e[0].batches == ["CD5678"] and e[1].batches == [] and e[1].makers == ["Acme Pharma"] and e[1].drugs == ["ibuprofen"] and e[2].batches == []


def test_lexicon_of_long_and_nested_names(spark):
    from medlattice.operators import classify

    names = spark.createDataFrame([("a b c d e f g h",), ("c d",), ("z",)], "name string")
    docs = spark.createDataFrame([(1, "x A b c d, e f g h y"), (2, "c d z"), (3, None), (4, "")], "doc_id long, text string")
    assert sorted((r.doc_id, r.name) for r in classify.lexicon_matches(docs, names).collect()) == [(1, "a b c d e f g h"), (2, "c d"), (2, "z")]
