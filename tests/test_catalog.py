"""Registered queries: the contract's functions, SQL agreement on small tables, and streams."""

import os
import re

import pytest
from pyspark.sql import functions as F

from medlattice.plans import catalog
from medlattice.streaming import events

DATA = "/root/testdata/sf0.001"
SOME = ["T01_ranked_search", "R16_safety_assessment", "J02_product_graph", "W16_node_states", "W17_status_feed", "X06_approvals", "A10_keyword_score", "J16_lexicon_containment", "U02_except_intersect", "F07_formulation", "P03_alert_columns", "A20_covered_area", "R08_completed_verdict"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test data")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in os.listdir(DATA):
        c.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{t}'")
    got = catalog.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = c.sql(f"SELECT {', '.join(chr(34) + x + chr(34) for x in columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    norm = lambda rows: sorted([tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows])
    assert norm(got.select(*columns).collect()) == norm(want) and want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test data")
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_is_consumed_once(spark, tmp_path):
    rows = [("1", '{"source": "aws.states", "time": "2024-01-01T00:00:00Z", "detail": {"status": "RUNNING"}}', 1), ("2", "{source: aws.ecs}", 1), ("3", "@@", 3)]
    messages = spark.createDataFrame(rows, "message_id string, body string, attempts int")
    for i in range(2):  # the same messages arrive twice
        messages.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    parsed = events.parsed(events.file_stream(spark, str(tmp_path / "in"), messages.schema))
    good, _, dropped = events.split_poison(events.parsed(messages))
    assert [r.event_id for r in dropped.collect()] == ["3"]
    seen = []
    for _ in range(2):
        q = events.consume(parsed.filter("not bad"), str(tmp_path / "out"), str(tmp_path / "cp"), lambda df: seen.append(df.count()))
        q.awaitTermination(60)
    out = spark.read.parquet(str(tmp_path / "out")).select("event_id", "event_type").collect()
    assert sorted(map(tuple, out)) == [("1", "sfn.state_change"), ("2", "ecs.task_state_change")] and good.count() == 2


def test_windowed_counts_and_replay(spark):
    e = spark.createDataFrame([(i, f"2024-01-01 0{i % 3}:10:00", "k") for i in range(6)], "event_id int, t string, event_type string").withColumn("event_time", F.to_timestamp("t")).drop("t")
    assert {r.n for r in events.windowed_counts(e).collect()} == {2}
    assert events.replay_then_live(e, e, 2).groupBy("kind").count().count() == 2


TEXTS = [
    (1, "en", "Acme Pvt. Ltd., Goa " + "and more of it " * 60 + "Last Company"), (2, "fr", "Caféco ltd Éco co² CO. Résumé d’été camelCase œuvre"), (3, "de", "Straße GROẞ\u00a0GmbH ﬁne co\u0301 İstanbul ²½ Ｔｅｓｔ"), (4, None, "Null lang, limited"), (5, "en", None), (6, "es", ""),
    (7, "fr", "Médecin ing. läuft\u00a0ING x²  ing and naïve ing, naïve\ting; _ ing being"),
]


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("texts"))
    rows = [(i, lang, "s", t) for i, lang, t in TEXTS]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.parquet(f"{folder}/documents.parquet")
    return folder


def by_id(df, column):
    return {r.doc_id: r[column] for r in df.collect()}


def test_canonical_of_whole_texts(spark, texts):
    def canonical(t):
        t = re.sub(r"\b(pvt|private|ltd|limited|inc|corp|corporation|co|company)\b\.?", "", (t or "").lower().strip())
        return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", t)).strip()

    assert by_id(catalog.QUERIES["F01_canonical"](spark, texts), "canonical") == {i: canonical(t) for i, _, t in TEXTS}


def test_words_tokens_and_entities_of_all_documents(spark, texts):
    import unicodedata

    def folded(t):
        t = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", t or "")
        return re.sub(r"[^a-z0-9]+", " ", unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode("ascii").casefold()).strip()

    def makers(t):
        return len({m.group().strip() for m in re.finditer(r"\b\w+\s+ing\b", re.sub(r"\s+", " ", t or "").strip(), re.IGNORECASE)})

    def whole(name, column):
        return by_id(catalog.QUERIES[name](spark, texts), column)

    assert whole("F02_normalized_words", "words") == {i: " ".join(re.findall("[a-z0-9]+", (t or "").casefold())) for i, _, t in TEXTS}
    assert whole("F03_folded_words", "words") == {i: folded(t) for i, _, t in TEXTS}
    assert whole("F19_content_tokens", "tokens") == {i: len(set(re.findall("[a-z0-9]{3,}", (t or "").lower()))) for i, _, t in TEXTS}
    assert whole("A11_entities", "makers") == {i: makers(t) for i, _, t in TEXTS}


def test_case_folds_are_all_that_give_ascii():
    import sys

    from medlattice.functions.text import CASE_FOLDS

    ascii_of = lambda t: re.findall("[a-z0-9]", t)
    odd = {c for c in map(chr, range(128, sys.maxunicode + 1)) if ascii_of(c.casefold()) != ascii_of(c.lower())}
    assert odd == {c for c in CASE_FOLDS} and all(ascii_of(CASE_FOLDS[c]) == ascii_of(c.casefold()) for c in odd)


def test_sequence_records_keep_whole_turns(spark, tmp_path):
    turns = [" ".join(f"t{chr(97 + t)}w" + "x" * (i % 7) for i in range(40)) + "\nlast line" for t in range(3)]
    spark.createDataFrame([(1, t, "user", x) for t, x in enumerate(turns)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = sorted((r.number, r.name, r.detail) for r in catalog.QUERIES["W09_sequence_records"](spark, str(tmp_path)).collect())
    joined = [t.replace("\n", " ") for t in turns]
    assert out == [(4, joined[0], ""), (5, joined[1], "GSR 578 Dated 3 . 05 . 20 04"), (6, f"{joined[2]} and others", "")]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test data")
@pytest.mark.parametrize("name", ["T05_date_then_id", "S21_key_lookup"])
def test_every_order_has_a_row(spark, name):
    test_query_equals_its_sql(spark, name)
    assert catalog.QUERIES[name](spark, DATA).count() == spark.read.parquet(f"{DATA}/orders.parquet").count()


def test_orders_without_a_date_come_last(spark, tmp_path):
    rows = [(k, "P" if k % 3 == 0 else "O", f"2024-01-0{k % 4 + 1}") for k in range(1, 901)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string, o_orderdate string").write.parquet(f"{tmp_path}/orders.parquet")
    got = [r.o_orderkey for r in catalog.QUERIES["T05_date_then_id"](spark, str(tmp_path)).orderBy("position").collect()]
    dated = sorted((r for r in rows if r[1] == "O"), key=lambda r: (-int(r[2][-1]), r[0]))
    assert got == [r[0] for r in dated] + [r[0] for r in rows if r[1] == "P"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test data")
def test_raw_records_get_all_checks(spark):
    test_query_equals_its_sql(spark, "A31_raw_record_checks")
    found = {(r.check_name, r.detail) for r in catalog.QUERIES["A31_raw_record_checks"](spark, DATA).collect()}
    assert found >= {("empty", "source_location"), ("empty", "raw_json"), ("duplicate", "source_record_id"), ("json", "invalid"), ("json", "neither object nor array")}


def test_first_batch_itself_is_exact(spark, tmp_path):
    """The SQL calls a product exact that has batch B-1-1, also where the data has that batch."""
    from pyspark.sql import functions as F

    from medlattice.plans import catalog

    for name in ("part", "supplier", "nation", "region", "lineitem"):
        df = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        if name == "lineitem":
            df = df.filter("l_orderkey > 1").unionByName(df.limit(3).withColumn("l_orderkey", F.lit(1).cast("long")).withColumn("l_partkey", F.lit(7).cast("long")).withColumn("l_linenumber", F.lit(1)))
            df = df.unionByName(df.limit(1).withColumn("l_orderkey", F.lit(1).cast("long")).withColumn("l_partkey", F.lit(9).cast("long")).withColumn("l_linenumber", F.lit(2)))
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    rows = {r.id: (r.relevance, r.match_type) for r in catalog.QUERIES["J03_batch_existence"](spark, str(tmp_path)).collect()}
    assert rows == {7: (95, "EXACT"), 9: (80, "PARTIAL")}
