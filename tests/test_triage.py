from __future__ import annotations

import json
from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from shelfwatch.operators import lineage, triage
from shelfwatch.session import scratch_path, shared_dir


def one(spark, column, **values):
    """Value of an expression over one row of literals."""
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("message", "category"),
    [
        ("Binder Error: Referenced column customer_segment not found", "schema_change"),
        ("Parser Error: syntax error at or near SELEC", "sql_compilation"),
        ("IO Error: file is LOCKED", "infrastructure"),
        ("Env var required but not provided: 'X'", "config_error"),
        ("Got 2 results, configured to fail if != 0", "dbt_test_failure"),
        ("MERGE failed on fct_orders: duplicate key order_id", "dependency_error"),
        ("Conversion Error: could not convert", "data_error"),
        ("nothing known", "unknown"),
        ("", "unknown"),
        (None, "unknown"),
    ],
)
def test_error_category(spark, message, category):
    column = triage.error_category(F.col("m").cast("string"))
    assert one(spark, column, m=message) == category


def test_run_results_document(spark, tmp_path):
    document = {
        "args": {"invocation_command": "build"},
        "results": [
            {"unique_id": "test.shop.unique_id", "status": "fail", "message": "Got 2 results, configured to fail if != 0"},
            {"unique_id": "model.shop.ok", "status": "success", "message": None},
            {
                "unique_id": "model.shop.int_orders",
                "status": "error",
                "message": "Binder Error: Referenced column x not found (models/int/int_orders.sql)",
            },
        ],
    }
    (tmp_path / "run_results.json").write_text(json.dumps(document, indent=2))
    runs = triage.read_json_documents(spark, str(tmp_path), triage.RUN_RESULTS).withColumn("run_id", F.lit(1))
    nodes = triage.failed_nodes(runs)
    found = nodes.select("command_executed", "position", "node_type", "node_name", "file_path").collect()
    assert [tuple(r) for r in found] == [
        ("dbt build", 0, "test", "unique_id", ""),
        ("dbt build", 2, "model", "int_orders", "models/int/int_orders.sql"),
    ]
    first = triage.prioritised(nodes, ["int_orders.sql"]).first()
    assert first["unique_id"] == "model.shop.int_orders"
    expected = spark.createDataFrame([(1, "schema_change"), (1, "test_failure")], "run_id int, error_type string")
    match = triage.classifications_match(nodes, expected).first()
    assert match["classifications_match"] and match["failure_count_match"]
    assert triage.primary_failures(nodes).first()["position"] == 0


def test_multisets_differ_in_multiplicity(spark):
    nodes = spark.createDataFrame(
        [(1, "syntax error"), (1, "syntax error"), (2, "syntax error")], "run_id int, error_message string"
    )
    expected = spark.createDataFrame(
        [(1, "compilation_error"), (2, "compilation_error"), (3, "data_error")], "run_id int, error_type string"
    )
    found = triage.classifications_match(nodes, expected)
    verdicts = {r.run_id: (r.classifications_match, r.failure_count_match) for r in found.collect()}
    assert verdicts == {1: (False, False), 2: (True, True), 3: (False, False)}
    assert rows(triage.eval_summary(found)) == [(3, 1, 1, 1)]


def test_untyped_expectations_count_but_name_no_class(spark):
    nodes = spark.createDataFrame([(1, "syntax error")], "run_id int, error_message string")
    expected = spark.createDataFrame([(1, "compilation_error"), (1, None)], "run_id int, error_type string")
    found = triage.classifications_match(nodes, expected).first()
    assert found["classifications_match"] and not found["failure_count_match"]


def test_single_class_with_hot_runs(spark):
    nodes = spark.createDataFrame(
        [(1, 0, "syntax error"), (1, 1, "file locked"), (2, 0, "")], "run_id int, position int, error_message string"
    )
    expected = spark.createDataFrame(
        [(1, "compilation_error"), (1, "infrastructure"), (2, "unknown"), (3, "x")], "run_id int, error_type string"
    )
    for hot in ((), (1,)):
        assert rows(triage.single_class_matches(nodes, expected, hot)) == [
            (1, "compilation_error", True), (1, "infrastructure", False), (2, "unknown", True), (3, "x", False)
        ]


def test_runs_without_a_failure_are_unknown(spark):
    nodes = spark.createDataFrame(
        [(1, 0, "m.a", "file locked"), (1, 1, "m.b", "syntax error"), (2, 0, "m.c", "syntax error")],
        "run_id int, position int, unique_id string, error_message string",
    )
    runs = spark.createDataFrame([(1,), (2,), (3,)], "run_id int")
    assert rows(triage.run_categories(runs, nodes)) == [
        (1, "m.a", "infrastructure", False), (2, "m.c", "sql_compilation", True), (3, None, "unknown", True)
    ]
    expected = spark.createDataFrame(
        [(1, "compilation_error"), (1, "infrastructure"), (2, "data_error"), (3, "unknown")], "run_id int, error_type string"
    )
    assert rows(triage.run_evaluation(nodes, expected)) == [
        (1, "infrastructure", True, True), (2, "sql_compilation", True, False), (3, "unknown", False, True)
    ]


def test_malformed_results_are_refused(spark):
    documents = spark.createDataFrame([('{"results": []}',), ('{"results": [',)], "document string")
    with pytest.raises(Exception, match="(?i)malformed"):
        triage.parsed_runs(documents, "document").collect()


def test_plain_text_failure(spark):
    logs = spark.createDataFrame(
        [(1, " \n "), (2, "Compilation Error\nEnv var required but not provided: X"), (3, "in model.shop.a-b (models/a.sql)\n")],
        "id int, text string",
    )
    found = triage.failed_nodes_from_text(logs, "id", "text").orderBy("id").collect()
    assert [(r.node_type, r.node_name, r.file_path) for r in found] == [
        ("unknown", "failure", ""),
        ("unknown", "failure", ""),
        ("model", "a-b", "models/a.sql"),
    ]
    assert found[0].error_message == triage.NO_TEXT
    assert found[1].error_message.startswith("Compilation Error")


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Source data issue: two late files", True),
        ("Checked.\r\n\t SOURCE-DATA correction is required", True),
        ("a\x0bConclusion:  source data issue: none", True),
        ("This is not a source data issue: the model is wrong", False),
        ("Conclusion: a bad join. Conclusion: source data issue: none", False),
        ("The model has a source data issue", False),
        ("Conclusion:\nsource data is fine", False),
        ("", False),
    ],
)
def test_source_data_conclusion(spark, text, expected):
    assert one(spark, triage.source_data_issue(F.col("t")), t=text) is expected


@pytest.mark.parametrize(
    ("text", "confidence", "human"),
    [
        ("Confidence: 0.85", 0.85, False),
        ("confidence 3", 0.95, False),
        ("CONFIDENCE: 0.01", 0.15, True),
        ("confidence: 1.2.3", 0.5, True),
        ("none", 0.5, True),
        ("confidence: 0.9, infrastructure", 0.9, True),
    ],
)
def test_report_confidence(spark, text, confidence, human):
    value = triage.report_confidence(F.col("t"))
    assert one(spark, value, t=text) == confidence
    assert one(spark, triage.needs_human(F.col("t"), value), t=text) is human


@pytest.mark.parametrize(
    ("text", "intent"),
    [
        ("Comment est calculé le CA ?", "metric_definition"),
        ("Quelle table alimente ce graphe", "chart_source"),
        ("D'où vient ce chiffre", "lineage"),
        ("Top ventes", "data_exploration"),
    ],
)
def test_question_intent(spark, text, intent):
    assert one(spark, triage.question_intent(F.col("t"))[0], t=text) == intent


def test_legacy_incidents_and_order(spark):
    schema = (
        f"incident_id string, created_at timestamp_ntz, diagnostic {triage.DIAGNOSTIC}, context {triage.LEGACY_CONTEXT}"
    )
    context = ("model.shop.a", "boom (models/a.sql)", "", None)
    records = spark.createDataFrame(
        [("A", datetime(2026, 1, 1), None, context), ("B", datetime(2026, 1, 2), None, None)], schema
    )
    fixed = {r.incident_id: r.diagnostic for r in triage.incidents_normalised(records).collect()}
    assert fixed["B"] is None
    assert fixed["A"].command_executed == "Inconnue"
    assert fixed["A"].failed_nodes[0].file_path == "models/a.sql"
    assert [r.incident_id for r in triage.incidents_latest(records).collect()] == ["B", "A"]


def test_incident_store(spark, tmp_path):
    document = {"incident_id": "A", "created_at": "2026-01-01T10:00:00", "context": {"failed_node": "model.s.a"}}
    (tmp_path / "A.json").write_text(json.dumps(document, indent=2))
    loaded = triage.read_incidents(spark, str(tmp_path))
    assert loaded.first()["diagnostic"].failed_nodes[0].node_name == "a"
    store = scratch_path(spark, "incidents")
    triage.append_incidents(loaded, store)
    triage.append_incidents(loaded.withColumn("incident_id", F.lit("B")), store)
    again = spark.read.schema(loaded.schema).json(store)
    assert sorted(r.incident_id for r in again.collect()) == ["A", "B"]


def manifest_tables(spark, tmp_path):
    def node(unique_id, kind, *parents):
        return {
            "unique_id": unique_id, "resource_type": kind, "name": unique_id.split(".")[-1],
            "depends_on": {"nodes": list(parents)},
        }

    nodes = [
        node("model.s.upstream", "model", "source.s.raw", "model.s.gone"),
        node("model.s.failed_a", "model", "model.s.upstream"),
        node("model.s.failed_b", "model", "model.s.upstream"),
        node("model.s.downstream", "model", "model.s.failed_a", "model.s.failed_b"),
        node("model.s.unrelated", "model"),
        node("test.s.check", "test", "model.s.downstream"),
    ]
    sources = [node("source.s.raw", "source"), node("source.s.unused", "source")]
    document = {
        "nodes": {n["unique_id"]: n for n in nodes},
        "sources": {n["unique_id"]: n for n in sources},
    }
    (tmp_path / "manifest.json").write_text(json.dumps(document))
    manifests = triage.read_json_documents(spark, str(tmp_path), lineage.MANIFEST)
    table = lineage.manifest_nodes(manifests)
    failed = spark.createDataFrame([("model.s.failed_a",), ("model.s.failed_b",)], "unique_id string")
    return table, lineage.edges(table), failed


def test_lineage_of_two_failures(spark, tmp_path):
    nodes, edges, failed = manifest_tables(spark, tmp_path)
    up = lineage.closure(spark, edges, failed, "upstream", nodes)
    down = lineage.closure(spark, edges, failed, "downstream", nodes)
    assert rows(up) == [("model.s.upstream", 1), ("source.s.raw", 2)]
    assert rows(down) == [("model.s.downstream", 1), ("test.s.check", 2)]
    assert rows(lineage.summary(spark, edges, failed, nodes)) == [
        ("downstream", 1, 2), ("failed", 2, 2), ("upstream", 1, 2)
    ]
    assert rows(lineage.distances(spark, edges, failed, nodes)) == [
        ("model.s.failed_a", "model.s.downstream", 1),
        ("model.s.failed_a", "model.s.upstream", -1),
        ("model.s.failed_b", "model.s.downstream", 1),
        ("model.s.failed_b", "model.s.upstream", -1),
    ]
    tests = lineage.tests_of(nodes, nodes.where("resource_type = 'model'"))
    assert rows(tests) == [("model.s.downstream", "test.s.check", "check")]
    lineage.require_known(failed, nodes)
    with pytest.raises(ValueError, match="model.s.gone"):
        lineage.summary(spark, edges, spark.createDataFrame([("model.s.gone",)], "unique_id string"), nodes)
    selected = lineage.selected_nodes(spark, edges, failed, nodes)
    assert rows(selected.select("unique_id")) == [
        ("model.s.downstream",), ("model.s.failed_a",), ("model.s.failed_b",), ("model.s.upstream",),
        ("source.s.raw",), ("test.s.check",)
    ]


def test_unknown_parents_stay_in_the_depth_walk(spark):
    nodes = spark.createDataFrame([("b", "b", ["a", "gone"]), ("a", "a", [])], "unique_id string, name string, parents array<string>")
    root = spark.createDataFrame([("b",)], "unique_id string")
    found = lineage.upstream_within(spark, lineage.edges(nodes, known_only=False), root, nodes)
    assert rows(found.select("unique_id", "name", "level")) == [("a", "a", 1), ("b", "b", 0), ("gone", None, 1)]


def test_walk_ends_on_cycles_and_respects_depth(spark):
    edges = spark.createDataFrame(
        [("b", "a"), ("c", "b"), ("a", "c"), ("d", "c"), ("d", "a"), ("e", "d")], "child string, parent string"
    )
    nodes = spark.createDataFrame([(n, n) for n in "abcde"], "unique_id string, name string")
    root = spark.createDataFrame([("e",)], "unique_id string")
    assert {r.unique_id: r.distance for r in lineage.closure(spark, edges, root, "upstream", nodes).collect()} == {
        "d": 1, "a": 2, "c": 2, "b": 3
    }
    near = lineage.upstream_within(spark, edges, root, nodes, depth=1)
    assert rows(near.select("unique_id", "level")) == [("d", 1), ("e", 0)]
    only = lineage.upstream_within(spark, edges, root, nodes, direction="downstream")
    assert rows(only.select("unique_id", "level")) == [("e", 0)]
    with pytest.raises(ValueError):
        lineage.closure(spark, edges, root, "sideways", nodes)


def test_scratch_is_below_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(shared_dir(spark))
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
