"""Run results, log texts, reports, incidents and lineage derived from the tables.

The given data has no pipeline artefacts. These functions shape whole tables into
the nested layout of the artefacts, row by row and without a shuffle, so triage
jobs can be run and timed at the size of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.operators.triage import DIAGNOSTIC, LEGACY_CONTEXT

# One message per classification rule, one that matches none and
# an empty one.
MESSAGES = (
    "IO Error: Could not set lock on file warehouse.db: it is locked",
    "Env var required but not provided: STORE_SOURCE",
    "Got 2 results, configured to fail if != 0",
    "Failure in test unique_orders (models/schema.yml)",
    "Binder Error: Referenced column customer_segment not found (models/1_intermediate/int_orders.sql)",
    "Node fct_daily_sales depends on a node named normalize which was not there",
    "Conversion Error: invalid date format: not-a-date",
    r"Parser Error: syntax error at or near SELEC (models\2_marts\fct_orders.sql)",
    "Process exited with code 137",
    "",
)
NODE_IDS = (
    "model.retail.fct_orders",
    "model.retail.int_orders",
    "test.retail.unique_orders",
    "standalone",
)
STATES = ("error", "fail", "success", "skipped", "pass")
COMMANDS = ("dbt build", "build --select marts", "", "dbt test")
EXPECTED_TYPES = (
    "infrastructure",
    "config_error",
    "test_failure",
    "dbt_test_failure",
    "schema_change",
    "dependency_error",
    "database_error",
    "compilation_error",
)
PATCHED_FILES = ("fct_orders.sql", "unique_orders")
FIX_FILES = ("models/2_marts/dim_customers.sql", "models/2_marts/fct_orders.sql")
RESULTS_PER_RUN = 3

# Statements of the query log; {} is replaced by a number.
STATEMENTS = (
    "SELECT * FROM fct_orders WHERE order_id = {}",
    "  with x as (select {} as a) select * from x",
    "INSERT INTO fct_orders VALUES ({})",
    "select {} ; drop table fct_orders",
    "SELECT updated_at FROM fct_orders WHERE order_id = {}",
    "selection {}",
)


def _nth(values: tuple[str, ...], position: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (position + 1).cast("int"))


def message_at(number: Column) -> Column:
    return _nth(MESSAGES, number % len(MESSAGES))


def run_results(events: DataFrame) -> DataFrame:
    """One run per event with three node results each."""
    event = F.col("event_id")
    results = []
    for k in range(RESULTS_PER_RUN):
        number = event * RESULTS_PER_RUN + k
        results.append(
            F.struct(
                _nth(NODE_IDS, number % len(NODE_IDS)).alias("unique_id"),
                _nth(STATES, number % len(STATES)).alias("status"),
                message_at(F.floor(number / len(STATES))).alias("message"),
            )
        )
    command = _nth(COMMANDS, event % len(COMMANDS))
    return events.select(
        event.alias("run_id"),
        F.struct(command.alias("invocation_command")).alias("args"),
        F.array(*results).alias("results"),
    )


def run_results_json(events: DataFrame) -> DataFrame:
    """The same runs as JSON documents."""
    return run_results(events).select("run_id", F.to_json(F.struct("run_id", "args", "results")).alias("document"))


def expected_failures(events: DataFrame) -> DataFrame:
    """Expected failure types, one or two per run depending on the event."""
    event = F.col("event_id")
    number = F.floor(event * RESULTS_PER_RUN / len(STATES))
    first = _nth(EXPECTED_TYPES, number % len(MESSAGES) % len(EXPECTED_TYPES))
    second = _nth(EXPECTED_TYPES, F.lit(2))
    types = F.when(event % 5 == 0, F.array(first, second)).otherwise(F.array(first))
    return events.select(event.alias("run_id"), F.explode(types).alias("error_type"))


def log_texts(documents: DataFrame) -> DataFrame:
    """Console logs around whole document texts; some are blank."""
    doc, text = F.col("doc_id"), F.col("text")
    log = (
        F.when(doc % 4 == 0, " \n\t ")
        .when(doc % 4 == 1, F.concat(F.lit("Failure in model.retail.fct-orders (models/2_marts/fct_orders.sql)\n"), text))
        .when(doc % 4 == 2, F.concat(F.lit("\n"), text, F.lit("\n")))
        .otherwise(F.concat(text, F.lit("\nCompilation Error in test.retail.unique_orders\n")))
    )
    return documents.select("doc_id", log.alias("log_text"))


def reports(documents: DataFrame) -> DataFrame:
    """Investigation reports that end in a conclusion and, often, a confidence."""
    doc, text = F.col("doc_id"), F.col("text")
    conclusion = (
        F.when(doc % 5 == 0, "\n  Source data issue: late file")
        .when(doc % 5 == 1, "\nConclusion:  source-data correction is required")
        .when(doc % 5 == 2, "\nThis is not a source data issue: the model is wrong")
        .when(doc % 5 == 3, "\nConclusion: a bad join. Conclusion: source data issue: none")
        .otherwise("\nThe infrastructure was locked")
    )
    stated = (
        F.when(doc % 7 == 0, "")
        .when(doc % 7 == 1, "\nconfidence: 1.2.3")
        .when(doc % 7 == 2, "\nConfidence : 9")
        .otherwise(F.concat(F.lit("\nCONFIDENCE: 0."), F.lpad((doc % 100).cast("string"), 2, "0")))
    )
    return documents.select("doc_id", F.concat(text, conclusion, stated).alias("report"))


def query_log(events: DataFrame) -> DataFrame:
    event = F.col("event_id")
    template = _nth(STATEMENTS, event % len(STATEMENTS))
    return events.select("event_id", F.replace(template, F.lit("{}"), event.cast("string")).alias("statement"))


def incidents(events: DataFrame) -> DataFrame:
    """Incident records; every third still has the old layout (context only)."""
    event, number = F.col("event_id"), F.col("event_id") * RESULTS_PER_RUN
    node, message = _nth(NODE_IDS, event % len(NODE_IDS)), message_at(event)
    old = event % 3 == 0
    failed = F.struct(
        F.substring_index(node, ".", 1).alias("node_type"),
        node.alias("unique_id"),
        F.substring_index(node, ".", -1).alias("node_name"),
        F.lit("").alias("file_path"),
        message.alias("error_message"),
    )
    diagnostic = F.struct(
        F.lit("dbt build").alias("command_executed"),
        F.lit(True).alias("has_errors"),
        F.array(failed).alias("failed_nodes"),
    ).cast(DIAGNOSTIC)
    context = F.struct(
        node.alias("failed_node"),
        message.alias("error_message"),
        F.when(event % 2 == 0, "models/given.sql").otherwise("").alias("file_path"),
        F.when(event % 4 != 0, "dbt build").alias("dbt_command"),
    ).cast(LEGACY_CONTEXT)
    one, both = F.array(F.lit(FIX_FILES[0])), F.array(*map(F.lit, FIX_FILES))
    backslashed = F.array(F.lit(FIX_FILES[0].replace("/", "\\")))
    patch_path = F.when(event % 4 == 0, FIX_FILES[1]).when(event % 4 == 1, FIX_FILES[0].replace("/", "\\"))
    patches = (
        F.when(event % 6 == 0, F.array().cast("array<string>"))
        .when(event % 6 <= 2, backslashed)
        .otherwise(F.array(F.lit(FIX_FILES[1])))
    )
    return events.select(
        F.concat(F.lit("INC-"), F.lpad(event.cast("string"), 12, "0")).alias("incident_id"),
        F.col("ts").alias("created_at"),
        F.col("event_type").alias("scenario_id"),
        F.when(~old, diagnostic).alias("diagnostic"),
        F.when(old & (number % 9 != 0), context).alias("context"),
        F.struct(patch_path.alias("file_path")).alias("patch"),
        F.transform(patches, lambda p: F.struct(p.alias("file_path"))).alias("patches"),
        F.struct(F.when(event % 4 == 2, F.concat(F.lit("edit "), F.lit(FIX_FILES[0]))).alias("proposed_fix")).alias("rca"),
        F.concat(F.lit("see "), F.when(event % 8 == 3, FIX_FILES[0]).otherwise("nothing")).alias("investigation_output"),
        F.when(event % 3 == 0, True).when(event % 3 == 1, False).alias("validation_passed"),
        F.lit(FIX_FILES[0]).alias("expected_file"),
        F.when(event % 5 == 0, F.array().cast("array<string>"))
        .when(event % 5 <= 2, one)
        .otherwise(both)
        .alias("expected_files"),
    )


def lineage_nodes(customers: DataFrame) -> DataFrame:
    """A dependency tree over customers: node k depends on node k // 2.

    Every tenth node also names a parent that does not exist.
    """
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    kind = F.when(segment == "BUILDING", "test").when(segment == "MACHINERY", "source").otherwise("model")

    def node_id(number: Column) -> Column:
        return F.concat(F.lit("node."), number.cast("string"))

    parents = F.filter(
        F.array(
            F.when(key > 0, node_id(F.floor(key / 2))),
            F.when(key % 10 == 0, node_id(key + 1_000_000_000)),
        ),
        lambda p: p.isNotNull(),
    )
    return customers.select(
        node_id(key).alias("unique_id"),
        kind.alias("resource_type"),
        F.concat(F.lit("n"), key.cast("string")).alias("name"),
        parents.alias("parents"),
        F.col("c_acctbal").alias("balance"),
    )


def failed_lineage_nodes(customers: DataFrame, below: float = -800.0) -> DataFrame:
    """The nodes that failed: customers deep in debt."""
    return lineage_nodes(customers.where(F.col("c_acctbal") < below)).select("unique_id")
