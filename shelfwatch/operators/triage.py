"""Failure triage over tables of run results, log texts, reports and incidents.

Inputs are nested tables in the layout of the JSON artefacts. Everything is a
column expression; lists inside a record stay inside the record, and lists across
records are compared as counted rows, never collected.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwatch.functions.skew import split_join, union_all
from shelfwatch.functions.text import (
    base_name,
    contains_any,
    file_in_message,
    forward_slashes,
    id_head,
    id_tail,
    lines,
    node_in_message,
    strip,
)

# Schemas of the artefacts.
RUN_RESULTS = (
    "run_id bigint, args struct<invocation_command: string>, "
    "results array<struct<unique_id: string, status: string, message: string>>"
)
FAILED_NODE = (
    "struct<node_type: string, unique_id: string, node_name: string, file_path: string, "
    "error_message: string>"
)
DIAGNOSTIC = f"struct<command_executed: string, has_errors: boolean, failed_nodes: array<{FAILED_NODE}>>"
LEGACY_CONTEXT = (
    "struct<failed_node: string, error_message: string, file_path: string, dbt_command: string>"
)

INCIDENT = (
    f"incident_id string, scenario_id string, status string, diagnostic {DIAGNOSTIC}, "
    f"context {LEGACY_CONTEXT}, rca struct<proposed_fix: string>, patch struct<file_path: string>, "
    "patches array<struct<file_path: string>>, investigation_output string, "
    "validation_passed boolean, created_at timestamp_ntz"
)

# States, default texts and category names.
FAILED_STATES = ("error", "fail")
UNKNOWN_COMMAND = "Inconnue"
NO_TEXT = "dbt failed before producing run_results.json"
UNKNOWN_NODE = "unknown.dbt.failure"
DEFAULT_COMMAND = "dbt build"
INFRASTRUCTURE = "infrastructure"
CONFIG_ERROR = "config_error"
DBT_TEST_FAILURE = "dbt_test_failure"
SCHEMA_CHANGE = "schema_change"
DEPENDENCY_ERROR = "dependency_error"
DATA_ERROR = "data_error"
SQL_COMPILATION = "sql_compilation"
UNKNOWN = "unknown"

# Words looked for in a lower-cased message.
LOCK_WORDS = ("locked", "permission", "io error", "cannot open file")
CONFIG_WORDS = ("profiles.yml", "dbt_profile", "env_var", "env var required")
MISSING_WORDS = ("not found", "does not exist", "referenced column", "does not have a column")
OBJECT_WORDS = ("column", "table", "field")
DEPENDENCY_WORDS = (
    "depends on",
    "upstream",
    "skipped due to",
    "duplicate key",
    "merge failed",
    "incremental",
)
DATA_WORDS = (
    "cast",
    "conversion",
    "invalid input",
    "could not convert",
    "divide by zero",
    "division by zero",
)
COMPILATION_WORDS = (
    "binder error",
    "syntax error",
    "parser error",
    "catalog error",
    "catalog exception",
    "invalid function",
    "compilation error",
    "macro",
)

# Alternative names of categories.
ALIASES = {
    "compilation_error": SQL_COMPILATION,
    "database_error": DATA_ERROR,
    "test_failure": DBT_TEST_FAILURE,
}

# Report confidence and source-data conclusions.
CONFIDENCE = r"confidence[:\s]+([0-9.]+)"
CONFIDENCE_RANGE = (0.15, 0.95)
DEFAULT_CONFIDENCE = 0.5
HUMAN_BELOW = 0.70
SOURCE_DATA_MARKERS = (
    "source data issue:",
    "source-data issue:",
    "source data correction is required",
    "source-data correction is required",
)

# Question words per intent, in order of precedence, and its tools.
INTENTS = (
    (
        "metric_definition",
        ("calcul", "défini", "definition", "ca ", "chiffre d'affaires"),
        ("get_dbt_schema_yml", "get_dbt_models", "get_dbt_manifest"),
    ),
    (
        "chart_source",
        ("quelle table", "source", "alimente", "alimenté"),
        ("get_dbt_manifest", "get_dbt_models"),
    ),
    (
        "lineage",
        ("vient", "lineage", "origine", "d'où"),
        ("get_dbt_manifest", "get_dbt_models"),
    ),
)
DEFAULT_INTENT = ("data_exploration", ("run_sql", "get_schema"))


def read_json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON artefacts, one document per file, with a declared schema; a malformed one is an error."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def parsed_runs(documents: DataFrame, column: str) -> DataFrame:
    """Run results from JSON texts; a malformed one is an error."""
    return documents.select(F.from_json(column, RUN_RESULTS, {"mode": "FAILFAST"}).alias("d")).select("d.*")


# -- failed nodes ----------------------------------------------------------


def command_text(command: Column) -> Column:
    given = F.coalesce(command, F.lit(""))
    return (
        F.when(F.startswith(given, F.lit("dbt ")), given)
        .when(given != "", F.concat(F.lit("dbt "), given))
        .otherwise(UNKNOWN_COMMAND)
    )


def node_columns(unique_id: Column, message: Column) -> list[Column]:
    """The five fields of a failed node."""
    return [
        id_head(unique_id).alias("node_type"),
        unique_id.alias("unique_id"),
        id_tail(unique_id).alias("node_name"),
        file_in_message(message).alias("file_path"),
        message.alias("error_message"),
    ]


def failed_nodes(runs: DataFrame) -> DataFrame:
    """One row per failed node of every run, in document order (``position``)."""
    exploded = runs.select(
        "run_id",
        command_text(F.col("args.invocation_command")).alias("command_executed"),
        F.posexplode("results").alias("position", "result"),
    ).where(F.col("result.status").isin(*FAILED_STATES))
    unique_id = F.coalesce("result.unique_id", F.lit(""))
    return exploded.select(
        "run_id", "command_executed", "position", *node_columns(unique_id, F.col("result.message"))
    )


def failed_nodes_from_text(logs: DataFrame, key: str, text: str) -> DataFrame:
    """One node per log when a run left no results file."""
    message = F.coalesce(F.nullif(strip(F.col(text)), F.lit("")), F.lit(NO_TEXT))
    named = logs.select(key, message.alias("message")).withColumn(
        "node", F.coalesce(F.nullif(node_in_message(F.col("message")), F.lit("")), F.lit(UNKNOWN_NODE))
    )
    return named.select(
        key,
        F.lit(DEFAULT_COMMAND).alias("command_executed"),
        *node_columns(F.col("node"), F.col("message")),
    )


def sort_priority(patched_files: Sequence[str]) -> Column:
    """0 for nodes whose file (or name) is among the patched files, else 1."""
    shown = base_name(F.coalesce(F.nullif("file_path", F.lit("")), F.col("node_name")))
    return F.when(shown.isin(*patched_files), 0).otherwise(1)


def prioritised(nodes: DataFrame, patched_files: Sequence[str]) -> DataFrame:
    """Failed nodes per run, patched files first, then by id.

    The sort key ends with the document position, which keeps equal ids in their
    original order and makes the key fine enough for balanced range partitions.
    """
    ranked = nodes.withColumn("sort_priority", sort_priority(patched_files))
    return ranked.orderBy("run_id", "sort_priority", "unique_id", "position")


def primary_failures(nodes: DataFrame, patched_files: Sequence[str] | None = None) -> DataFrame:
    """The first failed node of every run.

    Rank 1 is pruned map-side, so a run with very many failures stays cheap.
    """
    order = [F.col("position")]
    if patched_files is not None:
        order = [sort_priority(patched_files), F.col("unique_id"), F.col("position")]
    first = Window.partitionBy("run_id").orderBy(*order)
    return nodes.withColumn("pick", F.row_number().over(first)).where("pick = 1").drop("pick")


# -- classification --------------------------------------------------------


def error_category(message: Column, lowered: Column | None = None) -> Column:
    """Category of a message: ordered rules, the first match decides.

    ``lowered`` is the message in lower case, where it is a column already.
    """
    text = F.lower(message) if lowered is None else lowered

    def has(word: str) -> Column:
        return F.contains(text, F.lit(word))

    return (
        F.when(message.isNull() | (message == ""), UNKNOWN)
        .when(contains_any(text, LOCK_WORDS), INFRASTRUCTURE)
        .when(contains_any(text, CONFIG_WORDS), CONFIG_ERROR)
        .when(has("configured to fail") | (has("got") & has("result")), DBT_TEST_FAILURE)
        .when(has("test") & has("fail"), DBT_TEST_FAILURE)
        .when(contains_any(text, MISSING_WORDS) & contains_any(text, OBJECT_WORDS), SCHEMA_CHANGE)
        .when(contains_any(text, DEPENDENCY_WORDS), DEPENDENCY_ERROR)
        .when(contains_any(text, DATA_WORDS), DATA_ERROR)
        .when(contains_any(text, COMPILATION_WORDS), SQL_COMPILATION)
        .otherwise(UNKNOWN)
    )


def normalized_type(error_type: Column) -> Column:
    """Canonical category of an expected error type."""
    normal = F
    for alias, category in ALIASES.items():
        normal = normal.when(error_type == alias, category)
    return normal.otherwise(error_type)


def auto_fixable(category: Column) -> Column:
    return ~category.isin(INFRASTRUCTURE, CONFIG_ERROR)


def classified(nodes: DataFrame) -> DataFrame:
    lowered = nodes.withColumn("__lowered", F.lower("error_message"))
    category = error_category(F.col("error_message"), F.col("__lowered"))
    return lowered.withColumn("error_category", category).drop("__lowered")


def run_categories(runs: DataFrame, nodes: DataFrame, patched_files: Sequence[str] | None = None) -> DataFrame:
    """Category of the first failure of every run, and whether a fix can be automatic.

    A run without a failed node is unknown and fixable.
    """
    first = classified(primary_failures(nodes, patched_files)).select("run_id", "unique_id", "error_category")
    category = F.coalesce("error_category", F.lit(UNKNOWN))
    return (
        runs.select("run_id")
        .join(first, "run_id", "left")
        .select("run_id", "unique_id", category.alias("error_category"), auto_fixable(category).alias("auto_fixable"))
    )


def category_counts(nodes: DataFrame) -> DataFrame:
    return classified(nodes).groupBy("error_category").agg(F.count(F.lit(1)).alias("node_count"))


# -- evaluation against expectations ---------------------------------------


def classifications_match(nodes: DataFrame, expected: DataFrame) -> DataFrame:
    """Per run: is the multiset of observed categories the expected one?

    ``expected`` has (run_id, error_type), one row per expected failure. Both
    sides are counted per (run, category), so equal multisets are equal counts
    and no list of a run is ever built.
    """
    seen = classified(nodes).select("run_id", F.col("error_category").alias("category"), F.lit(1).alias("n"))
    wanted = expected.select(
        "run_id", normalized_type(F.col("error_type")).alias("category"), F.lit(-1).alias("n")
    )
    sides = seen.unionByName(wanted)
    per_category = sides.groupBy("run_id", "category").agg(
        F.sum("n").alias("balance"),
        F.count_if(F.col("n") > 0).alias("observed"),
        F.count_if(F.col("n") < 0).alias("expected"),
    )
    return per_category.groupBy("run_id").agg(
        F.sum("observed").alias("observed_failures"),
        F.sum("expected").alias("expected_failures"),
        # Expectations without a type count as failures, but name no class.
        F.coalesce(
            F.bool_and(F.when(F.coalesce("category", F.lit("")) != "", F.col("balance") == 0)), F.lit(True)
        ).alias("classifications_match"),
        (F.sum("observed") == F.sum("expected")).alias("failure_count_match"),
    )


def eval_summary(matches: DataFrame) -> DataFrame:
    """Number of runs and of runs that match in count and in categories."""
    passed = F.col("classifications_match") & F.col("failure_count_match")
    return matches.agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(passed).alias("passed"),
        F.count_if(F.col("failure_count_match")).alias("count_matches"),
        F.count_if(F.col("classifications_match")).alias("class_matches"),
    )


def single_class_matches(
    nodes: DataFrame, expected: DataFrame, hot: Sequence[Any] = ()
) -> DataFrame:
    """Does the first failure of a run have an expected type?

    Every expectation gets an answer: a run without a failed node counts as unknown.
    ``hot`` names runs that hold a large share of the expected rows.
    """
    first = classified(primary_failures(nodes)).select("run_id", F.col("error_category").alias("category"))
    wanted = expected.select("run_id", "error_type")
    matched = F.coalesce("category", F.lit(UNKNOWN)) == normalized_type(F.col("error_type"))
    return union_all(split_join(wanted, first, "run_id", "left", hot)).select(
        "run_id", "error_type", matched.alias("matched")
    )


def run_evaluation(nodes: DataFrame, expected: DataFrame) -> DataFrame:
    """One row per expected run: category of its first failure, count test and class test.

    Several expected failures are compared as a multiset, a single one with the first failure.
    """
    first = classified(primary_failures(nodes)).select("run_id", "error_category")
    single = expected.groupBy("run_id").agg(F.min(normalized_type(F.col("error_type"))).alias("single"))
    category = F.coalesce("error_category", F.lit(UNKNOWN))
    several = F.col("expected_failures") > 1
    match = F.when(several, F.col("classifications_match")).otherwise(category == F.coalesce("single", F.lit("")))
    return (
        classifications_match(nodes, expected)
        .where("expected_failures > 0")
        .join(single, "run_id")
        .join(first, "run_id", "left")
        .select("run_id", category.alias("error_category"), "failure_count_match", match.alias("classification_match"))
    )


def root_cause_file_match(expected_file: Column) -> Column:
    """Does the first available of patch path, proposed fix and report name it?"""
    patch, fix = F.col("patch.file_path"), F.col("rca.proposed_fix")
    return (
        F.when(F.coalesce(patch, F.lit("")) != "", F.contains(forward_slashes(patch), forward_slashes(expected_file)))
        .when(F.coalesce(fix, F.lit("")) != "", F.contains(fix, expected_file))
        .otherwise(F.contains(F.coalesce("investigation_output", F.lit("")), expected_file))
    )


def fix_files_match(expected_files: Column) -> Column:
    """Are all expected files among the patched ones (and is any expected)?"""

    def cleaned(paths: Column) -> Column:
        named = F.filter(paths, lambda p: F.coalesce(p, F.lit("")) != "")
        return F.transform(named, forward_slashes)

    paths = F.coalesce(F.transform("patches", lambda p: p["file_path"]), F.array().cast("array<string>"))
    observed = cleaned(F.array_append(paths, F.col("patch.file_path")))
    expected = cleaned(F.coalesce(expected_files, F.array().cast("array<string>")))
    return (F.size(expected) > 0) & (F.size(F.array_except(expected, observed)) == 0)


def validation_passed(flag: Column) -> Column:
    """True only when the flag is exactly true."""
    return flag.eqNullSafe(F.lit(True))


# -- reports and questions -------------------------------------------------


def report_confidence(report: Column) -> Column:
    """Stated confidence, limited to the allowed range; 0.5 when none is stated."""
    low, high = CONFIDENCE_RANGE
    stated = F.regexp_extract(report, "(?iU)" + CONFIDENCE, 1)
    value = F.nullif(stated, F.lit("")).try_cast("double")
    # greatest and least skip NULL, so the default is decided before the limits.
    limited = F.least(F.greatest(value, F.lit(low)), F.lit(high))
    return F.when(value.isNull(), DEFAULT_CONFIDENCE).otherwise(limited)


def needs_human(report: Column, confidence: Column) -> Column:
    return (confidence < HUMAN_BELOW) | F.contains(F.lower(report), F.lit("infrastructure"))


def source_data_issue(report: Column) -> Column:
    """Does a line, or the text after its first "conclusion:", start with a marker?

    Texts without any marker are answered before they are split into lines.
    """
    text, word = F.lower(report), "conclusion:"
    opening = r"(?U)^\s*(" + "|".join(SOURCE_DATA_MARKERS) + ")"

    def concludes(line: Column) -> Column:
        rest = F.substr(line, F.locate(word, line) + len(word))
        return line.rlike(opening) | (F.contains(line, F.lit(word)) & rest.rlike(opening))

    return contains_any(text, SOURCE_DATA_MARKERS) & F.exists(lines(text), concludes)


def question_intent(question: Column) -> tuple[Column, Column]:
    """Intent and tools of a question: ordered word lists, the first match decides."""
    text = F.lower(question)
    name, tools = F, F
    for intent, words, intent_tools in INTENTS:
        hit = contains_any(text, words)
        name = name.when(hit, intent)
        tools = tools.when(hit, F.array(*map(F.lit, intent_tools)))
    default, default_tools = DEFAULT_INTENT
    return name.otherwise(default), tools.otherwise(F.array(*map(F.lit, default_tools)))


# -- incidents -------------------------------------------------------------


def read_incidents(spark: SparkSession, path: str) -> DataFrame:
    """Stored incident documents, old layouts brought up to date."""
    return incidents_normalised(read_json_documents(spark, path, INCIDENT))


def append_incidents(incidents: DataFrame, path: str) -> None:
    """Add incidents to a store of JSON lines."""
    incidents.write.mode("append").option("ignoreNullFields", "false").json(path)


def incidents_normalised(incidents: DataFrame) -> DataFrame:
    """Fill the diagnostic of records that still carry only a context."""
    context = F.col("context")
    unique_id = F.coalesce(context["failed_node"], F.lit(""))
    message = F.coalesce(context["error_message"], F.lit(""))
    path = F.coalesce(F.nullif(context["file_path"], F.lit("")), file_in_message(message))
    rebuilt = F.struct(
        F.coalesce(context["dbt_command"], F.lit(UNKNOWN_COMMAND)).alias("command_executed"),
        F.lit(True).alias("has_errors"),
        F.array(
            F.struct(
                id_head(unique_id).alias("node_type"),
                unique_id.alias("unique_id"),
                id_tail(unique_id).alias("node_name"),
                path.alias("file_path"),
                message.alias("error_message"),
            )
        ).alias("failed_nodes"),
    )
    diagnostic = F.coalesce("diagnostic", F.when(context.isNotNull(), rebuilt))
    return incidents.withColumn("diagnostic", diagnostic).drop("context")


def incidents_latest(incidents: DataFrame) -> DataFrame:
    """Newest incidents first; the id makes the order total."""
    return incidents.orderBy(F.desc("created_at"), F.desc("incident_id"))
