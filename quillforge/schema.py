"""The metric registry and its default thresholds, and the schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Metric, scope, default threshold for Python and for Rust (None: not checked), in registry order.
METRICS = (
    ("statements_per_function", "function", 35, 35),
    ("arguments_per_function", "function", 7, 8),
    ("positional_args", "function", 3, None),
    ("keyword_only_args", "function", 3, None),
    ("max_indentation_depth", "function", 4, 5),
    ("nested_function_depth", "function", 2, 2),
    ("returns_per_function", "function", 5, 5),
    ("return_values_per_function", "function", 3, None),
    ("branches_per_function", "function", 9, 9),
    ("local_variables_per_function", "function", 15, 20),
    ("statements_per_try_block", "function", 3, None),
    ("boolean_parameters", "function", 1, 1),
    ("annotations_per_function", "function", 5, 1),
    ("calls_per_function", "function", 20, 45),
    ("methods_per_class", "type", 10, 10),
    ("statements_per_file", "file", 200, 250),
    ("lines_per_file", "file", 300, 900),
    ("functions_per_file", "file", 10, 40),
    ("interface_types_per_file", "file", 1, 0),
    ("concrete_types_per_file", "file", 1, 8),
    ("imported_names_per_file", "file", 30, 50),
    ("inv_test_coverage", "file", None, None),
    ("fan_in", "module", None, None),
    ("fan_out", "module", None, None),
    ("cycle_size", "module", 0, 0),
    ("indirect_dependencies", "module", 10, 10),
    ("dependency_depth", "module", 3, 3),
)
METRIC_IDS = tuple(m[0] for m in METRICS)
#: Metrics that `check` never emits for a language although they have a threshold.
UNCHECKED = {("python", "arguments_per_function")}

# Defaults of the gate and of duplicate detection.
GATE = {"test_coverage_threshold": 90, "min_similarity": 0.9, "duplication_enabled": True, "orphan_module_enabled": True}
DUPLICATES = {"hashes": 100, "shingle": 3, "bands": 20, "min_similarity": 0.9, "largest_bucket": 100, "min_lines": 5, "min_tokens": 10}

#: What a metric asks for, behind its name, and what to do where it is over its limit.
ADVICE = {
    "statements_per_function": ("statements in a function body", "Break it into smaller functions."),
    "arguments_per_function": ("arguments of a function", "Gather related arguments in one type."),
    "positional_args": ("arguments that may be given by place", "Make more of them keyword-only."),
    "keyword_only_args": ("arguments that must be given by name", "Gather related options in one type."),
    "max_indentation_depth": ("levels of indentation in a function", "Return early, or move a block to a function."),
    "nested_function_depth": ("functions or closures inside one another", "Move inner functions out."),
    "returns_per_function": ("return statements in a function", "Let fewer ways lead out."),
    "return_values_per_function": ("values in one return statement", "Return a named type."),
    "branches_per_function": ("branches in a function", "Use a table, or split the cases."),
    "local_variables_per_function": ("local variables in a function", "Move a step with its variables to a function."),
    "statements_per_try_block": ("statements in one try block", "Keep only what can fail inside."),
    "boolean_parameters": ("parameters that are true or false", "Use two functions, or an enumeration."),
    "annotations_per_function": ("decorators or attributes of a function", "Combine or drop some."),
    "calls_per_function": ("calls in a function", "Hand parts of the work to other functions."),
    "methods_per_class": ("methods of a class or type", "Split the type by its tasks."),
    "statements_per_file": ("statements in the functions of a file", "Split the file."),
    "lines_per_file": ("lines in a file", "Split the file."),
    "functions_per_file": ("functions in a file", "Move related functions to a file of their own."),
    "interface_types_per_file": ("interfaces in a file", "Move some to files of their own."),
    "concrete_types_per_file": ("types in a file", "Move some to files of their own."),
    "imported_names_per_file": ("names that a file imports", "Split the file by what it needs."),
    "cycle_size": ("modules in a cycle of dependencies", "Remove the edge that the fewest others need."),
    "indirect_dependencies": ("modules needed by way of others", "Put an interface between them."),
    "dependency_depth": ("steps to the farthest module needed", "Move what is shared to a base module."),
}


def metrics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, s, k) for k, (m, s, _, _) in enumerate(METRICS)], "metric string, scope string, ord int")


def default_thresholds() -> dict[tuple[str, str], int]:
    return {(lang, m): v for m, _, py, rs in METRICS for lang, v in (("python", py), ("rust", rs)) if v is not None and (lang, m) not in UNCHECKED}


def thresholds(spark: SparkSession, overrides: dict[tuple[str, str], int] | None = None) -> DataFrame:
    """(language, metric, threshold): 54 rows at most, so it may be broadcast."""
    rows = default_thresholds() | (overrides or {})
    return spark.createDataFrame([(lang, m, int(v)) for (lang, m), v in rows.items()], "language string, metric string, threshold bigint")
