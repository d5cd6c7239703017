"""Reports as string columns; ordering is the caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillforge.functions.text import dot_label, mermaid_id, mermaid_label, shell_quoted, truncate_left

WIDE = (("file", 40), ("name", 20), ("kind", 10))
#: Columns of the wide table after file, name and kind, with their widths.
WIDE_NUMBERS = (("line", 5), ("statements", 6), ("arguments", 5), ("indentation", 5), ("branches", 5), ("returns", 5), ("locals", 6), ("methods", 7), ("lines", 5), ("imports", 7), ("fan_in", 6), ("fan_out", 6))


def stats_line() -> Column:
    """A line of the distribution table, from (metric, count, p50, p90, p95, p99, max)."""
    return F.format_string("%-28s %5d %5d %5d %5d %5d %5d", "metric", "count", "p50", "p90", "p95", "p99", "max")


def stat_line() -> Column:
    return F.format_string("STAT:%s:%d:%s:%d:%s", "metric", "value", "file", "line", "name")


def _padded(text: Column, width: int, left: bool) -> Column:
    """Longer texts stay whole, as in a printed table."""
    fill = F.repeat(F.lit(" "), F.greatest(F.lit(width) - F.length(text), F.lit(0)))
    return F.concat(text, fill) if left else F.concat(fill, text)


def wide_line() -> Column:
    texts = [_padded(truncate_left(F.col(c), n) if c != "kind" else F.col(c), n, True) for c, n in WIDE]
    numbers = [_padded(F.coalesce(F.col(c).cast("string"), F.lit("-")), n, False) for c, n in WIDE_NUMBERS]
    return F.concat_ws(" ", *texts, *numbers)


def dry_line() -> Column:
    return F.format_string("%.3f  %s:%d-%d  %s:%d-%d", "similarity", "file1", "start1", "end1", "file2", "start2", "end2")


def duplicate_lines(members: DataFrame, summary: DataFrame, suggestion: str = "Extract common code into a shared function.") -> DataFrame:
    """(cluster_id, line): one line for each cluster, its first chunk as anchor. A line names every chunk of
    its cluster, so a report is for clusters of code, whose lines a reader can take in."""
    place = F.format_string("%s:%d-%d", "file", "start_line", "end_line")
    each = members.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("file", "start_line", "end_line", "name", place.alias("place")))).alias("m"))
    first = F.col("m")[0]
    text = F.format_string("VIOLATION:duplication:%s:%d:%s: %.0f%% similar, %d copies: [%s]. %s", first["file"], first["start_line"], first["name"], F.col("avg_similarity") * 100, F.size("m"), F.array_join(F.transform("m", lambda x: x["place"]), ", "), F.lit(suggestion))
    return each.join(summary, "cluster_id").select("cluster_id", text.alias("line"))


def summary_line() -> Column:
    """From one row of (files, code_units, statements, graph_nodes, graph_edges)."""
    return F.format_string("Analyzed: %d files, %d code_units, %d statements, %d graph_nodes, %d graph_edges", "files", "code_units", "statements", "graph_nodes", "graph_edges")


def layer_name(level: Column, layers: Column) -> Column:
    return F.when(level == 0, "Foundation").when(level == layers - 1, "Application").when(level == 1, "Domain").otherwise("Intermediate")


def _numbered(count: Column, one: str, many: str) -> Column:
    return F.when(count == 1, F.concat(count.cast("string"), F.lit(" " + one))).when(count > 1, F.concat(count.cast("string"), F.lit(" " + many)))


def layout_summary() -> Column:
    """From one row of (cycles, layer_violations, cross_group)."""
    issues = F.concat_ws(" and ", _numbered(F.col("cycles"), "cycle", "cycles"), _numbered(F.col("layer_violations"), "layering violation", "layering violations"), _numbered(F.col("cross_group"), "cross-directory dependency", "cross-directory dependencies"))
    return F.when(issues == "", "No layering issues detected.").otherwise(F.concat(F.lit("Current layout has "), issues, F.lit(".")))


def layout_lines(summary: DataFrame, rings: DataFrame, breaks: DataFrame, layered: DataFrame, after: DataFrame, title: str) -> DataFrame:
    """(part, ord, line) of a Markdown report: summary (cycles, layer_violations, cross_group), rings
    (node, scc), breaks (scc, src, dst), layered (node, layer), after (cycles, remaining_cycles, layers)."""
    row = lambda df, part, ord_, line: df.select(F.lit(part).alias("part"), ord_.alias("ord"), line.alias("line"))
    head = summary.select(F.posexplode(F.array(F.lit(f"# Proposed Layout for `{title}`"), F.lit("## Summary"), layout_summary())).alias("k", "line"))
    whole = row(head, 0, F.col("k").cast("string"), F.col("line"))
    named = rings.groupBy("scc").agg(F.array_join(F.array_sort(F.collect_set("node")), " → ").alias("ring")).join(breaks, "scc")
    whole = whole.unionByName(row(named, 1, F.col("scc"), F.format_string('- cycle: "%s"; break: "%s -> %s"', "ring", "src", "dst")))
    top = layered.agg((F.max("layer") + 1).alias("layers"))
    levels = layered.join(top).select("node", "layer", layer_name(F.col("layer"), F.col("layers")).alias("name"))  # one row
    whole = whole.unionByName(row(levels, 2, F.format_string("%06d %s", "layer", "node"), F.format_string("- level %d (%s): %s", "layer", "name", "node")))
    text = F.when(F.col("remaining_cycles") == 0, F.format_string("Breaking %s results in a clean %d-layer architecture.", F.coalesce(_numbered(F.col("cycles"), "cycle", "cycles"), F.lit("0 cycles")), "layers"))
    text = text.otherwise(F.format_string("Breaking suggested edges reduces cycles from %d to %d.", "cycles", "remaining_cycles"))
    return whole.unionByName(row(after, 3, F.lit("0"), text))


def test_commands(selectors: DataFrame) -> DataFrame:
    """(language, command): one line for each language, from (language, test_file, test_id)."""
    word = F.when(F.col("language") == "python", F.concat_ws("::", "test_file", "test_id")).otherwise(F.col("test_id"))
    held = selectors.select("language", shell_quoted(word).alias("w")).groupBy("language").agg(F.array_join(F.array_sort(F.collect_set("w")), " ").alias("w"))
    start = F.when(F.col("language") == "python", F.lit("python -m pytest ")).otherwise(F.lit("cargo test -- "))
    return held.select("language", F.concat(start, "w").alias("command"))


def dot_lines(nodes: DataFrame, edges: DataFrame, prefix: str) -> DataFrame:
    """(part, ord, line): nodes, then edges; nodes have (node) and a label."""
    named = lambda c: F.concat(F.lit(f'"{prefix}:'), dot_label(F.col(c)), F.lit('"'))
    node = nodes.select(F.lit(0).alias("part"), F.col("node").alias("ord"), F.concat(F.lit("  "), named("node"), F.lit(' [label="'), dot_label(F.col("label")), F.lit('"];')).alias("line"))
    edge = edges.select(F.lit(1).alias("part"), F.concat_ws(" ", "src", "dst").alias("ord"), F.concat(F.lit("  "), named("src"), F.lit(" -> "), named("dst"), F.lit(";")).alias("line"))
    return node.unionByName(edge)


def mermaid_lines(nodes: DataFrame, edges: DataFrame, prefix: str) -> DataFrame:
    node = nodes.select(F.lit(0).alias("part"), F.col("node").alias("ord"), F.concat(F.lit("  "), mermaid_id(prefix, F.col("node")), F.lit('["'), mermaid_label(F.col("label")), F.lit('"]')).alias("line"))
    edge = edges.select(F.lit(1).alias("part"), F.concat_ws(" ", "src", "dst").alias("ord"), F.concat(F.lit("  "), mermaid_id(prefix, F.col("src")), F.lit(" --> "), mermaid_id(prefix, F.col("dst"))).alias("line"))
    return node.unionByName(edge)


def viz_format(path: str) -> str:
    """dot, mermaid or markdown, by the output's extension."""
    kinds = {"dot": "dot", "mmd": "mermaid", "mermaid": "mermaid", "md": "markdown", "markdown": "markdown"}
    extension = path.rsplit("/", 1)[-1].rpartition(".")[2].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if extension not in kinds:
        raise ValueError(f"{path!r}: the output needs the extension .dot, .mmd, .mermaid or .md")
    return kinds[extension]


def graph_text(lines: list[str], kind: str, title: str = "dependencies") -> str:
    """A whole file from its lines in order."""
    if kind == "dot":
        return "\n".join([f"digraph {title} {{", *lines, "}"]) + "\n"
    body = "\n".join(["graph TD", *lines])
    return f"```mermaid\n{body}\n```\n" if kind == "markdown" else body + "\n"
