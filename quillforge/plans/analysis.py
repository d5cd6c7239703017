"""Whole analyses of a source tree: check, stats, dry, mimic, shrink, viz and coverage.

Each takes files(path, language, source) and returns DataFrames; nothing is printed or written.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillforge.functions import text as T
from quillforge.operators import dedup, graph, profile, render, resolve, rules
from quillforge.schema import ADVICE, DUPLICATES, GATE, METRIC_IDS, metrics, thresholds
from quillforge.sources import extract
from quillforge.sources.scratch import materialise


@dataclass
class Settings:
    limits: dict[tuple[str, str], int] = field(default_factory=dict)
    gate: dict = field(default_factory=lambda: dict(GATE))
    duplicates: dict = field(default_factory=lambda: dict(DUPLICATES))


class Corpus:
    """Tables of one tree, each extracted once and written to the shared folder when first used."""

    def __init__(self, files: DataFrame, settings: Settings | None = None):
        self.files, self.settings = files, settings or Settings()
        self.spark: SparkSession = files.sparkSession
        self._kept: dict[str, DataFrame] = {}

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = materialise(make(), name)
        return self._kept[name]

    @property
    def units(self) -> DataFrame:
        return self._once("units", lambda: extract.units(self.files))

    @property
    def chunks(self) -> DataFrame:
        d = self.settings.duplicates
        size = F.size(T.tokens(T.normalize_code(F.col("text"))))
        rows = lambda: extract.chunks(self.files).filter((F.col("end_line") - F.col("start_line") + 1 >= d["min_lines"]) & (size >= d["min_tokens"]))
        return self._once("chunks", lambda: rows().withColumn("chunk_id", F.format_string("%s:%09d:%09d:%s", "path", "start_line", "end_line", "name")).dropDuplicates(["chunk_id"]))

    @property
    def module_files(self) -> DataFrame:
        """(language, path, module, bare, parent): one row for each file."""
        p = F.col("path")
        by = lambda py, rs: F.when(F.col("language") == "python", py).otherwise(rs)
        named = self.files.select("language", "path", by(T.module_name_py(p), T.module_name_rs(p)).alias("module"), by(T.bare_name_py(p), T.stem(p)).alias("bare"))
        parent = F.when(F.col("module").contains("."), F.regexp_replace("module", "\\.[^.]*$", "")).otherwise("")
        return self._once("module-files", lambda: named.withColumn("parent", parent))

    @property
    def modules(self) -> DataFrame:
        """(language, path, module, bare, parent): one row for each module name, under the least path of its files."""
        least = F.min(F.struct("path", "bare", "parent"))
        return self._once("modules", lambda: self.module_files.groupBy("language", "module").agg(least.alias("x")).select("language", "x.path", "module", "x.bare", "x.parent"))

    def edges(self, language: str) -> DataFrame:
        """Edges of all files of each module name; modules of one name are one node."""
        modules = self.modules.filter(F.col("language") == language)
        files = self.module_files.filter(F.col("language") == language).select("path", "module", "parent", "bare")
        met = extract.imports(self.files.filter(F.col("language") == language)).join(files, "path")
        if language == "python":
            made = lambda: resolve.dependency_edges(met.select("module", "import", "parent"), modules.select("module", "bare"))
        else:
            parent = F.when(F.col("bare").isin("lib", "main", "build"), F.col("parent")).otherwise(F.col("module"))
            made = lambda: resolve.resolve_rust(met.select("module", "import", "kind", parent.alias("parent")), modules.select("module", "bare"))
        return self._once(f"edges-{language}", made)

    def nodes(self, language: str) -> DataFrame:
        return self.modules.filter(F.col("language") == language).select(F.col("module").alias("node"), "path")

    def components(self, language: str) -> DataFrame:
        return self._once(f"scc-{language}", lambda: graph.strong_components(self.nodes(language).select("node"), self.edges(language)))

    def module_metrics(self, language: str) -> DataFrame:
        """(node, path, fan_in, fan_out, indirect_dependencies, dependency_depth, cycle_size)."""

        def make() -> DataFrame:
            nodes, edges = self.nodes(language), self.edges(language)
            far = graph.reach(nodes, edges).select("node", F.col("indirect").alias("indirect_dependencies"), F.col("depth").alias("dependency_depth"))
            ring = self.components(language).select("node", F.when(F.col("size") >= 2, F.col("size")).otherwise(0).alias("cycle_size"))
            return nodes.join(graph.degrees(nodes, edges), "node").join(far, "node").join(ring, "node")

        return self._once(f"modules-{language}", make)

    @property
    def languages(self) -> list[str]:
        return sorted(r.language for r in self.files.select("language").distinct().collect())

    @property
    def is_test(self) -> DataFrame:
        """(path, test): by name, directory, or a test framework and a test."""
        by_name = F.when(F.col("language") == "python", T.is_test_path(F.col("path"))).otherwise(T.is_test_path_rs(F.col("path")))
        return self._once("tests", lambda: self.files.select("path", "language", by_name.alias("n")).join(extract.frameworks(self.files), "path").select("path", "language", (F.col("n") | F.col("uses")).alias("test")))

    @property
    def definitions(self) -> DataFrame:
        held = self.is_test.filter("not test").select(F.col("path").alias("file"))
        return self._once("definitions", lambda: extract.definitions(self.files).join(held, "file", "left_semi"))

    @property
    def uncovered(self) -> DataFrame:
        """Definitions that no test mentions."""

        def make() -> DataFrame:
            tests = self.files.join(self.is_test.filter("test").select("path"), "path", "left_semi")
            inline = extract.test_usages(self.files.filter("language = 'rust'")).select("ref")
            refs = extract.references(tests).select("ref").unionByName(inline).distinct()
            names = self.definitions.select("file").distinct()
            identifiers = names.select("file", F.explode(T.path_identifiers(F.col("file"))).alias("ident"))
            chosen = resolve.disambiguate(self.definitions, identifiers, refs)
            suffixes = names.select("file", T.module_suffix(F.col("file")).alias("suffix"))
            by_import = resolve.chosen_by_import(self.definitions, extract.references(tests).select(F.col("file").alias("test_file"), "ref"), self.module_files.select(F.col("path").alias("file"), "module"), self.all_edges())
            chosen = chosen.unionByName(by_import.join(chosen.select("name"), "name", "left_anti"))
            missing = resolve.uncovered(self.definitions, refs, extract.bindings(tests).select("module", "name"), suffixes, chosen)
            return self.with_orphans(missing)

        return self._once("uncovered", make)

    def all_edges(self) -> DataFrame:
        """(language, src, dst) of all languages."""
        whole = self.spark.createDataFrame([], "language string, src string, dst string")
        for language in self.languages:
            whole = whole.unionByName(self.edges(language).select(F.lit(language).alias("language"), "src", "dst"))
        return whole

    def with_orphans(self, missing: DataFrame) -> DataFrame:
        """What is missing, and all definitions in modules without any edge that are no entry points."""
        alone = None
        for language in self.languages:
            part = self.module_metrics(language).filter("fan_in = 0 and fan_out = 0").filter(~T.is_entry_point(F.col("node"))).select(F.lit(language).alias("language"), F.col("node").alias("module"))
            alone = part if alone is None else alone.unionByName(part)
        if alone is None:
            return missing
        files = self.module_files.join(alone, ["language", "module"], "left_semi").select(F.col("path").alias("file"))
        key = ["file", "name", "line"]
        return missing.unionByName(self.definitions.join(files, "file", "left_semi").join(missing.select(key), key, "left_anti").select(missing.columns))

    def coverage_violations(self, focus: DataFrame | None = None) -> DataFrame:
        """One row for each definition that no test mentions, by file and line, with its file's coverage;
        a module that nothing imports is named so, one that tests import with up to three of these."""
        percent = self.coverage().select("file", "percent")
        rows = self.uncovered.join(percent, "file").join(self.module_files.select(F.col("path").alias("file"), "language", "module"), ["file", "language"], "left")
        about = None
        for language in self.languages:
            tests = self.module_files.join(self.is_test.filter("test").select("path"), "path", "left_semi").filter(F.col("language") == language).select(F.col("module").alias("node"))
            by = graph.importers(self.edges(language), tests).groupBy("node").agg(F.array_sort(F.collect_set("importer")).alias("by"))
            part = self.module_metrics(language).join(by, "node", "left").select(F.lit(language).alias("language"), F.col("node").alias("module"), "fan_in", "by")
            about = part if about is None else about.unionByName(part)
        if about is not None:
            rows = rows.join(about, ["language", "module"], "left")
        else:
            rows = rows.withColumns({"fan_in": F.lit(None).cast("long"), "by": F.lit(None).cast("array<string>")})
        unused = (F.col("fan_in") == 0) & ~T.is_entry_point(F.col("module"))
        message = F.concat(F.format_string("%d%% covered. Add test coverage for this code unit.", "percent"), F.when(unused, F.lit(" No test module imports this module.")).otherwise(F.lit("")), F.when(F.size("by") > 0, F.concat(F.lit(" (candidates: "), T.candidates_text(F.col("by")), F.lit(")"))).otherwise(F.lit("")))
        zero = F.lit(0).cast("long")
        named = rows.select("file", F.col("line").cast("int").alias("line"), F.col("name").alias("unit_name"), F.lit("test_coverage").alias("metric"), zero.alias("value"), zero.alias("threshold"), message.alias("message"), F.when(unused, F.lit("Add an import in a test file, or remove if dead.")).otherwise(F.lit("")).alias("suggestion"))
        return rules.focus(named, focus).orderBy("file", "line", "unit_name")

    def covering(self) -> DataFrame:
        return resolve.covering_tests(self.definitions, extract.test_usages(self.files))

    def tests_of(self, changed: DataFrame) -> DataFrame:
        """(test_file, test_id) to run for changed files: tests that cover them, and tests in them."""
        files = changed.select(F.col(changed.columns[0]).alias("file")).distinct()
        covering = self.covering().join(files, "file", "left_semi").select("test_file", "test_id")
        own = extract.test_usages(self.files).join(files.withColumnRenamed("file", "test_file"), "test_file", "left_semi").select("test_file", "test_id")
        return covering.unionByName(own).distinct()

    def coverage(self) -> DataFrame:
        return rules.coverage_by_file(self.definitions, self.uncovered)

    # analyses

    def long(self) -> DataFrame:
        """(language, file, name, line, inside_class, metric, value) of units and modules."""
        measures = [c for c in self.units.columns if c in METRIC_IDS]
        units = profile.to_long(self.units.withColumnRenamed("path", "file"), ["language", "file", "name", "line", "inside_class"], measures)
        whole = units
        for language in self.languages:
            rows = self.module_metrics(language).select(F.lit(language).alias("language"), F.col("path").alias("file"), F.col("node").alias("name"), F.lit(1).alias("line"), F.lit(False).alias("inside_class"), *(c for c in ("fan_in", "fan_out", "cycle_size", "indirect_dependencies", "dependency_depth")))
            whole = whole.unionByName(profile.to_long(rows, ["language", "file", "name", "line", "inside_class"], ["fan_in", "fan_out", "cycle_size", "indirect_dependencies", "dependency_depth"]))
        inverse = self.files.select("language", F.col("path").alias("file")).join(self.coverage().select("file", "percent"), "file", "left")
        inverse = inverse.select("language", "file", T.stem(F.col("file")).alias("name"), F.lit(1).alias("line"), F.lit(False).alias("inside_class"), F.lit("inv_test_coverage").alias("metric"), profile.inverse_coverage(F.coalesce("percent", F.lit(100))).alias("value"))
        return whole.unionByName(inverse)

    def violations(self, focus: DataFrame | None = None) -> DataFrame:
        """Everything over its threshold, orphans, and cycles once each."""
        held = thresholds(self.spark, self.settings.limits)
        graph_only = ["cycle_size", "indirect_dependencies", "dependency_depth"]
        many = self.files.limit(2).count() > 1
        rows = rules.exempt_methods(self.long())
        rows = rows.filter(~F.col("metric").isin("fan_in", "fan_out", "inv_test_coverage"))
        roots = F.col("file").rlike("(^|/)(src|tests)/(lib|main|build)\\.rs$")
        rows = rows.filter(~((F.col("metric") == "indirect_dependencies") & roots))
        rows = rows.filter(~F.col("metric").isin(*graph_only)) if not many else rows
        over = rules.violations(rows, held, ["language", "metric"])
        firsts = None
        for language in self.languages:
            part = self.components(language).groupBy("scc").agg(F.min("node").alias("name")).select(F.lit(language).alias("language"), "name")
            firsts = part if firsts is None else firsts.unionByName(part)
        if firsts is not None:
            rings = over.filter("metric = 'cycle_size'").join(firsts, ["language", "name"], "left_semi")
            over = over.filter("metric <> 'cycle_size'").unionByName(rings)
        advice = F.coalesce(*(F.when(F.col("metric") == m, F.lit(text)) for m, (_, text) in ADVICE.items()), F.lit(""))
        named = over.select("file", F.col("line").cast("int").alias("line"), F.col("name").alias("unit_name"), "metric", "value", "threshold", F.format_string("%s is %d (threshold: %d)", "metric", "value", "threshold").alias("message"), advice.alias("suggestion"))
        if many and self.settings.gate["orphan_module_enabled"]:
            for language in self.languages:
                named = named.unionByName(self.orphans(language).select(F.col("path").alias("file"), F.lit(1).alias("line"), F.col("node").alias("unit_name"), F.lit("orphan_module").alias("metric"), F.lit(0).cast("long").alias("value"), F.lit(0).cast("long").alias("threshold"), F.concat(F.lit("Module '"), "node", F.lit("' has no dependencies and nothing depends on it")).alias("message"), F.lit("Use it, or remove it.").alias("suggestion")))
        return rules.focus(named, focus)

    def orphans(self, language: str) -> DataFrame:
        measured = self.module_metrics(language)
        busy = measured.filter("fan_in + fan_out > 0").select("path").distinct()
        exempt = T.is_entry_point(F.col("node")) | T.in_tests_dir(F.col("path")) | (T.stem(F.col("path")) == "__init__")
        return graph.orphans(measured, exempt).join(busy, "path", "left_anti").select("node", "path")

    def duplicate_pairs(self, language: str | None = None, focus: DataFrame | None = None) -> DataFrame:
        """(id1, id2, similarity), alike ones first, then by chunk; with a focus, pairs that touch its files."""
        d = self.settings.duplicates
        rows = self.chunks if language is None else self.chunks.filter(F.col("language") == language)
        signed = materialise(dedup.signatures(rows, "chunk_id", "text", d["shingle"], d["hashes"]), "signatures")
        pairs = dedup.verified(dedup.candidates(signed, "chunk_id", d["bands"], d["largest_bucket"]), signed, "chunk_id", self.settings.gate["min_similarity"])
        pairs = dedup.drop_nested(pairs, rows, "chunk_id")
        return (pairs if focus is None else dedup.touching(pairs, rows, "chunk_id", focus)).orderBy(F.desc("similarity"), "id1", "id2")

    def dry_lines(self, focus: DataFrame | None = None) -> DataFrame:
        """(line) of every pair, in the order of duplicate_pairs."""
        side = lambda k: self.chunks.select(F.col("chunk_id").alias(f"id{k}"), F.col("path").alias(f"file{k}"), F.col("start_line").alias(f"start{k}"), F.col("end_line").alias(f"end{k}"))
        pairs = self.duplicate_pairs(focus=focus).join(side(1), "id1").join(side(2), "id2")
        return pairs.orderBy(F.desc("similarity"), "id1", "id2").select(render.dry_line().alias("line"))

    def duplicate_clusters(self, language: str, focus: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(members, summary) of the clusters of a language; larger clusters first, then those more alike."""
        pairs = materialise(self.duplicate_pairs(language), "pairs")
        members = dedup.clusters(pairs)
        rows = members.join(self.chunks.withColumnRenamed("chunk_id", "id"), "id").select("cluster_id", "id", F.col("path").alias("file"), "name", "start_line", "end_line")
        if focus is not None:
            rows = rules.focus_clusters(rows, focus)
        return rows, dedup.cluster_summary(pairs, members).orderBy(F.desc("size"), F.desc("avg_similarity"), "cluster_id")

    def status(self, focus: DataFrame | None = None) -> DataFrame:
        """One row: violations, orphans among them, clusters of duplicates, and whether and how a check ends."""
        over = self.violations(focus).agg(F.count("*").alias("violations"), F.count_if(F.col("metric") == "orphan_module").alias("orphans"))
        copies = self.spark.createDataFrame([], "cluster_id string")
        if self.settings.gate["duplication_enabled"]:
            for language in self.languages:
                copies = copies.unionByName(self.duplicate_clusters(language, focus)[0].select("cluster_id").distinct())
        both = over.join(copies.agg(F.count("*").alias("duplicate_clusters")))  # one row each
        failed = (F.col("violations") > 0) | (F.col("duplicate_clusters") > 0)
        return both.select("*", failed.alias("failed"), failed.cast("int").alias("exit_code"))

    def layout(self, title: str = "tree") -> DataFrame:
        """(part, ord, line) of the layout report over the graphs of all languages, whose nodes are prefixed."""
        prefixes = {"python": "py", "rust": "rs"}
        nodes, edges, groups = (self.spark.createDataFrame([], kind) for kind in ("node string", "src string, dst string", "node string, grp string"))
        for language in self.languages:
            more, links = graph.with_prefix(self.nodes(language).select("node"), self.edges(language), prefixes[language])
            nodes, edges = nodes.unionByName(more), edges.unionByName(links)
            place = self.nodes(language).select(F.concat(F.lit(prefixes[language] + ":"), "node").alias("node"), F.regexp_replace("path", "/?[^/]*$", "").alias("grp"))
            groups = groups.unionByName(place)
        nodes, edges = materialise(nodes, "nodes"), materialise(edges, "edges")
        found = materialise(graph.strong_components(nodes, edges), "scc")
        layered = materialise(graph.layers(edges, found), "layers")
        count = lambda df, name: df.agg(F.count("*").alias(name))
        summary = count(graph.cycles(found), "cycles").join(count(graph.layer_violations(edges, layered), "layer_violations")).join(count(graph.cross_group(edges, groups), "cross_group"))  # one row each
        return render.layout_lines(summary, found.filter("size >= 2"), graph.break_edges(edges, found), layered, graph.what_if(nodes, edges), title)

    def rules(self) -> DataFrame:
        """(language, metric, op, threshold, ord, line) of the limits in force."""
        held = thresholds(self.spark, self.settings.limits).join(metrics(self.spark), "metric")
        text = F.coalesce(*(F.when(F.col("metric") == m, F.lit(what)) for m, (what, _) in ADVICE.items()))
        line = F.format_string("RULE: [%s] [%s <= %d] %s", "language", "metric", "threshold", text)
        return held.filter(text.isNotNull()).select("language", "metric", F.lit("<=").alias("op"), "threshold", "ord", line.alias("line")).orderBy("language", "ord")

    def summary_line(self) -> DataFrame:
        found = self.totals().groupBy().pivot("metric", ["files", "code_units", "statements", "graph_nodes", "graph_edges"]).agg(F.first("value"))
        return found.select(render.summary_line().alias("line"))

    def test_commands(self, changed: DataFrame) -> DataFrame:
        """(language, command) that runs the tests of changed files."""
        by = self.files.select(F.col("path").alias("test_file"), "language")
        return render.test_commands(self.tests_of(changed).join(by, "test_file"))

    def stats(self) -> DataFrame:
        """Distribution of every metric by language, in registry order by `ord`."""
        return profile.percentiles(self.long(), ["language", "metric"]).join(F.broadcast(metrics(self.spark).select("metric", "ord")), "metric")

    def top(self, n: int = 10) -> DataFrame:
        return profile.top_n(self.long(), n, ["file", "line", "name"]).select("metric", "value", "file", "line", "name", "rank")

    def mimic(self) -> dict[tuple[str, str], int]:
        """Thresholds that this tree just meets; one number for each language and metric."""
        rows = profile.maxima(self.long().filter(~F.col("metric").isin("fan_in", "fan_out", "inv_test_coverage")), ["language", "metric"]).collect()
        return {(r.language, r.metric): r.threshold for r in rows}

    def mimic_gate(self) -> dict:
        overall = rules.overall_coverage(self.coverage()).first()
        orphan = any(not self.orphans(language).isEmpty() for language in self.languages)
        return dict(self.settings.gate) | {"test_coverage_threshold": overall.min_percent, "duplication_enabled": self.duplicate_pairs().isEmpty(), "orphan_module_enabled": not orphan}

    def totals(self) -> DataFrame:
        """(metric, value): files, units, statements, graph nodes and edges over all languages."""
        units = self.units.agg(F.count_distinct("path").alias("files"), F.count("*").alias("code_units"), F.coalesce(F.sum("statements_per_function"), F.lit(0)).alias("statements"))
        whole = units.unpivot([], units.columns, "metric", "value")
        edges = sum(self.edges(language).count() for language in self.languages)
        more = self.spark.createDataFrame([("graph_nodes", self.modules.count()), ("graph_edges", edges)], "metric string, value bigint")
        return whole.unionByName(more)

    def failing_files(self, focus: DataFrame | None = None) -> DataFrame:
        """(file, definitions, covered, percent) under the coverage threshold, by file."""
        least = self.settings.gate["test_coverage_threshold"]
        return rules.focus(self.coverage(), focus).filter(F.col("percent") < least).orderBy("file")

    def gate(self, focus: DataFrame | None = None) -> DataFrame:
        rows = rules.focus(self.coverage(), focus)
        return rules.gate(rules.overall_coverage(rows), self.settings.gate["test_coverage_threshold"])
