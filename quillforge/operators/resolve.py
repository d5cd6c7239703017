"""Name resolution: imports to modules, and definitions to what refers to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolve_exact(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(src, dst): imports(module, import) whose text is a module's full name."""
    return imports.join(modules.select(F.col("module").alias("import")), "import").select(F.col("module").alias("src"), F.col("import").alias("dst")).filter("src <> dst").distinct()


def resolve_bare(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(src, dst): imports without a dot that are the bare name of one module, or of one module below the
    importer's parent; modules has (module, bare), imports (module, import, parent)."""
    rows = imports.filter(~F.col("import").contains(".")).select("module", "import", "parent").distinct()
    met = rows.join(modules.select(F.col("module").alias("dst"), F.col("bare").alias("import")), "import")
    near = F.coalesce(F.col("parent"), F.lit("")) != ""
    below = near & F.startswith(F.col("dst"), F.concat("parent", F.lit(".")))
    each = Window.partitionBy("module", "import")
    counted = met.withColumn("_all", F.count("*").over(each)).withColumn("_below", F.count_if(below).over(each))
    return counted.filter((F.col("_all") == 1) | (below & (F.col("_below") == 1))).select(F.col("module").alias("src"), "dst").filter("src <> dst").distinct()


def resolve_dotted(imports: DataFrame, modules: DataFrame, strict: bool = False) -> DataFrame:
    """(src, dst): imports with dots that a module's name ends with; several may match, the importer's
    package decides if it leaves one. Without `strict` the end need not be at a dot."""
    rows = imports.filter(F.col("import").contains(".")).select("module", "import", "parent").distinct().withColumn("bare", F.element_at(F.split("import", "\\."), -1))
    met = rows.join(modules.select(F.col("module").alias("dst"), "bare"), "bare")
    ends = (F.col("dst") == F.col("import")) | F.endswith(F.col("dst"), F.concat(F.lit("."), "import")) if strict else F.endswith(F.col("dst"), F.col("import"))
    below = (F.coalesce(F.col("parent"), F.lit("")) != "") & F.startswith(F.col("dst"), F.concat("parent", F.lit(".")))
    each = Window.partitionBy("module", "import")
    counted = met.filter(ends).withColumn("_all", F.count("*").over(each)).withColumn("_below", F.count_if(below).over(each))
    return counted.filter((F.col("_all") == 1) | (F.col("_below") != 1) | below).select(F.col("module").alias("src"), "dst").filter("src <> dst").distinct()


def dependency_edges(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Exact names first; what they leave goes by bare or dotted names. Other modules make no edge."""
    exact = resolve_exact(imports, modules)
    rest = imports.join(modules.select(F.col("module").alias("import")), "import", "left_anti")
    return exact.unionByName(resolve_bare(rest, modules)).unionByName(resolve_dotted(rest, modules)).distinct()


def resolve_rust(uses: DataFrame, modules: DataFrame) -> DataFrame:
    """(src, dst): full names, else every module of that bare name; uses has (module, import, kind, parent),
    where `mod` declares a child of the parent (which lib, main and build do not name)."""
    full = F.when((F.col("kind") == "mod") & (F.coalesce(F.col("parent"), F.lit("")) != ""), F.concat_ws(".", "parent", "import")).otherwise(F.col("import"))
    rows = uses.withColumn("full", full).select("module", "import", "full").distinct()
    exact = rows.join(modules.select(F.col("module").alias("full")), "full").select("module", "import", F.col("full").alias("dst"))
    loose = rows.join(exact.select("module", "import"), ["module", "import"], "left_anti").join(modules.select(F.col("module").alias("dst"), F.col("bare").alias("import")), "import").select("module", "import", "dst")
    return exact.unionByName(loose).select(F.col("module").alias("src"), "dst").filter("src <> dst").distinct()


def ambiguous(definitions: DataFrame, name: str = "name", file: str = "file") -> DataFrame:
    """(name, files) of names that more than one file defines."""
    return definitions.groupBy(name).agg(F.count_distinct(file).alias("files")).filter("files > 1")


def disambiguate(definitions: DataFrame, identifiers: DataFrame, references: DataFrame) -> DataFrame:
    """(name, file): the one file of an ambiguous name that has a path identifier which is referred to
    and which no other candidate has; definitions(file, name), identifiers(file, ident), references(ref)."""
    many = definitions.select("file", "name").distinct().join(ambiguous(definitions).select("name"), "name", "left_semi")
    owned = many.join(identifiers.distinct(), "file").join(references.select(F.col("ref").alias("ident")).distinct(), "ident", "left_semi")
    alone = owned.groupBy("name", "ident").agg(F.count("*").alias("_n"), F.min("file").alias("file")).filter("_n = 1")
    return alone.groupBy("name").agg(F.count_distinct("file").alias("_n"), F.min("file").alias("file")).filter("_n = 1").select("name", "file")


def chosen_by_import(definitions: DataFrame, usages: DataFrame, file_modules: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, file): the one candidate file of an ambiguous name whose module a test file that uses the
    name imports; a name with a candidate outside the graph has none. usages has (test_file, ref),
    file_modules (file, module), edges (src, dst)."""
    many = definitions.select("file", "name").distinct().join(ambiguous(definitions).select("name"), "name", "left_semi")
    placed = many.join(file_modules, "file", "left")
    whole = placed.groupBy("name").agg(F.count_if(F.col("module").isNull()).alias("_out")).filter("_out = 0").select("name")
    using = usages.select("test_file", F.col("ref").alias("name")).distinct().join(whole, "name", "left_semi")
    inside = using.join(file_modules.select(F.col("file").alias("test_file"), F.col("module").alias("src")), "test_file").select("name", "src").distinct()
    met = placed.join(inside, "name").join(edges.select("src", F.col("dst").alias("module")), ["src", "module"], "left_semi").select("name", "file").distinct()
    return met.groupBy("name").agg(F.count("*").alias("_n"), F.min("file").alias("file")).filter("_n = 1").select("name", "file")


def uncovered(definitions: DataFrame, references: DataFrame, bindings: DataFrame | None = None, suffixes: DataFrame | None = None, chosen: DataFrame | None = None) -> DataFrame:
    """Definitions (file, name, owner, ...) that nothing covers. One is covered if

    its owner is referred to; or it is referred to by a name that one file defines (or that `chosen`
    gives to its file); or a test imports it from a module that is, or ends, its file's dotted name:
    bindings(module, name), suffixes(file, suffix)."""
    refs = references.select(F.col("ref")).distinct()
    many = ambiguous(definitions).select("name", F.lit(True).alias("_many"))
    hit = definitions.join(refs.select(F.col("ref").alias("name"), F.lit(True).alias("_named")), "name", "left").join(many, "name", "left")
    hit = hit.join(refs.select(F.col("ref").alias("owner"), F.lit(True).alias("_owned")), "owner", "left")
    covered = F.coalesce("_owned", F.lit(False)) | (F.coalesce("_named", F.lit(False)) & F.col("_many").isNull())
    if chosen is not None:
        hit = hit.join(chosen.select("name", "file", F.lit(True).alias("_chosen")), ["name", "file"], "left")
        covered = covered | (F.coalesce("_chosen", F.lit(False)) & F.coalesce("_named", F.lit(False)))
    if bindings is not None and suffixes is not None:
        named = definitions.select("file", "name").distinct().join(suffixes, "file").join(bindings.distinct(), "name")
        met = named.filter((F.col("suffix") == F.col("module")) | F.endswith(F.col("suffix"), F.concat(F.lit("."), "module"))).select("file", "name", F.lit(True).alias("_bound")).distinct()
        hit = hit.join(met, ["file", "name"], "left")
        covered = covered | F.coalesce("_bound", F.lit(False))
    return hit.filter(~covered).select(definitions.columns)


def covering_tests(definitions: DataFrame, usages: DataFrame) -> DataFrame:
    """(file, name, test_file, test_id) distinct, by the definition's own name or its owner's;
    usages has (test_file, test_id, ref)."""
    keys = definitions.select("file", "name", F.explode(F.array_distinct(F.array_compact(F.array("name", "owner")))).alias("ref")).distinct()
    return keys.join(usages, "ref").select("file", "name", "test_file", "test_id").distinct()


def resolved_uses(definitions: DataFrame, usages: DataFrame, identifiers: DataFrame, winners: DataFrame) -> DataFrame:
    """(file, name, test_file, test_id, evidence): every use of a name, given to one of its definitions.

    2: the using test also refers to an identifier of the definition's file (the first such file); else 1:
    one file alone defines the name, or `winners` (name, file) has one for it; else 0: the first of its files. Evidence is
    looked up from the identifiers that a test refers to, so no use meets all definitions of a frequent name."""
    defs = definitions.select("file", "name").distinct()
    used = usages.select("test_file", "test_id", F.col("ref").alias("name")).join(defs.select("name").distinct(), "name", "left_semi").distinct()
    seen = usages.select("test_file", "test_id", F.col("ref").alias("ident")).join(identifiers.select("file", "ident").distinct(), "ident").select("test_file", "test_id", "file").distinct()
    key = ["test_file", "test_id", "name"]
    near = seen.join(defs, "file").join(used, key).groupBy(*key).agg(F.min("file").alias("_near"))
    least = defs.groupBy("name").agg(F.min("file").alias("_first"), F.count("*").alias("_n")).join(winners.select("name", F.col("file").alias("_won")), "name", "left")
    whole = used.join(near, key, "left").join(least, "name")
    evidence = F.when(F.col("_near").isNotNull(), 2).when((F.col("_n") == 1) | F.col("_won").isNotNull(), 1).otherwise(0).cast("int")
    return whole.select(F.coalesce("_near", "_won", "_first").alias("file"), "name", "test_file", "test_id", evidence.alias("evidence"))
