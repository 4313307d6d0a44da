"""Call and import edges of snapshots: who depends on what.

Edges carry repo_path and git_hash; every operator joins within a snapshot. Callees match on
(callee_path, qualified name); matching by bare name alone is an option.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import module_name

RUN = ["repo_path", "git_hash"]
MAX_DEPENDENTS = 15
OVERVIEW_FILES, OVERVIEW_SYMBOLS = 60, 20
SHOWN_EDGES = 500


def callers_of(edges: DataFrame, name: str) -> DataFrame:
    return edges.where(F.col("callee_name") == name)


def importers_of(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Import edges (repo_path, git_hash, rel_path, module) of the modules (repo_path, git_hash, module)."""
    return imports.join(modules.select(*RUN, "module").distinct(), [*RUN, "module"], "left_semi")


def reverse_dependencies(edges: DataFrame, changed: DataFrame, symbols: DataFrame, imports: DataFrame | None = None, by_name: bool = False) -> DataFrame:
    """(repo_path, git_hash, rel_path) of the files one hop from changed (repo_path, git_hash, rel_path), themselves left out."""
    changed = changed.select(*RUN, "rel_path").distinct()
    if by_name:
        names = symbols.join(changed, [*RUN, "rel_path"], "left_semi").select(*RUN, F.col("qualified_name").alias("callee_qname")).distinct()
        callers = edges.join(names, [*RUN, "callee_qname"], "left_semi")
    else:
        defined = symbols.join(changed, [*RUN, "rel_path"], "left_semi").select(
            *RUN, F.col("rel_path").alias("callee_path"), F.col("qualified_name").alias("callee_qname")
        )
        callers = edges.join(defined.distinct(), [*RUN, "callee_path", "callee_qname"], "left_semi")
    found = callers.select(*RUN, F.col("caller_path").alias("rel_path"))
    if imports is not None:
        modules = changed.select(*RUN, module_name(F.col("rel_path")).alias("module")).where("module <> ''")
        found = found.unionByName(importers_of(imports, modules).select(*RUN, "rel_path"))
    return found.distinct().join(changed, [*RUN, "rel_path"], "left_anti")


def first_dependents(dependents: DataFrame, files: DataFrame, n: int = MAX_DEPENDENTS) -> DataFrame:
    """The first n dependents of each snapshot, by path, that are files of it."""
    there = dependents.join(files.select(*RUN, "rel_path").distinct(), [*RUN, "rel_path"], "left_semi")
    order = Window.partitionBy(*RUN).orderBy("rel_path")
    return there.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)


def graph_stats(symbols: DataFrame, edges: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """(repo_path, git_hash, n_files, n_symbols, n_calls, n_imports) of each snapshot."""
    s = symbols.groupBy(*RUN).agg(F.countDistinct("rel_path").alias("n_files"), F.count("*").alias("n_symbols"))
    e = edges.groupBy(*RUN).agg(F.count("*").alias("n_calls"))
    out = s.join(e, RUN, "full")
    if imports is not None:
        out = out.join(imports.groupBy(*RUN).agg(F.count("*").alias("n_imports")), RUN, "full")
    counts = [c for c in out.columns if c not in RUN]
    return out.select(*RUN, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts])


def symbol_overview(symbols: DataFrame, n_files: int = OVERVIEW_FILES, n_symbols: int = OVERVIEW_SYMBOLS) -> DataFrame:
    """(repo_path, git_hash, rel_path, shown, more) of the first files of each snapshot and their first symbols by symbol_id."""
    per_file = symbols.groupBy(*RUN, "rel_path").agg(F.count("*").alias("n"))
    by_path = Window.partitionBy(*RUN).orderBy("rel_path")
    files = per_file.withColumn("_file", F.row_number().over(by_path)).where(F.col("_file") <= n_files)
    order = Window.partitionBy(*RUN, "rel_path").orderBy("symbol_id")
    top = symbols.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n_symbols)
    label = F.concat("kind", F.lit(" "), "qualified_name", F.lit(" (L"), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"), F.lit(")"))
    shown = top.groupBy(*RUN, "rel_path").agg(F.array_sort(F.collect_list(F.struct("_rank", label.alias("label")))).alias("rows"))
    text = F.array_join(F.transform("rows", lambda r: r["label"]), "\n")
    return files.join(shown, [*RUN, "rel_path"]).select(*RUN, "rel_path", text.alias("shown"), F.greatest(F.lit(0), F.col("n") - n_symbols).alias("more"))


def symbols_per_file(symbols: DataFrame) -> DataFrame:
    """(repo_path, git_hash, rel_path, symbols): the symbols of each file, by line."""
    entry = F.struct("line_start", "qualified_name", "kind", "line_end")
    return symbols.groupBy(*RUN, "rel_path").agg(F.array_sort(F.collect_set(entry)).alias("symbols"))


def symbol_calls(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(direction, repo_path, git_hash, name, edge_id) of the calls to and from names (repo_path, git_hash, name).

    A call to a name matches it bare or qualified; the alternative is the union of two equi joins.
    """
    n = names.select(*RUN, "name").distinct()
    by_name = edges.join(n.withColumnRenamed("name", "callee_name"), [*RUN, "callee_name"]).select(*RUN, F.col("callee_name").alias("name"), "edge_id")
    by_qname = edges.join(n.withColumnRenamed("name", "callee_qname"), [*RUN, "callee_qname"]).select(*RUN, F.col("callee_qname").alias("name"), "edge_id")
    out = edges.join(n.withColumnRenamed("name", "caller_qname"), [*RUN, "caller_qname"]).select(*RUN, F.col("caller_qname").alias("name"), "edge_id")
    into = by_name.unionByName(by_qname).withColumn("direction", F.lit("caller"))
    return into.unionByName(out.withColumn("direction", F.lit("callee"))).distinct()


def edges_of_file(edges: DataFrame, path: str, shown: int = SHOWN_EDGES) -> DataFrame:
    """The calls that a file makes or receives."""
    return edges.where((F.col("caller_path") == path) | (F.col("callee_path") == path)).orderBy("edge_id").limit(shown)


def module_files(modules: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_path, git_hash, module, rel_path): a package's __init__ before a module file, null where there is neither."""
    base = F.translate("module", ".", "/")
    options = modules.select(*RUN, "module", F.posexplode(F.array(F.concat(base, F.lit("/__init__.py")), F.concat(base, F.lit(".py")))).alias("choice", "rel_path"))
    there = options.join(files.select(*RUN, "rel_path").distinct(), [*RUN, "rel_path"])
    best = there.groupBy(*RUN, "module").agg(F.min_by("rel_path", "choice").alias("rel_path"))
    return modules.select(*RUN, "module").distinct().join(best, [*RUN, "module"], "left")


def resolved_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame, files: DataFrame) -> DataFrame:
    """calls (repo_path, git_hash, caller_path, caller_qname, callee_name, line) with callee_path and callee_qname.

    An approximation by names: a symbol of the caller's own file before one of a module it imports
    the name from. What neither has stays null.
    """
    defined = symbols.select(*RUN, "rel_path", "name", "qualified_name")
    own = calls.join(
        defined.select(*RUN, F.col("rel_path").alias("caller_path"), F.col("name").alias("callee_name"), F.col("rel_path").alias("callee_path"), F.col("qualified_name").alias("callee_qname"), F.lit(0).alias("choice")),
        [*RUN, "caller_path", "callee_name"],
    )
    named = imports.select(*RUN, F.col("rel_path").alias("caller_path"), "module", "imported_name", F.coalesce("alias", "imported_name").alias("callee_name"))
    homes = module_files(named.select(*RUN, "module"), files).where("rel_path is not null").withColumnRenamed("rel_path", "callee_path")
    targets = named.join(homes, [*RUN, "module"]).join(
        defined.select(*RUN, F.col("rel_path").alias("callee_path"), F.col("name").alias("imported_name"), F.col("qualified_name").alias("callee_qname")),
        [*RUN, "callee_path", "imported_name"],
    )
    far = calls.join(targets.select(*RUN, "caller_path", "callee_name", "callee_path", "callee_qname", F.lit(1).alias("choice")), [*RUN, "caller_path", "callee_name"])
    key = [*RUN, "caller_path", "caller_qname", "callee_name", "line"]
    order = F.struct("choice", "callee_path", "callee_qname")
    best = own.unionByName(far).groupBy(*key).agg(F.min_by(F.struct("callee_path", "callee_qname"), order).alias("to"))
    return calls.select(key).distinct().join(best, key, "left").select(*key, "to.callee_path", "to.callee_qname")
