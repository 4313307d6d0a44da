"""Queries over index tables: files, runs, symbols, calls, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths
from ..operators import graph, indexing, store
from ..operators.evals import missing_dependents
from ..operators.symbols import enclosing_symbols
from ..sources.tables import table

RUN = ["repo_path", "git_hash"]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "file_entries").dropDuplicates(["entry_id"])


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "symbols").dropDuplicates(["symbol_id"])


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "call_edges").dropDuplicates(["edge_id"])


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "index_runs").groupBy(*RUN).agg(F.max("indexed_at").alias("indexed_at"), F.max("file_count").alias("file_count"))


def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo_path, git_hash, rel_path) of the files that reviews of a snapshot change."""
    last = table(spark, sf_dir, "reviews").groupBy("review_id").agg(F.max(F.struct("ingested_at", *RUN)).alias("x"))
    chunks = table(spark, sf_dir, "diff_chunks").select("review_id", F.regexp_replace("file_path", r"^(?:\./)+", "").alias("rel_path")).distinct()
    return chunks.join(last.select("review_id", "x.repo_path", "x.git_hash"), "review_id").select(*RUN, "rel_path").distinct()


def language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).select(paths.language(F.col("rel_path")).alias("found"), F.lower(F.trim("language")).alias("stated"))
    return rows.groupBy("found", "stated").agg(F.count("*").alias("n_files"))


def path_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test code, files irrelevant to security, files a walk ignores."""
    path = F.col("rel_path")
    kinds = {"is_test": paths.is_test_path(path), "irrelevant": paths.is_irrelevant(path), "ignored": paths.is_ignored(path), "is_python": path.endswith(".py")}
    rows = files(spark, sf_dir).select("rel_path", *[c.alias(n) for n, c in kinds.items()])
    return rows.groupBy(*kinds).agg(F.count("*").alias("n_files"))


def path_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "diff_chunks").select("file_path").distinct()
    return rows.select("file_path", paths.path_key(F.col("file_path")).alias("path_key"))


def module_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).select("rel_path").distinct()
    return rows.select("rel_path", paths.module_name(F.col("rel_path")).alias("module"))


def module_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir)
    modules = rows.select(*RUN, paths.module_name(F.col("rel_path")).alias("module")).where("module <> ''")
    return graph.module_files(modules, rows)


def _successive(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The files of every run, and under its hash those of the run before it."""
    before = F.lag("git_hash").over(Window.partitionBy("repo_path").orderBy("indexed_at", "git_hash"))
    pairs = runs(spark, sf_dir).withColumn("before", before).select(*RUN, "before")
    entries = files(spark, sf_dir)
    current = entries.join(pairs.select(RUN), RUN, "left_semi")
    scope = F.concat_ws("@", "repo_path", "git_hash").alias("repo_path")
    older = pairs.where("before is not null").select("repo_path", F.col("git_hash").alias("now"), F.col("before").alias("git_hash"))
    previous = entries.join(older, RUN).select(F.concat_ws("@", "repo_path", "now").alias("repo_path"), "git_hash", "rel_path", "content_hash")
    return current.withColumn("run", F.concat_ws("@", *RUN)).select(scope, "git_hash", "rel_path", "content_hash", "language", "entry_id"), previous


def incremental_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every run how many files are parsed, reused and skipped, compared with the run before it."""
    current, previous = _successive(spark, sf_dir)
    return indexing.counters(indexing.compared(current, previous)).drop("git_hash")


def files_to_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, previous = _successive(spark, sf_dir)
    return indexing.to_parse(current, previous).select("entry_id")


def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexing.latest_runs(table(spark, sf_dir, "index_runs")).select("repo_path", "git_hash")


def latest_wins_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews as first ingested, with later deliveries written over them; the repository stays as first written."""
    rows = table(spark, sf_dir, "reviews").dropDuplicates().withColumn("seq", F.struct("ingested_at", "created_at", "max_tokens"))
    columns = ["review_id", "repo_path", "max_tokens", "run_tests", "seq"]
    first = rows.groupBy("review_id").agg(F.min("seq").alias("seq"))
    old = rows.join(first, ["review_id", "seq"]).select(columns)
    new = rows.join(first, ["review_id", "seq"], "left_anti").select(columns)
    return store.upserted(old, new, ["review_id"], keep=["repo_path"]).select("review_id", "repo_path", F.coalesce("max_tokens", F.lit(0)).alias("max_tokens"), "run_tests")


def existence_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the snapshot of every review is indexed, and whether it has call edges."""
    wanted = table(spark, sf_dir, "reviews").select(RUN).distinct()
    probed = store.indexed(table(spark, sf_dir, "index_runs"), wanted)
    called = store.with_edges(wanted, table(spark, sf_dir, "call_edges")).withColumn("has_edges", F.lit(True))
    return probed.join(called, RUN, "left").withColumn("has_edges", F.coalesce("has_edges", F.lit(False)))


#: What the look-ups ask for unless they are told otherwise.
ASKED_REPO, ASKED_FOLDER, ASKED_NAME, ASKED_FILE = "/srv/repos/orchard-mono", "src/", "join", "src/api/noisy_segment.ts"


def point_read(spark: SparkSession, sf_dir: str, repo: str = ASKED_REPO, folder: str = ASKED_FOLDER) -> DataFrame:
    """The entries of one folder in all snapshots of one repository."""
    rows = table(spark, sf_dir, "file_entries").where((F.col("repo_path") == repo) & F.startswith("rel_path", F.lit(folder)))
    return rows.select("entry_id", "git_hash", "rel_path", "content_hash").dropDuplicates(["entry_id"])


def enclosing_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The innermost symbol round the line of every call."""
    calls = edges(spark, sf_dir).select("edge_id", *RUN, "caller_path", F.col("line").alias("line_start"), F.col("line").alias("line_end"))
    placed = enclosing_symbols(calls, symbols(spark, sf_dir), RUN, "caller_path", ["edge_id"])
    return placed.select("edge_id", "symbol", "symbol_kind")


def callers_of(spark: SparkSession, sf_dir: str, name: str = ASKED_NAME) -> DataFrame:
    return graph.callers_of(table(spark, sf_dir, "call_edges"), name).select("edge_id").distinct()


def reverse_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reverse_dependencies(edges(spark, sf_dir), changed_files(spark, sf_dir), symbols(spark, sf_dir))


def reverse_dependencies_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reverse_dependencies(edges(spark, sf_dir), changed_files(spark, sf_dir), symbols(spark, sf_dir), by_name=True)


def snapshot_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first dependents of the files that the reviews of each snapshot change."""
    found = graph.reverse_dependencies(edges(spark, sf_dir), changed_files(spark, sf_dir), symbols(spark, sf_dir))
    return graph.first_dependents(found, files(spark, sf_dir)).withColumn("position", F.col("position").cast("int"))


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import edges as the calls imply them: a Python file imports the module of every other one that it calls into."""
    calls = edges(spark, sf_dir).where("caller_path like '%.py' and callee_path <> caller_path")
    module = paths.module_name(F.col("callee_path"))
    return calls.select(*RUN, F.col("caller_path").alias("rel_path"), module.alias("module"), F.col("callee_name").alias("imported_name")).where("module <> ''").distinct()


def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports(spark, sf_dir).groupBy(*RUN, "rel_path", "module").agg(F.count("*").alias("n_names"))


def importers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that import a module of a changed file."""
    changed = changed_files(spark, sf_dir).select(*RUN, paths.module_name(F.col("rel_path")).alias("module")).where("module <> ''")
    return graph.importers_of(imports(spark, sf_dir), changed).select(*RUN, "rel_path", "module").distinct()


def dependents_by_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers of and importers from changed files, and of changed modules alone where their symbols are not known."""
    some = symbols(spark, sf_dir).where("kind = 'class'")
    return graph.reverse_dependencies(edges(spark, sf_dir), changed_files(spark, sf_dir), some, imports(spark, sf_dir))


def required_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a snapshot's importers of changed modules are all among its callers of changed files."""
    checked = reverse_dependencies(spark, sf_dir).groupBy(RUN).agg(F.collect_set("rel_path").alias("checked"))
    wanted = importers(spark, sf_dir).groupBy(RUN).agg(F.collect_set("rel_path").alias("wanted"))
    rows = wanted.join(checked, RUN, "left")
    return rows.select(*RUN, missing_dependents(F.col("wanted"), F.coalesce("checked", F.array().cast("array<string>"))).alias("missing"))


def import_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_stats(symbols(spark, sf_dir), edges(spark, sf_dir), imports(spark, sf_dir))


def resolved_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the names of calls lead to by the caller's own file and its imports, as an extractor without types resolves them."""
    calls = edges(spark, sf_dir).select(*RUN, "caller_path", "caller_qname", "callee_name", "line")
    named = imports(spark, sf_dir).withColumn("alias", F.lit(None).cast("string"))
    return graph.resolved_calls(calls, symbols(spark, sf_dir), named, files(spark, sf_dir))


def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_stats(symbols(spark, sf_dir), edges(spark, sf_dir))


def symbol_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.symbol_overview(symbols(spark, sf_dir))


def symbols_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph.symbols_per_file(symbols(spark, sf_dir))
    return rows.select(*RUN, "rel_path", F.array_join(F.transform("symbols", lambda s: F.concat(s["line_start"].cast("string"), F.lit(":"), s["qualified_name"])), ",").alias("symbols"))


def symbol_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls to and from every class."""
    names = symbols(spark, sf_dir).where("kind = 'class'").select(*RUN, F.col("qualified_name").alias("name"))
    return graph.symbol_calls(edges(spark, sf_dir), names)


def edges_of_file(spark: SparkSession, sf_dir: str, path: str = ASKED_FILE) -> DataFrame:
    rows = table(spark, sf_dir, "call_edges").where((F.col("caller_path") == path) | (F.col("callee_path") == path)).dropDuplicates(["edge_id"])
    return graph.edges_of_file(rows, path).select("edge_id")


QUERIES = {
    f.__name__: f
    for f in (
        language_counts, path_kinds, path_keys, module_names, module_files, incremental_reuse, files_to_parse, latest_run, latest_wins_upsert,
        existence_probe, point_read, enclosing_symbol, callers_of, reverse_dependencies, reverse_dependencies_by_name, snapshot_dependents,
        import_edges, importers, dependents_by_imports, required_dependents, import_stats, resolved_calls, graph_stats, symbol_overview, symbols_per_file, symbol_calls, edges_of_file,
    )
}

_FE = "fe AS (SELECT DISTINCT ON (entry_id) * FROM file_entries)"
_SY = "sy AS (SELECT DISTINCT ON (symbol_id) * FROM symbols)"
_CE = "ce AS (SELECT DISTINCT ON (edge_id) * FROM call_edges)"
_SUFFIX = r"lower(regexp_extract(rel_path, '[^/]\.([^./]+)$', 1))"
_LANGUAGE = f"CASE {_SUFFIX} {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in paths.LANGUAGES.items())} END"
_LIST = lambda xs: ", ".join(f"'{x}'" for x in xs)
_RUNS = """r AS (SELECT repo_path, git_hash, max(indexed_at) AS indexed_at FROM index_runs GROUP BY ALL),
  p AS (SELECT *, lag(git_hash) OVER (PARTITION BY repo_path ORDER BY indexed_at, git_hash) AS before FROM r)"""
_CHANGED = """last AS (SELECT * FROM reviews QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY ingested_at DESC, repo_path DESC, git_hash DESC) = 1),
  changed AS (SELECT DISTINCT repo_path, git_hash, regexp_replace(file_path, '^(?:\\./)+', '') AS rel_path FROM diff_chunks JOIN last USING (review_id))"""


def _dependents(match: str) -> str:
    return f"""SELECT DISTINCT e.repo_path, e.git_hash, e.caller_path AS rel_path FROM ce e
      JOIN sy s ON s.repo_path = e.repo_path AND s.git_hash = e.git_hash AND s.qualified_name = e.callee_qname {match}
      JOIN changed c ON c.repo_path = s.repo_path AND c.git_hash = s.git_hash AND c.rel_path = s.rel_path
      WHERE NOT EXISTS (SELECT 1 FROM changed x WHERE x.repo_path = e.repo_path AND x.git_hash = e.git_hash AND x.rel_path = e.caller_path)"""


_SAME_PATH = "AND s.rel_path = e.callee_path"
_MODULE = r"CASE WHEN rel_path LIKE '%.py' THEN regexp_replace(replace(regexp_replace(rel_path, '\.py$', ''), '/', '.'), '(^|\.)__init__$', '') ELSE '' END"

def _module_of(path: str) -> str:
    return _MODULE.replace("rel_path", path)


_IMPORTS = f"""im AS (SELECT DISTINCT repo_path, git_hash, caller_path AS rel_path, {_module_of("callee_path")} AS module, callee_name AS imported_name
  FROM ce WHERE caller_path LIKE '%.py' AND callee_path <> caller_path AND {_module_of("callee_path")} <> '')"""
_IMPORTERS = f"""ip AS (SELECT DISTINCT im.repo_path, im.git_hash, im.rel_path, im.module FROM im JOIN (
  SELECT repo_path, git_hash, {_MODULE} AS module FROM changed WHERE {_MODULE} <> '') c USING (repo_path, git_hash, module))"""
_HOME = "im.repo_path = e.repo_path AND im.git_hash = e.git_hash AND im.rel_path = e.caller_path AND im.imported_name = e.callee_name"

SQL = {
    "import_edges": f"WITH {_CE}, {_IMPORTS} SELECT repo_path, git_hash, rel_path, module, count(*) AS n_names FROM im GROUP BY ALL",
    "importers": f"WITH {_CE}, {_CHANGED}, {_IMPORTS}, {_IMPORTERS} SELECT * FROM ip",
    "dependents_by_imports": f"""WITH {_CE}, {_CHANGED}, {_IMPORTS}, {_IMPORTERS}, sy AS (SELECT DISTINCT ON (symbol_id) * FROM symbols WHERE kind = 'class'),
        d AS ({_dependents(_SAME_PATH)} UNION SELECT repo_path, git_hash, rel_path FROM ip)
        SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM changed x WHERE x.repo_path = d.repo_path AND x.git_hash = d.git_hash AND x.rel_path = d.rel_path)""",
    "required_dependents": f"""WITH {_SY}, {_CE}, {_CHANGED}, {_IMPORTS}, {_IMPORTERS}, d AS ({_dependents(_SAME_PATH)})
        SELECT ip.repo_path, ip.git_hash, count(*) FILTER (d.rel_path IS NULL) > 0 AS missing FROM (SELECT DISTINCT repo_path, git_hash, rel_path FROM ip) ip
        LEFT JOIN d ON d.repo_path = ip.repo_path AND d.git_hash = ip.git_hash AND d.rel_path = ip.rel_path GROUP BY ALL""",
    "import_stats": f"""WITH {_SY}, {_CE}, {_IMPORTS}, a AS (SELECT repo_path, git_hash, count(DISTINCT rel_path) AS n_files, count(*) AS n_symbols FROM sy GROUP BY ALL),
        b AS (SELECT repo_path, git_hash, count(*) AS n_calls FROM ce GROUP BY ALL), c AS (SELECT repo_path, git_hash, count(*) AS n_imports FROM im GROUP BY ALL)
        SELECT repo_path, git_hash, coalesce(n_files, 0) AS n_files, coalesce(n_symbols, 0) AS n_symbols, coalesce(n_calls, 0) AS n_calls, coalesce(n_imports, 0) AS n_imports
        FROM a FULL JOIN b USING (repo_path, git_hash) FULL JOIN c USING (repo_path, git_hash)""",
    "resolved_calls": f"""WITH {_FE}, {_SY}, {_CE}, {_IMPORTS}, e AS (SELECT DISTINCT repo_path, git_hash, caller_path, caller_qname, callee_name, line FROM ce),
        m AS (SELECT DISTINCT repo_path, git_hash, module FROM im), o AS (SELECT *, replace(module, '.', '/') || '/__init__.py' AS a, replace(module, '.', '/') || '.py' AS b FROM m),
        home AS (SELECT o.repo_path, o.git_hash, o.module, arg_min(f.rel_path, f.rel_path = o.b) AS path FROM o JOIN fe f ON f.repo_path = o.repo_path AND f.git_hash = o.git_hash AND f.rel_path IN (o.a, o.b) GROUP BY ALL),
        t AS (SELECT e.*, 0 AS choice, s.rel_path AS p, s.qualified_name AS q FROM e JOIN sy s ON s.repo_path = e.repo_path AND s.git_hash = e.git_hash AND s.rel_path = e.caller_path AND s.name = e.callee_name
          UNION ALL SELECT e.*, 1, s.rel_path, s.qualified_name FROM e JOIN im ON {_HOME} JOIN home h ON h.repo_path = im.repo_path AND h.git_hash = im.git_hash AND h.module = im.module
            JOIN sy s ON s.repo_path = e.repo_path AND s.git_hash = e.git_hash AND s.rel_path = h.path AND s.name = e.callee_name),
        best AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY repo_path, git_hash, caller_path, caller_qname, callee_name, line ORDER BY choice, p, q) = 1)
        SELECT e.*, best.p AS callee_path, best.q AS callee_qname FROM e LEFT JOIN best USING (repo_path, git_hash, caller_path, caller_qname, callee_name, line)""",
    "language_counts": f"WITH {_FE} SELECT {_LANGUAGE} AS found, lower(trim(language, ' ')) AS stated, count(*) AS n_files FROM fe GROUP BY ALL",
    "path_kinds": f"""WITH {_FE}, k AS (SELECT rel_path, regexp_replace(rel_path, '^[./]+', '') AS key FROM fe),
        x AS (SELECT rel_path, starts_with(key, 'tests/') OR starts_with(key, 'test/') OR starts_with(regexp_extract(key, '([^/]*)$', 1), 'test_') OR ends_with(key, '_test.py') OR regexp_extract(key, '([^/]*)$', 1) = 'conftest.py' AS is_test,
          {_SUFFIX} IN ({_LIST(paths.IRRELEVANT_SUFFIXES)}) AS irrelevant,
          list_has_any(string_split(rel_path, '/')[:-2], [{_LIST(paths.IGNORED_DIRECTORIES)}]) OR {_SUFFIX} IN ({_LIST(paths.IGNORED_SUFFIXES)}) AS ignored,
          ends_with(rel_path, '.py') AS is_python FROM k)
        SELECT is_test, irrelevant, ignored, is_python, count(*) AS n_files FROM x GROUP BY ALL""",
    "path_keys": "SELECT DISTINCT file_path, ltrim(file_path, './') AS path_key FROM diff_chunks",
    "module_names": f"SELECT DISTINCT rel_path, {_MODULE} AS module FROM file_entries",
    "module_files": f"""WITH {_FE}, m AS (SELECT DISTINCT repo_path, git_hash, {_MODULE} AS module FROM fe WHERE {_MODULE} <> ''),
        o AS (SELECT *, replace(module, '.', '/') || '/__init__.py' AS a, replace(module, '.', '/') || '.py' AS b FROM m)
        SELECT repo_path, git_hash, module, CASE WHEN EXISTS (SELECT 1 FROM fe f WHERE f.repo_path = o.repo_path AND f.git_hash = o.git_hash AND f.rel_path = o.a) THEN a
          WHEN EXISTS (SELECT 1 FROM fe f WHERE f.repo_path = o.repo_path AND f.git_hash = o.git_hash AND f.rel_path = o.b) THEN b END AS rel_path FROM o""",
    "incremental_reuse": f"""WITH {_FE}, {_RUNS}, x AS (SELECT fe.*, p.before, EXISTS (SELECT 1 FROM fe q WHERE q.repo_path = fe.repo_path AND q.git_hash = p.before
            AND q.rel_path = fe.rel_path AND q.content_hash = fe.content_hash) AS reused FROM fe JOIN p USING (repo_path, git_hash))
        SELECT repo_path || '@' || git_hash AS repo_path, count(*) AS n_files, count(*) FILTER (language IS NOT NULL AND NOT reused) AS n_parsed,
          count(*) FILTER (language IS NOT NULL AND reused) AS n_reused, count(*) FILTER (language IS NULL) AS n_skipped FROM x GROUP BY repo_path, git_hash""",
    "files_to_parse": f"""WITH {_FE}, {_RUNS} SELECT entry_id FROM fe JOIN p USING (repo_path, git_hash) WHERE NOT EXISTS (
        SELECT 1 FROM fe q WHERE q.repo_path = fe.repo_path AND q.git_hash = p.before AND q.rel_path = fe.rel_path AND q.content_hash = fe.content_hash)""",
    "latest_run": "SELECT repo_path, git_hash FROM index_runs QUALIFY row_number() OVER (PARTITION BY repo_path ORDER BY indexed_at DESC, git_hash DESC) = 1",
    "latest_wins_upsert": """WITH d AS (SELECT DISTINCT * FROM reviews), k AS (SELECT *,
          row_number() OVER (PARTITION BY review_id ORDER BY ingested_at, created_at, max_tokens NULLS FIRST) AS a,
          row_number() OVER (PARTITION BY review_id ORDER BY ingested_at DESC, created_at DESC, max_tokens DESC NULLS LAST) AS b FROM d)
        SELECT x.review_id, x.repo_path, coalesce(y.max_tokens, 0)::INT AS max_tokens, y.run_tests FROM k x JOIN k y USING (review_id) WHERE x.a = 1 AND y.b = 1""",
    "existence_probe": """SELECT DISTINCT repo_path, git_hash, EXISTS (SELECT 1 FROM index_runs i WHERE i.repo_path = r.repo_path AND i.git_hash = r.git_hash) AS is_indexed,
        EXISTS (SELECT 1 FROM call_edges e WHERE e.repo_path = r.repo_path AND e.git_hash = r.git_hash) AS has_edges FROM reviews r""",
    "point_read": f"WITH {_FE} SELECT entry_id, git_hash, rel_path, content_hash FROM fe WHERE repo_path = '{ASKED_REPO}' AND rel_path LIKE '{ASKED_FOLDER}%'",
    "enclosing_symbol": f"""WITH {_SY}, {_CE}, o AS (SELECT e.edge_id, s.qualified_name, s.kind FROM ce e
          LEFT JOIN sy s
          ON s.repo_path = e.repo_path AND s.git_hash = e.git_hash AND s.rel_path = e.caller_path AND e.line BETWEEN s.line_start AND s.line_end
          QUALIFY row_number() OVER (PARTITION BY e.edge_id ORDER BY s.line_start DESC NULLS LAST, s.symbol_id) = 1)
        SELECT edge_id, coalesce(qualified_name, '<module>') AS symbol, coalesce(kind, 'module') AS symbol_kind FROM o""",
    "callers_of": f"SELECT DISTINCT edge_id FROM call_edges WHERE callee_name = '{ASKED_NAME}'",
    "reverse_dependencies": f"WITH {_SY}, {_CE}, {_CHANGED} {_dependents(_SAME_PATH)}",
    "reverse_dependencies_by_name": f"WITH {_SY}, {_CE}, {_CHANGED} {_dependents('')}",
    "snapshot_dependents": f"""WITH {_FE}, {_SY}, {_CE}, {_CHANGED}, d AS ({_dependents(_SAME_PATH)})
        SELECT repo_path, git_hash, rel_path, CAST(row_number() OVER (PARTITION BY repo_path, git_hash ORDER BY rel_path) AS INT) AS position FROM d
        WHERE EXISTS (SELECT 1 FROM fe f WHERE f.repo_path = d.repo_path AND f.git_hash = d.git_hash AND f.rel_path = d.rel_path) QUALIFY position <= 15""",
    "graph_stats": f"""WITH {_SY}, {_CE}, a AS (SELECT repo_path, git_hash, count(DISTINCT rel_path) AS n_files, count(*) AS n_symbols FROM sy GROUP BY ALL),
        b AS (SELECT repo_path, git_hash, count(*) AS n_calls FROM ce GROUP BY ALL)
        SELECT repo_path, git_hash, coalesce(n_files, 0) AS n_files, coalesce(n_symbols, 0) AS n_symbols, coalesce(n_calls, 0) AS n_calls FROM a FULL JOIN b USING (repo_path, git_hash)""",
    "symbol_overview": f"""WITH {_SY}, n AS (SELECT * FROM (SELECT repo_path, git_hash, rel_path, count(*) AS n FROM sy GROUP BY ALL)
          QUALIFY row_number() OVER (PARTITION BY repo_path, git_hash ORDER BY rel_path) <= 60),
        t AS (SELECT *, row_number() OVER (PARTITION BY repo_path, git_hash, rel_path ORDER BY symbol_id) AS r FROM sy QUALIFY r <= 20)
        SELECT repo_path, git_hash, rel_path, string_agg(kind || ' ' || qualified_name || ' (L' || line_start || '-' || line_end || ')', chr(10) ORDER BY r) AS shown,
          greatest(0, max(n) - 20) AS more FROM n JOIN t USING (repo_path, git_hash, rel_path) GROUP BY repo_path, git_hash, rel_path""",
    "symbols_per_file": f"""WITH {_SY}, d AS (SELECT DISTINCT repo_path, git_hash, rel_path, line_start, qualified_name, kind, line_end FROM sy)
        SELECT repo_path, git_hash, rel_path, string_agg(line_start || ':' || qualified_name, ',' ORDER BY line_start, qualified_name, kind, line_end) AS symbols FROM d GROUP BY ALL""",
    "symbol_calls": f"""WITH {_SY}, {_CE}, n AS (SELECT DISTINCT repo_path, git_hash, qualified_name AS name FROM sy WHERE kind = 'class')
        SELECT DISTINCT 'caller' AS direction, n.repo_path, n.git_hash, n.name, e.edge_id FROM n JOIN ce e ON e.repo_path = n.repo_path AND e.git_hash = n.git_hash AND (e.callee_name = n.name OR e.callee_qname = n.name)
        UNION SELECT DISTINCT 'callee', n.repo_path, n.git_hash, n.name, e.edge_id FROM n JOIN ce e ON e.repo_path = n.repo_path AND e.git_hash = n.git_hash AND e.caller_qname = n.name""",
    "edges_of_file": f"WITH {_CE} SELECT edge_id FROM ce WHERE caller_path = '{ASKED_FILE}' OR callee_path = '{ASKED_FILE}' ORDER BY edge_id LIMIT 500",
}
