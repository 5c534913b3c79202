"""Every registered query of the code-graph engine with its DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ferrule.functions import scalars as S
from ferrule.operators import evaluation as E
from ferrule.operators import graph as G
from ferrule.operators import lookups as Q
from ferrule.operators.index import extract_facts, graph_of, index_files
from ferrule.plans import adapters as A
from ferrule.sources import cache as C
from ferrule.streaming import freshness

#: The part whose function traversals start from.
START = 10
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def _add(name: str, query: Query, oracle: str, facts: bool = True) -> None:
    _QUERIES[name] = query
    _ORACLES[name] = f"WITH RECURSIVE {A.WITH} one AS (SELECT 1) {oracle}" if facts else oracle


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- traversal -------------------------------------------------------------------------


def _starts(graph) -> DataFrame:
    return graph.functions.where(F.col("pos") == START).select("name", "file")


def _reach(direction: str, depth: int) -> Query:
    def run(spark, sf_dir):
        graph = A.graph(spark, sf_dir)
        found = G.reach(_starts(graph), graph, direction, depth)
        return found.select("name", "file", "depth", *(["line"] if depth == 1 else []))

    return run


_START_SQL = f"start AS (SELECT name, file FROM functions WHERE pos = {START})"
_RESOLVED = """resolved AS (
  SELECT caller, caller_file, callee, callee_file, line, pos FROM (
    SELECT c.*, coalesce(f.file, '') AS callee_file, row_number() OVER (PARTITION BY c.pos ORDER BY (f.file = c.caller_file) DESC NULLS LAST, f.file, f.pos) AS rank
    FROM calls c LEFT JOIN functions f ON f.name = c.callee
  ) WHERE rank = 1
)"""
_FLAGS = "flags AS (SELECT name, file, arg_min(is_static, pos) AS is_static FROM functions GROUP BY name, file)"


def _walk(direction: str, depth: int) -> str:
    if direction == "callees":
        edge = "SELECT e.callee, e.callee_file, w.depth + 1 FROM walk w JOIN resolved e ON e.caller = w.name AND e.caller_file = w.file"
    else:
        edge = "SELECT c.caller, c.caller_file, w.depth + 1 FROM walk w JOIN calls c ON c.callee = w.name LEFT JOIN flags s ON s.name = w.name AND s.file = w.file"
    limit = f"w.depth < {depth}" + (" AND (NOT coalesce(s.is_static, FALSE) OR c.caller_file = w.file)" if direction == "callers" else "")
    return f""", {_START_SQL}, {_RESOLVED}, {_FLAGS}, walk AS (
  SELECT name, file, CAST(0 AS BIGINT) AS depth FROM start UNION {edge} WHERE {limit}
), reached AS (
  SELECT name, file, min(depth) AS depth FROM walk WHERE (name, file) NOT IN (SELECT (name, file) FROM start) GROUP BY name, file
)"""


def _lines(direction: str) -> str:
    if direction == "callees":
        return "SELECT e.callee AS name, e.callee_file AS file, arg_min(e.line, e.pos) AS line FROM resolved e JOIN start s ON e.caller = s.name AND e.caller_file = s.file GROUP BY ALL"
    return "SELECT c.caller AS name, c.caller_file AS file, arg_min(c.line, c.pos) AS line FROM calls c JOIN start s ON c.callee = s.name GROUP BY ALL"


for _d in ("callees", "callers"):
    for _n in (0, 1, 2, 3):
        if _n == 1:
            _add(f"{_d}_d1", _reach(_d, 1), f"{_walk(_d, 1)} SELECT r.name, r.file, r.depth, l.line FROM reached r LEFT JOIN ({_lines(_d)}) l ON l.name = r.name AND l.file = r.file")
        else:
            _add(f"{_d}_d{_n}", _reach(_d, _n), f"{_walk(_d, _n)} SELECT name, file, depth FROM reached")


def _both(spark, sf_dir):
    of = lambda direction: _reach(direction, 1)(spark, sf_dir).select(F.lit(direction).alias("direction"), "name", "file", "line")
    return of("callers").unionByName(of("callees"))


_both_sql = f"""{_walk("callees", 1)}, walk2 AS (
  SELECT DISTINCT c.caller AS name, c.caller_file AS file FROM start w JOIN calls c ON c.callee = w.name LEFT JOIN flags s ON s.name = w.name AND s.file = w.file
  WHERE (NOT coalesce(s.is_static, FALSE) OR c.caller_file = w.file) AND (c.caller, c.caller_file) NOT IN (SELECT (name, file) FROM start)
)
SELECT 'callees' AS direction, r.name, r.file, l.line FROM reached r LEFT JOIN ({_lines("callees")}) l ON l.name = r.name AND l.file = r.file
UNION ALL SELECT 'callers', r.name, r.file, l.line FROM walk2 r LEFT JOIN ({_lines("callers")}) l ON l.name = r.name AND l.file = r.file"""
_add("call_graph_both_d1", _both, _both_sql)


def _name_bfs(direction: str, depth: int) -> tuple[Query, str]:
    src, dst = ("caller", "callee") if direction == "callees" else ("callee", "caller")
    # place: where a breadth-first search meets the name
    sql = f""", walk AS (
  SELECT 'fn_2' AS name, CAST(0 AS BIGINT) AS depth, CAST([] AS STRUCT(f VARCHAR, p BIGINT)[]) AS path
  UNION ALL SELECT c.{dst}, w.depth + 1, list_append(w.path, {{'f': c.caller_file, 'p': CAST(c.pos AS BIGINT)}}) FROM walk w JOIN calls c ON c.{src} = w.name WHERE w.depth < {depth}
), met AS (SELECT name, depth, min(path) AS path FROM walk w WHERE name <> 'fn_2' AND depth = (SELECT min(depth) FROM walk v WHERE v.name = w.name) GROUP BY name, depth)
SELECT name, depth, row_number() OVER (ORDER BY depth, path) AS place FROM met"""

    def run(spark, sf_dir):
        found = G.reach_by_name("fn_2", A.graph(spark, sf_dir).calls, direction, depth)
        return found.select("name", "depth", F.row_number().over(W.orderBy("depth", "path")).cast("long").alias("place"))

    return run, sql


for _d in ("callees", "callers"):
    for _n in (1, 2):
        _add(f"name_bfs_{_d}_d{_n}", *_name_bfs(_d, _n))


def _static_scope(spark, sf_dir):
    """Callers of every static function: those of its own file only."""
    graph = A.graph(spark, sf_dir)
    flags = G.static_flags(graph.functions).where("is_static")
    steps = graph.calls.join(flags, (F.col("callee") == F.col("name")) & (F.col("caller_file") == F.col("file")))
    return steps.groupBy("name", "file", "caller").agg(F.count("*").alias("sites"))


_add("callers_static_scope", _static_scope, f", {_FLAGS} SELECT s.name, s.file, c.caller, count(*) AS sites FROM flags s JOIN calls c ON c.callee = s.name AND c.caller_file = s.file WHERE s.is_static GROUP BY ALL")


def _resolution(spark, sf_dir):
    graph = A.graph(spark, sf_dir)
    return G.resolve_callees(graph.calls, graph.functions).select("caller", "caller_file", "callee", "callee_file", "line", "pos")


_add("callee_resolution", _resolution, f", {_RESOLVED} SELECT caller, caller_file, callee, callee_file, line, pos FROM resolved")


def _site_line(spark, sf_dir):
    """First call site of every (caller, caller_file, callee)."""
    return A.graph(spark, sf_dir).calls.groupBy("caller", "caller_file", "callee").agg(F.min_by("line", "pos").alias("line"), F.count("*").alias("sites"))


_add("call_site_line", _site_line, "SELECT caller, caller_file, callee, first(line ORDER BY pos) AS line, count(*) AS sites FROM calls GROUP BY caller, caller_file, callee")


def _external(spark, sf_dir):
    graph = A.graph(spark, sf_dir)
    edges = G.resolve_callees(graph.calls, graph.functions).where(F.col("callee_file") == "")
    return edges.groupBy("callee").agg(F.count("*").alias("call_sites"), F.count_distinct("caller").alias("callers"))


_add("external_callees", _external, "SELECT callee, count(*) AS call_sites, count(DISTINCT caller) AS callers FROM calls WHERE callee NOT IN (SELECT name FROM functions) GROUP BY callee")


def _graph_answer(name: str, direction: str, file: str | None = None) -> Query:
    """outcome, name, file, signature or message of query_call_graph's candidate selection, and the lists that an answer has."""

    def run(spark, sf_dir):
        graph = A.graph(spark, sf_dir)
        own = Q.candidates(graph, name, file)
        n = own.groupBy().agg(F.count("*").alias("n"))
        found = own.join(F.broadcast(n)).select(F.when(F.col("n") > 1, "ambiguous").otherwise("found").alias("outcome"), "name", "file", F.when(F.col("n") > 1, F.col("signature")).alias("signature"))
        message = Q.call_graph_error(graph, name, file)["error"]
        missing = n.where("n = 0").select(F.lit("error").alias("outcome"), F.lit(name).alias("name"), F.lit(None).cast("string").alias("file"), F.lit(message).alias("signature"))
        parts = F.when(F.col("outcome") == "found", ",".join(Q.answer_parts(direction))).alias("parts")
        return found.unionByName(missing).select("*", parts)

    return run


_SIGNATURE = "trim(split_part(split_part(source, '*/', 2), '{', 1), ' ' || chr(10))"


def _answer_sql(name: str, file: str | None, message: str, parts: str) -> str:
    wanted = f"name = '{name}'" + (f" AND contains(lower(file), lower('{file}'))" if file is not None else "")
    return f""", own AS (SELECT name, file, {_SIGNATURE} AS signature, count(*) OVER () AS n FROM functions WHERE {wanted})
SELECT CASE WHEN n > 1 THEN 'ambiguous' ELSE 'found' END AS outcome, name, file, CASE WHEN n > 1 THEN signature END AS signature, CASE WHEN n = 1 THEN '{parts}' END AS parts FROM own
UNION ALL SELECT 'error', '{name}', NULL, '{message}', NULL WHERE NOT EXISTS (SELECT * FROM own)"""


for _q, _name, _dir, _file, _msg, _parts in (
    ("call_graph_ambiguous", "fn_2", "both", None, "", "callers,callees"),
    ("call_graph_not_found", "ext_1", "callees", None, "function ''ext_1'' not found", "callees"),
    ("call_graph_not_in_file", "fn_2", "callees", "nowhere", "function ''fn_2'' not found in files matching ''nowhere''", "callees"),
    ("call_graph_bad_direction", "fn_3", "sideways", ".c", "", ""),
    ("call_graph_both_directions", "fn_3", "both", ".c", "", "callers,callees"),
    ("call_graph_callers_only", "fn_3", "callers", ".c", "", "callers"),
):
    _add(_q, _graph_answer(_name, _dir, _file), _answer_sql(_name, _file, _msg, _parts))

# --- lookups ---------------------------------------------------------------------------

_ARMS = f"""
  SELECT name, 'function' AS kind, line, {_SIGNATURE} AS signature, file FROM functions
  UNION ALL SELECT name, 'variable', line, decl, file FROM globals
  UNION ALL SELECT name, kind, line, trim(split_part(definition, chr(10), 1)), file FROM types
  UNION ALL SELECT name, 'macro', line, CASE WHEN kind = 'macro_fn' THEN '#define ' || name || substr(value, 1, strpos(value, ')')) ELSE '#define ' || name END, file FROM symbols WHERE kind <> 'enum_value'
  UNION ALL SELECT name, 'enum_value', line, CASE WHEN value IS NULL THEN name ELSE name || ' = ' || value END, file FROM symbols WHERE kind = 'enum_value'
"""


def _lookup(file: str, kind: str | None) -> Query:
    return lambda spark, sf_dir: Q.symbol_rows(A.graph(spark, sf_dir), file, kind).select("name", "kind", "line", "signature")


for _kind, _file in ((None, "C/"), ("function", "BRAND_1"), ("variable", "nation_1"), ("typedef", "inc/"), ("struct", "inc/"), ("union", "inc/"), ("enum", "inc/"), ("macro", "ma"), ("enum_value", "Inc/")):
    _add(f"symbol_lookup_{_kind or 'all'}", _lookup(_file, _kind), f", arms AS ({_ARMS}) SELECT name, kind, line, signature FROM arms WHERE contains(lower(file), lower('{_file}'))" + (f" AND kind = '{_kind}'" if _kind else ""))

_add(
    "symbol_lookup_unknown_kind",
    lambda spark, sf_dir: spark.createDataFrame([(Q.symbol_lookup(A.graph(spark, sf_dir), "src", "klass")["error"],)], "error string"),
    "SELECT 'unknown kind ''klass'', valid: ' || 'function|variable|typedef|struct|union|enum|macro|enum_value' AS error",
)

_SOURCES = f"""
  SELECT name, 'function' AS kind, file, line, {_SIGNATURE} AS signature, source FROM functions
  UNION ALL SELECT name, 'typedef', file, line, trim(split_part(definition, chr(10), 1)), definition FROM types
  UNION ALL SELECT name, 'variable', file, line, decl, decl FROM globals
  UNION ALL SELECT name, 'macro', file, line, text, text FROM (
    SELECT *, CASE WHEN kind = 'enum_value' THEN name || coalesce(' = ' || value, '') ELSE '#define ' || name || CASE WHEN value IS NULL THEN '' WHEN kind = 'define' THEN ' ' || value ELSE value END END AS text FROM symbols)
"""


def _source(name: str, file: str | None) -> tuple[Query, str]:
    wanted = f"name = '{name}'" + (f" AND contains(lower(file), lower('{file}'))" if file is not None else "")
    sql = f""", m AS (SELECT *, count(*) OVER () AS n FROM ({_SOURCES}) WHERE {wanted})
SELECT CASE WHEN n = 1 THEN 'found' ELSE 'ambiguous' END AS outcome, name, kind, file, signature, CASE WHEN n = 1 THEN '// file: ' || file || chr(10) || '// line: ' || line || chr(10) || chr(10) || source END AS text FROM m
UNION ALL SELECT 'error', '{name}', NULL, NULL, NULL, 'symbol ''{name}'' not found' WHERE NOT EXISTS (SELECT * FROM m)"""
    return lambda spark, sf_dir: Q.source_answer(A.graph(spark, sf_dir), name, file), sql


for _q, _name, _file in (
    ("get_source_function", "fn_0", "BRAND_2"),
    ("get_source_type", "T_ASIA", "regions"),
    ("get_source_variable", "g_7", "src/"),
    ("get_source_macro", "SYM_1", "inc/"),
    ("get_source_enum_value", "SYM_2", None),
    ("get_source_ambiguous", "fn_2", None),
    ("get_source_not_found", "ext_1", None),
):
    _add(_q, *_source(_name, _file))

_add("find_function", lambda spark, sf_dir: G.find_function(A.graph(spark, sf_dir).functions, "FN_12").select("name", "file", "line"), "SELECT name, file, line FROM functions WHERE contains(lower(name), 'fn_12')")
_add("find_functions_in_file", lambda spark, sf_dir: G.find_functions_in_file(A.graph(spark, sf_dir).functions, "Brand_3").select("name", "file", "line"), "SELECT name, file, line FROM functions WHERE contains(lower(file), 'brand_3')")


def _merge(spark, sf_dir):
    """Two halves of the graph put together again have the facts of the whole."""
    graph = A.graph(spark, sf_dir)
    half = lambda k: type(graph)(**{n: getattr(graph, n).where(F.col("pos") % 2 == k) for n in ("functions", "calls", "symbols", "types", "globals")})
    merged = half(0).merge(half(1))
    out = None
    for name in ("functions", "calls", "symbols", "types", "globals"):
        key = F.concat_ws(":", "caller" if name == "calls" else "name", "caller_file" if name == "calls" else "file", F.col("pos").cast("string"))
        one = getattr(merged, name).agg(F.count("*").alias("facts"), F.count_distinct(key).alias("places"), F.min(key).alias("first"), F.max(key).alias("last")).select(F.lit(name).alias("fact"), "facts", "places", "first", "last")
        out = one if out is None else out.unionByName(one)
    return out


_add("merge_union", _merge, " UNION ALL ".join(f"SELECT '{n}' AS fact, count(*) AS facts, count(DISTINCT k) AS places, min(k) AS first, max(k) AS last FROM (SELECT {'caller' if n == 'calls' else 'name'} || ':' || {'caller_file' if n == 'calls' else 'file'} || ':' || pos AS k FROM {n})" for n in ("functions", "calls", "symbols", "types", "globals")))

# --- scalars ---------------------------------------------------------------------------

_add("signature", lambda spark, sf_dir: A.graph(spark, sf_dir).functions.select("pos", S.function_signature(F.col("source")).alias("signature")), f"SELECT pos, {_SIGNATURE} AS signature FROM functions")
_add("first_line", lambda spark, sf_dir: A.graph(spark, sf_dir).types.select("pos", S.first_line(F.col("definition")).alias("first_line")), "SELECT pos, kind || ' ' || name || ' {' AS first_line FROM types")
_add(
    "macro_signature",
    lambda spark, sf_dir: A.graph(spark, sf_dir).symbols.where("kind <> 'enum_value'").select("pos", S.macro_signature(F.col("name"), F.col("kind"), F.col("value")).alias("signature")),
    "SELECT pos, CASE WHEN kind = 'macro_fn' THEN '#define ' || name || CASE WHEN pos % 5 = 0 THEN '(...)' ELSE '(a, b)' END ELSE '#define ' || name END AS signature FROM symbols WHERE kind <> 'enum_value'",
)
_add(
    "symbol_source_text",
    lambda spark, sf_dir: A.graph(spark, sf_dir).symbols.select("pos", S.symbol_source(F.col("name"), F.col("kind"), F.col("value")).alias("text")),
    "SELECT pos, CASE kind WHEN 'enum_value' THEN concat(name, ' = ' || value) WHEN 'define' THEN concat('#define ', name, ' ' || value) ELSE concat('#define ', name, value) END AS text FROM symbols",
)
_add(
    "trim_value",
    lambda spark, sf_dir: _read(spark, sf_dir, "documents").select("doc_id", S.trim_value(F.col("text")).alias("value")),
    r"""WITH t AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS x FROM documents)
SELECT doc_id, CASE WHEN strlen(x) <= 200 THEN x ELSE substr(x, 1, list_max(list_filter(range(0, 201), lambda n: strlen(substr(x, 1, n)) <= 200))) || '…' END AS value FROM t""",
    facts=False,
)

# --- freshness and cache ---------------------------------------------------------------

_SINCE = datetime(2024, 1, 15)
_EVENT_FILE = "CASE WHEN event_id % 3 = 0 THEN 'f' || event_id || '.c' WHEN event_id % 3 = 1 THEN 'f' || event_id || '.H' ELSE '.f' || event_id || '.h' END"


def _stale(spark, sf_dir):
    files = _read(spark, sf_dir, "events").select(F.expr(_EVENT_FILE).alias("path"), F.col("ts").alias("mtime"))
    return freshness.has_stale_files(files, _SINCE)


_add("stale_files", _stale, f"SELECT coalesce(bool_or(regexp_matches({_EVENT_FILE}, '[.][ch]$') AND ts > TIMESTAMP '{_SINCE}'), FALSE) AS stale FROM events", facts=False)

_CACHED = "SELECT 'f_' || p_partkey AS path, CASE WHEN p_size % 5 = 0 THEN 'old' ELSE p_brand END AS content_hash FROM {part} WHERE p_partkey % 7 <> 0"
_PRESENT = "SELECT 'f_' || p_partkey AS path, p_brand AS content_hash FROM {part}"


def _split(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    hits, misses = C.split_hits(spark.sql(_PRESENT, part=part), spark.sql(_CACHED, part=part))
    return hits.withColumn("outcome", F.lit("hit")).unionByName(misses.withColumn("outcome", F.lit("miss")))


_add("cache_split_hit_miss", _split, "SELECT 'f_' || p_partkey AS path, p_brand AS content_hash, CASE WHEN p_partkey % 7 <> 0 AND p_size % 5 <> 0 THEN 'hit' ELSE 'miss' END AS outcome FROM part", facts=False)
_add(
    "cache_evict_topk",
    lambda spark, sf_dir: C.newest(_read(spark, sf_dir, "events").select(F.col("event_id").alias("path"), F.col("ts").alias("last_used")), 100),
    "SELECT event_id AS path, ts AS last_used FROM events ORDER BY ts DESC, event_id DESC LIMIT 100",
    facts=False,
)


def _changes(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    return freshness.changes(spark.sql(_CACHED, part=part), spark.sql(_PRESENT + " WHERE p_partkey % 11 <> 0", part=part))


_add(
    "snapshot_changes",
    _changes,
    """SELECT 'f_' || p_partkey AS path, CASE WHEN p_partkey % 7 = 0 THEN 'added' WHEN p_partkey % 11 = 0 THEN 'deleted' ELSE 'modified' END AS change FROM part
WHERE NOT (p_partkey % 7 = 0 AND p_partkey % 11 = 0) AND (p_partkey % 7 = 0 OR p_partkey % 11 = 0 OR p_size % 5 = 0)""",
    facts=False,
)
_add(
    "cache_slots",
    lambda spark, sf_dir: _read(spark, sf_dir, "part").select("p_partkey", S.cache_slots(F.col("p_partkey"), 25).alias("slots")),
    "SELECT p_partkey, CAST(p_partkey * 125 // 100 AS BIGINT) AS slots FROM part",
    facts=False,
)

# --- extraction ------------------------------------------------------------------------


def _facts(kinds: str, columns: str, where: str = "true") -> Query:
    def run(spark, sf_dir):
        rows = extract_facts(A.c_files(spark, sf_dir), kinds.split()).withColumn("conditions", F.concat_ws(";", "conditions"))
        return rows.where(where).selectExpr(*columns.split(", "))

    return run


def _each(*rows: str) -> str:
    """Oracle rows of every supplier's file: SELECT lists over k, its key, and file."""
    return "WITH s AS (SELECT CAST(s_suppkey AS STRING) AS k, 'gen/s_' || CAST(s_suppkey AS STRING) || '.c' AS file FROM supplier) " + " UNION ALL ".join(f"SELECT {r} FROM s" for r in rows)


_HELPER = "'// first line' || chr(10) || '/* second */' || chr(10) || 'static int helper_' || k || '(int a) { return a + ext_' || k || '(a); }'"
_RUN1 = "'int run_' || k || '(void) {' || chr(10) || '    int r = helper_' || k || '(1) + s->m(2) + (*cb_' || k || ')();' || chr(10) || '    return run_' || k || '() + ADD_' || k || '(r, 2);' || chr(10) || '}'"
_RUN2 = "'int run_' || k || '(void) { return helper_' || k || '(2); }'"
_GUARD = "'#ifndef S_' || k || '_H'"

for _q, _query, _sql in (
    ("parse_functions", _facts("function", "name, file, line, text AS source"), _each(f"'helper_' || k AS name, file, CAST(16 AS BIGINT) AS line, {_HELPER} AS source", f"'run_' || k, file, 20, {_RUN1}", f"'run_' || k, file, 25, {_RUN2}")),
    ("parse_comments", _facts("function", "name, line, substring(text,1,2) AS head"), _each("'helper_' || k AS name, CAST(16 AS BIGINT) AS line, '//' AS head", "'run_' || k, 20, 'in'", "'run_' || k, 25, 'in'")),
    ("parse_static", _facts("function", "name, line, flag AS is_static"), _each("'helper_' || k AS name, CAST(16 AS BIGINT) AS line, TRUE AS is_static", "'run_' || k, 20, FALSE", "'run_' || k, 25, FALSE")),
    (
        "parse_calls",
        _facts("call", "name AS caller, kind AS callee, line, file"),
        _each("'helper_' || k AS caller, 'ext_' || k AS callee, CAST(18 AS BIGINT) AS line, file", "'run_' || k, 'helper_' || k, 21, file", "'run_' || k, 'ADD_' || k, 22, file", "'run_' || k, 'helper_' || k, 25, file"),
    ),
    (
        "parse_defines",
        _facts("symbol", "name, text AS value, line", "kind = 'define'"),
        _each("'LIMIT_' || k AS name, k || '*10' AS value, CAST(3 AS BIGINT) AS line", "'EMPTY_' || k, NULL, 4", "'WIDE_' || k, repeat('ab', 100) || '…', 29"),
    ),
    ("parse_macro_fns", _facts("symbol", "name, text AS value, line", "kind = 'macro_fn'"), _each("'ADD_' || k AS name, '(a, b) ((a) + (b))' AS value, CAST(5 AS BIGINT) AS line")),
    ("parse_enum_values", _facts("symbol", "name, text AS value, line", "kind = 'enum_value'"), _each("'RED_' || k AS name, NULL AS value, CAST(6 AS BIGINT) AS line", "'BLUE_' || k, k, 6")),
    ("parse_structs", _facts("type", "name, text AS definition, line", "kind = 'struct'"), _each("'pt_' || k AS name, 'struct pt_' || k || ' { int x; int y; }' AS definition, CAST(7 AS BIGINT) AS line")),
    ("parse_unions", _facts("type", "name, text AS definition, line", "kind = 'union'"), _each("'un_' || k AS name, 'union un_' || k || ' { int i; float f; }' AS definition, CAST(8 AS BIGINT) AS line")),
    ("parse_enums", _facts("type", "name, text AS definition, line", "kind = 'enum'"), _each("'color_' || k AS name, 'enum color_' || k || ' { RED_' || k || ', BLUE_' || k || ' = ' || k || ' }' AS definition, CAST(6 AS BIGINT) AS line")),
    ("parse_typedefs", _facts("type", "name, text AS definition, line", "kind = 'typedef'"), _each("'pt_' || k || '_t' AS name, 'typedef struct pt_' || k || ' pt_' || k || '_t;' AS definition, CAST(9 AS BIGINT) AS line")),
    (
        "parse_globals",
        _facts("global", "name, text AS decl, line, flag AS is_static"),
        _each("'count_' || k AS name, 'static int count_' || k || ' = ' || k || ', other_' || k || ';' AS decl, CAST(11 AS BIGINT) AS line, TRUE AS is_static", "'shared_' || k, 'extern int shared_' || k || ';', 12, FALSE"),
    ),
    ("parse_prototype_filter", _facts("global", "file, count(*) AS globals", "name LIKE 'proto%' OR name LIKE 'cb%'"), ""),
    (
        "parse_conditions",
        _facts("function symbol", "name, line, conditions"),
        _each(
            f"'LIMIT_' || k AS name, CAST(3 AS BIGINT) AS line, {_GUARD} AS conditions", f"'EMPTY_' || k, 4, {_GUARD}", f"'ADD_' || k, 5, {_GUARD}", f"'RED_' || k, 6, {_GUARD}", f"'BLUE_' || k, 6, {_GUARD}",
            f"'helper_' || k, 16, {_GUARD}", f"'run_' || k, 20, {_GUARD} || ';#ifdef FAST'", f"'run_' || k, 25, {_GUARD} || ';#ifdef FAST;#else'", "'WIDE_' || k, 29, ''",
        ),
    ),
):
    if _q != "parse_prototype_filter":
        _add(_q, _query, _sql, facts=False)


def _prototypes(spark, sf_dir):
    """File-scope variables of each file; prototypes and function pointers are none."""
    rows = graph_of(extract_facts(A.c_files(spark, sf_dir), ["global"])).globals
    return rows.groupBy("file").agg(F.count("*").alias("globals"), F.count_if(F.col("name").rlike("^(proto|cb)_")).alias("prototypes"))


_add("parse_prototype_filter", _prototypes, _each("file, CAST(2 AS BIGINT) AS globals, CAST(0 AS BIGINT) AS prototypes"), facts=False)
_add(
    "index_stats",
    lambda spark, sf_dir: index_files(A.c_files(spark, sf_dir))[1],
    "SELECT 'ok' AS status, count(*) AS files_ok, CAST(0 AS BIGINT) AS files_err, CAST(0 AS BIGINT) AS l2_hits, 3 * count(*) AS functions, 4 * count(*) AS call_edges FROM supplier",
    facts=False,
)


def _end_to_end(spark, sf_dir):
    """Generated C files, parsed and indexed; then the callees of every run_ function with their files."""
    graph, _ = index_files(A.c_files(spark, sf_dir))
    edges = G.resolve_callees(graph.calls, graph.functions)
    return edges.where(F.col("caller").startswith("run_")).groupBy("caller", "callee", "callee_file").agg(F.min_by("line", "pos").alias("line"), F.count("*").alias("sites"))


_add("index_to_callees", _end_to_end, _each("'run_' || k AS caller, 'helper_' || k AS callee, file AS callee_file, CAST(21 AS BIGINT) AS line, CAST(2 AS BIGINT) AS sites", "'run_' || k, 'ADD_' || k, '', 22, 1"), facts=False)

# --- evaluation ------------------------------------------------------------------------

_JUDGED = """SELECT 'q' || CAST(doc_id % 3 AS STRING) AS task_id, 'run' || CAST(doc_id % 4 AS STRING) AS run, CASE WHEN doc_id % 2 = 0 THEN 'exp' ELSE 'ctrl' END AS condition,
  CASE WHEN doc_id % 7 = 0 THEN NULL ELSE quality END AS s1, toxic * 2 AS s2, CASE WHEN doc_id % 14 = 0 THEN 2.5 END AS total FROM {labels}"""


def _totals(spark, sf_dir):
    judged = spark.sql(_JUDGED, labels=_read(spark, sf_dir, "labels")).withColumn("criteria_scores", F.array(F.col("s1").cast("long"), F.col("s2").cast("long"))).withColumn("total", F.col("total").cast("double"))
    rubric = spark.createDataFrame([("q0", 1), ("q0", 2), ("q1", 4), ("q2", 2)], "task_id string, points long")
    stats = spark.createDataFrame([(f"q{t}", f"run{r}", c, 0.25 * (t + r)) for t in range(3) for r in range(3) for c in E.CONDITIONS], "task_id string, run string, condition string, duration_sec double")
    return E.condition_totals(judged, rubric, stats)


_add(
    "eval_condition_totals",
    _totals,
    f"""WITH j AS ({_JUDGED.format(labels="labels")}), r AS (
  SELECT *, CASE WHEN s1 IS NOT NULL THEN s1 + s2 WHEN total IS NOT NULL THEN 2 END AS score, CASE task_id WHEN 'q0' THEN 3 WHEN 'q1' THEN 4 ELSE 2 END AS points,
         CASE WHEN run = 'run3' THEN 0 ELSE 0.25 * (CAST(substr(task_id, 2) AS INT) + CAST(substr(run, 4) AS INT)) END AS secs FROM j
)
SELECT condition, CAST(sum(score) AS BIGINT) AS score, CAST(sum(points) AS BIGINT) AS max_score, count(*) AS responses, CAST(sum(secs) AS DOUBLE) AS seconds,
       CAST(sum(score) AS DOUBLE) / CAST(sum(points) AS DOUBLE) * 100 AS percent
FROM r WHERE score IS NOT NULL GROUP BY condition""",
    facts=False,
)

_FENCED = """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '```json' || chr(10) || '{{"criteria_scores": [' || quality || ', ' || toxic || '], "notes": "n' || doc_id || '"}}' || chr(10) || '```'
  WHEN 1 THEN 'Scores: {{"criteria_scores": [' || quality || '], "notes": "n' || doc_id || '"}} as asked.' ELSE 'no scores for ' || doc_id END AS text FROM {labels}"""


def _scores(spark, sf_dir):
    rows = spark.sql(_FENCED, labels=_read(spark, sf_dir, "labels"))
    parsed = S.parse_scores(F.col("text"), "criteria_scores array<bigint>, notes string")
    return rows.select("doc_id", parsed.alias("p")).select("doc_id", F.concat_ws(",", F.col("p.criteria_scores").cast("array<string>")).alias("scores"), "p.notes")


_add(
    "eval_parse_scores",
    _scores,
    "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN CAST(quality AS STRING) || ',' || CAST(toxic AS STRING) WHEN 1 THEN CAST(quality AS STRING) ELSE '' END AS scores, CASE WHEN doc_id % 3 < 2 THEN 'n' || doc_id END AS notes FROM labels",
    facts=False,
)
_add(
    "eval_score_clamp",
    lambda spark, sf_dir: _read(spark, sf_dir, "labels").select("doc_id", S.clamp_score((F.col("doc_id") % 13 - 3) / 2, F.col("quality") + 2).alias("score")),
    "SELECT doc_id, CAST(least(greatest(round_even((doc_id % 13 - 3) / 2, 0), 0), quality + 2) AS BIGINT) AS score FROM labels",
    facts=False,
)


def _responses(spark, sf_dir):
    rows = _read(spark, sf_dir, "conversations").select(F.when(F.col("turn") > 0, F.concat(F.lit("c"), F.col("conv_id") % 5)).alias("task_id"), F.lit("r").alias("run"), F.col("role").alias("condition"), F.col("text").alias("response"), F.lit(None).cast("double").alias("duration_sec"))
    return E.task_counts(E.result_rows(rows))


_add("eval_task_counts", _responses, "SELECT count(*) AS responses, count(DISTINCT conv_id % 5) AS tasks, count(*) // nullif(count(DISTINCT conv_id % 5), 0) AS per_task FROM conversations WHERE turn > 0", facts=False)
