"""Fact tables and C files made from the driver's tables.

The SQL of a fact table is valid in Spark and in DuckDB, so queries and oracles start
from the same facts; `{name}` stands for a table. What the operators do with them is
written twice, as DataFrame code and as oracle SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.operators.index import Graph
from ferrule.sources import tree

FUNCTIONS = """
SELECT 'fn_' || CAST(CAST(floor(p_partkey / 4) AS BIGINT) AS STRING) AS name,
       'src/' || lower(replace(p_brand, '#', '_')) || '.c' AS file,
       CAST(10 * row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS BIGINT) AS line,
       '/* ' || p_name || ' */' || chr(10) || CASE WHEN p_size % 3 = 0 THEN 'static ' ELSE '' END || 'int fn_' || CAST(CAST(floor(p_partkey / 4) AS BIGINT) AS STRING)
         || '(int ' || lower(replace(p_type, ' ', '_')) || ') {{' || chr(10) || '  return ' || CAST(p_size AS STRING) || ';' || chr(10) || '}}' AS source,
       p_size % 3 = 0 AS is_static,
       CAST(p_partkey AS BIGINT) AS pos
FROM {part}
"""
CALLS = """
SELECT a.name AS caller, a.file AS caller_file,
       CASE WHEN s.l_returnflag = 'R' THEN 'ext_' || CAST(s.l_suppkey % 7 AS STRING) ELSE 'fn_' || CAST(CAST(floor(s.next_part / 4) AS BIGINT) AS STRING) END AS callee,
       CAST(s.rn * 3 + CAST(s.l_quantity AS BIGINT) AS BIGINT) AS line, CAST(s.l_orderkey * 10000 + s.rn AS BIGINT) AS pos
FROM (
  SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_returnflag,
         lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS next_part,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS rn
  FROM {lineitem}
) s JOIN {functions} a ON a.pos = s.l_partkey
WHERE s.next_part IS NOT NULL
"""
# self-calls are no edges
CALLS = f"SELECT * FROM ({CALLS}) edges WHERE caller <> callee"
GLOBALS = """
SELECT 'g_' || CAST(s_suppkey % 40 AS STRING) AS name, 'src/nation_' || CAST(s_nationkey AS STRING) || '.c' AS file,
       CASE WHEN s_suppkey % 2 = 0 THEN 'static ' ELSE '' END || 'int g_' || CAST(s_suppkey % 40 AS STRING) || ' = ' || CAST(s_suppkey AS STRING) || ';' AS decl,
       s_suppkey % 2 = 0 AS is_static, CAST(3 + s_suppkey % 90 AS BIGINT) AS line, CAST(s_suppkey AS BIGINT) AS pos
FROM {supplier}
"""
_KIND = "CASE key % 4 WHEN 0 THEN 'struct' WHEN 1 THEN 'union' WHEN 2 THEN 'enum' ELSE 'typedef' END"
TYPES = f"""
SELECT name, file, kind, line, pos, kind || ' ' || name || ' {{{{' || chr(10) || '  int a;' || chr(10) || '}}}}' AS definition FROM (
  SELECT 'T_' || replace(label, ' ', '_') AS name, file, {_KIND} AS kind, CAST(5 + key AS BIGINT) AS line, CAST(key AS BIGINT) AS pos
  FROM (
    SELECT n_nationkey AS key, n_name AS label, 'inc/region_' || CAST(n_regionkey AS STRING) || '.h' AS file FROM {{nation}}
    UNION ALL SELECT 100 + r_regionkey, r_name, 'inc/region_' || CAST(r_regionkey AS STRING) || '.h' FROM {{region}}
    UNION ALL SELECT 200 + r_regionkey, r_name, 'inc/regions.h' FROM {{region}}
  ) t
) u
"""
SYMBOLS = """
SELECT 'SYM_' || CAST(c_custkey % 700 AS STRING) AS name, 'inc/' || lower(c_mktsegment) || '.h' AS file,
       CASE c_custkey % 3 WHEN 0 THEN 'define' WHEN 1 THEN 'macro_fn' ELSE 'enum_value' END AS kind,
       CASE WHEN c_custkey % 5 = 0 AND c_custkey % 3 <> 1 THEN NULL WHEN c_custkey % 3 = 1 AND c_custkey % 5 = 0 THEN '(...)'
            WHEN c_custkey % 3 = 1 THEN '(a, b) ((a) + ' || CAST(c_custkey AS STRING) || ')' ELSE CAST(c_custkey AS STRING) END AS value,
       CAST(1 + c_custkey % 900 AS BIGINT) AS line, CAST(c_custkey AS BIGINT) AS pos
FROM {customer}
"""
TABLES = ("part", "lineitem", "supplier", "nation", "region", "customer")


def duckdb(sql: str) -> str:
    """The adapter's SQL over the oracle's own views."""
    return sql.format(**{t: t for t in TABLES}, functions="functions")


#: WITH clause of the fact tables, for oracles.
WITH = "\n".join(f"{name} AS ({duckdb(sql)})," for name, sql in (("functions", FUNCTIONS), ("calls", CALLS), ("globals", GLOBALS), ("types", TYPES), ("symbols", SYMBOLS)))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    of = lambda *names: {n: _table(spark, sf_dir, n) for n in names}
    functions = spark.sql(FUNCTIONS, **of("part"))
    return Graph(
        functions=functions,
        calls=spark.sql(CALLS, functions=functions, **of("lineitem")),
        symbols=spark.sql(SYMBOLS, **of("customer")),
        types=spark.sql(TYPES, **of("nation", "region")),
        globals=spark.sql(GLOBALS, **of("supplier")),
    )


#: Lines of the C file that is generated for each supplier; `@` is its key.
C_FILE = """\
/* supplier @ */
#ifndef S_@_H
#define LIMIT_@ @*10
#define EMPTY_@
#define ADD_@(a, b) ((a) + (b))
enum color_@ { RED_@, BLUE_@ = @ };
struct pt_@ { int x; int y; };
union un_@ { int i; float f; };
typedef struct pt_@ pt_@_t;
typedef int *ptr_@;
static int count_@ = @, other_@;
extern int shared_@;
int proto_@(int a);
int (*cb_@)(void);

// first line
/* second */
static int helper_@(int a) { return a + ext_@(a); }
#ifdef FAST
int run_@(void) {
    int r = helper_@(1) + s->m(2) + (*cb_@)();
    return run_@() + ADD_@(r, 2);
}
#else
int run_@(void) { return helper_@(2); }
#endif
#endif
int **none_@(void) { return 0; }
#define WIDE_@"""


def c_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`files`: one generated C file a supplier. The table is small and one row group, so its keys are dealt over the tasks that parse."""
    key = F.col("s_suppkey").cast("string")
    text = F.replace(F.lit(C_FILE), F.lit("@"), key)
    # a macro value beyond the limit ends the file
    wide = F.concat(text, F.lit(" "), F.repeat(F.lit("ab"), 101), F.lit("\n"))
    rows = tree.dealt(_table(spark, sf_dir, "supplier").select("s_suppkey")).select(F.concat(F.lit("gen/s_"), key, F.lit(".c")).alias("path"), wide.alias("content"))
    return tree.from_rows(rows)
