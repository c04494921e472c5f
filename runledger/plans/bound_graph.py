"""Call graph, places of nodes and parameter plans, bound to `events` and `part`: edges, dump places and parameters are put together from ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import callgraph, precond, units
from .base import Relation, query

# Calls between functions of a unit of ten users; some go back, so that there are cycles.
EDGES = Relation(
    "SELECT DISTINCT event_type || CAST(user_id {div} 10 AS {str}) AS tu, 'f' || CAST(user_id % 10 AS {str}) AS caller, "
    "'f' || CAST(CASE WHEN {k} % 11 = 0 THEN user_id % 10 - 1 ELSE user_id % 10 + 1 + {k} % 3 END AS {str}) AS callee FROM {events} WHERE {k} IS NOT NULL"
)
E = {"edge": EDGES}


@query("h4_self_reachable", E, """WITH RECURSIVE walk AS (SELECT tu, caller AS a, callee AS b FROM edge UNION SELECT w.tu, w.a, e.callee FROM walk w JOIN edge e ON e.tu = w.tu AND e.caller = w.b)
    SELECT DISTINCT tu, a AS name FROM walk WHERE a = b""")
def h4(edge):
    return callgraph.self_reachable(edge)


@query("d5_referrers", E, "SELECT tu, callee, caller FROM edge WHERE caller <> callee")
def d5(edge):
    listed = edge.groupBy("tu", F.col("caller").alias("name")).agg(F.array_sort(F.collect_list("callee")).alias("calls"))
    return callgraph.referrers(listed)


# One node a row; a place is whole, abbreviated to lines, or abbreviated to columns.
PLACES = Relation(
    "SELECT user_id AS tu, event_id AS ord, event_id % 5 AS shape, CASE event_id % 5 WHEN 0 THEN ' 0x1 <a' || CAST(event_id % 7 AS {str}) || '.c:' || CAST(event_id AS {str}) || ':1, col:9> col:5 f' "
    "WHEN 1 THEN ' 0x1 <line:' || CAST(event_id AS {str}) || ':1, line:' || CAST(event_id + 3 AS {str}) || ':1> col:5 f' WHEN 3 THEN ' 0x1 <line:' || CAST(event_id AS {str}) || ':1, col:5> line:' || CAST(event_id + 7 AS {str}) || ':9 g' "
    "WHEN 4 THEN ' no place' ELSE ' 0x1 <col:3> x' END AS rest FROM {events}"
)


@query("f10_placed_nodes", {"tree": PLACES}, """SELECT tu, ord, coalesce(last_value(CASE WHEN shape = 0 THEN 'a' || ord % 7 || '.c' END IGNORE NULLS) OVER w, '') AS file,
    coalesce(last_value(CASE shape WHEN 0 THEN ord WHEN 1 THEN ord + 3 WHEN 3 THEN ord + 7 END IGNORE NULLS) OVER w, 0) AS line FROM tree WINDOW w AS (PARTITION BY tu ORDER BY ord)""")
def f10(tree):
    return units.placed(tree).select("tu", "ord", "file", F.col("line").cast("long").alias("line"))


# Three parameters of each unit; c tells what each is.
_C = "(p_partkey * 7 + {0} * 5 + p_size * ({0} + 1)) % 8"
PARAMS = Relation(
    "SELECT unit, pos, c, least, CASE c WHEN 0 THEN 'buf' WHEN 1 THEN 'Len' WHEN 2 THEN 'n' WHEN 3 THEN '' WHEN 4 THEN 'v' WHEN 5 THEN 'arr' WHEN 6 THEN 'p' ELSE 'size' END AS name, "
    "CASE c WHEN 0 THEN 'char *' WHEN 1 THEN 'unsigned long' WHEN 2 THEN 'int' WHEN 3 THEN 'int' WHEN 4 THEN 'void *' WHEN 5 THEN 'int *' WHEN 6 THEN 'const struct s *' ELSE 'double' END AS type FROM ("
    + " UNION ALL ".join(f"SELECT p_partkey AS unit, {i} AS pos, {_C.format(i)} AS c, {_C.format(i)} = 5 AND p_size % 2 = 0 AS least FROM {{part}}" for i in range(3))
    + ") AS x"
)
P = {"param": PARAMS}
_ROLES = """WITH near AS (SELECT *, CASE WHEN name = '' THEN 'arg' || pos ELSE name END AS var, lead(c) OVER w AS after, lead(name) OVER w AS next, lag(c) OVER w AS before FROM param WINDOW w AS (PARTITION BY unit ORDER BY pos)),
    roles AS (SELECT *, CASE WHEN c = 4 THEN 'unresolved' WHEN c IN (0, 5, 6) AND after = 1 THEN 'ptr_byte_len' WHEN c IN (0, 5, 6) AND after = 2 THEN 'ptr_elem_count' WHEN c = 5 THEN 'fixed_array'
        WHEN c IN (0, 6) THEN 'scalar_ptr' WHEN c IN (1, 2) AND before IN (0, 5, 6) THEN 'length' ELSE 'scalar' END AS role FROM near) """


def _planned(param):
    shape = F.struct("name", "type", F.when(F.col("c") == 5, 4).cast("int").alias("array_extent"), F.lit(False).alias("array_extent_unresolved"), F.col("least").alias("array_static_min"))
    whole = param.groupBy("unit").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", shape.alias("p")))), lambda x: x["p"]).alias("params"))
    return precond.planned(whole)


@query("f13_parameter_roles", P, _ROLES + "SELECT unit, CAST(pos AS INTEGER) AS pos, var, role, CASE WHEN role IN ('ptr_byte_len', 'ptr_elem_count') THEN next END AS length_var FROM roles")
def f13(param):
    return _planned(param).select("unit", F.posexplode("plan").alias("pos", "p")).select("unit", "pos", "p.var", "p.role", "p.length_var")


@query("j17_object_sizes", P, _ROLES + """SELECT unit, var, CASE role WHEN 'scalar_ptr' THEN 'sizeof(*' || var || ')' WHEN 'fixed_array' THEN '(size_t)4 * sizeof(*arr)'
    WHEN 'ptr_byte_len' THEN CASE WHEN least THEN '((size_t)Len > (size_t)4 * sizeof(*arr) ? (size_t)Len : (size_t)4 * sizeof(*arr))' ELSE '(size_t)Len' END
    ELSE CASE WHEN least THEN '((size_t)n > (size_t)4 ? (size_t)n : (size_t)4)' ELSE '(size_t)n' END || ' * sizeof(*' || var || ')' END AS size FROM roles WHERE role IN ('scalar_ptr', 'fixed_array', 'ptr_byte_len', 'ptr_elem_count')""")
def j17(param):
    rows = _planned(param).select("unit", F.explode(precond.pointers(F.col("plan"))).alias("p"))
    return rows.select("unit", "p.var", precond.allocation(F.col("p")).alias("size"))


@query("n11_unresolved_plans", P, _ROLES + """SELECT unit, count(*) FILTER (role = 'unresolved') = 0 AS resolvable, coalesce(string_agg(var, ',' ORDER BY pos) FILTER (role = 'unresolved'), '') AS unresolved,
    count(*) FILTER (c IN (0, 5, 6)) AS n_pointers FROM roles GROUP BY unit""")
def n11(param):
    return _planned(param).select("unit", "resolvable", F.array_join("unresolved_params", ",").alias("unresolved"), F.col("n_pointers").cast("long").alias("n_pointers"))


# Ninety events in a row are the tree of one translation unit; nine kinds of nodes in turn.
TREE = Relation(
    "SELECT event_id {div} 90 AS tu, event_id AS ord, event_id % 9 AS shape, event_id {div} 9 % 6 AS n, coalesce({k}, 0) AS w, event_id - 1 AS parent, event_id % 9 = 6 AS is_callee, "
    "CASE event_id % 9 WHEN 0 THEN 'FunctionDecl' WHEN 1 THEN 'AsmLabelAttr' WHEN 2 THEN 'AliasAttr' WHEN 3 THEN 'ConstructorAttr' WHEN 4 THEN 'DestructorAttr' WHEN 7 THEN CASE event_id % 5 WHEN 0 THEN 'GCCAsmStmt' WHEN 1 THEN 'FileScopeAsmDecl' ELSE 'CompoundStmt' END WHEN 8 THEN 'StringLiteral' ELSE 'DeclRefExpr' END AS kind, "
    "CASE event_id % 9 WHEN 2 THEN 'g' WHEN 5 THEN 'h' WHEN 6 THEN 'h' ELSE 'f' END || CAST(event_id {div} 9 % 6 AS {str}) AS site, CASE event_id % 9 WHEN 0 THEN ' 0x1 <a.c:1:1> col:5 f' || CAST(event_id {div} 9 % 6 AS {str}) || ' ''int (int)''' WHEN 1 THEN ' 0x2 <col:9> \"sym' || CAST(coalesce({k}, 0) % 3 AS {str}) || '\"' "
    "WHEN 2 THEN ' 0x3 <col:9> \"f' || CAST(coalesce({k}, 0) % 6 AS {str}) || '\"' WHEN 5 THEN ' 0x5 <col:3> ''int (int)'' Function 0x9 ''f' || CAST(coalesce({k}, 0) % 6 AS {str}) || ''' ''int (int)''' WHEN 6 THEN ' 0x5 <col:3> ''int (int)'' Function 0x9 ''f' || CAST(coalesce({k}, 0) % 6 AS {str}) || ''' ''int (int)''' "
    "WHEN 8 THEN ' 0x8 <col:5> ''char[9]'' lvalue \"call f' || CAST(coalesce({k}, 0) % 6 AS {str}) || ', f0\"' ELSE ' 0x9 <col:3>' END AS rest FROM {events}"
)
T = {"tree": TREE}
_SYMBOLS = """labels AS (SELECT DISTINCT tu, 'f' || n AS name, 'sym' || w % 3 AS symbol FROM tree WHERE shape = 1), declared AS (SELECT DISTINCT tu, 'f' || n AS name FROM tree WHERE shape = 0),
    symbols AS (SELECT * FROM labels UNION ALL SELECT tu, name, name FROM declared WHERE (tu, name) NOT IN (SELECT (tu, name) FROM labels))"""
_ALIASED = f"""{_SYMBOLS}, aliased AS (SELECT a.tu, a.name AS callee, b.name AS site FROM symbols a JOIN symbols b ON a.tu = b.tu AND a.symbol = b.symbol AND a.name <> b.name
    UNION SELECT t.tu, k.name, 'g' || t.n FROM tree t JOIN (SELECT * FROM symbols UNION SELECT tu, name, name FROM symbols) k ON k.tu = t.tu AND k.symbol = 'f' || t.w % 6 WHERE t.shape = 2)"""
_ASM = """asm AS (SELECT tu, callee, site, min(ord) AS ord FROM (SELECT d.tu, d.name AS callee, t.site, t.ord FROM declared d JOIN tree t ON t.tu = d.tu AND t.kind = 'GCCAsmStmt'
    UNION ALL SELECT t.tu, d.name, t.site, t.ord FROM tree t JOIN tree p ON p.tu = t.tu AND p.ord = t.parent AND p.kind = 'FileScopeAsmDecl' JOIN declared d ON d.tu = t.tu AND d.name IN ('f0', 'f' || t.w % 6) WHERE t.shape = 8) GROUP BY ALL)"""
_ESCAPED = "escaped AS (SELECT tu, 'f' || w % 6 AS callee, site, min(ord) AS ord FROM tree WHERE shape = 5 GROUP BY ALL)"
_IMPLICIT = "implicit AS (SELECT tu, site AS callee, CASE shape WHEN 3 THEN 'constructor' ELSE 'destructor' END AS site, min(ord) AS ord FROM tree WHERE shape IN (3, 4) GROUP BY tu, site, shape)"


def _asked(tree):
    return tree.where("kind = 'FunctionDecl'").select("tu", F.concat(F.lit("f"), F.col("n").cast("string")).alias("callee")).distinct()


@query("d6_aliases", T, f"WITH {_ALIASED} SELECT tu, callee, site FROM aliased")
def d6(tree):
    return callgraph.symbol_aliases(tree)


@query("h7_address_escapes", T, f"WITH {_ESCAPED} SELECT tu, callee, site, ord FROM escaped")
def h7_escapes(tree):
    return callgraph.address_escapes(tree)


@query("h7_implicit_calls", T, f"WITH {_IMPLICIT} SELECT tu, callee, site, ord FROM implicit")
def h7_implicit(tree):
    return callgraph.implicit_invocations(tree)


@query("h7_assembly_sites", T, f"WITH {_SYMBOLS}, {_ASM} SELECT tu, callee, site, ord FROM asm")
def h7_assembly(tree):
    return callgraph.asm_sites(tree, _asked(tree))


# Definitions of a translation unit; a third are its own source's, a third a header's, a third of no known place.
DEFINITIONS = Relation(
    "SELECT event_id {div} 90 AS tu, event_id AS closed, 'f' || CAST(event_id {div} 3 % 9 AS {str}) AS name, CASE event_id % 3 WHEN 0 THEN './src/../a.c' WHEN 1 THEN 'b.h' ELSE '' END AS file, event_id % 40 AS def_line, "
    "{list}('f' || CAST(coalesce({k}, 0) % 9 AS {str}), 'f' || CAST(event_id {div} 3 % 9 AS {str})) AS calls FROM {events}"
)
SOURCES = Relation("SELECT DISTINCT event_id {div} 90 AS tu, 'a.c' AS source FROM {events}")
_FOREIGN = "foreigners AS (SELECT DISTINCT tu, unnest(calls) AS callee, name AS caller FROM found WHERE closed % 3 > 0), outer_calls AS (SELECT * FROM foreigners WHERE callee <> caller)"


@query("d7_external_callers", {"found": DEFINITIONS, "sources": SOURCES}, f"WITH {_FOREIGN} SELECT tu, callee, caller FROM outer_calls")
def d7(found, sources):
    return callgraph.external_callers(found, sources)


@query("n5_own_units", {"found": DEFINITIONS, "sources": SOURCES}, "SELECT tu, name, def_line, closed FROM found WHERE closed % 3 = 0 QUALIFY row_number() OVER (PARTITION BY tu, name ORDER BY closed) = 1")
def n5(found, sources):
    return units.units(found, sources).select("tu", "name", "def_line", "closed")


@query("n10_open_callers", T | {"found": DEFINITIONS, "sources": SOURCES}, f"""WITH {_ALIASED}, {_ASM}, {_ESCAPED}, {_IMPLICIT}, {_FOREIGN},
    o AS (SELECT tu, callee, 0 AS rank, caller AS site FROM outer_calls UNION ALL SELECT tu, callee, 1, site FROM escaped UNION ALL SELECT tu, callee, 2, site FROM aliased UNION ALL SELECT tu, callee, 3, site FROM implicit UNION ALL SELECT tu, callee, 4, site FROM asm)
    SELECT tu, callee, CAST(rank AS INT) AS rank, CASE WHEN rank = 3 THEN '<' || site || '>' ELSE site END AS caller, CASE WHEN rank = 0 THEN 'unchecked' ELSE 'unresolved' END AS outcome FROM o""")
def n10(tree, found, sources):
    listed = callgraph.openings(callgraph.external_callers(found, sources), callgraph.address_escapes(tree), callgraph.symbol_aliases(tree), callgraph.implicit_invocations(tree), callgraph.asm_sites(tree, _asked(tree)))
    return callgraph.open_caller_checks(listed, F.lit("a.c")).select("tu", "callee", "rank", "caller", "outcome")


# Plans by user: a listing may fail, main may be there, a unit may be missing or hold a pointer of unknown size.
PLANNED = Relation("SELECT DISTINCT user_id {div} 4 AS tu, CASE WHEN user_id % 20 = 3 THEN 'main' ELSE 'f' || CAST(user_id % 4 AS {str}) END AS name, user_id % 7 <> 2 AS resolvable, {list}('p' || CAST(user_id % 4 AS {str}), 'q') AS unresolved_params FROM {events} WHERE user_id % 5 <> 4")
WANTED_PLANS = Relation("SELECT DISTINCT user_id {div} 4 AS tu, 'f' || CAST(user_id % 4 AS {str}) AS name FROM {events}")
FAILED_LISTS = Relation("SELECT DISTINCT user_id {div} 4 AS tu, 'exit ' || CAST(user_id {div} 4 % 3 AS {str}) AS error FROM {events} WHERE user_id {div} 4 % 11 = 5")


@query("n6_plan_subjects", {"found": PLANNED, "wanted": WANTED_PLANS, "failed": FAILED_LISTS}, """WITH m AS (SELECT DISTINCT tu FROM found WHERE name = 'main')
    SELECT w.tu, w.name, CASE WHEN x.error IS NOT NULL OR m.tu IS NOT NULL OR f.name IS NULL THEN 'error' WHEN NOT f.resolvable THEN 'needs_contract' END AS assessment,
    CASE WHEN x.error IS NOT NULL THEN x.error WHEN m.tu IS NOT NULL THEN w.tu || ' defines main(); the sidecar #includes the source, which would duplicate main' WHEN f.name IS NULL THEN 'no definition of ' || w.name || '() in ' || w.tu WHEN NOT f.resolvable THEN 'unresolved pointer parameter(s): ' || array_to_string(f.unresolved_params, ', ') END AS detail
    FROM wanted w LEFT JOIN failed x USING (tu) LEFT JOIN m USING (tu) LEFT JOIN found f ON f.tu = w.tu AND f.name = w.name""")
def n6(found, wanted, failed):
    as_text = lambda df: df.withColumn("tu", F.col("tu").cast("string"))
    return units.plan_subject(as_text(found), as_text(wanted), as_text(failed)).withColumn("tu", F.col("tu").cast("long"))


ASSESSED = Relation("SELECT DISTINCT 'u' || CAST(user_id AS {str}) AS name, CASE user_id % 5 WHEN 0 THEN 'violated' WHEN 1 THEN NULL ELSE 'assumed_verified' END AS assessment, 'own ' || CAST(user_id AS {str}) AS detail, user_id % 3 AS n_pointers FROM {events}")
FOLDED = Relation("SELECT DISTINCT 'u' || CAST(user_id AS {str}) AS callee, 'discharged_verified' AS assessment, 'all callers' AS detail FROM {events} WHERE user_id % 4 = 0")
CALLED = Relation("SELECT 'u' || CAST(user_id AS {str}) AS callee FROM {events} WHERE user_id % 2 = 0 OR user_id % 7 = 0")


@query("n9_discharged", {"unit": ASSESSED, "folded": FOLDED, "called": CALLED}, """SELECT u.name, CASE WHEN u.assessment IS DISTINCT FROM 'assumed_verified' THEN u.assessment WHEN n_pointers = 0 THEN 'discharged_verified' WHEN u.name NOT IN (SELECT callee FROM called) THEN 'assumed_verified' ELSE coalesce(f.assessment, 'assumed_verified') END AS assessment,
    CASE WHEN u.assessment IS DISTINCT FROM 'assumed_verified' THEN u.detail WHEN n_pointers > 0 AND u.name IN (SELECT callee FROM called) THEN f.detail END AS detail FROM unit u LEFT JOIN folded f ON f.callee = u.name""")
def n9(unit, folded, called):
    done = precond.discharge(unit, folded, called)
    # The texts of an empty or exported obligation are those of the operator; the oracle tells the others.
    said = F.col("detail").startswith("own ") | (F.col("detail") == "all callers")
    return done.withColumn("detail", F.when(said, F.col("detail")))
