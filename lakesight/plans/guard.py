"""Checks on text that becomes SQL: read-only queries, KPI formulas, rule conditions.

Texts are parsed by the session's own parser, and the unresolved plan is walked
through all its parts, named subqueries and subqueries in expressions included.
Only the listed kinds of nodes are accepted, so a word means what it means to
Spark: a column may be called lock and a function replace.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession


class UnsafeSql(ValueError):
    """The text is not an acceptable read-only query, formula or condition."""


# Accepted first words, refused functions and relations, row limits, functions of formulas.
READ_STARTS = ("SELECT", "WITH", "EXPLAIN")
REFUSED_FUNCTIONS = frozenset(("LOAD_FILE", "PG_SLEEP", "BENCHMARK"))
REFUSED_RELATIONS = frozenset(("INFORMATION_SCHEMA.USER_PRIVILEGES",))
AGGREGATES = ("SUM", "AVG", "COUNT", "MIN", "MAX")
DEFAULT_LIMIT = 1_000
MAX_ROWS = 50_000

#: Spark's own ways out of a query: calls of Java methods
SIDE_DOORS = frozenset(("REFLECT", "JAVA_METHOD", "TRY_REFLECT"))
#: names that Spark takes for a file format, if they stand before a dot and are no database
FILE_FORMATS = frozenset(("PARQUET", "ORC", "AVRO", "CSV", "JSON", "TEXT", "XML", "BINARYFILE", "DELTA", "ICEBERG", "HUDI", "JDBC"))
#: kinds of plan nodes that only read
READING_NODES = frozenset((
    "Aggregate", "Distinct", "Except", "Filter", "Generate", "GlobalLimit", "Intersect", "Join", "LateralJoin", "LocalLimit", "LocalRelation", "Offset",
    "OneRowRelation", "Pivot", "Project", "Sample", "Sort", "SubqueryAlias", "Union", "UnresolvedHaving", "UnresolvedInlineTable",
    "UnresolvedOrderBy", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedTableValuedFunction", "UnresolvedWith",
    "Unpivot", "Window", "WithWindowDefinition",
))
READING_FUNCTIONS = frozenset(("RANGE", "EXPLODE", "EXPLODE_OUTER", "POSEXPLODE", "POSEXPLODE_OUTER", "INLINE", "INLINE_OUTER", "STACK", "JSON_TUPLE"))
#: kinds of expressions that name something only when the query runs
LATE_NAMES = frozenset(("ExpressionWithUnresolvedIdentifier", "UnresolvedTableArg", "FunctionTableSubqueryArgumentExpression"))
FORMULA_NODES = frozenset((
    "UnresolvedFunction", "UnresolvedAttribute", "UnresolvedStar", "Literal", "Add", "Subtract", "Multiply", "Divide", "UnaryMinus", "UnaryPositive",
))

_PARTS = re.compile(
    r"""(?P<text>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*")|(?P<name>`(?:[^`]|``)*`)|(?P<comment>--[^\n]*|/\*.*?\*/)|(?P<open>['"`]|/\*)|(?P<code>.)""",
    re.DOTALL)
_WORD = re.compile(r"[A-Za-z_]\w*")
_FORMULA = re.compile(r"[\w\s+\-*/().]+", re.ASCII)
_LAST_LIMIT = re.compile(r"\blimit\s+(\d+)(?:\s+offset\s+\d+)?\s*$", re.IGNORECASE)


def _refuse(condition: bool, reason: str) -> None:
    if condition:
        raise UnsafeSql(reason)


def bare_code(sql: str) -> str:
    """The query with the insides of literals and quoted names and all comments blanked, every character at its place.

    Words inside literals, quoted names and comments mean nothing to Spark, so
    the checks must not see them, nor take a comment mark inside a literal for one.
    """
    out = []
    for m in _PARTS.finditer(sql):
        kind, part = m.lastgroup, m.group()
        _refuse(kind == "open", "a quote or comment is not closed")
        if kind == "comment":
            part = " " * len(part)
        elif kind != "code":
            part = part[0] + "_" * (len(part) - 2) + part[-1]
        out.append(part)
    return "".join(out)


def _session() -> SparkSession:
    session = SparkSession.getActiveSession() or SparkSession._instantiatedSession
    if session is None:
        raise RuntimeError("queries are checked by the parser of a session, and there is none")
    return session


def _parsed(text: str, as_expression: bool = False):
    parser = _session()._jsparkSession.sessionState().sqlParser()
    try:
        return parser.parseExpression(text) if as_expression else parser.parsePlan(text)
    except ParseException as error:
        raise UnsafeSql(str(error).splitlines()[0]) from None


def _items(sequence) -> list:
    return [sequence.apply(i) for i in range(sequence.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName().removesuffix("$")


def _expressions(node) -> Iterator:
    yield node
    for child in _items(node.children()):
        yield from _expressions(child)


def _text_parts(node) -> list[str]:
    """The parts of a dotted name."""
    return [str(p) for p in _items(node)]


def _check_relation(parts: list[str]) -> None:
    name = ".".join(parts).upper()
    _refuse(any(name.endswith(r) for r in REFUSED_RELATIONS), f"refused relation: {name}")
    if len(parts) > 1:
        by_path = any(c in parts[-1] for c in "/:\\*")
        _refuse(by_path or (parts[0].upper() in FILE_FORMATS and not _session().catalog.databaseExists(parts[0])), "files cannot be read by their path")


def _check_expression(root) -> None:
    for node in _expressions(root):
        kind = _kind(node)
        _refuse(kind in LATE_NAMES, f"refused expression: {kind}")
        if kind == "UnresolvedFunction":
            name = _text_parts(node.nameParts())[-1].upper()
            _refuse(name in SIDE_DOORS or name in REFUSED_FUNCTIONS, f"refused function: {name}")
        if hasattr(node, "plan") and _is_subquery(node):
            _check_plan(node.plan())


def _is_subquery(node) -> bool:
    jvm = _session()._jvm
    return jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.expressions.PlanExpression").isInstance(node)


def _check_plan(plan) -> None:
    kind = _kind(plan)
    _refuse(kind not in READING_NODES, f"refused: {kind} is no part of a read")
    if kind == "UnresolvedRelation":
        _check_relation(_text_parts(plan.multipartIdentifier()))
    if kind == "UnresolvedTableValuedFunction":
        name = _text_parts(plan.name())[-1].upper()
        _refuse(name not in READING_FUNCTIONS, f"refused table function: {name}")
    for expression in _items(plan.expressions()):
        _check_expression(expression)
    for part in (*_items(plan.children()), *_items(plan.innerChildren())):
        _check_plan(part)


def check_read_only(sql: str) -> str:
    """Return the query as it was given, without a final semicolon, or raise."""
    given = sql or ""
    code = bare_code(given)
    end = len(code.rstrip())
    if code[:end].endswith(";"):
        end -= 1
    code, given = code[:end], given[:end]
    first = _WORD.match(code.lstrip(" \t\r\n("))
    _refuse(first is None or first.group().upper() not in READ_STARTS, "only SELECT, WITH and EXPLAIN are allowed")
    _refuse(";" in code, "more than one statement")
    plan = _parsed(given.strip())
    _check_plan(plan.logicalPlan() if _kind(plan) == "ExplainCommand" else plan)
    return given.strip()


def check_condition(condition: str) -> str:
    """A boolean row condition: one read-only expression without comments."""
    _refuse(not (condition or "").strip(), "empty condition")
    _refuse(any(mark in condition for mark in (";", "--", "/*", "*/")), "semicolons and comments are refused")
    _check_expression(_parsed(condition, as_expression=True))
    return condition.strip()


def check_formula(formula: str) -> list[str]:
    """Columns of an aggregate formula made of SUM/AVG/COUNT/MIN/MAX, numbers and + - * / ( )."""
    text = (formula or "").strip()
    _refuse(not text, "empty formula")
    _refuse("--" in text or "/*" in text or "*/" in text, "comments are refused")
    _refuse(_FORMULA.fullmatch(text) is None, "only names, numbers, + - * / and parentheses are allowed")
    columns = []
    for node in _expressions(_parsed(text, as_expression=True)):
        kind = _kind(node)
        _refuse(kind not in FORMULA_NODES, f"refused in a formula: {kind}")
        if kind == "UnresolvedFunction":
            name = _text_parts(node.nameParts())[-1].upper()
            _refuse(name not in AGGREGATES, f"refused function: {name}")
        if kind == "UnresolvedAttribute":
            columns.append(".".join(_text_parts(node.nameParts())))
    return list(dict.fromkeys(columns))


def zero_safe(formula: str) -> str:
    """Wrap every divisor in nullif(.., 0), so that a zero divisor gives NULL instead of an error."""
    done, rest = "", formula
    while "/" in rest:
        before, after = rest.split("/", 1)
        head = re.match(r"\s*[+-]?\s*[\w.]*\s*", after).group()
        end = len(head)
        if after[end : end + 1] == "(":
            depth = 0
            for end in range(end, len(after)):
                depth += {"(": 1, ")": -1}.get(after[end], 0)
                if depth == 0:
                    break
            end += 1
        done += f"{before}/ nullif({zero_safe(after[:end].strip())}, 0) "
        rest = after[end:]
    return done + rest


def run_read_only(
    spark: SparkSession, sql: str, default_limit: int | None = None, max_rows: int | None = None
) -> DataFrame:
    """Run a guarded query as it was written.

    ``default_limit`` cuts a query without a final LIMIT, ``max_rows`` any query;
    without them all rows come back. ``is_cut`` tells whether rows were left out.
    """
    result, rows = _planned(spark, sql, default_limit, max_rows)
    return result if rows is None else result.limit(rows)


def is_cut(spark: SparkSession, sql: str, default_limit: int | None = None, max_rows: int | None = None) -> bool:
    """True if ``run_read_only`` with these limits leaves out rows that the query has."""
    result, rows = _planned(spark, sql, default_limit, max_rows)
    return rows is not None and result.limit(rows + 1).count() > rows


def _planned(spark: SparkSession, sql: str, default_limit: int | None, max_rows: int | None) -> tuple[DataFrame, int | None]:
    statement = check_read_only(sql)
    code = bare_code(statement).strip()
    own = _LAST_LIMIT.search(code)
    limits = [x for x in ((max_rows,) if own else (default_limit, max_rows)) if x is not None]
    if code.split(None, 1)[0].upper() == "EXPLAIN" or not limits:
        return spark.sql(statement), None
    return spark.sql(statement), min(limits)
