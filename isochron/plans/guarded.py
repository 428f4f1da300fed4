"""SQL of users against as-of views: reading only, at a pinned clock, a bounded number of rows."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator
from zoneinfo import ZoneInfo

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

from isochron.functions.timeaxis import SITE_ZONE, naive_utc
from isochron.operators.series import capped

#: Text that is no code: strings, quoted names, comments.
_QUOTED = re.compile(r"""('(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/)""", re.DOTALL)
#: Calls of the clock, and the names that SQL takes for such calls without parentheses; no columns of a table (r.now) and no aliases (AS today).
_CALL = r"(?:\s*\(\s*\))"
_CLOCKS = re.compile(
    rf"(?P<no>(?:\.|\bas\s)\s*\w+)|\b(?P<day>current_date\b{_CALL}?|today\s*\(\s*\))|\b(?P<instant>(?:current_timestamp|localtimestamp)\b{_CALL}?|(?:now|current_datetime){_CALL})|\b(?P<time>current_time\b{_CALL}?)", re.IGNORECASE
)


def pinned(sql: str, as_of: dt.datetime, zone: str = SITE_ZONE) -> str:
    """``sql`` with the clock's functions replaced by literals: dates are the site's, instants are naive UTC."""
    utc, day = naive_utc(as_of), as_of.astimezone(ZoneInfo(zone)).date()

    def literal(m: re.Match) -> str:
        if m["no"]:
            return m[0]
        if m["day"]:
            return f"DATE '{day}'"
        return f"TIMESTAMP_NTZ '{utc:%Y-%m-%d %H:%M:%S}'" if m["instant"] else f"'{utc:%H:%M:%S}'"

    return "".join(part if k % 2 else _CLOCKS.sub(literal, part) for k, part in enumerate(_QUOTED.split(sql)))


def _children(spark: SparkSession, node) -> Iterator:
    """What a node of a parsed statement holds: plans below it, its expressions, plans within those and common table expressions."""
    seq = lambda s: (s.apply(k) for k in range(s.size()))
    yield from seq(node.children())
    is_a = lambda kind: spark._jvm.java.lang.Class.forName(kind).isInstance(node)
    if is_a("org.apache.spark.sql.catalyst.plans.QueryPlan"):
        yield from seq(node.expressions())
        if node.getClass().getSimpleName() == "UnresolvedWith":
            yield from (pair._2() for pair in seq(node.cteRelations()))
    elif is_a("org.apache.spark.sql.catalyst.expressions.PlanExpression"):
        yield node.plan()


#: Nodes of Spark's parsed plans that only read. Others (commands, inserts, scripts, immediate execution, blocks) make a statement no query.
_READING = frozenset("""
    Project Filter Aggregate Join LateralJoin UsingJoin Sort GlobalLimit LocalLimit Offset Distinct Union Intersect Except SubqueryAlias OneRowRelation LocalRelation
    Generate Expand Window Sample Pivot Unpivot Tail UnresolvedWith UnresolvedRelation UnresolvedInlineTable UnresolvedTableValuedFunction UnresolvedTVFAliases UnresolvedHaving
    UnresolvedSubqueryColumnAliases UnresolvedHint WithWindowDefinition PipeOperator RepartitionByExpression
""".split())


def parsed_names(spark: SparkSession, sql: str) -> tuple[set[str], set[str], set[str]]:
    """Nodes that do not only read, functions and relations of a statement, by Spark's own parser; nothing is run or looked up. Names that WITH defines are no relations."""
    plan = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.LogicalPlan")
    commands, functions, relations, defined = set(), set(), set(), set()
    todo = [spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        name = lambda node=node: ".".join(node.nameParts().apply(k) for k in range(node.nameParts().size()))
        if plan.isInstance(node) and kind not in _READING:
            commands.add(kind)
        elif kind == "UnresolvedFunction":
            functions.add(name().lower())
        elif kind == "UnresolvedTableValuedFunction":
            functions.add(".".join(node.name().apply(k) for k in range(node.name().size())).lower())
        elif kind == "UnresolvedRelation":
            relations.add(".".join(node.multipartIdentifier().apply(k) for k in range(node.multipartIdentifier().size())).lower())
        elif kind == "UnresolvedWith":
            defined |= {node.cteRelations().apply(k)._1().lower() for k in range(node.cteRelations().size())}
        if not commands:
            todo += _children(spark, node)
    return commands, functions, relations - defined


#: Functions that run code of the JVM by name.
_REFLECTION = {"reflect", "java_method", "try_reflect"}


def select_only(spark: SparkSession, sql: str, tables: set[str] | None = None) -> DataFrame:
    """The DataFrame of one query that only reads.

    Spark's parser decides, not a pattern: a statement with a node in its tree that is not known to read only is refused (commands, inserts,
    scripts, immediate execution), and so are several statements, functions that call JVM code, and files that are named in place of a table. With ``tables`` only those
    (and what WITH defines) may be read. Words in strings, comments and quoted names count for nothing.
    """
    try:
        commands, functions, relations = parsed_names(spark, sql.strip().rstrip(";"))
    except ParseException as e:
        raise ValueError("only one query is allowed") from e
    if commands:
        raise ValueError(f"only one query is allowed, no {', '.join(sorted(commands))}")
    if refused := functions & _REFLECTION:
        raise ValueError(f"functions that call code: {', '.join(sorted(refused))}")
    if refused := {x for x in relations if "/" in x or "\\" in x}:
        raise ValueError(f"files in place of tables: {', '.join(sorted(refused))}")
    if tables is not None and (refused := relations - {t.lower() for t in tables}):
        raise ValueError(f"no such tables: {', '.join(sorted(refused))}")
    return spark.sql(sql.strip().rstrip(";"))


def ask(spark: SparkSession, sql: str, as_of: dt.datetime, most: int = 100) -> dict:
    """columns, rows (at most ``most``) and whether there are more."""
    df = select_only(spark, pinned(sql, as_of))
    rows, more = capped(df, most)
    return {"columns": df.columns, "rows": [r.asDict() for r in rows], "truncated": more}
