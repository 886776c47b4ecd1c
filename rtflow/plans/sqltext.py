"""Job statements given as SQL text.

Spark's own parser takes the text apart; this adapter only reads the pieces off its unresolved
plan. It needs a session with a JVM gateway (not Spark Connect). Jobs given in parts, see
``plans.jobs``, do without it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import ParseException
from pyspark.sql import SparkSession

from rtflow.operators.joins import JoinSpec

_JOIN_TYPES = {"Inner": "inner", "LeftOuter": "left", "RightOuter": "right"}


@dataclass
class Statement:
    select: list[tuple[str, str]] = field(default_factory=list)
    table: str = ""
    alias: str | None = None
    where: str | None = None
    group_by: list[str] = field(default_factory=list)
    having: str | None = None
    join: JoinSpec | None = None


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _parts(attribute) -> list[str]:
    return [str(part) for part in _items(attribute.nameParts())]


def _text(node, sql: str, parser) -> str:
    """The text of an expression: as the user wrote it, or else as Spark prints it.

    Spark does not print everything (DISTINCT, for one) and does not record every position
    exactly, so a text counts only if it parses to the very same expression.
    """
    origin = node.origin()
    candidates = []
    if origin.startIndex().isDefined() and origin.stopIndex().isDefined():
        candidates.append(sql[origin.startIndex().get() : origin.stopIndex().get() + 1])
    candidates.append(node.sql())
    for text in candidates:
        try:
            if parser.parseExpression(text).equals(node):
                return text
        except ParseException:
            continue
    raise ValueError(f"cannot take {node.sql()} out of its statement: give the job in parts")


def _select_item(node, sql: str, parser) -> tuple[str, str]:
    if _kind(node) == "Alias":
        return _text(node.child(), sql, parser), str(node.name())
    if _kind(node) == "UnresolvedAlias":
        node = node.child()
    if _kind(node) == "UnresolvedAttribute":
        return node.sql(), _parts(node)[-1]
    if "Star" in _kind(node):
        raise ValueError("SELECT * is not supported: name the columns")
    raise ValueError(f"select item {node.sql()} needs an alias")


def _relation(node) -> tuple[str, str | None]:
    alias = None
    if _kind(node) == "SubqueryAlias":
        alias, node = str(node.alias()), node.child()
    if _kind(node) == "Join":
        raise ValueError("joins of three and more tables are not supported: chain two jobs")
    if _kind(node) != "UnresolvedRelation":
        raise ValueError(f"FROM must name tables, not {_kind(node)}")
    return ".".join(str(part) for part in _items(node.multipartIdentifier())), alias


def _key(node, spec_names: tuple[set, set]) -> tuple[int, str]:
    parts = _parts(node) if _kind(node) == "UnresolvedAttribute" else []
    for side in (0, 1):
        if len(parts) == 2 and parts[0] in spec_names[side]:
            return side, parts[1]
    raise ValueError(f"ON must compare a column of each table, written table.column; got {node.sql()}")


def _join(node) -> JoinSpec:
    kind = str(node.joinType().toString())
    if kind not in _JOIN_TYPES:
        raise ValueError(f"{kind} joins are not supported, use inner, left or right")
    (left, left_alias), (right, right_alias) = _relation(node.left()), _relation(node.right())
    condition = node.condition()
    if condition.isEmpty() or _kind(condition.get()) != "EqualTo":
        raise ValueError("a join needs ON with exactly one equality of two columns")
    names = ({left, left_alias}, {right, right_alias})
    keys = dict(_key(side, names) for side in (condition.get().left(), condition.get().right()))
    if len(keys) != 2:
        raise ValueError("ON compares two columns of the same table")
    return JoinSpec(left, right, keys[0], keys[1], _JOIN_TYPES[kind], left_alias, right_alias)


def parse_select(spark: SparkSession, sql: str) -> Statement:
    """Read ``SELECT .. FROM a [JOIN b ON a.k = b.k] [WHERE ..] [GROUP BY ..] [HAVING ..]``."""
    if not sql or not sql.strip():
        raise ValueError("the SQL statement is empty")
    parser = spark._jsparkSession.sessionState().sqlParser()
    try:
        node = parser.parsePlan(sql)
    except ParseException as error:
        raise ValueError(f"not a SELECT statement Spark can parse: {error}") from error
    statement = Statement()
    if _kind(node) == "UnresolvedHaving":
        statement.having, node = _text(node.havingCondition(), sql, parser), node.child()
    if _kind(node) == "Aggregate":
        statement.group_by = [_text(group, sql, parser) for group in _items(node.groupingExpressions())]
        selected = node.aggregateExpressions()
    elif _kind(node) == "Project":
        selected = node.projectList()
    else:
        raise ValueError(f"only a plain SELECT is supported, not {_kind(node)}")
    statement.select = [_select_item(item, sql, parser) for item in _items(selected)]
    node = node.child()
    if _kind(node) == "Filter":
        statement.where, node = _text(node.condition(), sql, parser), node.child()
    if _kind(node) == "Join":
        statement.join = _join(node)
    else:
        statement.table, statement.alias = _relation(node)
    return statement
