"""One read-only query over nothing but the relations of a scope."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Collection, Iterable, Mapping
from dataclasses import dataclass, field
from typing import TypeVar

from py4j.protocol import Py4JJavaError
from pyspark.errors import ParseException
from pyspark.sql import DataFrame, Row, SparkSession

from plumbline.functions import fixed
from plumbline.operators.audit import cap_rows


T = TypeVar("T")


class QueryRejected(ValueError):
    """The query is not allowed; nothing was executed."""


@dataclass(frozen=True)
class Relation:
    """How a scoped relation is loaded, and the columns it hides."""

    load: Callable[[SparkSession], DataFrame]
    hidden: tuple[str, ...] = ()


# Functions of the engine that reach outside of the data.
_OUTSIDE = ("reflect", "java_method", "try_reflect")
# Leaves that hold no data but what the text itself spells out, or stand for a part of the plan that is walked anyway.
_OWN_LEAVES = ("OneRowRelation", "LocalRelation", "CTERelationRef", "UnresolvedInlineTable", "ResolvedInlineTable", "OuterReference")
_SUBQUERIES = ("ScalarSubquery", "ListQuery", "Exists", "LateralSubquery", "FunctionTableSubqueryArgumentExpression")


@dataclass
class Findings:
    """What a plan is made of, outside of the scoped views."""

    relations: list[str] = field(default_factory=list)  # scoped views, in the order they are met
    foreign: list[str] = field(default_factory=list)  # any other source of rows
    unconditional: int = 0  # joins of scoped views without a condition
    functions: list[str] = field(default_factory=list)
    table_functions: list[str] = field(default_factory=list)


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _name(parts) -> str:
    return ".".join(str(p) for p in _items(parts))


def _below(node) -> list:
    """Plans below a plan node: children, definitions of common tables, and subqueries within its expressions."""
    plans = _items(node.children())
    if _kind(node) == "UnresolvedWith":
        plans += [pair._2() for pair in _items(node.cteRelations())]
    return plans


def _walk_expressions(node, found: Findings, walk: Callable) -> None:
    pending = _items(node.expressions())
    while pending:
        expression = pending.pop()
        if _kind(expression) == "UnresolvedFunction":
            found.functions.append(_name(expression.nameParts()).lower())
        if _kind(expression) in _SUBQUERIES:
            walk(expression.plan())
        pending += _items(expression.children())


def parsed_findings(plan) -> Findings:
    """Functions and table functions as written; texts inside literals are none."""
    found = Findings()

    def walk(node) -> None:
        if _kind(node) == "UnresolvedTableValuedFunction":
            found.table_functions.append(_name(node.name()).lower())
        _walk_expressions(node, found, walk)
        for child in _below(node):
            walk(child)

    walk(plan)
    return found


def analysed_findings(plan, scope: Collection[str]) -> Findings:
    """Which scoped views the resolved plan really reads, what else it reads, and how they are joined.

    A name counts only as what the analyser made of it: a common table or an alias named like a scoped relation is no such relation. What a
    scoped view itself reads is not looked at.
    """
    found = Findings()

    def walk(node) -> bool:
        """Whether scoped views are read below."""
        kind = _kind(node)
        if kind == "View":
            identifier = node.desc().identifier()
            name = identifier.table().lower()
            if node.isTempView() and identifier.database().isEmpty() and name in scope:
                found.relations.append(name)
                return True
            found.foreign.append(identifier.unquotedString())
            return False
        _walk_expressions(node, found, walk)
        sides = [walk(child) for child in _below(node)]
        if not sides and kind not in _OWN_LEAVES:
            found.foreign.append(node.nodeName())
        if kind == "Join" and all(sides) and node.condition().isEmpty():
            found.unconditional += 1
        if kind == "LateralJoin" and sides[0] and node.condition().isEmpty():
            before = len(found.relations)
            found.unconditional += walk(node.right().plan())
            del found.relations[before:]  # met among the expressions already
        return any(sides)

    walk(plan)
    return found


def governed_query(
    spark: SparkSession,
    scope: Mapping[str, Relation],
    sql: str,
    max_rows: int | None,
    allow: Iterable[str] = (),
) -> DataFrame:
    """Analyse ``sql`` in a session of its own that knows only the scope, and cap the result.

    The text is wrapped in a subquery, so writes, commands and second statements do not parse. What it may do is decided on the plans that
    the engine makes of it, node by node: functions on the parsed one, relations and joins on the analysed one. Hidden columns do not exist
    for the query, not even for ``*``, unless allowed by name. Without ``max_rows`` the result is meant to be written, not fetched, and no
    cap gathers it.
    """
    if not scope:
        raise QueryRejected("An empty scope allows no query")
    session = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        session.conf.set(key, spark.conf.get(key))
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    session.conf.set("spark.sql.crossJoin.enabled", "false")
    text = f"select * from (\n{sql}\n)"
    try:
        parsed = parsed_findings(session._jsparkSession.sessionState().sqlParser().parsePlan(text))
    except Py4JJavaError as exc:
        raise QueryRejected(str(exc.java_exception.getMessage()).strip().splitlines()[0]) from exc
    except ParseException as exc:
        raise QueryRejected(str(exc).strip().splitlines()[0]) from exc
    for name in parsed.functions:
        if name in fixed.FORBIDDEN_FUNCTIONS or name in _OUTSIDE:
            raise QueryRejected(f"Function '{name}' is forbidden")
    for name in parsed.table_functions:
        raise QueryRejected(f"Table function '{name}' is not in scope")
    permitted = {name.lower() for name in allow}
    for name, relation in scope.items():
        df = relation.load(session)
        hidden = {h.lower() for h in relation.hidden} - permitted
        df.select(*[c for c in df.columns if c.lower() not in hidden]).createTempView(name)
    try:
        result = session.sql(text)
    except Exception as exc:
        raise QueryRejected(str(exc).splitlines()[0]) from exc
    found = analysed_findings(result._jdf.queryExecution().analyzed(), {name.lower() for name in scope})
    if found.foreign:
        raise QueryRejected(f"Relation '{found.foreign[0]}' is not in scope")
    if not found.relations:
        raise QueryRejected("SQL must query at least one relation of the scope")
    if found.unconditional:
        raise QueryRejected("Every join of relations requires a join condition")
    return result if max_rows is None else cap_rows(result, max_rows)


def _within(session: SparkSession, timeout_seconds: float, action: Callable[[], T]) -> T:
    """Run an action of this thread; when time is up its jobs are cancelled."""
    tag = f"governed-{uuid.uuid4().hex}"
    late, done = threading.Event(), threading.Event()

    def stop() -> None:
        if done.wait(timeout_seconds):
            return
        late.set()
        while not done.wait(0.2):  # a job may start after the first interrupt
            context.cancelJobsWithTag(tag)

    context = session.sparkContext
    watch = threading.Thread(target=stop, daemon=True)
    context.addJobTag(tag)
    watch.start()
    try:
        return action()
    except Exception as exc:
        if late.is_set():
            raise TimeoutError(f"Query exceeded the {timeout_seconds}s timeout") from exc
        raise
    finally:
        done.set()
        watch.join()
        context.removeJobTag(tag)


def fetch(result: DataFrame, timeout_seconds: float) -> list[Row]:
    """Collect a capped result; when time is up its jobs are cancelled."""
    return _within(result.sparkSession, timeout_seconds, result.collect)


def save(result: DataFrame, path: str, timeout_seconds: float) -> None:
    """Write a result of any size as Parquet; when time is up its jobs are cancelled and nothing is committed."""
    _within(result.sparkSession, timeout_seconds, lambda: result.write.parquet(path))
