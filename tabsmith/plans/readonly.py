"""Read-only SQL: one statement that only reads registered views."""

from __future__ import annotations

import re
import threading
from collections.abc import Sequence
from typing import Any

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from tabsmith.errors import WorkbenchError
from tabsmith.operators.order import global_index

#: Heads a statement may have, and table functions that read nothing.
HEADS = ("with", "select", "values", "table")
FUNCTIONS = ("range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple", "sequence")
#: Functions that run code by its name.
REFUSED = ("reflect", "java_method", "try_reflect")
#: The kinds of plan nodes that a reading statement is made of once it is analysed; views are not looked into.
NODES = frozenset("""Aggregate CTERelationDef CTERelationRef Deduplicate Distinct Except Expand Filter Generate GlobalLimit Intersect Join LateralJoin
LocalLimit LocalRelation Offset OneRowRelation Project Range RebalancePartitions RepartitionByExpression Repartition ResolvedHint Sample Sort SubqueryAlias Union UnionLoop
UnionLoopRef Window WithCTE WithWindowDefinition""".split())
#: The kinds of expressions that stand for no function of a name (or for several).
EXPRESSIONS = frozenset("""AggregateExpression Alias AttributeReference BoundReference Cast CommonExpressionDef CommonExpressionRef CurrentRow$ Exists Explode FramelessOffsetWindowFunction
GetArrayItem GetArrayStructFields GetMapValue GetStructField GroupingID Inline InSubquery LambdaFunction LateralSubquery ListQuery Literal NamedLambdaVariable OuterReference
OuterScopeReference PercentileCont PercentileDisc PivotFirst PosExplode PrettyAttribute ScalarSubquery SortOrder SpecialFrameBoundary SpecifiedWindowFrame TemporaryRowFrame TimestampAddInterval
UnboundedFollowing$ UnboundedPreceding$ UnspecifiedFrame$ VariableReference WindowExpression WindowSpecDefinition With GeneratorOuter Grouping DateAddInterval DateAddYMInterval TimestampAddYMInterval
SubtractTimestamps SubtractDates DatetimeSub Ascii$ DivideYMInterval DivideDTInterval MultiplyYMInterval MultiplyDTInterval CheckOverflow MakeDecimal PromotePrecision KnownNotNull CaseWhen Not""".split())
#: Of them, those that hold a plan.
PLANS = frozenset(("Exists", "LateralSubquery", "ListQuery", "ScalarSubquery"))
_lock = threading.Lock()
_known: dict[str, frozenset[str]] = {}


def _items(seq: Any) -> list[Any]:
    return [seq.apply(k) for k in range(seq.size())]


def check_readonly(spark: SparkSession, sql: str) -> None:
    """Refuses what isn't a single reading statement, by the plan that Spark's own parser makes of it. Parts of a plan are evaluated while it
    is analysed, so what names a function or a table by an expression is refused here, whatever it names."""
    head = re.match(r"(?:\s|--[^\n]*\n|/\*.*?\*/|\()*([A-Za-z]+)", sql, re.S)
    if not head or head[1].lower() not in HEADS:
        raise WorkbenchError("INVALID_QUERY", "a query starts with WITH, SELECT, VALUES or TABLE")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise WorkbenchError("INVALID_QUERY", str(e).split("\n")[0]) from None
    todo = [plan]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if re.search(r"Command|Insert|Create|Drop|Alter|Merge|Delete|Update|Statement$|ScriptTransformation|UnresolvedIdentifier", kind):
            raise WorkbenchError("INVALID_QUERY", f"{kind} changes something or hides a name")
        if kind == "UnresolvedTableValuedFunction":
            name = node.name().mkString(".").lower()
            if name not in FUNCTIONS:
                raise WorkbenchError("INVALID_QUERY", f"table function {name} is not allowed")
        todo += _check_functions(node)
        todo += _items(node.children())
        todo += [x for x in _items(node.innerChildren()) if hasattr(x, "innerChildren")]


def _check_functions(node: Any) -> list[Any]:
    """Refuses functions of ``REFUSED``, those of a catalog, which may be anyone's code, and names made by expressions, anywhere in a plan node's
    expressions; the plans that these hold."""
    todo, plans = _items(node.expressions()), []
    while todo:
        e = todo.pop()
        kind = e.getClass().getSimpleName()
        if kind == "UnresolvedFunction":
            parts = [str(p).lower() for p in _items(e.nameParts())]
            if parts[-1] in REFUSED or len(parts) > 1:
                raise WorkbenchError("INVALID_QUERY", f"function {'.'.join(parts)} is not allowed")
        if "UnresolvedIdentifier" in kind:
            raise WorkbenchError("INVALID_QUERY", "a name made by an expression is not allowed")
        if kind in PLANS:
            plans.append(e.plan())
        todo += _items(e.children())
    return plans


def _builtin(spark: SparkSession) -> frozenset[str]:
    """Classes of the functions in Spark's own registry, but for those that are refused; what a user registers is in none of them."""
    key = spark.sparkContext.applicationId
    if key not in _known:
        own = spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
        names, bad, all_ = own.listFunction().iterator(), set(), set()
        while names.hasNext():
            name = names.next()
            found = own.lookupFunction(name)
            if found.isDefined():
                (bad if name.funcName() in REFUSED else all_).add(found.get().getClassName())
        _known[key] = frozenset(all_ - bad)
    return _known[key]


def check_analysed(df: DataFrame) -> None:
    """Refuses a query unless every node and expression of its analysed plan is known to read only: builtin functions over registered
    temporary views, whose own plans are not looked into."""
    builtin = _builtin(df.sparkSession)
    todo = [df._jdf.queryExecution().analyzed()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "View" and node.isTempView():
            continue
        if kind not in NODES:
            raise WorkbenchError("INVALID_QUERY", f"{kind} is not allowed")
        held = _items(node.expressions())
        while held:
            e = held.pop()
            name, short = e.getClass().getName(), e.getClass().getSimpleName()
            if name not in builtin and not (short in EXPRESSIONS and name.startswith("org.apache.spark.sql.catalyst.expressions.")):
                raise WorkbenchError("INVALID_QUERY", f"expression {short} is not allowed")
            if short in PLANS:
                todo.append(e.plan())
            held += _items(e.children())
        todo += _items(node.children())


def query(spark: SparkSession, sql: str, args: Sequence[Any] | dict[str, Any] | None = None) -> DataFrame:
    """Runs a read-only statement with typed parameters (``?`` in order, or ``:name``)."""
    check_readonly(spark, sql)
    values = list(args.values()) if isinstance(args, dict) else list(args or [])
    for v in values:
        if isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))):
            raise WorkbenchError("INVALID_QUERY", "a parameter must be finite")
    marks = len(re.findall(r"\?", re.sub(r"'(?:[^'\\]|\\.|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", "", sql, flags=re.S)))
    if not isinstance(args, dict) and marks != len(values):
        raise WorkbenchError("INVALID_QUERY", "parameter count differs", expected=marks, given=len(values))
    with _lock:  # a path in place of a table is refused while the plan is analysed
        before = spark.conf.get("spark.sql.runSQLOnFiles", "true")
        spark.conf.set("spark.sql.runSQLOnFiles", "false")
        try:
            out = spark.sql(sql, args=args if args else None)
            check_analysed(out)
            return out
        except ParseException as e:
            raise WorkbenchError("INVALID_QUERY", str(e).split("\n")[0]) from None
        except AnalysisException as e:
            raise WorkbenchError("INVALID_QUERY", str(e).split("\n")[0]) from None
        finally:
            spark.conf.set("spark.sql.runSQLOnFiles", before)


def preview(df: DataFrame, limit: int = 200) -> tuple[int, DataFrame]:
    """The number of all rows and at most ``limit`` of them (1 to 200)."""
    if not 1 <= limit <= 200:
        raise WorkbenchError("INVALID_QUERY", "a preview has 1 to 200 rows")
    return df.count(), df.limit(limit)


def with_row_ordinal(df: DataFrame, order: Sequence[Any]) -> DataFrame:
    return global_index(df, order)
