"""The SQL surface: one read-only query, checked before it runs, with a known order of its rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.engine import dialect

MAX_SQL_BYTES, MAX_DEPTH = 65_536, 256
MAX_TEXT, MAX_ITEMS = 64 << 20, 20_000_000

#: Plan nodes of the parser that a query may hold; everything else is refused.
ALLOWED = frozenset(
    (
        "Project Aggregate Sort GlobalLimit LocalLimit Offset Filter UnresolvedHaving Join LateralJoin UnresolvedWith SubqueryAlias "
        "UnresolvedSubqueryColumnAliases Distinct Union Intersect Except UnresolvedInlineTable LocalRelation UnresolvedRelation OneRowRelation "
        "UnresolvedTVFAliases UnresolvedTableValuedFunction Generate WithWindowDefinition Window Pivot Unpivot UnresolvedHint Sample UnionLoop UnresolvedSubqueryColumnAlias "
        "AsOfJoin Deduplicate Tail RelationTimeTravel ResolvedInlineTable Expand UnresolvedOrdinal"
    ).split()
)
#: Functions that reach outside the query.
REFUSED_FUNCTIONS = frozenset(("reflect", "java_method", "try_reflect", "input_file_name", "read_files"))
#: Nodes over which rows keep the order they were given in; file scans may be split, so they claim no order.
_FILE_ORDER = {"Project", "Filter", "GlobalLimit", "LocalLimit", "Offset", "SubqueryAlias", "View", "LogicalRDD", "OneRowRelation", "LocalRelation"}


class Refused(ValueError):
    """A query that isn't run; the message is one sentence."""


def configure(spark: SparkSession) -> None:
    """Names keep their case, double quotes quote names, and no file is read from SQL."""
    for key, value in {"spark.sql.caseSensitive": "true", "spark.sql.ansi.enabled": "true", "spark.sql.ansi.doubleQuotedIdentifiers": "true", "spark.sql.runSQLOnFiles": "false", "spark.sql.session.timeZone": "UTC"}.items():
        spark.conf.set(key, value)


def _list(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _walk(node, depth: int = 0):
    """(node, whether it is a plan) of all plan nodes and expressions below a plan, subqueries and common table
    expressions included."""
    if depth > MAX_DEPTH:
        raise Refused("the query is nested too deeply")
    yield node, True
    kind = _kind(node)
    below = _list(node.children())
    if kind == "UnresolvedWith":
        below += [pair._2() for pair in _list(node.cteRelations())]
    for c in below:
        yield from _walk(c, depth + 1)
    for e in _list(node.expressions()):
        yield from _expressions(e, depth + 1)


#: Expressions that hold a plan of their own.
_HOLD_PLANS = ("ScalarSubquery", "ListQuery", "Exists", "LateralSubquery", "UnresolvedTableArgPlanId", "FunctionTableSubqueryArgumentExpression")


def _expressions(e, depth: int):
    if depth > MAX_DEPTH:
        raise Refused("the query is nested too deeply")
    yield e, False
    if _kind(e) in _HOLD_PLANS:
        yield from _walk(e.plan(), depth + 1)
    for c in _list(e.children()):
        yield from _expressions(c, depth + 1)


def gate(spark: SparkSession, sql: str) -> None:
    """Refuses all but one SELECT, or EXPLAIN of one. What can't be told is refused."""
    if len(sql.encode()) > MAX_SQL_BYTES:
        raise Refused(f"the query is longer than {MAX_SQL_BYTES} bytes")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as x:  # noqa: BLE001
        raise Refused(f"the query does not parse: {sentence(x)}") from None
    if _kind(plan) == "ExplainCommand":
        plan = plan.logicalPlan()
    for node, is_plan in _walk(plan):
        kind = _kind(node)
        if is_plan and kind not in ALLOWED:
            raise Refused("only SELECT queries are run")
        if kind == "UnresolvedFunction":
            name = _list(node.nameParts())[-1].lower()
            if name in REFUSED_FUNCTIONS:
                raise Refused(f"the function {name} is not available")
            _bounded(name, node)


def _bounded(name: str, node) -> None:
    """Refuses literal sizes that would make texts or lists too large, before anything folds them."""
    args = _list(node.arguments())

    def number(i: int) -> int | None:
        if len(args) > i and _kind(args[i]) == "Literal":
            try:
                return int(args[i].value())
            except (TypeError, ValueError):
                return None
        return None

    if name in ("repeat", "lpad", "rpad") and (k := number(1)) is not None and k > MAX_TEXT:
        raise Refused(f"{name} would make a text of more than {MAX_TEXT >> 20} MiB")
    if name == "array_repeat" and (k := number(1)) is not None and k > MAX_ITEMS:
        raise Refused(f"{name} would make a list of more than {MAX_ITEMS} elements")
    if name == "sequence" and (a := number(0)) is not None and (b := number(1)) is not None and abs(b - a) / max(1, abs(number(2) or 1)) > MAX_ITEMS:
        raise Refused(f"{name} would make a list of more than {MAX_ITEMS} elements")


def sentence(x: BaseException) -> str:
    """The root cause of an error in one sentence."""
    root = getattr(x, "java_exception", None)
    while root is not None and root.getCause() is not None:
        root = root.getCause()
    text = str(root.getMessage()).split("\n")[0] if root is not None and root.getMessage() else ""
    text = text or str(x.getMessage() if isinstance(x, PySparkException) and hasattr(x, "getMessage") else getattr(x, "java_exception", x)).split("\n")[0].strip()
    if "DIVIDE_BY_ZERO" in text:
        return "a number was divided by zero; NULLIF(divisor, 0) avoids it"
    if "ARITHMETIC_OVERFLOW" in text:
        return "a number left the range of its type"
    if text.startswith("[") and "]" in text:
        text = text[text.index("]") + 1 :].strip()
    return text.split(" SQLSTATE:")[0].strip().rstrip(".")


def _whole(spark: SparkSession):
    def check(text: str, wanted: int) -> bool:
        try:
            plan = spark._jsparkSession.sql(text).queryExecution().analyzed()
        except Exception:  # noqa: BLE001
            return False
        found = [e for e, is_plan in _walk(plan) if not is_plan and _kind(e) == "IntegralDivide"]
        integral = {"LongType", "IntegerType", "ShortType", "ByteType"}
        return len(found) >= wanted and all(_kind(c.dataType()) in integral for e in found for c in _list(e.children()))

    return check


def _floats(spark: SparkSession):
    def check(text: str, n: int) -> bool:
        """Whether the n-th division of a text is between floats: told by making it one that fails on floats only."""
        ts = dialect.tokens(text)
        i = [k for k, t in enumerate(ts) if t.kind == "sign" and t.text == "/"][n]
        try:
            before = spark._jsparkSession.sql(text).queryExecution().analyzed()
            after = spark._jsparkSession.sql("".join(" % " if k == i else t.text for k, t in enumerate(ts))).queryExecution().analyzed()
        except Exception:  # noqa: BLE001
            return False
        double = lambda plan: sum(_kind(e.dataType()) in ("DoubleType", "FloatType") for e, is_plan in _walk(plan) if not is_plan and _kind(e) == "Divide")
        return double(before) > double(after)

    return check


@dataclass
class Prepared:
    df: DataFrame
    order: str  # query, file, columns or none
    sql: str


def sortable(t: T.DataType) -> bool:
    return isinstance(t, T.AtomicType) and not isinstance(t, (T.YearMonthIntervalType, T.VariantType))


def prepare(spark: SparkSession, sql: str, rewrite: bool = True) -> Prepared:
    """A checked query and the order of its rows: the query's own, that of the file, or by all sortable columns."""
    text = dialect.rewrite(sql.strip().rstrip(";")) if rewrite else sql
    gate(spark, text)
    if rewrite and "/" in text:
        text = dialect.float_divisions(dialect.divisions(text, _whole(spark)), _floats(spark))
    try:
        df = spark.sql(text)
    except (AnalysisException, ParseException) as x:
        raise Refused(sentence(x)) from None
    plan = df._jdf.queryExecution().analyzed()
    node = plan
    while _kind(node) in ("Project", "SubqueryAlias", "GlobalLimit", "LocalLimit", "Offset", "WithCTE", "Filter"):
        kids = _list(node.children())
        if _kind(node) == "Filter" or not kids:
            break
        node = kids[0]
    if _kind(node) == "Sort":
        return Prepared(df, "query", text)
    kinds = {_kind(x) for x, is_plan in _walk(plan) if is_plan}
    if kinds <= _FILE_ORDER and df._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1:
        return Prepared(df, "file", text)
    by = [F.col(f"`{f.name.replace('`', '``')}`").asc_nulls_last() for f in df.schema.fields if sortable(f.dataType)] if len(set(df.columns)) == len(df.columns) else []
    return Prepared(df.orderBy(*by), "columns", text) if by else Prepared(df, "none", text)
