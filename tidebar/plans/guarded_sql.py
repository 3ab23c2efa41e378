"""Read-only SQL over named tables, allowed by the analysed plan; structured reads of the journal's resources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST = 500

#: What an analysed plan may consist of, by Spark's class names; nothing else runs. Plans:
PLANS = frozenset(
    "Aggregate CTERelationDef CTERelationRef Distinct Except Expand Filter GlobalLimit Intersect Join LocalLimit LocalRelation Offset OneRowRelation Pivot Project Sort SubqueryAlias Tail Union Unpivot Window WithCTE".split()
)
#: Expressions: names and literals, operators, and functions that only look at their arguments.
EXPRESSIONS = frozenset(
    """
    Alias AttributeReference OuterReference Literal Cast SortOrder AggregateExpression WindowExpression WindowSpecDefinition SpecifiedWindowFrame UnboundedPreceding UnboundedFollowing CurrentRow UnspecifiedFrame NamedArgumentExpression
    With CommonExpressionDef CommonExpressionRef ScalarSubquery ListQuery InSubquery Exists LambdaFunction NamedLambdaVariable GroupingID Grouping
    Add Subtract Multiply Divide IntegralDivide Remainder Pmod UnaryMinus UnaryPositive Abs And Or Not EqualTo EqualNullSafe LessThan LessThanOrEqual GreaterThan GreaterThanOrEqual Between In InSet IsNull IsNotNull IsNaN
    CaseWhen If Coalesce Nvl Nvl2 IfNull NullIf Greatest Least BitwiseAnd BitwiseOr BitwiseXor BitwiseNot ShiftLeft ShiftRight TryAdd TrySubtract TryMultiply TryDivide TryCast
    Round BRound Floor Ceil FloorExpressionBuilder CeilExpressionBuilder RoundFloor RoundCeil Sqrt Cbrt Pow Exp Log Log10 Log2 Log1p Logarithm Signum Sin Cos Tan Asin Acos Atan Atan2 ToDegrees ToRadians
    Upper Lower InitCap Length OctetLength Substring SubstringIndex StringInstr StringLocate StringTrim StringTrimLeft StringTrimRight StringTrimBoth Concat ConcatWs Elt StringReplace StringTranslate Reverse StringLPad StringRPad Left Right Like ILike RLike LikeAll LikeAny StartsWith EndsWith Contains StringSplit SplitPart RegExpReplace RegExpExtract Levenshtein Ascii Chr
    Year Quarter Month DayOfMonth DayOfWeek WeekDay DayOfYear WeekOfYear Hour Minute Second DateAdd DateSub DateDiff AddMonths MonthsBetween LastDay NextDay TruncDate TruncTimestamp DateFormatClass ToUnixTimestamp UnixTimestamp FromUnixTime MakeDate ParseToDate ParseToTimestamp Extract TimestampDiff TimestampAdd UnixMillis UnixSeconds MillisToTimestamp SecondsToTimestamp
    Count Sum Average Min Max First Last StddevPop StddevSamp VariancePop VarianceSamp Corr CovPopulation CovSample Percentile ApproximatePercentile Median Mode CountIf BoolAnd BoolOr MaxBy MinBy Skewness Kurtosis HyperLogLogPlusPlus CollectList CollectSet
    RowNumber Rank DenseRank PercentRank CumeDist NTile Lag Lead NthValue
    CreateArray CreateNamedStruct GetStructField GetArrayItem ElementAt Size ArrayContains SortArray ArraySort ArrayMax ArrayMin Slice GetMapValue MapKeys MapValues ArrayTransform ArrayFilter ArrayAggregate ArrayExists ArrayForAll
    """.split()
)


def _walk(plan, views: set[str]) -> str | None:
    """What of an analysed plan isn't allowed, or None. Everything below one of our views is."""
    kind = plan.getClass().getSimpleName()
    if kind == "View":
        return None if plan.desc().identifier().table() in views else "a relation that isn't given"
    if kind not in PLANS:
        return f"{kind} in the plan"
    seq = lambda s: [s.apply(i) for i in range(s.size())]

    def expression(e) -> str | None:
        name = e.getClass().getSimpleName()
        if name.rstrip("$") not in EXPRESSIONS:
            return f"the function or expression {e.prettyName()}"
        return next((x for child in seq(e.children()) if (x := expression(child))), None)

    for e in seq(plan.expressions()):
        if found := expression(e):
            return found
    return next((x for child in [*seq(plan.children()), *seq(plan.subqueries())] if (x := _walk(child, views))), None)


def guarded(spark: SparkSession, query: str, tables: dict[str, DataFrame], limit: int = MOST) -> DataFrame:
    """At most `limit` (and MOST) rows of a single SELECT over the given tables; ValueError for anything else.

    The query is analysed, not searched for words: each relation that its names resolve to, in their scopes, must be one of the tables, and each plan and expression
    one of those listed here. The tables are there under their names for this query only; the session's own views are neither read nor changed.
    """
    text = query.strip()
    parser = spark._jsparkSession.sessionState().sqlParser()
    command = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.Command")
    try:
        if command.isInstance(parser.parsePlan(text)):
            raise ValueError("only a single SELECT is allowed")
        names = {name: f"guard_{uuid.uuid4().hex}" for name in tables}
        for name, df in tables.items():
            df.createOrReplaceTempView(names[name])
        try:
            given = ", ".join(f"`{name}` AS (SELECT * FROM {view})" for name, view in names.items())
            # The line break ends a comment that the query may end with.
            out = spark.sql(f"WITH {given} SELECT * FROM (\n{text}\n)" if given else text)
        finally:
            for view in names.values():
                spark.catalog.dropTempView(view)
    except ValueError:
        raise
    except Exception as e:
        raise ValueError(f"not a query over these tables: {str(e).splitlines()[0]}") from None
    if problem := _walk(out._jdf.queryExecution().analyzed(), set(names.values())):
        raise ValueError(f"not allowed: {problem}")
    return out.limit(max(1, min(MOST, limit)))


def tried(spark: SparkSession, query: str, tables: dict[str, DataFrame], limit: int = MOST) -> dict:
    """guarded()'s rows, or what was wrong, as a record: ok, count, rows, error."""
    try:
        rows = [r.asDict(recursive=True) for r in guarded(spark, query, tables, limit).collect()]
    except Exception as e:
        return {"ok": False, "count": 0, "rows": [], "read_only": True, "error_code": type(e).__name__, "error": str(e), "retryable": False}
    return {"ok": True, "count": len(rows), "rows": rows, "read_only": True}


#: Resources by the names they may be asked for.
RESOURCES = {"positions": "positions", "trades": "trades", "signals": "signals", "decisions": "decisions", "decision_logs": "decisions", "wallet": "wallet"}


def resource(tables: dict[str, DataFrame], name: str = "trades", symbol: str | None = None, strategy: str | None = None, action: str | None = None, limit: int = 100, order: tuple[str, ...] = ("timestamp",)) -> DataFrame:
    """The last `limit` (1 to MOST) rows, by order, of a resource, and in `matched` how many there are. Filters are case-insensitive; one on a column that the resource lacks matches nothing,
    as an unknown value does. ValueError for an unknown resource."""
    found = tables.get(RESOURCES.get(str(name).lower(), ""))
    if found is None:
        raise ValueError(f"no such resource: {name}; there are {sorted(RESOURCES)}")
    for column, value in (("symbol", symbol), ("strategy", strategy), ("action", action)):
        if value:
            found = found.where(F.upper(F.col(column).cast("string")) == str(value).upper() if column in found.columns else F.lit(False))
    keys = [F.col(c).desc() for c in order if c in found.columns]
    last = (found.orderBy(*keys) if keys else found).limit(max(1, min(MOST, int(limit))))
    return last.crossJoin(F.broadcast(found.agg(F.count("*").alias("matched"))))


def position_differences(stored: DataFrame, live: DataFrame, key: str = "symbol") -> DataFrame:
    """(symbol, kind) of positions that only the store or only the live book has."""
    a, b = stored.select(key).distinct().withColumn("_stored", F.lit(True)), live.select(key).distinct().withColumn("_live", F.lit(True))
    return a.join(b, key, "full_outer").where("_stored is null or _live is null").select(key, F.when(F.col("_stored").isNull(), "missing_in_db").otherwise("missing_in_memory").alias("kind"))
