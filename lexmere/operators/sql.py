"""SQL by text: queries and writes, read by Spark's own parser and held to the tables that they may touch.

Nothing of the text runs before the parsed tree is checked: only kinds of nodes, relations and functions
that are listed here pass. Writes become rows to add and keys to take away, which a store commits at once.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from py4j.java_gateway import is_instance_of
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Nodes of a query's tree.
_ALLOWED = {
    "Project", "Filter", "Join", "LateralJoin", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Deduplicate", "Union", "Intersect", "Except",
    "SubqueryAlias", "UnresolvedRelation", "UnresolvedInlineTable", "UnresolvedWith", "UnresolvedHaving", "OneRowRelation", "LocalRelation", "Generate", "Window", "WithWindowDefinition",
    "Pivot", "Unpivot", "Expand", "UnresolvedTableValuedFunction", "Range", "Values", "UnresolvedSubqueryColumnAliases", "WithCTE", "CTERelationDef", "CTERelationRef", "Sample", "UnresolvedOrdinal",
    "UnionLoop", "Hint", "UnresolvedHint", "UnresolvedTVFAliases", "GroupingSets", "BaseGroupingSets", "AsOfJoin", "Tail", "ParameterizedQuery", "NameParameterizedQuery", "PosParameterizedQuery",
}
_SUBQUERIES = {"ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"}
#: Groups of built-in functions, by their documentation, that work on their arguments alone.
_GROUPS = {
    "agg_funcs", "array_funcs", "bitwise_funcs", "collection_funcs", "conditional_funcs", "conversion_funcs", "csv_funcs", "datetime_funcs", "generator_funcs", "hash_funcs", "json_funcs",
    "lambda_funcs", "map_funcs", "math_funcs", "predicate_funcs", "string_funcs", "struct_funcs", "url_funcs", "variant_funcs", "window_funcs",
}
#: Of the other functions, those that may run.
_OTHERS = {"typeof", "uuid", "raise_error", "assert_true", "hll_sketch_estimate", "hll_union", "approx_top_k_estimate"}
#: Table functions that make rows from their arguments alone.
_GENERATORS = {"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple", "variant_explode", "variant_explode_outer"}


def _each(seq: Any) -> list[Any]:
    return [seq.apply(i) for i in range(seq.size())]


def _parts(seq: Any) -> list[str]:
    return [str(x).lower() for x in _each(seq)]


def parse(spark: SparkSession, text: str, args: Mapping[str, Any] | Sequence[Any] | None = None) -> Any:
    """The parsed tree of one statement, values put in for its markers (:name, or ? in order); ValueError if it is none."""
    parser, jvm = spark._jsparkSession.sessionState().sqlParser(), spark._jvm

    def literal(v: Any) -> Any:
        if isinstance(v, (list, tuple, dict, Column)):
            raise ValueError("markers stand for single values")
        return spark.range(1).select(F.lit(v).alias("v"))._jdf.queryExecution().analyzed().expressions().head().child()

    try:
        if not args:
            return parser.parsePlan(text)
        if isinstance(args, Mapping):
            context = jvm.org.apache.spark.sql.catalyst.parser.NamedParameterContext(jvm.PythonUtils.toScalaMap({k: literal(v) for k, v in args.items()}))
        else:
            context = jvm.org.apache.spark.sql.catalyst.parser.PositionalParameterContext(jvm.PythonUtils.toSeq([literal(v) for v in args]))
        return parser.parsePlanWithParameters(text, context)
    except Exception as e:
        raise ValueError(f"not a statement: {str(e).strip().splitlines()[0]}") from None


class Guard:
    """Checks trees: only listed nodes, the named tables (single-part names), common tables where they are in scope, and listed functions."""

    def __init__(self, spark: SparkSession, tables: Iterable[str], functions: Iterable[str] = ()) -> None:
        self.gateway = spark.sparkContext._gateway
        self.tables = frozenset(t.lower() for t in tables)
        self.functions = {f.lower() for f in functions}
        catalyst = spark._jvm.org.apache.spark.sql.catalyst
        self.registry, self.name_of = catalyst.analysis.FunctionRegistry.builtin(), catalyst.FunctionIdentifier

    def _function(self, parts: list[str]) -> None:
        name = parts[-1]
        if len(parts) == 1 and name in self.functions | _OTHERS:
            return
        about = self.registry.lookupFunction(self.name_of(name)) if len(parts) == 1 else None
        if about is None or about.isEmpty() or about.get().getGroup() not in _GROUPS:
            raise ValueError(f"not allowed: {'.'.join(parts)}")

    def check(self, tree: Any) -> None:
        """Raises ValueError at the first node that may not be."""
        todo = [(tree, self.tables)]
        while todo:
            node, scope = todo.pop()
            kind = node.getClass().getSimpleName()
            if "UnresolvedIdentifier" in kind:
                raise ValueError("names must be plain, not computed")
            if is_instance_of(self.gateway, node, "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan"):
                if node.nodeName() not in _ALLOWED:
                    raise ValueError(f"only queries are allowed, not {node.nodeName()}")
                if kind == "UnresolvedRelation":
                    parts = _parts(node.multipartIdentifier())
                    if len(parts) != 1 or parts[0] not in scope:
                        raise ValueError(f"no such table: {'.'.join(parts)}")
                elif kind == "UnresolvedTableValuedFunction":
                    self._table_function(_parts(node.name()))
                elif kind == "UnresolvedWith":
                    for entry in _each(node.cteRelations()):
                        name, common = entry._1().lower(), entry._2()
                        if "." in name:
                            raise ValueError(f"not a name for a common table: {name}")
                        # a common table sees those before it, and itself where recursion is allowed
                        todo.append((common, scope | {name} if node.allowRecursion() else scope))
                        scope = scope | {name}
                todo += [(x, scope) for x in _each(node.expressions())]
            elif kind == "UnresolvedFunction":
                self._function(_parts(node.nameParts()))
            elif kind == "UnresolvedGenerator":
                self._table_function([node.name().funcName().lower()])
            elif kind in _SUBQUERIES:
                todo.append((node.plan(), scope))
            todo += [(x, scope) for x in _each(node.children())]

    def _table_function(self, parts: list[str]) -> None:
        if len(parts) != 1 or parts[0] not in _GENERATORS | self.functions:
            raise ValueError(f"no such table function: {'.'.join(parts)}")


def check_query(spark: SparkSession, query: str, tables: Iterable[str], functions: Iterable[str] = ()) -> None:
    """Raises ValueError unless Spark's parser reads the text as one query over the named tables.

    Commands, writes, other relations (files by path too), computed names and functions that are not listed are
    refused, in subqueries and common tables as well; literals and comments don't matter. ``functions``: registered ones that may run.
    """
    Guard(spark, tables, functions).check(parse(spark, query))


def sql_query(spark: SparkSession, query: str, tables: dict[str, DataFrame], limit: int = 100, cap: int = 5000, args: dict[str, Any] | list[Any] | None = None) -> dict[str, Any]:
    """columns, rows (at most min(limit, cap)) and row_count (of the whole result); errors come back as {"error": ...}.

    args are values for the markers of the query (:name, or ? in order); they are never spliced into its text.
    """
    try:
        check_query(spark, query, tables)
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        result = spark.sql(query, args=args)
        rows = [r.asDict(recursive=True) for r in result.limit(min(limit, cap)).collect()]
        return {"columns": result.columns, "rows": rows, "row_count": result.count() if len(rows) == min(limit, cap) else len(rows)}
    except Exception as e:  # noqa: BLE001  callers get errors as data
        return {"error": str(e).splitlines()[0]}


@dataclass(frozen=True)
class Write:
    """What a statement does to one table: rows to add, keys of rows to take away first."""

    table: str
    rows: DataFrame | None
    gone: DataFrame | None


class Writer:
    """Compiles INSERT, UPDATE, DELETE and MERGE over ``tables`` (a tenant's rows) into Writes.

    keys: the natural key of each table that may be written; fixed: columns with one value, which statements may name but
    not change; defaults: for a table, expressions for columns that an insert leaves null; optional: key columns that may be null.
    """

    def __init__(
        self, spark: SparkSession, tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]], fixed: Mapping[str, Any],
        defaults: Mapping[str, Mapping[str, Column]] | None = None, optional: Mapping[str, Sequence[str]] | None = None,
    ) -> None:
        self.spark, self.tables, self.keys, self.fixed = spark, tables, keys, fixed
        self.defaults, self.optional = defaults or {}, optional or {}
        self.guard = Guard(spark, tables)
        classic = spark._jvm.org.apache.spark.sql.classic
        self._utils, self._dataset = classic.ExpressionUtils, classic.Dataset

    def _column(self, expression: Any) -> Column:
        self.guard.check(expression)
        return Column(self._utils.column(expression))

    def _frame(self, plan: Any) -> DataFrame:
        self.guard.check(plan)
        return DataFrame(self._dataset.ofRows(self.spark._jsparkSession, plan), self.spark)

    def _target(self, plan: Any) -> tuple[str, str]:
        """Name and alias of a statement's table."""
        alias = plan.alias() if plan.nodeName() == "SubqueryAlias" else None
        relation = plan.child() if alias else plan
        parts = _parts(relation.multipartIdentifier()) if relation.nodeName() == "UnresolvedRelation" else []
        if len(parts) != 1 or parts[0] not in self.keys:
            raise ValueError(f"not a table to write: {'.'.join(parts)}")
        return parts[0], alias or parts[0]

    def _assigned(self, assignments: Any, table: str) -> dict[str, Column]:
        out = {}
        for a in _each(assignments):
            name = _parts(a.key().nameParts())[-1]
            if name not in self.tables[table].columns or name in self.fixed or name in out:
                raise ValueError(f"can't be set: {name}")
            out[name] = self._column(a.value())
        return out

    def _cast(self, rows: DataFrame, table: str, given: Mapping[str, Column]) -> DataFrame:
        """A row of the table for each of rows: what is given, the fixed values, defaults, else null."""
        kinds = dict(self.tables[table].dtypes)
        columns = {c: given[c].cast(k) if c in given else F.lit(self.fixed[c]).cast(k) if c in self.fixed else F.lit(None).cast(k) for c, k in kinds.items()}
        made = rows.select(*[v.alias(c) for c, v in columns.items()])
        for c, default in self.defaults.get(table, {}).items():
            made = made.withColumn(c, F.coalesce(F.col(c), default.cast(kinds[c])))
        return made

    def _sound(self, rows: DataFrame, table: str, gone: DataFrame | None) -> DataFrame:
        """Rows written down, after a check that their keys are whole and no other row has them."""
        from lexmere.operators.relational import null_safe
        from lexmere.sources.staging import staged

        keys = list(self.keys[table])
        rows = staged(rows, f"write-{table}")
        for c, v in self.fixed.items():
            if c in rows.columns and not rows.filter(~F.col(c).eqNullSafe(F.lit(v))).isEmpty():
                raise ValueError(f"{c} must be {v}")
        needed = [c for c in {*keys, *self.defaults.get(table, {})} if c not in self.optional.get(table, ())]
        for c in needed:
            if not rows.filter(F.col(c).isNull()).isEmpty():
                raise ValueError(f"{c} must not be null")
        if not rows.groupBy(*keys).count().filter("count > 1").isEmpty():
            raise ValueError(f"rows with the same {', '.join(keys)}")
        others = self.tables[table] if gone is None else null_safe(self.tables[table], gone, keys, "left_anti")
        if not null_safe(others, rows, keys, "left_semi").isEmpty():
            raise ValueError(f"there is a row with this {', '.join(keys)}")
        return rows

    def compile(self, statement: str, args: Mapping[str, Any] | Sequence[Any] | None = None) -> tuple[Write, int]:
        """The statement's changes and the number of rows that it adds, changes or takes away; ValueError for what may not be."""
        plan = parse(self.spark, statement, args)
        make = {"InsertIntoStatement": self._insert, "UpdateTable": self._update, "DeleteFromTable": self._delete, "MergeIntoTable": self._merge}.get(plan.nodeName())
        if make is None:
            raise ValueError(f"only INSERT, UPDATE, DELETE and MERGE write, not {plan.nodeName()}")
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)
        return make(plan)

    def _insert(self, plan: Any) -> tuple[Write, int]:
        table, _ = self._target(plan.table())
        if plan.overwrite() or plan.ifPartitionNotExists() or not plan.partitionSpec().isEmpty():
            raise ValueError("only plain inserts are allowed")
        rows = self._frame(plan.query())
        names = _parts(plan.userSpecifiedCols()) or (rows.columns if plan.byName() else self.tables[table].columns)
        if len(names) != len(rows.columns) or len(set(names)) < len(names) or set(names) - set(self.tables[table].columns):
            raise ValueError("the columns don't fit the table")
        rows = rows.toDF(*[f"__{i}" for i in range(len(names))])
        made = self._sound(self._cast(rows, table, {n: F.col(f"__{i}") for i, n in enumerate(names)}), table, None)
        return Write(table, made, None), made.count()

    def _some(self, condition: Any, what: str) -> Column:
        if condition is None or condition.toString() == "true":
            raise ValueError(f"{what} without WHERE is refused")
        return self._column(condition)

    def _update(self, plan: Any) -> tuple[Write, int]:
        table, alias = self._target(plan.table())
        condition = plan.condition().get() if plan.condition().isDefined() else None
        met = self.tables[table].alias(alias).filter(self._some(condition, "UPDATE"))
        return self._changed(table, alias, [(met, self._assigned(plan.assignments(), table))], [], [])

    def _delete(self, plan: Any) -> tuple[Write, int]:
        table, alias = self._target(plan.table())
        met = self.tables[table].alias(alias).filter(self._some(plan.condition(), "DELETE"))
        return self._changed(table, alias, [], [met], [])

    def _changed(self, table: str, alias: str, updates: list[tuple[DataFrame, dict[str, Column]]], deletes: list[DataFrame], inserts: list[tuple[DataFrame, dict[str, Column]]]) -> tuple[Write, int]:
        """Rows that are met change or go, others come; each input is evaluated once, into a written table."""
        from lexmere.sources.staging import staged

        whole, keys = self.tables[table].columns, list(self.keys[table])
        kinds = dict(self.tables[table].dtypes)
        old = [F.col(f"{alias}.{c}").alias(f"__old_{c}") for c in keys]
        parts, empty = [], self.tables[table].limit(0)
        for met, given in updates:
            parts.append(met.select(*old, *[(given[c].cast(kinds[c]) if c in given else F.col(f"{alias}.{c}")).alias(c) for c in whole], F.lit(True).alias("__kept")))
        for met in deletes:
            parts.append(met.select(*old, *[F.col(f"{alias}.{c}").alias(c) for c in whole], F.lit(False).alias("__kept")))
        gone, rows, n = None, None, 0
        if parts:
            met = parts[0]
            for p in parts[1:]:
                met = met.unionByName(p)
            met = staged(met, f"met-{table}")
            n = met.count()
            gone = met.select(*[F.col(f"__old_{c}").alias(c) for c in keys])
            if gone.distinct().count() < n:
                raise ValueError("a row is met more than once")
            rows = met.filter("__kept").select(*whole)
        for source, given in inserts:
            new = staged(self._cast(source, table, given), f"new-{table}")
            n += new.count()
            rows = new if rows is None else rows.unionByName(new)
        rows = self._sound(empty if rows is None else rows, table, gone)
        return Write(table, rows, gone), n

    def _merge(self, plan: Any) -> tuple[Write, int]:
        table, alias = self._target(plan.targetTable())
        if not plan.notMatchedBySourceActions().isEmpty():
            raise ValueError("WHEN NOT MATCHED BY SOURCE is not supported")
        target, source, on = self.tables[table].alias(alias), self._frame(plan.sourceTable()), self._column(plan.mergeCondition())
        own = set(self.tables[table].columns)

        def split(rows: DataFrame, actions: list[Any]) -> list[tuple[Any, DataFrame]]:
            """Each action with the rows that are its: those of no action before."""
            which = F.lit(None).cast("int")
            for i, a in reversed(list(enumerate(actions))):
                which = F.when(self._column(a.condition().get()), i).otherwise(which) if a.condition().isDefined() else F.lit(i)
            numbered = rows.withColumn("__action", which)
            return [(a, numbered.filter(F.col("__action") == i)) for i, a in enumerate(actions)]

        def values(action: Any) -> dict[str, Column]:
            if action.getClass().getSimpleName().endswith("StarAction"):
                return {c: source[c] for c in source.columns if c in own and c not in self.fixed}
            return self._assigned(action.assignments(), table)

        updates, deletes, inserts = [], [], []
        for action, rows in split(target.join(source, on), _each(plan.matchedActions())):
            if action.getClass().getSimpleName() == "DeleteAction":
                deletes.append(rows)
            else:
                updates.append((rows, values(action)))
        for action, rows in split(source.join(target, on, "left_anti"), _each(plan.notMatchedActions())):
            inserts.append((rows, values(action)))
        return self._changed(table, alias, updates, deletes, inserts)
