"""Reads that are held to a list of tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

#: Leaves of a plan that read nothing.
EMPTY_LEAVES = ("OneRowRelation", "LocalRelation", "Range", "CTERelationRef")


class ReadRefused(PermissionError):
    """A statement that reads what isn't on the list, or that does more than read."""


class Allowed:
    """A session of its own that knows some tables only; statements are analysed, and refused before anything runs.

    tables: name -> Parquet path. Statements may use the names in ``allowed`` and nothing else: no other
    table, view or path, no function that is a table, and no command.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, str], allowed: Iterable[str]):
        self.names = frozenset(n.lower() for n in allowed)
        missing = self.names - {t.lower() for t in tables}
        if missing:
            raise ValueError(f"no such tables: {sorted(missing)}")
        self.spark = spark.newSession()
        self.spark.conf.set("spark.sql.runSQLOnFiles", "false")
        for name, path in tables.items():
            if name.lower() in self.names:
                self.spark.read.parquet(path).createOrReplaceTempView(name)

    def table(self, name: str) -> DataFrame:
        if name.lower() not in self.names:
            raise ReadRefused(f"{name} may not be read")
        return self.spark.table(name)

    def sql(self, statement: str) -> DataFrame:
        """The statement's rows; ReadRefused if it reads or does anything else."""
        jvm = self.spark._jvm
        state = self.spark._jsparkSession.sessionState()
        skip = getattr(getattr(jvm.org.apache.spark.sql.execution, "CommandExecutionMode$"), "MODULE$").SKIP()
        run = state.executePlan(state.sqlParser().parsePlan(statement), skip)
        try:
            plan = run.analyzed()
        except Exception as e:
            raise ReadRefused(f"not a statement over {sorted(self.names)}") from e
        self._check(plan, jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.Command"))
        return self.spark.sql(statement)

    def _check(self, plan, command) -> None:
        if command.isInstance(plan):
            raise ReadRefused(f"{plan.nodeName()} is more than a read")
        kind = plan.getClass().getSimpleName()
        if kind == "View" and plan.isTempView():
            name = plan.desc().identifier().table().lower()
            if name not in self.names:
                raise ReadRefused(f"{name} may not be read")
            return
        below = [*_each(plan.children()), *_each(plan.subqueries())]
        if not below and kind not in EMPTY_LEAVES:
            raise ReadRefused(f"{plan.nodeName()} may not be read")
        for p in below:
            self._check(p, command)


def _each(seq) -> list:
    return [seq.apply(k) for k in range(seq.size())]
