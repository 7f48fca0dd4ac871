"""The query builder: knn(base).where(p).order_by_l2(vector, q).limit(k)."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import checked_query
from ..operators.exact import filtered_top_k
from ..operators.ivf import IvfIndex, adaptive_probes, ivf_top_k
from ..operators.quantized import Sq8, quantized_top_k
from .router import Router, Run, Shape
from .settings import STRATEGIES, Settings


@dataclass(frozen=True)
class Knn:
    """A filtered nearest-neighbour query; each method returns a changed copy, nothing runs."""

    base: DataFrame
    predicate: Column | str | None = None
    vector: str | None = None
    query: tuple[float, ...] | None = None
    k: int | None = None
    skip: int = 0
    id: str = "vec_id"
    forced: str = "auto"
    router: Router = field(default_factory=Router)
    coded: tuple[DataFrame, Sq8] | None = None
    ivf: IvfIndex | None = None
    probes: int | None = None
    selectivity: float | None = None
    name: str = "base"
    live: DataFrame | None = None
    columns: tuple[str, ...] | None = None
    rows: int | None = None
    sample: DataFrame | None = None

    def where(self, predicate: Column | str) -> Knn:
        """Adds a conjunct; the whole predicate holds before ranking."""
        column = F.expr(predicate) if isinstance(predicate, str) else predicate
        if self.predicate is None:
            return replace(self, predicate=column)
        old = F.expr(self.predicate) if isinstance(self.predicate, str) else self.predicate
        return replace(self, predicate=old & column)

    def order_by_l2(self, vector: str, query: Sequence[float] | DataFrame, descending: bool = False) -> Knn:
        """The one sort key: ascending distance to a literal vector or to a one-row DataFrame's."""
        if descending:
            raise ValueError("only ascending distance is a search")
        if self.vector is not None:
            raise ValueError("there is one distance key")
        kind = self.base.schema[vector].dataType
        if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, (T.FloatType, T.DoubleType)):
            raise ValueError(f"{vector} is no vector column")
        if isinstance(query, DataFrame):
            rows = query.limit(2).collect()
            if len(rows) != 1:
                raise ValueError("the query DataFrame has one row")
            query = rows[0][0]
        return replace(self, vector=vector, query=tuple(checked_query(query)))

    def limit(self, k: int) -> Knn:
        if k < 1:
            raise ValueError("k is at least 1")
        return replace(self, k=k)

    def offset(self, n: int) -> Knn:
        if n < 0:
            raise ValueError("offset is at least 0")
        return replace(self, skip=n)

    def strategy(self, name: str, probes: int | None = None) -> Knn:
        if name not in STRATEGIES:
            raise ValueError(f"strategy: one of {', '.join(STRATEGIES)}")
        return replace(self, forced=name, probes=probes)

    def using(self, router: Router | None = None, coded: tuple[DataFrame, Sq8] | None = None, ivf: IvfIndex | None = None, live: DataFrame | None = None, name: str | None = None,
              rows: int | None = None, sample: DataFrame | None = None) -> Knn:
        """What a snapshot offers: coded rows, an inverted index, its number of rows and a sample of
        them; and the live table, whose ids a result must still have."""
        given = {"router": router, "coded": coded, "ivf": ivf, "live": live, "name": name, "rows": rows, "sample": sample}
        return replace(self, **{n: v for n, v in given.items() if v is not None})

    def returning(self, *columns: str) -> Knn:
        """The columns of the result; all of the base's by default."""
        return replace(self, columns=columns)

    def estimated(self, selectivity: float) -> Knn:
        """The predicate's selectivity, for routing, where it is known better than from the sample."""
        return replace(self, selectivity=selectivity)

    def _checked(self) -> None:
        if self.vector is None or self.query is None:
            raise ValueError("order_by_l2 is missing")
        if self.k is None:
            raise ValueError("limit is missing")

    def available(self) -> tuple[str, ...]:
        both = self.coded and self.ivf and "codes" in self.ivf.table.columns
        return ("exact", *["sq8"] * bool(self.coded), *["ivf"] * bool(self.ivf), *["ivf_sq8"] * bool(both))

    def _estimate(self) -> float:
        """Share of rows that match: as stated, else as in the sample (half a row added), else 1."""
        if self.selectivity is not None:
            return self.selectivity
        if self.predicate is None or self.sample is None:
            return 1.0
        n, matching = self.sample.agg(F.count(F.lit(1)), F.count_if(F.coalesce(F.expr(self.predicate) if isinstance(self.predicate, str) else self.predicate, F.lit(False)))).first()
        return min(1.0, (matching + 0.5) / (n + 1))

    def shape(self) -> Shape:
        """What the router prices; the base is counted only where its size isn't known."""
        estimate = self._estimate()
        lists = self.ivf.lists if self.ivf else 0
        probes = self.probes or (adaptive_probes(self.k + self.skip, self.router.settings.ef_search, lists, estimate) if lists else 0)
        return Shape(self.rows if self.rows is not None else self.base.count(), len(self.query), self.k + self.skip, estimate, 1, lists, probes)

    def planned(self) -> str:
        """The strategy that runs: forced if it is there, else the cheapest; exact is the fallback, as explain_info tells."""
        self._checked()
        if self.forced != "auto":
            return self.forced if self.forced in self.available() else "exact"
        if len(self.available()) == 1:
            return "exact"
        return self.router.choose(self.name, self.available(), self.shape())

    def _run(self, strategy: str) -> DataFrame:
        n = self.k + self.skip
        if strategy == "sq8":
            rows, sq8 = self.coded
            found = quantized_top_k(self._alive(rows), sq8, self.query, n, self.vector, self.id, self.predicate)
        elif strategy in ("ivf", "ivf_sq8"):
            budget = self.router.settings.ef_search
            probes = self.probes or adaptive_probes(n, budget, self.ivf.lists, self._estimate())
            index = replace(self.ivf, table=self._alive(self.ivf.table))

            def by_codes(rows, query, k, vector, id, where):
                return quantized_top_k(rows, self.coded[1], query, k, vector, id, where, candidates=budget)

            found, _ = ivf_top_k(index, self.query, n, probes, self.predicate, by_codes if strategy == "ivf_sq8" else None)
        else:
            return filtered_top_k(self._alive(self.base), self.query, self.k, self.vector, self.id, self.predicate, self.skip)
        return found.offset(self.skip) if self.skip else found

    def _alive(self, rows: DataFrame) -> DataFrame:
        return rows if self.live is None else rows.join(self.live.select(self.id), self.id, "left_semi")

    def result(self) -> DataFrame:
        """The result's rows in order, with d = distance."""
        self._checked()
        found = self._run(self.planned())
        return found.select(*(self.columns or self.base.columns), F.sqrt("d2").alias("d")).orderBy("d", self.id)

    def measured(self) -> tuple[list, float]:
        """Runs, returns rows and milliseconds, and feeds the router."""
        planned = ran = self.planned()
        shape, began = self.shape(), time.perf_counter()
        try:
            rows = self.result().collect()  # k rows
        except Exception:
            if planned == "exact" or self.forced != "auto":
                raise
            ran, began = "exact", time.perf_counter()  # an index that can't be read doesn't fail a search
            rows = self.strategy("exact").result().collect()
        ms = (time.perf_counter() - began) * 1000
        self.router.feedback.record(self.name, planned, ran, Run(shape.selectivity, self.router.predicted(ran, shape), ms, 1.0))
        return rows, ms

    def explain_info(self) -> dict:
        """Strategy, why it isn't the one asked for, the filters that reach the scan, the estimate
        and prices of what was available."""
        strategy = self.planned()
        plan = self._run(strategy)._jdf.queryExecution().executedPlan().toString()
        pushed = sorted({line[line.index("PushedFilters:") + 14 :].split("], ")[0].strip(" [") for line in plan.splitlines() if "PushedFilters:" in line})
        shape = self.shape()
        prices = {s: self.router.price(self.name, s, shape) for s in self.available()}
        fallback = f"{self.forced} is not available here" if self.forced not in ("auto", strategy) else None
        return {
            "strategy": strategy, "fallback": fallback, "pushed_filters": pushed, "rows": shape.rows, "selectivity": shape.selectivity,
            "prices_ms": prices, "top_k_in_scan_stage": "TakeOrderedAndProject" in plan,
        }

    def counters(self) -> dict:
        """Runs one aggregate over the base: rows, rows that match, and rows that have left the live table."""
        matches = self.base if self.predicate is None else self.base.where(self.predicate)
        alive = self._alive(matches).count()
        n = matches.count() if self.live is not None else alive
        return {"rows": self.rows if self.rows is not None else self.base.count(), "matches": n, "live_skips": n - alive}


def knn(base: DataFrame, id: str = "vec_id") -> Knn:
    """Starts a query over base; id breaks ties and identifies rows."""
    if id not in base.columns:
        raise ValueError(f"no column {id}")
    return Knn(base, id=id, router=Router(Settings.of(base.sparkSession)))
