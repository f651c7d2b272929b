"""References to records that do not exist (problem 6).

A fixpoint cascade over a graph of foreign keys: rows whose reference does not resolve are direct orphans; rows
that refer to an orphan inherit its state, found by semi-joins that go down the graph, which may refer to itself,
until a round finds nothing new.

A reference may be bound to a time: it then resolves only in a record that is valid at the referring row's time.
Defined results: null references refer to nothing and are no orphans; records with a null key answer nothing;
null starts and ends of validity mean always and still; with a null time only ``missing`` can be told.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.runtime import materialize

_FIRST, _LAST = "timestamp_ntz'0001-01-01 00:00:00'", "timestamp_ntz'9999-12-31 23:59:59'"


@dataclass
class Entity:
    """A table in the graph: its rows, the key others refer to, and the column that dates a row, or None."""

    rows: DataFrame
    key: str | None = None
    dated: str | None = None
    valid_from: str | None = None
    valid_to: str | None = None


@dataclass
class Relation:
    """Rows of ``child`` refer by ``column`` to the key of ``parent``; at the child's time if the parent's rows are valid for a time."""

    child: str
    column: str
    parent: str


def spans(records: DataFrame, key: str, start: str | None, end: str | None) -> DataFrame:
    """``(k, spans)``: each key's times of validity. Repeated rows are combined before the shuffle, so a key
    collects one span for each different start."""
    a = F.coalesce(F.col(start).cast("timestamp_ntz"), F.expr(_FIRST)) if start else F.expr(_FIRST)
    b = F.coalesce(F.col(end).cast("timestamp_ntz"), F.expr(_LAST)) if end else F.expr(_LAST)
    once = records.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), a.alias("a"), b.alias("b")).groupBy("k", "a").agg(F.max("b").alias("b"))
    return once.groupBy("k").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


class Cascade:
    """Direct and inherited orphans of a graph of foreign keys."""

    def __init__(self, entities: dict[str, Entity], relations: list[Relation], most_rounds: int = 1000):
        self.entities, self.relations = entities, relations
        self.direct = [self._unresolved(r) for r in relations]
        self.lost = self._down(most_rounds)

    def _unresolved(self, r: Relation) -> DataFrame:
        """The child's rows whose reference does not resolve, with ``_kind``: ``missing`` without any record of the
        key; else, where none is valid at the row's time, ``removed`` if one had begun and ``later`` if none had."""
        child, parent = self.entities[r.child], self.entities[r.parent]
        rows = child.rows.filter(F.col(r.column).isNotNull())
        if parent.valid_from is None and parent.valid_to is None:
            keys = parent.rows.select(F.col(parent.key).alias("_k"))
            return rows.join(keys, F.col(r.column) == F.col("_k"), "left_anti").withColumn("_kind", F.lit("missing"))
        # A key that many rows refer to is split by AQE; its record's spans are repeated, not its rows.
        known = spans(parent.rows, parent.key, parent.valid_from, parent.valid_to).select(F.col("k").alias("_k"), F.col("spans").alias("_spans"))
        joined = rows.join(known, F.col(r.column) == F.col("_k"), "left")
        t = F.col(child.dated).cast("timestamp_ntz") if child.dated else F.lit(None).cast("timestamp_ntz")
        begun: Column = F.exists("_spans", lambda s: s["a"] <= t)
        valid: Column = F.exists("_spans", lambda s: (s["a"] <= t) & (t < s["b"]))
        kind = F.when(F.col("_spans").isNull(), "missing").when(t.isNull() | valid, None).when(begun, "removed").otherwise("later")
        return joined.withColumn("_kind", kind).filter("_kind IS NOT NULL").drop("_k", "_spans")

    def _keys(self, name: str, rows: DataFrame) -> DataFrame:
        return rows.select(F.col(self.entities[name].key).alias("k")).filter("k IS NOT NULL")

    def _down(self, most_rounds: int) -> dict[str, DataFrame]:
        """Keys of all orphans, direct and inherited, of each table that others refer to; written each round."""
        found: dict[str, list[DataFrame]] = {}
        referred = {r.parent for r in self.relations}
        for r, rows in zip(self.relations, self.direct):
            if r.child in referred and self.entities[r.child].key:
                found.setdefault(r.child, []).append(self._keys(r.child, rows))
        lost: dict[str, DataFrame] = {}
        for _ in range(most_rounds):
            fresh: dict[str, DataFrame] = {}
            for name, parts in found.items():
                new = reduce(DataFrame.unionByName, parts).distinct()
                if name in lost:
                    new = new.join(lost[name], "k", "left_anti")
                new = materialize(new)
                if not new.isEmpty():
                    fresh[name] = new
                    lost[name] = materialize(lost[name].unionByName(new)) if name in lost else new
            found = {}
            for r in self.relations:
                if r.parent in fresh and r.child in referred and self.entities[r.child].key:
                    below = self.entities[r.child].rows.join(fresh[r.parent], F.col(r.column) == F.col("k"), "left_semi")
                    found.setdefault(r.child, []).append(self._keys(r.child, below))
            if not found:
                return lost
        raise RuntimeError(f"no fixpoint after {most_rounds} rounds")

    def _period(self, name: str) -> Column:
        dated = self.entities[name].dated
        return F.coalesce(F.date_format(dated, "yyyy-MM"), F.lit("unknown")) if dated else F.lit("unknown")

    def ends(self, id_column: str) -> DataFrame:
        """``(id_column, end_name, kind, period)``: one row for each direct orphan reference, repeated rows once."""
        parts = [rows.select(id_column, F.lit(r.column).alias("end_name"), F.col("_kind").alias("kind"), self._period(r.child).alias("period")) for r, rows in zip(self.relations, self.direct)]
        return reduce(DataFrame.unionByName, parts).distinct()

    def inherited(self, r: Relation) -> DataFrame | None:
        """The child's rows whose record is there, but is itself an orphan."""
        if r.parent not in self.lost:
            return None
        parent = self.entities[r.parent]
        rows = self.entities[r.child].rows
        return rows.join(self.lost[r.parent], F.col(r.column) == F.col("k"), "left_semi").join(parent.rows.select(F.col(parent.key).alias("_k")), F.col(r.column) == F.col("_k"), "left_semi")

    def report(self) -> DataFrame:
        """``(table_name, reference, period, state, n)``: orphan rows of each table, reference and month."""
        parts = []
        for r, direct in zip(self.relations, self.direct):
            for state, rows in (("direct", direct), ("inherited", self.inherited(r))):
                if rows is not None:
                    counted = rows.groupBy(self._period(r.child).alias("period")).agg(F.count("*").alias("n"))
                    parts.append(counted.select(F.lit(r.child).alias("table_name"), F.lit(r.column).alias("reference"), "period", F.lit(state).alias("state"), "n"))
        return reduce(DataFrame.unionByName, parts)


def dangling_ends(links: DataFrame, pages: DataFrame) -> DataFrame:
    """``(link_id, end_name, kind, period)`` of all ends of links, ``src`` and ``dst``, that no page answers at ``seen_at``."""
    graph = {"url_map": Entity(pages, "id", None, "first_seen", "removed_at"), "id_graph": Entity(links, None, "seen_at")}
    return Cascade(graph, [Relation("id_graph", "src", "url_map"), Relation("id_graph", "dst", "url_map")]).ends("link_id")
