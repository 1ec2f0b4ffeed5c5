"""Change streams: rows (op, s, p, o) folded into a graph, with triggers and standing patterns, in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.fixpoint import insert, remove
from graphloom.operators.lineage import cut
from graphloom.sources.graphs import Graph, bind
from graphloom.sources.n3 import Rule

CHANGES = "op string, s string, p string, o string, seq bigint"


class Reactive:
    """A graph that follows a change stream. ``retract`` withdraws what depended on a removed triple."""

    def __init__(self, graph: Graph, rules: list[Rule], retract: bool = False):
        self.rules, self.retract = rules, retract
        self.asserted = Graph(cut(graph.triples))
        self.graph = insert(Graph(graph.triples.limit(0)), rules, self.asserted.triples).graph
        self.subscriptions: list[tuple[tuple, Callable[[DataFrame], None]]] = []

    def subscribe(self, pattern: tuple[str, str, str], handler: Callable[[DataFrame], None]) -> None:
        """handler gets the pattern's bindings in each batch's new triples."""
        self.subscriptions.append((pattern, handler))

    def apply(self, batch: DataFrame, batch_id: int = 0) -> None:
        """One micro-batch: the last operation on a triple counts; additions first, then removals."""
        last = batch.groupBy("s", "p", "o").agg(F.max_by("op", "seq").alias("op"))
        last = cut(last)
        added, removed = (last.where(F.col("op") == op).select("s", "p", "o") for op in ("add", "remove"))
        before = self.graph.triples
        if not added.isEmpty():
            self.asserted = Graph(cut(self.asserted.insert(added).triples))
            self.graph = insert(self.graph, self.rules, added).graph
        if not removed.isEmpty():
            if self.retract:
                self.graph = remove(self.asserted, self.graph, self.rules, removed)
            else:
                self.graph = Graph(cut(self.graph.delete(removed).triples))
            self.asserted = Graph(cut(self.asserted.delete(removed).triples))
        new = Graph(cut(self.graph.triples.join(before, ["s", "p", "o"], "left_anti")))
        for pattern, handler in self.subscriptions:
            found = bind(new, *pattern)
            if not found.isEmpty():
                handler(found)

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = True):
        """The stream's query; with available_now it ends when the source is read."""
        writer = stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Windowed counts of an event stream (ts, event_type), with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
