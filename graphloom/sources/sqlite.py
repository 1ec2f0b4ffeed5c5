"""Triples in SQLite files. SQLite is one file on one machine: the driver reads and writes it, by pattern and in batches."""

from __future__ import annotations

import sqlite3
from contextlib import closing

from pyspark.sql import DataFrame, SparkSession

from graphloom.sources.graphs import TRIPLE, Graph

_LAYOUT = ("create table if not exists terms (id integer primary key, value text unique not null)",
           "create table if not exists triples (s integer not null, p integer not null, o integer not null, primary key (s, p, o)) without rowid",
           "create index if not exists by_p on triples (p, o, s)", "create index if not exists by_o on triples (o, s, p)")
_ROWS = "select a.value, b.value, c.value from triples t join terms a on a.id = t.s join terms b on b.id = t.p join terms c on c.id = t.o"


def write(triples: DataFrame, path: str, batch: int = 10_000) -> int:
    """Adds triples to the file, all or none, in batches within one transaction; returns how many are new."""
    with closing(sqlite3.connect(path)) as db, db:
        for statement in _LAYOUT:
            db.execute(statement)
        before, rows = db.execute("select count(*) from triples").fetchone()[0], []

        def flush() -> None:
            db.executemany("insert or ignore into terms (value) values (?)", [(t,) for r in rows for t in r])
            db.executemany("insert or ignore into triples select a.id, b.id, c.id from terms a, terms b, terms c where a.value = ? and b.value = ? and c.value = ?", rows)
            rows.clear()

        for r in triples.select("s", "p", "o").toLocalIterator():
            rows.append((r.s, r.p, r.o))
            if len(rows) >= batch:
                flush()
        flush()
        return db.execute("select count(*) from triples").fetchone()[0] - before


class SqliteGraph(Graph):
    """A graph in a file; a pattern reads the triples that have its terms, by the file's indexes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @property
    def triples(self) -> DataFrame:
        return self.scan()

    def scan(self, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
        given = [(c, t) for c, t in (("a", s), ("b", p), ("c", o)) if t is not None]
        where = " where " + " and ".join(f"{c}.value = ?" for c, _ in given) if given else ""
        with closing(sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)) as db:
            rows = db.execute(_ROWS + where, [t for _, t in given]).fetchall()
        return self.spark.createDataFrame(rows, TRIPLE)


def rows(path: str, text: str, values: tuple = ()) -> list[tuple]:
    """What a query gives; the file is opened for reading only."""
    with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as db:
        return db.execute(text, values).fetchall()
