"""Statements from the terminal, a replica, and a crash to look at.

    python -m quillon.cli PATH                      a prompt: SQL, .help .tables .indexes .window exit
    python -m quillon.cli --follow MASTER REPLICA   keep a replica of MASTER's commits until interrupted
    python -m quillon.cli --crash PATH              write, die in the middle of a transaction; then open PATH again and look
"""

from __future__ import annotations

import sys
import time

from pyspark.sql import DataFrame, SparkSession

from quillon.engine import Engine, EngineError
from quillon.plans.statement import parse
from quillon.streaming.follower import Follower

#: Rows and characters of a value that are printed.
MOST_ROWS, MOST_CHARS = 200, 40


def shown(columns: list[str], rows: list[tuple], more: bool = False) -> str:
    cells = [[("NULL" if v is None else str(v))[:MOST_CHARS] for v in r] for r in rows]
    widths = [max(map(len, c)) for c in zip(columns, *cells)] if columns else []
    lines = [" | ".join(x.ljust(w) for x, w in zip(r, widths)) for r in [columns, *cells]]
    return "\n".join(lines + ["..."] * more)


def look(df: DataFrame) -> str:
    """The first rows; no more than these reach the driver."""
    rows = [tuple(r) for r in df.limit(MOST_ROWS + 1).collect()]
    return shown(df.columns, rows[:MOST_ROWS], len(rows) > MOST_ROWS)


def answer(engine: Engine, line: str) -> str:
    """What the prompt says to a line."""
    if line == ".help":
        return __doc__
    if line == ".tables":
        return "\n".join(f"{t.name}({', '.join(f'{c.name} {c.type}' for c in t.columns)})" for t in engine.tables.values())
    if line == ".indexes":
        return "\n".join(f"{k} ON {v['table']}({', '.join(v['columns'])})" for k, v in engine.indexes.items())
    if line == ".window":
        return str(engine.time_travel_window)
    began, statement = time.time(), parse(line)
    if statement.kind == "select" and not statement.explain:
        return f"{look(engine.sql(line))}\n{(time.time() - began) * 1000:.0f} ms"
    r = engine.execute(line)
    return f"{r.analyze or r.explain or 'ok'}\n{r.row_count} rows, {r.time_ms:.0f} ms"


def prompt(spark: SparkSession, path: str) -> None:
    engine = Engine.open(spark, path)
    print(__doc__)
    while True:
        try:
            line = input("> ").strip()
        except EOFError:
            break
        if line in ("exit", ".quit", ".exit"):
            break
        try:
            print(answer(engine, line) if line else "")
        except EngineError as e:
            print(f"error: {e}")
    engine.close()


def follow(spark: SparkSession, master: str, replica: str, seconds: float | None = 0.25) -> Follower:
    """Apply commits as they come and say which; with None those that there are."""
    follower = Follower(spark, master, replica, f"{replica.rstrip('/')}-checkpoint")
    query, said = follower.start(seconds), 0
    try:
        while not query.awaitTermination(1):
            if len(follower.applied) > said:
                said = len(follower.applied)
                print(f"{said} commits applied, the last one {follower.applied[-1]}")
    except KeyboardInterrupt:
        query.stop()
    return follower


def crash(spark: SparkSession, path: str) -> tuple[list[tuple], list[tuple]]:
    """(rows that were committed before the process died inside a transaction, rows that a new process finds)."""
    engine = Engine.create(spark, path)
    engine.execute("CREATE TABLE notes (id INTEGER PRIMARY KEY, body TEXT)")
    engine.execute("INSERT INTO notes (body) VALUES ('kept'), ('kept as well')")
    before = engine.execute("SELECT id, body FROM notes ORDER BY id").rows
    engine.execute("BEGIN")
    engine.execute("INSERT INTO notes (body) VALUES ('lost')")
    engine.execute("UPDATE notes SET body = 'lost' WHERE id = 1")
    engine.simulate_crash()
    return before, Engine.open(spark, path).execute("SELECT id, body FROM notes ORDER BY id").rows


def main(arguments: list[str]) -> None:
    spark = SparkSession.builder.master("local[*]").getOrCreate()
    if arguments[:1] == ["--follow"]:
        follow(spark, *arguments[1:3])
    elif arguments[:1] == ["--crash"]:
        before, after = crash(spark, arguments[1])
        print(f"committed before: {before}\nfound after:      {after}\n{'as it should be' if before == after else 'LOST OR CHANGED'}")
    else:
        prompt(spark, arguments[0])


if __name__ == "__main__":
    main(sys.argv[1:])
