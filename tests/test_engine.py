"""Behaviour through SQL on a database folder: definitions, queries, changes, transactions, time travel, vectors."""

import threading

import pytest
from pyspark.sql import functions as F

from quillon import Engine, EngineError, parse
from quillon.cli import answer, crash
from quillon.operators import dml
from quillon.plans.explain import physical


@pytest.fixture(scope="module")
def harbour(spark, tmp_path_factory):
    """Ships, their calls at ports, and soundings as vectors."""
    e = Engine.create(spark, str(tmp_path_factory.mktemp("harbour") / "db"))
    for text in (
        "CREATE TABLE ship (imo INTEGER PRIMARY KEY, title TEXT NOT NULL, tonnes INTEGER, draught REAL)",
        "CREATE TABLE port_call (no INTEGER PRIMARY KEY, ship_imo INTEGER, port TEXT, days REAL)",
        "CREATE TABLE sounding (id INTEGER PRIMARY KEY, spot TEXT, at VECTOR)",
        "INSERT INTO ship (title, tonnes, draught) VALUES ('Juno', 900, 4.5), ('Hebe', 400, 3.25), ('Ceres', 1500, 6.0), ('Juno', NULL, 2.0), ('Vesta', 650, NULL), ('Iris', 1, 1.0)",
        "DELETE FROM ship WHERE title = 'Iris'",
        "INSERT INTO port_call (ship_imo, port, days) VALUES (1, 'Riga', 2.5), (1, 'Turku', 1.0), (3, 'Riga', 7.25), (44, 'Visby', 0.5)",
        "INSERT INTO sounding (spot, at) VALUES ('north', [0, 6, 8]), ('east', [2, 0, 0]), ('south', '[0, -3, 0]')",
    ):
        e.execute(text)
    return e


SELECTS = {
    "SELECT imo, title, tonnes, draught FROM ship ORDER BY imo OFFSET 3": [(4, "Juno", None, 2.0), (5, "Vesta", 650, None)],
    "SELECT title FROM ship WHERE tonnes >= 650 ORDER BY tonnes": [("Vesta",), ("Juno",), ("Ceres",)],
    "SELECT COUNT(*), COUNT(tonnes), AVG(draught) FROM ship": [(5, 4, 3.9375)],
    "SELECT title, COUNT(*) AS n FROM ship GROUP BY title HAVING n = 2": [("Juno", 2)],
    "SELECT port FROM port_call GROUP BY port HAVING SUM(days) > 5": [("Riga",)],
    "SELECT DISTINCT title FROM ship WHERE title LIKE '%S%' ORDER BY title": [("Ceres",), ("Vesta",)],
    "SELECT title FROM ship WHERE tonnes NOT BETWEEN 500 AND 1000 ORDER BY imo": [("Hebe",), ("Ceres",)],
    "SELECT s.title, c.port FROM ship s JOIN port_call c ON s.imo = c.ship_imo ORDER BY c.no": [("Juno", "Riga"), ("Juno", "Turku"), ("Ceres", "Riga")],
    "SELECT s.imo, c.days FROM ship s LEFT JOIN port_call c ON s.imo = c.ship_imo AND c.days > 2 ORDER BY s.imo": [(1, 2.5), (2, None), (3, 7.25), (4, None), (5, None)],
    "SELECT s.title, c.port FROM ship s RIGHT JOIN port_call c ON s.imo = c.ship_imo WHERE s.imo IS NULL": [(None, "Visby")],
    "SELECT d.heavy FROM (SELECT title AS heavy, tonnes FROM ship WHERE tonnes > 800) AS d ORDER BY d.tonnes DESC": [("Ceres",), ("Juno",)],
    "SELECT imo FROM ship WHERE imo NOT IN (SELECT ship_imo FROM port_call) ORDER BY imo": [(2,), (4,), (5,)],
    "SELECT title FROM ship s WHERE EXISTS (SELECT 1 FROM port_call c WHERE c.ship_imo = s.imo AND c.port = 'Turku')": [("Juno",)],
    "SELECT imo, (SELECT COUNT(*) FROM port_call c WHERE c.ship_imo = s.imo) AS n FROM ship s ORDER BY imo LIMIT 3": [(1, 2), (2, 0), (3, 1)],
    "SELECT (SELECT title FROM ship ORDER BY tonnes DESC) AS t, ((SELECT port FROM port_call ORDER BY no)) AS p, (SELECT title FROM ship WHERE imo > 99) AS none": [("Ceres", "Riga", None)],
    "SELECT imo, (SELECT port FROM port_call c WHERE c.ship_imo = s.imo ORDER BY c.days) AS p FROM ship s WHERE imo < 4 ORDER BY imo": [(1, "Turku"), (2, None), (3, "Riga")],
    "SELECT port FROM port_call EXCEPT ALL SELECT 'Riga' ORDER BY port": [("Riga",), ("Turku",), ("Visby",)],
    "SELECT 7 AS x UNION ALL SELECT 8 EXCEPT SELECT 7": [(8,)],
    "SELECT [1, 1] <-> [4, 5] AS d, ([2] <-> [0]) * 2 AS e": [(5.0, 4.0)],
    "SELECT spot, at <-> [0, 0, 0] r FROM sounding WHERE at <-> [0, 0, 0] < 5 AND spot <> 'x' ORDER BY r": [("east", 2.0), ("south", 3.0)],
    "SELECT spot FROM sounding ORDER BY sounding.at <-> [0, 5, 8] LIMIT 1": [("north",)],
    "SELECT ROUND(-0.5) AS r, SUBSTR('anchor', -2, 3) AS s, CONCAT(NULL, 'b', 2.5) AS c, TRIM('\n y\t') AS t, RTRIM('abbb', 'b') AS u": [(0.0, "anc", "b2.5", "y", "a")],
    "SELECT TYPEOF(2.5) AS a, TYPEOF('') AS b, TYPEOF(NULL) AS c, TYPEOF(1 = 1) AS d, TYPEOF([2, 3]) AS e": [("number", "string", "null", "boolean", "object")],
    "SELECT 0x10 AS a, 9 / 4 AS b, -9 % 4 AS c, '3.99'::int AS d, CAST('40' AS REAL) AS e, 'c:\\d' AS f, 'o''k' AS g": [(16, 2.25, -1, 3, 40.0, "c:\\d", "o'k")],
    "SELECT GROUP_CONCAT(port) AS p, GROUP_CONCAT(DISTINCT port) AS q FROM port_call": [("Riga,Riga,Turku,Visby", "Riga,Turku,Visby")],
    "SELECT GROUP_CONCAT(port) AS p FROM port_call WHERE no > 90": [("",)],
    "SELECT COUNT(*) AS n FROM ship WHERE tonnes - 900": [(3,)],
    "SELECT IF(2 < 1, 'a', 'b') AS a, IFNULL(NULL, 'z') AS b, NULLIF('q', 'q') AS c, LEAST(4, NULL, 2) AS d -- the end": [("b", "z", None, 2)],
    "SELECT CASE port WHEN 'Riga' THEN 1 ELSE 0 END AS k, COUNT(*) AS n FROM port_call GROUP BY CASE port WHEN 'Riga' THEN 1 ELSE 0 END ORDER BY k": [(0, 2), (1, 2)],
}


@pytest.mark.parametrize("sql", SELECTS)
def test_select(harbour, sql):
    assert harbour.execute(sql).rows == SELECTS[sql]


ERRORS = {
    "SELECT * FROM lighthouse": "not found",
    "SELECT port FROM port_call INTERSECT SELECT imo, title FROM ship": "same number of columns",
    "SELECT [5, 6, 7] <-> [5, 6] AS d": "dimension mismatch",
    "SELECT [5] <-> 'deep' AS d": "requires two VECTOR",
    "CREATE TABLE chart (at VECTOR PRIMARY KEY)": "cannot be a primary key",
    "CREATE INDEX by_at ON sounding(at)": "cannot be indexed",
    "CREATE TABLE ship (x TEXT)": "already exists",
    "INSERT INTO ship (tonnes) VALUES (3)": "NOT NULL constraint failed: title",
    "INSERT INTO ship (imo, title) VALUES (80, 'a'), (81, 'b'), (80, 'c')": "UNIQUE constraint failed: imo = 80",
    "INSERT INTO ship (imo, title) VALUES (3, 'again')": "UNIQUE constraint failed: imo = 3",
    "SELECT LN(-1) AS x": "domain error",
    "SELECT 5 % 0 AS x": "Division by zero",
    "SELECT 5 AS OF yesterday": "integer transaction id",
    "COMMIT": "no transaction",
    "SAIL north": "unsupported statement",
    "SELECT [1, 2": "closing bracket",
    "EXPLAIN DELETE FROM ship": "not run to be explained",
}


@pytest.mark.parametrize("sql", ERRORS)
def test_errors(harbour, sql):
    with pytest.raises(EngineError, match=ERRORS[sql]):
        harbour.execute(sql)
    assert harbour.execute("SELECT COUNT(*) FROM ship").rows == [(5,)]


def test_explain(harbour):
    text = harbour.execute("EXPLAIN SELECT spot FROM sounding ORDER BY at <-> [1, 1, 1] LIMIT 3").explain
    assert "knn k=3" in text and "TakeOrderedAndProject" in text
    assert "knn" not in harbour.execute("EXPLAIN SELECT spot FROM sounding ORDER BY spot LIMIT 3").explain
    run = harbour.execute("EXPLAIN ANALYZE SELECT port FROM port_call")
    assert run.analyze.startswith("rows=4") and run.row_count == 4 and run.rows == []


def test_parse():
    s = parse("EXPLAIN SELECT spot FROM sounding ORDER BY at <-> [1] LIMIT 2 AS OF 5")
    assert (s.kind, s.explain, s.analyze, s.as_of) == ("select", True, False, 5) and "zip_with" in s.spark_sql
    assert parse("DROP TABLE ship").kind == "drop_table"
    for bad in ("SAIL north", "EXPLAIN", "DELETE FROM ship AS OF 3", ";"):
        with pytest.raises(EngineError):
            parse(bad)


def test_functions_of_the_caller(spark, tmp_path):
    spark.udf.register("knots", lambda x: None if x is None else x * 2, "long")
    e = Engine.create(spark, str(tmp_path / "f"))
    assert e.execute("SELECT KNOTS(21) AS k").rows == [(42,)]


def test_transactions(harbour):
    q = harbour.execute
    q("BEGIN")
    with pytest.raises(EngineError, match="already in a transaction"):
        q("START TRANSACTION")
    q("INSERT INTO ship (title) VALUES ('Ghost')")
    q("UPDATE ship SET tonnes = 0 WHERE title = 'Hebe'")
    q("DELETE FROM port_call WHERE port = 'Riga'")
    q("CREATE TABLE berth (no INTEGER PRIMARY KEY)")
    q("CREATE INDEX by_title ON ship(title)")
    q("DROP TABLE sounding")
    with pytest.raises(EngineError, match="not found"):
        q("DELETE FROM lighthouse")
    assert harbour.in_transaction and "berth" in harbour.tables and "sounding" not in harbour.tables
    assert q("SELECT COUNT(*), SUM(tonnes) FROM ship").rows == [(6, 3050)] and q("SELECT COUNT(*) FROM port_call").rows == [(2,)]
    q("ROLLBACK")
    assert q("SELECT COUNT(*), SUM(tonnes) FROM ship").rows == [(5, 3450)] and q("SELECT COUNT(*) FROM port_call").rows == [(4,)]
    assert "berth" not in harbour.tables and "sounding" in harbour.tables and not harbour.indexes


def test_sessions_and_conflicts(harbour):
    harbour.execute("CREATE TABLE queue (slot INTEGER PRIMARY KEY, who TEXT)")
    a, b = harbour.session(), harbour.session()
    a.execute("BEGIN")
    a.execute("INSERT INTO queue VALUES (10, 'pilot')")
    assert a.execute("SELECT who FROM queue").rows == [("pilot",)] and b.execute("SELECT who FROM queue").rows == []
    with pytest.raises(EngineError, match="write conflict"):
        b.execute("DELETE FROM queue")
    a.execute("COMMIT")
    assert b.execute("UPDATE queue SET who = 'tug' WHERE slot = 10").row_count == 1
    harbour.execute("DROP TABLE queue")


def test_of_two_writers_of_a_commit_one_wins(spark, tmp_path):
    e = Engine.create(spark, str(tmp_path / "w"))
    name, won = f"{e.store.log}/{7:020d}.json", []
    threads = [threading.Thread(target=lambda i=i: won.append(e.store.files.publish(name, f"writer {i}"))) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(won) == [False] * 7 + [True] and e.store.files.read(name).startswith("writer")
    assert not [n for n in e.store.files.names(e.store.log) if "-" in n]


def test_time_travel_reopen_and_window(spark, tmp_path):
    path = str(tmp_path / "t")
    e = Engine.create(spark, path, depth=6)
    e.execute("CREATE TABLE cargo (lot INTEGER PRIMARY KEY, goods TEXT, bales INTEGER DEFAULT 12)")
    e.execute("INSERT INTO cargo (goods, bales) VALUES ('wool', 40), ('flax', 8)")
    first = e.last_xid
    e.execute("INSERT INTO cargo (goods) VALUES ('hemp')")
    assert e.execute("UPDATE cargo SET bales = bales / 2 WHERE goods = 'wool'").row_count == 1
    assert e.execute("DELETE FROM cargo WHERE bales < 10").row_count == 1
    assert e.execute(f"SELECT goods, bales FROM cargo ORDER BY lot AS OF {first}").rows == [("wool", 40), ("flax", 8)]
    assert e.execute("SELECT goods, bales FROM cargo ORDER BY lot").rows == [("wool", 20), ("hemp", 12)]
    with pytest.raises(EngineError, match="not committed"):
        e.execute(f"SELECT goods FROM cargo AS OF {e.last_xid + 5}")
    e = Engine.open(spark, path, depth=3)
    for goods in ("tar", "salt", "rye"):
        e.execute(f"INSERT INTO cargo (goods) VALUES ('{goods}')")
    with pytest.raises(EngineError, match="outside the time-travel window"):
        e.execute(f"SELECT goods FROM cargo AS OF {first}")
    w = e.time_travel_window
    assert w == {"oldest": e.last_xid - 2, "newest": e.last_xid, "depth": 3} and e.execute(f"SELECT * FROM cargo AS OF {w['oldest']}").row_count == 3
    assert e.execute("SELECT COUNT(*), SUM(bales) FROM cargo").rows == [(5, 68)]


def many(spark, path, n=1000):
    """A table of n rows in several files, sorted by key."""
    e = Engine.create(spark, path)
    e.execute("CREATE TABLE m (k INTEGER PRIMARY KEY, v INTEGER)")
    e.execute(f"INSERT INTO m SELECT id, 0 FROM (SELECT explode(sequence(1, {n})) AS id)")
    table, parts = e.tables["m"], []
    for low in range(0, n, n // 4):
        parts += e.store.write(table, e.store.read(table).filter((F.col("k") > low) & (F.col("k") <= low + n // 4)).coalesce(1))
    head = e.store.head()
    head.tables["m"].parts, head.xid = parts, head.xid + 1
    e.store.commit(head)
    return e


def test_a_random_condition_is_decided_once(spark, tmp_path):
    e = many(spark, str(tmp_path / "r"))
    n = e.execute("UPDATE m SET v = 1 WHERE RANDOM() < 0.5").row_count
    assert 300 < n < 700 and e.execute("SELECT COUNT(*), COUNT(DISTINCT k), SUM(v) FROM m").rows == [(1000, 1000, n)]
    gone = e.execute("DELETE FROM m WHERE RANDOM() < 0.5").row_count
    assert e.execute("SELECT COUNT(*), COUNT(DISTINCT k) FROM m").rows == [(1000 - gone, 1000 - gone)]


def test_only_touched_files_are_written_anew(spark, tmp_path):
    e = many(spark, str(tmp_path / "o"))
    before = e.tables["m"].parts
    assert e.execute("UPDATE m SET v = 5 WHERE k IN (3, 400)").row_count == 2
    after = e.tables["m"].parts
    assert set(before) & set(after) == set(before[2:])
    assert e.execute("DELETE FROM m WHERE k = 999").row_count == 1
    assert set(before) & set(e.tables["m"].parts) == {before[2]}
    assert e.execute("SELECT COUNT(*), COUNT(DISTINCT k), SUM(v) FROM m").rows == [(999, 999, 10)]
    assert e.execute(f"SELECT COUNT(*), SUM(v) FROM m AS OF {e.last_xid - 2}").rows == [(1000, 0)]
    assert e.execute("UPDATE m SET v = 6 WHERE k > 5000").row_count == 0 and e.execute("DELETE FROM m").row_count == 999
    assert e.execute("SELECT COUNT(*) FROM m").rows == [(0,)]


def test_keys_of_few_new_rows_are_looked_up_without_a_shuffle(spark, tmp_path):
    e = many(spark, str(tmp_path / "s"))
    plan = physical(dml.clashes(spark.range(3).toDF("k"), e.store.read(e.tables["m"]).select("k"), ["k"], 3))
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "LessThanOrEqual(k,2)" in plan


def test_small_folders_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("quillon.engine.MOST_PARTS", 8)
    e = many(spark, str(tmp_path / "g"))
    first = set(e.tables["m"].parts)
    for i in range(6):
        e.execute(f"INSERT INTO m (v) VALUES ({i})")
    parts = e.tables["m"].parts
    assert len({p.rpartition("/")[0] for p in parts}) == 6 and first <= set(parts)
    assert e.execute("SELECT COUNT(*), COUNT(DISTINCT k), SUM(v) FROM m").rows == [(1006, 1006, 15)]


def test_indexes_never_change_results(spark, tmp_path):
    e = Engine.create(spark, str(tmp_path / "i"))
    e.execute("CREATE TABLE tide (hour INTEGER, height REAL)")
    e.execute("INSERT INTO tide SELECT id % 24, id / 7 FROM (SELECT explode(sequence(1, 240)) AS id)")
    ask = ("SELECT COUNT(*) FROM tide WHERE hour = 5", "SELECT MIN(height) FROM tide WHERE hour >= 20 AND height > 3")
    before = [e.execute(q).rows for q in ask]
    e.execute("CREATE INDEX by_hour ON tide(hour, height)")
    assert before == [e.execute(q).rows for q in ask]
    assert "EqualTo(hour,5)" in e.execute("EXPLAIN SELECT height FROM tide WHERE hour = 5").explain
    with pytest.raises(EngineError, match="UNIQUE"):
        e.execute("CREATE UNIQUE INDEX u ON tide(hour)")
    e.execute("DROP INDEX by_hour")
    assert e.indexes == {} and before == [e.execute(q).rows for q in ask]


def test_constraints_on_update_and_coercion(spark, tmp_path):
    e = Engine.create(spark, str(tmp_path / "c"))
    e.execute("CREATE TABLE buoy (id INTEGER PRIMARY KEY, code TEXT UNIQUE, lamps INTEGER NOT NULL DEFAULT 2, lit BOOLEAN DEFAULT true)")
    e.execute("INSERT INTO buoy (code, lamps) VALUES ('A', '7.8'), ('B', 'dark'), (NULL, 1), (NULL, 3)")
    assert e.execute("SELECT lamps, lit FROM buoy ORDER BY id").rows == [(7, True), (0, True), (1, True), (3, True)]
    for sql, said in (("UPDATE buoy SET code = 'A' WHERE id = 2", "UNIQUE"), ("UPDATE buoy SET lamps = NULL", "NOT NULL"), ("UPDATE buoy SET id = 4 WHERE id = 1", "UNIQUE"), ("INSERT INTO buoy (code) VALUES ('B')", "UNIQUE")):
        with pytest.raises(EngineError, match=said):
            e.execute(sql)
    assert e.execute("UPDATE buoy SET lamps = lamps + 10 WHERE id IN (SELECT id FROM buoy WHERE code IS NULL)").row_count == 2
    assert e.execute("UPDATE buoy SET lamps = (SELECT lamps FROM buoy ORDER BY lamps DESC) WHERE code = 'A'").row_count == 1
    assert e.execute("SELECT SUM(lamps) AS s FROM buoy").rows == [(37,)]


def test_a_crash_leaves_what_was_committed(spark, tmp_path):
    before, after = crash(spark, str(tmp_path / "k"))
    assert before == after == [(1, "kept"), (2, "kept as well")]


def test_prompt(harbour):
    assert "sounding(id int, spot text, at vector)" in answer(harbour, ".tables") and answer(harbour, ".indexes") == ""
    assert "title" in answer(harbour, "SELECT title FROM ship") and "Vesta" in answer(harbour, "SELECT title FROM ship")
    long = answer(harbour, "SELECT explode(sequence(1, 5000)) AS x")
    assert long.count("\n") == 202 and "..." in long and answer(harbour, "EXPLAIN ANALYZE SELECT 1 AS x").startswith("rows=1")
