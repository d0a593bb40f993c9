"""The replica that follows the commit log."""

import pytest

from quillon import Engine, EngineError
from quillon.cli import follow
from quillon.streaming.follower import Follower


def test_follow(spark, tmp_path):
    master, replica = str(tmp_path / "origin"), str(tmp_path / "copy")
    e = Engine.create(spark, master)
    for text in ("CREATE TABLE ledger (line INTEGER PRIMARY KEY, amount REAL)", "INSERT INTO ledger (amount) VALUES (12.5), (3), (8.25)", "UPDATE ledger SET amount = 4 WHERE line = 2"):
        e.execute(text)
    f = follow(spark, master, replica, seconds=None)
    assert f.applied == [1, 2, 3] and f.engine.execute("SELECT SUM(amount) FROM ledger").rows == [(24.75,)]
    writer = e.session()
    writer.execute("BEGIN")
    writer.execute("DELETE FROM ledger WHERE line = 1")
    f.start(None).awaitTermination(120)
    assert f.engine.execute("SELECT COUNT(*) FROM ledger").rows == [(3,)]  # nothing before the commit
    writer.execute("COMMIT")
    f.start(None).awaitTermination(120)
    assert f.engine.execute("SELECT line, amount FROM ledger ORDER BY line").rows == [(2, 4.0), (3, 8.25)]
    assert f.engine.execute("SELECT COUNT(*) FROM ledger AS OF 2").rows == [(3,)]
    f.apply(e.store.head())  # a commit that comes again changes nothing
    assert f.engine.execute("SELECT COUNT(*) FROM ledger").rows == [(2,)]


def test_a_master_created_anew_empties_the_replica(spark, tmp_path):
    master, replica = str(tmp_path / "origin"), str(tmp_path / "copy")
    old = Engine.create(spark, master)
    old.execute("CREATE TABLE before (x TEXT)")
    Follower(spark, master, replica, str(tmp_path / "one")).start(None).awaitTermination(120)
    new = Engine.create(spark, master)
    new.execute("CREATE TABLE after (y TEXT)")
    new.execute("INSERT INTO after VALUES ('here')")
    f = Follower(spark, master, replica, str(tmp_path / "two"))
    f.start(None).awaitTermination(120)
    assert f.engine.execute("SELECT y FROM after").rows == [("here",)]
    with pytest.raises(EngineError, match="not found"):
        f.engine.execute("SELECT x FROM before")


def test_follow_as_commits_come(spark, tmp_path):
    e = Engine.create(spark, str(tmp_path / "origin"))
    f = Follower(spark, str(tmp_path / "origin"), str(tmp_path / "copy"), str(tmp_path / "cp"))
    query = f.start(0.2)
    e.execute("CREATE TABLE tick (n INTEGER)")
    e.execute("INSERT INTO tick VALUES (1), (2)")
    query.processAllAvailable()
    query.stop()
    assert f.engine.execute("SELECT SUM(n) FROM tick").rows == [(3,)]
