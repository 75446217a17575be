"""Reading, streaming and writing SQLite databases."""

import sqlite3

import pytest

from tallyloom.sources import sqlite


@pytest.fixture()
def forum(tmp_path):
    path = str(tmp_path / "forum 1#%.db")
    c = sqlite3.connect(path)
    c.execute("create table posts(post_id integer primary key, content text, score real, raw blob, odd whatever)")
    c.execute("create table votes(vote_id integer primary key, value integer, content text)")
    c.executemany("insert into posts(content, score, raw, odd) values (?, ?, ?, ?)", [("a", 1.5, b"x", 1), (None, None, None, None), ("it's", "n/a", b"", "t")] + [(str(k), k, b"y", k) for k in range(50)])
    c.commit()
    yield path, c
    c.close()


def test_tables(spark, forum):
    path, c = forum
    df = sqlite.sqlite_table(spark, path, "posts", 4)
    assert df.schema.simpleString() == "struct<post_id:bigint,content:string,score:double,raw:binary,odd:string>"
    assert df.rdd.getNumPartitions() == 4 and df.count() == 53
    first = [tuple(r) for r in df.orderBy("post_id").limit(3).collect()]
    assert first == [(1, "a", 1.5, b"x", "1"), (2, None, None, None, None), (3, "it's", None, b"", "t")], "a value of another type than its column's is null"
    assert df.filter("post_id in (2, 3)").count() == 2 and df.filter("content = 'it''s'").count() == 1 and df.filter("post_id > 50 and score is not null").count() == 3
    assert sqlite.sqlite_table(spark, path, "votes").count() == 0
    c.execute("delete from posts where post_id between 10 and 45")
    c.commit()
    assert sqlite.sqlite_table(spark, path, "posts", 8).count() == 17, "gaps in the ids"
    with pytest.raises(Exception, match="no table"):
        sqlite.sqlite_table(spark, path, "absent").count()


def test_writes(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(k, f"t{k}" if k % 3 else None, k / 4, k % 2 == 0) for k in range(40)], "k long, t string, x double, b boolean")
    sqlite.write_sqlite(df.repartition(3), path, "a")
    assert sorted(tuple(r) for r in sqlite.sqlite_table(spark, path, "a").select("k", "x", "b").collect()) == [(k, k / 4, int(k % 2 == 0)) for k in range(40)]
    sqlite.write_sqlite(df.limit(5), path, "a", "append")
    assert sqlite.sqlite_table(spark, path, "a").count() == 45
    sqlite.write_sqlite(df.limit(5), path, "a")
    assert sqlite.sqlite_table(spark, path, "a").count() == 5
    sqlite.write_sqlite(df.limit(0), path, "b", "append")
    assert not list((tmp_path / "out").glob("*unfinished"))


def test_cursors(spark, forum, tmp_path):
    path, c = forum

    def run():
        news = sqlite.sqlite_news(spark, path, {"posts": "post_id", "votes": "vote_id"}, 3)
        query = news.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sum(p["numInputRows"] for p in query.recentProgress)

    assert run() == 53
    c.execute("insert into posts(content) values ('new')")
    c.executemany("insert into votes(value) values (?)", [(1,), (-1,)])
    c.commit()
    assert run() == 3 and run() == 0
    got = spark.read.parquet(str(tmp_path / "o"))
    assert got.count() == 56 and got.filter("source_table = 'votes' and post_id is null").count() == 2 and got.filter("content = 'new'").first().post_id == 54
