from emberlens.operators import static_python as py
from emberlens.operators import static_web as web

SOURCE = '''import sqlite3
import pandas


def rows(db, client, ids):
    for i in ids:
        db.execute("SELECT * FROM t WHERE id = ?", (i,))
        db.execute("INSERT INTO t VALUES (1)")
    db.execute("SELECT a.id FROM a LEFT JOIN b AS bb ON bb.id = a.id WHERE a.x = 1 LIMIT 5 OFFSET 500")
    db.execute("SELECT a.id, c.n FROM a LEFT JOIN c c ON c.id = a.id")
    client.messages.create(model="m", messages=[])
    client.messages.create(model="m", max_tokens=5, messages=[])


async def slow():
    sqlite3.connect("x")
'''
TEST = '''def test_values():
    assert str(value()) == "a"
    assert value() == 42
    assert value() == 42
'''


def test_database_and_model_rules(spark):
    table = py.facts(spark.createDataFrame([("app/db.py", SOURCE), ("tests/test_db.py", TEST)], "path string, text string")).cache()
    found = sorted((r.check_id, r.line) for r in py.hits(table).collect())
    for hit in [("DB-09", 7), ("DB-13", 8), ("DB-14", 7), ("DB-39", 9), ("DB-41", 16), ("LLM-07", 11), ("PY-10", 2), ("TST-04", 3), ("TST-05", 3), ("TST-08", 2)]:
        assert hit in found
    assert ("LLM-07", 12) not in found
    assert [(r.line, r.identity) for r in py.unused_left_joins(table).collect()] == [(9, "left-join:bb")]


def test_assertions_that_differ_late_are_no_duplicates(spark):
    text = "def test_items():\n" + "".join(f"    assert response.json()['items'][0]['name']['of']['the']['item'] == '{x}'\n" for x in ("first", "second", "third", "second"))
    table = py.facts(spark.createDataFrame([("tests/test_a.py", text)], "path string, text string"))
    assert [r.line for r in py.hits(table).collect() if r.check_id == "TST-05"] == [3]


def test_web_rules(spark):
    files = spark.createDataFrame(
        [("a.css", "a { transition: width 1s, opacity 2s } /* transition: height 1s */"), ("b.js", "el.addEventListener('x', f)\n// removeEventListener(\ntry { throw new Error() } catch (e) {}"), ("c.js", "const t = setInterval(f, 5); clearInterval(t)")],
        "path string, text string",
    )
    assert [(r.path, r.property) for r in web.layout_transitions(files).collect()] == [("a.css", "width")]
    assert [r.path for r in web.uncleared(files).collect()] == ["b.js"] == [r.path for r in web.local_throws(files).collect()]
    names = spark.createDataFrame([("p", "winston"), ("p", "pino"), ("q", "pino")], "path string, name string")
    assert [(r.path, r.tools) for r in web.overlapping_tools(names, {"winston": "logger", "pino": "logger"}).collect()] == [("p", ["pino", "winston"])]
    fields = spark.createDataFrame([("s", "userId", "a"), ("s", "user_id", "a"), ("s", "user_id", "b"), ("s", "ok", "a")], "scope string, key string, file string")
    drift = web.field_drift(fields.withColumn("concept", web.concept(fields.key)), "scope", "concept", "key", "file").collect()
    assert [(r.concept, r.reference, r.spellings) for r in drift] == [("user_id", "user_id", 2)]
    support = spark.createDataFrame([("python", "3.8", "2024-10-07")], "runtime string, version string, ends string").selectExpr("runtime", "version", "CAST(ends AS date) AS ends")
    assert [r.days_left for r in web.end_of_life(spark.createDataFrame([("Dockerfile", "FROM python:3.8-slim")], "path string, text string"), support, "2024-10-01").collect()] == [6]
