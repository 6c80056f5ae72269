"""SQLite files as tables, and foreign indexes of snapshots."""

import sqlite3

from palimpsest.sources import sqlite


def test_tables_are_read_in_ranges(spark, tmp_path):
    for n in range(2):
        db = sqlite3.connect(f"{tmp_path}/{n} ?#x.sqlite3")
        db.execute('CREATE TABLE "odd ""name" (a, b TEXT)')
        db.executemany('INSERT INTO "odd ""name" VALUES (?, ?)', [(i if i % 3 else None, f"é{i}") for i in range(50 * n, 50 * n + 30)])
        db.execute('DELETE FROM "odd ""name" WHERE rowid BETWEEN 5 AND 9')
        db.commit()
        db.close()
    sqlite3.connect(f"{tmp_path}/empty.db").close()
    for rows in (4, 1000):
        got = sqlite.read_table(spark, f"file://{tmp_path}", 'odd "name', ["b", "a"], rows)
        assert sorted((r.b, r.a) for r in got.collect()) == sorted((f"é{i}", str(i) if i % 3 else None) for n in range(2) for i in range(50 * n, 50 * n + 30) if not 4 <= i - 50 * n <= 8)
        assert got.rdd.getNumPartitions() == (16 if rows == 4 else 2)
    assert sqlite.read_table(spark, f"file://{tmp_path}", "none", ["b"]).count() == 0


def test_snapshots_of_two_indexes(spark, tmp_path):
    for n, tagged in ((1, True), (2, False)):
        db = sqlite3.connect(f"{tmp_path}/index{n}.sqlite3")
        db.execute("CREATE TABLE core_snapshot (id TEXT, timestamp TEXT, url TEXT, title TEXT, added TEXT)")
        db.executemany("INSERT INTO core_snapshot VALUES (?, ?, ?, ?, ?)", [("a", "1.5", f"http://{n}/", None, "2024"), ("b", "", "http://x/", "t", "2024"), ("c", "2", None, "t", "2024"), ("d", "3", "http://d/", "D", None)])
        if tagged:
            db.executescript("CREATE TABLE core_tag (id INTEGER, name TEXT); CREATE TABLE core_snapshot_tags (snapshot_id TEXT, tag_id INTEGER); INSERT INTO core_tag VALUES (1, ' z '), (2, 'y'), (3, ' '); INSERT INTO core_snapshot_tags VALUES ('a', 1), ('a', 2), ('a', 3), ('b', 1);")
        db.commit()
        db.close()
    got = sorted((r.path[-15:], r.id, r.timestamp, r.url, r.title, r.added, tuple(r.tags)) for r in sqlite.read_snapshots(spark, f"file://{tmp_path}").collect())
    assert got == [("/index1.sqlite3", "a", "1.5", "http://1/", "", "2024", ("y", "z")), ("/index1.sqlite3", "d", "3", "http://d/", "D", None, ()), ("/index2.sqlite3", "a", "1.5", "http://2/", "", "2024", ()), ("/index2.sqlite3", "d", "3", "http://d/", "D", None, ())]
