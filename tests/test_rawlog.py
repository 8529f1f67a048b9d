"""Raw logs of servers: rendered and read back, whatever the ranges of bytes."""

import datetime as dt
import io
import random

import pytest

from stmtwatch.sources import rawlog

START = dt.datetime(2024, 1, 1, 12)
COLUMNS = "seq long, event_time timestamp, conn_id string, db_type string, db_name string, db_user string, user_ip string, command string, query string"


def _rows(dialect, count=300):
    rng, rows = random.Random(4), []
    texts = ["select 1", "select *\nfrom t\n\nwhere a = 'x,\"y\"'", "insert into t values ('2024-01-01T00:00:00.0Z')", "é" * 50 + "\r\nx", "a\tb"]
    for seq in range(count):
        command = rng.choice(["query"] * 6 + (["login", "use_db", "quit", "create_db"] if dialect == "mysql" else ["login", "quit", "parse"]))
        has_text = command in ("query", "create_db", "parse")
        names = command in ("login", "use_db") or dialect == "pgsql"
        rows.append((
            seq, START + dt.timedelta(milliseconds=seq * 7), str(rng.randrange(1, 90)), dialect, "shop" if names else "",
            "ann" if command == "login" or dialect == "pgsql" else "", "10.0.0.1" if command == "login" or dialect == "pgsql" else "",
            command, rng.choice(texts) if has_text else "",
        ))
    return rows


def _text(spark, rows, dialect):
    df = spark.createDataFrame(rows, COLUMNS)
    return [r.value for r in df.orderBy("seq").select(rawlog.render(df, dialect).alias("value")).collect()]


@pytest.mark.parametrize("dialect", ["mysql", "pgsql"])
@pytest.mark.parametrize("split,chunk", [(1 << 20, 1 << 20), (1000, 400), (97, 300), (10, 257)])
def test_read_back(spark, tmp_path, dialect, split, chunk):
    rows = _rows(dialect, 60 if split < 100 else 300)
    lines = _text(spark, rows, dialect)
    half = len(lines) // 2
    banner = "/usr/sbin/mysqld, Version: 8.0.36 (x). started with:\nTcp port: 3306\nTime  Id Command  Argument\n"
    for name, part in (("a.log", lines[:half]), ("b.log", lines[half:])):
        extra = banner if dialect == "mysql" else ""
        (tmp_path / name).write_bytes((extra + "\n".join(part) + "\n" + extra).encode())
    log = rawlog.read_raw_log(spark, str(tmp_path), dialect, proxy_id=3, splitbytes=split, chunkbytes=chunk)
    got = [tuple(r) for r in log.orderBy("seq").select(*[c.split()[0] for c in COLUMNS.split(", ")][1:]).collect()]
    want = [r[1:] for r in rows]
    assert [tuple(x) for x in got] == [(*w[:-1], w[-1].rstrip("\r\n") if dialect == "mysql" else w[-1]) for w in want]
    assert {r.proxy_id for r in log.select("proxy_id").distinct().collect()} == {3}
    assert log.select("seq").distinct().count() == len(rows)


def test_records_of_every_range(spark):
    """Each record is found in exactly one range, also where a statement looks like lines of its own."""
    data = ("\n".join(_text(spark, _rows("mysql", 40), "mysql")) + "\n").encode()
    whole = list(rawlog.records(io.BytesIO(data), 0, len(data), rawlog.GeneralLog.start))
    assert b"".join(r for _, r in whole) == data and len(whole) == 40
    for width in (1, 7, 50, 333):
        found = [x for low in range(0, len(data), width)
                 for x in rawlog.records(io.BytesIO(data), low, min(low + width, len(data)), rawlog.GeneralLog.start, 300)]
        assert found == whole
    assert rawlog.last_start(io.BytesIO(data), len(data), rawlog.GeneralLog.start, 64) == whole[-1][0]


def test_a_stream_follows_a_growing_file(spark, tmp_path):
    lines = _text(spark, _rows("mysql", 30), "mysql")
    path, out = tmp_path / "general.log", []

    def run():
        rawlog.stream_raw_log(spark, str(tmp_path / "general.log"), "mysql", splitbytes=500).writeStream.foreachBatch(
            lambda df, n: out.extend(df.select("query", "command").collect())
        ).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    path.write_text("\n".join(lines[:10]) + "\n")
    run()
    assert len(out) == 9  # the last one may go on
    with path.open("a") as file:
        file.write("  and more\n" + "\n".join(lines[10:]) + "\n")
    run()
    assert len(out) == 29
    assert out[9].query.endswith("and more") or out[9].command != "query"


def test_odd_files(spark, tmp_path):
    (tmp_path / "empty.log").write_text("")
    (tmp_path / "other.log").write_text("no record\nat all\n")
    assert rawlog.read_raw_log(spark, str(tmp_path), "mysql", splitbytes=4).count() == 0
    (tmp_path / "p.csv").write_text('2024-01-01 00:00:00.000 CET,"u","d",1,"h:1",s,1,"",t,,0,LOG,00000,"statement: x"\n')
    with pytest.raises(Exception, match="UTC"):
        rawlog.read_raw_log(spark, str(tmp_path / "p.csv"), "pgsql").collect()
