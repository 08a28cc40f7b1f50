import zipfile

import pytest

from pyspark.sql import functions as F

from taskweft.operators.durations import durations
from taskweft.sources import config, schedules, sinks, stored
from taskweft.streaming import messages
from taskweft.streaming.intake import run_intake


def node(i, **keys):
    return f'<node id="{i}">\n' + "\n".join(f'<data key="{k}">{v}</data>' for k, v in keys.items()) + "\n</node>\n"


TASK = dict(TaskType="TT_Task", Label="Lay_cable &amp test", PlannedStart="01/02/2020", PlannedEnd="11/02/2020", ActualStart="2020-02-03", ActualEnd="2020-02-05", Float="0", Status="Done")


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.graphml").write_text("</node>\n" + node("A1", **TASK) + node("A2", **TASK | {"TaskType": "TT_Mile"}) + node("A3", TaskType="TT_TASK", Label="Bücher�", Constraint="x"))
    (tmp_path / "b.graphml").write_bytes((node("A1", **TASK) + node("A1", **TASK) + node("B2", TaskType="TT_Task", Label="Bücher")).encode("latin-1"))
    return tmp_path


def test_nodes(spark, folder):
    tasks = schedules.parse_nodes(schedules.text_files(spark, str(folder / "*.graphml")))
    got = {(r.id, r.file): r for r in tasks.collect()}
    assert tasks.count() == 6 and tasks.columns == [*schedules.TASK_COLUMNS, "file"]
    assert got["A3", "a.graphml"].label == "Bücher" and got["A3", "a.graphml"].planned_start is None
    assert got["B2", "b.graphml"].label == "Bücher"
    older = schedules.parse_nodes(schedules.text_files(spark, str(folder / "a.graphml")), {"task_id": "ID", "name": "Label", "limit": "Constraint"}, "source_file")
    assert older.columns == ["task_id", "name", "limit", "source_file"] and older.where("task_id = 'A3'").first().limit == "x"
    clean = schedules.clean_tasks(tasks)
    assert sorted((r.id, r.file) for r in clean.collect()) == [("A1", "a.graphml"), ("A1", "b.graphml"), ("A3", "a.graphml"), ("B2", "b.graphml")]
    assert clean.where("id = 'A1'").first().label == "Lay cable  test"
    assert {(r.id, r.d) for r in durations(clean, "planned_start", "planned_end", "d").collect()} == {("A1", 10)}
    assert {(r.id, r.d) for r in durations(clean, "actual_start", "actual_end", "d").collect()} == {("A1", 2)}


@pytest.fixture
def small_parts(spark):
    """Files are read in parts of a few hundred bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": "400", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_nodes_by_records(spark, folder, small_parts):
    """Reading by records gives what reading whole files gives; one file is read by several tasks."""
    (folder / "large.graphml").write_text("﻿<graphml>\n" + "".join(node(f"L{i}", **TASK | {"Label": f"é {i} </ node>"}) for i in range(60)) + "</graphml>", encoding="utf-8")
    (folder / "latin.graphml").write_bytes(("<graphml>\n" + "".join(node(f"Q{i}", TaskType="TT_Task", Label="é" if i % 7 == 0 else "Ã\x83Â©"[:1] + "x") for i in range(20))).encode("latin-1"))
    path = str(folder / "*.graphml")
    whole, records = schedules.parse_nodes(schedules.text_files(spark, path)), schedules.read_nodes(spark, path)
    assert sorted(map(repr, records.collect())) == sorted(map(repr, whole.collect())) and records.count() == 86
    assert spark.read.text(str(folder / "large.graphml"), lineSep="</node>").rdd.getNumPartitions() > 5
    older = {"task_id": "ID", "limit": "Constraint"}
    assert schedules.read_nodes(spark, path, older, "source_file").columns == ["task_id", "limit", "source_file"]


def test_xer_by_lines(spark, tmp_path, small_parts):
    """Tables that cross the borders of parts keep their headers, in files of several tables and encodings."""
    import random

    rng = random.Random(2)
    for f in range(4):
        text = "ERMHDR\t19\r\n"
        for t in range(6):
            cols = [f"c{t}_{i}" for i in range(rng.randint(1, 4))]
            text += f"%T\tTABLE{t}\r\n" + "%F\t" + "\t".join(cols) + "\r\n" + "".join("%R\t" + "\t".join(f"é{f}{t}{r}{c}" for c in cols) + "\t" * (r % 3 == 0) + "\r\n" for r in range(rng.choice([0, 1, 30])))
        (tmp_path / f"p{f}.xer").write_bytes((text + "%T\tLAST\n%E\n").encode("latin-1" if f % 2 else "utf-8"))
    path = str(tmp_path / "*.xer")
    assert spark.read.text(path).rdd.getNumPartitions() > 8
    whole, lines = schedules.parse_xer(schedules.text_files(spark, path)), schedules.read_xer(spark, path)
    got, want = (sorted((r.file, r.table, sorted(r.row.items())) for r in x.collect()) for x in (lines, whole))
    assert got == want and len(got) > 50


def test_zip(spark, folder):
    with zipfile.ZipFile(folder / "up.zip", "w") as z:
        z.writestr("dir/", "")
        z.write(folder / "a.graphml", "dir/a.graphml")
        z.writestr("bom.graphml", "﻿" + node("Z", Label="ok"))
    members = schedules.zip_members(spark, str(folder / "up.zip"))
    assert sorted(r.file for r in members.collect()) == ["a.graphml", "bom.graphml"]
    assert schedules.parse_nodes(members).count() == 4
    assert not members.where("file = 'bom.graphml'").first().text.startswith("﻿")


def test_csv_and_lines(spark, tmp_path):
    (tmp_path / "t.csv").write_text(',id,name\n0,1,"a, ""b"""\n1,2,c\n')
    assert [tuple(r) for r in schedules.read_csv(spark, str(tmp_path / "t.csv"), ["name", "id"]).orderBy("id").collect()] == [('a, "b"', "1"), ("c", "2")]
    (tmp_path / "n.txt").write_text("x\ny\n")
    assert schedules.read_lines(spark, str(tmp_path / "n.txt")).count() == 2


def test_xer(spark):
    head = "ERMHDR\t19\n%T\tPROJECT\n%F\tproj_id\n%R\t7\n"
    cols = ["task_code", "task_type", "task_name", "target_start_date", "target_end_date", "act_start_date", "act_end_date", "total_float_hr_cnt", "status_code"]
    body = "%T\tTASK\n%F\t" + "\t".join(cols) + "\n%R\tT1\tTT_Task\tDig\t2020-01-01\t2020-01-03\t\t\t0\tTK\n%E\n"
    rows = schedules.parse_xer(spark.createDataFrame([("p.xer", head + body)], "file string, text string"))
    assert {r.table for r in rows.collect()} == {"PROJECT", "TASK"}
    t = schedules.xer_tasks(rows).first()
    assert (t.id, t.task_type, t.label, t.planned_end, t.actual_start) == ("T1", "TT_TASK", "Dig", "2020-01-03", "")


def test_config():
    c = config.from_ini("[run]\npercents = 1, 2\nnum_clusters = 5\nweight_silhouette = 10\nmerge_keys = no\n")
    assert c.percents == (1.0, 2.0) and c.num_clusters == 5 and c.metrics["silhouette"] == ("max", 10.0) and not c.merge_keys
    assert config.Config().metrics["silhouette"][1] == 1.0


def test_tables_and_documents(spark, tmp_path):
    name = sinks.create_table(spark, "Run Results", {"Run ID": "int", "Best %": "double"})
    try:
        sinks.append(spark.createDataFrame([(0.5, 1)], "`Best %` double, `Run ID` int"), name)
        sinks.append(spark.createDataFrame([(2, 0.7)], "`Run ID` int, `Best %` double"), name)
        assert sorted(tuple(r) for r in spark.table(name).collect()) == [(1, 0.5), (2, 0.7)]
    finally:
        spark.sql(f"DROP TABLE {name}")
    clusters = spark.createDataFrame([(1, "Key", "a", "it's \"x\"\n"), (1, "Key", "b", "y")], "cluster int, key string, id string, name string")
    days = lambda c: spark.createDataFrame([("a", 3)], f"id string, {c} int")
    docs = sinks.result_document(clusters, days("planned_days"), days("actual_days"), spark.createDataFrame([("a", "f"), ("b", "f")], "id string, file string"))
    back = {r.id: r for r in sinks.parse_document(docs).collect()}
    assert back["a"].name == "it's \"x\"\n" and back["a"].planned_days == 3 and back["b"].actual_days is None
    sinks.cluster_report(clusters, str(tmp_path / "report"))
    told = []
    sinks.commit(lambda: None, told.append, "e1")
    with pytest.raises(RuntimeError):
        sinks.commit(lambda: (_ for _ in ()).throw(RuntimeError()), told.append, "e2")
    assert told == ["e1"]


def test_stream(spark, folder):
    told = []
    for _ in range(2):  # the second run finds nothing new
        run_intake(spark, str(folder / "*.graphml"), str(folder / "out"), str(folder / "state"), told.append).awaitTermination()
    assert spark.read.parquet(str(folder / "out")).count() == 4 and told == [0]


def test_database_table(spark):
    """Written to and read from an in-memory database; the filter reaches it."""
    url, how = "jdbc:derby:memory:taskweft;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = [(1, "it's; DROP TABLE x"), (2, "b"), (3, None)]
    df = spark.createDataFrame(rows, "id int, name string")
    sinks.write_jdbc(df, url, "results", how, "overwrite")
    sinks.write_jdbc(df.where("id = 2"), url, "results", how)
    assert sorted(tuple(r) for r in schedules.read_jdbc(spark, url, "results", properties=how).collect()) == sorted([*rows, (2, "b")], key=lambda r: r[0])
    found = schedules.read_jdbc(spark, url, "results", "id = 2", how)
    assert found.count() == 2 and "EqualTo(id,2)" in found._jdf.queryExecution().executedPlan().toString()


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c'), (2, None)], "id int, name string")
    for kind in ("parquet", "csv", "json"):
        sinks.write_files(df, str(tmp_path / kind), kind)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "parquet")).collect()), key=repr) == [(1, 'a "b", c'), (2, None)]
    assert sorted(map(tuple, schedules.read_csv(spark, str(tmp_path / "csv")).collect()), key=repr) == [("1", 'a "b", c'), ("2", None)]
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_wide_table_needs_a_shared_folder(spark, monkeypatch):
    from taskweft.plans import scratch

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default="": default)

        class sparkContext:
            master, applicationId = "spark://host:7077", "x"

    with pytest.raises(ValueError, match="checkpoint"):
        scratch.checkpoint_root(Cluster)


def test_messages(spark, tmp_path, monkeypatch):
    """A restart after a failed batch neither loses nor repeats a message."""
    log, out, state = (str(tmp_path / n) for n in ("log", "out", "state"))
    results = spark.createDataFrame([("e1", "r1"), ("e2", "r2"), ("e3", "r3")], "experiment_id string, result string")
    read = lambda: sorted((r.number, r.experiment_id, r.result) for r in spark.read.parquet(out).collect())
    assert [messages.publish(log, e) for e in ("e1", "e2")] == [1, 2]
    (tmp_path / "log" / "half.tmp").write_text("{")
    run = lambda of: messages.run_results(spark, log, of, out, state).awaitTermination()
    with pytest.raises(Exception, match="lost"):
        run(results.withColumn("result", F.raise_error(F.lit("lost"))))
    assert messages.publish(log, "e3") == 3
    run(results)  # the failed batch again, as the same range
    run(results)
    assert read() == [(1, "e1", "r1"), (2, "e2", "r2"), (3, "e3", "r3")]
    run(results)  # nothing new
    messages.publish(log, "unknown")
    run(results)
    assert read()[3:] == [(4, "unknown", None)] and len(read()) == 4
    messages.run_results(spark, log, results, out, state, drop=True).awaitTermination()
    assert messages.numbers(log)[-1] == 4


def test_message_ranges(tmp_path):
    reader = messages._Reader(str(tmp_path), False)
    assert reader.latestOffset() == reader.initialOffset() and reader.partitions({"number": 2}, {"number": 2}) == []
    assert [(p.first, p.last) for p in reader.partitions({"number": 5}, {"number": 2006})] == [(6, 1005), (1006, 2005), (2006, 2006)]
    messages.publish(str(tmp_path), "a")
    messages.publish(str(tmp_path), "b")
    (tmp_path / "000000000001.json").unlink()
    assert [x[:2] for p in reader.partitions({"number": 0}, reader.latestOffset()) for x in reader.read(p)] == [(2, "b")]


def test_stored_updates(spark, tmp_path, monkeypatch):
    """Other partitions keep their files; an interrupted update leaves the old rows, or is carried on."""
    path = str(tmp_path / "t")
    spark.createDataFrame([(i, f"v{i}", "abc"[i % 3]) for i in range(12)] + [(99, "n", None)], "id int, v string, p string").write.partitionBy("p").parquet(path)
    rows = lambda: {r.id: r.v for r in stored.read(spark, path).collect()}
    files = lambda p: sorted(f.name for f in (tmp_path / "t" / p).iterdir())
    before = {p: files(f"p={p}") for p in "abc"}
    assert stored.update(spark, path, "p", (F.col("id") % 3 == 1) & (F.col("id") > 3), {"v": F.lit("new")}) == 1
    want = {i: "new" if i % 3 == 1 and i > 3 else f"v{i}" for i in range(12)} | {99: "n"}
    assert rows() == want and files("p=a") == before["a"] and files("p=c") == before["c"] and files("p=b") != before["b"]
    assert stored.update(spark, path, "p", F.col("id") == 99, {"v": F.concat("v", F.lit("!"))}) == 1
    want[99] = "n!"
    with pytest.raises(Exception, match="broken"):
        stored.update(spark, path, "p", F.col("id") == 0, {"v": F.raise_error(F.lit("broken"))})
    assert rows() == want and not [n for n in (tmp_path / "t").iterdir() if n.name.startswith("_update")]

    def stop(*_):
        raise OSError("stopped")

    with monkeypatch.context() as m:
        m.setattr(stored._Folder, "rename", stop)
        with pytest.raises(OSError):
            stored.update(spark, path, "p", F.col("id") < 2, {"v": F.lit("later")})
    assert rows() == want | {0: "later", 1: "later"}  # it was complete: the next reader carries it on
    assert stored.update(spark, path, "p", F.col("v") == "none such", {"v": F.lit("x")}) == 0
    with pytest.raises(ValueError):
        stored.update(spark, path, "p", F.lit(True), {"p": F.lit("x")})
