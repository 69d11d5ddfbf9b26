"""Dialect, templates, sources, sinks and jobs on small fixtures."""

from __future__ import annotations

import json
import math
import uuid
from datetime import UTC, datetime
from pathlib import Path

import pytest
from quernflow import cli
from quernflow.jobs import Job, Task, Validation, load_job, run_job
from quernflow.jobs import loader, records
from quernflow.jobs.dag import DagError, build, table_names
from quernflow.plans.engine import Catalog
from quernflow.plans.parser import SqlError
from quernflow.session import DIALECT
from quernflow.sources.store import Place
from quernflow.sources import InputFile, OutputFile, read_input, write_output
from quernflow.temporal import TemplateError, TemporalVariables

AT = TemporalVariables(datetime(2026, 1, 1, 5, 30, 21, tzinfo=UTC))


@pytest.fixture
def views(spark):
    catalog = Catalog(spark)

    def make(**tables):
        for name, (schema, rows) in tables.items():
            catalog.register(name, catalog.spark.createDataFrame(rows, schema))
        return lambda sql: [tuple(r) for r in catalog.sql(sql, "strict").collect()]

    return make


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("{{ today }}", "20260101"), ("{{today-30}}", "20251202"), ("{{ yesterday - 1 }}", "20251230"), ("{{ current_hour - 13 }}", "16"),
        ("{{ current_minute - 31 }}", "59"), ("{{ iso_datetime - 1 }}", "2026-01-01T05:30:20"), ("{{ current_dow }}", "4"), ("{{ month_pad }}", "01"),
        ("{{ year_month - 1 }}", "202512"), ("{{ current_quarter }}", "1"), ("{{ epoch_seconds }}", "1767245421"), ("a {{ iso_date }} b", "a 2026-01-01 b"),
    ],
)
def test_templates(text, want):
    assert AT.render(text) == want


@pytest.mark.parametrize("text", ["{{ nope }}", "{{ today + }}", "{{ today 3 }}"])
def test_bad_templates(text):
    with pytest.raises(TemplateError):
        AT.render(text)


def test_month_ends_are_clamped():
    assert TemporalVariables(datetime(2024, 1, 31, tzinfo=UTC)).render("{{ current_month + 1 }}") == "2"


def test_ranks_and_frames(views):
    sql = views(ties=("score int", [(x,) for x in (100, 90, 90, 80, 70, 70, 70, 60)]), v=("id int, val int", [(i, i) for i in range(1, 6)]))
    assert sorted(sql("SELECT RANK() OVER (ORDER BY score DESC) r, DENSE_RANK() OVER (ORDER BY score DESC) d FROM ties")) == [(1, 1), (2, 2), (2, 2), (4, 3), (5, 4), (5, 4), (5, 4), (8, 5)]
    assert sorted(sql("SELECT id, SUM(val) OVER (ORDER BY id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) s FROM v")) == [(1, 3), (2, 6), (3, 9), (4, 12), (5, 9)]
    assert sorted(sql("SELECT id, LAG(val, 2, -1) OVER (ORDER BY id) l FROM v")) == [(1, -1), (2, -1), (3, 1), (4, 2), (5, 3)]


def test_whole_and_ieee_division(views):
    sql = views(t=("a int, b int, x double", [(7, 2, 1.0), (-7, 2, -1.0), (7, 0, 0.0)]))
    assert sql("SELECT a / b, a % b FROM t") == [(3, 1), (-3, -1), (None, None)]
    got = [r[0] for r in sql("SELECT x / (x - x) FROM t")]
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2])
    assert sql("SELECT 2147483647 + 1 AS n FROM t LIMIT 1") == [(-2147483648,)]


def test_functions(views):
    sql = views(t=("a int, b int, c int", [(1, 5, 3), (None, 7, 2), (None, None, None)]), one=("x double", [(1.0,)]))
    assert sql("SELECT GREATEST(a, b, c), LEAST(a, b, c) FROM t") == [(5, 1), (7, 2), (None, None)]
    assert sql("SELECT ROUND(-2.5), FLOOR(1.5), TRUNC(-3.789, 2), SIGN(-4), SUBSTRING('hello', -3, 2), LENGTH(TRIM(' \t a b \n')) FROM one") == [(-2.0, 1.0, -3.78, -1, "he", 3)]
    assert sql("SELECT LN(0), RAND(42) FROM one")[0] == (-math.inf, pytest.approx(0.7275636800328681))
    assert sql("SELECT CASE WHEN 10 < '9' THEN 1 ELSE 0 END FROM one") == [(1,)]


def test_groups_and_nulls(views):
    sql = views(g=("cat string, v int", [("A", 1), (None, 2), ("A", 3), (None, 4), ("B", 5)]), e=("x int", []))
    assert sorted(sql("SELECT cat, SUM(v) FROM g GROUP BY 1"), key=str) == [("A", 4), ("B", 5), (None, 6)]
    assert sql("SELECT COUNT(*), SUM(x), COUNT_IF(x > 1) FROM e") == [(0, None, 0)]
    assert sql("SELECT cat FROM g GROUP BY cat HAVING COUNT(*) > 1 ORDER BY SUM(v) DESC") == [(None,), ("A",)]
    assert sorted(sql("SELECT cat, RANK() OVER (ORDER BY COUNT(*) DESC) FROM g GROUP BY cat"), key=str) == [("A", 1), ("B", 3), (None, 1)]


@pytest.mark.parametrize(
    ("query", "part"),
    [
        ("SELECT nope FROM g", "Available"), ("SELECT a.cat FROM g a JOIN g b ON a.v = b.v WHERE cat = 'A'", "Ambiguous"), ("SELECT * FROM zzz", "Known views"),
        ("", "empty"), ("DELETE FROM g", "Only SELECT"), ("SELECT cat FROM g UNION SELECT cat, v FROM g", "columns"), ("SELECT cat FROM g GROUP BY 3", "position"),
        ("SELECT cat FROM g WHERE COUNT(*) > 1", "WHERE"), ("SELECT foo(v) FROM g", "Unknown function"), ("SELECT v FROM g LIMIT x", "LIMIT"),
        ("SELECT v FROM g INTERSECT SELECT v FROM g", "INTERSECT"), ("SELECT v FROM (SELECT v FROM g)", "tables"),
    ],
)
def test_errors(views, query, part):
    sql = views(g=("cat string, v int", [("A", 1)]))
    with pytest.raises(SqlError, match=part):
        sql(query)


def test_nonequi_guard(spark):
    catalog = Catalog(spark)
    catalog.register("big", catalog.spark.range(20).toDF("x"))
    with pytest.raises(SqlError, match="at most 5 rows"):
        catalog.sql("SELECT a.x FROM big a JOIN big b ON a.x < b.x", "strict", max_nonequi_rows=5)


def test_csv_inference_and_quotes(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_text('i,l,d,b,day,t,name\n1,3000000000,1,true,2026-01-01,2026-01-01T00:00:01Z,"smith, ""j"""\n\n2,4,2.5,FALSE,2025-12-31,2026-01-01T00:00:02,"two\nlines"\n3\n')
    df = read_input(spark, InputFile("v", str(p)))
    assert [t for _, t in df.dtypes] == ["int", "bigint", "double", "boolean", "date", "timestamp", "string"]
    rows = df.collect()
    assert rows[0].name == 'smith, "j"' and rows[1].name == "two\nlines" and rows[2].l is None


def test_csv_output(spark, tmp_path):
    df = spark.createDataFrame([(1, " a ", datetime(2026, 1, 1, 0, 0, 0, 123456)), (2, None, None)], "id int, s string, t timestamp").coalesce(1)
    names = write_output(df, OutputFile(str(tmp_path / "o")))
    assert names == ["part-00000.csv"]
    assert (tmp_path / "o" / names[0]).read_text() == "id,s,t\n1, a ,2026-01-01T00:00:00.123456Z\n2,,\n"
    with pytest.raises(NotImplementedError):
        write_output(df, OutputFile("s3://x/y"))


def test_tables_of_a_query(spark):
    sql = "WITH c AS (SELECT * FROM a) SELECT * FROM c JOIN B ON c.x = b.x WHERE x IN (SELECT y FROM d) AND EXISTS (SELECT 1 FROM e)"
    assert table_names(spark, sql) == {"a", "b", "d", "e"}


def make_job(tmp_path, bad=False):
    loader.new_project(str(tmp_path / "job"))
    base = str(tmp_path / "job")
    (tmp_path / "job/data/events.csv").write_text("user_id,event,amount\n1,buy,10\n2,buy,5\n1,view,0\n3,buy,7\n")
    (tmp_path / "job/data/users.csv").write_text("user_id,tier\n1,gold\n2,silver\n3,gold\n")
    for v in ("events", "users"):
        loader.save_input(base, v, {"path": f"data/{v}.csv", "cache": True})
    loader.save_table(base, "enriched", "SELECT u.tier, e.amount FROM events e JOIN users u ON e.user_id = u.user_id WHERE e.event = 'buy'", {"format": "parquet"})
    loader.save_table(base, "by_tier", "SELECT '{{ today }}' AS day, tier, SUM(amount) AS spend FROM enriched GROUP BY tier", {"partitionBy": "day={{ today }}", "maxPartitions": 1})
    loader.save_validation(base, "enriched", "No Null Tiers", "SELECT * FROM enriched WHERE tier IS NULL" if not bad else "SELECT * FROM enriched WHERE tier = 'gold'")
    return base


@pytest.mark.parametrize("mode", ["native", "strict"])
def test_directory_job(spark, tmp_path, mode):
    base = make_job(tmp_path)
    result = run_job(spark, load_job(base, execution_time=AT.execution_time, mode=mode))
    assert result.succeeded, [(t.name, t.error) for t in result.tasks]
    out = tmp_path / "job/output/by_tier/day=20260101"
    assert sorted((out / "part-00000.csv").read_text().split()) == ["20260101,gold,17", "20260101,silver,5", "day,tier,spend"]
    record = json.loads((out / "_run.json").read_text())
    assert record["status"] == "Succeeded" and record["rowsProduced"] == 2 and record["outputFiles"] == ["part-00000.csv"]
    assert json.loads((tmp_path / "job/output/job.json").read_text())["succeeded"]
    assert len(records.history(spark, str(tmp_path / "job/output/by_tier/day={{ today }}"))) == 1
    assert records.layout(spark, str(tmp_path / "job/output"))[0] == "single"
    again = run_job(spark, load_job(base, execution_time=AT.execution_time, mode=mode))
    assert again.succeeded and not again.warnings


def test_outputs_in_a_store_that_only_spark_reads(spark, tmp_path):
    (tmp_path / "store").mkdir()
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.jobs.link./out", (tmp_path / "store").as_uri())
    top = "viewfs://jobs/out/run"
    for _ in range(2):
        result = run_job(spark, load_job(make_job(tmp_path / uuid.uuid4().hex, bad=True), top, AT.execution_time))
        assert {t.name: t.status for t in result.tasks} == {"enriched": "ValidationFailed", "by_tier": "Skipped", "example_summary": "Succeeded"}
        assert not result.warnings
    kept = sorted(p.name for p in (tmp_path / "store/run/enriched").iterdir() if not p.name.startswith("."))  # without the checksums of the store below
    assert kept == ["_run.json", "_validation-no_null_tiers.csv", "part-00000.parquet"]
    assert records.layout(spark, top) == ("single", [top]) and records.layout(spark, f"{top}/none") == ("empty", [])
    found = records.history(spark, f"{top}/{{{{ x }}}}")
    assert sorted(r["directory"] for r in found) == [f"{top}/enriched", f"{top}/example_summary"]


def test_command_line(spark, tmp_path, capsys):
    before = {k: spark.conf.get(k) for k in DIALECT}
    job = str(tmp_path / "job")
    (tmp_path / "t.psv").write_text("k|v\n1|2\n1|3\n2|\n")
    assert cli.main(["init", job]) == 0
    assert cli.main(["add-input", job, "t", str(tmp_path / "t.psv"), "--option", "delimiter=|", "--no-cache"]) == 0
    assert cli.main(["add-table", job, "sums", "SELECT k, SUM(v) AS s FROM t GROUP BY k", "--format", "parquet", "--max-partitions", "1"]) == 0
    assert cli.main(["add-validation", job, "sums", "no nulls", "SELECT * FROM sums WHERE k IS NULL"]) == 0
    assert json.loads((tmp_path / "job/inputs/t/input.json").read_text()) == {"path": str(tmp_path / "t.psv"), "cache": False, "options": {"delimiter": "|"}}
    assert cli.main(["delete", job, "table", "example_summary"]) == 0
    assert cli.main(["dag", job]) == 0 and "0 sums" in capsys.readouterr().out
    assert cli.main(["run", job]) == 0
    assert cli.main(["runs", job]) == 0 and '"rowsProduced": 2' in capsys.readouterr().out
    assert cli.main(["sql", job, "SELECT SUM(s) AS total FROM sums", "--save", f"{job}/adhoc"]) == 0 and "5" in capsys.readouterr().out
    assert (tmp_path / "job/adhoc/part-00000.csv").read_text() == "total\n5\n"
    assert cli.main(["peek", f"{job}/output/sums"]) == 0 and "rows: 2" in capsys.readouterr().out
    assert cli.main(["delete", job, "validation", "sums", "no nulls"]) == 0 and not list((tmp_path / "job/tables/sums/validations").iterdir())
    with pytest.raises(ValueError, match="no view name"):
        cli.main(["add-table", job, "1x", "SELECT 1"])
    for k, v in before.items():  # the commands' session is this one
        spark.conf.set(k, v)


def test_places(spark, tmp_path):
    place = Place(spark, str(tmp_path)) / "a" / "b.txt"
    assert not place.exists() and not place.is_file() and place.parent.children() == []
    place.write_text("één\n")
    place.write_text("twee é\n")
    assert place.read_text() == "twee é\n" == (tmp_path / "a/b.txt").read_text()
    assert [p.name for p in place.parent.children()] == ["b.txt"] and (Place(spark, f"{tmp_path}/*/b.*")).matching()[0].path == str(place)
    place.move(Place(spark, f"{tmp_path}/c/d"))
    place.delete()
    assert (tmp_path / "c/d").is_file() and Place(spark, f"{tmp_path}/c").is_dir()


def test_failed_validation_skips(spark, tmp_path):
    result = run_job(spark, load_job(make_job(tmp_path, bad=True), execution_time=AT.execution_time))
    status = {t.name: t.status for t in result.tasks}
    assert status == {"enriched": "ValidationFailed", "by_tier": "Skipped", "example_summary": "Succeeded"}
    folder = Path(result.task("enriched").directory)
    assert (folder / "_validation-no_null_tiers.csv").is_file() and (folder / "part-00000.parquet").is_file()
    assert result.task("enriched").validations[0].failed_rows == 2


def test_failed_input_skips_only_its_dependents(spark, tmp_path):
    good = tmp_path / "a.csv"
    good.write_text("x\n1\n")
    job = Job(
        (InputFile("a", str(good)), InputFile("b", str(tmp_path / "none.csv"))),
        (Task("ta", "SELECT x FROM a"), Task("tb", "SELECT * FROM b"), Task("tc", "SELECT * FROM tb")),
    )
    assert {t.name: t.status for t in run_job(spark, job).tasks} == {"ta": "Succeeded", "tb": "Skipped", "tc": "Skipped"}


@pytest.mark.parametrize(
    ("tasks", "part"),
    [
        ([Task("a", "SELECT * FROM b"), Task("b", "SELECT * FROM a")], "cycle"), ([Task("a", "SELECT * FROM a")], "own view"), ([Task("a", "SELECT * FROM zz")], "unknown view"),
        ([Task("i", "SELECT * FROM i")], "both an input"), ([Task("a", "SELECT * FROM i"), Task("A", "SELECT * FROM i")], "Two tasks"),
        ([Task(v, "SELECT * FROM i", output=OutputFile("/tmp/same")) for v in "ab"], "same path"),
    ],
)
def test_graph_errors(spark, tasks, part):
    with pytest.raises(DagError, match=part):
        build(spark, Job((InputFile("i", "/tmp/x.csv"),), tuple(tasks)))


def test_validation_may_read_its_own_view(spark):
    nodes = build(spark, Job((InputFile("i", "/tmp/x.csv"),), (Task("a", "SELECT * FROM i", validations=(Validation("v", "SELECT * FROM a"),)),)))
    assert nodes[0].waits == set()


def test_plans(spark):
    """Filters and columns reach the scan, top-k is fused."""
    from quernflow.operators.queries import queries

    def plan(name):
        return queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()

    assert "TakeOrderedAndProject" in plan("topk")
    text = plan("filter_between")
    assert "PushedFilters: [IsNotNull" in text and "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double,l_discount:double>" in text
    assert "CartesianProduct" not in plan("join_comma")


def test_editing_refuses_names_in_use(tmp_path):
    base = str(tmp_path / "job")
    loader.new_project(base)
    with pytest.raises(FileExistsError):
        loader.new_project(base)
    for save in (lambda v: loader.save_input(base, v, {"path": "x.csv"}), lambda v: loader.save_table(base, v, "SELECT 1")):
        for used in ("example", "EXAMPLE", "example_summary"):
            with pytest.raises(FileExistsError):
                save(used)
    loader.save_input(base, "example", {"path": "y.csv"}, replace=True)
    loader.save_table(base, "example_summary", "SELECT 2", replace=True)
    with pytest.raises(FileExistsError):
        loader.save_table(base, "example", "SELECT 2", replace=True)
    loader.save_validation(base, "example_summary", "No rows", "SELECT 1")
    with pytest.raises(FileExistsError):
        loader.save_validation(base, "example_summary", "No rows", "SELECT 2")
    for bad in ("../x", "a/b", "..", "", ".hidden", None):
        with pytest.raises(ValueError):
            loader.save_validation(base, "example_summary", bad, "SELECT 1")
        with pytest.raises(ValueError):
            loader.delete(base, "validation", "example_summary", bad)
    with pytest.raises(FileNotFoundError):
        loader.save_validation(base, "no_table", "x", "SELECT 1")
    loader.delete(base, "validation", "example_summary", "No rows")


def test_count_distinct_windows(spark):
    """Whole partitions and running frames, with NULLs, ties in the order and windows inside expressions."""
    catalog = Catalog(spark)
    rows = [(i, i % 3, None if i % 4 == 0 else i * i % 7, i // 2) for i in range(40)]
    catalog.register("t", catalog.spark.createDataFrame(rows, "i int, p int, x int, o int"))
    got = {r.i: r for r in catalog.sql("SELECT i, COUNT(DISTINCT x) OVER (PARTITION BY p) AS a, 1 + COUNT(DISTINCT x) OVER (PARTITION BY p ORDER BY i DESC) AS b, COUNT(DISTINCT x + 1) OVER (PARTITION BY p ORDER BY o) AS c FROM t ORDER BY COUNT(DISTINCT x) OVER (PARTITION BY p), i", "strict").collect()}
    for i, p, _, o in rows:
        whole = {x for _, q, x, _ in rows if q == p and x is not None}
        down = {x for j, q, x, _ in rows if q == p and x is not None and j >= i}
        least = {x for j, q, x, k in rows if q == p and x is not None and (k < o or j == i)}
        most = {x for _, q, x, k in rows if q == p and x is not None and k <= o}
        assert got[i].a == len(whole) and got[i].b == 1 + len(down) and len(least) <= got[i].c <= len(most)
    plan = catalog.sql("SELECT COUNT(DISTINCT x) OVER (PARTITION BY p ORDER BY i) AS n FROM t", "strict")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan


def test_shared_folder_is_needed_on_clusters(spark):
    from quernflow import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        def __init__(self, master):
            self.master = master

        def getConf(self):  # noqa: N802
            return Conf()

    class Session:
        def __init__(self, master):
            self.sparkContext = Context(master)

    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_path(Session(master), "x")
    one, two = (session.shared_path(spark, "x") for _ in range(2))
    assert one != two and Place(spark, one).children() == []


def test_correlation_with_a_constant_is_null_however_rows_are_dealt(spark):
    catalog = Catalog(spark)  # partial means of 49 ones come out of a merge as 0.9999999999999999
    catalog.register("t", catalog.spark.range(0, 98, 1, 2).selectExpr("CAST(id AS double) AS x", "1 AS one", "IF(id % 7 = 0, NULL, 0.1D) AS gaps", "IF(id < 60, id, NULL) AS part", "IF(id < 60, 3, id) AS late", "IF(id = 5, double('nan'), 2D) AS odd"))
    row = catalog.sql("SELECT CORR(x, 1) a, CORR(one, x) b, CORR(x, gaps) c, CORR(part, late) d, CORR(one, gaps) e, CORR(x, x + x) f, CORR(x, -part) g, CORR(one, odd) h FROM t", "strict").first()
    assert tuple(row)[:5] == (None,) * 5
    assert row.f == pytest.approx(1) and row.g == pytest.approx(-1) and math.isnan(row.h)
    assert catalog.sql("SELECT CORR(x, one) a FROM t WHERE x < 0 UNION ALL SELECT CORR(x, x) FROM t WHERE x = 3", "strict").collect() == [(None,), (None,)]


def test_count_star_reads_footers_only(spark, tmp_path):
    """A count takes no column: it comes from the files' footers even where every data page is damaged."""
    path = tmp_path / "t"
    spark.range(50_000).selectExpr("id", "id * 3 AS x").coalesce(1).write.option("compression", "none").parquet(str(path))
    (part,) = path.glob("part-*.parquet")
    raw = bytearray(part.read_bytes())
    footer = int.from_bytes(raw[-8:-4], "little") + 8
    raw[4 : len(raw) - footer] = bytes(len(raw) - footer - 4)
    part.write_bytes(raw)
    for crc in path.glob(".*.crc"):
        crc.unlink()
    catalog = Catalog(spark)
    catalog.register("t", catalog.spark.read.parquet(str(path)))
    assert [r.n for r in catalog.sql("SELECT COUNT(*) AS n FROM t", "strict").collect()] == [50_000]
    with pytest.raises(Exception, match="(?i)parquet|decode|page|read"):
        catalog.sql("SELECT SUM(x) AS s FROM t", "strict").collect()
