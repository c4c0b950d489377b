"""The whole engine over a small tree: views, sinks, command line."""

from __future__ import annotations

import datetime as dt
import json
import os
import pathlib
import sqlite3
import subprocess
import sys

import pytest

from lodestrata.plans.engine import Engine, Extension, PackExtension, select_views, snippets_extension, sort_view
from lodestrata.operators import graph
from lodestrata.operators.extract import Pack, builtin_pack
from lodestrata.plans.definitions import load_definitions
from lodestrata.sources import filetree, sinks
from pyspark.sql import functions as F

TREE = {
    "shop/cart": "\nunit shop\n\nneeds stock\nneeds mail", "shop/list": "\nunit shop\n\nneeds stock", "stock/count": "\nunit stock\n\nneeds mail\nneeds mail",
    "mail/send": "\nunit mail\n\nneeds shop\nneeds log", "log/all": "\nunit log",
}
PATTERNS = [r"unit (?P<modularity__component__declarations>[a-z]+)", r"needs (?P<modularity__component__imports>[a-z]+)"]


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for p, c in TREE.items():
        (root / p).parent.mkdir(exist_ok=True)
        (root / p).write_text(c)
    return str(root)


@pytest.fixture(scope="module")
def analysis(spark, tree):
    return Engine(spark, [snippets_extension(PATTERNS)]).analyze(filetree.read_tree(spark, tree))


def test_components(analysis):
    got = {r["name"]: r.asDict() for r in analysis.view("components").collect()}
    assert {n: (v["complexity__files"], v["complexity__lines"], v["modularity__component__imports"]) for n, v in got.items()} == {
        "shop": (2, 9, 3), "stock": (1, 5, 2), "mail": (1, 5, 2), "log": (1, 2, 0),
    }
    assert got["shop"]["modularity__instability"] == pytest.approx(2 / 3) and got["log"]["modularity__distance_main_sequence"] == 1.0
    assert got["stock"]["cycles__short__count"] == 1 and got["mail"]["graph__betweenness"] == 3


def test_other_views(analysis):
    total = {r["name"]: r["value"] for r in analysis.view("summary").collect()}
    assert [float(total[k]) for k in ("complexity__files", "complexity__lines", "component_count", "connection_count", "directory_count")] == [5, 21, 4, 7, 4]
    assert float(total["modularity__component__declarations"]) == 5 and float(total["modularity__component__imports"]) == 7
    assert {r["name"]: r["complexity__files"] for r in analysis.view("directories").collect()} == {"shop": 2, "stock": 1, "mail": 1, "log": 1}
    files = {r["name"]: (r["directory"], r["component"]) for r in analysis.view("files").collect()}
    assert files["shop/cart"] == ("shop", "shop")
    groups = {r["component"]: r["group_size"] for r in analysis.view("component_strongly_connected_groups").collect()}
    assert groups == {"shop": 3, "stock": 3, "mail": 3, "log": 1}
    assert analysis.view("component_cycles_shortest").count() == 4 + 3
    assert {r["component"] for r in analysis.view("component_communities").collect()} == {"shop", "stock", "mail", "log"}
    assert analysis.view("definitions").count() == 13
    with pytest.raises(ValueError):
        analysis.view("nothing")
    with pytest.raises(ValueError):
        analysis.view("files", ["nothing"])
    with pytest.raises(ValueError):
        analysis.view("git_authors").count()


def test_extension_hooks(spark, tree):
    class Mine(Extension):
        def register(self, engine):
            engine.views["mine"] = lambda a: a.source.groupBy().count()
            engine.accumulators["weight"] = F.max
            engine.file_records.append(lambda f: f.select(F.col("path").alias("file"), F.lit("weight").alias("stat_type"), F.length("content").cast("double").alias("value")))

    a = Engine(spark, [snippets_extension(PATTERNS), Mine(), PackExtension(builtin_pack("java"))]).analyze(filetree.read_tree(spark, tree))
    assert a.view("mine").first()[0] == 5
    sizes = {n: max(len(c) for p, c in TREE.items() if p.startswith(n)) for n in ("shop", "stock", "mail", "log")}
    assert {r["name"]: r["weight"] for r in a.view("directories").collect()} == sizes
    # the same accumulator makes the total
    assert {r["name"]: r["value"] for r in a.view("summary").collect()}["weight"] == str(float(max(sizes.values())))


def test_packs_that_only_count_or_go_by_folder(spark, tree):
    files = filetree.read_tree(spark, tree)
    only = Pack("units", "**", (PATTERNS[0],), only_stats=True)
    a = Engine(spark, [PackExtension(only)]).analyze(files)
    assert a.view("snippets").count() == 0
    assert {r["name"]: r["modularity__component__declarations"] for r in a.view("files").collect()} == dict.fromkeys(TREE, 1)
    some = Engine(spark, [PackExtension(Pack("p", "**", tuple(PATTERNS), by_directory=True))]).analyze(files)
    assert {(r["file"], r["component"]) for r in some.snippets.collect()} == {(p, p.split("/")[0]) for p in TREE}
    few = Engine(spark, [PackExtension(Pack("p", "**", (PATTERNS[1],), limit=1))]).analyze(files)
    assert few.snippets.where("file = 'stock/count'").count() == 1


def test_history_in_the_views(spark, tree):
    """Counts are of the parts of all files of a row, each commit and author once; files without a commit have none."""
    rows = [
        ("shop", "c1", dt.datetime(2024, 12, 30), "shop/cart", "Ann", 5, 1), ("shop", "c1", dt.datetime(2024, 12, 30), "shop/list", "Ann", 2, 0),
        ("shop", "c2", dt.datetime(2024, 10, 1), "shop/cart", "Bo", 1, 1), ("", "c3", dt.datetime(2024, 12, 31), "stock/count", "Ann", None, None),
    ]
    parts = spark.createDataFrame(rows, "repo string, commit_hash string, commit_time timestamp, file string, author string, additions int, deletions int")
    parts = parts.withColumn("component", F.lit(None).cast("string"))
    a = Engine(spark, [snippets_extension(PATTERNS)], based_on="2025-01-01 00:00:00").analyze(filetree.read_tree(spark, tree), parts)
    names = ["git__repository", "git__age_in_days", "git__commits__total", "git__authors__total", "git__additions__total", "git__commits__last_30_days", "git__unique_file_changes__total"]
    of = lambda v: {r["name"]: tuple(r[c] for c in names) for r in a.view(v).collect()}
    files, folders, units = of("files"), of("directories"), of("components")
    assert files["shop/cart"] == ("shop", 92, 2, 2, 6, 1, 1) and files["log/all"] == ("", 0, 0, 0, 0, 0, 0)
    # the ages of its two files differ, so the smaller one is the commonest
    assert folders["shop"] == units["shop"] == ("shop", 2, 2, 2, 8, 1, 2) and units["log"] == ("", 0, 0, 0, 0, 0, 0)
    total = {r["name"]: r["value"] for r in a.view("summary").collect()}
    assert (total["git__commits__total"], total["git__authors__total"], total["git__additions__total"]) == ("3", "2", "8")


def test_edges_there_or_not(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "from string, to string")
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), (None, "a"), ("a", "b")], "from string, to string")
    got = sorted(((r["from"] or "", r["to"], r["from_to"], r["between"]) for r in graph.has_edges(edges, pairs).collect()))
    assert got == [("", "a", False, False), ("a", "b", True, True), ("a", "b", True, True), ("a", "c", False, False), ("b", "a", False, True)]


def test_definitions_from_files(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "x.yaml").write_text("id: lines\nname: 'Lines of a file'\nshort: \"quoted \\\"so\\\"\"\nlong: |\n  first\n  second\nother: 1\n")
    (tmp_path / "sub" / "y.yml").write_text("id: z\nlong: goes on\n  and on\n")
    (tmp_path / "no.txt").write_text("id: no")
    assert load_definitions(str(tmp_path)) == [("z", "", "", "goes on and on"), ("lines", "Lines of a file", 'quoted "so"', "first\nsecond")]


def test_sorting(spark):
    df = spark.createDataFrame([(7,), (None,), (3,), (11,), (5,)], "v long")
    assert [r[0] for r in sort_view(df).collect()] == [11, 7, 5, 3, None]
    assert [r[0] for r in sort_view(spark.createDataFrame([("pear",), ("fig",)], "s string")).collect()] == ["fig", "pear"]


def test_view_selection():
    abc = ["a", "b", "c"]
    assert select_views(abc) == abc and select_views(abc, exclude=["b"]) == ["a", "c"] and select_views(abc, exclude=["b", "c"]) == ["a"]
    assert select_views(abc, ["b"]) == ["b"] and select_views(abc, ["b", "c"]) == ["b", "c"] and select_views(abc, ["c"], ["b"]) == ["c"]
    for bad in ({"include": ["x"]}, {"exclude": ["x"]}):
        with pytest.raises(ValueError):
            select_views(abc, **bad)


def test_formats(spark):
    df = spark.createDataFrame([("x,y", 1.5), (None, float("nan"))], "name string, v double").coalesce(1)
    assert list(sinks.render(df, "csv")) == ["name,v", '"x,y",1.5', "-,nan"]
    assert list(sinks.render(df, "csv", header=False))[0] == '"x,y",1.5'
    assert list(sinks.render(df, "tsv"))[0] == "name\tv"
    assert [json.loads(x) for x in sinks.render(df, "ndjson")] == [{"name": "x,y", "v": 1.5}, {"name": None, "v": None}]
    assert json.loads("\n".join(sinks.render(df.limit(0), "json"))) == []
    assert json.loads("\n".join(sinks.render(df, "json"))) == [{"name": "x,y", "v": 1.5}, {"name": None, "v": None}]
    assert list(sinks.render(df, "table")) == ["NAME  V", "x,y   1.5", "-     nan"] and list(sinks.render(df.limit(0), "table")) == ["NAME  V"]
    with pytest.raises(ValueError):
        list(sinks.render(df, "xml"))


def test_sqlite(spark, tmp_path):
    db = str(tmp_path / "r.db")
    one = spark.createDataFrame([("x", 1)], "name string, v long")
    sinks.save_sqlite(db, {"t": one}, "r1", dt.datetime(2024, 1, 1))
    sinks.save_sqlite(db, {"t": one.withColumn("w", F.lit(2.5))}, "r2")
    sinks.save_sqlite(db, {"t": one.union(one)}, "r1")
    rows = sqlite3.connect(db).execute('SELECT report_id, name, v, w FROM "t" ORDER BY 1, 2').fetchall()
    assert rows == [("r1", "x", 1, None), ("r1", "x", 1, None), ("r2", "x", 1, 2.5)]


def test_report_folder_is_replaced(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(1,), (2,)], "v long")
    for rep, rows in (("r1", df), ("r2", df), ("r1", df.limit(1))):
        sinks.write_report(rows, path, rep)
    assert {r["report_id"]: r["count"] for r in spark.read.parquet(path).groupBy("report_id").count().collect()} == {"r1": 1, "r2": 2}


def test_walker(spark, tmp_path):
    for p in ("top.md", "trash.tmp", "web/app.js", "web/trash.tmp", "web/style.gen", "doc/sheet.csv", "doc/old.md", "style.gen", "sub dir/a+b%20c.txt"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("x")
    for p, rules in {".gitignore": "*.tmp\n# no\n\n", "web/.gitignore": "*.gen", "doc/.gitignore": "old.md"}.items():
        (tmp_path / p).write_text(rules)
    got = {r["path"] for r in filetree.read_tree(spark, str(tmp_path)).collect()}
    assert got == {"./top.md", "./style.gen", "web/app.js", "doc/sheet.csv", "sub dir/a+b%20c.txt"}
    # the same by the file system that Spark knows
    other = filetree.read_tree(spark, f"file://{tmp_path}")
    assert {r["path"] for r in other.collect()} == got
    assert filetree.read_rules(f"file://{tmp_path}", True, spark) == filetree.read_rules(str(tmp_path), True)


def test_rules(spark):
    def kept(rules, *paths):
        rs = [r for x in rules if (r := filetree.rule(x))]
        df = spark.createDataFrame([(p,) for p in paths], "p string")
        return {r[0] for r in df.where(~filetree.ignored(F.col("p"), rs)).collect()}

    assert kept(["build/", "!build/keep"], "build/x", "a/build/y", "build/keep", "buildx") == {"build/keep", "buildx"}
    assert kept(["/top.txt", "a/*.c", "**/z", "q/**"], "top.txt", "s/top.txt", "a/x.c", "b/a/x.c", "m/z", "q/w/e") == {"s/top.txt", "b/a/x.c"}


def test_command_line(tree, capsys, monkeypatch):
    from lodestrata import cli

    args = ["-f", tree, *[x for p in PATTERNS for x in ("-s", p)]]
    assert cli.main([*args, "view", "component_connections_direct", "-o", "csv", "-c", "from, to", "--no-header"]) == 0
    lines = capsys.readouterr().out.split()
    assert lines == ["mail,log", "mail,shop", "shop,mail", "shop,stock", "shop,stock", "stock,mail"]
    assert cli.main([*args, "view", "component_cycles_largest"]) == 1


def test_real_history(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a b.txt").write_text("1\n2\n")
    run("add", "-A")
    run("-c", "user.name=Ann", "-c", "user.email=a@x", "commit", "-qm", "first -- one")
    from lodestrata.sources import gitlog

    out = gitlog.commit_parts(gitlog.raw_commits(gitlog.read_logs(spark, str(tmp_path)))).collect()
    assert [(r["file"], r["additions"], r["author"], r["message"]) for r in out] == [("a b.txt", 2, "Ann", "first -- one")]


def test_workers_have_the_package(tmp_path):
    """A session started elsewhere runs Python stages of this package."""
    code = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "from lodestrata import build_session\n"
        "from lodestrata.operators.extract import Pack, raw_snippets\n"
        "s = build_session(cpus=1)\n"
        "f = s.createDataFrame([('a', bytearray(b'xy'))], 'path string, content binary')\n"
        "print(raw_snippets(f, [Pack('p', '**', ('(?P<t>x)',))]).count())\n"
    )
    root = str(pathlib.Path(__file__).resolve().parent.parent)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code, root], cwd=tmp_path, capture_output=True, text=True, env=env, timeout=180, check=False)
    assert out.stdout.split()[-1:] == ["1"], out.stderr[-2000:]
