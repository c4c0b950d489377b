from __future__ import annotations

import pytest

from lodestrata.functions.text import glob_to_regex, indentation_max, indentation_sum, line_count
from lodestrata.operators import extract, linking, packs
from pyspark.sql import functions as F

SAMPLE = b"\nmodule shop;\n\nload stock;\nhas price: int;\nhas name: text;\n\ndo count(){\n//note\n}"
PATTERNS = [r"module (?P<mod>[a-zA-Z]+);", r"load (?P<loaded>[a-zA-Z]+);", r"has (?P<part>\w+)", r"do (?P<deed>\w+\(\))"]


def files(spark, rows):
    return spark.createDataFrame([(p, bytearray(c) if c is not None else None, 1) for p, c in rows], "path string, content binary, pattern int")


def test_offsets(spark):
    out = extract.raw_snippets(files(spark, [("x.txt", SAMPLE), ("null", None), ("empty", b"")]), [extract.Pack("p", "**", tuple(PATTERNS))]).collect()
    got = [(r["snippet_type"], r["content"], r["begin_position"]["offset"], r["end_position"]["offset"]) for r in out]
    assert sorted(got, key=lambda r: r[2]) == [
        ("mod", "shop", 8, 12), ("loaded", "stock", 20, 25), ("part", "price", 31, 36), ("part", "name", 47, 51), ("deed", "count()", 63, 70),
    ]
    first = next(r for r in out if r["content"] == "shop")
    assert (first["begin_position"]["line"], first["begin_position"]["char_in_line"]) == (2, 8)


def test_offsets_are_bytes(spark):
    text = "é\nä x".encode()
    r = extract.raw_snippets(files(spark, [("a", text)]), [extract.Pack("p", "**", ("(?P<t>x)",))]).first()
    assert (r["begin_position"]["offset"], r["begin_position"]["line"], r["begin_position"]["char_in_line"]) == (6, 2, 4)


def test_lookaround_is_refused():
    with pytest.raises(ValueError):
        packs.compiled([r"(?=a)b"])
    with pytest.raises(ValueError):
        extract.builtin_pack("cobol")


def test_lines_and_indentation(spark):
    lines = ["\t" * n + "x" for n in (0, 1, 1, 2, 2, 3, 4, 4)]
    text = "\n".join([*lines, "Total=17"])
    df = spark.createDataFrame([(text,), ("\n" * 7,), ("",), (None,), ("    a\n        b\n  c\n",)], "t string")
    got = [tuple(r) for r in df.select(line_count(F.col("t")), indentation_max(F.col("t")), indentation_sum(F.col("t"))).collect()]
    assert got[0] == (9, 4, 17) and got[1][0] == 8 and got[2] == (1, 0, 0) and got[3][0] is None and got[4] == (4, 2, 3)


@pytest.mark.parametrize("n, want", [(0, 0), (2, 0), (4, 1), (5, 1), (8, 2), (12, 3)])
def test_spaces(spark, n, want):
    df = spark.createDataFrame([(" " * n + "x\n",)], "t string")
    assert df.select(indentation_max(F.col("t"))).first()[0] == want


def test_globs():
    import re

    assert re.match(glob_to_regex("**/*.kt"), "a/b/c.kt") and re.match(glob_to_regex("**/*.kt"), "c.kt")
    assert not re.match(glob_to_regex("*.kt"), "a/c.kt") and re.match(glob_to_regex("**.cs"), "a/b.cs")
    assert re.match(glob_to_regex("{a,b}?.[!x]"), "a1.y") and not re.match(glob_to_regex("[ab].c"), "c.c")


JAVA = b"""package com.sample.models;
import com.sample.http.*;
import com.sample.id.Ids;
import net.shop.Cart;
import net.shop.list.Row;
import static net.tools.Texts.join;
import static net.tools.Texts.*;
/* class NotAType { } */
@Service("x")
public abstract class Thing extends Base {
    private final String name = "class Fake {";
    int a, b;
    @GetMapping("/x") public String get(@Path("a") int id) { int local = 1; return f(id); }
    @RequestMapping(value = "/y", method = RequestMethod.POST)
    void post() throws Exception {}
}
interface Other { void call(); }
record Pair(int a, int b) {}
"""


def test_java():
    found, counts = packs.java(JAVA, ignored=())
    got = {}
    for kind, _, _, value in found:
        got.setdefault(kind, []).append(value.decode())
    assert got[packs.DECLARATIONS] == ["com.sample.models"]
    assert got[packs.IMPORTS] == ["com.sample.http", "com.sample.id", "net.shop", "net.shop.list", "net.tools.Texts", "net.tools.Texts"]
    assert got[packs.TYPES] == ["Thing", "Other", "Pair"] and got[packs.ABSTRACT] == ["Thing", "Other"]
    assert got["java__spring__service"] == ["Thing"] and got["java__method_declaration"] == ["get", "post", "call"]
    assert got["java__field__declaration"] == ["name", "a"]
    n = dict(counts)
    assert n["java__spring__services"] == 1 and n["java__spring__beans"] == 1
    assert n["java__spring__request_mappings__total"] == 2 and n["java__spring__request_mappings__get"] == 1 and n["java__spring__request_mappings__post"] == 1
    assert packs.IMPORTS not in {k for k, *_ in packs.java(b"import java.util.List;\nimport javatools.x.Y;\n")[0]}


def test_byte_order_marks_do_not_hide_the_first_line():
    assert packs.java(b"\xef\xbb\xbfpackage a.b;\n")[0][0] == (packs.DECLARATIONS, 11, 14, b"a.b")
    assert packs.csharp(b"\xef\xbb\xbfusing A.B;\n")[0][0] == (packs.IMPORTS, 9, 12, b"A.B")


def test_csharp():
    code = b"""using System;
using A = Some.Thing;
namespace Acme.Web.Controllers
{
    public interface IA {}  interface IB<T> {}
    public abstract class C : D { }
    class E { string s = "class F {"; }
    struct G { }
    public record struct H(int x);
}
"""
    found, _ = packs.csharp(code)
    got = {}
    for kind, _, _, value in found:
        got.setdefault(kind, []).append(value.decode())
    assert got[packs.DECLARATIONS] == ["Acme.Web.Controllers"] and got[packs.IMPORTS] == ["System", "Some.Thing"]
    assert len(got[packs.TYPES]) == 6 and got[packs.ABSTRACT] == ["IA", "IB", "C"]


def test_linking(spark):
    raw = extract.raw_snippets(
        files(spark, [("a/x", b"unit a\nunit z\nneeds b"), ("b/y", b"unit b\nneeds a\nneeds nowhere"), ("q", b"needs a")]),
        [extract.Pack("p", "**", (r"unit (?P<modularity__component__declarations>[a-z]+)", r"needs (?P<modularity__component__imports>[a-z]+)"))],
    )
    s = linking.declared_components(raw)
    assert {(r["file"], r["component"]) for r in s.collect()} == {("a/x", "a"), ("b/y", "b"), ("q", "Unknown")}
    assert {(r["from"], r["to"]) for r in linking.connections(s).collect()} == {("a", "b"), ("b", "a"), ("Unknown", "a")}


def test_directories(spark):
    dirs = spark.createDataFrame([("src",), ("src/web/page/form",), ("src/db",), ("doc/img",), (".",)], "directory string")
    got = {r[0] for r in linking.closed_directories(dirs).collect()}
    assert got == {"src", "src/web", "src/web/page", "src/web/page/form", "src/db", "doc", "doc/img"}
    snippets = spark.createDataFrame([("a/b/f",), ("a/bc/f",), ("r",)], "file string")
    assert {tuple(r) for r in linking.directory_files(snippets).collect()} == {("a", "a/b/f"), ("a/b", "a/b/f"), ("a", "a/bc/f"), ("a/bc", "a/bc/f")}
