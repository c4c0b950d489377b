from __future__ import annotations

import random

import pytest

from lodestrata.llm.handwritten import UNIFORM, lex, named_files, not_handwritten, reason, uniformity

CODE = "package a.b;\n\nimport x.y.Z;\n\npublic class Thing {\n" + "".join(f"    void call{c}(Foo bar) {{\n        bar.go({i});\n    }}\n" for i, c in enumerate("ABCDEF")) + "}\n"
ACCESSORS = "class P {\n" + "".join(f"    public int getField{i}() {{ return this.f_{i}_; }}\n    public void setField{i}(int v) {{ this.f_{i}_ = v; bits |= 0x1; }}\n" for i in range(12)) + "}\n"
BEAN = "class P {\n" + "".join(f"    public String get{n}() {{ return this.{n.lower()}; }}\n    public void set{n}(String {n.lower()}) {{ this.{n.lower()} = {n.lower()}; }}\n" for n in ("Digest", "Bridge", "Depot", "Quota", "Vault", "Parcel")) + "}\n"
MINIFIED = "!function(l){q&&l.merge(t)}(130);" + "".join(f"i.session{i}=function(w){{x(w,{i})}};for(var s=0;s<c.length;s++)q(c[s]);" for i in range(30))


@pytest.mark.parametrize(
    "path, text, want",
    [
        ("p/src/A.java", "// Code generated by tool v1.2. DO NOT EDIT.\n" + CODE, "generated"),
        ("p/src/A.java", CODE.replace("import", "/*\n * AUTOMATICALLY GENERATED FILE - do not modify by hand\n */\nimport", 1), "generated"),
        ("p/src/A.kt", "// Diese Datei wurde automatisch erzeugt (x). Nicht von Hand ändern.\n" + CODE, "generated"),
        ("p/q.sql", "-- <auto-generated> This code was produced by x; changes are lost. </auto-generated>\nselect 1;", "generated"),
        ("p/src/A.java", CODE.replace("public class", '@Generated(value = "x")\npublic class'), "generated"),
        ("p/src/A.java", ACCESSORS, "generated"),
        ("p/x_pb2.py", "A = 1", "generated"),
        ("p/deps.lock", "a==1", "generated"),
        ("p/src-gen/A.java", CODE, "generated"),
        ("p/web/a.js", "/*! grid v1.2.3 | (c) 2020 grid contributors | MIT License */\nlet a;", "third party"),
        ("p/tools/a.py", "# Copied from grid at revision abc1, local changes: none\na = 1", "third party"),
        ("p/third_party/grid/a.js", "let a;", "third party"),
        ("p/web/a.js", MINIFIED, "minified"),
        ("p/web/a.min.css", "a{b:c}", "minified"),
        ("p/t.cs", "class T { static int[] X = {" + ", ".join(f"0x{i * 7919 % 65536:04x}" for i in range(300)) + "}; }", "data"),
        ("p/t.js", 'const x = "' + "Ab9/+" * 400 + '";', "data"),
        ("p/s.sql", "".join(f"INSERT INTO t VALUES ({i}, 'x', {i * 991}, {i * 7});\n" for i in range(60)), "data"),
        # nobody's case
        ("p/src/A.java", CODE, None),
        ("p/src/A.java", BEAN, None),
        ("p/src/A.java", "// The generated stubs live in the build directory; this file is edited by hand.\n" + CODE, None),
        ("p/src/A.java", "// Not generated. Please keep it readable.\n" + CODE, None),
        ("p/src/A.java", CODE.replace("void callA", 'static final String HEAD = "Code generated by x. DO NOT EDIT.";\n    void callA'), None),
        ("p/src/GeneratedThing.java", CODE, None),
        ("grid-app/src/A.java", "// This file is part of grid-app. Copyright 2020 The Authors\n" + CODE, None),
        ("p/src/A.java", "// Copyright (c) 2020 the p developers. All rights reserved.\n" + CODE, None),
        ("p/src/vendor/page.py", "# Vendor master data\ndef a(): return 1", None),
        ("p/src/min-graph.js", CODE, None),
        ("p/src/Q.java", CODE.replace("void callA", 'static final String SQL = "select ' + "worker stock from table where a b " * 20 + '";\n    void callA'), None),
        ("p/README.md", "Files that say `Code generated by x. DO NOT EDIT.` are left out.", None),
        ("p/a.java", "", None),
        ("p/a.java", None, None),
    ],
)
def test_reasons(path, text, want):
    got = reason(path, None if text is None else text.encode("utf-8"))
    assert (got is None) if want is None else (got is not None and got.startswith(want)), got


def test_encodings():
    head = "// Fichier généré par x, ne pas modifier.\r\n" + CODE
    for data in (b"\xef\xbb\xbf" + head.encode(), head.encode("utf-16"), head.encode("cp1252")):
        assert reason("p/A.java", data) == "generated: comment"
    assert (reason("p/A.java", bytes(range(256)) * 4) or "data").startswith("data")


def test_frames(spark):
    files = spark.createDataFrame([("p/a_pb2.py", bytearray(b"x"), 1), ("p/b.java", None, 1), (None, bytearray(b"y"), 1), ("p/b.java", bytearray(CODE.encode()), 1)], "path string, content binary, reason int")
    assert [tuple(r) for r in not_handwritten(files).collect()] == [("p/a_pb2.py", "generated: path")]
    parts = spark.createDataFrame([("p/a_pb2.py",), ("p/a_pb2.py",), ("gone/vendor/x/y.js",), (None,)], "file string")
    snips = spark.createDataFrame([("p/a_pb2.py",)], "file string")
    got = {r["path"]: (r["commit_rows"], r["snippet_rows"]) for r in named_files(parts, snips, files).collect()}
    assert got == {"p/a_pb2.py": (2, 1), "gone/vendor/x/y.js": (1, 0)}
    assert not_handwritten(files.limit(0)).count() == 0


def test_canonical_form():
    seen = lex("package a;  // x\nint  f(int a,int b){return a+b;}\n\n/* y */ String s=\"a;b\";", "java")
    assert seen.canonical().split("\n") == ["package a;", "int f(int a, int b) {", "return a + b;", "}", 'String s = "a;b";']
    assert [h for h, _ in seen.comments] == [True, False] and seen.code_lines == 3
    assert lex("a = 1\nb = f(1,\n  2)\n", "py").canonical() == "a = 1\nb = f(1, 2)"


def wrapped(text, width):
    """``text`` with line ends after ``;`` and braces, once a line has ``width`` characters."""
    out, line = [], ""
    for c in text:
        line += c
        if len(line) >= width and c in ";{}":
            out.append(line)
            line = ""
    return "\n".join([*out, line])


@pytest.mark.parametrize("width", [80, 150, 400, 10_000])
def test_minified_at_any_width(width):
    assert reason("p/web/a.js", wrapped(MINIFIED, width).encode()) == "minified: layout"


def test_layout_of_long_lines_counts_to_their_end():
    head = "x" * 500
    counting = "".join(f"call({head}, {i});\n" for i in range(12))
    rng = random.Random(2)
    free = "".join(f"call({head}, {rng.randrange(10**6)}, {rng.choice('abcdef')}{rng.randrange(99)});\n" for i in range(12))
    assert reason("p/a.java", counting.encode()) == "generated: layout" and reason("p/a.java", free.encode()) is None


def test_marks_of_third_parties_count_at_the_head_only_however_long_it_is():
    head = "package a.b;\n" + "".join(f"import x.y{i}.Thing{i};\n" for i in range(60))
    mark = "/* grid v1.2.3 | (c) 2020 grid contributors | MIT License */\n"
    assert reason("p/A.java", (head + mark + CODE.split("\n", 4)[4]).encode()) == "third party: comment"
    assert reason("p/A.java", (CODE + mark).encode()) is None


def statements(lines):
    return lex("\n".join(lines), "java").statements


@pytest.mark.parametrize("seed", range(5))
def test_names_in_order_are_evidence_names_out_of_order_are_none(seed):
    rng = random.Random(seed)
    names = sorted({"".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(10)})
    block = lambda ns: [x for n in ns for x in (f"int {n};", f"boolean has_{n};")]
    assert uniformity(statements(block(names))) >= UNIFORM
    shuffled = names[1::2] + names[::2][::-1]
    assert uniformity(statements(block(shuffled))) < UNIFORM
    steps = [f"if (tag == {2 + 8 * i}) {{ this.{n} = read(); mask |= {1 << i}; }}" for i, n in enumerate(names)]
    assert uniformity(statements(steps)) > 2 * UNIFORM
    assert uniformity(statements([f"set({rng.randrange(1000)});" for _ in range(40)])) < UNIFORM


def test_most_is_seen_in_the_layout(spark):
    """Comments, annotations and paths are the last resort: most generated, minified and data files are known without them."""
    files = spark.read.parquet("/root/testdata/sf0.1/source_files.parquet")
    found = [r["reason"] for r in not_handwritten(files).collect() if not r["reason"].startswith("third party")]
    assert sum(r.endswith(("layout", "literals")) for r in found) >= 0.8 * len(found)


def test_odd_contents():
    for text in ("\x00\x01", "{", "}" * 5000, "(" * 5000, '"' * 4001, "x" * 200_000, "١ ٢ ٣\n" * 50, "/*", "0x" * 50, "case １: a;\ncase ２: b;\n" * 9):
        reason("p/a.java", text.encode())
