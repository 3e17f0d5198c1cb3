import pytest
from pyspark.sql import functions as F

from graphloom.functions.lexer import parse_source
from graphloom.functions.parse import init_parser, parse_file, register_parse_imports, with_imports
from graphloom.functions.paths import is_supported, language_of, language_of_name


def one(text, language="typescript"):
    (found,) = parse_source(text, language)
    return found


@pytest.mark.parametrize(
    "text, source, specifiers, kind",
    [
        ("import knob from 'dials';", "dials", ["knob"], "esm"),
        ("import { left, right } from 'sides';", "sides", ["left", "right"], "esm"),
        ("import { left as port } from 'sides';", "sides", ["port"], "esm"),
        ("import * as tools from './shed';", "./shed", ["* as tools"], "esm"),
        ("import 'shims';", "shims", [], "esm"),
        ("import Panel, { dock, undock } from 'panels';", "panels", ["Panel", "dock", "undock"], "esm"),
        ("import { lamp } from '../hall/lamp';", "../hall/lamp", ["lamp"], "esm"),
        ("const knob = require('dials');", "dials", ["knob"], "cjs"),
        ("const { left, right } = require('sides');", "sides", ["left", "right"], "cjs"),
        ("const { left: a, right = 1, ...c } = require('m');", "m", ["a"], "cjs"),
        ("require('on-load');", "on-load", [], "cjs"),
        ("const y = require('x').y;", "x", [], "cjs"),
        ("const a: Kind = require('x');", "x", ["a"], "cjs"),
        ("export { left, right as q } from './sides';", "./sides", ["left", "right"], "esm"),
        ("export * from './sides';", "./sides", ["*"], "esm"),
        ("export * as ns from './sides';", "./sides", [], "esm"),
        ("import type { Kind } from './kinds';", "./kinds", ["Kind"], "esm"),
        ("import type Kind from './kinds';", "./kinds", ["Kind"], "esm"),
        ("import { type A, type B as C } from 'u';", "u", ["A", "C"], "esm"),
        ("const f = async () => import('lazy');", "lazy", [], "esm"),
        ("import(x, 'second');", "second", [], "esm"),
        ("import a from './a' with { type: 'json' };", "./a", ["a"], "esm"),
    ],
)
def test_forms(text, source, specifiers, kind):
    found = one(text)
    assert (found.source, found.specifiers, found.type, found.line) == (source, specifiers, kind, 1)


def test_order_and_lines():
    text = "\nimport one from 'p1';\n\nconst two = require('p2');\nexport * from 'p3';\nimport('p4');\nimport again from 'p1';"
    found = parse_source(text)
    assert [(x.source, x.line) for x in found] == [("p1", 2), ("p2", 4), ("p3", 5), ("p4", 6), ("p1", 7)]


@pytest.mark.parametrize(
    "text",
    [
        "// import 'a'",
        "/* require('b') \n import 'c' */",
        "const s = \"import 'c'\"",
        "const t = `import 'd' \\` require('x')`",
        "const r = /require('g')/g",
        "a.require('h'); a?.require('h'); require.resolve('i'); new require('k')",
        "import(`template`); require(`t`); require('a' + b)",
        "import x = require('y')",
        "import.meta.url; const o = { import: 1, export: 2 }",
        "const s = 'it\\'s import'; x = a / b / require",
    ],
)
def test_nothing_to_find(text):
    assert parse_source(text) == []


def test_nested_places():
    assert [x.source for x in parse_source("const t = `${require('e')} ${`${import('f')}`}`")] == ["e", "f"]
    assert [x.source for x in parse_source("const x = <div title='a'>Don't import 'b' {require('c')}<br/></div>; const k = require('d')", "tsx")] == ["c", "d"]
    assert [x.source for x in parse_source("const f = <T,>(x: T) => require('a'); let v = <T>(1)", "tsx")] == ["a"]
    assert [x.source for x in parse_source("function a(){ return /'/.test(x) } import q from 'r'")] == ["r"]


def test_bad_source_and_language():
    assert parse_source("const = ] } ` ${ ( import") == []
    assert [x.source for x in parse_source("{{{ import a from 'b'")] == ["b"]
    assert parse_source(None) == []
    with pytest.raises(ValueError):
        parse_source("", "python")
    with pytest.raises(ValueError):
        init_parser("python")


def test_deep_nesting():
    depth = 5_000
    assert [x.source for x in parse_source("`${" * depth + "require('x')" + "}`" * depth)] == ["x"]
    assert [x.source for x in parse_source("<a>{" * depth + "require('x')" + "}</a>" * depth, "tsx")] == ["x"]
    assert [x.source for x in parse_source("(" * depth + "{[" * depth + "import('x')")] == ["x"]


def test_file(tmp_path):
    file = tmp_path / "a.mts"
    file.write_text("import 'x'")
    assert [x.source for x in parse_file(str(file))] == ["x"]
    with pytest.raises(ValueError):
        parse_file(str(tmp_path / "a.css"))


def test_languages(spark):
    names = {"a.ts": "typescript", "a.tsx": "tsx", "a.mts": "typescript", "a.cts": "typescript", "a.JS": "javascript", "a.jsx": "jsx", "a.mjs": "javascript", "a.cjs": "javascript", "a.json": None, "a.css": None, "a.py": None, ".ts": None, "x/.eslintrc.js": "javascript", "noext": None, "a.b.TSX": "tsx"}
    df = spark.createDataFrame([(k,) for k in names], "p string")
    got = {r.p: (r.l, r.s) for r in df.select("p", language_of(F.col("p")).alias("l"), is_supported(F.col("p")).alias("s")).collect()}
    assert got == {k: (v, v is not None) for k, v in names.items()}
    assert {k: language_of_name(k) for k in names} == names


def test_columns_and_table_function(spark):
    rows = [("/a.ts", "typescript", "import {x} from './b'"), ("/b.ts", "typescript", None), ("/c.zz", "cobol", "")]
    got = {r.path: r for r in with_imports(spark.createDataFrame(rows, "path string, language string, content string")).collect()}
    assert got["/a.ts"].imports[0].specifiers == ["x"] and got["/a.ts"].errors == []
    assert got["/b.ts"].imports == [] and len(got["/b.ts"].errors) == 1 and "Unsupported" in got["/c.zz"].errors[0]
    register_parse_imports(spark)
    found = spark.sql("SELECT i.* FROM VALUES ('import a from \"q\"') AS t(s), LATERAL parse_imports(s, 'typescript') AS i").collect()
    assert [(r.source, r.specifiers, r.type, r.line) for r in found] == [("q", ["a"], "esm", 1)]


@pytest.mark.parametrize("before", ["const f = <T{}extends X,>(x: T) => x;", "const f = <{}T,>(x: T) => x;", "const e = <div>text<{}/div>;"])
def test_white_space_of_any_length_in_angles(before):
    found = parse_source(before.format(" " * 600) + "\nimport a from './after';", "tsx")
    assert [x.source for x in found] == ["./after"]
