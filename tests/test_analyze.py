import json

import pytest
from pyspark.sql import functions as F

from graphloom import cli
from graphloom.functions.paths import dirname, ignores, is_external, normalise, relative, should_ignore
from graphloom.operators import viewer as V
from graphloom.operators.cycles import find_cycles
from graphloom.operators.graph import Graph
from graphloom.operators.resolve import candidates, lookup
from graphloom.plans import analyze as A, report as R
from graphloom.schema import DEFAULT_EXTENSIONS, AnalyzerOptions
from graphloom.sources import scan


def tree(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(root)


def edges(result, root):
    return sorted((r.src.removeprefix(root + "/"), r.dst.removeprefix(root + "/")) for r in result.graph.edges.collect())


FILES = {
    "a.ts": "import './x'; import './m.js'; import './style.css'; import '.'; import 'react'; import '@/x'; import './missing'; import './x'",
    "x.ts": "",
    "x/index.ts": "import '..'",
    "m.ts": "import './node_modules/dep'",
    "style.css": "",
    "index.ts": "import '.'\nimport('./x.ts')",
    "node_modules/dep.js": "import '../a'",
    "t.test.ts": "import './a'",
}


def test_directory(spark, tmp_path):
    root = tree(tmp_path, FILES)
    result = A.analyze_directory(spark, root, AnalyzerOptions(ignore_patterns=["*.test.ts"], path_aliases={"@/*": ["./*"]}))
    assert edges(result, root) == sorted([("a.ts", "x.ts"), ("a.ts", "m.ts"), ("a.ts", "style.css"), ("a.ts", "index.ts"), ("x/index.ts", "index.ts"), ("m.ts", "node_modules/dep.js"), ("index.ts", "index.ts"), ("index.ts", "x.ts")])
    stats = result.stats.first()
    assert stats.totalFiles == 7 and stats.totalDependencies == 8 and stats.circularDependencies == 1
    assert [r.file_path.removeprefix(root + "/") for r in result.graph.ordered_nodes().collect()] == ["a.ts", "x.ts", "m.ts", "style.css", "index.ts", "node_modules/dep.js", "x/index.ts"]
    assert A.has_circular_dependencies(spark, root)


def test_aliases(spark, tmp_path):
    root = tree(tmp_path, {"a.ts": "import '@lib'; import '@/u'; import '/abs'", "src/lib.ts": "", "src/u.ts": ""})
    aliases = {"@lib": ["src/lib", "never"], "@/*": ["src/*"], "none": []}
    plain = A.analyze_directory(spark, root, AnalyzerOptions(path_aliases=aliases))
    assert edges(plain, root) == [("a.ts", "src/lib.ts")]
    strict = A.analyze_directory(spark, root, AnalyzerOptions(path_aliases=aliases, strict_aliases=True))
    assert edges(strict, root) == [("a.ts", "src/lib.ts"), ("a.ts", "src/u.ts")]


def test_missing_and_empty(spark, tmp_path, capsys):
    result = A.analyze_directory(spark, str(tmp_path / "none"))
    assert result.graph.node_count() == 0 and result.stats.first().totalFiles == 0
    assert cli.analyze(spark, str(tmp_path / "none")) == 0 and "No TypeScript/JavaScript files found." in capsys.readouterr().out
    assert cli.analyze(spark, str(tmp_path / "none"), "json") == 0 and json.loads(capsys.readouterr().out)["cycles"] == []


def test_reports(spark, tmp_path, capsys):
    root = tree(tmp_path, {"a.ts": "import './b'", "b.ts": "import './a'", "c.ts": ""})
    assert cli.analyze(spark, root, "json") == 1
    out = json.loads(capsys.readouterr().out)
    assert out["graph"] == {"nodes": ["a.ts", "b.ts", "c.ts"], "edges": [{"from": "a.ts", "to": "b.ts"}, {"from": "b.ts", "to": "a.ts"}]}
    assert out["cycles"] == [{"chain": ["b.ts", "a.ts", "b.ts"], "length": 2}] and out["stats"]["topDependencies"][0]["file"] == root + "/a.ts"
    assert cli.analyze(spark, root, "text") == 1
    text = capsys.readouterr().out
    assert "1. b.ts → a.ts → b.ts → b.ts" in text and "Files involved: 2" in text and "Found 1 circular dependency chain:" in text
    result = A.analyze_directory(spark, root)
    data = V.load(spark, R.viewer_json(result))
    assert V.node_records(data).count() == 3
    R.write_report(result, root, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/edges")).count() == 2


def test_report_texts(spark, tmp_path):
    """The text made by the executors is the one that the json module writes, with odd names and empty lists; written ranges give it again."""
    odd = 'q"\\\n\x0b\x1f\u20ac\U0001f600'
    pairs = [("/r/" + a, "/r/" + b) for a, b in [("a", "b"), ("b", "a"), (odd, "a"), ("c", "c"), ("a", odd)]]
    for links, failed in ((pairs, [("/r/z", odd), ("/q/y", "no")]), ([], []), (pairs[2:3], []), ([], [("/r/z", "no")])):
        graph = Graph.from_edges(spark, links, "/r") if links else Graph.empty(spark, "/r")
        errors = spark.createDataFrame(failed, "file string, error string")
        cycles = find_cycles(graph)
        result = A.AnalysisResult(graph, cycles, A.graph_stats(graph, cycles), errors, "/r")
        t = {name: [r.asDict(recursive=True) for r in df.collect()] for name, df in R.report_tables(result, "/r").items()}
        want = json.dumps({"stats": t["stats"][0], "cycles": t["cycles"], "graph": {"nodes": [r["node"] for r in t["nodes"]], "edges": t["edges"]}, "errors": t["errors"]}, indent=2, ensure_ascii=False)
        assert R.json_report(result, "/r") == want
        R.write_report(result, "/r", str(tmp_path / "out"))
        for part, text in (("json", want), ("text", R.text_report(result, "/r"))):
            files = sorted((tmp_path / "out" / part).glob("part-*"))
            assert "".join(f.read_text(newline="") for f in files) == text + "\n"


def test_errors_are_listed(spark):
    rows = [(f"/r/f{i}.ts", "typescript", None) for i in range(7)]
    sources = spark.createDataFrame(rows, "path string, language string, content string")
    text = R.text_report(A.analyze_sources(sources, sources.select("path"), "/r"), "/r")
    assert "7 file(s) had parsing errors" in text and "... and 2 more" in text and "f4.ts" in text and "f5.ts" not in text


def test_scan(spark, tmp_path):
    root = tree(tmp_path, {"a.ts": "", "dist/b.ts": "", "k/c.d.ts": "", "k/d.TSX": "", "e.css": "", ".gitignore": "# no\n\n/a.ts\nskip\n!keep\n", "skip/z.ts": "", "q.js": ""})
    short = [p.removeprefix(root + "/") for p in scan.discover_files(root)]
    assert short == ["a.ts", "k/c.d.ts", "k/d.TSX", "q.js", "skip/z.ts"]
    assert scan.parse_gitignore(spark, root) == ["a.ts", "**/skip", "**/!keep"] and scan.parse_gitignore(spark, root + "/k") == []
    assert [p.removeprefix(root + "/") for p in scan.list_source_files(spark, root)] == ["q.js"]
    with pytest.raises(FileNotFoundError, match="Directory not found"):
        scan.list_source_files(spark, root + "/nowhere")
    with pytest.raises(NotADirectoryError, match="Not a directory"):
        scan.list_source_files(spark, root + "/a.ts")
    sources, every = scan.scan_store(spark, root)
    assert sorted(r.path.removeprefix(root + "/") for r in sources.collect()) == short and every.count() >= 7


def test_paths(spark):
    df = spark.createDataFrame([("/a/./b/../c//d/",), ("/../x",), ("/",)], "p string")
    assert [r[0] for r in df.select(normalise(F.col("p"))).collect()] == ["/a/c/d", "/x", "/"]
    df = spark.createDataFrame([("/r/a",), ("/r",), ("/q/z",), ("/rr/a",)], "p string")
    assert [r[0] for r in df.select(relative(F.col("p"), "/r")).collect()] == ["a", "", "../q/z", "../rr/a"]
    assert [r[0] for r in df.select(dirname(F.col("p"))).collect()] == ["/r", "/", "/q", "/rr"]
    cases = {"./x": False, "../y": False, "lodash": True, "@s/p": True, "@name": False, "/abs": False, "node:fs": True, "src/a": True, "#x": True, "~/x": True}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.e for r in df.select("s", is_external(F.col("s")).alias("e")).collect()} == cases
    df = spark.createDataFrame([("/p/a.test.ts",), ("/p/src/test/x.ts",), ("/p/axts",)], "p string")
    ignored = lambda *p: [r[0] for r in df.select(should_ignore(F.col("p"), list(p))).collect()]
    assert ignored("*.test.ts") == [True, False, False] and ignored("test") == [True, True, False] and ignored("a?ts") == [False] * 3 and ignored("*a.ts") == [False, False, True] and ignored() == [False] * 3


def test_lookup_of_files(spark):
    """What the suffixes of files tell is what the candidates of each target say, in their order."""
    extensions = [*DEFAULT_EXTENSIONS, ".d.ts", ""]
    names = ["t", "t.js", "t.d", "t/index", "index", "", "t.ts", "t.js.js", "t/index.js"]
    ways = [stem + x for stem in names for x in ["", *extensions, *("/index" + y for y in extensions), ".js.ts", ".js.tsx"]]
    every = sorted({"/" + w.strip("/") for w in ways})
    wanted = spark.createDataFrame([(p,) for p in every], "target string")
    for step in (1, 2, 3, 5, 7):
        files = spark.createDataFrame([(p,) for p in every[::step]], "path string")
        tried = wanted.select("target", F.posexplode(F.transform(candidates(F.col("target"), extensions), lambda x: F.regexp_replace(x, "^//", "/"))).alias("pos", "path"))
        brute = tried.join(files, "path").groupBy("target").agg(F.min_by("path", "pos").alias("resolved"))
        found = lookup(files, extensions).join(wanted, "target")
        assert sorted(map(tuple, found.select("target", "resolved").collect())) == sorted(map(tuple, brute.collect()))


def test_ignored_by_the_last_segment(spark):
    """A pattern with an asterisk fits the whole path or the last segment, in both forms alike."""
    paths = ["/a/b/c.ts", "/a/bc.ts", "b", "/x\ny/b.ts", "/a.b/c", "/a/b/"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    for pattern, want in {"b*": [0, 1, 1, 1, 0, 0], "/a*": [1, 1, 0, 0, 1, 1], "*c": [0, 0, 0, 0, 1, 0], "a.b": [0, 0, 0, 0, 1, 0], "?c*": [0, 1, 0, 0, 0, 0], "": [1] * 6, "b|x*": [0, 1, 1, 1, 0, 0]}.items():
        assert [int(r[0]) for r in df.select(should_ignore(F.col("p"), [pattern])).collect()] == [int(ignores(p, [pattern])) for p in paths]
        if "|" not in pattern:
            assert [int(ignores(p, [pattern])) for p in paths] == want, pattern


def test_viewer(spark):
    text = json.dumps({"nodes": {n: {"filePath": n, "dependencies": d, "dependents": []} for n, d in {"s/a.ts": ["s/b.ts", "s/b.ts", "gone"], "s/b.ts": ["s/a.ts"], "c.ts": ["s/a.ts"]}.items()}, "cycles": [{"chain": ["s/a.ts", "s/b.ts", "s/a.ts"], "length": 2}], "rootDir": "/"})
    data = V.load(spark, text)
    records, cycles = V.node_records(data), data.select(F.explode("cycles").alias("c")).select("c.*")
    nodes, links = V.view_nodes(records, cycles), V.view_edges(records, cycles)
    assert {r.id: r.inCycle for r in nodes.collect()} == {"s/a.ts": True, "s/b.ts": True, "c.ts": False}
    assert {r.id: r.inCycle for r in links.collect()} == {"s/a.ts->s/b.ts": True, "s/a.ts->gone": False, "s/b.ts->s/a.ts": True, "c.ts->s/a.ts": False}
    kept, inner = V.filter_elements(nodes, links, "S/?.TS")
    assert kept.count() == 2 and inner.count() == 2
    assert V.filter_elements(nodes, links, "", True)[1].count() == 2 and V.filter_elements(nodes, links, "a(b")[0].count() == 0
    assert V.view_stats(kept, inner, cycles).first().asDict() == {"nodes": 2, "edges": 2, "cycles": 1}
    assert V.selected_node(nodes, "c.ts").count() == 1 and V.selected_node(nodes, "zz").count() == 0
    dim_nodes, dim_edges = V.dim_elements(nodes, links, "^s/")
    assert {r.id: r.dimmed for r in dim_nodes.collect()} == {"s/a.ts": False, "s/b.ts": False, "c.ts": True} and not dim_edges.filter("dimmed").count()
    assert not V.dim_elements(nodes, links, "(")[0].filter("dimmed").count()
    marked, lines = V.highlight_elements(nodes, links, ["s/a.ts", "s/b.ts"], "c.ts")
    assert marked.filter("highlighted").count() == 2 and marked.filter("selected").count() == 1 and lines.filter("highlighted").count() == 2
    assert {r.name for r in V.file_name(nodes).collect()} == {"a.ts", "b.ts", "c.ts"}
    assert sorted(r.id for r in V.render_edges(links).collect())[0] == "edge-c.ts-s/a.ts-0"
    with pytest.raises(ValueError):
        V.load(spark, "{broken")


def test_viewer_sample(spark):
    records, cycles = V.sample(spark)
    assert records.count() == V.SAMPLE["stats"]["totalFiles"] and V.view_edges(records, cycles).count() == V.SAMPLE["stats"]["totalDependencies"]
    assert sorted(records.filter("id = 'src/services/api.ts'").first().dependents) == ["src/app.ts", "src/components/Button.tsx"]
    assert sorted(r.id for r in V.view_nodes(records, cycles).filter("inCycle").collect()) == ["src/services/api.ts", "src/services/auth.ts"]


def test_contents_are_read_by_executors(spark, tmp_path):
    """Odd bytes and names survive; what is ignored is not opened, whatever its size."""
    root = tree(tmp_path, {"a.ts": "import './b'", "[id].ts": "import './a'", "node_modules/x.ts": "", "e.ts": ""})
    (tmp_path / "b.ts").write_bytes(b"// caf\xe9 \xff\nimport './[id]'")
    with open(tmp_path / "node_modules/huge.ts", "wb") as huge:
        huge.truncate(3 << 30)  # beyond what a binary value may hold
    for sources in (scan.read_sources(spark, scan.discover_files(root)), scan.scan_store(spark, root)[0]):
        found = {r.path.removeprefix(root + "/"): r.content for r in sources.collect()}
        assert set(found) == {"a.ts", "b.ts", "[id].ts", "e.ts"} and found["e.ts"] == "" and "\ufffd" in found["b.ts"]
    assert edges(A.analyze_directory(spark, root), root) == [("[id].ts", "a.ts"), ("a.ts", "b.ts"), ("b.ts", "[id].ts")]
    gone = scan.read_sources(spark, [root + "/a.ts", root + "/gone.ts"]).filter("content IS NULL").collect()
    assert [r.path for r in gone] == [root + "/gone.ts"]


def test_alias_to_the_base(spark, tmp_path):
    root = tree(tmp_path, {"a.ts": "import './b/x'", "x.ts": ""})
    for to in ("", "./*"):
        assert edges(A.analyze_directory(spark, root, AnalyzerOptions(path_aliases={"./b/*": [to]})), root) == [("a.ts", "x.ts")]


def test_public_names():
    import graphloom

    assert all(getattr(graphloom, name) for name in graphloom.__all__)
    assert [x.source for x in graphloom.init_parser("tsx")("import 'q'")] == ["q"]


def test_files_stand_for_paths_by_few_rows(spark):
    from graphloom.operators.resolve import candidates, lookup
    from graphloom.schema import DEFAULT_EXTENSIONS

    paths = ["/a.ts", "/a.d.ts", "/b/index.ts", "/b.tsx", "/index.js", "/c.d.ts/index.d.ts", "/plain", "/x.mts", "/b"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    for extensions in (list(DEFAULT_EXTENSIONS), [".d.ts", ".ts", ".js"]):
        found = {r["target"]: r["resolved"] for r in lookup(files, extensions).collect()}
        asked = spark.createDataFrame([(t,) for t in found], "t string").select("t", candidates(F.col("t"), extensions).alias("c"))
        want = {r["t"]: next(x for x in r["c"] if x in paths) for r in asked.collect() if r["t"] != "/"}
        assert {t: p for t, p in found.items() if t != "/"} == want
    # of each file four rows, not one for each suffix
    plan = lookup(files, list(DEFAULT_EXTENSIONS))._jdf.queryExecution().analyzed().toString()
    assert plan.lower().count("case when endswith") == 4
