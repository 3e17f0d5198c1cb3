"""Cases that the registered queries deal out over the events, each with its stated result.

``{k}`` stands for the event's link, ``{n}`` for its number.
"""

from __future__ import annotations

#: By kind: text, language, and the imports to find as (source, specifiers, type, line).
FORMS: dict[str, list[tuple[str, str, list[tuple[str, list[str], str, int]]]]] = {
    "static": [
        ("import 'pkg{k}';", "typescript", [("pkg{k}", [], "esm", 1)]),
        ("import whole from './d{k}';", "typescript", [("./d{k}", ["whole"], "esm", 1)]),
        ('import { one, two } from "./n{k}"', "javascript", [("./n{k}", ["one", "two"], "esm", 1)]),
        ("import { one as uno, type Two } from './a{k}';", "typescript", [("./a{k}", ["uno", "Two"], "esm", 1)]),
        ("import * as all from './s{k}';", "tsx", [("./s{k}", ["* as all"], "esm", 1)]),
        ("import whole, { one as uno } from './m{k}';", "jsx", [("./m{k}", ["whole", "uno"], "esm", 1)]),
        ("import type { Shape } from './t{k}';", "typescript", [("./t{k}", ["Shape"], "esm", 1)]),
    ],
    "dynamic": [
        ("const lazy = () => import('./l{k}');", "javascript", [("./l{k}", [], "esm", 1)]),
        ("import(name, 'late{k}');", "javascript", [("late{k}", [], "esm", 1)]),
        ("import(`./t{k}`);", "javascript", []),
        ('async function f() {\n  await import("./w{k}");\n}', "typescript", [("./w{k}", [], "esm", 2)]),
    ],
    "require": [
        ("const one = require('./r{k}');", "javascript", [("./r{k}", ["one"], "cjs", 1)]),
        ("const { a, b: c, d = 1, ...rest } = require('./o{k}');", "javascript", [("./o{k}", ["a", "c"], "cjs", 1)]),
        ("require('./e{k}');", "javascript", [("./e{k}", [], "cjs", 1)]),
        ("const y = require('./p{k}').y;", "typescript", [("./p{k}", [], "cjs", 1)]),
        ("obj.require('./x{k}'); require.resolve('./x{k}'); require(`./x{k}`);", "javascript", []),
    ],
    "reexport": [
        ("export { a, b as c } from './e{k}';", "typescript", [("./e{k}", ["a", "b"], "esm", 1)]),
        ("export * from './s{k}';", "typescript", [("./s{k}", ["*"], "esm", 1)]),
        ("export * as ns from './s{k}';", "typescript", [("./s{k}", [], "esm", 1)]),
        ("export const x = './s{k}'.length;", "typescript", []),
    ],
    "other": [
        ("import x = require('./y{k}');", "typescript", []),
        ("// import './c{k}'\nimport './real{k}';", "typescript", [("./real{k}", [], "esm", 2)]),
        ("/* require('./c{k}') */ const s = \"import './s{k}'\"; import './real{k}'", "javascript", [("./real{k}", [], "esm", 1)]),
        ("const t = `${require('./t{k}')} import './u{k}'`;", "javascript", [("./t{k}", [], "cjs", 1)]),
        ("const r = /require('g{k}')/; import './real{k}'", "javascript", [("./real{k}", [], "esm", 1)]),
        ("const x = <div title='a'>Don't {require('./j{k}')}</div>;", "tsx", [("./j{k}", [], "cjs", 1)]),
    ],
    "order": [
        (
            "import a from './a{k}';\nconst b = require('./b{k}');\n\nexport * from './c{k}';\nimport('./d{k}');\nimport './a{k}';",
            "typescript",
            [("./a{k}", ["a"], "esm", 1), ("./b{k}", ["b"], "cjs", 2), ("./c{k}", ["*"], "esm", 4), ("./d{k}", [], "esm", 5), ("./a{k}", [], "esm", 6)],
        ),
        ("\n\nexport { z } from './z{k}';\n  require('./y{k}')", "javascript", [("./z{k}", ["z"], "esm", 3), ("./y{k}", [], "cjs", 4)]),
    ],
}

ALIASES = {"@lib": ["src/lib", "never"], "./x/*": ["alt/*"], "./bare/*": ["/*"], "none": [], "/abs": ["src/abs"], "@deep/*": ["src/*"]}
BASE_URL = "/p/base"
ALIAS_FILES = ["/p/base/src/lib.ts", "/p/base/alt/one.ts", "/p/src/x/two.ts", "/p/src/near.ts", "/p/base/@only.ts", "/p/@top/index.ts", "/p/base/src/abs/z.ts", "/p/up/index.ts", "/p/src/mod.ts", "/p/base/src/deep.ts", "/p/base/q.ts"]
#: A specifier in a file of /p/src, and the file that it resolves to.
ALIAS_CASES = [
    ("@lib", "/p/base/src/lib.ts"),
    ("./x/one", "/p/base/alt/one.ts"),
    ("./x/two", "/p/src/x/two.ts"),
    ("./near", "/p/src/near.ts"),
    ("@only", "/p/base/@only.ts"),
    ("@top", "/p/@top/index.ts"),
    ("@deep/deep", None),
    ("lodash", None),
    ("/abs/z", "/p/base/src/abs/z.ts"),
    ("./gone", None),
    ("../up", "/p/up/index.ts"),
    ("./mod.js", "/p/src/mod.ts"),
    ("./bare/q", "/p/base/q.ts"),
]

#: Path; normalised, folder, name, relative to /r/s.
PATHS = [
    ("/a/./b/../c//d/", "/a/c/d", "/a/c", "d", "../../a/c/d"),
    ("/../x", "/x", "/", "x", "../../x"),
    ("/r/s/t.ts", "/r/s/t.ts", "/r/s", "t.ts", "t.ts"),
    ("/r/s", "/r/s", "/r", "s", ""),
    ("/r/sx/y", "/r/sx/y", "/r/sx", "y", "../sx/y"),
    ("/r/q/../s/u/v", "/r/s/u/v", "/r/s/u", "v", "u/v"),
]

#: Path under the root; whether the walk finds it; whether the patterns alone leave it in.
PATTERNS = ["*.test.ts", "skipme", "old?*"]
WALKED = [
    ("a{n}.ts", True, True),
    ("a{n}.test.ts", False, False),
    ("node_modules/a{n}.ts", False, True),
    ("lib/dist/a{n}.ts", False, True),
    ("lib/.git/x{n}.js", False, True),
    ("skipme/a{n}.ts", False, False),
    ("k/skipmeAlso{n}.ts", False, False),
    ("k/c{n}.d.ts", True, True),
    ("k/d{n}.TSX", True, True),
    ("k/e{n}.css", False, True),
    ("oldx{n}.ts", False, False),
    ("my-node_modules/x{n}.mjs", True, True),
    ("k{n}/.ts", False, True),
    ("gen.test.ts/a{n}.ts", False, True),
]
#: Path under the root; whether the plain lister finds it, with ``**/skip`` besides its own globs.
LISTED = [
    ("a{n}.ts", True),
    ("k/b{n}.tsx", True),
    ("c{n}.d.ts", False),
    ("node_modules/x{n}.js", False),
    ("k/dist/x{n}.js", False),
    ("k/skip/x{n}.js", False),
    ("skip{n}/x.js", True),
    ("d{n}.TS", False),
    ("e{n}.mjs", False),
    ("f{n}", False),
]
#: A line of a .gitignore and its glob.
GIT_LINES = [("# note", None), ("", None), ("  /top.ts ", "top.ts"), ("skip", "**/skip"), ("!keep", "**/!keep"), ("  dir/sub", "**/dir/sub"), ("   ", None)]
SPECIFIERS = ["./x", "../y", "lodash", "@scope/pkg", "@name", "/abs/z", "node:fs", "src/a", "#x", "~/x"]
FILE_NAMES = ["a.ts", "B.TSX", "c.js", "d.py", ".ts", "noext", "e.d.mts", "x.test.jsx", "f.mjs", "g.cjs", "h.cts"]


def values_sql(rows: list[tuple]) -> str:
    """Rows as the body of a VALUES clause."""

    def one(x) -> str:
        return "NULL::varchar" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).lower()

    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)
