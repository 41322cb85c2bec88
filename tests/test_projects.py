"""Java roots, capped walks, Node manifests, workspaces, frameworks and overviews on small trees."""

import json

import pytest
from pyspark.sql import functions as F

from treeloom.operators import nodes as O
from treeloom.operators import roots as R


def known(spark, paths, project="p"):
    return spark.createDataFrame([(project, *(p if isinstance(p, tuple) else (p, 1))) for p in paths], "project string, path string, size long")


def modules(spark, dirs, project="p"):
    return spark.createDataFrame([(project, d) for d in dirs], "project string, dir string")


def test_overlapping_roots_count_a_package_once(spark):
    paths = [f"{m}/src/main/java/com/example/{m}/X.java" for m in ("api", "cli", "core")]
    roots, packages = R.java_roots(known(spark, paths), modules(spark, ["api", "cli", "core"]))
    assert sorted((r.dir, r.root, r.n_files, r.n_packages) for r in roots.collect()) == [(m, f"{m}/src/main/java", 1, 1) for m in ("api", "cli", "core")]
    assert {(r.package, r["name"]) for r in packages.collect()} == {(f"{m}/src/main/java/com/example/{m}", f"com.example.{m}") for m in ("api", "cli", "core")}


@pytest.mark.parametrize(("paths", "want"), [
    (["src/A.java", "src/main/B.java"], {"src/main"}), (["src/A.java", "src/docs/b.txt"], {"src"}), (["src/test/java/T.java", "src/main/java/M.java", "src/main/r.xml"], {"src/main/java", "src/test/java"}),
    (["src/main/java/readme.md", "src/main/r.XML"], {"src/main"}), (["src/java/A.java", "src/B.java"], {"src/java"}), (["src.java", "x/src/A.java"], set()),
])
def test_roots_are_tried_in_order(spark, paths, want):
    roots, packages = R.java_roots(known(spark, paths), modules(spark, [""]))
    assert {r.root for r in roots.collect()} == want
    assert all(r["name"] == "default" for r in packages.collect() if r.package == r.root)


def test_files_belong_to_all_modules_around(spark):
    roots, _ = R.java_roots(known(spark, ["a/src/main/java/in/src/main/java/X.java"]), modules(spark, ["a", "a/src/main/java/in"]))
    assert {(r.dir, r.root) for r in roots.collect()} == {("a", "a/src/main/java"), ("a/src/main/java/in", "a/src/main/java/in/src/main/java")}


def test_capped_walk(spark):
    paths = ["a/1.go", "a/2/x.go", "a/2/y/z.go", "a/3/q.go", "b.go", "build/no.go", "c/d/build/no.go", "c/d/e.go"]
    walk = lambda **k: [r.path for r in R.capped_walk(spark.createDataFrame([(p,) for p in paths], "path string"), **k).orderBy("nth").collect()]
    assert walk() == ["a/1.go", "a/2/x.go", "a/2/y/z.go", "a/3/q.go", "b.go", "c/d/e.go"]
    # The third entry of a directory goes with all below it; ignored directories count as entries.
    assert walk(per_dir=2) == ["a/1.go", "a/2/x.go", "a/2/y/z.go", "b.go"]
    assert walk(per_dir=1) == ["a/1.go"] and walk(total=2) == ["a/1.go", "a/2/x.go"]


MANIFESTS = [
    ({"name": "x", "bin": "b.js"}, True, True, ["b.js"], []), ({"bin": {"a": "1.js", "b": 2}}, True, True, ["1.js"], []), ({"bin": None}, True, False, [], []), ({"workspaces": ["a/*", " ", 3, " b "]}, True, True, [], ["a/*", "b"]),
    ({"workspaces": {"packages": ["p/*"]}}, True, True, [], ["p/*"]), ({"workspaces": {"nohoist": ["p"]}}, True, False, [], []), ({"name": 5}, False, False, [], []), ({"scripts": {"a": 1}}, False, False, [], []), ({"scripts": {"a": None}}, True, True, [], []),
    ({"dependencies": []}, False, False, [], []), ([], False, False, [], []), ({"bin": [1]}, True, True, [], []), ({}, True, False, [], []),
]


def test_manifests_of_all_shapes(spark):
    texts = [(i, json.dumps(m)) for i, (m, *_) in enumerate(MANIFESTS)] + [(98, "null"), (99, '{"name": "x"'), (100, None)]
    got = {r.i: r for r in O.with_manifest(spark.createDataFrame(texts, "i int, t string"), "t").collect()}
    for i, (m, ok, eligible, bins, workspaces) in enumerate(MANIFESTS):
        assert (got[i].ok, got[i].eligible, got[i].bins, got[i].workspaces) == (ok, eligible, bins, workspaces), m
    assert got[98].ok and not got[98].eligible and not got[99].ok and not got[100].ok


def test_pnpm_and_plain_workspaces(spark):
    text = "packages:\n  - 'apps/*'\n  # - no/*\n  - \"tools/gen\"\n\ncatalog:\n  - x/*\n"
    rows = spark.createDataFrame([("p", "", text)], "project string, dir string, t string").withColumn("patterns", O.pnpm_patterns("t"))
    paths = ["apps/a/package.json", "apps/b/x.js", "apps/node_modules/package.json", "apps/a/deep/package.json", "tools/gen/package.json", "x/y/package.json"]
    assert {(r.pattern, r.root) for r in O.workspace_roots(rows, known(spark, paths)).collect()} == {("apps/*", "apps/a"), ("tools/gen", "tools/gen")}
    bad = rows.withColumn("patterns", F.array(*map(F.lit, ["*", "apps/**", "../apps/*", "/apps/*", "apps/*/deep", "./apps/./a"])))
    assert {r.pattern for r in O.workspace_roots(bad, known(spark, paths)).collect()} == {"./apps/./a"}


def test_script_words(spark):
    scripts = {"node ./a.js --flag b/c=1": ["./a.js"], "tsx src/x.mts && vite": ["src/x.mts"], "'q.cjs' \"d e.ts\"": ["q.cjs", "e.ts"], "echo hi": [], "": []}
    got = spark.createDataFrame([(s,) for s in scripts], "s string").select("s", O.script_tokens(F.col("s")).alias("w")).collect()
    assert {r.s: r.w for r in got} == scripts


def test_root_overview_is_capped_and_ranked(spark):
    manifest = {"name": "m", "main": "lib/main.js", "bin": {"m": "bin/m.js"}, "scripts": {"go": "node tools/go.js"}, "dependencies": {"react": "1", "next": "1"}}
    paths = [("package.json", 1), ("tsconfig.json", 1), ("next.config.js", 1), ("server.js", 1), ("main.js", 1), ("index.js", 1), ("index.html", 1), ("App.tsx", 1), ("pages/z.tsx", 5), ("pages/index.tsx", 9), ("components/a/Deep.tsx", 1), ("components/b.tsx", 9), ("bin/m.js", 1), ("lib/main.js", 1), ("tools/go.js", 1), (".env", 1), ("sub/package.json", 1)]
    rows = O.with_manifest(spark.createDataFrame([("p", "", json.dumps(manifest))], "project string, dir string, t string"), "t")
    tree = known(spark, paths)
    found = O.with_found(rows, tree)
    assert found.first().found == ["App.tsx", "components", "index.html", "main.js", "next.config.js", "pages"]
    got = [r.path for r in O.overviews(found, tree, 20).orderBy("nth").collect()]
    assert got == ["package.json", "tsconfig.json", "next.config.js", "server.js", "main.js", "index.js", "index.html", "App.tsx", "pages/index.tsx", "components/a/Deep.tsx", "bin/m.js", "lib/main.js", "tools/go.js"]
    assert [r.path for r in O.overviews(found, tree).orderBy("nth").collect()] == got[:10]
    assert O.stacks(found, tree).first().stack == "Node.js, React, Next.js"


def test_a_framework_needs_a_path_too(spark):
    rows = O.with_manifest(spark.createDataFrame([("p", "web", '{"dependencies": {"vue": "3", "vite": "5", "@nestjs/common": "1"}}')], "project string, dir string, t string"), "t")
    stack = lambda paths: O.stacks(O.with_found(rows, known(spark, paths)), known(spark, paths)).first().stack
    assert stack(["web/package.json"]) == "Node.js"
    assert stack(["web/package.json", "web/index.html", "go.mod", "web/src/main.ts"]) == "Go Modules, Node.js, Vite, NestJS"
    assert stack(["web/package.json", "web/components/x.vue", "node_modules/pom.xml"]) == "Node.js, Vue"
