import pytest
from pyspark.sql import functions as F

from treeloom.functions import classify as C
from treeloom.operators import review as R
from treeloom.operators import selectors as S
from treeloom.operators.ranking import within_budget
from treeloom.sources.corpus import directory
from treeloom.streaming.bursts import bursts


def paths(spark, values):
    rows = [(p, p.rpartition("/")[2], p.rpartition("/")[0]) for p in values]
    return spark.createDataFrame(rows, "path string, name string, dir string")


def test_sensitive_paths(spark):
    want = {".env": True, ".env.foo": True, "keys/id_rsa": True, ".azure/token.json": True, "config/service.pem": True, ".ENV.EXAMPLE": False, "src/main.go": False, ".aws/config": True, "a/.gcp/credentials.json": True}
    got = {r.path: r.s for r in paths(spark, want).select("path", C.is_sensitive().alias("s")).collect()}
    assert got == want


def test_review_priority(spark):
    want = {"internal/api/new_client.go": 1, "media/logo.png": 0, "notes/draft.xyz": 0, "build/tmp.txt": None, "README.md": 1, "go.sum": None, "x/robots.txt": 0}
    got = {r.path: r.p for r in paths(spark, want).select("path", C.review_priority().alias("p")).collect()}
    assert got == want


def test_ops_rank_rises(spark):
    names = ["README.md", ".env.example", "Dockerfile", "manual-vm-deploy.md", "healthcheck.sh", "ci.yml", "random.txt"]
    got = {r.path: r.r for r in paths(spark, names).select("path", C.ops_rank().alias("r")).collect()}
    assert [got[n] for n in names] == sorted(got.values()) and len(set(got.values())) == len(names)


def test_selector_lines(spark):
    lines = ["prefix: path/to/file.go # func main ", "FLLE: x", "FILE :x", "NEAR: a.go", "FILE:", "", "file:a#b#c"]
    rows = S.parse(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")).orderBy("i").collect()
    assert [(r.type, r.sel_path, r.pattern, r.code) for r in rows] == [
        ("PREFIX", "path/to/file.go", "func main", "ok"), ("", "", "", "not_a_selector"), ("", "", "", "not_a_selector"), ("NEAR", "a.go", "", "no_pattern"), ("FILE", "", "", "no_path"), ("", "", "", "blank"), ("FILE", "a", "b#c", "ok"),
    ]


@pytest.mark.parametrize("limit", [9, 10, 11, 12, 13])
def test_trim_keeps_code_points(spark, limit):
    texts = ["aéßüöäñçb" * 2, "short", "日本語テキスト長い", ""]
    for text, got in spark.createDataFrame([(t,) for t in texts], "t string").select("t", R.trimmed("t", limit).alias("g")).collect():
        if len(text.encode()) <= limit:
            assert got == text
        else:
            head, _, tail = got.partition("\n... [cut ")
            cut, _, tail = tail.partition(" bytes] ...\n")
            assert text.startswith(head) and text.endswith(tail)
            assert len(head.encode()) + len(tail.encode()) + int(cut) == len(text.encode())
            assert max(len(head.encode()), len(tail.encode())) <= limit // 2


@pytest.mark.parametrize(("limit", "n"), [(29, 2), (30, 3), (31, 3)])
def test_budget_boundary(spark, limit, n):
    rows = spark.createDataFrame([(1, i, 10) for i in range(3)], "k int, ord int, size int")
    assert within_budget(rows, ["k"], ["ord"], F.col("size"), limit).count() == n


def test_review_overflow_stops_all_later(spark):
    rows = spark.createDataFrame([(1, "a", 5, "pending"), (1, "b", 9, "pending"), (1, "c", 1, "pending"), (1, "d", 1, "binary")], "k int, path string, size int, status string")
    got = {r.path: r.verdict for r in R.greedy(rows, ["k"], ["path"], 10).collect()}
    assert got == {"a": "included", "b": "budget", "c": "budget", "d": "binary"}


def test_references_and_write_paths(spark):
    text = 'see @a/b.go, and mail x@y.z @c). @"a \\"b\\".md" @.\n```\n@in.md\n````\n@é1 @"open'
    refs = R.references(spark.createDataFrame([(text,)], "text string")).collect()
    assert [(r.pos, r.ref) for r in refs] == [(0, "a/b.go"), (1, "c"), (2, 'a "b".md'), (3, "é1")]
    open_ones = [("@\"x",), ("@\"x\"",), ("a@\"x",), ('@"x\\"',), (None,)]
    assert [r.u for r in spark.createDataFrame(open_ones, "text string").select(R.unclosed_reference().alias("u")).collect()] == [True, False, False, True, None]
    errors = {r.p: r.e for r in spark.createDataFrame([(x,) for x in ("a/b", "/a", "a*", "<p>", "../x", ".", "")], "p string").select("p", R.path_error("p").alias("e")).collect()}
    assert errors == {"a/b": None, "/a": "absolute", "a*": "pattern", "<p>": "placeholder", "../x": "outside", ".": "root", "": "empty"}


FENCES = [
    (["a", "```go", "x", "```", "b"], "01110"), (["````", "```", "x", "````", "y"], "11110"), (["~~~", "```", "~~~", "z"], "1110"), (["```", "```go", "x"], "111"), (["```a`b", "x"], "00"),
    (["    ```", "x"], "00"), (["```\r", "x", "  ```  ", "y"], "1110"), (["~~~ `x`", "x", "~~~~~", "y"], "1110"), (["``", "x"], "00"), (["```", "x", "``` no", "y"], "1111"),
]


def test_fences(spark):
    rows = R.fence_mask(spark.createDataFrame([(i, x) for i, (x, _) in enumerate(FENCES)], "id int, lines array<string>")).orderBy("id", "ln").collect()
    for i, (_, want) in enumerate(FENCES):
        assert "".join(str(int(r.fenced)) for r in rows if r.id == i) == want, FENCES[i]


def test_partitioning_does_not_matter(spark):
    from treeloom.operators import topology as T
    from treeloom.sources.corpus import files

    rows = files(spark, "/root/testdata/sf0.001")
    one, many = (T.package_lines(T.candidates(x)).orderBy("dir").collect() for x in (rows.coalesce(1), rows.repartition(13, "name")))
    assert one == many


def test_directory_reads_no_contents(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1\n")
    (tmp_path / "README.md").write_text("# hi\n")
    got = directory(spark, str(tmp_path))
    assert sorted((r.path, r.dir, r["size"]) for r in got.collect()) == [("README.md", "", 5), ("src/a.py", "src", 6)]
    assert "content:binary" not in got._jdf.queryExecution().executedPlan().toString()


def test_bursts_on_a_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    events.write.parquet(str(tmp_path / "in"))
    stream = bursts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.outputMode("append").format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    batch = {tuple(r) for r in bursts(events).collect()}
    closed = {tuple(r) for r in spark.sql("select * from bursts").collect()}
    assert closed and closed <= batch
