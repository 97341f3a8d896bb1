import posixpath
import random
from collections import Counter

from pyspark.sql import functions as F

from riskloom.operators import imports, ordering
from riskloom.operators.skew import spread_join, top_k
from riskloom.operators.dependencies import dependency_heat
from verification import queries

FILES = "repo_id string, path string"
REFS = "repo_id string, path string, imp string"


def by_hand(files, refs):
    """Edges by trying every file for every import."""
    known = set(files)
    edges = []
    for repo, importer, imp in refs:
        names = [imp + e for e in (".py", ".go", ".ts", ".js", "/__init__.py")]
        names.append(posixpath.normpath(posixpath.join(imp, "__init__.py")))
        edges += [(repo, name, importer) for name in names if (repo, name) in known][:1]
        loose = [p for r, p in files if r == repo and p != importer and imp in p]
        if loose:
            edges.append((repo, min(loose), importer))
    return Counter(edges)


def check(spark, files, refs):
    f, r = spark.createDataFrame(files, FILES), spark.createDataFrame(refs, REFS)
    expected = by_hand(files, refs)
    edges = imports.import_edges(f, r)
    assert Counter((e.repo_id, e.path, e.imported_by) for e in edges.collect()) == expected
    counts = Counter()
    for (repo, path, _), n in expected.items():
        counts[repo, path] += n
    fan_in = imports.fan_in(f, r)
    assert {(e.repo_id, e.path): e.import_count for e in fan_in.collect()} == dict(counts)
    return f, r, counts


def test_resolution_order_and_both_hits(spark):
    files = [("r", p) for p in ("a/b.go", "a/b.py", "a/b/__init__.py", "a/c/__init__.py", "x.py",
                                "lib/ab/b.rs", "z/only.rs", "os.py")] + [("q", "a/b.ts")]
    refs = [("r", "x.py", "a/b"), ("r", "a/b.py", "a/b"), ("r", "x.py", "a/c"), ("r", "x.py", "./a/c"),
            ("r", "x.py", "only"), ("r", "x.py", "nowhere"), ("q", "a/b.ts", "a/b"), ("q", "a/b.ts", "/"),
            ("r", "x.py", "os"), ("r", "os.py", "os"), ("r", "x.py", "/"), ("r", "x.py", "a/b"),
            ("r", "x.py", "s.")]
    check(spark, files, refs)


def test_cleaned_paths(spark, apply):
    odd = ["./a/../b", "a//b", ".", "", "..", "../..", "../a/..", "/..", "/a/../..", "a/./b/", "./", "a/b/../..", "é/../x", "a/../../b", "/", "/a//b/."]
    got = apply("s string", [(o,) for o in odd], imports.cleaned(F.col("s")))
    assert got == [posixpath.normpath(o) for o in odd]
    files = [("r", p) for p in ("b/__init__.py", "a/b/__init__.py", "__init__.py", "a/b.py", "x.go")] + [("q", "b/__init__.py")]
    check(spark, files, [(r, "x.go", o) for r in "rq" for o in odd if o] + [("r", "x.go", "a/b")])


def test_ranges_of_an_order(spark):
    """The least two of every range against looking at all rows, over several partitions."""
    rng = random.Random(8)
    rows = [(i, rng.randrange(400)) for i in range(3000)]
    df = ordering.in_order(spark.createDataFrame(rows, "id long, number long").repartition(5), ["id"], "at", "t")
    place = sorted(r["at"] for r in df.collect())
    number = [n for _, n in rows]
    asked = [(0, 3000), (5, 5), (0, 1), (2999, 3000)] + [tuple(sorted(rng.sample(range(3000), 2))) for _ in range(150)] + [(i, i + rng.randrange(9)) for i in range(0, 2900, 37)]
    ranges = spark.createDataFrame([(k, place[a], place[b] if b < 3000 else place[-1] + 1) for k, (a, b) in enumerate(asked)], "k long, lo long, hi long")
    got = {r["k"]: r["least"] for r in ordering.two_least_in_ranges(df, ranges, ["k"]).collect()}
    assert got == {k: sorted(set(number[a:b]))[:2] for k, (a, b) in enumerate(asked) if a < b}


def test_ranges_between_marks(spark):
    """Nested, empty and repeated ranges, most of them over several pieces, against all rows."""
    rng = random.Random(4)
    texts = {(g, "".join(rng.choices("ab", k=rng.randrange(0, 7)))) for g in ("x", "y") for _ in range(60)}
    rows = [(rng.choice("xy"), "".join(rng.choices("abc", k=8)), rng.randrange(300)) for _ in range(1500)]
    data = [(g, t.encode(), 1, n) for g, t, n in rows]
    data += [(g, t.encode() + end, kind, None) for g, t in texts for kind, end in ((0, b""), (2, b"\xff"))]
    df = spark.createDataFrame(data, "g string, k binary, kind int, no long").repartition(3)
    want = {(g, t): sorted({n for h, u, n in rows if h == g and u.startswith(t)})[:2] for g, t in texts}
    want = {k: v for k, v in want.items() if v}
    for pieces in (1, 7):
        got = ordering.two_least_between_marks(df, ["g", "k"], "kind", "no", (pieces - 1) * ordering._PIECE_ROWS).collect()
        assert len(got) == len(want)
        assert {(r["g"], bytes(r["k"]).decode()): r["least"] for r in got} == want


def test_places_of_hot_groups(spark):
    rows = [(g if i % 3 else "hot", i % 4, i) for i in range(2000) for g in ("a", "b", None)]
    df = spark.createDataFrame(rows, "g string, s int, i int")
    got = sorted((str(r["g"]), r["rank"], r["s"], r["i"]) for r in ordering.ranked(df, ["g"], [F.desc("s"), "i"]).collect())
    want = []
    for g in ("None", "a", "b", "hot"):
        own = sorted(((s, i) for k, s, i in rows if str(k) == g), key=lambda x: (-x[0], x[1]))
        want += [(g, n + 1, s, i) for n, (s, i) in enumerate(own)]
    assert got == sorted(want)


def test_random_graph(spark):
    rng = random.Random(11)
    names = ["a", "b", "ab", "ba", "aa", "src", "lib"]
    files = sorted({(rng.choice("rq"), "/".join(rng.choices(names, k=rng.randint(1, 4)))
                     + rng.choice([".py", ".go", ".ts", ".rs", "/__init__.py"])) for _ in range(150)})
    refs = []
    for _ in range(500):
        repo, importer = rng.choice(files)
        imp = "/".join(rng.choices(names, k=rng.randint(1, 3)))
        refs.append((repo, importer, rng.choice([imp, imp[:2], imp[1:] or "/", "./" + imp, imp])))
    check(spark, files, refs)


def test_hot_repository(spark):
    """One repository and one import with most of the rows."""
    files = [("hot", f"src/m{i % 7}/f{i}.py") for i in range(300)] + [("cold", "src/m1/f1.py")]
    refs = [("hot", p, "src/m1/f1") for r, p in files if r == "hot"] + [("cold", "src/m1/f1.py", "src")]
    _, _, counts = check(spark, files, refs)
    assert counts["hot", "src/m1/f1.py"] >= 299


def test_centrality(spark):
    counts = spark.createDataFrame(
        [("r", "core.go", 4), ("r", "a.go", 1), ("q", "x.go", 2)],
        "repo_id string, path string, import_count bigint")
    got = {(r.repo_id, r.path): r.centrality for r in imports.centrality(counts).collect()}
    assert got == {("r", "core.go"): 1.0, ("r", "a.go"): 0.25, ("q", "x.go"): 1.0}


def test_no_imports(spark):
    f, r, counts = check(spark, [("r", "a.py")], [("r", "a.py", "zzz")])
    assert not counts
    assert imports.centrality(imports.fan_in(f, r)).count() == 0


def test_dependency_heat(spark):
    edges = spark.createDataFrame([("r", "a", "b", "x", "exact"), ("r", "gone", "b", "x", "loose")],
                                  "repo_id string, imported_by string, path string, imp string, match string")
    heat = spark.createDataFrame([("r", "a", 5), ("r", "b", 90)],
                                 "repo_id string, path string, heat_score int")
    got = sorted((r.imported_by, r.importer_heat, r.heat_score)
                 for r in dependency_heat(edges, heat).collect())
    assert got == [("a", 5, 90), ("gone", 0, 90)]


def test_plan_has_no_pairwise_join(spark):
    f = spark.createDataFrame([("r", "a.py")], FILES)
    r = spark.createDataFrame([("r", "a.py", "x")], REFS)
    plan = imports.import_edges(f, r)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_lengths_leads_and_repeats(spark):
    """Imports of 1 to 40 characters with many leads, overlaps and one large repository."""
    rng = random.Random(5)
    files = [("big" if i % 2 else f"r{i % 7}", "/".join(
        "".join(rng.choices("abcé_", k=rng.randint(1, 9))) for _ in range(rng.randint(1, 6))) + f"{i}.py") for i in range(120)]
    refs = []
    for _ in range(700):
        repo, importer = rng.choice(files)
        path = rng.choice([p for r, p in files if r == repo])
        at = rng.randrange(len(path))
        imp = path[at:at + rng.randint(1, 40)]
        refs.append((repo, importer, imp if rng.random() < 0.8 else imp + rng.choice("xz")))
    assert len({(r, i[:6]) for r, _, i in refs}) > 300
    check(spark, files, refs)


def test_spread_join(spark):
    large = spark.createDataFrame([("a", i) for i in range(100)] + [("z", 0)], "k string, i int")
    small = spark.createDataFrame([("a", 7)], "k string, v int")
    assert spread_join(large, small, ["k"], ["i"], "left").count() == 101
    assert spread_join(large, small, ["k"], ["i"]).filter("v = 7").count() == 100


def test_top_k_of_many_hot_groups(spark):
    rows = [(g, i) for g in range(40) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, i int").repartition(5)
    for k in (1, 7, 2000):
        got = sorted((r.g, r.i, r["rank"]) for r in top_k(df, ["g"], ["i"], k, spread_on=["i"], fan_out=3).collect())
        assert got == [(g, i, i + 1) for g in range(40) for i in range(min(k, 300))]


def test_range_pieces_grow_with_the_levels_only(spark):
    """The bounds of a level are not written out of those of all levels below it."""
    def size(row):
        places = spark.createDataFrame([(row + i, i) for i in range(3)], "at long, number long")
        ranges = spark.createDataFrame([("a", 0, 2)], "k string, lo long, hi long")
        plan = ordering.two_least_in_ranges(places, ranges, ["k"])._jdf.queryExecution().analyzed()
        return max(len(line) for line in plan.toString().split("\n"))

    assert size(1 << 30) < 3 * size(1 << 12)


def test_a_result_resolves_its_imports_once(spark, monkeypatch):
    """Heat, counts and edges of one result start from one table of resolved imports."""
    tables = {
        "fx_file_metrics": ([("r", p, "Go", 10, 99, "h", 1, 1, 3, 4) for p in ("src/a.go", "src/b.go")],
                            "repo_id string, path string, language string, lines long, bytes long, content_hash string, "
                            "function_count long, exported_symbols long, cyclomatic long, cognitive long"),
        "fx_import_refs": ([("r", "src/a.go", "src/b"), ("r", "src/b.go", "a")], REFS),
        "fx_commit_files": ([("r", "s", "src/a.go", "u", None, "m")], "repo_id string, sha string, path string, author string, ts timestamp, message string"),
        "fx_incidents": ([("r", "src/a.go", None, "low")], "repo_id string, file string, date timestamp, severity string"),
        "fx_runs": ([("r", "/r", None, "c", "main")], "repo_id string, repo_path string, analyzed_at timestamp, commit_sha string, branch string"),
    }
    calls, resolved = [], imports.resolved_imports
    monkeypatch.setattr(queries.Inputs, "bind", staticmethod(lambda spark, d, name: spark.createDataFrame(*tables[name])))
    monkeypatch.setattr(imports, "resolved_imports", lambda *a: calls.append(a) or resolved(*a))
    edges = queries.result_dependencies(spark, "")
    assert sorted((e.path, e.imported_by, e.match) for e in edges.collect()) == [
        ("src/a.go", "src/b.go", "loose"), ("src/b.go", "src/a.go", "exact"), ("src/b.go", "src/a.go", "loose")]
    assert len(calls) == 1
    calls.clear()
    assert queries.dependency_heat(spark, "").count() == 3 and len(calls) == 1
    calls.clear()
    queries.tree_search(spark, "").collect()
    assert len(calls) == 1
