import hashlib
import re

import pytest
from pyspark.sql import functions as F

from riskloom.functions import paths, texts
from riskloom.settings import Exclusions



@pytest.fixture(autouse=True)
def columns(spark):
    global p, m, t
    p, m, t = F.col("p"), F.col("m"), F.col("t")


def test_languages(apply):
    rows = {"main.go": "Go", "app.ts": "TypeScript", "app.tsx": "TypeScript", "app.js": "JavaScript",
            "app.jsx": "JavaScript", "app.py": "Python", "app.java": "Java", "app.rs": "Rust",
            "app.rb": "Ruby", "app.c": "C", "app.cpp": "C++", "x.cc": "C++", "x.cxx": "C++",
            "x.CS": "C#", "README.md": "", "config.yaml": "", "image.png": "", "a.py/b": "",
            "Makefile": "", ".go": "Go"}
    assert apply("p string", [(k,) for k in rows], paths.language(p)) == list(rows.values())


def test_test_and_assessable_names(apply):
    tests = {"a/handler_test.go": True, "handler.test.ts": True, "x/handler.spec.js": True,
             "a/test_handler.py": True, "test_handler.py": True, "handler.go": False,
             "main.go": False, "testdata/fixture.json": False, "test_x/a.go": False,
             "latest_x.py": False, "a_test.rs": False}
    assert apply("p string", [(k,) for k in tests], paths.is_test(p)) == list(tests.values())
    wanted = {"src/auth/jwt.go": True, "src/auth/jwt_test.go": False, "src/handler.rs": True,
              "test_something.py": False, "generated.pb.go": False, "README.md": False,
              "config.yaml": False, "go.mod": False, "go.sum": False, "src/main.rs": True,
              "app.py": True, "handler.test.ts": False, "handler.spec.js": False,
              "a.generated.ts": False, "x.generated.d/a.ts": True, "a_test.rs": False, "A.MD": True,
              "Cargo.lock": False}
    assert apply("p string", [(k,) for k in wanted], paths.is_assessable(p)) == list(wanted.values())


def test_keywords(apply):
    rows = [("src/auth/jwt.go", ["auth"], True), ("src/utils/helpers.go", ["auth", "payment"], False),
            ("src/api/user_controller.go", ["controller"], True), ("src/api/routes.go", ["api/"], True),
            ("src/Auth/JWT.go", ["auth"], True), ("src/main.go", [], False)]
    for path, words, expected in rows:
        assert apply("p string", [(path,)], paths.contains_any(p, words)) == [expected]
    impact = {"src/auth/jwt.go": "0100", "src/api/handler.go": "1000", "src/api/auth_handler.go": "1100",
              "src/db/schema.go": "0010", "src/payment/checkout.go": "0001", "src/utils/format.go": "0000"}
    got = apply("p string", [(k,) for k in impact], *paths.user_impact_flags(p).values())
    assert ["".join(str(int(x)) for x in g) for g in got] == list(impact.values())
    sensitive = {"src/user/profile.go": "100", "src/auth/token.go": "010",
                 "src/billing/invoice.go": "001", "src/utils/format.go": "000"}
    got = apply("p string", [(k,) for k in sensitive], *paths.sensitivity_flags(p).values())
    assert ["".join(str(int(x)) for x in g) for g in got] == list(sensitive.values())


def test_exclusions(apply):
    rows = {"main.go": False, "pkg/util.go": False, ".hidden/skip.go": True, "a/.hidden.go": False,
            "src/vendor/a.go": True, "vendorx/a.go": False, "env1/a.py": True, "a/environ/b.py": True,
            "x.egg-info/a.py": True, "distribution-2/a.c": True, "vendor.go": False, "env.py": False}
    assert apply("p string", [(k,) for k in rows], paths.in_excluded_dir(p, Exclusions())) \
        == list(rows.values())
    none = Exclusions(dirs=(), patterns=())
    assert apply("p string", [("vendor/a.go",), (".x/a.go",)], paths.in_excluded_dir(p, none)) \
        == [False, True]


def test_globs():
    for glob, yes, no in [("a?c", "abc", "ac"), ("[ab]x", "bx", "cx"), ("*.d", "x.d", "xd"),
                          (r"\*", "*", "a"), ("a.b", "a.b", "aXb")]:
        regex = paths.glob_to_regex(glob)
        assert re.fullmatch(regex, yes) and not re.fullmatch(regex, no)


def test_parts(apply):
    got = apply("p string", [("a/b/c.go",), ("c.go",), ("a/c.go",)], paths.directory(p),
                paths.base_name(p), paths.module(p), paths.ancestors(p))
    assert got == [("a/b", "c.go", "a/b", ["a", "a/b"]), (".", "c.go", "c.go", []),
                   ("a", "c.go", "a/c.go", ["a"])]


def test_lines_hash_excerpt(apply):
    contents = ["", "hello", "hello\n", "one\ntwo\nthree\n", "a\n\nb"]
    assert apply("t string", [(x,) for x in contents], texts.line_count(t)) == [0, 1, 1, 3, 3]
    assert apply("t string", [("päckage",)], texts.content_hash(t)) \
        == [hashlib.sha256("päckage".encode()).hexdigest()[:32]]
    short, exact, long = ("\n".join(map(str, range(n))) for n in (5, 300, 301))
    got = apply("t string", [(short,), (exact,), (long,)], texts.prompt_excerpt(t, 300))
    assert got == [short, exact, "\n".join(map(str, range(300))) + "\n... (truncated)"]
    assert apply("t string", [(long,)], texts.prompt_excerpt(t, None)) == [long]
    prompt = apply("t string", [("fn validate_token() {}",)],
                   texts.assessment_prompt(F.lit("src/auth.rs"), t))[0]
    assert all(x in prompt for x in ("src/auth.rs", "validate_token", "security_impact"))


def test_commit_messages(apply):
    rows = {"Merge pull request #12 from x": 12, "Fix (#34) y": 34, "x (# 7b)": 7, "(#9": None,
            "Merge pull request #abc (#5)": 5, "plain": None, "a (#x) (#4)": None,
            "see #3: Merge pull request #8": 3, "Add (#1)\n\nbody (#2)": 1,
            "Merge pull request #99999999999999999999 x": None}
    assert apply("m string", [(k,) for k in rows], texts.pr_number(m)) == list(rows.values())
    fixes = {"Fix it": True, "add prefix": True, "RESOLVED": True, "Add feature": False}
    assert apply("m string", [(k,) for k in fixes], texts.is_bug_fix(m)) == list(fixes.values())
    assert apply("m string", [("   subject \r\nbody",), ("one",)], texts.first_line(m)) \
        == ["subject", "one"]


def test_count_literal_and_trim(apply):
    got = apply("t string", [("aaaa",), ("é=>=>é",), ("",)], texts.count_literal(t, "aa"),
                texts.count_literal(t, "=>"))
    assert got == [(2, 0), (0, 2), (0, 0)]
    spaced = "  a  b \t\n" + chr(0x3000) + chr(0xA0) + "c \n \n"
    assert apply("t string", [(spaced,)], texts.trim_lines(t)) == ["a  b\nc\n\n"]
