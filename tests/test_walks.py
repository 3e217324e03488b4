"""Ignore rules against a walk from the root, one entry at a time."""

import random
import re

from gaugeworks.sources import walks as W


def matches(pattern, name):
    """One pattern on a relative path, segment by segment."""
    def segments(ps, ns):
        if not ps:
            return not ns
        if ps[0] == "**":
            if len(ps) == 1:
                return len(ns) >= 1
            return any(segments(ps[1:], ns[k:]) for k in range(len(ns) + 1))
        return bool(ns) and one(ps[0], ns[0]) and segments(ps[1:], ns[1:])

    def one(p, n):
        out, i = "", 0
        while i < len(p):
            c = p[i]
            if c == "*":
                out += ".*"
            elif c == "?":
                out += "."
            elif c == "\\" and i + 1 < len(p):
                i += 1
                out += re.escape(p[i])
            elif c == "[" and "]" in p[i + 2 :]:
                end = p.index("]", i + 2)
                body = p[i + 1 : end]
                out += "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]"
                i = end
            else:
                out += re.escape(c)
            i += 1
        return re.fullmatch(out, n, re.S) is not None

    return segments(pattern.split("/"), name.split("/"))


def decides(files, entry, is_dir):
    """True if ignored, False if taken back in, None if no rule matches."""
    parts = entry.split("/")
    for depth in range(len(parts) - 1, -1, -1):
        at = "/".join(parts[:depth])
        for line in reversed(files.get(at, "").split("\n")):
            line = re.sub(r"(?<!\\)[ \t]+$", "", line)
            if not line or line.startswith("#"):
                continue
            again, line = line.startswith("!"), line.removeprefix("!")
            only, line = line.endswith("/"), line.removesuffix("/")
            anchored, line = "/" in line, line.removeprefix("/")
            if not line or (only and not is_dir):
                continue
            if matches(line, "/".join(parts[depth:]) if anchored else parts[-1]):
                return not again
    return None


def brute(paths, files):
    kept = set()
    for p in paths:
        parts = p.split("/")
        if ".git" in parts[:-1]:
            continue
        if not any(decides(files, "/".join(parts[: k + 1]), k < len(parts) - 1) for k in range(len(parts))):
            kept.add(p)
    return kept


def walked(spark, paths, files, **kw):
    df = spark.createDataFrame([(p, 10, False) for p in paths], "path string, size long, link boolean")
    rules = spark.createDataFrame(list(files.items()), "dir string, contents string")
    return W.walk(df, rules, **kw)


PATHS = ["a.py", "b.log", "src/a.py", "src/b.log", "src/build/x.o", "src/build/keep.o", "src/lib/build", "build/y.o", "docs/a/b/c.md", "docs/a/x.md", "docs/.hidden", "src/deep/er/b.log", "src/deep/keep.log", ".git/config", "sub/.git/x", "we ird/#x", "src/[a]", "naïve/é.py"]


def test_nested_rules(spark):
    cases = [
        {"": "*.log\nbuild/\n", "src": "!keep.log\n!b.log\n", "src/deep": "*.log\n!keep.log"},
        {"": "/docs/**/c.md\n**/er\nsrc/*/x.o\n# comment\n\n\\#x\n"},
        {"": "src/\n!src/a.py\n", "src": "!*\n"},
        {"": "*\n!*/\n!*.py\n"},
        {"": "docs/**\n!docs/a\nsrc/build/*\n!src/build/keep.o\n", "docs": "!.hidden"},
        {"": "[ab].*\n[!a-r]*\n?.py\nlib/build\n", "src": "\\[a\\]\nbuild/  \n"},
        {"": "", "src": None, "none": "*"},
    ]
    for files in cases:
        got = {r["path"] for r in walked(spark, PATHS, files).collect()}
        assert got == brute(PATHS, {k: v or "" for k, v in files.items()}), files


def test_random_rules(spark):
    rng = random.Random(8)
    names = ["a", "b", "ab", "c.x", "d.x", "build"]
    for _ in range(6):
        paths = sorted({"/".join(rng.choice(names) for _ in range(rng.randrange(1, 5))) + rng.choice(["", ".py"]) for _ in range(120)})
        paths = [p for p in paths if not any(q.startswith(p + "/") for q in paths)]
        pieces = ["a", "b*", "*.x", "?", "build", "**", "a?", "[a-b]", "*.py"]

        def rule(rng=rng, pieces=pieces):
            body = "/".join(rng.choice(pieces) for _ in range(rng.randrange(1, 4)))
            return rng.choice(["", "", "!"]) + rng.choice(["", "", "/"]) + body + rng.choice(["", "", "/"])

        files = {d: "\n".join(rule() for _ in range(rng.randrange(1, 5))) for d in ["", "a", "b", "a/b", "build", "ab/a"] if rng.random() < 0.8}
        files = {d: "\n".join(x for x in c.split("\n") if not re.search(r"(^|/)\*\*/\*\*|^[!/]*\*\*/?$", x)) for d, c in files.items()} or {"": ""}
        got = {r["path"] for r in walked(spark, paths, files).collect()}
        assert got == brute(paths, files), files


def test_sizes_links_and_roots(spark):
    df = spark.createDataFrame([("a/x", 10, False), ("a/y", 2_098_001, False), ("a/z", 2_098_000, None), ("b/l", 1, True), ("c/x", 1, False), (None, 1, False), ("a/x", 10, False)], "path string, size long, link boolean")
    none = spark.createDataFrame([("", "x\na/\n")], "dir string, contents string")
    assert sorted(r["path"] for r in W.walk(df, none).collect()) == []
    assert sorted(r["path"] for r in W.walk(df, none, roots=["a/"]).collect()) == ["a/z"]
    assert sorted(r["path"] for r in W.walk(df, none.limit(0)).collect()) == ["a/x", "a/x", "a/z", "c/x"]
    assert sorted(r["path"] for r in W.walk(df, none, roots=["c/x"]).collect()) == ["c/x"]  # named itself
