"""Spans against a reading of each text character by character and line by line."""

import random

from treeloom.functions import names as N
from treeloom.jobs import spans as jobs
from treeloom.operators import spans as S


def structure(lines):
    """(opens, closes, semis) of each line; quotes and block comments may run over lines."""
    out, state = [], ""
    for line in lines:
        counts, i = [0, 0, 0], 0
        while i < len(line):
            c, two = line[i], line[i : i + 2]
            i += 1
            if state == "*":
                if two == "*/":
                    state, i = "", i + 1
            elif state:
                if c == "\\":
                    i += 1
                elif c == state:
                    state = ""
            elif two == "//" or c == "#":
                break
            elif two == "/*":
                state, i = "*", i + 1
            elif c in "'\"`":
                state = c
            elif c in "{};":
                counts["{};".index(c)] += 1
        out.append(tuple(counts))
    return out


def brace_end(lines, start):
    depth = opened = 0
    for i, (o, c, _) in enumerate(structure(lines[start : start + N.BRACE_LINES]), start):
        depth, opened = depth + o - c, opened or o > 0
        if opened and depth <= 0:
            return i
    return None


def depth(line):
    n = 0
    for c in line:
        if c not in " \t":
            break
        n += 4 if c == "\t" else 1
    return n


def note(line):
    return line.strip().startswith(("//", "/*", "*", "#"))


def intro(line):
    return line.strip().startswith(("def ", "class ", "async def ")) and line.strip().endswith(":")


def indent_end(lines, start):
    at = next((i for i in range(start, min(len(lines), start + N.INDENT_LINES)) if lines[i].strip() and not note(lines[i]) and not lines[i].strip().startswith("@")), None)
    if at is None or not intro(lines[at]):
        return None
    end, body = at, False
    for i in range(at + 1, len(lines)):
        if not lines[i].strip():
            end = i if body else end
        elif depth(lines[i]) <= depth(lines[at]):
            break
        else:
            body, end = body or not note(lines[i]), i
    return end


WORDS = "const let var func type interface class export public private protected static package import return if for switch case async def".split()


def declares(line):
    t = line.strip()
    return any(x in t for x in ("=>", "->", *"=(){}[]<>;")) or t.startswith(tuple(w + " " for w in WORDS))


def declaration_end(lines, start):
    near = lines[start : start + N.DECLARATION_LINES]
    skip = [note(x) or x.strip().startswith("@") for x in near]
    marks = structure(["" if s else x for s, x in zip(skip, near, strict=True)])
    seen, end = False, -1
    for i, line in enumerate(near):
        t = line.strip()
        goes_on = t.endswith(tuple(",.+-*/=([{\\:"))
        if not t:
            if seen:
                break
        elif skip[i]:
            if seen and depth(line) <= depth(near[0]):
                break
            end = i
        elif intro(line) or not seen and not declares(line):
            return None
        elif not declares(line) and not goes_on:
            break
        elif marks[i][0]:
            return None
        else:
            seen, end = True, i
            more = i + 1 < len(near) and near[i + 1].strip() and depth(near[i + 1]) > depth(near[0])
            if marks[i][2] or not (goes_on or more):
                break
    return start + end if end >= 0 else None


PIECES = ["def f(x):", "class A:", "x = 1;", "  y, z", "", "# it's { a note", "// say \"hi", "@mark", "if (a) {", "}", "s = 'a { b' + \"}\"", "t = `", "` + {", "/* open { ", " close */ }", "a \\", "\t\treturn x", "const k =", "word", "q = 'don\\'t { }'", "async def g(): pass", "   * list {"]


def test_ends_against_a_reading_of_lines(spark):
    rnd = random.Random(7)
    texts = ["\n".join(" " * rnd.choice([0, 0, 2, 4]) + rnd.choice(PIECES) for _ in range(rnd.randint(1, 70))) for _ in range(1500)]
    rows = [(i, t, rnd.randrange(t.count("\n") + 1)) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "i int, text string, start long").withColumn("lines", S.lines_of())
    got = S.with_declaration_end(S.with_indent_end(S.with_brace_end(frame, "b"), "n"), "d").collect()
    found = [0, 0, 0]
    for r in got:
        _, text, at = rows[r.i]
        want = tuple(f(text.split("\n"), at) for f in (brace_end, indent_end, declaration_end))
        assert (r.b, r.n, r.d) == want, (text.split("\n")[at : at + 30], want)
        found = [n + (x is not None) for n, x in zip(found, want, strict=True)]
    assert min(found) > 50


def test_long_strings_and_lines(spark):
    texts = ["{ '" + "a\\'" * 50_000 + "' }", "{ \"" + "x\n" * 40 + "\" }", "{" * 100_000 + "}" * 100_000]
    frame = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "i int, text string, start long").withColumn("lines", S.lines_of())
    assert {r.i: r.b for r in S.with_brace_end(frame, "b").collect()} == {0: 0, 1: 40, 2: 0}


def test_queries_find_each_kind(spark):
    rows = jobs.span_cascade(spark, "/root/testdata/sf0.001").groupBy("method").count().collect()
    assert {r.method for r in rows} == {"brace", "indent", "declaration", "window"}
    plan = jobs.span_cascade(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
