"""Quotation linking on a small mail thread, and against a plain parser."""

import hashlib
import random
import re

from voxtide.llm.quotes import link_quotations

SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv int, thread string, sources int"


def link(spark, rows):
    df = spark.createDataFrame([(*r, 0, "x", 1) for r in rows], SCHEMA)
    return sorted(
        (tuple(r) for r in link_quotations(df).select(
            "conv_id", "turn", "text", "n_quotes", "n_linked", "sources", "parent", "thread", "depth"
        ).collect()), key=str,
    )


def test_thread(spark):
    rows = [
        (1, 0, "u", "How do I sort a table?\n\nIt is large."),
        (1, 1, "a", "Ann wrote:\n> how do I  SORT a table?\nUse orderBy."),
        (1, 2, "u", "> > How do I sort a table?\n> Use orderBy.\n\nThanks!"),
        (1, 3, "b", "> It is large.\nHow large?"),
        (1, 4, "b", "> never said\nHm."),
        (2, 0, "u", ">> Use orderBy.\nI read this elsewhere."),
    ]
    assert link(spark, rows) == [
        (1, 0, "How do I sort a table?\n\nIt is large.", 0, 0, [], None, 0, 0),
        (1, 1, "Use orderBy.", 1, 1, ["1:0"], 0, 0, 1),
        (1, 2, "Thanks!", 2, 2, ["1:0", "1:1"], 1, 0, 2),
        (1, 3, "How large?", 1, 1, ["1:0"], 0, 0, 1),
        (1, 4, "Hm.", 1, 0, [], None, 4, 0),
        (2, 0, "I read this elsewhere.", 1, 1, ["1:1"], None, 0, 0),
    ]


def test_odd_rows(spark):
    rows = [
        (1, 0, "u", None), (1, 1, "u", ""), (1, 2, "u", "> \n>>\n"), (1, 3, "u", ">"), (None, 4, "u", "hello"), (1, None, "u", "> hello"),
        (1, 5, "u", "same"), (1, 5, "u", "same"), (1, 6, "u", "> same"), (1, 7, "u", "> same\r\nok\rfine"), (1, 8, "u", "> word\n" * 3000 + "end"),
    ]
    got = link(spark, rows)
    assert len(got) == len(rows)
    by = {r[:2]: r[2:] for r in got}
    assert by[1, 0] == by[1, 1] [:0] + ("", 0, 0, [], None, 0, 0)
    assert by[1, 2] == ("", 0, 0, [], None, 2, 0)
    assert by[None, 4] == ("hello", 0, 0, [], None, 4, 0)
    assert by[1, None][1:] == (1, 0, [], None, None, 0)
    assert by[1, 6] == ("", 1, 1, ["1:5"], 5, 5, 1)
    assert by[1, 7] == ("ok\nfine", 1, 1, ["1:5"], 5, 5, 1)
    assert by[1, 8][:2] == ("end", 1)
    assert link(spark, []) == []


def parse(text):
    """(own text, [(level, body)]) by walking over the lines."""
    runs = []
    for line in re.split("\r\n|\n|\r", text or ""):
        mark = re.match(r"((?:[ \t]*>)+)[ \t]?", line)
        level = mark[1].count(">") if mark else 0
        body = line[mark.end():] if mark else line
        if runs and runs[-1][0] == level:
            runs[-1][1].append(body)
        else:
            runs.append((level, [body]))
    for (a, own), (b, _) in zip(runs, runs[1:], strict=False):
        if b > a and re.search(r"(?i)\bwrote:[ \t]*$", own[-1]):
            own.pop()
    bodies = [(n, "\n".join(own)) for n, own in runs]
    said = "\n".join(b for n, b in bodies if n == 0)
    return re.sub(r"^\s+|\s+$", "", said), [(n, b) for n, b in bodies if n and re.search(r"[^\W_]", b)]


def units(text):
    out = {}
    for part in [text, *re.split(r"\n[ \t]*\n", text), *text.split("\n")]:
        u = re.sub(r"\s+", " ", part.lower()).strip()
        if re.search(r"[^\W_]", u):
            out[hashlib.md5(u.encode()).hexdigest()] = len(u)
    return out


def brute(rows):
    parsed = {(c, t): parse(x) for c, t, _, x in rows}
    says: dict = {}
    for key, (said, _) in parsed.items():
        for h in units(said):
            says.setdefault(h, []).append(key)
    out, parents = {}, {}
    for (c, t), (said, quoted) in parsed.items():
        links, replies = [], []
        for level, body in quoted:
            options = []
            for h, size in units(body).items():
                here = [k for k in says.get(h, []) if k[0] == c]
                if here and min(here)[1] < t:
                    options.append((True, size, h, min(here)))
                else:
                    away = [k for k in says.get(h, []) if k[0] != c]
                    if away:
                        options.append((False, size, h, min(away)))
            if options:
                same, _, _, source = max(options)
                links.append(source)
                if same:
                    replies.append((level, -source[1]))
        parents[c, t] = -min(replies)[1] if replies else None
        out[c, t] = [said, len(quoted), len(links), sorted({f"{a}:{b}" for a, b in links}), parents[c, t]]
    for (c, t), row in out.items():
        depth, at = 0, t
        while parents[c, at] is not None:
            depth, at = depth + 1, parents[c, at]
        row += [at, depth]
    return sorted(((*k, *v) for k, v in out.items()), key=str)


def test_same_as_a_plain_parser(spark):
    rng = random.Random(9)
    rows, said = [], ["Alpha beta.", "Gamma", "delta  EPSILON", "zeta\n\neta theta", "- - -"]
    for c in range(4):
        for t in range(25):
            lines = []
            for _ in range(rng.randrange(1, 5)):
                level, body = rng.randrange(4), rng.choice(said)
                if level and rng.random() < 0.3:
                    lines.append("On Monday Bo wrote:")
                lines += [("> " * level if rng.random() < 0.7 else ">" * level) + line for line in body.split("\n")]
            rows.append((c, t, "u", "\n".join(lines)))
            said.append(f"word{rng.randrange(60)} says {t}")
    assert link(spark, rows) == brute(rows)


def test_long_chain_of_replies(spark):
    rows = [(1, 0, "u", "message 0")] + [(1, t, "u", f"> message {t - 1}\nmessage {t}") for t in range(1, 40)]
    assert [r[6:] for r in sorted(link(spark, rows), key=lambda r: r[1])] == [(None if t == 0 else t - 1, 0, t) for t in range(40)]


def test_no_python_in_the_plan(spark, data):
    plan = link_quotations(spark.read.parquet(f"{data}/conversations.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"))


def link_parts(spark, rows):
    df = spark.createDataFrame([(*r, 0, "x", 1) for r in rows], SCHEMA)
    out = link_quotations(df, every_part=True).select("conv_id", "turn", "text", "n_quotes", "n_linked", "sources", "parent", "thread", "depth")
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_every_part_of_a_passage(spark):
    rows = [
        (1, 0, "u", "First words."), (1, 1, "a", "Second words.\nMore of them."), (1, 2, "u", "Third words."),
        # paragraphs of two messages, lines of two messages, and a line inside a linked paragraph
        (1, 3, "b", "> First words.\n>\n> Third words.\nBoth."), (1, 4, "b", "> More of them.\n> First words.\nOk."),
        (1, 5, "b", "> Second words.\n> More of them.\n>\n> Unknown.\nFine."), (2, 0, "u", "Second words.\nMore of them."),
        # the paragraph is said elsewhere, one line of it here
        (3, 0, "u", "More of them."), (3, 1, "a", "> Second words.\n> More of them.\nHm."),
    ]
    got = {r[:2]: r[4:7] for r in link_parts(spark, rows)}
    assert got[1, 3] == (1, ["1:0", "1:2"], 2)
    assert got[1, 4] == (1, ["1:0", "1:1"], 1)
    assert got[1, 5] == (1, ["1:1"], 1)
    assert got[3, 1] == (1, ["1:1", "3:0"], 0)
    assert link_parts(spark, []) == []


def brute_parts(rows):
    """Sources, number of linked passages and parent by message, looking for the links of all parts."""
    parsed = {(c, t): parse(x) for c, t, _, x in rows}
    says: dict = {}
    for key, (said, _) in parsed.items():
        for h in units(said):
            says.setdefault(h, []).append(key)

    def source(body, c, t):
        for h, size in units(body).items():
            if size == len(re.sub(r"\s+", " ", body.lower()).strip()):
                here = min((k for k in says.get(h, []) if k[0] == c and k[1] < t), default=None)
                return (1, here) if here else (0, min(k for k in says[h] if k[0] != c)) if any(k[0] != c for k in says.get(h, [])) else None
        return None

    out = {}
    for (c, t), (_, quoted) in parsed.items():
        links, linked, replies = set(), 0, []
        for level, body in quoted:
            found = set()
            def walk(parts, outer):
                for part, below in parts:
                    s = source(part, c, t)
                    if s and s[0] > outer:
                        found.add(s)  # noqa: B023
                    walk(below, max(outer, s[0] if s else -1))
            walk([(body, [(p, [(x, []) for x in p.split("\n")]) for p in re.split(r"\n[ \t]*\n", body)])], -1)
            linked += bool(found)
            links |= {f"{a}:{b}" for _, (a, b) in found}
            replies += [(level, -k[1]) for same, k in found if same]
        out[c, t] = (linked, sorted(links), -min(replies)[1] if replies else None)
    return out


def test_every_part_as_a_plain_parser_finds_it(spark):
    rng = random.Random(11)
    rows, said = [], ["Alpha beta.", "Gamma", "zeta\n\neta theta", "one\ntwo", "two"]
    for c in range(4):
        for t in range(25):
            lines = []
            for _ in range(rng.randrange(1, 6)):
                level, body = rng.randrange(3), "\n\n".join(rng.sample(said, rng.choice([1, 1, 2])))
                lines += ["> " * level + line for line in body.split("\n")]
            rows.append((c, t, "u", "\n".join(lines)))
            said.append(f"word{rng.randrange(60)} says {t}")
    got = {r[:2]: r[4:7] for r in link_parts(spark, rows)}
    assert got == brute_parts(rows)
