"""Page text, line templates, decontamination, chat formatting and licences: edge cases, and brute force where SQL doesn't reach."""

import hashlib
import random

import pytest
from conftest import SMALL, rows_of
from pyspark.sql import functions as F

from lodeweave.llm import chat_format, decontaminate, license_scan, line_templates, page_text
from lodeweave.llm.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SMALL).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and rows_of(got, columns) == rows_of(want, columns)


# --- page text ---


def longest(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_shared_lines_are_a_longest_common_subsequence():
    r = random.Random(5)
    for _ in range(1500):
        a, b = (r.choices("abcdef", k=r.randint(0, 14)) for _ in range(2))
        s = sorted(page_text.shared_lines(a, b))
        it = iter(b)
        assert len(s) == longest(a, b) and all(a[i] in it for i in s)


def test_blocks():
    page = (
        '<!DOCTYPE html><head><title>x</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use</div>'
        '<main><article><h1>T &amp; U</h1><p>a<b>b</b>c<br>d\n  e<p class="ad">buy<p>last<form>q<input></form><script>var t="</p>";</script></article><section id="comments"><p>hi</section></main><footer>z'
    )
    b = page_text.blocks(page)
    assert page_text.main_text(b, set()) == "T & U abc d e last"
    assert page_text.main_text(b, set(range(len(b)))) == "T & U abc d e last"  # what is marked as the article stays
    plain = page_text.blocks("<body><div>menu</div><div>the story</div><div>foot</div>")
    assert page_text.main_text(plain, {0, 2}) == "the story"
    shell = '<body class="has-sidebar"><div class="main-header">Top</div><div id="sidebar">s</div><div class="main-content"><div class="article-header">T</div><p>x</p><ul class="share-links"><li>y</ul></div><div class=copyright>c</div>'
    assert page_text.main_text(page_text.blocks(shell), set()) == "T x"
    assert page_text.blocks("") == [] and page_text.blocks("<p") == [] and page_text.blocks("a < b") == [("a < b", False, 0)]


PAGES = "page_id long, url string, html string, text string"


def test_pages_without_marks_lose_what_neighbours_share(spark):
    shell = "<div>Shop name</div><p>{}</p><div>imprint</div>"
    rows = [(i, f"http://h.example/a/{i}", shell.format(f"story {i}"), "clash") for i in range(30)] + [(100, None, None, None), (101, "http://lonely.example/", "<p>alone</p>", ""), (101, "http://lonely.example/", "<p>alone</p>", "")]
    out = sorted(page_text.extract(spark.createDataFrame(rows, PAGES)).select("page_id", "text", "n_chars").collect(), key=lambda r: r.page_id)
    assert [r.text for r in out[:30]] == [f"story {i}" for i in range(30)]
    assert out[30].text == "" and out[30].n_chars == 0 and len(out) == 33


def test_page_results_do_not_depend_on_partitions(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    run = lambda n: sorted((r.page_id, r.text, r.n_shared) for r in with_partitions(spark, n, lambda: page_text.extract(pages)).collect())
    one = run(1)
    assert one == run(7) and len(one) == pages.count()


def with_partitions(spark, n, make):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        return make().cache()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_no_pages(spark):
    assert page_text.extract(spark.createDataFrame([], PAGES)).count() == 0


# --- line templates ---

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_lines long"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0, 7) for i, t in texts], DOCS)


def test_lines(spark):
    long = "this line has a very own set of words number {} and then goes on"
    texts = [(i, f"own {'abcdefghij'[i]} of document {'abcdefghij'[i]} only\nShare this page 12{i} now\n\n{long.format(i)}") for i in range(6)]
    texts += [(50, None), (51, ""), (None, "Share this page 7 now\nof my own"), (5, texts[5][1])]
    out = line_templates.drop_recurring_lines(docs(spark, texts)).collect()
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert len(out) == len(texts) and out[0].n_lines in (1, 2, 4) and by[0].text == texts[0][1]  # the first keeps its lines
    assert by[3].text == "own d of document d only\n" and by[3].n_dropped == 2 and by[3].n_lines == 4
    assert by[50].text == by[51].text == "" and next(r for r in out if r.doc_id is None).text == "of my own"
    assert line_templates.drop_recurring_lines(docs(spark, [])).count() == 0


def dropped(spark, lines):
    """Lines dropped of documents that each have one of ``lines``."""
    out = line_templates.drop_recurring_lines(docs(spark, list(enumerate(lines)))).collect()
    return [r.n_dropped for r in sorted(out, key=lambda r: r.doc_id)]


def test_fields_that_vary(spark):
    names = "anna bert carl dora emil fred gina hans".split()
    assert dropped(spark, [f"user {x} logged in" for x in names]) == [0] + [1] * 7
    assert dropped(spark, [f"the article was written by {x} and first shown in our {x[::-1]} section" for x in names]) == [0] + [1] * 7
    assert dropped(spark, [f"{x} logged in here" for x in names]) == [0] * 8  # the first token leads to the leaf
    assert dropped(spark, [f"one {x} two {x} three" for x in names]) == [0] * 8
    assert dropped(spark, [f"a {x} b" for x in names]) == [0] * 8 and dropped(spark, [f"a {i} b" for i in range(8)]) == [0] + [1] * 7
    assert dropped(spark, [f"{x} {x} " * 4 + "some more of a line that isn't the same" for x in names]) == [0] * 8


def test_long_lines_recur_in_two_documents(spark):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    assert dropped(spark, [" ".join(words), " ".join(words[::-1]), " ".join([*words[:30], "other", *words[31:]]), " ".join(words[:49]), " ".join(words[:49])]) == [0, 0, 1, 0, 0]


def plain_templates(rows, min_docs=line_templates.MIN_DOCS):
    """(id, line number) of lines to drop, pair by pair: templates are all ways to leave out what may vary."""
    import itertools

    where = {}
    for i, text in rows:
        for at, line in enumerate(text.split("\n")):
            t = ["<*>" if any(c.isdigit() for c in x) else x for x in line.split()]
            n = len(t)
            if n >= 8:
                runs = [tuple(t[s * n // 8 : (s + 1) * n // 8]) for s in range(8)]
                ways = [tuple(None if k in pair else r for k, r in enumerate(runs)) for pair in itertools.combinations(range(8), 2)]
            elif n > 3:
                ways = [tuple(None if k == j else x for k, x in enumerate(t)) for j in range(1, n)]
            else:
                ways = [tuple(t)] if n == 3 else []
            for w in ways:
                where.setdefault((n, t[0], w), set()).add((i, at))
    gone = set()
    for (n, *_), places in where.items():
        ids = {i for i, _ in places}
        if len(ids) >= (line_templates.LONG_DOCS if n >= line_templates.LONG_TOKENS else min_docs):
            gone |= {(i, at) for i, at in places if i != min(ids)}
    return gone


def test_templates_against_brute_force(spark):
    import random

    r = random.Random(7)
    rows = []
    for i in range(120):
        lines = []
        for _ in range(r.randint(1, 12)):
            n = r.choice([1, 2, 3, 3, 4, 5, 6, 7, 8, 9, 12, 20, 55])
            base = random.Random(n * 10 + r.randrange(2))
            t = base.choices("the of a red blue green sun moon star 12".split(), k=n)
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                t[r.randrange(n)] = r.choice("x y z w v u 77".split())
            lines.append(" ".join(t))
        rows.append((i, "\n".join(lines)))
    gone = plain_templates(rows)
    got = {x.doc_id: x.text for x in line_templates.drop_recurring_lines(docs(spark, rows)).collect()}
    assert got == {i: "\n".join(x for at, x in enumerate(t.split("\n")) if (i, at) not in gone) for i, t in rows} and len(gone) > 100


def test_columns_of_the_operator_clash_with_none(spark):
    d = docs(spark, [(1, "some line of words"), (2, "other")]).withColumnsRenamed({"lang": "_id", "source": "_hash"}).withColumnRenamed("n_chars", "_lines")
    out = line_templates.drop_recurring_lines(d)
    assert out.columns == ["doc_id", "text", "_id", "_hash", "_lines", "n_lines", "n_dropped"] and out.count() == 2


# --- decontamination ---


def plain_scan(text, items, n):
    w = decontaminate.words_of(text)
    hit, found = set(), set()
    for item, t in items:
        p = decontaminate.words_of(t)
        k = min(n, len(p))
        grams = {tuple(p[i : i + k]) for i in range(len(p) - k + 1)} if k else set()
        for i in range(len(w) - k + 1 if k else 0):
            if tuple(w[i : i + k]) in grams:
                hit |= set(range(i, i + k))
                found.add(item)
    return len(hit), found


def test_search_against_brute_force():
    r = random.Random(3)
    for _ in range(400):
        word = lambda: r.choice("ab cd é".split())
        items = [(str(i), " ".join(word() for _ in range(r.randint(0, 9)))) for i in range(4)]
        text = ", ".join(word() for _ in range(r.randint(0, 40)))
        ranges, found = decontaminate.Tables([(i, decontaminate.words_of(t)) for i, t in items], 4).scan(decontaminate.words_of(text))
        assert (decontaminate.covered(ranges), found) == plain_scan(text, items, 4)


def test_decontaminate_edges(spark):
    d = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "One TWO three", "x"), (3, "One TWO three", "x"), (4, "two " * 5000, "x"), (5, "a zebra", "x")], "doc_id long, text string, n_hit string")
    b = spark.createDataFrame([(7, "one two three"), (7, "one two three"), (10, "TWO!"), (8, None), (9, ""), (None, "zebra")], "item_id long, text string")
    out = decontaminate.decontaminate(d, b).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r.n_items) for r in out] == [(0, 0, 0), (0, 0, 0), (3, 3, 2), (3, 3, 2), (5000, 5000, 1), (2, 1, 0)]
    assert out[-1].contaminated and out[-1].items_sha256 == out[0].items_sha256
    assert out[2].items_sha256 == hashlib.sha256(b"10,7").hexdigest() and out[0].items_sha256 == hashlib.sha256(b"").hexdigest()
    sharded = decontaminate.decontaminate(d, b, max_bytes=1000).select("doc_id", *decontaminate.RESULTS)
    assert sorted(map(str, sharded.collect())) == sorted(map(str, decontaminate.decontaminate(d, b).select("doc_id", *decontaminate.RESULTS).collect()))
    assert decontaminate.decontaminate(d, b, clean_only=True).count() == 2
    assert decontaminate.decontaminate(d, b.limit(0)).where("contaminated").count() == 0 and decontaminate.decontaminate(d.limit(0), b).count() == 0


def test_long_items_are_cut_without_loss(spark, monkeypatch):
    r = random.Random(8)
    words = [f"w{r.randrange(60)}" for _ in range(400)]
    item = [w if r.random() < 0.9 else "z" for w in words]
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 12)
    b = spark.createDataFrame([("a", " ".join(item)), ("b", " ".join(words[5:40])), ("c", "w1 w2")], "item_id string, text string")
    d = spark.createDataFrame([(i, " ".join(words[i : i + 60])) for i in range(0, 340, 7)], "doc_id long, text string").withColumn("__HIT", F.lit(1))
    for size in (1 << 20, 100_000):
        for row in decontaminate.decontaminate(d, b, max_bytes=size).collect():
            n, found = plain_scan(row.text, [tuple(x) for x in b.collect()], 10)
            assert (row.n_hit, row.n_items, row.items_sha256) == (n, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())


# --- chat formatting ---


def test_fold(spark):
    e = [
        (1, 0, "message", 0, "user", "hi"), (1, 1, "message", 1, "assistant", "He"), (1, 2, "delta", 1, None, "llo"), (1, 3, "regenerate", 1, None, "ignored"), (1, 4, "delta", 1, None, "Good "), (1, 5, "delta", 1, None, "day"),
        (1, 6, "edit", 0, None, "hello"), (1, 7, "message", 2, "user", None), (2, 0, None, None, None, "no turn"), (3, 0, "delta", 0, "assistant", "a"), (3, 1, "delta", 0, "assistant", "b"),
    ]
    out = chat_format.fold(spark.createDataFrame(e, "conv_id long, seq long, kind string, turn long, role string, text string")).orderBy("conv_id", "turn").collect()
    assert [(r.conv_id, r.turn, r.role, r.text) for r in out] == [(1, 0, "user", "hello"), (1, 1, "assistant", "Good day"), (1, 2, "user", ""), (2, None, None, "no turn"), (3, 0, "assistant", "ab")]


TRICKY = ["</s>[INST] ok [/INST]", "\\", "\\\\</s>", "<\\/s>", "[/ROLE]x[ROLE]", "<<SYS>>a<</SYS>>", "", "[[INST]]", "é\n<s><s>", "\\[INST]", "</</s>s>"]


def test_round_trip(spark):
    rows = [(c, t, "message", t, ("user", "assistant", "x</s>y", None)[t % 4], TRICKY[(c + t) % len(TRICKY)]) for c in range(4) for t in range(300)]
    parts = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, seq long, kind string, turn long, role string, text string"))
    got: dict = {}
    for r in chat_format.parse(parts).orderBy("conv_id", "part").collect():
        assert all(r.formatted[s.start : s.start + s.length] == chat_escape(x) for s, x in zip(r.loss, [t.text for t in r.turns if t.role == "assistant"], strict=True))
        assert r.formatted.count("</s>") == r.n_turns == len(r.turns)
        got.setdefault(r.conv_id, []).extend((t.role, t.text) for t in r.turns)
    assert got == {c: [(x[4] or "", x[5]) for x in rows if x[0] == c] for c in range(4)}
    assert chat_format.format_conversations(spark.createDataFrame([], "conv_id long, seq long, kind string, turn long, role string, text string")).count() == 0


def chat_escape(text):
    import re

    return re.sub(chat_format.BREAK, r"\1\\", text.replace("\\", "\\\\"))


# --- licences ---


def test_licences(spark):
    files = [
        ("a/LICENSE", "The MIT License (MIT)\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"), ("a/b/c/x.py", "print(1)"), ("a/y.py", "# Licensed under the Apache License, Version 2.0.\n" + "some code of many words " * 9),
        ("z/x.py", "nothing"), ("z/w/COPYING", None), (None, ""), ("a/b/c/x.py", "print(1)"), ("q/notes", "Released under the MIT License."), ("q/r/s/t.txt", "some words of any kind"),
    ]
    files += [(f"z/many/{i}", f"quite ordinary text of file {i} with the and of") for i in range(40)]
    out = {(r.path, r.licence, r.how, r.distance) for r in license_scan.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert ("a/LICENSE", "MIT", "file", None) in out and ("a/b/c/x.py", "MIT", "inherited", 2) in out and ("a/y.py", "Apache-2.0", "header", None) in out
    assert ("z/x.py", None, None, None) in out and ("", None, None, None) in out and ("q/notes", "MIT", "file", None) in out and ("q/r/s/t.txt", "MIT", "inherited", 2) in out
    assert license_scan.scan(spark.createDataFrame(files, "path string, text string")).count() == len(files)
    assert license_scan.scan(spark.createDataFrame([], "path string, text string")).count() == 0


def wrapped(text, mark="", width=70):
    import textwrap

    return "\n".join(f"{mark} {x}".strip() for x in textwrap.wrap(text, width))


def template(licence, of):
    return max((t for name, t in license_scan.TEMPLATES if name == licence and of in t), key=len)


def test_headers_and_whole_files(spark):
    """Licences that no single line states: headers of several lines, in comments, and whole files, among files with other texts."""
    code = "\n\nimport os\n\ndef main(argument):\n    return os.path.join(argument, 'data')\n"
    wants = {
        "gpl3": ("GPL-3.0", wrapped(template("GPL-3.0", "free software"), "#") + code), "agpl": ("AGPL-3.0", "/*\n" + wrapped(template("AGPL-3.0", "free software"), " *") + "\n */" + code),
        "lgpl": ("LGPL-2.1", wrapped(template("LGPL-2.1", "library"), "//") + code), "bsd3": ("BSD-3-Clause", wrapped(template("BSD-3-Clause", "Neither"))), "bsd2": ("BSD-2-Clause", wrapped(template("BSD-2-Clause", "Redistributions"), "", 50)),
        "mit": ("MIT", wrapped(template("MIT", "NONINFRINGEMENT")).replace("Permission is", "\n\nPermission is").replace("THE SOFTWARE IS", "\n\nTHE SOFTWARE IS")), "isc": ("ISC", wrapped(template("ISC", "DISCLAIMS"))),
        "mpl": ("MPL-2.0", wrapped(template("MPL-2.0", "distributed"), "//") + code), "apache": ("Apache-2.0", wrapped(template("Apache-2.0", "WARRANTIES"), "#") + code),
        "spdx1": ("MIT", "// SPDX-License-Identifier: MIT" + code), "spdx2": ("GPL-2.0", "# SPDX-License-Identifier: GPL-2.0-only" + code), "spdx3": (None, "# SPDX-License-Identifier: Homegrown-9" + code),
        "nc": ("CC-BY-NC-4.0", "Words about the sea.\nLicensed under CC BY-NC 4.0.\nMore words."), "none": (None, "A text that speaks of software, of a licence and of copyright holders, but grants none of its rights." + code),
    }
    files = [(f"{k}/x", text) for k, (_, text) in wants.items()] + [(f"z/{i}", f"quite ordinary text of file {i} with the and of{code}") for i in range(60)]
    got = {r.path: (r.licence, r.how) for r in license_scan.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert {k: got[f"{k}/x"][0] for k in wants} == {k: v for k, (v, _) in wants.items()}
    assert got["bsd3/x"][1] == got["mit/x"][1] == "file" and got["spdx1/x"][1] == "header"


def test_rival_licences(spark):
    """Licences that begin as others do, choices between two, and notices cut after their first paragraph."""
    code = "\n\nimport os\n\ndef main(argument):\n    return os.path.join(argument, 'data')\n"
    boost = template("BSL-1.0", "NON-INFRINGEMENT").replace(" Permission is", "\n\nPermission is").replace(" The copyright notices", "\n\nThe copyright notices").replace(" THE SOFTWARE IS", "\n\nTHE SOFTWARE IS")
    wants = {
        "boost/COPYING": ("BSL-1.0", "\n".join(wrapped(x) for x in boost.split("\n"))), "boost2/x.h": ("BSL-1.0", wrapped(template("BSL-1.0", "Distributed"), "//") + code),
        "dual/x.rs": ("Apache-2.0 OR MIT", "// SPDX-License-Identifier: MIT OR Apache-2.0" + code), "dual2/x.rs": ("Apache-2.0 OR MIT", wrapped("Licensed under the Apache License, Version 2.0 or the MIT license, at your option. This file may not be copied, modified, or distributed except according to those terms.", "//") + code),
        "kernel/x.c": ("GPL-2.0 OR MIT", "/* SPDX-License-Identifier: (GPL-2.0-only OR MIT) */" + code), "one/x.c": ("MIT", "/* SPDX-License-Identifier: MIT */" + code), "llvm/x.c": ("Apache-2.0 WITH LLVM-exception", "// SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception" + code),
        "gpl/x.c": ("GPL-3.0", wrapped(license_scan.GPL_GRANT.format(kind="", v="3"), "*") + code), "gpl2/x.c": ("GPL-2.0", wrapped(license_scan.GPL_GRANT.format(kind="", v="2"), "*") + code), "eupl/x.c": ("EUPL-1.2", "# Licensed under the EUPL, Version 1.2." + code),
        "mit/LICENSE": ("MIT", wrapped(template("MIT", "NONINFRINGEMENT"))), "apache/x.c": ("Apache-2.0", "# Licensed under the Apache License, Version 2.0." + code), "odd/x.c": (None, "// SPDX-License-Identifier: MIT OR Homegrown-9" + code),
        "boost/deep/y.c": ("BSL-1.0", code), "none/x.c": (None, "Permission is granted to no one." + code),
    }
    files = [(k, text) for k, (_, text) in wants.items()] + [(f"z/{i}", f"quite ordinary text of file {i} with the and of{code}") for i in range(60)]
    got = {r.path: r.licence for r in license_scan.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert {k: got[k] for k in wants} == {k: v for k, (v, _) in wants.items()}


def test_native_plans_hold_no_python(spark, monkeypatch):
    """Of the queries, and of all that they write on their way."""
    from lodeweave.llm import common, quality_rules

    plans = []

    def seen(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return common.cut(df, name)

    for module in (license_scan, line_templates, quality_rules):
        monkeypatch.setattr(module, "cut", seen)
    for name in ("op2_line_templates", "op8_chat_format", "op9_license_scan", "op10_quality_rules"):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        plans.append((name, plan))
    assert len(plans) >= 8
    for name, plan in plans:
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan, name
