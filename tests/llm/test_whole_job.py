"""Cases in which an operator once did less than its whole job."""

import random

from lodeweave.llm import near_duplicates, page_text, private_terms


def test_pairs_in_a_large_group_below_the_threshold(spark):
    r = random.Random(4)
    word = lambda: f"w{r.randrange(10**9)}"
    template = [word() for _ in range(256)]
    own = [[word() for _ in range(42)] for _ in range(300)]
    rows = [(i, " ".join(template + w)) for i, w in enumerate(own)]
    rows += [(1000 + i, " ".join(template + own[i][:26] + [word() for _ in range(16)])) for i in range(40)]
    got = {x.doc_id: x.class_id for x in near_duplicates.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i % 1000 for i, _ in rows}


def test_marks_on_a_page_drop_no_line_of_its_own(spark):
    page = '<div>Shop name</div><h1 class="entry-title">title {0}</h1><p>the whole story {0}</p><div>imprint</div>'
    rows = [(i, f"http://h.example/a/{i}", page.format(i)) for i in range(3)]
    out = {r.page_id: r.text for r in page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {i: f"title {i} the whole story {i}" for i in range(3)}
    marked = page_text.blocks("<div>menu</div><article>copied</article><div>note of this page</div>")
    assert page_text.main_text(marked, {0, 1}) == "copied note of this page"


def test_no_page_is_cut_off_from_its_host():
    r = random.Random(6)
    for n in (2, 5, 17):
        pages = sorted({(f"h{r.choice((0, 0, r.randrange(12)))}", f"/{r.randrange(10**6)}", i) for i in range(200)})
        starts = page_text.range_starts(sorted(r.sample(pages, 60)), n)
        assert starts == sorted(set(starts)) and len(starts) > n // 2 - 1
        place = lambda p: sum(s <= p for s in starts)
        for i, p in enumerate(pages):
            after = i + 1 < len(pages) and pages[i + 1][0] == p[0]  # the next page is in this range, or goes there as its neighbour
            before = i and pages[i - 1][0] == p[0]
            assert after or not before or place(pages[i - 1]) == place(p)


def test_disclosing_terms_are_marked_everywhere(spark):
    gap = "some quite ordinary words that tell nothing about anyone at all here"
    rows = [(i, f"ordinary words about the town {i}") for i in range(60)]
    rows += [(100 + i, f"Zorblax is back. {gap}. Write to zed@corp.example today, {i}") for i in range(4)]
    rows += [(200, f"{gap} zorblax"), (201, gap), (100, rows[60][1]), (300, None)] + [(400 + i, f"{gap} {i}") for i in range(40)]
    out = {r.doc_id: r for r in private_terms.find_private(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("term:0:7" in out[100 + i].spans and out[100 + i].n_email == 1 for i in range(4))
    at = len(gap) + 1
    assert out[200].spans == f"term:{at}:{at + 7}" and out[201].spans == "" and out[300].spans == ""
    assert private_terms.find_private(spark.createDataFrame([], "doc_id long, text string")).count() == 0
