"""Main text of pages: the linear scan against all regions, what the region does, learned features, odd pages."""

import random

from tipoff.llm import html_text as H


def test_best_region_against_all_regions():
    rng = random.Random(1)
    for _ in range(300):
        scores = [rng.choice([-3.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0]) for _ in range(rng.randint(0, 14))]
        a, b = H.best_region(scores)
        every = [(sum(scores[i:j]), -i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
        most = max((e[0] for e in every), default=0.0)
        if most <= 0:
            assert (a, b) == (0, 0)
        else:
            assert sum(scores[a:b]) == most


PAGE = "<body><div class=x9>Read more here</div><ul>{}</ul><div class=y3><h1>The title</h1><p>{}</p><ul><li>first thing of the list</li></ul><div class='z ad'>buy now</div><p>Last &amp; least\n words, which are a few more than the advert had.</p></div><ul>{}</ul><div>tail of it</div></body>"


def test_the_region_leaves_out_what_lies_beyond_menus():
    menu = "".join(f"<li><a href=/{k}>menu {k}</a></li>" for k in range(8))
    html = PAGE.format(menu, "many good words " * 20, menu)
    got = H.main_text(html)
    assert got == "The title\n" + ("many good words " * 20).strip() + "\nfirst thing of the list\nLast & least words, which are a few more than the advert had."
    whole = H.main_text(html, region=False)
    assert whole.startswith("Read more here\n") and whole.endswith("\ntail of it") and got in whole


def test_features_are_learned_without_their_names(spark):
    """Class names that no list holds are learned from pages that name their article, and then serve pages that do not."""
    rng = random.Random(2)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    inner = lambda w: f"<body><div class='qq'><p>{text(9)}</p></div>{w}<div class='zz'><p>{text(30)}</p></div></body>"
    named = [(k, "u", inner(f"<article><h1>{text(4)}</h1><p>{text(40)}</p><p>{text(20)}</p></article>")) for k in range(30)]
    body = f"<div><h1>{text(4)}</h1><p>{text(40)}</p><p>{text(20)}</p></div>"
    pages = spark.createDataFrame([*named, (99, "u", inner(body))], "page_id long, url string, html string")
    scores = H.learned(pages)
    assert scores.of(frozenset([".qq"]), "links:none") < 0 < scores.of(frozenset(), "links:none")
    got = {r["page_id"]: r["text"] for r in H.page_text(pages).collect()}
    want = body.replace("</h1><p>", "\n").replace("</p><p>", "\n")
    assert got[99] == want.replace("<div><h1>", "").replace("</p></div>", "")
    assert H.main_text(inner(body)) != got[99]


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (None, "u", "<p>one two"), (3, "u", "<p>a<!-- b"), (3, "u", "<p>a<!-- b"), (4, "u", "<p>" + "word " * 200_000), (5, "u", "<script>x</script><style>y"), (6, "u", "a <b>bold</b>move <br>on<p>x &lt;y&gt; &#233;</p>")]
    pages = spark.createDataFrame([(*r, "t", 1, 2) for r in rows], "page_id long, url string, html string, text string, n_chars int, o int")
    got = sorted(((r["page_id"] or 0, r["text"], r["n_chars"]) for r in H.page_text(pages).collect()))
    text = ("word " * 200_000).strip()
    assert got == [(0, "one two", 7), (1, "", 0), (2, "", 0), (3, "a", 1), (3, "a", 1), (4, text, len(text)), (5, "", 0), (6, "a boldmove on\nx <y> é", 21)]
    assert H.page_text(pages.limit(0)).count() == 0
