"""Pages of many templates, none of which is that of the given tables, and the region against brute force."""

import random

import pytest

from lexspan.llm import html_extract as X

LABELLED = ["<div class='banner'><p>ours</p></div><nav><a>Home</a> <a>News</a></nav><article><h1>T</h1><p>words of the text that is read</p><p>more of it</p></article><footer>all rights</footer>"] * 30
STORIES = [
    ("Sailing at night", ["The sea was calm and the stars stood high above us.", "We took our bearings by &lsquo;Polaris&rsquo; & wrote them down.", "At dawn the coast came into view."]),
    ("A history of bread", ["Grain was ground between two stones for ages.", "Later on came mills, and with them cheaper flour."]),
    ("Modal logic", ["Necessity and possibility are <em>dual</em> to one another.", "A frame is a set of worlds with a relation.", "See the <a href='/x'>next chapter</a> for proofs."]),
]
MENU = "<ul><li><a href='/'>Home</a></li><li><a href='/a'>About us</a></li><li><a href='/c'>Contact</a></li></ul>"


def paragraphs(story):
    return "".join(f"<p>{p}</p>" for p in story[1])


def expected(story):
    plain = [p.replace("&lsquo;", "‘").replace("&rsquo;", "’").replace("<em>", "").replace("</em>", "").replace("<a href='/x'>", "").replace("</a>", "") for p in story[1]]
    return "\n".join([story[0], *plain])


TEMPLATES = {
    "article with a menu": lambda t, s: f"<nav>{MENU}</nav><article><h1>{t}</h1>{s}</article><footer><p>Foot of the page</p></footer>",
    "main with an aside": lambda t, s: f"<header><div class='site-nav'>{MENU}</div></header><main><h1>{t}</h1>{s}</main><aside><p>Read these other stories of ours too</p></aside>",
    "divisions by id": lambda t, s: f"<div id='menu'>{MENU}</div><div id='content'><h1>{t}</h1>{s}</div><div id='footer'><p>Imprint and privacy</p></div>",
    "divisions by class": lambda t, s: f"<div class='navbar navbar-fixed'>{MENU}</div><div class='post'><h1>{t}</h1>{s}</div><div class='sidebar'><p>Latest posts of this week</p></div>",
    "camel case": lambda t, s: f"<div id='topNav'>{MENU}</div><div id='mainContent'><h1>{t}</h1>{s}</div><div id='cookieBanner'><p>We use cookies on this site</p></div>",
    "one form around all": lambda t, s: f"<form id='aspnetForm'><div class='menu'>{MENU}</div><div><h1>{t}</h1>{s}</div></form>",
    "names like boilerplate": lambda t, s: f"<nav>{MENU}</nav><main><section id='navigation-at-sea'><h1 id='market-share'>{t}</h1>{s}</section></main>",
    "a class beside a known one": lambda t, s: f"<article><section class='banner history'><h1>{t}</h1>{s}</section></article><div class='comments'><p>First! I liked it a lot.</p></div>",
    "search around all": lambda t, s: f"<div class='search'><h1>{t}</h1>{s}</div>",
    "reader comments": lambda t, s: f"<article><h1>{t}</h1>{s}<section id='comments'><h2>Comments</h2><p>Nice one, thank you for it.</p></section></article>",
    "newsletter in the text": lambda t, s: f"<main><h1>{t}</h1>{s}<div class='newsletter-signup-form'><p>Get our letter by mail each week</p></div></main>",
    "scripts and hidden parts": lambda t, s: f"<article><h1>{t}</h1><script>var a = '<p>no</p>';</script>{s}<div hidden><p>not seen</p></div><style>p {{}}</style></article>",
    "old tables": lambda t, s: f"<table><tr><td class='nav'>{MENU}</td><td><h1>{t}</h1>{s}</td></tr></table>",
    "unclosed": lambda t, s: f"<nav>{MENU}</nav><article><h1>{t}</h1>{s.replace('</p>', '')}</article>",
}


@pytest.mark.parametrize("story", STORIES, ids=lambda s: s[0])
@pytest.mark.parametrize("template", TEMPLATES)
def test_pages_of_many_templates(template, story):
    page = f"<!DOCTYPE html><html><head><title>no</title></head><body>{TEMPLATES[template](story[0], paragraphs(story))}</body></html>"
    for weights in (X.Weights(), X.learn(LABELLED)):
        assert X.extract(page, weights) == expected(story)


def test_controls_stand_within_a_line():
    assert X.extract("<p>Press <button>OK</button> now</p><p>or <input> wait</p>", X.Weights()) == "Press now\nor wait"
    assert X.extract("<button><div>Sub</div></button><p>seen</p>", X.Weights()) == "seen"


def test_regions_of_parsed_pages_by_force():
    """The run of tokens with the highest sum, over all pairs of ends, on pages whose boilerplate is taken out the same way."""
    weights = X.learn(LABELLED)
    for i in range(60):
        r = random.Random(i)
        bits = [r.choice(["<p>some words of text</p>", "<div>", "</div>", "<nav>a b</nav>", "<ul><li>x y z</li></ul>", "<a href='#'>link</a>", "loose words", "<aside><p>q q</p></aside>", "<h2>head</h2>"]) for _ in range(r.randint(1, 12))]
        page = X.parse("".join(bits), weights.words)
        scores = X.scored(page, weights)
        a, b = X.best_region(scores)
        sums = [sum(scores[x:y]) for x in range(len(scores)) for y in range(x + 1, len(scores) + 1)]
        assert sum(scores[a:b]) == pytest.approx(max([0.0, *sums]))
        assert all(s == 0.0 for s, (*_, node) in zip(scores, page.tokens, strict=True) if page.nodes[node].pruned)
