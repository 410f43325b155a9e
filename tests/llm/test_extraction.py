"""Main text: windows against brute force, pages that only the windows can tell apart, and broken pages."""

import time

import numpy as np
import pytest

from lodestone.llm import extraction as X

LONG = "A paragraph of text that says something, at some length. " * 4
TEASER = "<article><h2>See</h2><p>More of it.</p></article>"


def brute(page, window, near):
    """Every window by itself, regions line by line."""
    lines = X.weighed(X.strip(page), window)
    sums = [sum(w for _, w, _ in lines[max(0, i - (window - 1) // 2) : i + window // 2 + 1]) for i in range(len(lines))]
    label, here = [None] * len(lines), None
    for i, s in enumerate(sums):
        here = None if s == 0 else i if here is None else here
        label[i] = here
    peak = {r: max(sums[i] for i in range(len(lines)) if label[i] == r) for r in label if r is not None}
    own = {r: any(a for (_, _, a), x in zip(lines, label, strict=True) if x == r) for r in peak}
    top = max(peak, key=lambda r: (peak[r], own[r]), default=None)
    least = near * peak[top] if top is not None and own[top] else 0
    return "\n".join(t for (t, _, _), r in zip(lines, label, strict=True) if t and r is not None and peak[r] >= least)


def test_windows_match_brute_force():
    rng = np.random.default_rng(9)
    tags = ["div", "p", "article", "section", "li", "ul", "a", "nav", "main", "span class=ad", "footer", "h2", "td"]
    for _ in range(400):
        out, opened = [], []
        for _ in range(rng.integers(1, 60)):
            kind = rng.integers(0, 5)
            if kind < 2:
                out.append(f"<{(tag := tags[rng.integers(0, len(tags))])}>")
                opened.append(tag.split()[0])
            elif kind == 2 and opened:
                out.append(f"</{opened.pop(rng.integers(0, len(opened)))}>")
            else:
                out.append("word " * int(rng.integers(1, 12)))
        page = "".join(out)
        for window in (1, 2, 3, 5):
            for near in (0.0, 0.25, 0.8):
                assert X.main_text(page, window, near) == brute(page, window, near), page


@pytest.mark.parametrize(("page", "want"), [
    (f"<article><p>{LONG}</p></article><div><p>Elsewhere, unmarked.</p></div>", LONG.strip()),  # beside an article
    (f"<article><p>{LONG}</p></article>{TEASER}", LONG.strip()),
    (f"<article><p>{LONG}</p></article><article><p>{LONG}</p></article>", f"{LONG.strip()}\n{LONG.strip()}"),  # as long as it is
    (f"<div><p>{LONG * 60}</p></div>{TEASER}", f"{(LONG * 60).strip()}\nSee\nMore of it."),  # the article isn't the page's text: all stays
    (f"<article><p>{LONG}</p><div><div><div></div></div></div><div class=ad><p>a</p><p>b</p><p>c</p><p>d</p></div><section><div><p>Fin.</p></div></section></article>", f"{LONG.strip()}\nFin."),
    ("<ul><li><a href=1>Home</a><li><a href=2>About</a></ul><div></div><div></div><p>Text.</p><p><a href=3>and its link</a></p>", "Text.\nand its link"),
])
def test_surge_and_dive_decide(page, want):
    assert X.main_text(page) == want


def test_leaving_the_windows_out_changes_results():
    page = f"<article><p>{LONG}</p></article>{TEASER}<div><p>Elsewhere.</p></div>"
    every_line = "\n".join(t for t, _, never, _ in X.strip(page) if t and not never)
    assert X.main_text(page) == LONG.strip() != every_line
    assert X.main_text(page, near=0.0) == every_line
    links = "<ul><li><a href=1>Home</a></ul><div></div><div></div><div></div><p>Text.</p>"
    assert X.main_text(links) == "Text." and X.main_text(links, window=21) == "Home\nText."


@pytest.mark.parametrize("deep", [1, 7, 40])
def test_hidden_inline_elements_end_where_they_end(deep):
    assert X.main_text(f"<span class=ad>ad {'<div>' * deep}</span><p>one</p><p>two</p>") == "one\ntwo"
    assert X.main_text("<p>a <span class=ad>b <span>c</span> d</span> e</p>") == "a\ne"
    assert X.main_text(f"<article><p>one</p>{'<div>' * deep}<article class=comment><p>mine!</p></article>two</article>") == "one\ntwo"


@pytest.mark.parametrize("bad", ['<a href="x ', "<a 'x\">", "<!x ", "<script>", '<div "', "<p x='\" ", "<!-- ", "</div>", "<div>", "<span class=ad>", "<a href='<", "<![CDATA[", "<"])
def test_broken_pages_in_linear_time(bad):
    began = time.perf_counter()
    for page in (bad * (1_000_000 // len(bad)), "<p>x</p>" + bad * (1_000_000 // len(bad)) + ">"):
        X.main_text(page)
    assert time.perf_counter() - began < 20
