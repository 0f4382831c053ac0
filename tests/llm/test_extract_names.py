"""Names of elements weigh lines, they don't delete prose; windows decide where no name does."""

import pytest

from quarrykit.llm import extract

PROSE = "This paragraph of prose has quite enough words in it to be told as a part of the article itself."
NAMES = "ad-hoc comment-on-law menu-of-the-day newsletter-history cookie-recipe modal-logic replies-to-critics navigation-acts popup-book respond sponsored-bill masthead-history breadcrumbs-recipe".split()


@pytest.mark.parametrize("element", ["article", "div"])
def test_prose_under_odd_names_stays(element):
    named = "".join(f'<p class="{n}">{PROSE} {n}</p>' for n in NAMES)
    listed = "<ul>" + "".join(f"<li><a href=y>Linked line number {k}</a></li>" for k in range(5)) + "</ul>"
    page = f"<body><nav><a href=x>home</a></nav><{element}><h1>T</h1><p>{PROSE} 1</p><p>{PROSE} 2</p>{named}{listed}<p>{PROSE} end</p></{element}><div class='sidebar'><p>{PROSE} side</p></div></body>"
    lines = extract.main_text(page).split("\n")
    assert lines == ["T", f"{PROSE} 1", f"{PROSE} 2", *(f"{PROSE} {n}" for n in NAMES), *(f"Linked line number {k}" for k in range(5) if element == "article"), f"{PROSE} end"]


@pytest.mark.parametrize("name", ["ad", "ad-slot", "adBox", "site-footer", "comment-list", "main-nav", "sidebar left", "cookie-consent", "newsletter_signup", "menu"])
def test_structure_goes(name):
    page = f"<body><div><h1>T</h1><p>{PROSE} 1</p><p>{PROSE} 2</p><div class='{name}'><p>{PROSE} gone</p></div><p>{PROSE} 3</p></div></body>"
    assert extract.main_text(page) == "\n".join(["T", *(f"{PROSE} {k}" for k in (1, 2, 3))])


def test_windows_decide_without_names():
    short = "".join(f"<div>Item {k}</div>" for k in range(12))
    page = f"<body>{short}<div>{PROSE}</div><div>{PROSE}</div><div>{PROSE}</div>{short}</body>"
    kept = extract.main_text(page)
    assert kept.count(PROSE) == 3
    wide, loose = extract.main_text(page, window=12), extract.main_text(page, surge=1, share=0.01)
    assert len({kept, wide, loose}) == 3 and loose.count("Item") == 24 > wide.count("Item") > kept.count("Item")
