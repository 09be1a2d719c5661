"""Short blocks between content and boilerplate on pages without an article."""

from quarry.llm import html

LONG = ("This is the story of the man who was in the house and of the things that he had with him on that day. " * 4).strip()
LINKS = "<p><a href=x>Link one</a> <a href=y>Link two</a></p>"


def test_short_blocks_go_with_the_nearer_side():
    shorts = [f"Short line {k}." for k in range(5)]
    page = "<div>" + LINKS + "".join(f"<p>{x}</p>" for x in shorts) + f"<p>{LONG}</p>" + "".join(f"<p>{x}</p>" for x in shorts) + LINKS + "</div>"
    assert html.main_text(page).split("\n") == [*shorts[3:], LONG, *shorts[:2]]  # the middle ones are as far from both sides


def test_what_was_content_stays_content():
    near = "Harbour lamps of the old town burned in a row to the far end and went out slowly."
    page = f"<div>{LINKS}<p>{near}</p><p>Short.</p><h2>Heading</h2><p>Short.</p><p>Short.</p><p>{LONG}</p></div>"
    assert html.main_text(page).split("\n") == [near, "Heading", "Short.", "Short.", LONG]
