"""Pages without <article> or <main> keep all of the article's element."""

import pytest

from basewise.llm import main_text

MENU = "<div><ul>" + "".join(f"<li><a href='/{i}'>Section {i}</a>" for i in range(8)) + "</ul></div>"
ENDS = {
    "list": ("<ul>" + "".join(f"<li>item number {i} of the last list" for i in range(6)) + "</ul>", [f"item number {i} of the last list" for i in range(6)]),
    "table": ("<table>" + "".join(f"<tr><td>name {i}<td>{i * i}</tr>" for i in range(6)) + "</table>", [x for i in range(6) for x in (f"name {i}", str(i * i))]),
    "short": ("<section><p>Short.</p><p>The end</p></section>", ["Short.", "The end"]),
    "references": ("<ol>" + "".join(f"<li>Author {i}, a title of some length, <a>journal</a></li>" for i in range(6)) + "</ol>", [f"Author {i}, a title of some length, journal" for i in range(6)]),
}


@pytest.mark.parametrize("paragraphs", [1, 5, 10, 20])
@pytest.mark.parametrize("end", ENDS)
def test_closing_parts_stay(paragraphs, end):
    html, texts = ENDS[end]
    own = [f"Paragraph {i}. " + "Words of it, and more of them. " * 9 + "End." for i in range(paragraphs)]
    page = f"<html><body>{MENU}<div><h1>Head</h1>{''.join(f'<p>{p}</p>' for p in own)}{html}</div>{MENU}</body></html>"
    assert main_text.extract(page).split("\n") == ["Head", *own, *texts]


def test_links_between_go():
    text = "<p>" + "Words of it, and more of them. " * 9 + "</p>"
    page = f"<body><div>{text * 4}<ul><li><a>More of this</a><li><a>And of that</a></ul>{text * 4}<p>Last</p></div></body>"
    got = main_text.extract(page).split("\n")
    assert len(got) == 9 and got[-1] == "Last"
