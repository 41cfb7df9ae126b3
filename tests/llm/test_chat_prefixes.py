"""Black-box templates see whole prefixes, however long the conversation."""

import pytest

from basewise.llm import chat

TURNS = [("user" if i % 2 == 0 else "assistant", f"text {i}") for i in range(100)]


def last_40(turns):
    return chat.marked(turns[-40:])


def numbered(turns):
    return "".join(f"{i}:{x};" for i, (_, x) in enumerate(turns))


def alternating(turns):
    if any(role != ("user", "assistant")[i % 2] for i, (role, _) in enumerate(turns)):
        raise ValueError("roles must alternate, the user first")
    return chat.marked(turns)


def test_late_rewrites_are_found():
    assert chat.rewrites(TURNS, last_40) and not chat.rewrites(TURNS[:40], last_40)
    assert chat.rewrites(TURNS, lambda t: "summary;" * (len(t) > 33) + numbered(t))


@pytest.mark.parametrize("template", [numbered, alternating])
def test_position_is_no_rewrite(template):
    assert not chat.rewrites(TURNS, template)
    assert "".join(s.added for s in chat.render(TURNS[:99], template)) == template(TURNS[:99])


def test_own_template_keeps_its_window():
    renderer = chat.Renderer(chat.marked)
    assert "".join(renderer.add(*t).added for t in TURNS) == chat.marked(TURNS) and len(renderer.turns) <= chat.WINDOW


def test_format_turns(spark):
    def template(turns):
        return "".join(f"{i}:{x};" for i, (_, x) in enumerate(turns))

    rows = [(1, i, role, text) for i, (role, text) in enumerate(TURNS)]
    got = sorted(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), template).collect(), key=lambda r: r.position)
    assert "".join(r.added for r in got) == template(TURNS)
