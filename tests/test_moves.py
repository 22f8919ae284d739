"""Section moves keep every line; pins name one block."""

import pytest

from mnemospark.sources.moves import close_section, move_plan, pin, sections
from mnemospark.sources.store import Rejected, Store

PAGE = "projects/p/context/MEMORY.md"
TEXT = "# M\nintro\n## Index\n- [n](note.md)\n## Pending\n- [n](note.md) to do\n- two\n## Decided\nno\n"


@pytest.fixture
def store(tmp_path):
    s = Store(str(tmp_path))
    s.apply([s.change(PAGE, TEXT, "create"), s.change("projects/p/context/note.md", "n\n", "create")])
    return s


def test_sections_join_to_the_page():
    assert "".join(b for _, b in sections(TEXT)) == TEXT and [h for h, _ in sections(TEXT)] == ["", "## Index", "## Pending", "## Decided"]


def test_plan_moves_a_section_with_its_links(store):
    store.apply(move_plan(store, PAGE, {"## Decided": "decided"}))
    assert "## Decided" not in store.read(PAGE) and "(topics/decided.md)" in store.read(PAGE)
    assert store.read("projects/p/context/topics/decided.md") == "## Decided\nno\n"
    with pytest.raises(Rejected):
        move_plan(store, PAGE, {"## Index": "decided"})


def test_close_section_points_from_the_closed_heading(store):
    changes = close_section(store, PAGE, "## Decided", "old", "## Closed")
    assert changes[0].text.endswith("## Closed\n- [Decided](topics/old.md)\n")
    moved = move_plan(store, PAGE, {"## Pending": "pending"})[1]
    assert "(../note.md)" in moved.text
    store.apply(move_plan(store, PAGE, {"## Pending": "pending"}))
    assert "(../note.md) to do" in store.read("projects/p/context/topics/pending.md")


def test_bad_plans_are_refused(store):
    for plan in ({"## Nope": "a"}, {"## Pending": "Bad Slug"}, {"": "x"}):
        with pytest.raises(Rejected):
            move_plan(store, PAGE, plan)


def test_pin_needs_one_block():
    fp = str.strip
    assert pin({}, "- one\n- two\n", "two", fp) == {"- two": {"pinned": True}}
    assert pin({"- two": {"pinned": True, "first_seen": "d"}}, "- one\n- two\n", "two", fp, False) == {"- two": {"first_seen": "d"}}
    with pytest.raises(Rejected):
        pin({}, "- a b\n- a c\n", "a", fp)
