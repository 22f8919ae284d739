"""Moves of sections between pages as proposals for a Store, and pins of index blocks."""

from __future__ import annotations

import re

from ..functions.python_text import rebase_links, units
from .store import Change, Rejected, Store

SLUG = re.compile(r"\A[a-z0-9]+(?:-[a-z0-9]+)*\Z")


def sections(text: str) -> list[tuple[str, str]]:
    """(heading, text with the heading) of the ``## `` sections; what comes before the first has the heading ''."""
    parts = re.split(r"(?m)^(?=## )", text)
    named = [(p.split("\n", 1)[0].strip(), p) for p in parts if p.startswith("## ")]
    return [("", parts[0]), *named] if parts and not parts[0].startswith("## ") else named


def _folder(path: str) -> str:
    return path.rpartition("/")[0]


def move_plan(store: Store, page: str, plan: dict[str, str], closed: str | None = None) -> list[Change]:
    """The changes that move a page's sections (by heading) to new pages (by slug), each leaving a pointer.

    Unknown headings, bad slugs and existing pages are refused. With ``closed``, the pointers stand under that
    heading; links are rebased; the store's own proof refuses a lost line.
    """
    text = store.read(page)
    if text is None:
        raise Rejected(f"no page: {page}")
    found = sections(text)
    names = [h for h, _ in found]
    for heading, slug in plan.items():
        if names.count(heading) != 1 or not heading:
            raise Rejected(f"not one section: {heading}")
        if not SLUG.match(slug):
            raise Rejected(f"slug: {slug}")
    hub = lambda slug: f"{_folder(page)}/topics/{slug}.md"
    out, kept, pointers = [], [], []
    for heading, body in found:
        if heading not in plan:
            kept.append(body)
            continue
        path = hub(plan[heading])
        if store.read(path) is not None:
            raise Rejected(f"exists: {path}")
        moved = rebase_links(body, _folder(page), _folder(path), lambda p: not p.startswith("..") and store.read(p) is not None)
        out.append(Change(path, moved if moved.endswith("\n") else moved + "\n", "move", f"moved from {page}", None))
        pointers.append(f"- [{heading[3:]}](topics/{plan[heading]}.md)\n")
    rest = "".join(k if k.endswith("\n") else k + "\n" for k in kept if k)
    if closed and closed in names:
        rest = re.sub(rf"(?m)^{re.escape(closed)}[ \t]*\n", lambda m: m[0] + "".join(pointers), rest, count=1)
    else:
        rest += (f"{closed}\n" if closed else "") + "".join(pointers)
    return [Change(page, rest, "move", f"sections moved to {len(out)} pages", store.revision(page)), *out]


def close_section(store: Store, page: str, heading: str, slug: str, closed: str) -> list[Change]:
    """One finished section to a page of its own, with a pointer under the closed heading."""
    return move_plan(store, page, {heading: slug}, closed)


def pin(state: dict[str, dict], index: str, fragment: str, fingerprint, pinned: bool = True) -> dict[str, dict]:
    """A store's salience state with the one block that holds the fragment pinned, or no longer pinned."""
    blocks = [t for _, kind, t in units(index) if kind == "block" and fragment in t]
    if len(blocks) != 1:
        raise Rejected(f"{len(blocks)} blocks hold the fragment")
    fp = fingerprint(blocks[0])
    entry = {k: v for k, v in state.get(fp, {}).items() if k != "pinned"}
    return {**state, fp: entry | ({"pinned": True} if pinned else {})}
