"""Transactional changes of a file store, on the driver: validate, journal, replace, recover."""

from __future__ import annotations

import fcntl
import json
import os
import re
import tempfile
from collections import Counter
from collections.abc import Callable, Iterable
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from hashlib import sha256
from pathlib import Path

from ..functions.python_text import LINK, is_tied, named
from ..functions.text import REDACTIONS
from .files import confined

WRITABLE = re.compile(r"\A(?:context|projects/[A-Za-z0-9._-]+/context|skills/[A-Za-z0-9_-]+/(?:knowledge|references))/(?:[A-Za-z0-9._-]+/)*[A-Za-z0-9._-]+\.md\Z")
OPERATIONS = ("create", "append", "replace", "move")
MOST_CHANGES, MOST_CHARS = 100, 1_000_000
SECRETS = [re.compile(pattern) for pattern, _ in REDACTIONS]


class Conflict(Exception):
    """The store is no longer as the proposal saw it."""


class Rejected(Exception):
    """The proposal breaks a rule."""


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


@dataclass
class Change:
    path: str
    text: str
    operation: str
    reason: str
    before_sha256: str | None
    evidence: list[dict] = field(default_factory=list)


class Store:
    """Pages below a root and a journal beside them. One lock keeps writers apart; readers need none."""

    def __init__(self, root: str, secret: Callable[[str], bool] | None = None, caps: dict[str, int] | None = None):
        """secret: a further test of texts that are refused; what looks like a secret always is. caps: the most
        characters of pages, by path."""
        self.root, self.also_secret, self.caps = Path(root), secret, caps or {}
        self.journal = self.root / ".journal"
        self.journal.mkdir(parents=True, exist_ok=True)

    def secret(self, text: str) -> bool:
        return any(p.search(text) for p in SECRETS) or bool(self.also_secret and self.also_secret(text))

    def read(self, path: str) -> str | None:
        p = Path(confined(str(self.root), path))
        if any(x.is_symlink() for x in [p, *p.parents] if x != self.root and self.root in x.parents):
            raise Rejected(f"a symlink: {path}")
        return p.read_text(encoding="utf-8") if p.exists() else None

    def revision(self, path: str) -> str | None:
        text = self.read(path)
        return None if text is None else digest(text)

    def change(self, path: str, text: str, operation: str = "append", reason: str = "explicit write", evidence: Iterable[dict] = ()) -> Change:
        """A change with the revision it was made from."""
        return Change(path, text, operation, reason, self.revision(path), list(evidence))

    @contextmanager
    def locked(self):
        with (self.journal / "lock").open("w") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            yield

    def _replace(self, path: str, text: str) -> None:
        target = Path(confined(str(self.root), path))
        target.parent.mkdir(parents=True, exist_ok=True)
        fd, name = tempfile.mkstemp(dir=target.parent)
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, target)

    def _lines(self, path: str, text: str) -> list[str]:
        """A page's lines as a move must keep them: a link to a page by the page it names, a line with any other
        relative link together with its folder."""
        base = path.rpartition("/")[0]
        exists = lambda p: not p.startswith("..") and self.read(p) is not None
        whole = lambda m: m[0] if m[1] else f"{m[2]}@/{named(base, m[3])}"
        return [f"{base}\0{x.rstrip()}" if is_tied(x, base, exists) else LINK.sub(whole, x.rstrip()) for x in text.splitlines() if x.strip()]

    def validate(self, changes: list[Change]) -> None:
        if not 1 <= len(changes) <= MOST_CHANGES or len({c.path for c in changes}) != len(changes):
            raise Rejected("1 to 100 changes, each to its own page")
        moves = [c for c in changes if c.operation == "move"]
        if moves and len(moves) != len(changes):
            raise Rejected("a move is a batch of its own")
        for c in changes:
            before = self.read(c.path)
            if (None if before is None else digest(before)) != c.before_sha256:
                raise Conflict(c.path)
            if not WRITABLE.match(c.path) or c.operation not in OPERATIONS or not c.reason.strip():
                raise Rejected(c.path)
            if len(c.text) > min(MOST_CHARS, self.caps.get(c.path, MOST_CHARS)) or "\0" in c.text or self.secret(c.text):
                raise Rejected(f"content of {c.path}")
            if c.operation == "create" and before is not None or c.operation == "append" and before is not None and not c.text.startswith(before):
                raise Rejected(f"{c.operation} {c.path}")
            for e in c.evidence:
                if self.revision(e["path"]) != e["sha256"]:
                    raise Conflict(e["path"])
        if moves:
            lines = lambda pairs: Counter(x for path, t in pairs for x in self._lines(path, t))
            lost = lines((c.path, self.read(c.path) or "") for c in moves) - lines((c.path, c.text) for c in moves)
            if lost:
                raise Rejected(f"lost lines: {sorted(lost)[:3]}")

    def apply(self, changes: list[Change]) -> str:
        """All changes or none: written to the journal, then to the pages. Returns the batch's name."""
        with self.locked():
            self._recover()
            self.validate(changes)
            name = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%f")
            entry = {"status": "prepared", "created_at": name, "changes": [asdict(c) | {"before": self.read(c.path), "after_sha256": digest(c.text)} for c in changes]}
            path = self.journal / f"{name}.json"
            path.write_text(json.dumps(entry))
            for c in changes:
                self._replace(c.path, c.text)
            path.write_text(json.dumps(entry | {"status": "committed"}))
            return name

    def _recover(self) -> None:
        """Finish what was prepared; stop where a page has a revision that is neither the old nor the new one."""
        for path in sorted(self.journal.glob("*.json")):
            entry = json.loads(path.read_text())
            if entry["status"] != "prepared":
                continue
            for c in entry["changes"]:
                now = self.revision(c["path"])
                if now not in (c["before_sha256"], c["after_sha256"]):
                    raise Conflict(c["path"])
            for c in entry["changes"]:
                if self.revision(c["path"]) != c["after_sha256"]:
                    self._replace(c["path"], c["text"])
            path.write_text(json.dumps(entry | {"status": "committed"}))

    def recover(self) -> None:
        with self.locked():
            self._recover()
