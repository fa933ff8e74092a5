"""The workspace's folders: which path belongs to which work, and versioned backups.

``STEPS`` says how files move on: sources of a folder, the names that work on them may have, and the file
that comes of it.  ``OWNERS`` says to which name a path belongs.  All checks read these two tables.
"""

from __future__ import annotations

import itertools
import re
import shutil
import time
from pathlib import Path
from typing import NamedTuple

# The folders, and what a language code looks like.
FOLDERS = ["raw", "cleaned", "trans"]
CODE = r"[a-z]{2,3}(-[A-Za-z0-9]+)?"


class Step(NamedTuple):
    work: str  # pattern of the work's name
    shown: str  # how a message names it
    goal: str  # the file that the work becomes


STEPS = {
    "raw": Step("cleaned", "cleaned", "cleaned/{name}.srt"),
    "cleaned": Step(CODE, "<code>", "trans/{name}.{work}.srt"),
}
#: Patterns of paths below the workspace, or of whole paths elsewhere; the first that fits tells the name.
OWNERS = [
    r"work/(?P<name>[^/]+)/(?!backup(?:/|$)).+",
    r"work(?:/.*)?",  # the work folder itself, a work's own one, or a backup: nobody's
    r"(?:.*/)?trans/(?P<name>[^/]+?)(?:\.[^./]*)?\.[^./]*",
    r"(?:.*/)?(?P<name>[^/]+?)(?:\.[^./]*)?",
]


class Workspace:
    def __init__(self, root: str | Path = "workspace"):
        self.root = Path(root)
        self.raw, self.cleaned, self.trans = (self.root / d for d in FOLDERS)
        self.work = self.root / "work"

    def bootstrap(self) -> None:
        """Makes the folders that files are put into; only where there is a workspace."""
        if self.root.is_dir():
            for d in (self.raw, self.cleaned, self.trans):
                d.mkdir(exist_ok=True)

    def inside(self, path: str | Path) -> str | None:
        """The path below the workspace, with slashes, or None if it lies elsewhere."""
        own, top = Path(path).resolve(), self.root.resolve()
        return own.relative_to(top).as_posix() if own.is_relative_to(top) else None

    def step_of(self, src: str | Path) -> Step | None:
        """What happens to a source; None for files outside the workspace's own folders."""
        return STEPS.get(Path(src).parent.name) if self.inside(src) is not None else None

    def misplaced(self, src: str | Path, path: str | Path, folder: bool) -> str | None:
        """None if edits of ``src`` may lie at ``path``, else where they have to."""
        step = self.step_of(src)
        if step is None:
            return None
        home, suffix = f"work/{Path(src).stem}/", "" if folder else ".txt"
        if re.fullmatch(re.escape(home) + step.work + re.escape(suffix), self.inside(path) or ""):
            return None
        return f"{self.root.as_posix()}/{home}{step.shown}{suffix}"

    def goal_of(self, src: str | Path, edits: str | Path) -> Path | None:
        """The file that a merge writes: known from the source's folder and the edits' name."""
        step, edits = STEPS.get(Path(src).parent.name), Path(edits)
        if step is None:
            return None
        work = edits.stem if edits.suffix == ".txt" and not edits.is_dir() else edits.name
        return self.root / step.goal.format(name=Path(src).stem, work=work)

    def wrong_goal(self, src: str | Path, edits: str | Path, out: str | Path) -> Path | None:
        """None if a merge may write ``out``, else the file it has to write.  Paths elsewhere are free."""
        goal = self.goal_of(src, edits)
        return None if goal is None or self.inside(out) in (None, self.inside(goal)) else goal

    def backup_of(self, path: str | Path) -> Path:
        """The backup folder for a path; ValueError for what is nobody's."""
        where = self.inside(path) or Path(path).resolve().as_posix()
        owner = next(m.groupdict() for p in OWNERS if (m := re.fullmatch(p, where)))
        if not owner:
            raise ValueError(f"not to be archived: {path}")
        return self.work.resolve() / owner["name"] / "backup"

    def archive(self, path: str | Path, copy: bool = False) -> Path | None:
        """Moves or copies a file or folder to its backup folder under the minute's name; None if there is none."""
        own = Path(path)
        if not own.exists():
            return None
        folder, minute = self.backup_of(own), time.strftime("%Y%m%d-%H%M")
        stem, suffix = (own.name, "") if own.is_dir() else (own.stem, own.suffix)
        turns = itertools.chain([""], (f"-{n}" for n in itertools.count(2)))
        goal = next(g for t in turns if not (g := folder / f"{stem}.{minute}{t}{suffix}").exists())
        folder.mkdir(parents=True, exist_ok=True)
        take = shutil.move if not copy else shutil.copytree if own.is_dir() else shutil.copy2
        take(str(own), str(goal))
        return goal


def write_named(path: str | Path, text: str) -> None:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode("utf-8"))


def shell_quoted(path: str | Path) -> str:
    text = Path(path).as_posix()
    return f'"{text}"' if re.search(r"[\s'&;()]", text) else text
