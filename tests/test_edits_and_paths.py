"""Edits, parts, places and the state of a workspace, on generated cases with expectations from the rules."""

import itertools
import os
import random
import re
from pathlib import Path

import pytest

from tessera.sources.workspace import Workspace

from .files import subs, tool  # noqa: F401  a fixture

STEMS = ["K9", "Lọc (2)", "x.y"]
WORKS = ["cleaned", "fr", "pt-BR", "yue", "FR", "french", "f", "fr_CA", "backup"]


def belongs(stage, work):
    """Cleaning has one work, a translation is named by its language's code."""
    return work == "cleaned" if stage == "raw" else bool(re.fullmatch("[a-z]{2,3}(-[A-Za-z0-9]+)?", work))


@pytest.mark.parametrize("stage, stem", itertools.product(["raw", "cleaned", "trans"], STEMS))
def test_place_of_edits(tmp_path, stage, stem):
    ws = Workspace(tmp_path / "workspace")
    src = ws.root / stage / f"{stem}.srt"
    for work, home, folder in itertools.product(WORKS, [stem, f"{stem}_", "."], [True, False]):
        at = ws.work / home / (work + ("" if folder else ".txt"))
        right = stage == "trans" or home == stem and belongs(stage, work)
        said = ws.misplaced(src, at, folder)
        assert (said is None) == right, (at, said)
        assert right or said.endswith(f"work/{stem}/{'cleaned' if stage == 'raw' else '<code>'}" + ("" if folder else ".txt"))
    assert ws.misplaced(tmp_path / f"{stem}.srt", ws.work / "any", True) is None  # a source elsewhere is free


@pytest.mark.parametrize("stem", STEMS)
def test_goal_of_a_merge(tmp_path, stem):
    ws = Workspace(tmp_path / "workspace")
    for stage, work, ending in [("raw", "cleaned", ""), ("raw", "cleaned", ".txt"), ("cleaned", "fr", ""), ("cleaned", "pt-BR", ".txt")]:
        src, edits = ws.root / stage / f"{stem}.srt", ws.work / stem / (work + ending)
        goal = ws.cleaned / f"{stem}.srt" if stage == "raw" else ws.trans / f"{stem}.{work}.srt"
        for out in [goal, src, ws.trans / f"{stem}.de.srt", ws.root / "x.srt", tmp_path / "x.srt"]:
            inside = out.is_relative_to(ws.root)
            assert ws.wrong_goal(src, edits, out) == (goal if inside and out != goal else None), (src, edits, out)


def test_commands_refuse_wrong_places(tool):  # noqa: F811
    tool.write("workspace/raw/K9.srt", subs("uno"))
    tool.write("workspace/work/K9/draft.txt", "1 | due\n")
    code, out = tool.run("merge", "workspace/raw/K9.srt", "workspace/work/K9/draft.txt", "workspace/trans/K9.srt")
    assert code == 1 and "must be workspace/work/K9/cleaned.txt" in out and "must be workspace/cleaned/K9.srt" in out
    assert not Path("workspace/trans/K9.srt").exists()
    assert tool.run("parts", "workspace/raw/K9.srt", "workspace/work/K9/fr")[0] == 1
    for at in ("workspace", "workspace/trans/K9", "workspace/work/K9/parts"):
        assert tool.run("split", "workspace/raw/K9.srt", "--out", at)[0] == 1 and not list(Path("workspace").rglob("part_*"))


@pytest.mark.parametrize("n, size", [(1, 4), (8, 4), (9, 4), (5, 100)])
def test_split_by_size(tool, n, size):  # noqa: F811
    texts = [f"t{i}\nu{i}" if i % 3 == 0 else f"t{i}" for i in range(1, n + 1)]
    tool.write("in.srt", subs(*texts))
    tool.write("cut/part_077.srt", "left over")
    tool.write("cut/notes.md", "stays")
    code, out = tool.run("split", "in.srt", "--out", "cut", "--size", str(size))
    starts = range(0, n, size)
    assert code == 0 and [p.name for p in sorted(Path("cut").iterdir())] == ["notes.md", *[f"part_{k:03d}.srt" for k in range(1, len(starts) + 1)]]
    for k, at in enumerate(starts, 1):
        assert tool.read(f"cut/part_{k:03d}.srt") == subs(*texts[at : at + size], first=at + 1)
        assert f"part_{k:03d}.srt  block {at + 1}-{min(at + size, n)}" in out


def edit_lines(rng, ids):
    """(lines, what each ID becomes): kept, one line or two."""
    lines, new = [], {}
    for i in ids:
        own = rng.choice(["=", f"neu {i}", f"oben {i} / unten {i}"])
        lines.append(f"{i} |{rng.choice(['', ' '])}{own}")
        new[i] = None if own == "=" else own.replace(" / ", "\n")
    return lines, new


@pytest.mark.parametrize("seed", range(3))
def test_merge_writes_each_edit_once(tool, seed):  # noqa: F811
    rng = random.Random(seed)
    old = [f"  alt {i} " for i in range(1, 11)]
    lines, new = edit_lines(rng, range(1, 11))
    rng.shuffle(lines)
    tool.write("in.srt", subs(*old))
    tool.write("edits.txt", rng.choice(["\n", "\r\n", "\n\n"]).join(lines))
    code, out = tool.run("merge", "in.srt", "edits.txt", "new/dir/out.srt")
    kept = sum(v is None for v in new.values())
    assert code == 0 and f"merged 10 blocks -> new/dir/out.srt ({kept} kept)" in out
    assert tool.read("new/dir/out.srt") == subs(*[o if new[i] is None else new[i] for i, o in enumerate(old, 1)])


@pytest.mark.parametrize("fault", [None, "missing", "extra", "twice", "empty", "no edits"])
def test_merge_of_a_folder(tool, fault):  # noqa: F811
    """Three parts of 4 blocks; with any fault nothing is written, and the parts stay."""
    old = [f"alt {i}" for i in range(1, 13)]
    parts = {k: [f"{i} | neu {i}" for i in range(4 * k - 3, 4 * k + 1)] for k in (1, 2, 3)}
    said = {"missing": "missing 1 IDs: 6", "extra": "extra 1 IDs: 13", "twice": "part_003.txt other_part 2", "empty": "part_001.txt empty_text 4", "no edits": "no edits"}.get(fault, "")
    match fault:
        case "missing":
            del parts[2][1]
        case "extra":
            parts[3].append("13 | zu viel")
        case "twice":
            parts[3].insert(0, "2 | anders")
        case "empty":
            parts[1][3] = "4 |  "
        case "no edits":
            parts = {}
    tool.write("workspace/raw/Q.srt", subs(*old))
    home = Path("workspace/work/Q/cleaned")
    home.mkdir(parents=True)
    for k, lines in parts.items():
        tool.write(home / f"part_{k:03d}.txt", "\n".join(lines))
    code, out = tool.run("merge", "workspace/raw/Q.srt", str(home), "workspace/cleaned/Q.srt", "--cleanup")
    assert (code, home.exists(), Path("workspace/cleaned/Q.srt").exists()) == ((1, True, False) if fault else (0, False, True))
    assert said in out and (fault or tool.read("workspace/cleaned/Q.srt") == subs(*[f"neu {i}" for i in range(1, 13)]))


KINDS = {
    "todo": None, "done": lambda ids: [f"{i} | ok" for i in ids], "fewer": lambda ids: [f"{i} | ok" for i in ids[1:]],
    "more": lambda ids: [f"{i} | ok" for i in [*ids, 500]], "unread": lambda ids: [f"{i} | ok" for i in ids] + ["???"],
}


@pytest.mark.parametrize("kinds", [("todo", "done", "fewer"), ("done", "more", "todo"), ("unread", "done", "done"), ("done", "done", "done")])
def test_parts_tell_what_is_left(tool, kinds):  # noqa: F811
    """Parts of 6, 6 and 2 blocks."""
    blocks = [range(1, 7), range(7, 13), range(13, 15)]
    tool.write("workspace/cleaned/Q 1.srt", subs(*[f"alt {i}" for i in range(1, 15)]))
    home = "workspace/work/Q 1/fr"
    for k, (kind, ids) in enumerate(zip(kinds, blocks, strict=True), 1):
        if KINDS[kind]:
            tool.write(f"{home}/part_{k:03d}.txt", "\n".join(KINDS[kind](list(ids))))
    call = lambda: tool.run("parts", "workspace/cleaned/Q 1.srt", home, "--size", "6")
    code, out = call()
    for k, (kind, ids) in enumerate(zip(kinds, blocks, strict=True), 1):
        state = kind if kind in ("todo", "done") else "error"
        line = next(x for x in out.splitlines() if x.startswith(f"part_{k:03d}.txt"))
        assert line.startswith(f"part_{k:03d}.txt  block {ids[0]}-{ids[-1]}  {state}")
        assert (f"1 IDs missing from {ids[0]}" in line) == (kind == "fewer") and ("extra IDs 500" in line) == (kind == "more")
    left = [k for k, kind in enumerate(kinds, 1) if kind != "done"]
    assert code == bool(left) and f"{3 - len(left)}/3 parts done" in out
    if left:
        own = blocks[left[0] - 1]
        assert f"next part_{left[0]:03d}.txt" in out and f'text "workspace/cleaned/Q 1.srt" --from {own[0]} --to {own[-1]}' in out
    else:
        assert 'merge "workspace/cleaned/Q 1.srt" "workspace/work/Q 1/fr" "workspace/trans/Q 1.fr.srt"' in out
        tool.write(f"{home}/part_004.txt", "15 | zu viel")
        code, out = call()
        assert code == 1 and "part_004.txt  surplus" in out and "archive the surplus" in out


def test_archive_keeps_every_version(tool):  # noqa: F811
    kinds = {"workspace/cleaned/Q.srt": "Q", "workspace/trans/Q.pt-BR.srt": "Q", "workspace/work/Q/fr.txt": "Q", "workspace/work/R/notes/a.md": "R"}
    for path, name in kinds.items():
        tool.write(path, path)
        code, out = tool.run("archive", "--copy", path, path, path)
        kept = [p for p in Path(f"workspace/work/{name}/backup").iterdir() if p.name.startswith(f"{Path(path).stem}.2") and p.suffix == Path(path).suffix]
        assert code == 0 and out.count("copied") == 3 and len(kept) == 3 and {p.read_text() for p in kept} == {path}
        assert tool.run("archive", path)[0] == 0 and not Path(path).exists()
        assert "skipped" in tool.run("archive", path)[1]
    for path in ("workspace/work", "workspace/work/Q", "workspace/work/R/backup"):
        assert tool.run("archive", path)[0] == 1 and Path(path).exists()


def test_validate_agrees(tool):  # noqa: F811
    rows = [(f"第{i}句话在这里", f"câu thứ {i} ở đây") for i in range(1, 13)]
    code, out = tool.run("validate", *tool.pair(*zip(*rows, strict=True)), "--target", "vi")
    assert code == 0 and "0 errors" in out and "0 warnings" in out and "PASS" in out


def test_status_by_state(tool):  # noqa: F811
    """One work for each state a cell can have."""
    assert "no subtitle files" in tool.run("status")[1]
    source, good, long, bad = subs("一", "二"), subs("eins", "zwei"), subs("eins", "zwei", "drei"), b"\xfe\xfe"
    for name, files in {
        "fine": (source, good, good), "long": (source, source, long), "broken": (source, source, bad), "rough": (source, None, None), "lost": (None, None, good), "late": (source, source, good),
    }.items():
        for place, content in zip((f"raw/{name}.srt", f"cleaned/{name}.srt", f"trans/{name}.de.srt"), files, strict=True):
            if content is not None:
                tool.write(f"workspace/{place}", content)
                os.utime(f"workspace/{place}", (1_700_000_000 + len(place), 1_700_000_000 + len(place)))
    tool.write("workspace/work/fine/review.de.md", "### 1 | a | fixed\n### 2 | b | PENDING\n### 3 | c | unsure\n### 4 | d | pending \n")
    tool.write("workspace/work/late/review.de.md", "### 1 | a | fixed\n")
    os.utime("workspace/work/late/review.de.md", (1_600_000_000, 1_600_000_000))
    os.utime("workspace/cleaned/late.srt", (1_800_000_000, 1_800_000_000))
    code, out = tool.run("status")
    lines = {x.split()[0]: x for x in out.splitlines()}
    assert code == 0 and out.split()[:4] == ["name", "raw", "cleaned", "de"]
    assert [x for x in lines if x[0] not in "-n"] == sorted(["fine", "long", "broken", "rough", "lost", "late"])
    want = {"fine": "review: progressing (3)", "long": "FAIL", "broken": "unreadable", "lost": "no_source", "late": "source changed later · review: done (old)"}
    assert all(text in lines[name] for name, text in want.items()), out
    assert "PASS" in lines["fine"] and lines["rough"].split()[1:] == ["present", "-", "-"]
    tool.write("references/target-yue.md", "# Cantonese")
    assert tool.run("status")[1].split()[:5] == ["name", "raw", "cleaned", "de", "yue"]
