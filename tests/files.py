"""Subtitle files for tests, and the commands run on them."""

import io

import pytest

from tessera import cli


def subs(*texts, first=1):
    """A file with a block every four seconds that stays for two."""
    at = lambda seconds: f"00:{seconds // 60:02d}:{seconds % 60:02d},250"
    out = ""
    for n, text in enumerate(texts, first):
        out += "\n" * (n > first) + f"{n}\n{at(4 * n)} --> {at(4 * n + 2)}\n{text}\n"
    return out


@pytest.fixture
def tool(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    for d in ("raw", "cleaned", "trans"):
        (tmp_path / "workspace" / d).mkdir(parents=True)

    class Tool:
        def write(self, path, content):
            p = tmp_path / path
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_bytes(content if isinstance(content, bytes) else content.encode())
            return p

        def run(self, *arguments):
            out = io.StringIO()
            return cli.run(list(arguments), spark, out), out.getvalue()

        def pair(self, src, dst, name="a.vi"):
            self.write("workspace/cleaned/a.srt", subs(*src))
            self.write(f"workspace/trans/{name}.srt", subs(*dst))
            return "workspace/cleaned/a.srt", f"workspace/trans/{name}.srt"

        def read(self, path):
            return (tmp_path / path).read_text("utf-8")

    return Tool()
