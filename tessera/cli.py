"""The command surface: sixteen commands over subtitle files, run as ``python -m tessera.cli COMMAND``."""

from __future__ import annotations

import argparse
import shutil
import sys
from datetime import datetime
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import joined
from tessera.operators import blocks as B
from tessera.operators import lint as L
from tessera.operators import merging as M
from tessera.operators import pairing as P
from tessera.operators import rules as R
from tessera.operators.status import status
from tessera.sources import srt as S
from tessera.sources.workspace import Workspace, shell_quoted, write_named

# Names of the glossary's columns.
SOURCE_COLUMN, TARGET_COLUMNS = "Gốc", {"vi": "Tiếng Việt", "en": "English"}
WRONG_COLUMN, RIGHT_COLUMN = "ASR nghe sai", "Đúng là"
PROGRAM = "python -m tessera.cli"


class Refused(Exception):
    """Ends a command with exit code 1."""


class Tool:
    def __init__(self, spark: SparkSession, out=None, workspace: str = "workspace"):
        self.spark, self.out, self.ws = spark, out or sys.stdout, Workspace(workspace)

    def say(self, *words) -> None:
        print(*words, file=self.out)

    def read(self, path: str) -> tuple[DataFrame, list]:
        """Blocks of a file and its faults; refuses what can't be read."""
        if not Path(path).is_file():
            raise Refused(f"cannot read {path}")
        blocks, errors = S.read_srt(self.spark, [str(Path(path).resolve())])
        faults = errors.orderBy("pos", "n").collect()
        if any(e["code"] == "not_utf8" for e in faults):
            raise Refused(f"not UTF-8: {path}")
        return blocks.cache(), faults

    def two(self, a) -> tuple[DataFrame, DataFrame, list, list]:
        (src, src_faults), (dst, dst_faults) = self.read(a.src), self.read(a.dst)
        one = lambda df: df.withColumn("pair", F.lit("0"))
        return one(src), one(dst), src_faults, dst_faults

    def aligned(self, a) -> tuple[DataFrame, DataFrame]:
        src, dst, *_ = self.two(a)
        if src.count() != dst.count():
            raise Refused(f"block counts differ: {src.count()} and {dst.count()}; see validate")
        return P.zipped(src, dst), dst

    def tables(self, path: str) -> DataFrame:
        if not Path(path).is_file():
            raise Refused(f"cannot read {path}")
        texts = S.files(self.spark, [str(Path(path).resolve())]).select(S.plain(F.col("content")).alias("text"))
        if texts.where("text is null").count():
            raise Refused(f"not UTF-8: {path}")
        return S.parse_tables(texts)

    def info(self, a) -> int:
        blocks, faults = self.read(a.file)
        for r in B.info(blocks).collect():
            self.say(f"file {a.file}\nblocks {r['n_blocks']}")
            if r["n_blocks"]:
                self.say(f"ids {r['first_id']} -> {r['last_id']}\nends at {r['ends_at']}")
                if r["n_empty"]:
                    self.say(f"empty blocks {r['n_empty']}")
        self.faults(faults)
        return 1 if faults else 0

    def faults(self, faults, label: str = "") -> None:
        for e in faults:
            self.say(f"error {label}{e['code']} at block {e['pos']} {e['detail']}".rstrip())

    def text(self, a) -> int:
        blocks, faults = self.read(a.file)
        for e in faults:
            print(f"error {e['code']} at block {e['pos']}", file=sys.stderr)
        for r in B.text_rows(blocks, start=a.start, end=a.end).orderBy("pos").collect():
            self.say(f"{r['idx']} | {r['text']}")
        return 0

    def split(self, a) -> int:
        blocks, faults = self.read(a.file)
        if faults:
            self.faults(faults)
            return 1
        if self.ws.inside(a.out) is not None:
            raise Refused("split writes outside the workspace; edits of its files go by parts and text")
        Path(a.out).mkdir(parents=True, exist_ok=True)
        for old in Path(a.out).glob("part_*.srt"):
            old.unlink()
        texts = {r["part"]: r["srt"] for r in B.render(blocks.withColumn("part", B.part_of(a.size)), "part").collect()}
        for r in B.split_parts(blocks, size=a.size).orderBy("part").collect():
            write_named(Path(a.out) / r["name"], texts[r["part"]])
            self.say(f"{r['name']}  block {r['first_pos']}-{r['last_pos']}  (ID {r['first_id']}-{r['last_id']})")
        return 0

    def edits_of(self, source: Path) -> tuple[DataFrame, DataFrame]:
        return S.read_edits(self.spark, [str(source.resolve())], "part_*.txt" if source.is_dir() else None)

    def merge(self, a) -> int:
        blocks, faults = self.read(a.src)
        if faults:
            self.faults(faults, "SRC ")
            return 1
        source = Path(a.textfile)
        place = self.ws.misplaced(a.src, source, source.is_dir()) if self.ws.inside(source) is not None else None
        goal = self.ws.wrong_goal(a.src, source, a.out)
        if place or goal:
            raise Refused("; ".join(x for x in (place and f"{source.as_posix()} is out of place, must be {place}", goal and f"{a.out} must be {goal.as_posix()}") if x))
        if not (sorted(source.glob("part_*.txt")) if source.is_dir() else source.is_file()):
            raise Refused(f"no edits at {source.as_posix()}")
        edits, problems = self.edits_of(source)
        found = M.merge_problems(blocks, edits, problems).cache()
        for r in found.where("step <= 2").orderBy("step", "name", "place", "code").collect():
            self.say(f"error {r['name']} {r['code']} {r['detail']}".rstrip())
        for r in M.listed(found).orderBy("step").collect():
            self.say(f"error {r['code']} {r['n']} IDs: {r['ids']}" + " ..." * (r["n"] > M.SHOWN_IDS))
        if not found.isEmpty():
            return 1
        result = M.merged(blocks, M.combined(edits)).cache()
        kept, n = result.where("kept").count(), result.count()
        write_named(a.out, B.render(result).first()["srt"])
        self.say(f"merged {n} blocks -> {a.out} ({kept} kept)")
        if a.cleanup and source.is_dir():
            shutil.rmtree(source)
            self.say(f"removed {source.as_posix()}/")
        return 0

    def diff(self, a) -> int:
        src, dst, *_ = self.two(a)
        if src.count() != dst.count():
            self.say(f"warning block counts differ: {src.count()} and {dst.count()}")
        for r in P.diff(src, dst, a.loose).where(F.col("n") <= a.limit).orderBy("pos").collect():
            self.say(f"[{r['src_id']}] - {r['src_text']}\n[{r['dst_id']}] + {r['dst_text']}\n")
        r = P.diff_counts(src, dst, a.loose).first()
        self.say(f"changed {r['changed'] if r else 0}/{r['total'] if r else 0} blocks")
        return 0

    def validate(self, a) -> int:
        src, dst, src_faults, dst_faults = self.two(a)
        frame = lambda faults: self.spark.createDataFrame([("0", e["pos"], e["code"], e["detail"]) for e in faults], "pair string, pos int, code string, detail string")
        issues = P.validate(src, dst, a.target, frame(src_faults), frame(dst_faults)).cache()
        for r in P.shown(issues).orderBy("severity", "n").collect():
            self.say(f"{r['severity']} ID {r['id']} {r['kind']} {r['detail']}")
        n = {r["severity"]: r["count"] for r in issues.groupBy("severity").count().collect()}
        for s, most in P.SHOWN.items():
            if n.get(s, 0) > most:
                self.say(f"and {n[s] - most} more of severity {s}")
        self.say(f"SRC {src.count()} blocks | DST {dst.count()} blocks | {n.get('error', 0)} errors | {n.get('warning', 0)} warnings")
        self.say("result " + ("FAIL" if n.get("error") else "PASS"))
        return 1 if n.get("error") else 0

    def pair(self, a) -> int:
        try:
            ids = B.parse_ids(a.ids) if a.ids else None
        except ValueError as e:
            raise Refused(str(e)) from e
        both, _ = self.aligned(a)
        for r in P.pair_rows(both, a.start, a.end, ids).orderBy("pos").collect():
            self.say(f"{r['id']} | {r['src']} | {r['dst']}")
        return 0

    def report_glossary(self, both: DataFrame, a) -> None:
        rules = R.fetch(S.rules_of(self.tables(a.glossary), SOURCE_COLUMN, TARGET_COLUMNS[a.target]))
        found = R.glossary_violations(both, rules, a.start, a.end).cache()
        for r in found.orderBy("pos", "rule_no").collect():
            self.say(f"ID {r['id']}: {r['hit']!r} wants {r['wanted']!r} | {r['src']} | {r['dst']}")
        self.say(f"{len(rules)} terms on {both.where(B.in_range(a.start, a.end)).count()} blocks: {found.count()} violations")
        for r in R.violation_counts(found).orderBy("rank").collect():
            self.say(f"  {r['cell']}: {r['n']}")

    def check_glossary(self, a) -> int:
        both, _ = self.aligned(a)
        self.report_glossary(both, a)
        return 0

    def glossary(self, a) -> int:
        if not Path(a.glossary).exists():
            self.say(f"no {Path(a.glossary).as_posix()}: an empty glossary")
            return 0
        wanted = None
        if a.section:
            try:
                wanted = {i for low, high in B.parse_ids(a.section.replace(" ", "")) for i in range(low, high + 1)}
            except ValueError as e:
                raise Refused(str(e)) from e
        texts = S.files(self.spark, [str(Path(a.glossary).resolve())]).select(S.plain(F.col("content")).alias("text"))
        if texts.where("text is null").count():
            raise Refused(f"not UTF-8: {a.glossary}")
        rows = S.glossary_lines(texts, wanted).orderBy("line_no").collect()
        out = "\n".join(r["line"] for r in rows)
        while "\n\n\n" in out:
            out = out.replace("\n\n\n", "\n\n")
        if out.strip():
            self.say(out.strip())
        if absent := sorted((wanted or set()) - {r["section"] for r in rows}):
            self.say(f"(no section {', '.join(map(str, absent))})")
        return 0

    def report_lint(self, both: DataFrame, dst: DataFrame, a) -> None:
        terms = [t for r in R.fetch(S.rules_of(self.tables(a.glossary), SOURCE_COLUMN, SOURCE_COLUMN, approved_only=False)) for t in r.sources] if Path(a.glossary).exists() else []
        found = L.lint(both, dst, a.start, a.end, a.cps, terms).cache()
        texts = both.select("pair", "pos", joined(F.col("s.lines")).alias("src"), joined(F.col("d.lines")).alias("dst"))
        for r in found.join(texts, ["pair", "pos"]).orderBy("pos", "step", "detail").collect():
            self.say(f"ID {r['id']} | {r['kind']} | {r['detail']} | {r['src']} | {r['dst']}")
        kinds = ", ".join(f"{r['kind']} {r['n']}" for r in L.lint_counts(found).orderBy("rank").collect())
        self.say(f"lint: {found.count()} issues" + (f" ({kinds})" if kinds else ""))

    def lint(self, a) -> int:
        both, dst = self.aligned(a)
        self.report_lint(both, dst, a)
        return 0

    def review_prep(self, a) -> int:
        self.say("## validate")
        self.validate(a)
        self.say("\n## glossary")
        both, dst = self.aligned(a)
        if Path(a.glossary).exists():
            self.report_glossary(both, a)
        else:
            self.say(f"no {a.glossary}")
        self.say("\n## lint")
        self.report_lint(both, dst, a)
        self.say("\n## read side by side")
        n = both.count()
        first, last = a.start or 1, min(a.end or n, n)
        for at in range(first, last + 1, a.size):
            self.say(f"{PROGRAM} pair {shell_quoted(a.src)} {shell_quoted(a.dst)} --from {at} --to {min(at + a.size - 1, last)}")
        return 0

    def scan(self, patterns: list[str]) -> tuple[DataFrame, DataFrame]:
        """The blocks of all files in one scan, and the files (n, path, name) in the order given, repeated ones too."""
        paths, none = S.expand(patterns)
        for p in none:
            self.say(f"warning nothing matches {p!r}")
        for p in paths:
            if not Path(p).is_file():
                raise Refused(f"cannot read {p}")
        named = [(n, str(Path(p).resolve()), Path(p).name) for n, p in enumerate(paths)]
        order = self.spark.createDataFrame(named, "n int, path string, name string")
        if not paths:
            return self.spark.createDataFrame([], "path string, pos int, idx string, timing string, lines array<string>"), order
        blocks, errors = S.read_srt(self.spark, sorted({p for _, p, _ in named}))
        if broken := errors.where("code = 'not_utf8'").select("path").orderBy("path").first():
            raise Refused(f"not UTF-8: {broken['path']}")
        return blocks, order

    def find(self, a) -> int:
        blocks, order = self.scan(a.files)
        try:
            found = B.find(blocks, a.pattern, "path", regex=a.regex).cache()
            rows = found.join(order, "path").orderBy("n", "pos").collect()
        except PySparkException as e:
            raise Refused(f"bad pattern: {a.pattern}") from e
        for r in rows:
            self.say(f"{r['name']} | {r['idx']} | {r['text']}")
        totals = B.hit_totals(B.hits_by_file(found, order)).first()
        self.say(f"{totals['n_blocks']} blocks in {totals['n_files']} files")
        return 0

    def check_asr(self, a) -> int:
        rules = R.fetch(S.rules_of(self.tables(a.glossary), WRONG_COLUMN, RIGHT_COLUMN))
        if not rules:
            self.say(f"no approved rows in {a.glossary}")
            return 0
        blocks, order = self.scan(a.files)
        rows = R.asr_hits(blocks, rules, "path").join(order, "path").orderBy("n", "pos", "rule_no").collect()
        for r in rows:
            self.say(f"{r['name']} | {r['idx']} | {r['hit']!r} should be {r['wanted']!r} | {r['text']}")
        self.say(f"{len(rules)} rules on {order.count()} files: {len(rows)} left")
        return 0

    def archive(self, a) -> int:
        for p in a.paths:
            try:
                goal = self.ws.archive(p, a.copy)
            except ValueError as e:
                raise Refused(str(e)) from e
            self.say(f"skipped, not there: {p}" if goal is None else f"{'copied' if a.copy else 'moved'} {p} -> {goal}")
        return 0

    def parts(self, a) -> int:
        blocks, faults = self.read(a.src)
        if faults:
            self.faults(faults, "SRC ")
            return 1
        folder = Path(a.dir)
        if place := self.ws.misplaced(a.src, folder, True):
            raise Refused(f"{folder.as_posix()} is out of place, must be {place}")
        there = sorted(p.name for p in folder.glob("part_*.txt"))
        present = self.spark.createDataFrame([(p,) for p in there], "name string")
        if there:
            edits, problems = self.edits_of(folder)
        else:
            edits, problems = (self.spark.createDataFrame([], f"name string, line_no int, {c}") for c in ("idx string, text string", "code string, detail string"))
        rows = M.part_states(blocks, edits, problems, present, size=a.size).orderBy("part").collect()
        for r in rows:
            why = [f"{r['n_problems']} problems", *[f"{r['n_missing']} IDs missing from {r['first_missing']}"] * (r["n_missing"] > 0), *[f"extra IDs {r['extra_ids']}"] * (r["n_extra"] > 0)]
            self.say(f"{r['name']}  block {r['first_pos']}-{r['last_pos']}  {r['state']}" + f" ({'; '.join(why)})" * (r["state"] == "error"))
        surplus = [p for p in there if p > f"part_{len(rows):03d}.txt"]
        for p in surplus:
            self.say(f"{p}  surplus")
        todo = [r for r in rows if r["state"] != "done"]
        self.say(f"{len(rows) - len(todo)}/{len(rows)} parts done")
        if surplus:
            self.say("archive the surplus parts first")
        elif todo:
            r = todo[0]
            self.say(f"next {r['name']}: {PROGRAM} text {shell_quoted(a.src)} --from {r['first_pos']} --to {r['last_pos']}\n  write {shell_quoted(folder / r['name'])}")
        else:
            goal = self.ws.goal_of(a.src, folder)
            self.say(f"merge: {PROGRAM} merge {shell_quoted(a.src)} {shell_quoted(folder)} {shell_quoted(goal) if goal else '<target>'} --cleanup")
        return 1 if todo or surplus else 0

    def status_rows(self, languages: list[str]) -> DataFrame:
        """The status relation of the workspace; all files are parsed and compared in one batch."""
        ws, spark = self.ws, self.spark
        empty = spark.createDataFrame([], "path string, stem string, mtime timestamp")
        seen = {}
        for d in (ws.raw, ws.cleaned, ws.trans):
            void = [(str(p.resolve()), p.stem, datetime.fromtimestamp(p.stat().st_mtime)) for p in d.glob("*.srt") if not p.stat().st_size]  # Spark's scan leaves them out
            listed = S.catalogue(spark, str(d.resolve())) if any(d.glob("*.srt")) else empty
            seen[d.name] = listed.unionByName(spark.createDataFrame(void, empty.schema))
        plain = lambda df, stage: df.select("path", F.col("stem").alias("name"), F.lit(None).cast("string").alias("language"), F.lit(stage).alias("stage"), "mtime")
        trans = seen["trans"].where(F.col("stem").rlike(S.NAME_AND_LANGUAGE)).select("path", F.regexp_extract("stem", S.NAME_AND_LANGUAGE, 1).alias("name"), F.regexp_extract("stem", S.NAME_AND_LANGUAGE, 2).alias("language"), F.lit("trans").alias("stage"), "mtime")
        names = plain(seen["raw"], "raw").unionByName(plain(seen["cleaned"], "cleaned")).unionByName(trans).cache()
        paths = [str(p.resolve()) for d in (ws.raw, ws.cleaned, ws.trans) for p in d.glob("*.srt")]
        if not paths:
            return names.select("name")
        blocks, errors = (df.join(names, "path").cache() for df in S.read_srt(spark, paths))
        unreadable = errors.where("code = 'not_utf8'").select("stage", "name", "language").distinct()

        def verdicts(src_stage: str, dst_stage: str) -> DataFrame:
            pairs = names.where(F.col("stage") == dst_stage).select("name", "language", F.concat_ws("\0", "name", "language").alias("pair")).join(names.where(F.col("stage") == src_stage).select("name"), "name")
            side = lambda df, stage: df.where(F.col("stage") == stage).drop("language" if stage == src_stage else "none").join(pairs if stage == src_stage else pairs.select("name", "language", "pair"), ["name"] if stage == src_stage else [df["name"].eqNullSafe(pairs["name"]), df["language"].eqNullSafe(pairs["language"])])
            src, dst = side(blocks, src_stage).select("pair", "pos", "idx", "timing", "lines"), side(blocks, dst_stage).select("pair", "pos", "idx", "timing", "lines")
            wrong = [side(errors, s).select("pair", "pos", "code", "detail") for s in (src_stage, dst_stage)]
            judged = P.verdicts(P.validate(src, dst, None, *wrong), pairs)
            broken = side(unreadable, src_stage).select("pair").unionByName(side(unreadable, dst_stage).select("pair")).distinct().withColumn("broken", F.lit(True))
            return pairs.join(judged, "pair").join(broken, "pair", "left").select("name", "language", F.when(F.col("broken").isNull(), F.col("passed")).alias("passed"))

        found = [(n.parent.name, n.stem.removeprefix("review."), n) for n in ws.work.glob("*/review.*.md")]
        notes = spark.createDataFrame([(n, c, p.read_text("utf-8", "replace"), p.stat().st_mtime) for n, c, p in found], "name string, language string, body string, at double")
        reviews = notes.select("name", "language", S.count_open(F.col("body")).alias("n_open"), F.timestamp_millis((F.col("at") * 1000).cast("long")).alias("mtime"))
        return status(names, verdicts("raw", "cleaned").select("name", "passed"), verdicts("cleaned", "trans"), reviews, languages)

    def status(self, a) -> int:
        rows = self.status_rows([p.stem.removeprefix("target-") for p in Path(a.targets).glob("target-*.md")])
        if rows.columns == ["name"]:
            self.say(f"no subtitle files; put them into {self.ws.raw.as_posix()}/")
            return 0
        cells = {(r["name"], r["language"] or r["stage"]): r for r in rows.collect()}
        languages = sorted({r["language"] for r in cells.values() if r["language"]})
        table = [["name", "raw", "cleaned", *languages]]
        for name in sorted({n for n, _ in cells}):
            row = [name]
            for column in table[0][1:]:
                r = cells.get((name, column))
                cell = "-" if r is None or r["state"] == "absent" else r["state"].upper() if r["state"] in ("pass", "fail") else r["state"]
                if r is not None:
                    cell += " · source changed later" * r["stale"]
                    if r["review"]:
                        cell += f" · review: {r['review']}" + (f" ({r['n_open']})" if r["n_open"] else "") + " (old)" * r["review_old"]
                row.append(cell)
            table.append(row)
        widths = [max(len(r[i]) for r in table) for i in range(len(table[0]))]
        for r in [table[0], ["-" * w for w in widths], *table[1:]]:
            self.say("  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip())
        return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog=PROGRAM)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *arguments: str, limits: bool = False, **options) -> None:
        s = sub.add_parser(name)
        for x in arguments:
            s.add_argument(x)
        if limits:
            s.add_argument("--from", dest="start", type=int, default=0)
            s.add_argument("--to", dest="end", type=int, default=0)
        for flag, how in options.items():
            s.add_argument(flag if flag in ("files", "paths") else f"--{flag}", **how)

    number, book = {"type": int, "default": 100}, {"default": "workspace/glossary.md"}
    target = lambda needed: {"choices": ["vi", "en"], "required": needed}
    flag, many, speed = {"action": "store_true"}, {"nargs": "+"}, {"type": float, "default": 20.0}
    add("info", "file")
    add("text", "file", limits=True)
    add("split", "file", size=number, out={"required": True})
    add("merge", "src", "textfile", "out", cleanup=flag)
    add("diff", "src", "dst", limit={"type": int, "default": 50}, loose=flag)
    add("validate", "src", "dst", target=target(False))
    add("pair", "src", "dst", limits=True, ids={})
    add("check-glossary", "src", "dst", limits=True, target=target(True), glossary=book)
    add("glossary", section={}, glossary=book)
    add("lint", "src", "dst", limits=True, target=target(False), glossary=book, cps=speed)
    add("review-prep", "src", "dst", limits=True, target=target(True), glossary=book, cps=speed, size=number)
    add("find", "pattern", files=many, regex=flag)
    add("check-asr", files=many, glossary=book)
    add("archive", paths=many, copy=flag)
    add("parts", "src", "dir", size=number)
    add("status", targets={"default": "references", "help": "folder of target-<code>.md, one for each language to be listed"})
    return p


def run(arguments: list[str], spark: SparkSession | None = None, out=None) -> int:
    a = parser().parse_args(arguments)
    if getattr(a, "size", 1) < 1:
        parser().error("--size must be 1 or more")
    spark = spark or SparkSession.builder.appName("tessera").config("spark.ui.enabled", "false").getOrCreate()
    tool = Tool(spark, out)
    tool.ws.bootstrap()
    try:
        return getattr(tool, a.command.replace("-", "_"))(a)
    except Refused as e:
        tool.say(f"error {e}")
        return 1


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
