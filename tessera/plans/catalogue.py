"""Queries over the driver's tables, and the SQL that gives the same rows.

The tables hold no subtitles, so rows are mapped onto blocks the same way on both sides: a document is
a file whose lines are blocks, one second each; a conversation is a file whose turns are blocks.  The
edited side of a document is made from it by fixed changes on some lines.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import blocks as B
from tessera.operators import lint as L
from tessera.operators import merging as M
from tessera.operators import pairing as P
from tessera.operators import rules as R
from tessera.operators.chunks import output_numbers
from tessera.operators.status import status
from tessera.sources import srt as S
from tessera.sources import srt_files as W

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (WITH + sql) if not sql.lstrip().startswith("WITH") else sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clock(seconds) -> F.Column:
    part = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return F.concat(part(F.floor(seconds / 3600), 2), F.lit(":"), part(F.floor(seconds / 60) % 60, 2), F.lit(":"), part(seconds % 60, 2), F.lit(",000"))


def timing(first, last) -> F.Column:
    return F.concat(clock(first), F.lit(" --> "), clock(last))


def doc_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pair"), F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    pos = F.col("at") + 1
    return rows.select("pair", pos.alias("pos"), pos.cast("string").alias("idx"), timing(pos, pos + 1).alias("timing"), F.array("line").alias("lines"))


ASCII = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def edited_blocks(src: DataFrame) -> DataFrame:
    """The changes: see EDITED for the same in SQL."""
    line, k = F.col("lines")[0], F.col("pair") + F.col("pos")
    new = (
        F.when(k % 11 == 0, F.regexp_replace(line, "[0-9]", "N")).when(k % 13 == 0, F.translate(line, *ASCII)).when(k % 17 == 0, "").when(k % 19 == 0, F.concat(line, F.lit(" **bold**")))
        .when(k % 23 == 0, F.concat(line, F.lit(" Ctrl plus R"))).when(k % 7 == 0, F.concat(line, F.lit(" !")))
        .otherwise(line)
    )
    last = F.max("pos").over(Window.partitionBy("pair"))
    kept = src.withColumn("last", last).where(~((F.col("pair") % 29 == 0) & (F.col("pos") == F.col("last")) & (F.col("pos") > 1)))
    return kept.select(
        "pair", "pos", F.when(k % 31 == 0, (F.col("pos") + 1000).cast("string")).otherwise(F.col("idx")).alias("idx"),
        F.when(k % 37 == 0, timing(F.col("pos"), F.col("pos") + 2)).otherwise(F.col("timing")).alias("timing"), F.array(new).alias("lines"),
    )


def both_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    src = doc_blocks(spark, sf_dir)
    return src, edited_blocks(src)


def turn_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = (F.col("turn") + 1).cast("int")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("pair"), pos.alias("pos"), pos.cast("string").alias("idx"), timing(pos, pos + 1).alias("timing"), F.array("text").alias("lines"), "role")


def turn_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """User turns as the source, the assistant's answers as the target."""
    rows = turn_blocks(spark, sf_dir)
    src = rows.where("role = 'user'").drop("role")
    dst = rows.where("role = 'assistant'").withColumn("pos", F.col("pos") - 1).drop("role")
    return src, dst


WITH = r"""
WITH lines AS (
  SELECT doc_id AS pair, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS INTEGER) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
src AS (
  SELECT pair, pos, CAST(pos AS VARCHAR) AS idx, line,
         printf('%02d:%02d:%02d,000 --> %02d:%02d:%02d,000', pos // 3600, (pos // 60) % 60, pos % 60, (pos + 1) // 3600, ((pos + 1) // 60) % 60, (pos + 1) % 60) AS timing FROM lines),
edited AS (
  SELECT pair, pos, pair + pos AS k, line, timing, idx, max(pos) OVER (PARTITION BY pair) AS last FROM src),
dst AS (
  SELECT pair, pos, CASE WHEN k % 31 = 0 THEN CAST(pos + 1000 AS VARCHAR) ELSE idx END AS idx,
         CASE WHEN k % 37 = 0 THEN printf('%02d:%02d:%02d,000 --> %02d:%02d:%02d,000', pos // 3600, (pos // 60) % 60, pos % 60, (pos + 2) // 3600, ((pos + 2) // 60) % 60, (pos + 2) % 60) ELSE timing END AS timing,
         CASE WHEN k % 11 = 0 THEN regexp_replace(line, '[0-9]', 'N', 'g')
              WHEN k % 13 = 0 THEN translate(line, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')
              WHEN k % 17 = 0 THEN '' WHEN k % 19 = 0 THEN line || ' **bold**' WHEN k % 23 = 0 THEN line || ' Ctrl plus R' WHEN k % 7 = 0 THEN line || ' !' ELSE line END AS line
  FROM edited WHERE NOT (pair % 29 = 0 AND pos = last AND pos > 1)),
zip AS (SELECT s.pair, s.pos, s.idx AS sid, d.idx AS did, s.timing AS stime, d.timing AS dtime, s.line AS sline, d.line AS dline,
               regexp_replace(regexp_replace(s.line, '^\s+', ''), '\s+$', '') AS st, regexp_replace(regexp_replace(d.line, '^\s+', ''), '\s+$', '') AS dt
        FROM src s JOIN dst d USING (pair, pos)),
sizes AS (SELECT s.pair, n_src, n_dst FROM (SELECT pair, count(*) AS n_src FROM src GROUP BY pair) s JOIN (SELECT pair, count(*) AS n_dst FROM dst GROUP BY pair) d USING (pair)),
turns AS (SELECT conv_id AS pair, CAST(turn + 1 AS INTEGER) AS pos, CAST(turn + 1 AS VARCHAR) AS idx, role, text FROM conversations)
"""

ISSUES = r"""
, issues AS (
  SELECT pair, pos, 3 AS step, sid AS id, 'error' AS severity, 'id_changed' AS kind, sid || ' -> ' || did AS detail FROM zip WHERE sid <> did
  UNION ALL SELECT pair, pos, 4, sid, 'error', 'timing_changed', stime || ' => ' || dtime FROM zip WHERE stime <> dtime
  UNION ALL SELECT pair, pos, 5, did, 'error', 'dst_empty', '' FROM zip WHERE st <> '' AND dt = ''
  UNION ALL SELECT pair, pos, 6, did, 'warning', 'markup', substr(dt, 1, 60) FROM zip WHERE regexp_matches(dt, '(?im)```|\*\*|^#{1,6}\s|^>\s|translated by|bản dịch bởi')
  UNION ALL SELECT pair, pos, 7, did, 'warning', 'bad_shortcut', 'Ctrl plus ' FROM zip WHERE regexp_matches(dt, '(^|[^a-z])Ctrl plus R$')
  UNION ALL SELECT pair, pos, 8, did, 'warning', 'cjk_left', substr(dt, 1, 60) FROM zip WHERE regexp_matches(dt, '[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}]')
  UNION ALL SELECT pair, pos, 9, did, 'warning', 'vietnamese_left', substr(dt, 1, 60) FROM zip WHERE regexp_matches(dt, '[ăâđêôơưĂÂĐÊÔƠƯạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ]')
  UNION ALL SELECT pair, 0, 2, '', 'error', 'block_count', n_src || ' -> ' || n_dst FROM sizes WHERE n_src <> n_dst
  UNION ALL SELECT pair, 1073741824, 10, '', 'warning', 'untranslated', CAST(count(*) AS VARCHAR) FROM zip WHERE st <> '' AND st = dt AND length(st) > 3 GROUP BY pair)
"""


@query(ISSUES + "SELECT pair, pos, step, id, severity, kind, detail FROM issues")
def q_validate(spark, sf_dir):
    return P.validate(*both_sides(spark, sf_dir), target="en")


@query(ISSUES + "SELECT pair, severity, pos, step, kind, detail, n FROM (SELECT *, CAST(row_number() OVER (PARTITION BY pair, severity ORDER BY pos, step, id, detail) AS INTEGER) AS n FROM issues) WHERE n <= CASE severity WHEN 'error' THEN 5 ELSE 3 END")
def q_validate_shown(spark, sf_dir):
    issues = P.validate(*both_sides(spark, sf_dir), target="en")
    return P.shown(issues, {"error": 5, "warning": 3}).select("pair", "severity", "pos", "step", "kind", "detail", "n")


@query(ISSUES + ", pairs AS (SELECT DISTINCT pair FROM src), totals AS (SELECT pair, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS w FROM issues GROUP BY pair) SELECT pair, CAST(coalesce(e, 0) AS BIGINT) AS n_errors, CAST(coalesce(w, 0) AS BIGINT) AS n_warnings, coalesce(e, 0) = 0 AS passed FROM pairs LEFT JOIN totals USING (pair)")
def q_validate_verdict(spark, sf_dir):
    return P.judged(*both_sides(spark, sf_dir), target="en")


@query("SELECT pair, CAST(count(*) AS BIGINT) AS n FROM zip WHERE st <> '' AND st = dt AND length(st) > 3 GROUP BY pair")
def q_untranslated(spark, sf_dir):
    issues = P.validate(*both_sides(spark, sf_dir), target="vi").where("kind = 'untranslated'")
    return issues.select("pair", F.col("detail").cast("long").alias("n"))


@query("SELECT doc_id, regexp_matches(text, '(?im)```|\\*\\*|^#{1,6}\\s|^>\\s|translated by|bản dịch bởi') AS markup FROM documents")
def q_markdown_warn(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").rlike(T.MARKUP).alias("markup"))


@query("SELECT pair, pos, 'Ctrl plus ' AS hit FROM zip WHERE regexp_matches(dt, '(^|[^a-z])Ctrl plus R$')")
def q_shortcut_warn(spark, sf_dir):
    _, dst = both_sides(spark, sf_dir)
    line = F.col("lines")[0]
    return dst.where(line.rlike(T.SPELLED_SHORTCUT)).select("pair", "pos", F.regexp_extract(line, T.SPELLED_SHORTCUT, 0).alias("hit"))


@query("SELECT pair, pos, idx, timing, line AS text FROM src")
def q_parse_blocks(spark, sf_dir):
    """Documents rendered as subtitle files and parsed again."""
    rendered = B.render(doc_blocks(spark, sf_dir), "pair")
    blocks, _ = S.parse_srt(rendered, "pair", text="srt")
    return blocks.select("pair", "pos", "idx", "timing", F.array_join("lines", "\n").alias("text"))


@query("SELECT pair, string_agg(CAST(pos AS VARCHAR) || chr(10) || timing || chr(10) || line, chr(10) || chr(10) ORDER BY pos) || chr(10) AS srt FROM src GROUP BY pair")
def q_srt_render(spark, sf_dir):
    return B.render(doc_blocks(spark, sf_dir), "pair")


@query("SELECT pair, pos, CASE WHEN k % 5 = 0 THEN 'bad_id' ELSE 'bad_timing' END AS code FROM edited WHERE k % 5 = 0 OR k % 3 = 0 AND k % 5 <> 0 UNION ALL SELECT pair, pos, 'bad_timing' FROM edited WHERE k % 15 = 0")
def q_parse_errors(spark, sf_dir):
    k = F.col("pair") + F.col("pos")
    spoilt = doc_blocks(spark, sf_dir).withColumn("idx", F.when(k % 5 == 0, F.concat(F.lit("x"), "idx")).otherwise(F.col("idx"))).withColumn("timing", F.when(k % 3 == 0, "00:00 --> 1").otherwise(F.col("timing")))
    _, errors = S.parse_srt(B.render(spoilt, "pair"), "pair", text="srt")
    return errors.select("pair", "pos", "code")


@query("SELECT pair, count(*) AS n_blocks, arg_min(idx, pos) AS first_id, arg_max(idx, pos) AS last_id, substr(arg_max(timing, pos), 18) AS ends_at, count(*) FILTER (regexp_replace(line, '\\s+', '', 'g') = '') AS n_empty FROM src GROUP BY pair")
def q_info(spark, sf_dir):
    return B.info(doc_blocks(spark, sf_dir), "pair")


@query("SELECT pair, pos, idx, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS text FROM turns WHERE pos BETWEEN 2 AND 4")
def q_text_range(spark, sf_dir):
    return B.text_rows(turn_blocks(spark, sf_dir), "pair", start=2, end=4)


@query("SELECT pair, pos, idx FROM turns WHERE idx IN ('1', '3', '4')")
def q_ids_filter(spark, sf_dir):
    return turn_blocks(spark, sf_dir).where(B.with_ids(B.parse_ids("1,3-4"))).select("pair", "pos", "idx")


@query("SELECT pair, CAST(ceil(pos / 4.0) AS INTEGER) AS part, min(pos) AS first_pos, max(pos) AS last_pos, arg_min(idx, pos) AS first_id, arg_max(idx, pos) AS last_id, count(*) AS n_blocks, printf('part_%03d.srt', CAST(ceil(pos / 4.0) AS INTEGER)) AS name FROM src GROUP BY pair, CAST(ceil(pos / 4.0) AS INTEGER)")
def q_split_parts(spark, sf_dir):
    return B.split_parts(doc_blocks(spark, sf_dir), "pair", size=4)


DIFF = "SELECT pair, pos, sid AS src_id, did AS dst_id, sline AS src_text, dline AS dst_text, CAST(row_number() OVER (PARTITION BY pair ORDER BY pos) AS INTEGER) AS n FROM zip WHERE "


@query(DIFF + "sline <> dline")
def q_diff_strict(spark, sf_dir):
    return P.diff(*both_sides(spark, sf_dir))


LOOSE = "lower(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}]+', '', 'g'))"


@query(DIFF + LOOSE.format("sline") + " <> " + LOOSE.format("dline"))
def q_diff_loose(spark, sf_dir):
    return P.diff(*both_sides(spark, sf_dir), loose=True)


@query("SELECT * FROM (" + DIFF + "sline <> dline) WHERE n <= 2")
def q_diff_limit(spark, sf_dir):
    return P.diff(*both_sides(spark, sf_dir)).where("n <= 2")


@query("SELECT pair, count(*) FILTER (sline <> dline) AS changed, count(*) AS total FROM zip GROUP BY pair")
def q_diff_counts(spark, sf_dir):
    return P.diff_counts(*both_sides(spark, sf_dir))


STRIP = "regexp_replace(regexp_replace({0}, '^\\s+', ''), '\\s+$', '')"
ANSWERS = ", qa AS (SELECT u.pair, u.pos, u.idx AS sid, a.idx AS did, " + STRIP.format("u.text") + " AS src, " + STRIP.format("a.text") + " AS dst FROM turns u JOIN turns a ON u.pair = a.pair AND a.pos = u.pos + 1 WHERE u.role = 'user' AND a.role = 'assistant')"


@query(ANSWERS + "SELECT pair, pos, sid || '≠' || did AS id, src, dst FROM qa WHERE pos <= 3")
def q_pair(spark, sf_dir):
    return P.pair_rows(P.zipped(*turn_pairs(spark, sf_dir)), end=3)


@query("SELECT pair, CAST(n_src AS BIGINT) AS n_src, CAST(n_dst AS BIGINT) AS n_dst FROM sizes WHERE n_src <> n_dst")
def q_pair_mismatch(spark, sf_dir):
    return P.aligned(*both_sides(spark, sf_dir))[1]


TERMS = [R.Rule("the, die", ("the", "die"), ("THE",)), R.Rule("que", ("que",), ("QUE", "!")), R.Rule("of/as", ("of", "as"), ("bold", "N"))]


def word(spellings, text):
    return f"regexp_matches({text}, '(?i)(^|[^A-Za-z0-9\\x{{00C0}}-\\x{{024F}}\\x{{1E00}}-\\x{{1EFF}}])({'|'.join(spellings)})($|[^A-Za-z0-9\\x{{00C0}}-\\x{{024F}}\\x{{1E00}}-\\x{{1EFF}}])')"


VIOLATIONS = ", violations AS (" + " UNION ALL ".join(f"SELECT pair, pos, sid AS id, {n} AS rule_no, '{r.cell}' AS cell FROM zip WHERE {word(r.sources, 'st')} AND NOT " + (f"({word(r.targets[:1], 'dt')} OR contains(dt, '!'))" if "!" in r.targets else word(r.targets, "dt")) for n, r in enumerate(TERMS)) + ")"


@query(VIOLATIONS + "SELECT pair, pos, id, rule_no, cell FROM violations")
def q_glossary_violations(spark, sf_dir):
    return R.glossary_violations(P.zipped(*both_sides(spark, sf_dir)), TERMS).select("pair", "pos", "id", "rule_no", "cell")


@query(VIOLATIONS + "SELECT cell, count(*) AS n FROM violations GROUP BY cell")
def q_glossary_counts(spark, sf_dir):
    return R.violation_counts(R.glossary_violations(P.zipped(*both_sides(spark, sf_dir)), TERMS)).select("cell", "n")


@query(VIOLATIONS + "SELECT pair, pos, id, rule_no, cell FROM violations")
def q_glossary_join(spark, sf_dir):
    """The same with the rules as a table."""
    return R.indexed_violations(P.zipped(*both_sides(spark, sf_dir)), R.rules_frame(spark, TERMS)).select("pair", "pos", "id", "rule_no", "cell")


def benchmark_rules(spark, sf_dir) -> DataFrame:
    """Thousands of rules: any two words of a benchmark text that follow each other; the right spelling has the next one too."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0)
    each = table(spark, sf_dir, "benchmark").select(words.alias("w")).select("w", F.explode(F.sequence(F.lit(1), F.size("w") - 2)).alias("i")).where("size(w) > 2")
    word = lambda n: F.element_at("w", F.col("i") + n)
    found = each.groupBy(F.concat_ws(" ", word(0), word(1)).alias("cell")).agg(F.min(word(2)).alias("next"))
    numbers = found.withColumn("rule_no", F.row_number().over(Window.orderBy("cell")))  # as many as a benchmark has words
    return numbers.select("rule_no", "cell", F.array("cell").alias("sources"), F.array(F.concat_ws(" ", "cell", "next")).alias("targets"))


BOUNDED = "'(?i)(^|[^A-Za-z0-9\\x{00C0}-\\x{024F}\\x{1E00}-\\x{1EFF}])' || %s || '($|[^A-Za-z0-9\\x{00C0}-\\x{024F}\\x{1E00}-\\x{1EFF}])'"

MANY_RULES = """
, w AS (SELECT regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark),
three AS (SELECT w[i] || ' ' || w[i + 1] AS cell, w[i + 2] AS next, w[i + 1] AS key FROM (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM w)),
many AS (SELECT cell, min(next) AS next, min(key) AS key, CAST(row_number() OVER (ORDER BY cell) AS INTEGER) AS rule_no FROM three GROUP BY cell),
said AS (SELECT pair, pos, unnest(list_distinct(regexp_extract_all(lower(line), '[a-z0-9]+'))) AS key FROM src),
near AS (SELECT DISTINCT pair, pos, rule_no, cell, cell || ' ' || next AS other FROM said JOIN many USING (key))
"""


@query(MANY_RULES + "SELECT near.pair, near.pos, sid AS id, rule_no, cell FROM near JOIN zip ON zip.pair = near.pair AND zip.pos = near.pos WHERE contains(lower(st), cell) AND regexp_matches(st, " + BOUNDED % "cell" + ") AND NOT regexp_matches(dt, " + BOUNDED % "other" + ")")
def q_glossary_many(spark, sf_dir):
    """Documents and their edits against every two words of the benchmark, through the index."""
    return R.indexed_violations(P.zipped(*both_sides(spark, sf_dir)), benchmark_rules(spark, sf_dir)).select("pair", "pos", "id", "rule_no", "cell")


@query(MANY_RULES + "SELECT near.pair, near.pos, idx, rule_no, cell AS hit FROM near JOIN src ON src.pair = near.pair AND src.pos = near.pos WHERE contains(lower(line), cell) AND regexp_matches(regexp_replace(line, '(?i)\\b' || other || '($|[^A-Za-z0-9\\x{00C0}-\\x{024F}\\x{1E00}-\\x{1EFF}])', '#\\1', 'g'), " + BOUNDED % "cell" + ")")
def q_asr_many(spark, sf_dir):
    return R.indexed_asr(doc_blocks(spark, sf_dir), benchmark_rules(spark, sf_dir), "pair").select("pair", "pos", "idx", "rule_no", F.lower("hit").alias("hit"))


WRONG = [R.Rule("on", ("on",), ("on the", "on of")), R.Rule("ein", ("ein",), ("ein mit",))]


@query(
    ", hits AS ("
    + " UNION ALL ".join(f"SELECT pair, pos, idx, {n} AS rule_no, " + STRIP.format("line") + " AS text FROM src WHERE " + word(r.sources, "regexp_replace(line, '(?i)(^|[^A-Za-z0-9\\x{00C0}-\\x{024F}\\x{1E00}-\\x{1EFF}])(" + "|".join(r.targets) + ")\\b', '\\1#', 'g')") for n, r in enumerate(WRONG))
    + ") SELECT rule_no, count(*) > 0 AS found FROM hits GROUP BY rule_no"
)
def q_check_asr_found(spark, sf_dir):
    return R.asr_hits(doc_blocks(spark, sf_dir), WRONG, "pair").groupBy("rule_no").agg((F.count("*") > 0).alias("found"))


@query("SELECT pair, pos, idx, 0 AS rule_no, '" + "lyon' AS hit FROM src WHERE " + word(("lyon",), "line"))
def q_check_asr(spark, sf_dir):
    return R.asr_hits(doc_blocks(spark, sf_dir), [R.Rule("lyon", ("lyon",), ("zzz",))], "pair").select("pair", "pos", "idx", "rule_no", F.lower("hit").alias("hit"))


@query("SELECT pair, pos, idx FROM src WHERE contains(lower(line), 'license')")
def q_find_literal(spark, sf_dir):
    return B.find(doc_blocks(spark, sf_dir), "License", "pair").select("pair", "pos", "idx")


@query("SELECT pair, pos, idx FROM src WHERE regexp_matches(line, '(?i)the [a-z]+ of')")
def q_find_regex(spark, sf_dir):
    return B.find(doc_blocks(spark, sf_dir), r"(?P<first>the) [a-z]+ of", "pair", regex=True).select("pair", "pos", "idx")


@query("SELECT pair, pos, idx FROM src WHERE contains(lower(line), '. t') OR contains(line, '(')")
def q_find_escaped(spark, sf_dir):
    """Characters with a meaning in patterns stand for themselves."""
    blocks = doc_blocks(spark, sf_dir)
    return B.find(blocks, ". T", "pair").unionByName(B.find(blocks, "(", "pair")).select("pair", "pos", "idx").distinct()


@query("SELECT CAST(count(*) AS BIGINT) AS n_blocks, CAST(count(DISTINCT pair) AS BIGINT) AS n_files FROM src WHERE contains(lower(line), 'license')")
def q_find_totals(spark, sf_dir):
    return B.find(doc_blocks(spark, sf_dir), "license", "pair").agg(F.count("*").alias("n_blocks"), F.count_distinct("pair").alias("n_files"))


@query("SELECT pair, pos, array_to_string([" + STRIP.format("x") + " FOR x IN list_filter([lag(text) OVER w, text, lead(text) OVER w], lambda y: y IS NOT NULL)], ' / ') AS near FROM turns WINDOW w AS (PARTITION BY pair ORDER BY pos)")
def q_neighbour_window(spark, sf_dir):
    return L.neighbourhoods(turn_blocks(spark, sf_dir))


NEAR = r", near AS (SELECT pair, pos, concat_ws(' / ', lag(line) OVER w, line, lead(line) OVER w) AS near FROM dst WINDOW w AS (PARTITION BY pair ORDER BY pos)), sums AS (SELECT pair FROM sizes WHERE n_src = n_dst), li AS (SELECT z.*, n.near FROM zip z JOIN near n USING (pair, pos) JOIN sums USING (pair))"


def linted(spark, sf_dir, **how):
    src, dst = both_sides(spark, sf_dir)
    both, _ = P.aligned(src, dst)
    return L.lint(both, dst, **how)


@query(NEAR + r", lost AS (SELECT pair, pos, sid AS id, list_filter(list_distinct(regexp_extract_all(st, '\p{Nd}+')), lambda x: NOT list_contains(regexp_extract_all(near, '\p{Nd}+'), x)) AS lost FROM li) SELECT pair, pos, id, array_to_string(list_transform(list_sort(list_transform(lost, lambda x: printf('%05d', length(x)) || x)), lambda y: substr(y, 6)), ', ') AS detail FROM lost WHERE len(lost) > 0")
def q_lint_numbers(spark, sf_dir):
    return linted(spark, sf_dir, kinds=["number"]).select("pair", "pos", "id", "detail")


@query(NEAR + r"SELECT pair, pos, sid AS id FROM li WHERE length(dt) / 1.0 > 200")
def q_lint_speed(spark, sf_dir):
    return linted(spark, sf_dir, cps=200.0, kinds=["fast_read"]).select("pair", "pos", "id")


@query(NEAR + r"SELECT 'fast_read' AS kind, count(*) AS n FROM li WHERE length(dt) > 300 UNION ALL SELECT 'number', count(*) FROM li WHERE len(list_filter(list_distinct(regexp_extract_all(st, '\p{Nd}+')), lambda x: NOT list_contains(regexp_extract_all(near, '\p{Nd}+'), x))) > 0")
def q_lint_counts(spark, sf_dir):
    return L.lint_counts(linted(spark, sf_dir, cps=300.0, kinds=["number", "fast_read"])).select("kind", "n")


def with_keys(blocks, spoken):
    """Some lines with a key combination and a mouse button in the source; the target has them or not."""
    k, line = F.col("pair") + F.col("pos"), F.col("lines")[0]
    if spoken:
        added = F.when(k % 6 == 0, F.concat(line, F.lit(" 按 Ctrl 加 Z 右键"))).otherwise(line)
    else:
        added = F.when(k % 12 == 0, F.concat(line, F.lit(" Ctrl + Z chuột phải"))).otherwise(line)
    return blocks.withColumn("lines", F.array(added))


KEYED = ", keyed AS (SELECT pair, pos, idx, (pair + pos) % 6 = 0 AS asked, (pair + pos) % 12 = 0 AS given, line FROM src), missed AS (SELECT *, contains(lower(concat_ws(' ', lag(line) OVER w, line, lead(line) OVER w)), 'right') AS said, NOT (given OR coalesce(lag(given) OVER w, false) OR coalesce(lead(given) OVER w, false)) AS missed FROM keyed WINDOW w AS (PARTITION BY pair ORDER BY pos)) "


@query(KEYED + "SELECT pair, pos, idx AS id, 'key' AS kind, 'ctrl+z' AS detail FROM missed WHERE asked AND missed UNION ALL SELECT pair, pos, idx, 'mouse', 'right' FROM missed WHERE asked AND missed AND NOT said")
def q_lint_combos(spark, sf_dir):
    plain = doc_blocks(spark, sf_dir)
    src, dst = with_keys(plain, True), with_keys(plain, False)
    return L.lint(P.zipped(src, dst), dst, kinds=["key", "mouse"]).select("pair", "pos", "id", "kind", "detail")


@query("SELECT conv_id AS pair, CAST(turn + 1 AS INTEGER) AS pos, 'Photoshop, Gaussian' AS detail FROM conversations WHERE role = 'user' AND turn % 2 = 0 AND (conv_id + turn) % 3 = 0")
def q_lint_latin(spark, sf_dir):
    rows = turn_blocks(spark, sf_dir).where("role = 'user' and pos % 2 = 1")
    src = rows.where("(pair + pos - 1) % 3 = 0").withColumn("lines", F.array(F.lit("打开 Photoshop 的 Gaussian 模糊 ok Photoshop")))
    dst = src.withColumn("lines", F.array(F.lit("mở")))
    return L.lint(P.zipped(src, dst), dst, cps=0).where("kind = 'latin_term'").select("pair", "pos", "detail")


def doc_edits(spark, sf_dir):
    """Edit lines of the documents' blocks: some missing, some kept, some for IDs that aren't there, some twice."""
    src = doc_blocks(spark, sf_dir)
    k, line = F.col("pair") + F.col("pos"), F.col("lines")[0]
    rows = src.where(k % 9 != 0).select("pair", "idx", "pos", F.when(k % 4 == 0, "=").otherwise(F.concat(F.lit("new "), F.upper("idx"), F.lit(" / two"))).alias("text"))
    more = src.where(k % 25 == 0).select("pair", (F.col("pos") + 5000).cast("string").alias("idx"), "pos", F.lit("extra").alias("text"))
    again = src.where(k % 14 == 0).select("pair", "idx", (F.col("pos") + 100000).alias("pos"), F.lit("again").alias("text"))
    edits = rows.unionByName(more).unionByName(again).withColumnRenamed("pos", "line_no")
    return src, edits.withColumn("name", B.part_name(F.ceil(F.col("line_no") % 100000 / 4).cast("int"), ".txt"))


EDITS = """
, edits AS (
  SELECT pair, idx, pos AS line_no, CASE WHEN k % 4 = 0 THEN '=' ELSE 'new ' || idx || ' / two' END AS text, pos AS p FROM edited WHERE k % 9 <> 0
  UNION ALL SELECT pair, CAST(pos + 5000 AS VARCHAR), pos, 'extra', pos FROM edited WHERE k % 25 = 0
  UNION ALL SELECT pair, idx, pos + 100000, 'again', pos FROM edited WHERE k % 14 = 0),
last AS (SELECT pair, idx, arg_max(text, line_no) AS text FROM edits GROUP BY pair, idx)
"""


@query(EDITS + "SELECT e.pair, e.pos, e.idx, e.timing, CASE WHEN l.text IS NULL OR l.text = '=' THEN e.line WHEN l.text = 'again' THEN 'again' ELSE 'new ' || e.idx || chr(10) || 'two' END AS text, coalesce(l.text = '=', false) AS kept FROM edited e LEFT JOIN last l USING (pair, idx)")
def q_merge(spark, sf_dir):
    src, edits = doc_edits(spark, sf_dir)
    return M.merged(src, S.last_edits(edits, "pair"), "pair").select("pair", "pos", "idx", "timing", F.array_join("lines", "\n").alias("text"), "kept")


@query(EDITS + "SELECT pair, count(*) FILTER (l.text = '=') AS n_kept FROM edited e LEFT JOIN last l USING (pair, idx) GROUP BY pair")
def q_merge_keep(spark, sf_dir):
    src, edits = doc_edits(spark, sf_dir)
    return M.merged(src, S.last_edits(edits, "pair"), "pair").groupBy("pair").agg(F.count_if("kept").alias("n_kept"))


@query(EDITS + "SELECT pair, pos, idx FROM edited e WHERE NOT EXISTS (SELECT 1 FROM edits x WHERE x.pair = e.pair AND x.idx = e.idx)")
def q_merge_missing(spark, sf_dir):
    return M.missing(*doc_edits(spark, sf_dir), "pair")


@query(EDITS + "SELECT DISTINCT pair, idx FROM edits x WHERE NOT EXISTS (SELECT 1 FROM edited e WHERE x.pair = e.pair AND x.idx = e.idx)")
def q_merge_extra(spark, sf_dir):
    return M.extra(*doc_edits(spark, sf_dir), "pair")


@query(EDITS + "SELECT pair, idx, count(*) - 1 AS n FROM edits GROUP BY pair, idx HAVING count(*) > 1")
def q_merge_dups(spark, sf_dir):
    """Edit lines rendered as ``ID | text`` files and parsed again."""
    _, edits = doc_edits(spark, sf_dir)
    row = F.struct("line_no", F.concat_ws(" | ", "idx", "text").alias("line"))
    texts = edits.groupBy("pair").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["line"]), "\n").alias("text"))
    _, problems = S.parse_edits(texts, "pair")
    return problems.where("code = 'repeated'").groupBy("pair", F.col("detail").alias("idx")).agg(F.count("*").alias("n"))


@query(EDITS + """
, parts AS (SELECT pair, CAST(ceil(pos / 4.0) AS INTEGER) AS part, min(pos) AS first_pos, max(pos) AS last_pos FROM src GROUP BY ALL),
have AS (SELECT DISTINCT pair, CAST(ceil(p / 4.0) AS INTEGER) AS part, idx FROM edits),
miss AS (SELECT pair, CAST(ceil(pos / 4.0) AS INTEGER) AS part, count(*) AS n, arg_min(idx, pos) AS first FROM edited e WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.pair = e.pair AND h.idx = e.idx AND h.part = CAST(ceil(e.pos / 4.0) AS INTEGER)) GROUP BY ALL),
xtra AS (SELECT pair, part, count(*) AS n FROM have h WHERE NOT EXISTS (SELECT 1 FROM edited e WHERE h.pair = e.pair AND h.idx = e.idx AND h.part = CAST(ceil(e.pos / 4.0) AS INTEGER)) GROUP BY ALL)
SELECT p.pair, p.part, printf('part_%03d.txt', p.part) AS name, first_pos, last_pos,
       CASE WHEN NOT EXISTS (SELECT 1 FROM have h WHERE h.pair = p.pair AND h.part = p.part) THEN 'todo' WHEN m.n IS NOT NULL OR x.n IS NOT NULL THEN 'error' ELSE 'done' END AS state,
       CASE WHEN NOT EXISTS (SELECT 1 FROM have h WHERE h.pair = p.pair AND h.part = p.part) THEN 0 ELSE CAST((m.n IS NOT NULL) AS BIGINT) + CAST((x.n IS NOT NULL) AS BIGINT) END AS n_problems,
       CAST(coalesce(m.n, 0) AS BIGINT) AS n_missing, m.first AS first_missing, CAST(coalesce(x.n, 0) AS BIGINT) AS n_extra
FROM parts p LEFT JOIN miss m USING (pair, part) LEFT JOIN xtra x USING (pair, part)""")
def q_parts_state(spark, sf_dir):
    src, edits = doc_edits(spark, sf_dir)
    none = spark.sql("SELECT CAST(NULL AS BIGINT) AS pair, '' AS name, '' AS code, '' AS detail WHERE false")
    return M.part_states(src, edits, none, edits.select("pair", "name"), "pair", size=4).drop("extra_ids")


@query("SELECT pair, unnest(range(1, count(*) + 1, 5)) AS first, least(unnest(range(1, count(*) + 1, 5)) + 4, count(*)) AS last FROM src GROUP BY pair")
def q_review_ranges(spark, sf_dir):
    n = doc_blocks(spark, sf_dir).groupBy("pair").agg(F.count("*").alias("n"))
    return n.select("pair", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(5).cast("long"))).alias("first")).select("pair", "first", F.least(F.col("first") + 4, F.col("n")).alias("last"))


@query("""
WITH n AS (SELECT DISTINCT source AS name, lang AS language FROM documents),
s AS (SELECT name, language, count(*) OVER (PARTITION BY name) AS k FROM n)
SELECT source AS name, 'raw' AS stage, CAST(NULL AS VARCHAR) AS language, 'present' AS state FROM (SELECT DISTINCT source FROM documents)
UNION ALL SELECT source, 'cleaned', NULL, CASE WHEN length(source) % 2 = 0 THEN 'absent' ELSE 'pass' END FROM (SELECT DISTINCT source FROM documents)
UNION ALL SELECT a.source, 'trans', b.lang, CASE WHEN n.name IS NULL THEN 'absent' WHEN length(a.source) % 2 = 0 THEN 'no_source' WHEN b.lang = 'de' THEN 'fail' ELSE 'pass' END
FROM (SELECT DISTINCT source FROM documents) a CROSS JOIN (SELECT DISTINCT lang FROM documents) b LEFT JOIN n ON n.name = a.source AND n.language = b.lang""")
def q_status_pivot(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("name"), F.col("lang").alias("language")).distinct()
    at = F.timestamp_seconds(F.lit(0)).alias("mtime")
    none = F.lit(None).cast("string").alias("language")
    raw = docs.select("name", none, F.lit("raw").alias("stage"), at).distinct()
    names = raw.unionByName(raw.where(F.length("name") % 2 == 1).withColumn("stage", F.lit("cleaned"))).unionByName(docs.select("name", "language", F.lit("trans").alias("stage"), at))
    cleaned = raw.select("name", F.lit(True).alias("passed"))
    translated = docs.select("name", "language", (F.col("language") != "de").alias("passed"))
    reviews = docs.where("false").select("name", "language", F.lit(0).alias("n_open"), at)
    return status(names, cleaned, translated, reviews).select("name", "stage", "language", "state")


BOOK = "concat('## 4. Terms', {n}, '| Gốc | English | Trạng thái |', {n}, '|---|:---:|---|', {n}, '| ', n_name, ' / x', n_nationkey, ' | ', lower(n_name), ', land | ', CASE WHEN n_nationkey % 3 = 0 THEN 'x' ELSE '?' END, ' |', {n}, {n}, '## 5. Other', {n}, '| A | B |', {n}, '| <!-- gone -->', n_regionkey, ' | b |')"


@query("WITH t AS (SELECT n_nationkey AS pair, n_name, n_regionkey, n_nationkey FROM nation) SELECT pair, 4 AS section, 'Gốc' AS col, n_name || ' / x' || n_nationkey AS cell FROM t UNION ALL SELECT pair, 4, 'English', lower(n_name) || ', land' FROM t UNION ALL SELECT pair, 4, 'Trạng thái', CASE WHEN n_nationkey % 3 = 0 THEN 'x' ELSE '?' END FROM t UNION ALL SELECT pair, 5, 'A', CAST(n_regionkey AS VARCHAR) FROM t UNION ALL SELECT pair, 5, 'B', 'b' FROM t")
def q_glossary_parse(spark, sf_dir):
    books = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pair"), F.expr(BOOK.format(n="'\\n'")).alias("text"))
    return S.parse_tables(books, "pair").select("pair", "section", F.explode("cells").alias("col", "cell"))


@query("WITH t AS (SELECT * FROM nation WHERE n_nationkey % 3 = 0) SELECT n_nationkey AS pair, n_name || ' / x' || n_nationkey AS cell, n_name || ';x' || n_nationkey AS sources, lower(n_name) || ';land' AS targets FROM t")
def q_glossary_rules(spark, sf_dir):
    books = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pair"), F.expr(BOOK.format(n="'\\n'")).alias("text"))
    tables = S.parse_tables(books, "pair")
    rules = S.rules_of(tables.withColumn("line_no", F.col("pair")), "Gốc", "English")
    return rules.select(F.col("line_no").alias("pair"), "cell", F.array_join("sources", ";").alias("sources"), F.array_join("targets", ";").alias("targets"))


@query("SELECT doc_id AS pair, source AS name, lang AS language FROM documents WHERE regexp_matches(lang, '^[a-z]{2,3}$')")
def q_name_lang(spark, sf_dir):
    stem = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(".", "source", "lang").alias("stem")).where(F.col("stem").rlike(S.NAME_AND_LANGUAGE))
    return stem.select(F.col("doc_id").alias("pair"), F.regexp_extract("stem", S.NAME_AND_LANGUAGE, 1).alias("name"), F.regexp_extract("stem", S.NAME_AND_LANGUAGE, 2).alias("language"))


@query("SELECT doc_id AS pair, 'ABC fi ' || text || ' No. 3' AS normal FROM documents")
def q_nfkc(spark, sf_dir):
    wide = F.concat(F.lit("ＡＢＣ ﬁ "), F.col("text"), F.lit(" Nｏ. ３"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pair"), T.nfkc(wide).alias("normal"))


@query("SELECT conv_id AS pair, CAST(count(*) FILTER (role = 'user') AS BIGINT) AS n_open FROM conversations GROUP BY conv_id")
def q_review_pending(spark, sf_dir):
    """Reviews with a heading for each turn, those of the user open; the texts below count for nothing."""
    state = F.when(F.col("role") == "user", F.when(F.col("turn") % 4 == 0, "Pending").otherwise("unsure ")).otherwise("fixed")
    entry = F.concat(F.lit("### "), F.col("turn").cast("string"), F.lit(" | x | "), state, F.lit("\n"), F.regexp_replace("text", "[#|]", ""), F.lit("\n"))
    rows = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("pair")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", entry.alias("entry")))), lambda x: x["entry"]), "\n").alias("review"))
    return rows.select("pair", S.count_open(F.col("review")).cast("long").alias("n_open"))


@query("SELECT pair, pos, round((pair + pos) % 7 + ((pair * 13 + pos) % 1000) / 1000.0, 3)::DOUBLE AS seconds FROM src")
def q_durations(spark, sf_dir):
    """Clocks that end some seconds and thousandths after they begin."""
    blocks = doc_blocks(spark, sf_dir)
    begin, thousandths = F.col("pos"), (F.col("pair") * 13 + F.col("pos")) % 1000
    end = F.concat(F.substring(clock(begin + (F.col("pair") + F.col("pos")) % 7), 1, 8), F.lit("."), F.lpad(thousandths.cast("string"), 3, "0"))
    return blocks.select("pair", "pos", F.round(T.duration(F.concat(clock(begin), F.lit("  -->  "), end, F.lit(" X1:5"))), 3).alias("seconds"))


@query("SELECT doc_id AS pair, CASE doc_id % 4 WHEN 0 THEN 'empty' WHEN 1 THEN 'short' WHEN 2 THEN 'not_utf8' END AS code, CASE doc_id % 4 WHEN 1 THEN '1' ELSE '' END AS detail FROM documents WHERE doc_id % 4 < 3")
def q_parse_faults(spark, sf_dir):
    """Files of white space, of a lone number, of no text, and good ones."""
    k = F.col("doc_id") % 4
    text = F.when(k == 0, F.concat(F.lit(" \n"), F.repeat(F.lit("\t\n"), (F.col("doc_id") % 9).cast("int")))).when(k == 1, F.concat(F.lit("\n"), F.col("doc_id").cast("string"), F.lit("\n\n"))).when(k == 3, "1\n00:00:01,000 --> 00:00:02,000\nx\n")
    _, errors = S.parse_srt(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pair"), text.alias("text")), "pair")
    return errors.select("pair", "code", "detail")


@query("""
SELECT pair, pos AS line_no, 'malformed' AS code, substr('x' || regexp_replace(line, '[^a-z]', '', 'g') || 'x', 1, 60) AS detail FROM edited WHERE k % 4 = 0
UNION ALL SELECT pair, pos, 'empty_text', idx FROM edited WHERE k % 4 = 1""")
def q_edit_problems(spark, sf_dir):
    """Edit files with lines that have no ID and lines without a text."""
    blocks = doc_blocks(spark, sf_dir)
    k, line = F.col("pair") + F.col("pos"), F.regexp_replace(F.col("lines")[0], "[^a-z]", "")
    row = F.when(k % 4 == 0, F.concat(F.lit("x"), line, F.lit("x"))).when(k % 4 == 1, F.concat(F.lit(" "), F.col("idx"), F.lit(" |  "))).otherwise(F.concat(F.col("idx"), F.lit(" | a | b")))
    texts = blocks.groupBy("pair").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", row.alias("row")))), lambda x: x["row"]), "\n").alias("text"))
    _, problems = S.parse_edits(texts, "pair")
    return problems.select("pair", "line_no", "code", "detail")


SECTIONS = """
WITH t AS (SELECT * FROM nation)
SELECT n_nationkey AS pair, 4 AS section, unnest(['## 4. Terms', '| Gốc | English | Trạng thái |', '| --- | --- | --- |', '| ' || n_name || ' / x' || n_nationkey || ' | ' || lower(n_name) || ', land | ' || CASE WHEN n_nationkey % 3 = 0 THEN 'x' ELSE '?' END || ' |', '']) AS line FROM t
UNION ALL SELECT n_nationkey, 5, unnest(['## 5. Other', '| A | B |', '| ' || n_regionkey || ' | b |']) FROM t"""


@query(SECTIONS)
def q_glossary_sections(spark, sf_dir):
    """Sections of glossaries, tables compact and comments gone."""
    books = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pair"), F.concat(F.lit("# Title\n<!-- | x |\n-->\n"), F.expr(BOOK.format(n="'\n'")), F.lit("\n## 6. More\ntext")).alias("text"))
    return S.glossary_lines(books, {4, 5}, "pair").select("pair", "section", "line")


PARTS = """
, lines_of AS (
  SELECT pair, idx, pos, printf('part_%03d.txt', CAST(ceil(pos / 4.0) AS INTEGER)) AS name, pos AS line_no, 'own ' || idx AS text FROM edited WHERE k % 9 <> 0
  UNION ALL SELECT pair, idx, pos, printf('part_%03d.txt', CAST(ceil(pos / 4.0) AS INTEGER) + 1), 1, 'later ' || idx FROM edited WHERE k % 10 = 0
  UNION ALL SELECT pair, CAST(pos + 5000 AS VARCHAR), pos, printf('part_%03d.txt', CAST(ceil(pos / 4.0) AS INTEGER)), 2, 'extra' FROM edited WHERE k % 3 = 0)
"""


def part_edits(spark, sf_dir):
    """Part files: some IDs missing, some again in the next part, some that no block has."""
    src = doc_blocks(spark, sf_dir)
    k, part = F.col("pair") + F.col("pos"), F.ceil(F.col("pos") / 4).cast("int")
    row = lambda idx, part, line_no, text: src.select("pair", "pos", idx.alias("idx"), B.part_name(part, ".txt").alias("name"), line_no.alias("line_no"), text.alias("text"), k.alias("k"))
    idx = F.col("idx")
    own = row(idx, part, F.col("pos"), F.concat(F.lit("own "), idx)).where("k % 9 != 0")
    later = row(idx, part + 1, F.lit(1), F.concat(F.lit("later "), idx)).where("k % 10 = 0")
    extra = row((F.col("pos") + 5000).cast("string"), part, F.lit(2), F.lit("extra")).where("k % 3 = 0")
    return src, own.unionByName(later).unionByName(extra).drop("k", "pos")


@query(PARTS + "SELECT DISTINCT pair, idx, name FROM lines_of l WHERE EXISTS (SELECT 1 FROM lines_of x WHERE x.pair = l.pair AND x.idx = l.idx AND x.name < l.name)")
def q_merge_other_parts(spark, sf_dir):
    return M.in_several_parts(part_edits(spark, sf_dir)[1], "pair")


@query(PARTS + "SELECT pair, idx, arg_max(text, name || printf('%09d', line_no)) AS text FROM lines_of GROUP BY pair, idx")
def q_merge_last_part(spark, sf_dir):
    return M.combined(part_edits(spark, sf_dir)[1], "pair")


@query(PARTS + """
, wrong AS (
  SELECT pair, 3 AS step, 'missing' AS code, pos AS place, idx FROM edited e WHERE NOT EXISTS (SELECT 1 FROM lines_of l WHERE l.pair = e.pair AND l.idx = e.idx)
  UNION ALL SELECT DISTINCT pair, 4, 'extra', CAST(idx AS INTEGER), idx FROM lines_of l WHERE NOT EXISTS (SELECT 1 FROM edited e WHERE l.pair = e.pair AND l.idx = e.idx)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY pair, step ORDER BY place) AS turn FROM wrong)
SELECT pair, step, code, count(*) AS n, string_agg(idx, ', ' ORDER BY turn) FILTER (turn <= 20) AS ids FROM ranked GROUP BY pair, step, code""")
def q_merge_report(spark, sf_dir):
    """Missing IDs by position, extra ones by number, the first 20 of each named."""
    src, edits = part_edits(spark, sf_dir)
    none = spark.sql("SELECT CAST(NULL AS BIGINT) AS pair, '' AS name, 0 AS line_no, '' AS code, '' AS detail WHERE false")
    return M.listed(M.merge_problems(src, edits, none, "pair"), "pair")


def part_rows(spark, sf_dir):
    src, edits = part_edits(spark, sf_dir)
    none = spark.sql("SELECT CAST(NULL AS BIGINT) AS pair, '' AS name, '' AS code, '' AS detail WHERE false")
    return M.part_states(src, edits, none, edits.select("pair", "name"), "pair", size=4)


STATES = PARTS + """
, parts AS (SELECT pair, CAST(ceil(pos / 4.0) AS INTEGER) AS part, printf('part_%03d.txt', CAST(ceil(pos / 4.0) AS INTEGER)) AS name FROM src GROUP BY ALL),
xtra AS (SELECT DISTINCT pair, name, idx FROM lines_of l WHERE NOT EXISTS (SELECT 1 FROM edited e WHERE e.pair = l.pair AND e.idx = l.idx AND printf('part_%03d.txt', CAST(ceil(e.pos / 4.0) AS INTEGER)) = l.name)),
named AS (SELECT pair, name, count(*) AS n_extra, string_agg(idx, ', ' ORDER BY CAST(idx AS BIGINT)) FILTER (turn <= 5) AS extra_ids FROM (SELECT *, row_number() OVER (PARTITION BY pair, name ORDER BY CAST(idx AS BIGINT)) AS turn FROM xtra) GROUP BY pair, name),
lost AS (SELECT DISTINCT pair, printf('part_%03d.txt', CAST(ceil(pos / 4.0) AS INTEGER)) AS name FROM edited e WHERE NOT EXISTS (SELECT 1 FROM lines_of l WHERE l.pair = e.pair AND l.idx = e.idx AND l.name = printf('part_%03d.txt', CAST(ceil(e.pos / 4.0) AS INTEGER)))),
states AS (
  SELECT p.pair, p.part, p.name, coalesce(n.n_extra, 0) AS n_extra, coalesce(n.extra_ids, '') AS extra_ids,
         CASE WHEN NOT EXISTS (SELECT 1 FROM lines_of l WHERE l.pair = p.pair AND l.name = p.name) THEN 'todo' WHEN n.name IS NOT NULL OR o.name IS NOT NULL THEN 'error' ELSE 'done' END AS state
  FROM parts p LEFT JOIN named n USING (pair, name) LEFT JOIN lost o USING (pair, name))
"""


@query(STATES + "SELECT pair, part, state, CAST(n_extra AS BIGINT) AS n_extra, extra_ids FROM states")
def q_parts_extra(spark, sf_dir):
    return part_rows(spark, sf_dir).select("pair", "part", "state", "n_extra", "extra_ids")


@query(STATES + "SELECT pair, count(*) FILTER (state = 'done') AS n_done, count(*) AS n_parts, arg_min(name, part) FILTER (state <> 'done') AS next_part FROM states GROUP BY pair")
def q_parts_progress(spark, sf_dir):
    return M.progress(part_rows(spark, sf_dir), "pair")


@query(NEAR + r"SELECT pair, pos, sid AS id, CAST(length(dt) AS VARCHAR) || ' 1.0' AS detail FROM li WHERE length(dt) > 200")
def q_lint_speed_detail(spark, sf_dir):
    return linted(spark, sf_dir, cps=200.0, kinds=["fast_read"]).select("pair", "pos", "id", "detail")


@query("SELECT pair, pos, CASE WHEN (pair + pos) % 2 = 0 THEN 'Gaussian' ELSE 'Gaussian, Photoshop' END AS detail FROM turns WHERE role = 'user'")
def q_lint_glossary_terms(spark, sf_dir):
    """A term of the glossary is left to the glossary, and one that the target has in any case isn't lost."""
    src = turn_blocks(spark, sf_dir).where("role = 'user'").withColumn("lines", F.array(F.lit("打开滤镜 Gaussian Photoshop Layer"), F.lit("图层 ok")))
    dst = src.withColumn("lines", F.array(F.when((F.col("pair") + F.col("pos")) % 2 == 0, "photoshop!").otherwise("mở")))
    alone = lambda df: df.withColumn("pair", F.struct("pair", "pos"))  # every turn a file of its own: no neighbours
    src, dst = alone(src), alone(dst)
    return L.lint(P.zipped(src, dst), dst, glossary_terms=["layer"], kinds=["latin_term"]).select("pair.pair", "pos", "detail")


LONGEST = [R.Rule("of", ("of", "of the", "of the same"), ("NONE",))]


@query(", hits AS (SELECT pair, pos, lower(regexp_extract(st, '(?i)(?:^|[^A-Za-z0-9\\x{00C0}-\\x{024F}\\x{1E00}-\\x{1EFF}])(of the same|of the|of)(?:$|[^A-Za-z0-9\\x{00C0}-\\x{024F}\\x{1E00}-\\x{1EFF}])', 1)) AS hit FROM zip) SELECT pair, pos, hit FROM hits WHERE hit <> ''")
def q_glossary_longest(spark, sf_dir):
    """Of overlapping spellings the longest is the hit."""
    src, _ = both_sides(spark, sf_dir)
    return R.glossary_violations(P.zipped(src, edited_blocks(src).withColumn("lines", F.array(F.lit("x")))), LONGEST).select("pair", "pos", F.lower("hit").alias("hit"))


@query(VIOLATIONS + "SELECT cell, n, CAST(row_number() OVER (ORDER BY n DESC, first) AS INTEGER) AS rank FROM (SELECT cell, count(*) AS n, min(struct_pack(a := pair, b := pos, c := rule_no)) AS first FROM violations GROUP BY cell)")
def q_glossary_ranks(spark, sf_dir):
    return R.violation_counts(R.glossary_violations(P.zipped(*both_sides(spark, sf_dir)), TERMS)).select("cell", "n", "rank")


@query("""
WITH f AS (SELECT DISTINCT source AS name, lang AS language FROM documents),
a AS (SELECT DISTINCT name FROM f), l AS (SELECT DISTINCT language FROM f UNION SELECT 'xx'),
r AS (SELECT name, language, length(name) % 3 AS open, 1500 AS at FROM f WHERE length(name) % 2 = 1)
SELECT a.name, l.language, CASE WHEN f.name IS NULL THEN 'absent' ELSE 'pass' END AS state,
       f.name IS NOT NULL AND 1000 > 500 + 100 * length(a.name) AS stale,
       CASE WHEN r.name IS NULL THEN NULL WHEN r.open > 0 THEN 'progressing' ELSE 'done' END AS review, CAST(r.open AS BIGINT) AS n_open,
       r.name IS NOT NULL AND 500 + 100 * length(a.name) > 1500 AS review_old
FROM a CROSS JOIN l LEFT JOIN f ON f.name = a.name AND f.language = l.language LEFT JOIN r ON r.name = a.name AND r.language = l.language""")
def q_status_reviews(spark, sf_dir):
    """Sources that changed later, open and outdated reviews, and a language that no file has yet."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("name"), F.col("lang").alias("language")).distinct()
    at = lambda seconds: F.timestamp_seconds(seconds).alias("mtime")
    one = docs.select("name", F.lit(None).cast("string").alias("language"), F.lit("raw").alias("stage"), at(F.lit(0))).distinct()
    files = docs.select("name", "language", F.lit("trans").alias("stage"), at(500 + 100 * F.length("name")))
    names = one.unionByName(one.withColumn("stage", F.lit("cleaned")).withColumn("mtime", at(F.lit(1000)))).unionByName(files)
    reviews = docs.where(F.length("name") % 2 == 1).select("name", "language", (F.length("name") % 3).alias("n_open"), at(F.lit(1500)))
    known = status(names, one.select("name", F.lit(True).alias("passed")), docs.withColumn("passed", F.lit(True)), reviews, ["xx"])
    return known.where("stage = 'trans'").select("name", "language", "state", "stale", "review", "n_open", "review_old")


#: Documents that go into one file of q_srt_files, and bytes of a range in which it is read.
FILE_DOCUMENTS, FILE_RANGE = 500, 1 << 18


def shared_folder(spark) -> str:
    """A new folder's name where the driver and all executors see it; in local mode without such a place, one of this machine."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{top or tempfile.gettempdir()}/tessera-{uuid.uuid4().hex}"


@query(
    r", plain AS (SELECT pair // %d AS file, pair, pos, idx, timing, translate(line, chr(13), ' ') AS line FROM src) "
    "SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY pair, pos) AS INTEGER) AS pos, idx, timing, CASE WHEN regexp_full_match(line, '[ \t]*') THEN '' ELSE line END AS text FROM plain" % FILE_DOCUMENTS
)
def q_srt_files(spark, sf_dir):
    """Documents written as files of 500 each and read again in ranges."""
    blocks = doc_blocks(spark, sf_dir).withColumn("lines", F.transform("lines", lambda x: F.translate(x, "\r", " ")))
    rows = blocks.select(F.concat(F.floor(F.col("pair") / FILE_DOCUMENTS).cast("string"), F.lit(".srt")).alias("name"), F.struct("pair", "pos").alias("pos"), "idx", "timing", "lines")
    folder = shared_folder(spark)
    W.write(rows, folder)
    atexit.register(W.remove, folder)
    found, _ = W.scan(spark, folder, FILE_RANGE)
    return found.select(F.regexp_extract("path", r"([0-9]+)\.srt$", 1).cast("long").alias("file"), "pos", "idx", "timing", F.array_join("lines", "\n").alias("text"))


@query("SELECT pair, pos, row_number() OVER (ORDER BY pair, pos) AS number FROM src")
def q_output_numbers(spark, sf_dir):
    """The line that each block has in the output of all documents."""
    return output_numbers(doc_blocks(spark, sf_dir), "number").select("pair", "pos", "number")


NAMED = """
, named AS (SELECT doc_id AS pair, unnest(range(0, 1 + doc_id % 3)) AS turn FROM documents),
hit AS (SELECT pair, count(*) AS n FROM src WHERE contains(lower(line), 'license') GROUP BY pair),
files AS (SELECT pair, count(*) AS times, CAST(count(*) * coalesce(max(n), 0) AS BIGINT) AS n_blocks FROM named LEFT JOIN hit USING (pair) GROUP BY pair)
"""


def named_files(spark, sf_dir) -> DataFrame:
    """Documents as the files of a search, some named twice or three times."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pair"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("doc_id") % 3))).select("pair")


@query(NAMED + "SELECT pair, times, n_blocks FROM files")
def q_find_files(spark, sf_dir):
    return B.hits_by_file(B.find(doc_blocks(spark, sf_dir), "license", "pair"), named_files(spark, sf_dir), "pair")


@query(NAMED + "SELECT CAST(sum(times) AS BIGINT) AS n_files, CAST(sum(n_blocks) AS BIGINT) AS n_blocks FROM files")
def q_find_scanned(spark, sf_dir):
    return B.hit_totals(B.hits_by_file(B.find(doc_blocks(spark, sf_dir), "license", "pair"), named_files(spark, sf_dir), "pair"))


@query(r"""
, clocks AS (SELECT pair, pos, pos AS a, (pair * 7 + pos * 3) % 1000 AS ma, pos + 1 + (pair + pos) % 9 AS b, (pair * 13 + pos * 50) % 1000 AS mb FROM src)
SELECT pair, pos, printf('%.1f', (b // 60 * 60 + CAST(printf('%02d.%03d', b % 60, mb) AS DOUBLE)) - (a // 60 * 60 + CAST(printf('%02d.%03d', a % 60, ma) AS DOUBLE))) AS seconds FROM clocks""")
def q_seconds_shown(spark, sf_dir):
    """Durations as a report prints them, ties among them."""
    blocks, pair, pos = doc_blocks(spark, sf_dir), F.col("pair"), F.col("pos")
    stamp = lambda seconds, thousandths: F.concat(F.substring(clock(seconds), 1, 9), F.lpad((thousandths % 1000).cast("string"), 3, "0"))
    times = F.concat(stamp(pos, pair * 7 + pos * 3), F.lit(" --> "), stamp(pos + 1 + (pair + pos) % 9, pair * 13 + pos * 50))
    return blocks.select("pair", "pos", T.one_digit(T.duration(times)).alias("seconds"))
