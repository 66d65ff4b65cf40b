"""Chunking of documents, as they are and with headings and frontmatter put in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_heading
from ..operators.chunking import OVERLAP, SIZE, chunks
from ..sources.files import line_offset, strip_frontmatter
from ..sources.tables import table
from . import query

#: Every seventh line of a document becomes a heading where headings are wanted.
_HEADED = "list_transform(range(len(l)), lambda i: CASE WHEN i % 7 = 2 THEN '## ' || l[i + 1] ELSE l[i + 1] END)"


def _lines(text: str) -> str:
    return f"CASE WHEN {text} LIKE '%' || chr(10) THEN string_split({text}, chr(10))[:-2] ELSE string_split({text}, chr(10)) END"


def _packed(units: str, size: int | str = SIZE, overlap: int = OVERLAP, gap: int = 0) -> str:
    """SQL steps from units (doc_id, sec, base, l) to chunks (doc_id, sec, n, a, b, content).

    size: a number or a column of units; gap: what one more line takes besides its bytes.

    State of a unit: i and j (the chunk is [i, j)), held bytes, k (where the next one may begin), covered
    bytes; mode 0 adds a line, 1 has a chunk, 2 walks back.
    """
    return f"""{units},
s AS (SELECT doc_id, sec, base, l, list_transform(l, lambda x: strlen(x)) AS z, len(l) AS n, {size} AS room FROM units WHERE len(l) > 0),
walk AS (SELECT doc_id, sec, z, n, room, 1 AS i, 1 AS j, 0::BIGINT AS held, 1 AS k, 0::BIGINT AS covered, 0 AS mode FROM s
  UNION ALL
  SELECT doc_id, sec, z, n, room,
    CASE WHEN mode = 1 AND ({overlap} = 0 OR j > n) THEN j WHEN mode = 2 AND NOT (k > i AND covered < {overlap}) THEN CASE WHEN k = i THEN j ELSE k END ELSE i END,
    CASE WHEN mode = 0 AND j <= n AND (j = i OR held + z[j] + {gap} <= room) THEN j + 1 WHEN mode = 2 AND NOT (k > i AND covered < {overlap}) THEN CASE WHEN k = i THEN j ELSE k END ELSE j END,
    CASE WHEN mode = 0 AND j <= n AND (j = i OR held + z[j] + {gap} <= room) THEN held + z[j] + CASE WHEN held > 0 THEN 1 ELSE 0 END WHEN mode = 0 THEN held ELSE 0 END,
    CASE WHEN mode = 1 THEN j WHEN mode = 2 AND k > i AND covered < {overlap} THEN k - 1 ELSE k END,
    CASE WHEN mode = 1 THEN 0 WHEN mode = 2 AND k > i AND covered < {overlap} THEN covered + z[k - 1] + 1 ELSE covered END,
    CASE WHEN mode = 0 AND j <= n AND (j = i OR held + z[j] + {gap} <= room) THEN 0 WHEN mode = 0 THEN 1 WHEN mode = 1 AND ({overlap} = 0 OR j > n) THEN 0 WHEN mode = 1 THEN 2 WHEN k > i AND covered < {overlap} THEN 2 ELSE 0 END
  FROM walk WHERE NOT (mode = 1 AND j > n)),
cut AS (SELECT doc_id, sec, base, i, j, ltrim(array_to_string(l[i:j - 1], chr(10)), chr(10)) AS content FROM walk JOIN s USING (doc_id, sec) WHERE mode = 1)"""


_PLAIN = _packed(f"WITH RECURSIVE units AS (SELECT doc_id, 0 AS sec, 0 AS base, {_lines('text')} AS l FROM documents WHERE text <> '')")
_ROWS = "SELECT doc_id AS key, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sec, i) - 1 AS INTEGER) AS chunk_index, CAST(base + i AS INTEGER) AS start_line, CAST(base + j - 1 AS INTEGER) AS end_line, md5(content) AS content FROM cut"


def _texts(spark: SparkSession, sf_dir: str, ext: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.concat(F.lit("/data/"), "doc_id", F.lit(f".{ext}")).alias("path"), "text", "lang")


def _shown(cut: DataFrame) -> DataFrame:
    return cut.select("key", "chunk_index", "start_line", "end_line", F.md5("content").alias("content"))


@query(f"{_PLAIN} {_ROWS}")
def chunk_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(chunks(_texts(spark, sf_dir, "txt")))


@query(f"{_PLAIN} SELECT lang, count(*) AS chunks, CAST(sum(strlen(content)) AS BIGINT) AS bytes, CAST(max(j - i) AS INTEGER) AS most_lines FROM cut JOIN documents USING (doc_id) GROUP BY lang")
def chunk_stats_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(spark, sf_dir, "txt").withColumn("path", F.concat(F.lit("/data/"), "lang", F.lit(".txt")))
    cut = chunks(texts).withColumn("lang", F.regexp_extract("path", r"/(\w+)\.txt$", 1))
    lines = F.max(F.col("end_line") - F.col("start_line") + 1)
    return cut.groupBy("lang").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.octet_length("content")).alias("bytes"), lines.alias("most_lines"))


_SECTIONS = _packed(f"""
WITH RECURSIVE d AS (SELECT doc_id, {_lines("text")} AS l FROM documents WHERE text <> ''), h AS (SELECT doc_id, {_HEADED} AS l FROM d),
p AS (SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line FROM h),
g AS (SELECT doc_id, pos, line, sum(CASE WHEN regexp_matches(line, '^\\s*#{{1,6}} ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS sec FROM p),
x AS (SELECT doc_id, sec, min(pos) - 1 AS base, list(line ORDER BY pos) AS l, max(max(sec)) OVER (PARTITION BY doc_id) AS headings FROM g GROUP BY doc_id, sec),
units AS (SELECT doc_id, sec, base, CASE WHEN headings > 0 AND l[-1] = '' THEN l[:-2] ELSE l END AS l FROM x)""")


def _headed(text: str) -> F.Column:
    return F.array_join(F.transform(F.split(F.regexp_replace(text, "\n\\z", ""), "\n"), lambda x, i: F.when(i % 7 == 2, F.concat(F.lit("## "), x)).otherwise(x)), "\n")


@query(f"{_SECTIONS} {_ROWS}")
def chunk_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(chunks(_texts(spark, sf_dir, "md").withColumn("text", _headed("text"))))


@query(f"WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), p AS (SELECT doc_id, unnest({_HEADED}) AS line FROM d) SELECT doc_id, count(*) AS lines, count(CASE WHEN regexp_matches(line, '^\\s*#{{1,6}} ') THEN 1 END) AS headings FROM p GROUP BY doc_id")
def heading_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 7 == 2, F.concat(F.lit("## "), x)).otherwise(x))).alias("line"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count(F.when(is_heading(F.col("line")), 1)).alias("headings"))


@query("""
WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '---' || chr(10) || 'title: ' || source || chr(10) || '---' || chr(10) || chr(10) || text WHEN 1 THEN '---' || chr(10) || text ELSE text END AS t FROM documents),
s AS (SELECT doc_id, t, CASE WHEN starts_with(t, '---' || chr(10)) AND instr(t[4:], chr(10) || '---' || chr(10)) > 0 THEN regexp_replace(t[4 + instr(t[4:], chr(10) || '---' || chr(10)) + 4:], '^\\s+', '') ELSE t END AS stripped FROM d)
SELECT doc_id, md5(stripped) AS stripped, CAST(len(string_split(t, chr(10))) - len(string_split(stripped, chr(10))) AS INTEGER) AS line_offset FROM s""")
def frontmatter_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    block = F.concat(F.lit("---\ntitle: "), "source", F.lit("\n---\n\n"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.when(k == 0, block).when(k == 1, "---\n").otherwise(""), "text").alias("t"))
    rows = rows.withColumn("s", strip_frontmatter(F.col("t")))
    return rows.select("doc_id", F.md5("s").alias("stripped"), line_offset(F.col("t"), F.col("s")).alias("line_offset"))


def _as_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source files: each line of text is a statement of one of two functions."""
    body = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("    // "), F.regexp_replace(x, r"[{}\"]", " "), F.lit("\n"))), "\n")
    text = F.concat(F.lit("use std;\n\nfn f"), "key", F.lit("(a: u8) {\n"), body, F.lit("\n}\n\npub fn small() { 1 }\n"))
    return _texts(spark, sf_dir, "rs").withColumn("text", text)


def _code_sql(size: int, overlap: int) -> str:
    """SQL steps to `parts` (doc_id, pos, start_line, end_line, content): the chunks of _as_code's texts.

    A long function's paragraphs are its head with the first statement, each further statement, and the closing brace.
    """
    units = f"""
WITH RECURSIVE t AS (SELECT doc_id, 'fn f' || doc_id || '(a: u8) {{' AS head, list_transform(string_split(text, chr(10)), lambda x: '    // ' || regexp_replace(x, '[{{}}"]', ' ', 'g')) AS b FROM documents WHERE text IS NOT NULL),
f AS (SELECT *, len(b) AS k, head || chr(10) || array_to_string(b, chr(10) || chr(10)) || chr(10) || chr(10) || '}}' AS whole FROM t),
units AS (SELECT doc_id, 0 AS sec, 0 AS base, [head || chr(10) || b[1]] || b[2:] || ['}}'] AS l, {size} - strlen(head) - 1 AS own FROM f WHERE strlen(whole) > {size})"""
    return f"""{_packed(units, "own", overlap, 1)},
p AS (SELECT c.*, head, b, strlen(head || chr(10) || b[1]) > room AND i = 1 AND strlen(head || b[1]) > {size} AS apart FROM cut c JOIN f USING (doc_id) JOIN s USING (doc_id)),
parts AS (SELECT doc_id, i AS pos, CASE WHEN i = 1 THEN 3 ELSE 2 * i + 2 END AS start_line, CASE WHEN j = 2 THEN 4 ELSE 2 * (j - 1) + 2 END AS end_line, head || chr(10) || content AS content FROM p WHERE NOT apart
  UNION ALL SELECT doc_id, 0, 3, 3, head || chr(10) || head FROM p WHERE apart UNION ALL SELECT doc_id, 1, 4, 4, head || chr(10) || b[1] FROM p WHERE apart
  UNION ALL SELECT doc_id, 1, 3, 2 * k + 4, whole FROM f WHERE strlen(whole) <= {size}
  UNION ALL SELECT doc_id, k + 2, 2 * k + 6, 2 * k + 6, 'pub fn small() {{ 1 }}' FROM f)"""


@query(f"{_code_sql(SIZE, OVERLAP)} SELECT doc_id AS key, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS chunk_index, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, md5(content) AS content FROM parts")
def chunk_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(chunks(_as_code(spark, sf_dir)))


@query(f"{_code_sql(200, 20)} SELECT doc_id AS key, count(*) AS chunks, count(CASE WHEN starts_with(content, 'fn f' || doc_id || '(a: u8) {{') THEN 1 END) AS prefixed FROM parts GROUP BY doc_id")
def signature_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chunks of a document's code are under the signature of the function they are from."""
    cut = chunks(_as_code(spark, sf_dir), 200, 20)
    of_first = F.startswith("content", F.concat(F.lit("fn f"), F.col("key").cast("string"), F.lit("(a: u8) {")))
    return cut.groupBy("key").agg(F.count(F.lit(1)).alias("chunks"), F.count(F.when(of_first, 1)).alias("prefixed"))
