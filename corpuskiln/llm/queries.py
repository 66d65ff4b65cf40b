"""The queries of this package and, where SQL can express them, the SQL they are held against."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, katz, licences, packing, pieces, repair, topk
from . import quality as quality_model
from . import toxicity as toxicity_model
from .common import table
from .decontaminate import contamination
from .near_dedup import near_duplicates
from .near_vectors import near_vectors
from .spelling import ONE_IN, spelling_variants, word_counts


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat.digests(chat.format_chat(rows))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licences(table(spark, sf_dir, "documents"), licences.known_licences(spark))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 20)


def _scored(model, scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", model.held_out_rows().alias("held_out"), "score", "predicted")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _scored(quality_model, quality_model.quality(documents, table(spark, sf_dir, "labels")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _scored(toxicity_model, toxicity_model.toxicity(documents, table(spark, sf_dir, "labels")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    return packing.with_digest(pieces)


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op9_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return katz.katz_scores(table(spark, sf_dir, "documents"), held_out)


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = "piece_bpe_32k.model"
    return pieces.checked(pieces.encode(table(spark, sf_dir, "documents"), model, then=pieces.check(model)))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    rows = given.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("damage")).where("damage <> 0")
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("damage") == 4, "user").otherwise(F.col("role"))
    damaged = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), F.when(F.col("damage") == 3, 2).otherwise(1))))
    found = repair.audits(repair.repaired(damaged)).withColumnRenamed("conv_id", "_conv")
    out = given.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select("conv_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(table(spark, sf_dir, "documents"), one_in=ONE_IN))


def op13_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def _crc32(text: str) -> str:
    """SQL of the crc32 of a text of characters below U+0100, by a table of its 256 remainders."""
    remainders = [i for i in range(256)]
    for _ in range(8):
        remainders = [c >> 1 ^ 0xEDB88320 * (c & 1) for c in remainders]
    table_of = f"[{', '.join(map(str, remainders))}]::BIGINT[]"
    octets = f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(192 + (unicode(c) >> 6) AS BIGINT), CAST(128 + (unicode(c) & 63) AS BIGINT)] END))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda a, b: xor(a >> 8, ({table_of})[(xor(a, b) & 255) + 1])), CAST(4294967295 AS BIGINT))"


def _cheapest(steps: str) -> str:
    """SQL of a conversation's least (cost in nine digits and audit): steps are [initial, fault, '', ''], + where turns may be inserted; four of them, one a state, go from step to step."""
    add = lambda k, cost, letter: f"lpad(CAST(CAST(left(a[{k}], 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || substr(a[{k}], 10) || '{letter}'"
    least = lambda *ways: f"least({', '.join(ways)})"
    stays, more = "b[2] NOT IN ('blank', 'duplicate')", "CASE b[2] WHEN 'truncated' THEN 5 ELSE 0 END"
    keep = lambda k, c: f"CASE WHEN {stays} AND b[1] = '{c}' THEN {add(k, more, 'K')} END"
    other = lambda k: f"CASE WHEN {stays} THEN {add(k, f'1 + {more}', 'R')} END"
    insert = f"[a[1], a[2], {least('a[3]', *(add(k, 5, 'I') for k in (1, 2, 4)))}, {least('a[4]', add(3, 5, 'I'))}]"
    turn = f"[{add(1, 2, 'D')}, {least(add(2, 2, 'D'), keep(1, 's'))}, {least(add(3, 2, 'D'), *(way for k in (1, 2, 4) for way in (keep(k, 'u'), other(k))))}, {least(add(4, 2, 'D'), keep(3, 'a'), other(3))}]"
    end = f"list_reduce(list_prepend(['000000000', NULL, NULL, NULL], {steps}), lambda a, b: CASE WHEN b[2] = '+' THEN {insert} ELSE {turn} END)"
    return f"list_min(list_transform([{end}], lambda a: least(a[1], a[4])))"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    escaped = "regexp_replace({}, '" + chat.CONTROL + r"', '\1\\\2\3', 'g')"
    lower = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    plain = f"list_filter(regexp_split_to_array({lower}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    fixed = len(chat.START + chat.MIDDLE + chat.END)
    return {
        "op1_chat_format": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES
  (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum({fixed} + length({escaped.format("role")}) + length({escaped.format("text")})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id""",
        "op2_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM g),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, any_value(a.n + b.n) AS total FROM e a JOIN e b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * shared >= 85 * (total - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM g JOIN c USING (doc_id)""",
        "op3_licences": licences.oracle(),
        "op4_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS vector FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.vector, c.vector) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20""",
        "op8_near_vectors": """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, label, x, sqrt(list_inner_product(x, x)) AS norm FROM v),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE a.norm > 0 AND b.norm > 0 AND list_inner_product(a.x, b.x) / (a.norm * b.norm) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)""",
        "op11_repair": f"""
WITH k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (SELECT *, {_crc32("k")} % 20 AS h FROM k),
x AS (SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE h WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE h <> 0),
r AS (SELECT *, row_number() OVER c AS i, left(role, 1) AS c, coalesce(lag(left(role, 1)) OVER c || left(role, 1), 'ua') AS pair, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM x WINDOW c AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
f AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM r),
a AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
  {_cheapest("list_concat(flatten(list([['', '+', '', ''], [c, fault, '', '']] ORDER BY i)), [['', '+', '', ''], ['', '+', '', '']])")} AS best FROM f GROUP BY conv_id),
e AS (SELECT conv_id, j, substr(best, j + 9, 1) AS l, j - length(replace(substr(best, 10, j), 'I', '')) AS skipped FROM (SELECT conv_id, best, unnest(range(1, length(best) - 8)) AS j FROM a)),
p AS (SELECT e.conv_id, j, l, f.role, f.c, CASE l WHEN 'I' THEN '' ELSE f.text END AS text, row_number() OVER (PARTITION BY e.conv_id ORDER BY j) - max(CASE WHEN l = 'K' AND c = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS m
  FROM e LEFT JOIN f ON e.conv_id IS NOT DISTINCT FROM f.conv_id AND l <> 'I' AND f.i = j - skipped WHERE l <> 'D'),
t AS (SELECT conv_id, string_agg(CASE WHEN l = 'K' THEN role WHEN m % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j) AS t FROM p GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(left(best, 9), '0') AS BIGINT) AS cost, coalesce(substr(best, 10), '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN a ON o.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN t ON o.conv_id IS NOT DISTINCT FROM t.conv_id""",
        "op12_spellings": f"""
WITH RECURSIVE r AS (SELECT row_number() OVER () AS k, coalesce(CAST(doc_id AS VARCHAR), '') AS d, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS w FROM documents),
c AS (SELECT d, w, count(*) AS n, {_crc32("d || ':' || w")} AS h FROM r WHERE length(w) >= 6 GROUP BY d, w),
x AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM c),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM x WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
g AS (SELECT word, unnest(list_distinct(list_append(list_transform(range(1, length(word) + 1), lambda i: left(word, i - 1) || substr(word, i + 1)), word))) AS part FROM v),
p AS (SELECT DISTINCT a.word, b.word AS near FROM g a JOIN g b USING (part) WHERE a.word <> b.word),
e AS (SELECT p.word, near, n FROM p JOIN v ON near = v.word WHERE length(p.word) <> length(near) OR len(list_filter(range(1, length(near) + 1), lambda i: substr(p.word, i, 1) <> substr(near, i, 1))) = 1),
b AS (SELECT word, count(*) AS n_near, arg_min(near, (-n, near)) AS near, max(n) AS near_n FROM e GROUP BY word),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM v LEFT JOIN b USING (word)),
t AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT t.word, f.word, f.form FROM t JOIN f ON t.next = f.word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN t USING (word) WHERE next IS NULL""",
        "op13_contamination": f"""
WITH b AS (SELECT item_id, {plain} AS w FROM benchmark),
d AS (SELECT row_number() OVER () AS k, doc_id, {plain} AS w FROM documents),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT k, i, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw))),
o AS (SELECT DISTINCT k, i, n, item_id FROM dw JOIN iw USING (n, s)),
h AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM o) GROUP BY k),
l AS (SELECT k, count(x) AS n_items, string_agg(x, ',' ORDER BY x) AS x FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS x FROM o) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(x, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (k) LEFT JOIN l USING (k)""",
    }
