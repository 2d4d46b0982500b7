"""The thin queries of the corpus operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, exact_dedup, licenses, lines, packing, simhash, substrings, tokens, toxicity, urls
from .common import table

D = DataFrame
S = SparkSession


def op1_exact_dedup(spark: S, sf_dir: str) -> D:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), every_row=True)


def op2_license_scan(spark: S, sf_dir: str) -> D:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: S, sf_dir: str) -> D:
    # the operator's count of repeats isn't among the columns of the SQL
    return substrings.repeats_removed(table(spark, sf_dir, "documents"), with_text=False).drop("n_repeats")


def op4_best_fit_packing(spark: S, sf_dir: str) -> D:
    return packing.packed(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: S, sf_dir: str) -> D:
    return lines.digest(lines.line_dedup(table(spark, sf_dir, "documents"), one_line=lines.ONE_LINE))


def op6_simhash(spark: S, sf_dir: str) -> D:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: S, sf_dir: str) -> D:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_decontamination(spark: S, sf_dir: str) -> D:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_url_filter(spark: S, sf_dir: str) -> D:
    return urls.judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op10_token_counts(spark: S, sf_dir: str) -> D:
    return tokens.document_counts(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_exact_dedup, op2_license_scan, op3_substring_dedup, op4_best_fit_packing, op5_line_dedup,
        op6_simhash, op7_toxicity, op8_decontamination, op9_url_filter, op10_token_counts)}


SPACE = r"[\x20\x09-\x0D]+"

OP1 = f"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{SPACE}', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t
"""

OP3 = f"""
WITH d AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '{SPACE}') IF x <> ''] AS w FROM documents),
p AS (SELECT doc_id, i, hash(array_to_string(w[i:i + 34], ' ')) AS a, md5(array_to_string(w[i:i + 34], ' ')) AS b
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT doc_id, i FROM p JOIN (SELECT a, b FROM p GROUP BY a, b HAVING count(*) > 1) USING (a, b)),
c AS (SELECT DISTINCT doc_id, i + j AS k FROM r, range(0, 35) AS x(j)),
g AS (SELECT doc_id, list(k) AS gone FROM c GROUP BY doc_id),
s AS (SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN g ON d.doc_id = g.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string([w[i] FOR i IN range(1, len(w) + 1) IF NOT list_contains(gone, i)], ' '), '')) AS kept_sha256 FROM s
"""

OP5 = r"""
WITH RECURSIVE l AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
n AS (SELECT doc_id, pos, regexp_replace(ls[pos], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line FROM l),
s AS (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS seq FROM n WHERE line <> ''),
p AS (SELECT a.doc_id, a.seq, a.line AS x, b.line AS y FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.seq = a.seq + 1),
r AS (SELECT doc_id, seq, row_number() OVER (PARTITION BY x, y ORDER BY doc_id, seq) AS k FROM p),
o AS (SELECT doc_id, seq, length(line) AS chars, row_number() OVER (PARTITION BY line ORDER BY doc_id, seq) AS k FROM s),
m AS (SELECT doc_id, seq + j AS seq FROM r, range(0, 2) AS t(j) WHERE k > 1 UNION SELECT doc_id, seq FROM o WHERE k > 1 AND chars >= 100),
g AS (SELECT s.doc_id, list(s.pos) AS gone FROM s JOIN m ON s.doc_id = m.doc_id AND s.seq = m.seq GROUP BY s.doc_id),
e(doc_id, seq, d, key) AS (
  SELECT doc_id, seq, 1, md5(line) FROM (SELECT *, count(*) OVER (PARTITION BY line) AS c FROM s) WHERE c > 1
  UNION ALL
  SELECT doc_id, seq, d + 1, md5(key || line) FROM (
    SELECT e.doc_id, e.seq, d, key, line, count(*) OVER (PARTITION BY key, line) AS c FROM e JOIN s ON s.doc_id = e.doc_id AND s.seq = e.seq + d) WHERE c > 1),
x AS (SELECT doc_id, seq, max(d) AS lcp FROM e GROUP BY doc_id, seq),
z AS (SELECT doc_id, count(*) AS n_runs, max(lcp) AS longest_run FROM x WHERE lcp >= 2
      AND NOT EXISTS (SELECT 1 FROM x AS b WHERE b.doc_id = x.doc_id AND b.seq = x.seq - 1 AND b.lcp > x.lcp) GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
SELECT d.doc_id, CAST(CASE WHEN t = '' THEN 0 ELSE len(ls) END AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string([ls[i] FOR i IN range(1, len(ls) + 1) IF NOT list_contains(coalesce(gone, []), i)], chr(10)), '')) AS kept_sha256,
  CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(coalesce(longest_run, 0) AS BIGINT) AS longest_run
FROM d LEFT JOIN g ON d.doc_id = g.doc_id LEFT JOIN z ON d.doc_id = z.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1, "op2_license_scan": licenses.oracle(), "op3_substring_dedup": OP3, "op5_line_dedup": OP5, "op9_url_filter": urls.oracle()}
