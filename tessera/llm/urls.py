"""URL filter: a path-template tree per host (DataFrame operations only).

The paths of a host form a tree of segments. Going down from the host, at each
node (1) variable segments (numbers, hexadecimal keys, long mixed names)
become the wildcard ``*``; (2) branches whose share of good labels differs from
that of all their siblings by no more than ``z`` standard errors and one label
(so that a single label never decides) are merged into ``*`` as well, while a
branch that differs stays by itself. Depth and number of siblings have no limit.
Each leaf is a template, with a purity (good + alpha * prior) / (labels + alpha);
templates under the threshold are rejected, and with them the pages, labelled or
not, that have them.
Host rules come first: the longest that fits decides.

The tree is built over distinct (host, shape) pairs with their counts, so one
host with a third of all pages is a few pre-aggregated rows at each level.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, staged

# Fixed values: (host, path prefix, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
Z = 2.0
ALPHA = 10.0
PURITY = 0.5
NUMBER = r"^[0-9]+([.][A-Za-z0-9]{1,5})?$"
KEY = r"^[0-9a-f-]{12,}$"


def _rest() -> Column:
    """What follows the first ``://`` of ``_u``."""
    return F.expr("substring(_u, locate('://', _u) + 3)")


def host_of(rest: Column) -> Column:
    """What comes before ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, url, host, path``; both empty for a null or one without ``://``."""
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_u"))
    ok = F.coalesce(F.contains("_u", F.lit("://")), F.lit(False))
    path = F.regexp_extract(_rest(), r"^[^/?#]*([^?#]*)", 1)
    return base.select("page_id", F.col("_u").alias("url"), F.when(ok, host_of(_rest())).otherwise("").alias("host"), F.when(ok, path).otherwise("").alias("path"))


def rule_of(rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as ``host/path``) and its verdict."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0], r[1]))
    fits = lambda h, p: ((F.col("host") == h) | F.endswith("host", F.lit("." + h))) & F.startswith("path", F.lit(p))
    pick = lambda value: reduce(lambda c, r: c.when(fits(r[0], r[1]), F.lit(value(r))), ordered, F)
    if not ordered:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return pick(lambda r: r[0] + r[1]), pick(lambda r: r[2])


def shape_of(path: Column) -> Column:
    """The path's segments with variable ones as ``*``; a segment that is a star
    itself is percent-encoded, so that it isn't taken for the wildcard."""
    seg = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(seg, lambda s: F.when(s.rlike(NUMBER) | s.rlike(KEY) | (F.length(s) > 40), F.lit("*")).when(s == "*", F.lit("%2A")).otherwise(s))


def templates(labelled: DataFrame) -> DataFrame:
    """``host, shape, template, n, labels, good`` for each distinct (host, shape)
    of ``labelled`` (host, path, good: 1, 0 or null). A shape alone at its node
    is settled; the rounds are as many as the segments that shapes share."""
    shapes = labelled.select("host", shape_of(F.col("path")).alias("shape"), "good").groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.count("good").alias("labels"), F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("good")
    )
    level = staged(shapes.withColumn("template", F.lit("")).withColumn("open", F.size("shape") > 0), "op9-shapes")
    d = 0
    while not level.where("open").isEmpty():
        seg = F.when(F.col("open"), F.get("shape", F.lit(d)))
        here = level.withColumn("seg", seg)
        child = here.where("seg IS NOT NULL").groupBy("host", "template", "seg").agg(F.sum("labels").alias("cl"), F.sum("good").alias("cg"), F.count("*").alias("cs"))
        node = child.groupBy(F.col("host").alias("h"), F.col("template").alias("t")).agg(
            F.count("*").alias("kids"), F.sum("cl").alias("nl"), F.sum("cg").alias("ng"), F.sum("cs").alias("shapes"))
        p = (F.col("ng") + 1.0) / (F.col("nl") + 2.0)
        some = F.greatest(F.col("cl"), F.lit(1))
        similar = (F.col("cl") == 0) | (F.abs(F.col("cg") / some - p) - 1.0 / some <= Z * F.sqrt(p * (1 - p) / some))
        merged = F.when((F.col("kids") > 1) & similar, F.lit("*")).otherwise(F.col("seg"))
        step = child.join(node, (child["host"] == node["h"]) & (child["template"] == node["t"])).select(
            F.col("host").alias("h"), F.col("template").alias("t"), F.col("seg").alias("s"), F.concat("template", F.lit("/"), merged).alias("grown"), (F.col("shapes") == 1).alias("alone"))
        rest = F.concat("template", F.lit("/"), F.array_join(F.slice("shape", d + 1, F.greatest(F.size("shape"), F.lit(1))), "/"))
        after = staged(
            here.join(step, (here["host"] == step["h"]) & (here["template"] == step["t"]) & (here["seg"] == step["s"]), "left").select(
                "host", "shape", "n", "labels", "good", F.when(F.col("alone"), rest).otherwise(F.coalesce("grown", "template")).alias("template"),
                (F.col("open") & ~F.coalesce("alone", F.lit(False)) & (F.size("shape") > d + 1)).alias("open")), "op9-level")
        dropped(level)
        level, d = after, d + 1
    return level.drop("open")


def judged(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity``, a row for each
    page, repeated rows included.

    ``labels`` has ``doc_id, quality``; a page is labelled by the document whose
    number its path ends with (several labels of one: the least). Null qualities
    and ids count as no label. A null url, or one without ``://``, has an empty
    host and path and the template ``""`` of that host. Without any label the
    purity is 1 and the method allows.
    """
    urls = parsed(pages, id_col, url_col)
    doc = F.regexp_extract("path", r"/([0-9]{1,18})([.][A-Za-z0-9]{1,5})?/?$", 1)
    urls = urls.withColumn("_doc", F.when(doc != "", doc.cast("long")))
    known = labels.select(F.col("doc_id").alias("_l"), F.col("quality").alias("_q")).where("_l IS NOT NULL AND _q IS NOT NULL").groupBy("_l").agg(F.min("_q").cast("int").alias("good"))
    tree = templates(urls.join(known, urls["_doc"] == known["_l"], "left").select("host", "path", "good"))
    prior = tree.agg(F.sum("good"), F.sum("labels")).first()
    prior = (prior[0] / prior[1]) if prior and prior[1] else 1.0
    purity = tree.groupBy(F.col("host").alias("ph"), F.col("template").alias("pt")).agg(
        ((F.sum("good") + ALPHA * prior) / (F.sum("labels") + ALPHA)).alias("purity"))
    shapes = tree.join(purity, (tree["host"] == purity["ph"]) & (tree["template"] == purity["pt"])).select(
        F.col("host").alias("th"), F.col("shape").alias("ts"), "template", "purity")
    shapes = staged(shapes, "op9-purity")
    rule, verdict = rule_of(rules)
    urls = urls.withColumn("shape", shape_of(F.col("path")))
    return urls.join(shapes, (urls["host"] == shapes["th"]) & (urls["shape"] == shapes["ts"]), "left").select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("purity") < PURITY, "block").otherwise("allow")).alias("verdict"), "template", F.round("purity", 6).alias("purity"))


def oracle() -> str:
    """The same tree in DuckDB's SQL, a level of all hosts in each recursion."""
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rest = "substr(url, strpos(url, '://') + 3)"
    ok = "coalesce(contains(url, '://'), false)"
    ordered = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r[0], r[1]))
    case = lambda k: "CASE " + " ".join(f"WHEN (y.host = '{h}' OR ends_with(y.host, '.{h}')) AND starts_with(y.path, '{p}') THEN '{(h + p, v)[k]}'" for h, p, v in ordered) + " END"
    var = f"regexp_matches(s, '{NUMBER}') OR regexp_matches(s, '{KEY}') OR length(s) > 40"
    return f"""
WITH RECURSIVE u AS (SELECT page_id, CASE WHEN {ok} THEN {low.format(f"regexp_extract({rest}, '^([^/?#]*)', 1)")} ELSE '' END AS host,
    CASE WHEN {ok} THEN regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
k AS (SELECT doc_id, min(quality) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
y AS (SELECT u.*, [CASE WHEN {var} THEN '*' WHEN s = '*' THEN '%2A' ELSE s END FOR s IN string_split(path, '/') IF s <> ''] AS shape,
    try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})([.][A-Za-z0-9]{{1,5}})?/?$', 1), '') AS BIGINT) AS doc FROM u),
shapes AS (SELECT host, shape, count(good)::DOUBLE AS labels, coalesce(sum(good), 0)::DOUBLE AS good FROM y LEFT JOIN k ON y.doc = k.doc_id GROUP BY host, shape),
tree(d, host, shape, labels, good, template) AS (
  SELECT 0, host, shape, labels, good, '' FROM shapes
  UNION ALL
  SELECT d + 1, host, shape, labels, good, template || '/' || CASE WHEN kids > 1
      AND (cl = 0 OR abs(cg / greatest(cl, 1) - p) - 1.0::DOUBLE / greatest(cl, 1) <= {Z}::DOUBLE * sqrt(p * (1 - p) / greatest(cl, 1))) THEN '*' ELSE seg END
  FROM (SELECT *, max(place) OVER (PARTITION BY host, template) AS kids, sum(labels) OVER (PARTITION BY host, template, seg) AS cl, sum(good) OVER (PARTITION BY host, template, seg) AS cg,
      (sum(good) OVER (PARTITION BY host, template) + 1.0::DOUBLE) / (sum(labels) OVER (PARTITION BY host, template) + 2.0::DOUBLE) AS p
    FROM (SELECT *, shape[d + 1] AS seg, dense_rank() OVER (PARTITION BY host, template ORDER BY shape[d + 1]) AS place FROM tree WHERE len(shape) > d))),
done AS (SELECT host, shape, labels, good, template FROM tree WHERE d = len(shape)),
prior AS (SELECT CASE WHEN sum(labels) > 0 THEN sum(good) / sum(labels) ELSE 1.0 END AS v FROM done),
pur AS (SELECT host, template, (sum(good) + {ALPHA}::DOUBLE * any_value(v)) / (sum(labels) + {ALPHA}::DOUBLE) AS purity FROM done, prior GROUP BY 1, 2)
SELECT y.page_id, y.host, y.path, {case(0)} AS rule,
  coalesce({case(1)}, CASE WHEN purity < {PURITY} THEN 'block' ELSE 'allow' END) AS verdict,
  t.template, round(purity, 6) AS purity
FROM y JOIN done t ON y.host = t.host AND y.shape = t.shape JOIN pur ON t.host = pur.host AND t.template = pur.template
"""
