"""DDL and DML on snapshots: a statement reads the present snapshot of its
table, checks constraints, and registers the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import nodes as n
from ..errors import ColumnCountMismatch, ConstraintFault, DatatypeMismatch, NoSuchColumn, SyntaxFault
from ..functions.core import as_class, truthy, value
from ..plans.planner import Planner, Rel, Scope, Visible
from ..storage import snapshot
from ..types import SPARK, Col, E, TableMeta, joined

ROWID = "_rowid_"
TYPES = {"int": T.LongType(), "real": T.DoubleType(), "text": T.StringType(), "blob": T.BinaryType(), "null": T.NullType()}


def declared(kind: str) -> str:
    k = kind.upper()
    return "int" if "INT" in k else "text" if any(x in k for x in ("CHAR", "CLOB", "TEXT")) else "blob" if "BLOB" in k else "real" if any(x in k for x in ("REAL", "FLOA", "DOUB")) else "null"


def create(session, s: n.CreateTable) -> DataFrame:
    names = [c.name for c in s.columns]
    session.opened(s.name)
    if s.name in session.tables:
        raise SyntaxFault(f"table {s.name} exists")
    if len(set(names)) < len(names) or sum(c.ipk for c in s.columns) > 1:
        raise SyntaxFault("a column or the primary key is given twice")
    fields = [T.StructField(c.name, T.StringType() if declared(c.type) == "null" else TYPES[declared(c.type)]) for c in s.columns]
    df = session.spark.createDataFrame([], T.StructType([*fields, T.StructField(ROWID, T.LongType())]))
    t = session.register(s.name, df, collations={c.name: c.collation for c in s.columns}, ipk=next((c.name for c in s.columns if c.ipk), None), defs=s.columns, sql=s.sql)
    for c, d in zip(t.columns, s.columns, strict=True):
        # an undeclared column takes the class of what is inserted first
        c.cls = declared(d.type)
    return session.nothing()


def _frame(session, t: TableMeta) -> DataFrame:
    df = session.spark.table(t.view)
    if ROWID not in df.columns:
        raise SyntaxFault(f"{t.name} was registered, not created: copy it with INSERT ... SELECT first")
    return df


#: Appended parts that a table may have before it is written as one.
PARTS = 8


def _store(session, t: TableMeta, df: DataFrame, classes: list[str], appended: bool = False) -> TableMeta:
    """The next state of a table. What is appended is read beside what was there;
    the parts are written as one now and then, so that plans stay small."""
    casts = [F.col(c.name).cast("string" if k == "null" else SPARK[k]).alias(c.name) for c, k in zip(t.columns, classes, strict=True)]
    df = df.select(*casts, F.col(ROWID).cast("long").alias(ROWID))
    appended = appended and t.parts < PARTS
    df = df if appended else snapshot(df, t.name)
    new = session.register(t.name, df, collations={c.name: c.coll for c in t.columns}, ipk=t.ipk, defs=t.defs, sql=t.sql)
    new.parts = t.parts + 1 if appended else 1
    for c, k in zip(new.columns, classes, strict=True):
        c.cls = k
    return new


def _scope(t: TableMeta, alias: str, ctes: dict) -> Scope:
    return Scope([Visible(t.name, alias, [(c.name.lower(), c.name, c.cls, c.coll) for c in t.columns], [f"{alias}.`{ROWID}`"])], None, ctes)


def _ctes(session, ctes: list) -> tuple[Planner, dict]:
    p, scope = Planner(session), Scope()
    for name, cols, body in ctes:
        scope.ctes[name] = p.cte(name, cols, body, scope)
    return p, scope.ctes


def _violations(session, p: Planner, t: TableMeta, df: DataFrame) -> str:
    """SQL that is true for a row that breaks NOT NULL or CHECK."""
    scope = _scope(t, "v", {})
    parts = [f"v.`{d.name}` IS NULL" for d in t.defs if d.not_null]
    for d in t.defs:
        if d.check is not None:
            ok = truthy(p.expr(d.check, scope))
            parts.append(f"NOT coalesce({ok}, true)")
    return " OR ".join(parts)


def _checked(session, p: Planner, t: TableMeta, df: DataFrame, action: str) -> DataFrame:
    bad = _violations(session, p, t, df)
    if not bad:
        return df
    df.createOrReplaceTempView("d_checked")
    if action == "ignore":
        return session.spark.sql(f"SELECT * FROM d_checked AS v WHERE NOT ({bad})")
    if not session.spark.sql(f"SELECT 1 FROM d_checked AS v WHERE {bad} LIMIT 1").isEmpty():
        raise ConstraintFault(f"a row of {t.name} breaks a constraint")
    return df


def _numbered(df: DataFrame, first: int, name: str) -> DataFrame:
    """Consecutive numbers from ``first`` on in the order of the rows: each
    partition counts its own, after what the partitions before it hold."""
    df = snapshot(df.withColumn("_m", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_m", 33)
    counts = df.groupBy(part.alias("p")).count().orderBy("p").collect()  # one row a partition
    offsets, at = [], first
    for r in counts:
        offsets += [F.lit(r["p"]), F.lit(at)]
        at += r["count"]
    if not offsets:
        return df.withColumn(name, F.lit(None).cast("long")).drop("_m")
    return df.withColumn(name, F.element_at(F.create_map(*offsets), part) + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m")


def _returning(session, t: TableMeta, affected: DataFrame, items) -> DataFrame:
    if items is None:
        return session.nothing()
    view = snapshot(affected, "returning")
    shadow = session.tables[t.name]
    name = f"d_returning_{id(view)}"
    view.createOrReplaceTempView(name)
    session.tables[t.name] = TableMeta(t.name, name, shadow.columns, [ROWID])
    try:
        q = n.Query([], [n.Select(items, sources=[n.Source("table", t.name, None)])], [])
        rel = Planner(session).query(q, ordered=True)
        if rel.rowid:  # in the order of the rows' ids
            heads = ", ".join(f"c{i}" for i in range(len(rel.cols)))
            rel = Rel(f"SELECT {heads} FROM ({rel.sql}) ORDER BY {', '.join(rel.rowid)}", rel.cols)
        return session.frame(rel)
    finally:
        session.tables[t.name] = shadow


def _count(session, k: int) -> None:
    session.counters["changes"] = k
    session.counters["total_changes"] += k


def insert(session, s: n.Insert) -> DataFrame:
    t = session.table(s.table)
    old = _frame(session, t)
    p, ctes = _ctes(session, s.ctes)
    names = [c.name for c in t.columns]
    targets = s.columns or names
    if any(c not in names for c in targets):
        raise NoSuchColumn(str(targets))
    if s.query is None:
        rel, targets = Rel("SELECT NULL AS c0", [Col("c0", "null")]), [names[0]]
    else:
        rel = p.query(s.query, Scope([], None, ctes))
    if len(rel.cols) != len(targets):
        raise ColumnCountMismatch(f"{t.name} takes {len(targets)} values")
    source = {}
    for i, c in enumerate(targets):
        source.setdefault(c, i)  # the first of a repeated column counts
    classes, cells = [], []
    for c in t.columns:
        i = source.get(c.name)
        e = E(f"c{i}", rel.cols[i].cls) if i is not None else E("NULL", "null")
        k = joined([c.cls, e.cls])
        if c.name == t.ipk and value(e).cls not in ("int", "null"):
            raise DatatypeMismatch("a primary key is an INTEGER")
        classes.append(k)
        cells.append(f"{as_class(e, k) if e.cls != 'null' else f'CAST(NULL AS {SPARK[k]})'} AS `{c.name}`")
    rows = session.spark.sql(f"SELECT {', '.join(cells)} FROM ({rel.sql})")
    for c, k in zip(t.columns, classes, strict=True):
        if c.cls != k and c.cls not in ("null", k):
            old = old.withColumn(c.name, F.expr(as_class(E(f"`{c.name}`", c.cls), k)))
    top = old.agg(F.max(ROWID)).first()[0] or 0
    rows = _numbered(rows, 0, "_n")
    if t.ipk:
        given = rows.agg(F.max(t.ipk)).first()[0]
        free = max(top, given or 0)
        rows = rows.withColumn(t.ipk, F.coalesce(t.ipk, F.lit(free + 1) + F.col("_n"))).withColumn(ROWID, F.col(t.ipk))
    else:
        rows = rows.withColumn(ROWID, F.lit(top + 1) + F.col("_n"))
    rows = _checked(session, p, t, rows, s.action)
    kept = old
    if t.ipk:
        order = F.col("_n").desc() if s.action == "replace" else F.col("_n").asc()
        ranked = rows.withColumn("_k", F.row_number().over(Window.partitionBy(ROWID).orderBy(order)))
        ids = rows.select(F.col(ROWID).alias("_id"))
        if s.action == "replace":
            rows = ranked.where("_k = 1").drop("_k")
            kept = old.join(ids, old[ROWID] == ids["_id"], "left_anti")
        elif s.action == "ignore":
            rows = ranked.where("_k = 1").drop("_k")
            rows = rows.join(old.select(F.col(ROWID).alias("_id")), F.col(ROWID) == F.col("_id"), "left_anti")
        elif not ranked.where("_k > 1").isEmpty() or not ids.join(old, ids["_id"] == old[ROWID], "left_semi").isEmpty():
            raise ConstraintFault(f"{t.name}.{t.ipk} has to be unique")
    if s.action != "abort":  # else the rows are those that were numbered, and written with it
        rows = snapshot(rows, "inserted")
    n_rows, last = rows.agg(F.count("*"), F.max_by(ROWID, "_n")).first()
    _store(session, t, kept.select(*names, ROWID).unionByName(rows.select(*names, ROWID)), classes, s.action != "replace")
    _count(session, n_rows)
    if n_rows:
        session.counters["last_insert_rowid"] = last
    return _returning(session, t, rows.select(*names, ROWID), s.returning)


def update(session, s: n.Update) -> DataFrame:
    t = session.table(s.table)
    _frame(session, t)
    p, ctes = _ctes(session, s.ctes)
    scope = _scope(t, "u", ctes)
    names = [c.name for c in t.columns]
    new = {}
    for c, e in s.sets:
        if c not in names:
            raise NoSuchColumn(c)
        new[c] = value(p.expr(e, scope))
    hit = f"coalesce({truthy(p.expr(s.where, scope, None, True))}, false)" if s.where is not None else "true"
    classes, cells = [], []
    for c in t.columns:
        k = joined([c.cls, new[c.name].cls]) if c.name in new else c.cls
        own = E(f"u.`{c.name}`", c.cls)
        classes.append(k)
        fresh = as_class(new[c.name], k) if c.name in new and new[c.name].cls != "null" else f"CAST(NULL AS {SPARK[k]})"
        cells.append(f"{f'CASE WHEN {hit} THEN {fresh} ELSE {as_class(own, k)} END' if c.name in new else own.sql} AS `{c.name}`")
    before = ", ".join(f"u.`{x}` AS `_o_{x}`" for x in names)
    row = f"CASE WHEN {hit} THEN {as_class(new[t.ipk], 'int')} ELSE u.{ROWID} END" if t.ipk in new else f"u.{ROWID}"
    rows = snapshot(session.spark.sql(f"SELECT {', '.join(cells)}, {before}, {row} AS {ROWID}, u.{ROWID} AS _o_row, {hit} AS _hit FROM {t.view} AS u"), "updated")
    changed, rest = rows.where("_hit"), rows.where("NOT _hit")
    good = _checked(session, p, t, changed, s.action)
    if s.action == "ignore":
        left = changed.join(good.select(F.col("_o_row").alias("_g")), F.col("_o_row") == F.col("_g"), "left_anti")
        rest = rest.unionByName(left.select(*[F.col(f"_o_{x}").alias(x) for x in names], *[f"_o_{x}" for x in names], F.col("_o_row").alias(ROWID), "_o_row", "_hit"))
    if t.ipk in new:
        ids = good.select(F.col(ROWID).alias("_id"))
        if s.action == "replace":
            rest = rest.join(ids, rest[ROWID] == ids["_id"], "left_anti")
        elif not good.unionByName(rest).groupBy(ROWID).count().where("count > 1").isEmpty():
            raise ConstraintFault(f"{t.name}.{t.ipk} has to be unique")
    good = snapshot(good, "updated")
    _store(session, t, rest.select(*names, ROWID).unionByName(good.select(*names, ROWID)), classes)
    _count(session, good.count())
    return _returning(session, t, good.select(*names, ROWID), s.returning)


def delete(session, s: n.Delete) -> DataFrame:
    t = session.table(s.table)
    _frame(session, t)
    p, ctes = _ctes(session, s.ctes)
    scope = _scope(t, "u", ctes)
    hit = f"coalesce({truthy(p.expr(s.where, scope, None, True))}, false)" if s.where is not None else "true"
    rows = snapshot(session.spark.sql(f"SELECT u.*, {hit} AS _hit FROM {t.view} AS u"), "deleted")
    gone = rows.where("_hit").drop("_hit")
    _store(session, t, rows.where("NOT _hit").drop("_hit"), [c.cls for c in t.columns])
    _count(session, gone.count())
    return _returning(session, t, gone, s.returning)
