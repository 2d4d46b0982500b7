"""The scalar functions: name -> (least arguments, most, builder)."""

from __future__ import annotations

from collections.abc import Callable

from ..errors import DatatypeMismatch, InvalidEscape, SyntaxFault, UnknownFunction, Unsupported, WrongArgumentCount
from ..types import E, joined
from . import core, dates
from .core import as_class, integer, lit, quoted, real, strict, text, truthy, value
from .python_parts import shown_as_text

REGISTRY: dict[str, tuple[int, int | None, Callable[[list[E]], E]]] = {}


def fn(names: str, least: int, most: int | None = -1):
    """Register a builder under each of ``names``; most None: no limit."""

    def keep(f):
        for n in names.split():
            REGISTRY[n] = (least, least if most == -1 else most, f)
        return f

    return keep


def call(name: str, args: list[E]) -> E:
    if name not in REGISTRY:
        raise UnknownFunction(name)
    least, most, f = REGISTRY[name]
    if len(args) < least or (most is not None and len(args) > most):
        raise WrongArgumentCount(f"{name}() with {len(args)} arguments")
    return f([value(a) for a in args])


def opt(e: E, sql: str, cls: str) -> E:
    return E(sql, cls) if e.cls != "null" else E(f"CAST(NULL AS {core.SPARK[cls]})", "null")


# --- text and blobs
fn("lower", 1)(lambda a: E(f"d_nocase({text(a[0])})", "text"))
fn("upper", 1)(lambda a: E(f"d_upper({text(a[0])})", "text"))


@fn("length", 1)
def _length(a):
    if a[0].cls == "blob":
        return E(f"CAST(octet_length({a[0].sql}) AS BIGINT)", "int")
    return E(f"CAST(char_length(split_part({text(a[0])}, '\\u0000', 1)) AS BIGINT)", "int")


fn("octet_length", 1)(lambda a: E(f"CAST(octet_length({a[0].sql if a[0].cls == 'blob' else text(a[0])}) AS BIGINT)", "int"))


@fn("substr substring", 2, 3)
def _substr(a):
    n = integer(a[2]) if len(a) > 2 else "4294967296L"
    if a[0].cls == "blob":
        s = f"decode({a[0].sql}, 'ISO-8859-1')"
        return E(f"encode(d_substr({s}, {integer(a[1])}, {n}), 'ISO-8859-1')", "blob")
    return E(f"d_substr({text(a[0])}, {integer(a[1])}, {n})", "text")


fn("replace", 3)(lambda a: E(f"if({text(a[1])} = '', {text(a[0])}, replace({text(a[0])}, {text(a[1])}, {text(a[2])}))", "text"))


def _trim(side):
    return lambda a: E(f"trim({side} {text(a[1]) if len(a) > 1 else quoted(' ')} FROM {text(a[0])})", "text")


for _name, _side in (("trim", "BOTH"), ("ltrim", "LEADING"), ("rtrim", "TRAILING")):
    fn(_name, 1, 2)(_trim(_side))


@fn("instr", 2)
def _instr(a):
    if a[0].cls == a[1].cls == "blob":
        s, t = (f"decode({x.sql}, 'ISO-8859-1')" for x in a)
    else:
        s, t = text(a[0]), text(a[1])
    return E(f"CAST(instr({s}, {t}) AS BIGINT)", "int")


fn("hex", 1)(lambda a: E("''" if a[0].cls == "null" else f"coalesce(hex({a[0].sql if a[0].cls == 'blob' else text(a[0])}), '')", "text"))


@fn("unhex", 1, 2)
def _unhex(a):
    s = text(a[0])
    if len(a) > 1:
        # ignored characters may stand between pairs only
        s = f"CASE WHEN translate({s}, {text(a[1])}, '') IS NOT NULL AND regexp_replace({s}, '[0-9A-Fa-f][0-9A-Fa-f]', '') = translate(regexp_replace({s}, '[0-9A-Fa-f][0-9A-Fa-f]', ''), '0123456789abcdefABCDEF', '') AND translate(regexp_replace({s}, '[0-9A-Fa-f][0-9A-Fa-f]', ''), {text(a[1])}, '') = '' THEN translate({s}, {text(a[1])}, '') END"
    return E(f"CASE WHEN {s} RLIKE '^([0-9A-Fa-f][0-9A-Fa-f])*\\\\z' THEN unhex({s}) END", "blob")


@fn("quote", 1)
def _quote(a):
    e = a[0]
    if e.cls == "null":
        return lit("NULL")
    body = {"int": text(e), "real": text(e), "blob": f"concat('X\\'', hex({e.sql}), '\\'')"}.get(e.cls) or f"concat('\\'', replace(split_part({text(e)}, '\\u0000', 1), '\\'', '\\'\\''), '\\'')"
    return E(f"coalesce({body}, 'NULL')", "text")


fn("char", 0, None)(lambda a: E(f"d_char(array({', '.join(integer(x) if x.cls != 'null' else 'CAST(NULL AS BIGINT)' for x in a)}))", "text") if a else lit(""))
fn("unicode", 1)(lambda a: E(f"CAST(nullif(ascii({text(a[0])}), 0) AS BIGINT)", "int"))
fn("concat", 1, None)(lambda a: E(f"concat_ws('', {', '.join(map(text, a))})", "text"))


@fn("concat_ws", 2, None)
def _concat_ws(a):
    arr = f"array({', '.join(map(text, a[1:]))})"
    keep = f"filter({arr}, (x, i) -> x IS NOT NULL AND (x <> '' OR exists(slice({arr}, 1, i), y -> coalesce(y, '') <> '')))"
    return E(f"array_join({keep}, {text(a[0])})", "text")


def match(op: str, subject: E, pattern: E, escape: E | None = None) -> str:
    if escape is not None:
        if escape.cls == "null":
            return "CAST(NULL AS BOOLEAN)"
        if escape.literal and (not isinstance(escape.value, str) or len(escape.value) != 1):
            raise InvalidEscape("ESCAPE takes one character")
    if "null" in (subject.cls, pattern.cls):
        return "CAST(NULL AS BOOLEAN)"
    if escape is not None and not (escape.literal and pattern.literal):
        return f"d_like({text(pattern)}, {text(subject)}, {text(escape)})"
    if op == "like":
        return core.like(subject, pattern, escape)
    if pattern.literal:
        r = core.glob_regex(pattern.value if isinstance(pattern.value, str) else str(pattern.value))
        return f"if({text(subject)} IS NULL, NULL, false)" if r is None else f"({text(subject)} RLIKE {quoted(r)})"
    return f"d_glob({text(pattern)}, {text(subject)})"


fn("like", 2, 3)(lambda a: E(match("like", a[1], a[0], a[2] if len(a) > 2 else None), "bool"))
fn("glob", 2)(lambda a: E(match("glob", a[1], a[0]), "bool"))


@fn("coalesce", 2, None)
def _coalesce(a):
    cls = joined([x.cls for x in a])
    return E(f"coalesce({', '.join(as_class(x, cls) for x in a)})", cls)


fn("ifnull", 2)(_coalesce)


@fn("nullif", 2)
def _nullif(a):
    same = core.compared("=", a[0], a[1], "binary")
    return opt(a[0], f"CASE WHEN {same.sql} THEN NULL ELSE {a[0].sql} END", a[0].cls)


@fn("iif if", 2, None)
def _iif(a):
    pairs, other = list(zip(a[::2], a[1::2], strict=False)), a[-1] if len(a) % 2 else lit(None)
    cls = joined([v.cls for _, v in pairs] + [other.cls])
    return E("CASE " + " ".join(f"WHEN {truthy(c)} THEN {as_class(v, cls)}" for c, v in pairs) + f" ELSE {as_class(other, cls)} END", cls)


@fn("typeof", 1)
def _typeof(a):
    kind = {"int": "integer", "real": "real", "text": "text", "blob": "blob", "ts": "text"}.get(a[0].cls)
    return lit("null") if kind is None else E(f"if({a[0].sql} IS NULL, 'null', '{kind}')", "text")


def _extreme(name):
    def build(a):
        cls = joined([x.cls for x in a])
        vals = [as_class(x, cls) for x in a]
        if any(x.cls == "null" for x in a):
            return E(f"CAST(NULL AS {core.SPARK[cls]})", cls)
        return E(f"CASE WHEN {' AND '.join(f'{v} IS NOT NULL' for v in vals)} THEN {name}({', '.join(vals)}) END", cls)

    return build


fn("min", 2, None)(_extreme("least"))
fn("max", 2, None)(_extreme("greatest"))
fn("zeroblob", 1)(lambda a: E(f"unhex(repeat('00', CAST(greatest(0L, least(1000000000L, {integer(a[0])})) AS INT)))", "blob"))
fn("randomblob", 1)(lambda a: E(f"substring(unhex(repeat(replace(uuid(), '-', ''), CAST({integer(a[0])} / 16 AS INT) + 1)), 1, CAST(greatest(1L, {integer(a[0])}) AS INT))", "blob"))
fn("random", 0)(lambda a: E("xxhash64(uuid())", "int"))


# --- math
@fn("abs", 1)
def _abs(a):
    e = a[0]
    return E(f"abs({e.sql})", "int") if e.cls == "int" else opt(e, f"abs({real(e)})", "real")


@fn("round", 1, 2)
def _round(a):
    x = real(a[0])
    if "null" in [y.cls for y in a]:
        return E("CAST(NULL AS DOUBLE)", "real")
    # half away from zero on the binary value; a large one is whole already
    whole = f"CASE WHEN abs({x}) >= 4503599627370496D THEN {x} WHEN {x} < 0D THEN -floor(-({x}) + 0.5D) ELSE floor({x} + 0.5D) END"
    whole = f"CAST({whole} AS DOUBLE)"
    if len(a) < 2:
        return E(whole, "real")
    if a[1].literal:
        n = core.number(a[1]).value
        if n <= 0:
            return E(whole, "real")
        if n <= 15:
            # exact in the JVM while the scaled value is under 2**51; the rest is decided in decimal
            m = f"{float(10 ** int(n))!r}D"
            small = f"abs({x}) * {m} < 2251799813685248D"
            return E(f"if({small}, if({x} < 0D, -d_scaled(abs({x}), {m}), d_scaled(abs({x}), {m})), d_round(if({small}, CAST(NULL AS DOUBLE), {x}), {int(n)}))", "real")
        return E(f"d_round({x}, {int(min(n, 50))})", "real")
    return E(f"if({integer(a[1])} <= 0L, {whole}, d_round({x}, CAST(least(50L, greatest(0L, {integer(a[1])})) AS INT)))", "real")


fn("pi", 0)(lambda a: E("pi()", "real"))


def _math(names: str, form: str, domain: str = "") -> None:
    """A function of strict numbers; outside its domain it is NULL."""

    def build(a):
        xs = [strict(x) for x in a]
        body = form.format(*xs)
        return E(f"CASE WHEN {domain.format(*xs)} THEN {body} END" if domain else body, "real")

    n = 2 if "{1}" in form else 1
    fn(names, n)(build)


for _n in "sin cos tan atan sinh cosh tanh degrees radians exp".split():
    _math(_n, _n + "({0})")
_math("asinh", "if({0} < 0D, -asinh(-({0})), asinh({0}))")
_math("sqrt", "sqrt({0})", "{0} >= 0D")
_math("ln", "ln({0})", "{0} > 0D")
_math("log10", "log10({0})", "{0} > 0D")
_math("log2", "log2({0})", "{0} > 0D")
_math("asin", "asin({0})", "{0} BETWEEN -1D AND 1D")
_math("acos", "acos({0})", "{0} BETWEEN -1D AND 1D")
_math("acosh", "acosh({0})", "{0} >= 1D")
_math("atanh", "atanh({0})", "{0} BETWEEN -1D AND 1D")
_math("atan2", "atan2({0}, {1})")
_math("pow power", "nullif(pow({0}, {1}), CAST('NaN' AS DOUBLE))")
_math("mod", "try_mod({0}, {1})")


@fn("log", 1, 2)
def _log(a):
    if len(a) == 1:
        return REGISTRY["log10"][2](a)
    b, x = strict(a[0]), strict(a[1])
    return E(f"CASE WHEN {x} > 0D AND {b} > 0D AND {b} <> 1D THEN ln({x}) / ln({b}) END", "real")


def _whole(up: str, down: str):
    def build(a):
        e = a[0]
        if e.cls == "int":
            return e
        if e.cls == "null":
            return E("CAST(NULL AS BIGINT)", "int")
        x = strict(e)
        return E(f"CASE WHEN abs({x}) >= 4503599627370496D OR isnan({x}) THEN {x} WHEN {x} < 0D THEN CAST({down}({x}) AS DOUBLE) ELSE CAST({up}({x}) AS DOUBLE) END", "real")

    return build


fn("ceil ceiling", 1)(_whole("ceil", "ceil"))
fn("floor", 1)(_whole("floor", "floor"))
fn("trunc", 1)(_whole("floor", "ceil"))
fn("sign", 1)(lambda a: E(f"CAST(sign({strict(a[0])}) AS BIGINT)", "int"))


# --- dates
def _date(fmt: str, sub: str):
    def build(a):
        t, ms = dates.instant(a[0], a[1:])
        return E(dates.formatted(t, sub if ms else fmt), "text")

    return build


fn("date", 1, None)(_date("%Y-%m-%d", "%Y-%m-%d"))
fn("time", 1, None)(_date("%H:%M:%S", "%H:%M:%f"))
fn("datetime", 1, None)(_date("%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M:%f"))


@fn("julianday", 1, None)
def _julianday(a):
    return E(f"({dates.instant(a[0], a[1:])[0]} / 86400000D + 2440587.5D)", "real")


@fn("unixepoch", 0, None)
def _unixepoch(a):
    if not a:
        return E("CAST(NULL AS BIGINT)", "int")
    t, ms = dates.instant(a[0], a[1:])
    return E(f"({t} / 1000D)", "real") if ms else E(f"CAST(floor({t} / 1000D) AS BIGINT)", "int")


@fn("strftime", 1, None)
def _strftime(a):
    if len(a) < 2 or "null" in (a[0].cls, a[1].cls):
        return E("CAST(NULL AS STRING)", "text")
    if not a[0].literal:
        raise Unsupported("strftime() needs a literal format")
    t, _ = dates.instant(a[1], a[2:])
    return E(dates.formatted(t, str(a[0].value)) or "CAST(NULL AS STRING)", "text")


fn("timediff", 2)(lambda a: E(f"d_timediff({dates.instant(a[0], [])[0]}, {dates.instant(a[1], [])[0]})", "text"))


# --- printf and JSON
@fn("printf format", 1, None)
def _printf(a):
    if a[0].cls == "null":
        return E("CAST(NULL AS STRING)", "text")
    kinds = "".join({"int": "i", "real": "R" if x.signed else "r"}.get(x.cls, "t") for x in a[1:])
    plain = lambda x: f"CAST({x.sql} AS STRING)" if x.cls in ("int", "real") else text(x)
    # text has 15 digits of a real; numbers are made of all of them
    as_text = shown_as_text(str(a[0].value))
    shown = [text(x) if x.cls == "real" and i in as_text else plain(x) for i, x in enumerate(a[1:])]
    return E(f"d_printf({', '.join([text(a[0]), quoted(kinds), *shown])})", "text")


def _json(e: E) -> str:
    if e.cls == "blob":
        raise DatatypeMismatch("JSON cannot hold BLOB values")
    if e.cls == "null":
        return "'null'"
    return f"coalesce({text(e) if e.cls in ('int', 'real') else f'd_json({text(e)})'}, 'null')"


fn("json_quote", 1)(lambda a: E(_json(a[0]), "text"))
fn("json_array", 0, None)(lambda a: E(f"concat('[', {', \',\', '.join(map(_json, a))}, ']')" if a else "'[]'", "text"))


@fn("json_object", 0, None)
def _json_object(a):
    if len(a) % 2:
        raise WrongArgumentCount("json_object() needs an even number of arguments")
    if any(k.cls != "text" for k in a[::2]):
        raise DatatypeMismatch("json_object() labels must be TEXT")
    parts = [f"concat(d_json({text(k)}), ':', {_json(v)})" for k, v in zip(a[::2], a[1::2], strict=True)]
    return E(f"concat('{{', concat_ws(',', {', '.join(parts)}), '}}')" if parts else "'{}'", "text")


fn("sqlite_version", 0)(lambda a: lit("3.51.0"))
fn("sqlite_compileoption_used", 1)(lambda a: lit(0))
fn("sqlite_compileoption_get", 1)(lambda a: lit(None))


def cast(e: E, kind: str) -> E:
    """CAST by the affinity that a type's name has."""
    e, t = value(e), kind.upper()
    if not t:
        raise SyntaxFault("CAST without a type")
    if "INT" in t:
        if e.cls == "int":
            return e
        return E(f"d_toint({e.sql})", "int") if e.cls == "real" else E(f"d_intprefix({text(e)})", "int")
    if any(x in t for x in ("CHAR", "CLOB", "TEXT")):
        return E(text(e), "text")
    if "BLOB" in t:
        return e if e.cls == "blob" else E(f"CAST({text(e)} AS BINARY)", "blob")
    if any(x in t for x in ("REAL", "FLOA", "DOUB")):
        return E(real(e), "real")
    if e.cls in ("int", "real"):
        return e
    if e.literal and isinstance(e.value, str):
        n = core.number(e)
        return lit(int(n.value)) if isinstance(n.value, float) and n.value == int(n.value) and abs(n.value) < 1 << 53 else n
    return E(real(e), "real")
