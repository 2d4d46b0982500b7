"""``python -m tessera``: a line-by-line shell, or one statement with ``-c``.

Rows are shown in list mode: values set apart by ``|``, NULL as nothing, reals
with 15 digits, control characters as ``^`` and a letter, text up to a NUL.
"""

from __future__ import annotations

import sys
from typing import TextIO

from .errors import DialectError
from .functions.core import real_text

HELP = """python -m tessera                     start the shell
python -m tessera -c "SQL"            run one statement
python -m tessera -file PATH          open a database file
python -m tessera -file PATH -c "SQL"
.help shows this, .exit or .quit ends the shell
"""


def shown(v) -> str:
    """A value in list mode."""
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        return real_text(v)
    if isinstance(v, (bytes, bytearray)):
        v = bytes(v).decode("utf-8", "replace")
    text = str(v).partition("\0")[0]
    return "".join(c if ord(c) >= 32 or c in "\t\n" else "^" + chr(ord(c) + 64) for c in text)


def run(session, sql: str, out: TextIO, err: TextIO) -> bool:
    """Run a statement and print its rows as they come; whether it went well."""
    try:
        result = session.sql(sql)
        if result.columns != ["value"] or result.take(1):
            for row in result.toLocalIterator():
                print("|".join(map(shown, row)), file=out)
        return True
    except DialectError as e:
        print(f"error: {type(e).__name__}: {e}", file=err)
        return False


def shell(session, lines, out: TextIO, err: TextIO) -> None:
    for line in lines:
        line = line.strip()
        if line in (".exit", ".quit"):
            return
        if line == ".help":
            print(HELP, end="", file=out)
        elif line:
            run(session, line, out, err)


def main(args: list[str], session=None, lines=None, out: TextIO = sys.stdout, err: TextIO = sys.stderr) -> int:
    given = dict(zip(args[::2], args[1::2], strict=False))
    if "--help" in args or set(given) - {"-c", "-file"} or len(args) % 2:
        print(HELP, end="", file=out)
        return 0 if "--help" in args else 2
    if session is None:
        from pyspark.sql import SparkSession

        from .session import Session

        spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        spark.sparkContext.setLogLevel("OFF")
        session = Session(spark)
    if "-file" in given:
        session.attach(given["-file"], write=True)
    if "-c" in given:
        return 0 if run(session, given["-c"], out, err) else 1
    shell(session, lines or sys.stdin, out, err)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
