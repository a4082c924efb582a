"""Run commands: ``python -m kairolog [--db FOLDER] [--init SCRIPT] [--file SCRIPT]``, or one by one from standard input.

A command may run over several lines; it is executed when its parentheses balance. An error is printed and the next
command is read.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterable
from typing import TextIO

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from kairolog.session import Database, Result


def depth(text: str) -> int:
    """How many brackets are open: outside strings and comments."""
    n, quoted, skip, comment = 0, False, False, False
    for i, c in enumerate(text):
        if skip:
            skip = False
        elif comment:
            comment = c != "\n"
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c == ";" or (c == "#" and not text[:i].rpartition("\n")[2].strip() and not text.startswith("#uuid", i)):
            comment = True
        else:
            n += (c in "([{") - (c in ")]}")
    return n + quoted


def show(db: Database, text: str, out: TextIO) -> None:
    for found in db.execute_script(text):
        if found is not None:
            print(found.text() if isinstance(found, Result) else found, file=out)


def repl(db: Database, lines: Iterable[str], out: TextIO, prompt: str = "") -> None:
    """Read, execute and print, a command at a time, up to the end or ``EXIT``."""
    held = ""
    print(prompt, end="", file=out, flush=True)
    for line in lines:
        if not held and line.strip() == "EXIT":
            return
        held += line if line.endswith("\n") else line + "\n"
        if depth(held) > 0:
            continue
        text, held = held, ""
        try:
            show(db, text, out)
        except (ValueError, TypeError, KeyError, RuntimeError, PySparkException) as e:
            print(f"error: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=out)
        print(prompt, end="", file=out, flush=True)
    if held.strip():
        print("error: the last command is not complete", file=out)


def main() -> int:
    options = argparse.ArgumentParser(prog="kairolog")
    for name in ("--db", "--init", "--file"):
        options.add_argument(name)
    given = options.parse_args()
    db = Database(SparkSession.builder.appName("kairolog").getOrCreate(), given.db)
    for f in (given.init, given.file):
        if f:
            with open(f, encoding="utf-8") as script:
                show(db, script.read(), sys.stdout)
    if not given.file:
        repl(db, sys.stdin, sys.stdout, "> " if sys.stdin.isatty() else "")
    return 0


if __name__ == "__main__":
    sys.exit(main())
