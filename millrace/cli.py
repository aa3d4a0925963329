"""Command line: ``python -m millrace.cli [--eval TEXT | FILE] [name=value ...]``, or a prompt."""

from __future__ import annotations

import argparse
import contextlib
import re
import sys
from collections.abc import Iterator

from millrace.plans.engine import BUILTINS, Engine, EvalProblem, table_lines, text_of
from millrace.plans.syntax import SyntaxProblem
from millrace.plans.usage import USAGE
from millrace.plans.values import Table, table_of
from millrace.session import local_session
from millrace.sources import registry


def argument(text: str) -> bool | int | float | str:
    """A script's argument: a bool, int or float if it reads as one."""
    if text in ("true", "false"):
        return text == "true"
    for kind in (int, float):
        with contextlib.suppress(ValueError):
            return kind(text)
    return text


def show(engine: Engine, v: object) -> Iterator[str]:
    """What a value looks like, line by line; all rows of a table."""
    if isinstance(v, Table):
        yield from table_lines(v.df)
    else:
        out = engine.outside(v)
        yield from map(str, out) if isinstance(out, list) else [text_of(out)]


def help_text(name: str = "") -> str:
    if name in BUILTINS:
        return USAGE[name]
    return "functions: " + ", ".join(sorted(BUILTINS))


def prompt(engine: Engine, read=input, write=print) -> None:  # noqa: ANN001
    """Statements until ``quit`` or the end of input. ``help [name]``; ``statement > file`` and ``>> file`` write what would be shown."""
    text, past = "", []
    while True:
        try:
            text += read("... " if text else "> ")
        except EOFError:
            return
        word = text.strip()
        if word == "quit":
            return
        if word == "history":
            write("\n".join(past))
            text = ""
            continue
        if word == "help" or word.startswith("help "):
            write(help_text(word[5:].strip()))
            text = ""
            continue
        to = re.search(r"\s(>>?)\s*([\w./-]+\.\w+)\s*$", text)
        try:
            v = engine.run(text[: to.start()] if to else text)
            shown = show(engine, v) if v is not None else []
            if to:
                with open(to[2], "a" if to[1] == ">>" else "w") as f:
                    f.writelines(line + "\n" for line in shown)
            else:
                for line in shown:
                    write(line)
        except SyntaxProblem as e:
            if e.incomplete:
                text += "\n"
                continue
            write(f"error: {e}")
        except (EvalProblem, ValueError) as e:
            write(f"error: {e}")
        past.append(text.strip())
        text = ""


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="millrace", description=__doc__)
    parser.add_argument("--eval", help="a program")
    parser.add_argument("--output", help="write the resulting table to this path")
    parser.add_argument("--overwrite", action="store_true", help="replace files that exist")
    parser.add_argument("file", nargs="?", help="a file with a program")
    parser.add_argument("args", nargs="*", help="name=value: global names of the program")
    options = parser.parse_args(argv)
    rest = list(options.args)
    if options.eval is not None and options.file is not None:
        rest.insert(0, options.file)
    engine = Engine(local_session("millrace"), overwrite=options.overwrite)
    for pair in rest:
        name, _, value = pair.partition("=")
        engine.set_global(name, argument(value))
    if options.eval is None and options.file is None:
        prompt(engine)
        return 0
    if options.eval is None:
        with open(options.file) as f:
            text = f.read()
    else:
        text = options.eval
    try:
        v = engine.run(text)
    except (SyntaxProblem, EvalProblem) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    if options.output:
        df = v.df if isinstance(v, Table) else table_of(engine.spark.createDataFrame([(engine.outside(v),)], "_ string")).df
        registry.write(df, options.output, overwrite=options.overwrite)
    else:
        for line in show(engine, v):
            print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
