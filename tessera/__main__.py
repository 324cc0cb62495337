"""Command line: ``python -m tessera [-c SQL] [-f FILE] [--format table|csv|tsv|json|nd-json]``; without either, a prompt.

At the prompt: ``\\q`` quit, ``\\?`` help, ``\\d [table]`` list or describe, ``\\h`` functions, ``\\i file`` run a
file, ``\\quiet`` timing on or off, ``\\pset format NAME``.
"""

from __future__ import annotations

import argparse
import re
import sys
import time

from tessera.session import Session

FORMATS = ("table", "csv", "tsv", "json", "nd-json")


def statements(text: str) -> list[str]:
    """The statements of a text, cut at semicolons outside quotes and comments."""
    out, at = [], 0
    for m in re.finditer(r"'(?:[^']|'')*'|\"[^\"]*\"|--[^\n]*|/\*.*?\*/|;", text, re.S):
        if m[0] == ";":
            out.append(text[at : m.start()])
            at = m.end()
    return [s for s in (x.strip() for x in [*out, text[at:]]) if s]


class Shell:
    def __init__(self, session: Session, form: str = "table", quiet: bool = False, out=sys.stdout):
        self.session, self.form, self.quiet, self.out = session, form, quiet, out

    def print(self, frame) -> None:
        """All rows, fetched partition by partition."""
        names = frame.df.columns
        if self.form == "table":
            print(frame.to_string(1_000), file=self.out)
            return
        if self.form in ("json", "nd-json"):
            rows = frame.df.toJSON().toLocalIterator()
            text = "\n".join(rows) if self.form == "nd-json" else "[" + ",".join(rows) + "]"
            print(text, file=self.out)
            return
        import csv

        writer = csv.writer(self.out, delimiter="\t" if self.form == "tsv" else ",", lineterminator="\n")
        writer.writerow(names)
        writer.writerows(frame.df.toLocalIterator())

    def run(self, text: str) -> None:
        for sql in statements(text):
            began = time.time()
            self.print(self.session.sql(sql))
            if not self.quiet:
                print(f"Elapsed {time.time() - began:.3f} seconds.", file=self.out)

    def command(self, line: str) -> bool:
        """A backslash command; False ends the prompt."""
        word, *rest = line[1:].split()
        if word == "q":
            return False
        if word == "?":
            print(__doc__, file=self.out)
        elif word == "d":
            self.print(self.session.sql(f"DESCRIBE {rest[0]}" if rest else "SHOW TABLES"))
        elif word == "h":
            self.print(self.session.sql("SHOW FUNCTIONS"))
        elif word == "i":
            with open(rest[0]) as f:
                self.run(f.read())
        elif word == "quiet":
            self.quiet = rest[0] == "true" if rest else not self.quiet
        elif word == "pset" and len(rest) == 2 and rest[1] in FORMATS:
            self.form = rest[1]
        else:
            print(f"\\{word} isn't known; \\? helps", file=self.out)
        return True

    def prompt(self) -> None:
        held = ""
        while True:
            try:
                line = input("> " if not held else "| ")
            except EOFError:
                return
            if not held and line.startswith("\\"):
                if not self.command(line):
                    return
                continue
            held += line + "\n"
            if line.rstrip().endswith(";"):
                text, held = held, ""
                try:
                    self.run(text)
                except Exception as e:  # noqa: BLE001  the prompt goes on
                    print(str(e).split("JVM stacktrace")[0], file=self.out)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("-c", "--command", action="append", default=[])
    p.add_argument("-f", "--file", action="append", default=[])
    p.add_argument("--format", choices=FORMATS, default="table")
    p.add_argument("-q", "--quiet", action="store_true")
    a = p.parse_args(args)
    shell = Shell(Session(), a.format, a.quiet)
    for name in a.file:
        with open(name) as f:
            shell.run(f.read())
    for text in a.command:
        shell.run(text)
    if not a.file and not a.command:
        shell.prompt()


if __name__ == "__main__":
    main()
