"""What programs pass to each other: CALL ... USING with the copybook that defines each field.

The procedure division is read as a stream of words, literals and full stops. A call's operands
begin at USING and end at the next statement, scope end, exception phrase, RETURNING or full stop.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "path string, program string, callee string, field string, copybook string, level int, pic string, line int"
COLUMNS = ("path", "program", "callee", "field", "copybook", "level", "pic", "line")
IDLE, CALLEE, BEFORE, OPERANDS = range(4)  # of a call: what the next word can be
PROGRAM, DIVISION = re.compile(r"PROGRAM-ID\s*\.\s*([A-Z0-9@#$-]+)"), re.compile(r"PROCEDURE\s+DIVISION\b")
LEVEL = re.compile(r"^(\d{2})\s+([A-Z][A-Z0-9@#$-]*)")
PICTURE = re.compile(r"\bPIC(?:TURE)?\s+(?:IS\s+)?(\S+)")
TOKEN = re.compile(r"'[^']*'?|\"[^\"]*\"?|[A-Z0-9@#$_-]+|\.|\S")
NAME = re.compile(r"[A-Z][A-Z0-9@#$-]*")
# Words of the language. Those that are no field among operands, and those that end them.
MODES = frozenset("REFERENCE VALUE CONTENT BY USING END-CALL LENGTH ADDRESS OF NULL SPACES ZEROS ZERO".split())
PHRASES = frozenset("ON NOT EXCEPTION OVERFLOW RETURNING GIVING ELSE THEN WHEN".split())
VERBS = frozenset(
    "ACCEPT ADD ALTER CALL CANCEL CLOSE COMPUTE CONTINUE COPY DELETE DISPLAY DIVIDE ENTER ENTRY EVALUATE EXEC EXIT GENERATE GO GOBACK IF INITIALIZE INITIATE INSPECT INVOKE MERGE MOVE MULTIPLY NEXT OPEN PERFORM READ RELEASE REPLACE RETURN REWRITE SEARCH SET SORT START STOP STRING SUBTRACT SUPPRESS TERMINATE UNSTRING USE WRITE".split()
)


ENDS = VERBS | PHRASES | {"."}


def ends(word: str) -> bool:
    return word in ENDS or word.startswith("END-")


def declared(texts: list[str]) -> dict[str, tuple[str | None, int, str | None]]:
    """Of each field of the data division its copybook, level and picture: the last COPY before its declaration, or the one under its 01 level."""
    out: dict[str, tuple[str | None, int, str | None]] = {}
    book = top = None
    for text in texts:
        if m := re.search(r"\bCOPY\s+([A-Z0-9@#$-]+)", text):
            book = m[1]
            if top:
                out[top] = (book, *out[top][1:])
        elif m := LEVEL.match(text):
            pic = PICTURE.search(text)
            if m[1] == "01":
                top = m[2]
            out.setdefault(m[2], (book, int(m[1]), pic[1].rstrip(".") if pic else None))
    return out


class Calls:
    """The calls of a procedure division that pass something, as (line, callee, fields) in found; lines are fed in order.

    A line without CALL outside of a call says nothing and is not split into words.
    """

    def __init__(self):
        self.found: list[tuple[int, str, list[str]]] = []
        self.state, self.line, self.callee, self.fields = IDLE, 0, "", []

    def feed(self, line: int, text: str):
        if self.state == IDLE and "CALL" not in text:
            return
        for word in TOKEN.findall(text):
            if self.state == CALLEE:
                self.callee, self.fields, self.state = word.strip("'\""), [], BEFORE
                continue
            if self.state != IDLE and ends(word):
                self.close()
            if self.state == IDLE:
                if word == "CALL":
                    self.line, self.state = line, CALLEE
            elif self.state == BEFORE:
                if word == "USING":
                    self.state = OPERANDS
            elif NAME.fullmatch(word) and word not in MODES and word not in self.fields:
                self.fields.append(word)

    def close(self):
        if self.state == OPERANDS and self.fields and self.callee:
            self.found.append((self.line, self.callee, self.fields))
        self.state = IDLE


class File:
    """One file, line by line; comment and debugging lines don't count, and a continued literal is not joined."""

    def __init__(self, path: str | None):
        self.path, self.program, self.data, self.calls, self.in_procedure = path, None, [], Calls(), False

    def feed(self, line: int, code: str):
        if len(code) < 8 or code[6] in "*/D":
            return
        text = code[7:72].strip().upper()
        if not self.program and text.startswith("PROGRAM-ID") and (m := PROGRAM.match(text)):
            self.program = m[1]
        if text.startswith("PROCEDURE") and DIVISION.match(text):
            self.in_procedure = True
        elif self.in_procedure:
            self.calls.feed(line, text)
        else:
            self.data.append(text)

    def rows(self) -> list[tuple]:
        self.calls.close()
        if self.program is None:
            return []
        fields, none = declared(self.data), (None, None, None)
        return [(self.path, self.program, callee, f, *fields.get(f, none), line) for line, callee, names in self.calls.found for f in names]


def parse(codes: list[tuple[int, str]]) -> list[dict]:
    """Rows of one file's lines."""
    file = File(None)
    for line, code in codes:
        file.feed(line, code)
    return [dict(zip(COLUMNS[1:], row[1:], strict=True)) for row in file.rows()]


def uses(lines: DataFrame) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Files one after another, each in the order of its lines; a file may go over the end of a batch."""
        schema = pa.schema([(n, pa.int32() if n in ("level", "line") else pa.string()) for n in COLUMNS])
        file, out = None, []
        for batch in batches:
            for path, line, code in zip(*(batch.column(c).to_pylist() for c in ("path", "line", "code")), strict=True):
                if file is None or path != file.path:
                    out += file.rows() if file else []
                    file = File(path)
                file.feed(line, code)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                out = []
        if file and (out := file.rows()):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return lines.select("path", "line", "code").repartition("path").sortWithinPartitions("path", "line", "code").mapInArrow(scan, SCHEMA)
