"""The filter language, compiled to a Spark column.

    expression := term { op term }      op := & | ^      term := ! term | group | field cmp value
    group := ( expression ) | [ expression ] | { expression }      cmp := = != < <= > >=

Values may be quoted, with \\" for a quote; spaces inside a value are kept. By default & binds closer than ^, and ^
closer than |, ``&&`` and ``||`` mean the same as one sign, and ! negates whatever follows. With ``compat`` there is no
precedence (each operator takes all that follows as its right side), ! before a group of several terms is true,
``a || b`` is true, and "12.5" as a time is 12 s and 5 ns. Unknown values make a comparison true, as events without the
structure pass the filter.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class FilterError(ValueError):
    pass


@dataclass(frozen=True)
class Leaf:
    field: str
    cmp: str
    value: str


@dataclass(frozen=True)
class Node:
    op: str
    left: object
    right: object = None


TRUE = Node("true", None)
STRINGS = {"trace.name": "trace_name", "tracefile.name": "channel", "channel.name": "channel", "event.subname": "event_name", "state.process_name": "process_name", "state.thread_brand": "thread_brand", "state.execution_mode": "mode", "state.execution_submode": "submode", "state.process_status": "status"}
NUMBERS = {"state.pid": "pid", "state.ppid": "ppid", "state.cpu": "cpu", "event.tsc": "tsc", "event.target_pid": "target_pid"}
TIMES = {"event.time": "time_ns", "state.creation_time": "creation_time", "state.insertion_time": "insertion_time"}
OPEN, CLOSE = "([{", ")]}"
BINDS = {"|": 1, "^": 2, "&": 3}


def tokens(text: str) -> list[tuple[str, str]]:
    """(kind, text) with kind one of op, open, close, cmp, word."""
    out, word, i, quoted = [], "", 0, False

    def end() -> None:
        nonlocal word, quoted
        if word.strip() or quoted:
            out.append(("word", word if quoted else word.strip()))
        word, quoted = "", False

    while i < len(text):
        c = text[i]
        if c == '"':
            quoted, word, i = True, word.strip(), i + 1
            while i < len(text) and text[i] != '"':
                if text[i] == "\\" and text[i + 1 : i + 2] == '"':
                    i += 1
                word += text[i]
                i += 1
            if i == len(text):
                raise FilterError("a quote is not closed")
        elif c in "&|^":
            end()
            out.append(("op", c))
        elif c in "<>=" or c == "!":
            two = text[i : i + 2]
            if c == "!" and two != "!=":
                end()
                out.append(("not", c))
            else:
                end()
                out.append(("cmp", two if two in ("!=", "<=", ">=") else c))
                i += two in ("!=", "<=", ">=")
        elif c in OPEN or c in CLOSE:
            end()
            out.append(("open" if c in OPEN else "close", c))
        else:
            word += c
        i += 1
    end()
    return out


def parse(text: str, compat: bool = False):
    found, at = tokens(text), 0

    def peek(kind: str) -> bool:
        return at < len(found) and found[at][0] == kind

    def take() -> str:
        nonlocal at
        if at == len(found):
            raise FilterError("the expression ends too early")
        at += 1
        return found[at - 1][1]

    def term():
        if peek("not"):
            take()
            inner = term()
            return TRUE if compat and isinstance(inner, Node) and inner.op in BINDS else Node("!", inner)
        if peek("open"):
            shut = CLOSE[OPEN.index(take())]
            inner = expression(0)
            if not peek("close") or take() != shut:
                raise FilterError(f"{shut} is missing")
            return inner
        if compat and (peek("op") or at == len(found)):
            return TRUE
        field = take()
        if found[at - 1][0] != "word" or not peek("cmp"):
            raise FilterError(f"a comparison was expected at {field!r}")
        cmp, value = take(), take()
        if found[at - 1][0] != "word":
            raise FilterError(f"a value was expected at {value!r}")
        return Leaf(field.lower() if not field.lower().startswith("event.field.") else "event.field." + field[12:], cmp, value)

    def expression(least: int):
        left = term()
        while peek("op") and BINDS[found[at][1]] >= (0 if compat else least):
            op = take()
            if not compat and peek("op") and found[at][1] == op:
                take()
            left = Node(op, left, expression(0 if compat else BINDS[op] + 1))
        return left

    if not found:
        return TRUE
    out = expression(0)
    if at != len(found):
        raise FilterError(f"{found[at][1]!r} was not expected")
    return out


def _time(value: str, compat: bool) -> int:
    whole, _, part = value.partition(".")
    try:
        return int(whole) * 1_000_000_000 + (int(part or 0) if compat else int((part + "000000000")[:9]))
    except ValueError:
        raise FilterError(f"{value!r} is no time") from None


def _leaf(leaf: Leaf, compat: bool, columns: set[str] | None) -> Column:
    f = leaf.field
    if f == "event.category" or f.startswith("traceset."):
        return F.lit(True)
    if f == "event.name":
        channel, dot, name = leaf.value.rpartition(".")
        if leaf.cmp not in ("=", "!="):
            raise FilterError("event.name has = and != only")
        same = (F.col("channel") == channel) & (F.col("event_name") == name) if dot else F.col("event_name") == name if not compat else F.lit(False)
        return same if leaf.cmp == "=" else ~same
    if f.startswith("event.field."):
        if compat:
            return F.lit(True)
        name = f[12:].rpartition(".")[2]
        try:
            column, value = F.col(name), F.lit(int(leaf.value))
        except ValueError:
            column, value = F.col(name).cast("string"), F.lit(leaf.value)
    elif f in STRINGS:
        if leaf.cmp not in ("=", "!="):
            raise FilterError(f"{f} has = and != only")
        name = STRINGS[f]
        column, value = F.col(name), F.lit(leaf.value)
    elif f in NUMBERS:
        name = NUMBERS[f]
        try:
            column, value = F.col(name), F.lit(int(leaf.value) & 0xFFFF if compat and f in ("state.pid", "state.ppid") else int(leaf.value))
        except ValueError:
            raise FilterError(f"{leaf.value!r} is no number") from None
    elif f in TIMES:
        name = TIMES[f]
        column, value = F.col(name), F.lit(_time(leaf.value, compat))
    else:
        raise FilterError(f"there is no field {f!r}")
    if columns is not None and name not in columns:
        return F.lit(True)
    found = {"=": column == value, "!=": column != value, "<": column < value, "<=": column <= value, ">": column > value, ">=": column >= value}[leaf.cmp]
    return F.coalesce(found, F.lit(True))


def to_column(tree, compat: bool = False, columns: set[str] | None = None) -> Column:
    if isinstance(tree, Leaf):
        return _leaf(tree, compat, columns)
    if tree.op == "true":
        return F.lit(True)
    left = to_column(tree.left, compat, columns)
    if tree.op == "!":
        return ~left
    right = to_column(tree.right, compat, columns)
    return left & right if tree.op == "&" else left | right if tree.op == "|" else left != right


def compile_filter(text: str, compat: bool = False, columns: set[str] | None = None) -> Column:
    """columns: those of the table, if fields that it lacks are to pass."""
    return to_column(parse(text, compat), compat, columns)


def joined(expressions: list[str]) -> str:
    """Several expressions, each in brackets, all of which must hold."""
    return "&".join(f"({e})" for e in expressions if e.strip())


def gathered(spark, expressions: Sequence[str] = (), files: Sequence[str] = ()) -> str:
    """Expressions and those in text files, a file being one expression over all its lines, as one."""
    read = [" ".join(r.value for r in spark.read.option("wholetext", True).text(f).collect()) for f in files]
    return joined([*expressions, *[" ".join(text.split()) for text in read]])


def built(rows: list[tuple[str, str, str, str]]) -> str:
    """Rows of (field, comparison, value, operator to the next row) as one expression."""
    out = ""
    for k, (field, cmp, value, op) in enumerate(rows):
        quoted = '"' + value.replace('"', '\\"') + '"'
        out += f"{field}{cmp}{quoted}" + (op if k < len(rows) - 1 else "")
    return out
