"""Records read one by one, as trees: what the vectorised reader is tested against."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from millrace.operators.nested import ITSELF, RECORD, Table




class _Number(str):
    """A number as it is written."""

    __slots__ = ()


def _refuse(word: str):
    raise ValueError(word)


# Whole numbers are read as such, which is faster and gives the same text; those too long for that as text.
_DECODER = json.JSONDecoder(parse_float=_Number, parse_constant=_refuse)
_LONG_NUMBERS = json.JSONDecoder(parse_float=_Number, parse_int=_Number, parse_constant=_refuse)
_SURROGATE = re.compile("[\ud800-\udfff]")


def decode(text: str | None):
    """(True, value) of complete JSON, else (False, None). A JSON string that holds JSON counts as that JSON."""
    if not text or text.isspace():
        return False, None
    value = text
    first = True
    while isinstance(value, str) and not isinstance(value, _Number):
        try:
            inner = _parse(value)
        except ValueError:
            return (False, None) if first else (True, value)
        value, first = inner, False
    return True, value


def _parse(text: str):
    try:
        return _DECODER.decode(text)
    except json.JSONDecodeError:
        raise
    except ValueError:
        return _LONG_NUMBERS.decode(text)
    except RecursionError:
        return _parse_deep(text)


_TOKEN = re.compile(r'[ \t\r\n]*(?:([\[\]{},:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?)|(true|false|null))', re.A)
_WORDS = {"true": True, "false": False, "null": None}


def _parse_deep(text: str):
    """The same for records nested deeper than the interpreter's stack: a loop over tokens with a stack of its own."""
    stack: list = []
    root: list = []
    at, end, need = 0, len(text.rstrip(" \t\r\n")), "value"
    while at < end:
        m = _TOKEN.match(text, at)
        if m is None or (not stack and root):
            raise ValueError(f"no JSON at {at}")
        at = m.end()
        mark, string, number, word = m.groups()
        box = stack[-1] if stack else None
        if mark in ("]", "}"):
            opened = box is not None and isinstance(box[0], list if mark == "]" else dict)
            if not opened or not (need == "more" or need == "first"):
                raise ValueError(f"no JSON at {at}")
            stack.pop()
            need = "more"
            continue
        if mark == ",":
            if need != "more" or box is None:
                raise ValueError(f"no JSON at {at}")
            need = "value" if isinstance(box[0], list) else "name"
            continue
        if mark == ":":
            if need != "colon":
                raise ValueError(f"no JSON at {at}")
            need = "value"
            continue
        if box is not None and isinstance(box[0], dict) and need in ("name", "first"):
            if string is None:
                raise ValueError(f"no JSON at {at}")
            box[1], need = json.loads(string), "colon"
            continue
        if need not in ("value", "first"):
            raise ValueError(f"no JSON at {at}")
        value = [] if mark == "[" else {} if mark == "{" else json.loads(string) if string is not None else _Number(number) if number is not None else _WORDS[word]
        if box is None:
            root.append(value)
        elif isinstance(box[0], list):
            box[0].append(value)
        else:
            box[0][box[1]] = value
        need = "more"
        if mark is not None:
            stack.append([value, None])
            need = "first"
    if stack or not root:
        raise ValueError("ends too early")
    return root[0]


def as_text(value) -> str | None:
    """A scalar as text: strings without quotes, numbers as written, true and false; null stays null, objects and arrays are JSON."""
    if value is None or type(value) is str:
        return value if value is None or value.isascii() else _SURROGATE.sub("�", value)
    if value is True or value is False:
        return "true" if value else "false"
    if isinstance(value, (_Number, int)):
        return str(value)
    return _json(value)


def _json(value) -> str:
    """An object or array as JSON again, by a loop, so that depth does no harm."""
    out: list[str] = []
    todo: list = [value]
    while todo:
        x = todo.pop()
        if type(x) is tuple:
            out.append(x[0])
        elif isinstance(x, dict):
            parts: list = [("{",)]
            for i, (k, v) in enumerate(x.items()):
                parts += [((", " if i else "") + json.dumps(k) + ": ",), v]
            todo += reversed([*parts, ("}",)])
        elif isinstance(x, list):
            parts = [("[",)]
            for i, v in enumerate(x):
                parts += [(", ",), v] if i else [v]
            todo += reversed([*parts, ("]",)])
        else:
            out.append(str(x) if isinstance(x, _Number) else json.dumps(x))
    return "".join(out)


# Names that would make a path ambiguous, or that UTF-8 can't hold, are written as JSON strings.
_UNCLEAR = re.compile('[.\\[\\]"\ud800-\udfff]|^\\$$')


def _name(name: str) -> str:
    return json.dumps(name) if _UNCLEAR.search(name) else name


def _nodes(value) -> Iterator[tuple[str, tuple[int, ...], object, int, str | None]]:
    """(path, ordinals, value, number of the enclosing node, name) of every object, array and scalar, numbered from 0 in document order."""
    todo = [("$", (), value, -1, None)]
    number = -1
    while todo:
        node = todo.pop()
        number += 1
        yield node
        path, ordinals, x, _, _ = node
        if type(x) is dict:
            todo.extend([(f"{path}.{_name(k)}", ordinals, v, number, k) for k, v in reversed(x.items())])
        elif type(x) is list:
            path += "[]"
            todo.extend([(path, (*ordinals, i), x[i], number, None) for i in range(len(x) - 1, -1, -1)])


def triples(value) -> Iterator[tuple[str, tuple[int, ...], str, str | None]]:
    """(path, ordinals, kind, text) of every object, array and scalar in document order. Path: names joined by dots (those with dots,
    brackets or quotes as JSON strings), [] for an array element; ordinals: the positions from 0 in the arrays on the way."""
    for path, ordinals, x, _, _ in _nodes(value):
        if isinstance(x, dict):
            yield path, ordinals, "object", None
        elif isinstance(x, list):
            yield path, ordinals, "array", None
        else:
            kind = "null" if x is None else "boolean" if x is True or x is False else "number" if isinstance(x, (_Number, int)) else "string"
            yield path, ordinals, kind, as_text(x)


class _Row:
    """A row under way. path, depth: where its object or value stands, and in how many arrays."""

    __slots__ = ("columns", "depth", "key", "number", "parent", "parent_number", "path", "position", "table", "wanted")

    def __init__(self, table, parent, key, position, number, parent_number, path, depth, wanted):
        self.table, self.parent, self.key, self.position, self.number, self.parent_number = table, parent, key, position, number, parent_number
        self.path, self.depth, self.wanted, self.columns = path, depth, wanted, {}


def pivot(value, record: str | None, tables: tuple[Table, ...]) -> list[_Row]:
    """The triples of a record, each scalar at its path in the row of its repeated ancestor, in document order.

    Rows are the objects of the tables; every other array element that is no array, in a table named by the row that encloses it and the
    path from there (``issue.fields.labels[]``; a scalar stands in the column ITSELF, the key is the positions from that row on); and
    the record for what is left, unless it is such an object itself. An object of two tables has a row with the same columns in each.
    """
    by_field = {t.held_by: t for t in tables if t.held_by is not None}
    by_names = [(t, t.having[0], t.having[1:], t.but_not) for t in tables if t.held_by is None]
    out: list[_Row] = []
    # Of every object and array: the field that holds it if it is an array, the rows it belongs to, the nearest row of each table around, whether it is an array.
    inside: dict[int, tuple] = {}
    for number, (path, ordinals, x, up, name) in enumerate(_nodes(value)):
        held, owners, around, element = inside[up] if up >= 0 else (None, (), (), False)
        kind = type(x)
        if kind is not dict and kind is not list and not element and up >= 0:
            text = as_text(x)
            for row in owners:
                row.columns[path[len(row.path) + 1 :]] = text
            continue
        if element:
            name = held
        own, nearer = [], around
        if kind is dict:
            position = ordinals[-1] if element else 0
            of = [by_field[name]] if name in by_field else []
            of += [t for t, first, others, but_not in by_names if first in x and name not in but_not and all(h in x for h in others)]
            for t in of:
                key = str(position) if t.key is None else as_text(x.get(t.key))
                parent, parent_number = record if t.parents is None else None, None
                for n, k, m in reversed(around) if t.parents is not None else ():
                    if n in t.parents:
                        parent, parent_number = k, m
                        break
                own.append(_Row(t.name, parent, key, position, number, parent_number, path, len(ordinals), True))
                nearer = (*[e for e in nearer if e[0] != t.name], (t.name, key, number))
        if not own and up < 0:
            own = [_Row(RECORD, None, record, 0, number, None, path, 0, False)]
        elif not own and element and kind is not list:
            over = owners[-1]
            own = [_Row(over.table + path[len(over.path) :], over.key, ".".join(map(str, ordinals[over.depth :])), ordinals[-1], number, over.number, path, len(ordinals), False)]
        out += own
        if kind is dict or kind is list:
            inside[number] = (None if element else name, tuple(own) or owners, nearer, kind is list)
        else:
            own[0].columns[ITSELF] = as_text(x)
    return out
