"""Deeply nested records as related flat tables.

Records are read as a stream of bytes, a few megabytes at a time and all records of these together: marks outside strings give tokens,
tokens give triples (path, value, ordinals), one per scalar, and one per object or array so that empty ones are seen. No tree is
built, and depth needs no stack. Paths are numbered, so that what depends on a path alone is decided once per distinct path.
Triples whose paths share the same repeated ancestor (the innermost array element or the object of a table) belong to
one row; the rows of an ancestor form a table, linked to the row that encloses it, and each group is pivoted into its
table. Everything about a record is known where it is read, so nothing is shuffled; rows leave in document order.

Texts that aren't complete JSON (also with NaN, trailing text, or half a string), null and empty texts have no triples; neither have parts
of them. A JSON string that holds JSON counts as that JSON. Of a name repeated in an object the last holds, as most readers have
it. Numbers keep the text as written. Halves of surrogate pairs become U+FFFD.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRIPLES = "path string, ordinals array<int>, kind string, value string"
#: Bytes of records that are read together, or one record if it is longer.
CHUNK = 4 << 20

_OBJECT, _OBJECT_END, _ARRAY, _ARRAY_END, _COLON, _COMMA, _STRING, _LITERAL, _BLANK = range(9)


def _table_of_bytes(default: int, *sets: tuple[str, int]) -> np.ndarray:
    out = np.full(256, default, dtype=np.uint8)
    for characters, value in sets:
        out[list(characters.encode())] = value
    return out


_CLASS = _table_of_bytes(_LITERAL, ("{", _OBJECT), ("}", _OBJECT_END), ("[", _ARRAY), ("]", _ARRAY_END), (":", _COLON), (",", _COMMA), (" \t\r\n", _BLANK))
_STEP = np.array([1, -1, 1, -1, 0, 0, 0, 0, 0], dtype=np.int8)
_ESCAPES = _table_of_bytes(0, ('"\\/bfnrtu', 1)).astype(bool)
_HEX = _table_of_bytes(0, ("0123456789abcdefABCDEF", 1)).astype(bool)
_VALID = r"^(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null)$"
_SURROGATE = re.compile("[\ud800-\udfff]")
# Names that would make a path ambiguous, or that UTF-8 can't hold, are written as JSON strings.
_UNCLEAR = re.compile('[.\\[\\]"\ud800-\udfff]|^\\$$')


def _name(name: str) -> str:
    return json.dumps(name) if _UNCLEAR.search(name) else name


def _sound(text: str) -> str:
    return text if text.isascii() else _SURROGATE.sub("�", text)


def _refuse(word: str):
    raise ValueError(word)


def _unwrapped(text: str) -> str | None:
    """The JSON that a JSON string holds, however often it is wrapped; the string itself if that isn't JSON."""
    while True:
        try:
            inner = json.loads(text)
        except (ValueError, RecursionError):
            return text
        if not isinstance(inner, str):
            return text
        try:
            json.loads(inner, parse_constant=_refuse)
        except RecursionError:
            return _sound(inner)  # nested deeper than that reader goes
        except ValueError:
            return text
        text = _sound(inner)


def _spans(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Array:
    """The texts data[a:b]."""
    size = b - a
    ends = np.concatenate([[0], np.cumsum(size)])
    take = np.arange(ends[-1]) + np.repeat(a - ends[:-1], size)
    return pa.Array.from_buffers(pa.string(), len(a), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data[take])])


def _unescaped(raw: list[str]) -> list[str]:
    return [_sound(x) for x in json.loads('["' + '","'.join(raw) + '"]')] if raw else []


def _starts(values: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    return np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.zeros(0, bool)


def _by_level(level: np.ndarray) -> list[np.ndarray]:
    """The members of each level, in order."""
    if not len(level):
        return []
    order = np.argsort(level.astype(np.int16) if level.max() < 1 << 15 else level, kind="stable")
    return np.split(order, np.searchsorted(level[order], np.arange(1, level.max() + 1)))


@dataclass
class Triples:
    """The triples of some records as columns, in document order. record: its number among them; parent: the number of the enclosing
    triple (-1: none); position: from 0 in the array that it is an element of, -1 if it is none; name, path: numbers in ``names`` and
    ``paths``, which has (path of the parent, name; -1: an element)."""

    data: np.ndarray
    slashes: np.ndarray
    record: np.ndarray
    kind: np.ndarray
    start: np.ndarray
    end: np.ndarray
    parent: np.ndarray
    position: np.ndarray
    name: np.ndarray
    path: np.ndarray
    levels: list[np.ndarray]
    names: dict[str, int]
    paths: list[tuple[int, int]]

    def path_texts(self) -> list[str]:
        known, out = {i: "." + _name(n) for n, i in self.names.items()} | {-1: "[]"}, ["$"]
        for parent, name in self.paths[1:]:
            out.append(out[parent] + known[name])
        return out

    def scalars(self) -> np.ndarray:
        return self.kind >= _STRING

    def texts(self, at: np.ndarray) -> pa.Array:
        """The texts of triples: strings without quotes, numbers as written, true and false; null stays null, objects and arrays are the JSON as written."""
        a, b = self.start[at], self.end[at]
        text = self.kind[at] == _STRING
        out = _spans(self.data, a + text, b - text)
        mask = (self.kind[at] == _LITERAL) & (self.data[a] == ord("n"))
        if mask.any():
            out = pc.if_else(pa.array(~mask), out, pa.scalar(None, pa.string()))
        odd = np.flatnonzero(text & (np.searchsorted(self.slashes, b) > np.searchsorted(self.slashes, a)))
        if len(odd):
            where = np.arange(len(at))
            where[odd] = len(at) + np.arange(len(odd))
            found = pa.array(_unescaped(out.take(pa.array(odd)).to_pylist()), pa.string())
            out = pa.concat_arrays([out, found]).take(pa.array(where))
        return out

    def up(self, mark: np.ndarray) -> np.ndarray:
        """The nearest marked triple that encloses each, itself included; -1 if there is none."""
        near = np.where(mark, np.arange(len(mark)), -1)
        for at in self.levels[1:]:
            at = at[~mark[at]]
            near[at] = near[self.parent[at]]
        return near

    def has(self, name: str) -> np.ndarray:
        """Which objects have a field of this name."""
        out = np.zeros(len(self.kind), bool)
        if name in self.names:
            out[self.parent[self.name == self.names[name]]] = True
        return out

    def child(self, name: str) -> np.ndarray:
        """The triple of each object's field of this name, or -1."""
        out = np.full(len(self.kind), -1)
        if name in self.names:
            at = np.flatnonzero(self.name == self.names[name])
            out[self.parent[at]] = at
        return out


def triples(bodies: pa.Array) -> Triples:
    """Reads the records ``bodies`` (texts, none null)."""
    size = pc.binary_length(bodies).to_numpy(zero_copy_only=False).astype(np.int64)
    ended = pc.binary_join_element_wise(bodies, "", "\n")
    data = np.frombuffer(ended.buffers()[2] or b"", dtype=np.uint8)[: int((size + 1).sum())]
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    record_of = lambda at: np.searchsorted(begin, at, "right") - 1
    good = size > 0

    # Strings: quotes that no backslash escapes.
    slashes, quotes = np.flatnonzero(data == ord("\\")), np.flatnonzero(data == ord('"'))
    if len(slashes):
        first = np.concatenate([[True], slashes[1:] != slashes[:-1] + 1])
        escaped = slashes[(slashes - slashes[first][np.cumsum(first) - 1]) % 2 == 0] + 1
        is_escaped = np.zeros(len(data), bool)
        is_escaped[escaped] = True
        quotes = quotes[~is_escaped[quotes]]
        good[record_of(escaped[~_ESCAPES[data[escaped]]])] = False
        four = escaped[data[escaped] == ord("u")]
        good[record_of(four[~_HEX[data[np.minimum(four[:, None] + np.arange(1, 5), len(data) - 1)]].all(axis=1)])] = False
    good &= np.diff(np.searchsorted(quotes, begin)) % 2 == 0
    quotes = quotes if good.all() else quotes[good[record_of(quotes)]]
    opened, closed = quotes[0::2], quotes[1::2]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[opened] = 1
    edge[closed + 1] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    good[record_of(np.flatnonzero((data < 32) & inside))] = False

    # Tokens: marks, and where strings and literals begin.
    kinds = _CLASS[data]
    kinds[inside] = _BLANK
    literal = kinds == _LITERAL  # of the last byte it isn't, which ends a line
    kinds[1:][literal[1:] & literal[:-1]] = _BLANK
    kinds[opened] = _STRING
    at = np.flatnonzero(kinds != _BLANK)
    code = kinds[at]
    end = at + 1
    end[code == _STRING] = closed + 1
    end[code == _LITERAL] = np.flatnonzero(literal[:-1] > literal[1:]) + 1
    count = np.diff(np.searchsorted(at, begin))
    record = np.repeat(np.arange(len(size)), count)

    # Depth: an opening mark and its end stand on the level around them.
    step = _STEP[code]
    depth = np.cumsum(step, dtype=np.int64)
    base = np.repeat(np.concatenate([[0], depth])[np.searchsorted(at, begin[:-1])], count)
    level = depth - (step > 0) - base
    good &= count > 0
    good[record[level < 0]] = False
    ends = np.searchsorted(at, begin)
    total = np.concatenate([[0], depth])
    good &= total[ends[1:]] == total[ends[:-1]]
    if not good.all():
        keep = good[record]
        at, end, code, record, level = at[keep], end[keep], code[keep], record[keep], level[keep]
    first = _starts(record)

    # What encloses each token, and where each object or array ends.
    parent, whole = np.full(len(code), -1), end.copy()
    around = np.zeros(0, np.int64)
    for here in _by_level(level):
        if len(around):
            parent[here] = around[np.searchsorted(around, here) - 1]
        c = code[here]
        around, ends = here[(c == _OBJECT) | (c == _ARRAY)], here[(c == _OBJECT_END) | (c == _ARRAY_END)]
        opening = around[np.searchsorted(around, ends) - 1] if len(around) else ends
        whole[opening] = end[ends]
        good[record[ends[code[ends] != code[opening] + 1]]] = False

    # Grammar: what may stand after what.
    context = np.where(parent >= 0, code[parent], _BLANK) if len(code) else code
    before = np.where(first, _BLANK, np.concatenate([[_BLANK], code[:-1]])) if len(code) else code
    is_key = (code == _STRING) & (context == _OBJECT) & ((before == _OBJECT) | (before == _COMMA))
    value = ((code == _OBJECT) | (code == _ARRAY) | (code >= _STRING)) & ~is_key
    after = lambda mark: np.concatenate([[False], mark[:-1]]) & ~first if len(mark) else mark
    done = after(value & (code >= _STRING)) | (before == _OBJECT_END) | (before == _ARRAY_END)
    fits = is_key | (code == _COLON) & after(is_key) | (code == _COMMA) & (context != _BLANK) & done
    fits |= ((code == _OBJECT_END) | (code == _ARRAY_END)) & (done | (before == _OBJECT) | (before == _ARRAY))
    fits |= value & np.where(context == _OBJECT, before == _COLON, np.where(context == _ARRAY, (before == _ARRAY) | (before == _COMMA), before == _BLANK))
    good[record[~fits]] = False
    words = np.flatnonzero(code == _LITERAL)
    valid = pc.match_substring_regex(_spans(data, at[words], end[words]).cast(pa.string()), _VALID).to_numpy(zero_copy_only=False).astype(bool)
    good[record[words[~valid]]] = False

    # Names of fields, and fields whose name comes again later in their object.
    tokens = np.flatnonzero(value & good[record])
    number = np.full(len(code) + 1, -1)
    number[tokens] = np.arange(len(tokens))
    up = number[parent[tokens]]
    field = context[tokens] == _OBJECT
    keys = tokens[field] - 2
    coded = _spans(data, at[keys] + 1, end[keys] - 1).dictionary_encode()
    raw = coded.dictionary.to_pylist()
    names: dict[str, int] = {}
    known = [names.setdefault(n, len(names)) for n in (json.loads(f'"{r}"') if "\\" in r else r for r in raw)]
    name = np.full(len(tokens), -1)
    name[field] = np.array(known, dtype=np.int64)[coded.indices.to_numpy()] if len(keys) else 0
    again = np.flatnonzero(field)
    same = up[again] * max(1, len(names)) + name[again]
    order = np.argsort(same, kind="stable")
    hidden = again[order[:-1][same[order[1:]] == same[order[:-1]]]]
    levels = _by_level(level[tokens])
    if len(hidden):
        gone = np.zeros(len(tokens), bool)
        gone[hidden] = True
        for here in levels[1:]:
            gone[here] |= gone[up[here]]
        stay = np.flatnonzero(~gone)
        number = np.full(len(tokens) + 1, -1)
        number[stay] = np.arange(len(stay))
        tokens, up, name = tokens[stay], number[up[stay]], name[stay]
        levels = _by_level(level[tokens])

    # Places in arrays, and paths.
    position = np.full(len(tokens), -1)
    elements = np.flatnonzero((name < 0) & (up >= 0))
    order = np.argsort(up[elements], kind="stable")
    new = _starts(up[elements][order])
    position[elements[order]] = np.arange(len(order)) - (np.flatnonzero(new)[np.cumsum(new) - 1] if len(order) else 0)
    path, paths = np.zeros(len(tokens), np.int64), [(-1, -1)]
    for here in levels[1:]:
        k = len(names) + 1
        distinct, which = np.unique(path[up[here]] * k + name[here] + 1, return_inverse=True)
        path[here] = len(paths) + which
        paths += [(int(x // k), int(x % k) - 1) for x in distinct]
    return Triples(data, slashes, record[tokens], code[tokens], at[tokens], whole[tokens], up, position, name, path, levels, names, paths)


def _chunks(bodies: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(rows, their bodies) of texts that aren't null, as many at once as CHUNK allows; strings that hold JSON are unwrapped."""
    rows = np.flatnonzero(pc.is_valid(bodies).to_numpy(zero_copy_only=False))
    bodies = bodies.take(pa.array(rows))
    wrapped = pc.match_substring_regex(bodies, r'^[ \t\r\n]*"')
    if pc.any(wrapped).as_py():
        inner = pa.array([_unwrapped(x) for x in bodies.filter(wrapped).to_pylist()], pa.string())
        bodies = pc.replace_with_mask(bodies, wrapped, inner)
    size = np.cumsum(pc.binary_length(bodies).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK, "right")))
        yield rows[at:to], bodies.slice(at, to - at)
        at = to


def _ordinals(t: Triples) -> pa.Array:
    """The positions in the arrays on the way to each triple."""
    out: list[tuple[int, ...]] = [()] * len(t.kind)
    for at in t.levels[1:]:
        for i, up, place in zip(at.tolist(), t.parent[at].tolist(), t.position[at].tolist(), strict=True):
            out[i] = out[up] if place < 0 else (*out[up], place)
    return pa.array(out, pa.list_(pa.int32()))


def path_triples(df: DataFrame, body: str, keep: list[str]) -> DataFrame:
    """The triples of every record with its columns ``keep``: (path, ordinals, kind, value). Path: names joined by dots (those with dots,
    brackets or quotes as JSON strings), [] for an array element; ordinals: the positions from 0 in the arrays on the way."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, bodies in _chunks(batch.column(len(keep))):
                t = triples(bodies)
                lead = {ord("t"): "boolean", ord("f"): "boolean", ord("n"): "null"}
                kinds = [{_OBJECT: "object", _ARRAY: "array", _STRING: "string"}.get(k) or lead.get(c, "number") for k, c in zip(t.kind.tolist(), t.data[t.start].tolist(), strict=True)]
                text = pc.if_else(pa.array(t.scalars()), t.texts(np.arange(len(t.kind))), pa.scalar(None, pa.string()))
                out = [batch.column(k).take(pa.array(rows[t.record])) for k in range(len(keep))]
                out += [pa.array(t.path_texts(), pa.string()).take(pa.array(t.path)), _ordinals(t), pa.array(kinds, pa.string()), text]
                yield pa.RecordBatch.from_arrays(out, names=[*keep, "path", "ordinals", "kind", "value"])

    kept = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{body}`").cast("string").alias("__body"))
    fields = ", ".join(f"`{c}` {t}" for c, t in kept.drop("__body").dtypes)
    return kept.mapInArrow(read, f"{fields}, {TRIPLES}" if fields else TRIPLES)


@dataclass(frozen=True)
class Table:
    """A table to make: the objects held by a field ``held_by``, as an array element or directly, or, without that, the objects that have
    all of the names ``having``, unless held by a field of ``but_not``.

    key: ``id`` takes the object's field of that name as the row's key, None its position in the array as written.
    parents: tables whose rows may be the parent; the nearest row around counts. None: the record itself is the parent.
    columns: paths of scalars below the object, as ``fields.status.name``, that ``table_of`` makes columns of.
    """

    name: str
    held_by: str | None = None
    having: tuple[str, ...] = ()
    but_not: tuple[str, ...] = ()
    key: str | None = "id"
    parents: tuple[str, ...] | None = ()
    columns: tuple[str, ...] = ()


#: Table of the values of a record that stand in no other row, and column of a value that is a row by itself.
RECORD, ITSELF = "record", "$"


def _held(t: Triples) -> np.ndarray:
    """The name of the field that holds each triple, as an element or directly; an array within an array is held by none. -1: none."""
    out = np.full(len(t.paths), -1)
    for i, (parent, name) in enumerate(t.paths):
        # Of an element the array's own name, which is -1 if that is an element too.
        out[i] = name if name >= 0 or parent < 0 else t.paths[parent][1]
    return out[t.path]


def pivot(t: Triples, records: pa.Array, tables: tuple[Table, ...], columns: bool = True, whole: bool = True) -> tuple[np.ndarray, list[pa.Array]]:
    """(number of the record of each row, [table, parent key, key, position, columns, row, parent row]) of the rows of some records.

    Triples are grouped by their repeated ancestor, and every scalar stands at its path in the row of that. Rows are the objects of the
    tables; every other array element that is no array, in a table named by the row that encloses it and the path from there
    (``issue.fields.labels[]``; a scalar stands in the column ITSELF, the key is the positions from that row on); and the record for what is
    left, unless it is such an object itself. An object of two tables has a row with the same columns in each. records: their own keys.
    """
    n, objects, held, code = len(t.kind), t.kind == _OBJECT, _held(t), lambda name: t.names.get(name, -9)
    members = []
    for table in tables:
        hit = objects & (held == code(table.held_by)) if table.held_by is not None else objects.copy()
        for name in table.having:
            hit &= t.has(name)
        for name in table.but_not:
            hit &= held != code(name)
        members.append(hit)
    named = np.logical_or.reduce(members) if members else np.zeros(n, bool)
    roots = (t.parent < 0) & ~named
    others = (t.position >= 0) & (t.kind != _ARRAY) & ~named
    above = lambda mark: np.where(t.parent >= 0, t.up(mark)[t.parent], -1) if n else t.parent
    owner = above(named | roots | others)

    # Rows: of each table, of the records, and of the other elements, whose tables are numbered from len(tables) + 1 on.
    groups = [np.flatnonzero(m) for m in members] + [np.flatnonzero(roots), np.flatnonzero(others)]
    node = np.concatenate(groups)
    table = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    # Tables found by the holding field come before those found by what an object has.
    rank = np.array([i if x.held_by is not None else len(tables) + i for i, x in enumerate(tables)] + [0, 0])
    order = np.lexsort((rank[table], node))
    keys = [t.texts(c).take(pa.array(np.arange(len(c)), mask=miss)) if len(c) else pa.array([], pa.string()) for g, x in zip(groups, tables, strict=False) if x.key is not None for c, miss in [_own_keys(t, g, x.key)]]
    parts = [keys.pop(0) if x.key is not None else _digits(np.maximum(t.position[g], 0)) for g, x in zip(groups, tables, strict=False)]
    parts += [records.take(pa.array(t.record[groups[-2]])), _chained(t, groups[-1])]
    key = pa.concat_arrays(parts).take(pa.array(order))
    node, table = node[order], table[order]
    row_of = lambda mark: _last(n, node, mark)
    every = row_of(np.ones(len(node), bool))

    parent = np.full(len(node), -1)  # row
    for i, x in enumerate(tables):
        if x.parents:
            among = np.isin(table, [k for k, y in enumerate(tables) if y.name in x.parents])
            of = row_of(among)
            near = above(of >= 0)[node[table == i]]
            parent[table == i] = np.where(near >= 0, of[near], -1)
    extra = table == len(tables) + 1
    parent[extra] = every[owner[node[extra]]]
    from_record = np.isin(table, [i for i, x in enumerate(tables) if x.parents is None])
    parent_key = pc.if_else(pa.array(from_record), records.take(pa.array(t.record[node])), key.take(pa.array(parent, mask=parent < 0)))

    labels = [x.name for x in tables] + [RECORD]
    texts = t.path_texts()
    if extra.any():
        home = above(named | roots)[node[extra]]
        mixed = np.stack([t.path[node[extra]], t.path[home], table[every[home]]], axis=1)
        distinct, which = np.unique(mixed, axis=0, return_inverse=True)
        table[extra] = len(labels) + which.ravel()
        labels += [labels[c] + texts[a][len(texts[b]) :] for a, b, c in distinct.tolist()]
    shown = np.flatnonzero(~roots[node] & ~others[node]) if not whole else np.arange(len(node))
    take = pa.array(shown)
    out = [pa.array(labels, pa.string()).take(pa.array(table[shown])), parent_key.take(take), key.take(take), pa.array(np.maximum(t.position[node[shown]], 0), pa.int32())]
    if columns:
        out.append(_maps(t, texts, owner, others | roots, node, shown))
    if whole:
        first = np.flatnonzero(t.parent < 0)
        start = np.zeros(len(records), np.int64)
        start[t.record[first]] = first
        count = node - start[t.record[node]]
        out += [pa.array(count[shown], pa.int32()), pa.array(np.where(parent >= 0, count[parent], 0)[shown], pa.int32(), mask=(parent < 0)[shown])]
    return t.record[node[shown]], out


def _own_keys(t: Triples, at: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
    child = t.child(name)[at]
    return np.where(child < 0, at, child) if not (child < 0).all() else at, child < 0


def _digits(numbers: np.ndarray) -> pa.Array:
    return pc.cast(pa.array(numbers, pa.int64()), pa.string())


def _chained(t: Triples, at: np.ndarray) -> pa.Array:
    """The keys of other elements: their position, after those of the arrays in arrays that hold them."""
    key = _digits(t.position[at])
    deep = np.flatnonzero(t.position[t.parent[at]] >= 0) if len(at) else at
    if not len(deep):
        return key
    whole = key.to_pylist()
    for i in deep.tolist():
        up = int(t.parent[at[i]])
        while t.kind[up] == _ARRAY and t.position[up] >= 0:
            whole[i] = f"{t.position[up]}.{whole[i]}"
            up = int(t.parent[up])
    return pa.array(whole, pa.string())


def _last(n: int, node: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """The last of the marked rows of each triple, or -1. Rows are sorted."""
    out = np.full(n, -1)
    out[node[mark]] = np.flatnonzero(mark)
    return out


def _maps(t: Triples, texts: list[str], owner: np.ndarray, alone: np.ndarray, node: np.ndarray, shown: np.ndarray) -> pa.Array:
    """For each shown row the map from the path below it to the value, of the scalars that belong to it."""
    scalar = np.flatnonzero(t.scalars())
    itself = alone[scalar] & ((t.position[scalar] >= 0) | (t.parent[scalar] < 0))
    holder = np.where(itself, scalar, owner[scalar])
    # The rows of a triple stand side by side.
    rows = np.full(len(node), -1)
    rows[shown] = np.arange(len(shown))
    low, high = np.searchsorted(node, holder, "left"), np.searchsorted(node, holder, "right")
    entry = np.repeat(np.arange(len(scalar)), high - low)
    row = rows[np.arange(len(entry)) - np.repeat(np.cumsum(high - low) - high, high - low)]
    entry, row = entry[row >= 0], row[row >= 0]
    order = np.argsort(row, kind="stable")
    entry, row = entry[order], row[order]
    pairs = np.where(itself, 0, 1 + t.path[scalar] * len(t.paths) + t.path[holder])[entry]
    distinct, which = np.unique(pairs, return_inverse=True)
    labels = [ITSELF if x == 0 else texts[(x - 1) // len(t.paths)][len(texts[(x - 1) % len(t.paths)]) + 1 :] for x in distinct.tolist()]
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(shown)))]).astype(np.int32)
    return pa.MapArray.from_arrays(pa.array(ends), pa.array(labels, pa.string()).take(pa.array(which)), t.texts(scalar[entry]))


def flat_tables(df: DataFrame, body: str, record: str, keep: list[str], tables: tuple[Table, ...], columns: bool = True, whole: bool = False) -> DataFrame:
    """The rows of all tables: (keep..., table, parent_key, row_key, position, columns map<string,string>), with every scalar below a row and
    outside other rows at its path in the map.

    record: column with the record's own key, the parent of rows whose table has parents None. Without ``columns`` only the links.
    whole: also the rows of ``pivot`` outside the tables, so that every scalar of a record has a place; and row, parent_row: numbers
    of the row and its parent within the record, which link rows without keys too.
    """
    if whole and not columns:
        raise ValueError("the whole record needs the columns")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, bodies in _chunks(batch.column(len(keep))):
                records = batch.column(len(keep) + 1).take(pa.array(rows))
                at, made = pivot(triples(bodies), records, tables, columns, whole)
                out = [batch.column(k).take(pa.array(rows[at])) for k in range(len(keep))] + made
                yield pa.RecordBatch.from_arrays(out, names=[*keep, "table", "parent_key", "row_key", "position", *["columns"] * columns, *["row", "parent_row"] * whole])

    kept = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{body}`").cast("string").alias("__body"), F.col(f"`{record}`").cast("string").alias("__record"))
    fields = "".join(f"`{c}` {t}, " for c, t in kept.drop("__body", "__record").dtypes)
    return kept.mapInArrow(read, f"{fields}table string, parent_key string, row_key string, position int" + ", columns map<string,string>" * columns + ", row int, parent_row int" * whole)


def table_of(rows: DataFrame, table: Table, keep: list[str]) -> DataFrame:
    """One table of ``flat_tables`` with a column for each of its paths (dots become underscores)."""
    picked = [F.col("columns")[c].alias(c.replace(".", "_")) for c in table.columns]
    return rows.where(F.col("table") == table.name).select(*keep, "parent_key", "row_key", "position", *picked)
