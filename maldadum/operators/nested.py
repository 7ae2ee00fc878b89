"""Deeply nested JSON texts to linked flat tables, by vectorised structural indexing.

The bytes of many documents are indexed at once with numpy: bitmaps of escapes, quotes, brackets and delimiters, string
regions as the parity of a prefix sum over quotes, nesting depth as a prefix sum over brackets. A stable sort of the
delimiters by depth lines up every container's own delimiters one after the other; neighbours in that order bound the
container's spans. Levels are then followed as joins of sorted integer arrays, without a per-document parser.

Defined results: a null, empty, truncated or otherwise malformed document gives no rows; a leading byte-order mark is
skipped; of repeated object keys the last counts; a missing or null level ends the descent without losing its parents; a
null element of a list keeps its position; a single object where a list is usual counts as a list of one. Documents of
any length are taken whole. The key column is passed through as it is, so repeated or null keys are kept.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Bytes of text indexed together; a longer document is indexed on its own.
CHUNK_BYTES = 4 << 20
_SCALAR = re.compile(rb"true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_HEXADECIMAL, _ESCAPED = np.zeros(256, bool), np.zeros(256, bool)
_HEXADECIMAL[list(b"0123456789abcdefABCDEF")] = True
_ESCAPED[list(b'"\\/bfnrtu')] = True
_OPEN_OBJECT, _CLOSE_OBJECT, _OPEN_LIST, _CLOSE_LIST, _COLON, _COMMA, _QUOTE = b'{}[]:,"'


@dataclass
class Spans:
    """Values of containers: parallel arrays, ordered by container and position."""

    parent: np.ndarray  # container that holds the value
    ordinal: np.ndarray  # position in a list, or of the member in an object
    start: np.ndarray
    end: np.ndarray
    child: np.ndarray  # container that the value is, or -1
    key_start: np.ndarray  # 0 in lists
    key_end: np.ndarray


@dataclass
class StructuralIndex:
    """Containers and values of all well-formed documents in ``text[starts[i]:ends[i]]``."""

    text: bytes
    starts: np.ndarray
    ends: np.ndarray
    root: np.ndarray = field(init=False)  # container of each document, -1 if it has none
    is_object: np.ndarray = field(init=False)
    values: Spans = field(init=False)
    first_value: np.ndarray = field(init=False)  # by container: its values are first_value[c] .. first_value[c + 1]

    def __post_init__(self) -> None:
        b = np.frombuffer(self.text, np.uint8)
        n_docs = len(self.starts)
        starts, ends = self.starts.astype(np.int64), self.ends.astype(np.int64)
        bad = ends <= starts
        size = len(b)
        owner = np.zeros(size + 1, np.int32)
        np.add.at(owner, starts, 1)
        owner = np.cumsum(owner, dtype=np.int32)[:size] - 1  # document of each byte; a gap belongs to the one before

        def blame(positions: np.ndarray) -> None:
            if len(positions):
                bad[owner[positions]] = True

        # escapes: in each run of backslashes every other one, from the first, escapes what follows
        slash = np.flatnonzero(b == 92)
        escaped = np.zeros(size + 1, bool)
        if len(slash):
            fresh = np.ones(len(slash), bool)
            fresh[1:] = (np.diff(slash) != 1) | (owner[slash[1:]] != owner[slash[:-1]])
            run = np.maximum.accumulate(np.where(fresh, slash, 0))
            lead = slash[(slash - run) % 2 == 0]
            escaped[lead + 1] = True
            self._escapes = lead
        else:
            lead = self._escapes = slash
        quote = (b == _QUOTE) & ~escaped[:size]
        count = np.zeros(size + 1, np.int32)
        np.cumsum(quote, out=count[1:], dtype=np.int32)
        bad |= ((count[ends] - count[starts]) % 2).astype(bool)
        inside = ((count[1:] - count[starts][owner] if n_docs else count[1:]) % 2).astype(bool)  # an opening quote is inside
        # what a string may not hold
        blame(np.flatnonzero(inside & (b < 32)))
        if len(lead):
            blame(lead[~inside[lead]])
            nxt = b[np.minimum(lead + 1, size - 1)]
            blame(lead[(lead + 1 >= ends[owner[lead]]) | ~_ESCAPED[nxt]])
            u = lead[nxt == ord("u")]
            blame(u[u + 6 > ends[owner[u]]])
            for place in range(2, 6):
                blame(u[~_HEXADECIMAL[b[np.minimum(u + place, size - 1)]]])
        in_doc = np.zeros(size + 1, np.int32)
        np.add.at(in_doc, starts, 1)
        np.add.at(in_doc, ends, -1)
        in_doc = np.cumsum(in_doc, dtype=np.int32)[:size] > 0
        opener = ((b == _OPEN_OBJECT) | (b == _OPEN_LIST)) & ~inside & in_doc
        closer = ((b == _CLOSE_OBJECT) | (b == _CLOSE_LIST)) & ~inside & in_doc
        mark = opener | closer | (((b == _COLON) | (b == _COMMA)) & ~inside & in_doc)
        s = np.flatnonzero(mark)
        step = opener[s].astype(np.int32) - closer[s].astype(np.int32)
        total = np.cumsum(step, dtype=np.int32)
        # prefix sums that end above or dip under their document's base
        first = np.searchsorted(s, starts)
        last = np.searchsorted(s, ends)
        base = np.concatenate([[0], total])[first]
        bad |= np.concatenate([[0], total])[last] != base
        depth = total - base[owner[s]] if len(s) else total
        blame(s[depth < 0])
        ok = ~bad[owner[s]] if len(s) else np.zeros(0, bool)
        s, step, depth = s[ok], step[ok], depth[ok]
        level = depth + (step < 0)  # depth inside the container that the mark belongs to
        blame(s[level < 1])
        # each container's own marks, one after the other
        order = np.argsort(level, kind="stable")
        p = s[order]
        kind = b[p]
        is_open = (kind == _OPEN_OBJECT) | (kind == _OPEN_LIST)
        is_close = (kind == _CLOSE_OBJECT) | (kind == _CLOSE_LIST)
        container = np.cumsum(is_open) - 1
        opens, closes = p[is_open], p[is_close]
        if len(opens) == len(closes):
            blame(opens[b[opens] + 2 != b[closes]])  # { and }, [ and ] are two apart
        self.is_object = b[opens] == _OPEN_OBJECT
        plain = np.flatnonzero((b != 32) & (b != 9) & (b != 10) & (b != 13))
        left, right = np.flatnonzero(~is_close), np.flatnonzero(~is_close) + 1
        left, right = left[right < len(p)], right[right < len(p)]
        at = np.searchsorted(plain, p[left] + 1)
        start = plain[np.minimum(at, max(len(plain) - 1, 0))] if len(plain) else at
        end = plain[np.searchsorted(plain, p[right]) - 1] + 1 if len(plain) else at
        empty = start >= p[right]
        holder = container[left]
        in_object = self.is_object[holder] if len(holder) else np.zeros(0, bool)
        lone = is_open[left] & is_close[right]
        blame(p[left][empty & ~lone])
        is_key = in_object & (kind[left] != _COLON)
        # objects alternate key and value, lists have no colon
        blame(p[left][is_key & ~empty & (kind[right] != _COLON)])
        blame(p[left][in_object & ~is_key & (kind[right] == _COLON)])
        blame(p[left][~in_object & (kind[left] == _COLON) | ~in_object & (kind[right] == _COLON)])
        keep = ~empty
        left, right, start, end, holder, is_key = left[keep], right[keep], start[keep], end[keep], holder[keep], is_key[keep]
        head = b[start]
        is_text, is_box = head == _QUOTE, (head == _OPEN_OBJECT) | (head == _OPEN_LIST)
        blame(start[is_key & ~is_text])
        blame(start[is_text & ((count[end] - count[start] != 2) | ~quote[end - 1])])
        by_position = np.argsort(opens, kind="stable")
        child = np.full(len(start), -1, np.int64)
        if len(opens):
            where = np.minimum(np.searchsorted(opens[by_position], start[is_box]), len(opens) - 1)
            child[is_box] = by_position[where]
            if len(opens) == len(closes):
                blame(start[is_box][closes[child[is_box]] + 1 != end[is_box]])
        other = np.flatnonzero(~is_text & ~is_box)
        known: dict[bytes, bool] = {}
        for i, lo, hi in zip(other.tolist(), start[other].tolist(), end[other].tolist()):
            token = self.text[lo:hi]
            good = known.get(token)
            if good is None:
                good = known[token] = _SCALAR.fullmatch(token) is not None
            if not good:
                bad[owner[lo]] = True
        # one container per document, with nothing around it
        self.root = np.full(n_docs, -1, np.int64)
        if len(opens):
            outer = np.flatnonzero(level[order][is_open] == 1)
            docs = owner[opens[outer]]
            many = np.bincount(docs, minlength=n_docs) > 1
            bad |= many
            self.root[docs] = outer
            lo = plain[np.minimum(np.searchsorted(plain, starts), len(plain) - 1)]
            hi = plain[np.maximum(np.searchsorted(plain, ends) - 1, 0)]
            has = self.root >= 0
            odd = np.zeros(n_docs, bool)
            odd[has] = (opens[self.root[has]] != lo[has]) | (closes[self.root[has]] != hi[has]) if len(opens) == len(closes) else True
            bad |= odd
        self.root[bad] = -1
        self.readable = ~bad
        value = ~is_key
        key_at = np.flatnonzero(value) - 1  # in an object the span before a value is its key
        v_parent = holder[value]
        v_object = self.is_object[v_parent] if len(v_parent) else np.zeros(0, bool)
        key_at = np.where(v_object, key_at, 0)
        begins = np.searchsorted(v_parent, np.arange(len(opens) + 1))
        self.first_value = begins
        self.values = Spans(
            parent=v_parent,
            ordinal=np.arange(len(v_parent)) - begins[v_parent],
            start=start[value],
            end=end[value],
            child=child[value],
            key_start=np.where(v_object, start[key_at] if len(start) else 0, 0),
            key_end=np.where(v_object, end[key_at] if len(end) else 0, 0),
        )
        self._bytes = b

    def _plain_key(self, i: int) -> str:
        return json.loads(self.text[int(self.values.key_start[i]) : int(self.values.key_end[i])])

    def spans(self, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
        """The bytes ``lo[i]:hi[i]`` as strings, gathered in one step."""
        size = hi - lo
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(ends[-1]) + np.repeat(lo - ends[:-1], size)
        return pa.Array.from_buffers(pa.large_string(), len(lo), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(self._bytes[at]))]).cast(pa.string())

    def literals(self, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
        """Scalars written in ``lo[i]:hi[i]`` as text: strings without quotes and escapes, null as null, anything else as it stands."""
        quoted = self._bytes[lo] == _QUOTE if len(lo) else np.zeros(0, bool)
        out = self.spans(lo + quoted, hi - quoted)
        if len(self._escapes):
            coded = quoted & (np.searchsorted(self._escapes, hi) > np.searchsorted(self._escapes, lo))
            if coded.any():
                said = [json.loads(self.text[x:y]) for x, y in zip(lo[coded].tolist(), hi[coded].tolist())]
                out = pc.replace_with_mask(out, pa.array(coded), pa.array(said, pa.string()))
        null = ~quoted & (self._bytes[lo] == ord("n")) if len(lo) else quoted
        return pc.if_else(pa.array(null), pa.scalar(None, pa.string()), out) if null.any() else out

    def keys(self, values: np.ndarray) -> pa.Array:
        return self.literals(self.values.key_start[values], self.values.key_end[values])

    def last_of_key(self, source: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Which of the members ``values`` of objects ``source`` are the last under their key."""
        if not len(values):
            return np.zeros(0, np.int64)
        code = self.keys(values).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        _, first = np.unique((source * (code.max() + 1) + code)[::-1], return_index=True)
        return np.sort(len(values) - 1 - first)

    def members(self, containers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``containers``, value) of all values of the given containers, in order."""
        n = np.where(containers >= 0, self.first_value[containers + 1] - self.first_value[containers], 0)
        source = np.repeat(np.arange(len(containers)), n)
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return source, self.first_value[containers][source] + offset

    def get(self, containers: np.ndarray, key: str) -> np.ndarray:
        """For each container the value under ``key``, the last one if repeated; -1 where there is none or it is no object."""
        objects = np.where((containers >= 0) & self.is_object[containers], containers, -1) if len(self.is_object) else np.full(len(containers), -1)
        source, value = self.members(objects)
        out = np.full(len(containers), -1, np.int64)
        if not len(value):
            return out
        name = np.frombuffer(key.encode("utf-8"), np.uint8)
        lo, hi = self.values.key_start[value], self.values.key_end[value]
        hit = hi - lo == len(name) + 2
        for i, byte in enumerate(name):
            hit[hit] = self._bytes[lo[hit] + 1 + i] == byte
        if len(self._escapes):
            coded = np.flatnonzero(np.searchsorted(self._escapes, hi) > np.searchsorted(self._escapes, lo))
            for i in coded.tolist():
                hit[i] = self._plain_key(int(value[i])) == key
        out[source[hit]] = value[hit]  # in order, so the last one stays
        return out

    def box(self, values: np.ndarray) -> np.ndarray:
        """The container that each value is, -1 for scalars and absent values."""
        return np.where(values >= 0, self.values.child[values], -1) if len(self.values.child) else np.full(len(values), -1)

    def texts(self, values: np.ndarray) -> pa.Array:
        """Scalars as text; absent, null and container values as null."""
        use = (values >= 0) & (self.box(values) < 0)
        found = values[use]
        said = self.literals(self.values.start[found], self.values.end[found])
        place = np.cumsum(use) - 1
        return said.take(pa.array(place, pa.int64(), mask=~use))

    def elements(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into ``values``, position, element) of lists; a lone object is a list of one."""
        boxes = self.box(values)
        is_list = (boxes >= 0) & ~self.is_object[boxes] if len(self.is_object) else boxes >= 0
        source, value = self.members(np.where(is_list, boxes, -1))
        single = np.flatnonzero((boxes >= 0) & ~is_list)
        all_source = np.concatenate([source, single])
        all_value = np.concatenate([value, values[single]])
        all_pos = np.concatenate([self.values.ordinal[value] if len(value) else value, np.zeros(len(single), np.int64)])
        order = np.lexsort((all_pos, all_source))
        return all_source[order], all_pos[order], all_value[order]


@dataclass(frozen=True)
class Level:
    """A repeated level: where its list is in an element of the parent level, and its scalar fields by path."""

    name: str
    path: tuple[str, ...]
    fields: tuple[tuple[str, tuple[str, ...]], ...]


def _descend(index: StructuralIndex, boxes: np.ndarray, path: tuple[str, ...]) -> np.ndarray:
    for key in path[:-1]:
        boxes = index.box(index.get(boxes, key))
    return index.get(boxes, path[-1])


def _union_rows(index: StructuralIndex, values: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array, pa.Array]:
    """(element, kind, key, value) of a field of several shapes, as arrays.

    A list gives ('tags', entry) per entry that is not null, an object ('counts', 'outer.inner') per inner key, a scalar
    ('raw', text). An outer key without an inner object gives ('counts', 'outer'), but for an empty or null one. Where nothing
    comes out, as for absent, null and empty values, one row ('none', '') stands for the element."""
    v, boxes = index.values, index.box(values)
    is_object = np.zeros(len(values), bool)
    is_object[boxes >= 0] = index.is_object[boxes[boxes >= 0]]
    parts: list[tuple[np.ndarray, str, pa.Array, pa.Array | None]] = []

    raw = np.flatnonzero((values >= 0) & (boxes < 0))
    said = index.literals(v.start[values[raw]], v.end[values[raw]])
    some = np.flatnonzero(pc.fill_null(pc.greater(pc.utf8_length(said), 0), False).to_numpy(zero_copy_only=False))
    parts.append((raw[some], "raw", said.take(pa.array(some)), None))

    source, entry = index.members(np.where(is_object, -1, boxes))
    box = v.child[entry] >= 0
    said = pc.if_else(pa.array(box), index.spans(v.start[entry], v.end[entry]), index.literals(v.start[entry], v.end[entry]))
    some = np.flatnonzero(said.is_valid().to_numpy(zero_copy_only=False))
    parts.append((source[some], "tags", said.take(pa.array(some)), None))

    source, outer = index.members(np.where(is_object, boxes, -1))
    last = index.last_of_key(source, outer)
    source, outer = source[last], outer[last]
    names = index.keys(outer)
    inner = v.child[outer]
    nested = np.zeros(len(outer), bool)
    nested[inner >= 0] = index.is_object[inner[inner >= 0]]
    of, leaf = index.members(np.where(nested, inner, -1))
    last = index.last_of_key(of, leaf)
    of, leaf = of[last], leaf[last]
    joined = pc.binary_join_element_wise(names.take(pa.array(of)), index.keys(leaf), ".")
    parts.append((source[of], "counts", joined, pc.utf8_trim(index.spans(v.start[leaf], v.end[leaf]), '"')))
    plain = np.flatnonzero(~nested)
    whole = index.spans(v.start[outer[plain]], v.end[outer[plain]])
    some = np.flatnonzero(~pc.is_in(whole, pa.array(["null", '""', "[]"])).to_numpy(zero_copy_only=False))
    parts.append((source[plain[some]], "counts", names.take(pa.array(plain[some])), whole.take(pa.array(some))))

    seen = np.zeros(len(values), bool)
    for element, *_ in parts:
        seen[element] = True
    none = np.flatnonzero(~seen)
    parts.append((none, "none", pa.array([""] * len(none), pa.string()), None))
    element = np.concatenate([p[0] for p in parts])
    kind = pa.concat_arrays([pa.repeat(pa.scalar(p[1]), len(p[0])) for p in parts])
    value = pa.concat_arrays([pa.nulls(len(p[0]), pa.string()) if p[3] is None else p[3] for p in parts])
    order = pa.array(np.argsort(element, kind="stable"))
    return element[order.to_numpy()], kind.take(order), pa.concat_arrays([p[2] for p in parts]).take(order), value.take(order)


def _chunks(column: pa.Array) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, int]]:
    """(bytes, starts, ends, first row) of runs of rows of at most CHUNK_BYTES; null rows are empty."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        lo, hi = int(offsets[row]), int(offsets[stop])
        text = data.slice(lo, hi - lo).to_pybytes() if data is not None and hi > lo else b""
        starts, ends = offsets[row:stop] - lo, offsets[row + 1 : stop + 1] - lo
        marked = np.array([text[a : a + 3] == b"\xef\xbb\xbf" and z - a >= 3 for a, z in zip(starts.tolist(), ends.tolist())], bool)
        yield text, starts + 3 * marked, ends, row
        row = stop


def shred(df: DataFrame, key: str, payload: str, levels: tuple[Level, ...], level: str, union: tuple[str, tuple[str, ...]] | None = None) -> DataFrame:
    """One level of the nested texts in ``payload`` as a flat table.

    :param levels: from the outermost list inwards; columns are ``key``, one ``<name>_pos`` (BIGINT, 0-based) per level down to
        the wanted one, then that level's fields as STRING.
    :param level: name of the wanted level, or of ``union``.
    :param union: (name, path) of a field of the innermost level that has several shapes; its table has ``leaf_kind``,
        ``leaf_key`` and ``leaf_value`` STRING, one row per entry (see ``_union_rows``).

    The parent of a row is the row of the level above with the same key and positions. One pass over the input, no shuffle.
    Columns of ``df`` other than ``key`` and ``payload`` are not read."""
    names = [x.name for x in levels]
    wanted_union = union is not None and level == union[0]
    depth = len(levels) if wanted_union else names.index(level) + 1
    used = levels[:depth]
    key_type = df.schema[key].dataType.simpleString()
    columns = ["leaf_kind", "leaf_key", "leaf_value"] if wanted_union else [name for name, _ in used[-1].fields]
    schema = f"`{key}` {key_type}, " + ", ".join(f"{x.name}_pos BIGINT" for x in used) + "".join(f", `{c}` STRING" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for text, starts, ends, row in _chunks(batch.column(1)):
                index = StructuralIndex(text, starts, ends)
                docs = np.arange(len(starts))
                boxes = index.root
                positions: list[np.ndarray] = []
                values = boxes
                for at in used:
                    source, pos, values = index.elements(_descend(index, boxes, at.path)) if len(index.is_object) else (docs[:0],) * 3
                    docs, positions = docs[source], [x[source] for x in positions] + [pos]
                    boxes = index.box(values)
                if wanted_union:
                    real = np.flatnonzero(boxes >= 0)
                    element, *fields = _union_rows(index, _descend(index, boxes[real], union[1])) if len(real) else (real, *[pa.array([], pa.string())] * 3)
                    pick = real[element]
                    docs, positions = docs[pick], [x[pick] for x in positions]
                else:
                    fields = [index.texts(_descend(index, boxes, path)) if len(boxes) and len(index.is_object) else pa.array([], pa.string()) for _, path in used[-1].fields]
                arrays = [keys.take(pa.array(docs + row, pa.int64())), *[pa.array(x, pa.int64()) for x in positions], *fields]
                yield pa.RecordBatch.from_arrays(arrays, names=[key, *[f"{x.name}_pos" for x in used], *columns])

    return df.select(F.col(key), F.col(payload)).mapInArrow(run, schema)


#: Vendor files: a list of items, each with a list of errors, each with details of several shapes.
VENDOR_LEVELS = (
    Level("item", ("data",), tuple((f, ("metadata_info", f)) for f in ("id", "source", "interface", "keyboard", "date", "gender", "age")) + tuple((f, ("annotation", f)) for f in ("reg_date", "err_sentence", "cor_sentence", "err_sentence_spell", "cor_sentence_spell"))),
    Level("err", ("annotation", "errors"), tuple((f, (f,)) for f in ("err_idx", "err_location", "err_text", "cor_text", "edit_distance"))),
)
VENDOR_DETAILS = ("details", ("err_details",))


def vendor_items(files: DataFrame) -> DataFrame:
    return shred(files, "file_id", "payload", VENDOR_LEVELS, "item")


def vendor_errors(files: DataFrame) -> DataFrame:
    return shred(files, "file_id", "payload", VENDOR_LEVELS, "err")


def vendor_details(files: DataFrame) -> DataFrame:
    return shred(files, "file_id", "payload", VENDOR_LEVELS, "details", VENDOR_DETAILS)
