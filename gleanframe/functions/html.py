"""HTML bytes to pruned node rows: the only per-page Python in the package.

Each page is parsed once (``htmltree``). Only nodes that one of the wanted selectors matches leave the
worker, and the text that they ask for once, however deeply they nest. Everything after that is Catalyst expressions.

Both modules are pickled by value, so executors need pyarrow but no installed copy of this package.
"""

from __future__ import annotations

import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import WHITE_SPACE
from . import htmltree
from .htmltree import BLOCKS_CLOSING_P, ParseError, parse_tree
from .selectors import NODE, compile_selector

for _module in (sys.modules[__name__], htmltree):
    cloudpickle.register_pickle_by_value(_module)

# Why a page could not be parsed, bytes of its body text, the text that nodes ask for (each byte once, as it came),
# places in nodes of what each selector matches, and the nodes. A node's text is the bytes from start up to stop.
DOC = f"struct<error:string,body_text_bytes:int,text:binary,found:map<string,array<int>>,nodes:array<{NODE}>>"
BLOCKS = "array<struct<tag:string,boilerplate:boolean,text:string,link_chars:int>>"

# How much text a selector wants from the nodes it matches.
NO_TEXT, LEAF_TEXT, FULL_TEXT = 0, 1, 2


def _passes(tests, attrs):
    for name, op, value, fold in tests:
        values = [v.lower() if fold else v for k, v in attrs if k == name]
        if op == "equals":
            hit = value in values
        elif op == "contains":
            hit = value != "" and any(value in v for v in values)
        elif op == "word":
            hit = any(value in re.split(r"[\t\n\f\r ]+", v) for v in values)
        else:
            hit = bool(values)
        if hit == (op == "absent"):
            return False
    return True


def _index(wanted):
    """Compounds of the wanted selectors by tag, or by the first attribute they need."""
    by_tag, by_attr = {}, {}
    for tag, tests, selector in wanted:
        if tag is not None:
            by_tag.setdefault(tag, []).append((tests, selector))
        else:
            names = [t[0] for t in tests if t[1] != "absent"]
            if not names:
                raise ValueError("a selector needs a tag, or an attribute that is there")
            by_attr.setdefault(names[0], []).append((tests, selector))
    return by_tag, by_attr


def _matches(node, by_tag, by_attr):
    """Selectors that match the node."""
    attrs = node.attrs
    hits = {selector for tests, selector in by_tag.get(node.tag, ()) if _passes(tests, attrs)}
    for name, _ in attrs:
        hits.update(selector for tests, selector in by_attr.get(name, ()) if _passes(tests, attrs))
    return hits


def _decoded(body):
    """Text of a page and whether it is clean; bytes that are not UTF-8 stay as they are, each as one mark of its own."""
    try:
        return body.decode("utf-8"), True
    except UnicodeDecodeError:
        return body.decode("utf-8", "surrogateescape"), False


def _bytes(text):
    return text.encode() if text.isascii() else text.encode("utf-8", "surrogateescape")


def _shown(text):
    """Text in which bytes that are not UTF-8 become replacement marks."""
    return _bytes(text).decode("utf-8", "replace")


def _pages(bodies, read):
    """Results of read per page as (error, result); None for NULL pages."""
    for body in bodies.to_pylist():
        if body is None:
            yield None
            continue
        text, clean = _decoded(body)
        try:
            yield None, read(parse_tree(text), clean)
        except ParseError as e:
            yield str(e), None


def _read_nodes(tree, clean, by_tag, by_attr, modes):
    """(text bytes of the body, text that nodes ask for, places by selector, node rows)."""
    body = tree.nodes[tree.body]
    text = "".join(tree.parts[body.start : body.stop]).strip(WHITE_SPACE)
    text_bytes = len(text) if text.isascii() else len(_bytes(text))
    found, rows, asking = {}, [], []
    for idx, node in enumerate(tree.nodes):
        if not node.attrs and node.tag not in by_tag:
            continue
        hits = _matches(node, by_tag, by_attr)
        if hits:
            for selector in hits:
                found.setdefault(selector, []).append(len(rows))
            mode = max(modes[selector] for selector in hits)
            if mode == FULL_TEXT or (mode == LEAF_TEXT and not node.children):
                asking.append(len(rows))
            attrs = node.attrs if clean else [(_shown(k), _shown(v)) for k, v in node.attrs]
            rows.append([idx, node.parent, node.end, node.tag if clean else _shown(node.tag), attrs, node.start, node.stop, node.children])
    # Ranges of the text parts that are asked for, each part once, and where each part lies in what is kept.
    kept, at, size, upto = [], {}, 0, 0
    for k in asking:
        start, stop = rows[k][5:7]
        for part in range(max(start, upto), stop):
            at[part] = size
            kept.append(_bytes(tree.parts[part]))
            size += len(kept[-1])
            at[part + 1] = size
        upto = max(upto, stop)
    wanted = set(asking)
    for k, row in enumerate(rows):
        start, stop = row[5:7]
        row[5:7] = (None, None) if k not in wanted else (at[start], at[stop]) if start < stop else (0, 0)
    return text_bytes, b"".join(kept), found, rows


def _docs_array(docs, doc_type):
    """Arrow array of documents, assembled column by column."""
    missing, errors, text_bytes, texts = [], [], [], []
    node_offsets, attr_offsets, found_offsets, place_offsets = [0], [0], [0], [0]
    columns, keys, values, selectors, places = [[] for _ in range(7)], [], [], [], []
    for doc in docs:
        missing.append(doc is None)
        error, result = doc or (None, None)
        errors.append(error)
        size, text, found, rows = result or (None, None, {}, ())
        text_bytes.append(size)
        texts.append(text)
        for selector, hits in found.items():
            selectors.append(selector)
            places.extend(hits)
            place_offsets.append(len(places))
        found_offsets.append(len(selectors))
        for idx, parent, end, tag, attrs, start, stop, children in rows:
            for column, value in zip(columns, (idx, parent, end, tag, start, stop, children)):
                column.append(value)
            keys.extend(k for k, _ in attrs)
            values.extend(v for _, v in attrs)
            attr_offsets.append(len(keys))
        node_offsets.append(len(columns[0]))
    node_type = doc_type.field("nodes").type.value_type
    attr_type = node_type.field("attrs").type.value_type
    pairs = pa.StructArray.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.string())], fields=list(attr_type))
    idx, parent, end, tag, start, stop, children = columns
    ints = [pa.array(c, pa.int32()) for c in (idx, parent, end, start, stop, children)]
    nodes = pa.StructArray.from_arrays(
        [
            *ints[:3],
            pa.array(tag, pa.string()),
            pa.ListArray.from_arrays(pa.array(attr_offsets, pa.int32()), pairs, type=node_type.field("attrs").type),
            *ints[3:],
        ],
        fields=list(node_type),
    )
    unread = pa.array([t is None for t in texts], pa.bool_())
    offsets = pa.array(node_offsets, pa.int32())
    lists = pa.ListArray.from_arrays(offsets, nodes, type=doc_type.field("nodes").type, mask=unread)
    hits = pa.ListArray.from_arrays(pa.array(place_offsets, pa.int32()), pa.array(places, pa.int32()))
    found = pa.MapArray.from_arrays(pa.array(found_offsets, pa.int32()), pa.array(selectors, pa.string()), hits)
    return pa.StructArray.from_arrays(
        [pa.array(errors, pa.string()), pa.array(text_bytes, pa.int32()), pa.array(texts, pa.binary()), found.cast(doc_type.field("found").type), lists],
        fields=list(doc_type),
        mask=pa.array(missing, pa.bool_()),
    )


_ATTR_TYPE = pa.struct([("k", pa.string()), ("v", pa.string())])
_NODE_TYPE = pa.struct(
    [
        ("idx", pa.int32()),
        ("parent", pa.int32()),
        ("end", pa.int32()),
        ("tag", pa.string()),
        ("attrs", pa.list_(_ATTR_TYPE)),
        ("start", pa.int32()),
        ("stop", pa.int32()),
        ("n_children", pa.int32()),
    ]
)
_DOC_TYPE = pa.struct(
    [
        ("error", pa.string()),
        ("body_text_bytes", pa.int32()),
        ("text", pa.binary()),
        ("found", pa.map_(pa.string(), pa.list_(pa.int32()))),
        ("nodes", pa.list_(_NODE_TYPE)),
    ]
)


def parse_html(body: Column, wanted: dict[str, int]) -> Column:
    """Document struct of a BINARY column, pruned to the wanted selectors ({selector: text mode}).

    NULL bodies give NULL. Pages that cannot be parsed give their error, and NULL nodes.
    """
    by_tag, by_attr = _index([(tag, tests, selector) for selector in wanted for tag, tests in compile_selector(selector)])

    @F.arrow_udf(DOC)
    def parse(bodies: pa.Array) -> pa.Array:
        return _docs_array(_pages(bodies, lambda tree, clean: _read_nodes(tree, clean, by_tag, by_attr, wanted)), _DOC_TYPE)

    return parse(body)


def node_text(node: str, doc: str = "doc") -> str:
    """Text of a node, cut from the page's text; NULL where no selector asked for it."""
    return f"make_valid_utf8(CAST(substring({doc}.text, {node}.start + 1, {node}.stop - {node}.start) AS STRING))"


def nodes_with_text(doc: str = "doc") -> str:
    """All nodes of a document as structs that carry their text."""
    fields = ", ".join(f"'{f}', n.{f}" for f in ("idx", "parent", "end", "tag", "attrs", "n_children"))
    return f"transform({doc}.nodes, n -> named_struct({fields}, 'text', {node_text('n', doc)}))"


# Elements whose text is not part of the article, and tags that start a block of their own.
_BOILERPLATE = frozenset("nav footer aside header form menu button select script style noscript iframe svg".split())
_BLOCK = BLOCKS_CLOSING_P | frozenset("td th caption body".split())


def _read_blocks(tree, clean):
    """Text blocks of the body: each run of text between block boundaries, with its link characters."""
    nodes = tree.nodes
    owner = {}  # node index -> (nearest block, boilerplate, inside a link)
    for idx, node in enumerate(nodes):
        block, junk, link = owner.get(node.parent, (idx, False, False))
        owner[idx] = (idx if node.tag in _BLOCK else block, junk or node.tag in _BOILERPLATE, link or node.tag == "a")
    rows, last = [], None
    for at, idx in enumerate(tree.owners):
        if idx < tree.body:
            continue
        block, junk, link = owner[idx]
        if (block, junk) != last:
            rows.append([nodes[block].tag, junk, [], 0])
            last = (block, junk)
        rows[-1][2].append(tree.parts[at])
        rows[-1][3] += len(tree.parts[at].strip()) if link else 0
    shown = str if clean else _shown
    blocks = ((tag, junk, shown(" ".join("".join(texts).split())), link_chars) for tag, junk, texts, link_chars in rows)
    return [block for block in blocks if block[2]]


def text_blocks(body: Column) -> Column:
    """Text blocks of a BINARY column, for the readable-text heuristic."""

    @F.arrow_udf(BLOCKS)
    def blocks(bodies: pa.Array) -> pa.Array:
        row = pa.struct([("tag", pa.string()), ("boilerplate", pa.bool_()), ("text", pa.string()), ("link_chars", pa.int32())])
        return pa.array([page and page[1] for page in _pages(bodies, _read_blocks)], pa.list_(row))

    return blocks(body)
