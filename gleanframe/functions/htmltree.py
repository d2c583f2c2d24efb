"""Tokeniser and tree builder for one page.

It follows the recovery rules of the public HTML standard: void and raw-text elements, implied end
tags, reopened formatting elements, implied html/head/body. The tokeniser works on regular expressions.
"""

from __future__ import annotations

import html as entities
import re

# Element classes of the HTML standard.
VOID = frozenset(
    "area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split()
)
RAW = frozenset("iframe noembed noframes noscript plaintext script style textarea title xmp".split())
ESCAPABLE_RAW = frozenset(["textarea", "title"])
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS_CLOSING_P = HEADINGS | frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "header hgroup hr li listing main menu nav ol p plaintext pre search section summary table ul xmp".split()
)
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
TABLE_PARTS = frozenset("caption col colgroup tbody td tfoot th thead tr".split())
SCOPE = frozenset(
    "applet caption desc foreignobject html marquee math object svg table td template th".split()
)
FOREIGN = frozenset(["math", "svg"])
MARKERS = frozenset("applet caption marquee object td template th".split())
MARKED = MARKERS | FOREIGN
SPECIAL = (
    BLOCKS_CLOSING_P
    | VOID
    | RAW
    | HEAD
    | TABLE_PARTS
    | frozenset("applet body button frameset head html marquee object select".split())
)
NOT_REOPENING = BLOCKS_CLOSING_P | HEAD | TABLE_PARTS | frozenset("iframe noembed param source track textarea".split())
# Scopes and limits of the implied end tags, built from the classes above.
BUTTON_SCOPE = SCOPE | {"button"}
P_ONLY = frozenset(["p"])
LIST_SCOPE = SCOPE | {"ol", "ul"}
ITEM_LIMITS = {
    tags: SPECIAL - {"address", "div", "p"} - tags for tags in (frozenset(["li"]), frozenset(["dd", "dt"]))
}
ITEMS = {tag: tags for tags in ITEM_LIMITS for tag in tags}
TABLES = frozenset(["table", "template"])
TABLE_LIMITS = TABLES | {"html"}
CELLS = frozenset(["td", "th"])
ROW_CLOSERS = frozenset(["tr", "caption", "colgroup"])
# Start tags that may close other elements, or be ignored, before they open their own.
ROOM_MAKERS = TABLE_PARTS | frozenset("a button dd dt form image li optgroup option".split())
# Fixed value: the HTML package whose results are matched refuses deeper stacks of open elements (public release notes).
MAX_DEPTH = 512

_TAG = re.compile(r"<(?:(!--)|([!?]|/[^a-zA-Z])|(/?)([a-zA-Z][^\t\n\f\r />]*))")
_ATTR = re.compile(
    r"""[\t\n\f\r /]*([^\t\n\f\r />][^\t\n\f\r />=]*)"""
    r"""(?:[\t\n\f\r ]*=[\t\n\f\r ]*(?:"([^"]*)"|'([^']*)'|([^\t\n\f\r >]*)))?"""
)
_TAG_END = re.compile(r"[\t\n\f\r /]*>")
_COMMENT_END = re.compile(r"--!?>")
_SCRIPT_STEP = re.compile(r"<!--|-->|<(/?)script(?=[\t\n\f\r />])", re.I)
_ATTR_ENTITY = re.compile(r"&(?:#[xX]?[0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*(?:;|(?![=a-zA-Z0-9])))")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\t\n\f\r />])", re.I) for tag in RAW - {"plaintext", "script"}}


class ParseError(ValueError):
    """The page cannot be parsed; the message says why."""


def _unescape(data):
    """Character references decoded; numbers with more digits than Python reads are no character."""
    try:
        return entities.unescape(data)
    except ValueError:
        short = re.sub(r"&#0+(?=[0-9])", "&#", data)
        return entities.unescape(re.sub(r"&#[0-9]{20,};?", "\ufffd", short))


class _Node:
    __slots__ = ("tag", "attrs", "parent", "start", "stop", "end", "children")

    def __init__(self, tag, attrs, parent, start):
        self.tag, self.attrs, self.parent, self.start = tag, attrs, parent, start
        self.stop = self.end = self.children = 0


class _Tree:
    """Nodes in document order; the text of a subtree is one slice of ``parts``."""

    def __init__(self):
        self.nodes, self.parts, self.owners, self.formatting = [], [], [], []
        self.stack, self.tags = [], []  # open nodes, and their tags
        self.head = self.body = None
        self.foreign = 0  # open svg and math elements
        self.push("html", [])

    def push(self, tag, attrs, stays_open=True):
        nodes, stack = self.nodes, self.stack
        idx = len(nodes)
        parent = stack[-1] if stack else -1
        if stack:
            nodes[parent].children += 1
        node = _Node(tag, attrs, parent, len(self.parts))
        nodes.append(node)
        if stays_open:
            stack.append(idx)
            self.tags.append(tag)
            if len(stack) > MAX_DEPTH:
                raise ParseError("open elements nest too deeply")
            if tag in MARKED:
                if tag in MARKERS:
                    self.formatting.append(None)
                else:
                    self.foreign += 1
        else:
            node.stop, node.end = node.start, idx
        return idx

    def pop_to(self, depth):
        nodes, stack, tags = self.nodes, self.stack, self.tags
        stop, end = len(self.parts), len(nodes) - 1
        for _ in range(len(stack) - depth):
            node = nodes[stack.pop()]
            node.stop, node.end = stop, end
            tag = tags.pop()
            if tag in MARKED:
                if tag in MARKERS:
                    while self.formatting and self.formatting.pop() is not None:
                        pass
                else:
                    self.foreign -= 1

    def find(self, tags, limits):
        """Stack position of the nearest open element among tags; -1 if a limit comes first."""
        depth = len(self.tags)
        for tag in reversed(self.tags):
            depth -= 1
            if tag in tags:
                return depth
            if tag in limits:
                return -1
        return -1

    def is_open(self, tag):
        return tag in self.tags

    def close(self, tags, limits):
        depth = self.find(tags, limits)
        if depth >= 0:
            self.pop_to(depth)
        return depth >= 0

    def open_body(self, attrs=()):
        if self.body is None:
            self.pop_to(1)
            self.body = self.push("body", list(attrs))
        else:
            self.add_attrs(self.body, attrs)

    def add_attrs(self, idx, attrs):
        known = {k for k, _ in self.nodes[idx].attrs}
        self.nodes[idx].attrs.extend((k, v) for k, v in attrs if k not in known)

    def reopen_formatting(self):
        pending = self.formatting
        at = len(pending)
        while at and pending[at - 1] is not None and pending[at - 1] not in self.stack:
            at -= 1
        for i in range(at, len(pending)):
            node = self.nodes[pending[i]]
            pending[i] = self.push(node.tag, node.attrs)

    def remember_formatting(self, idx):
        """At most three equal entries are kept, as in the standard."""
        node, equal = self.nodes[idx], []
        for i in range(len(self.formatting) - 1, -1, -1):
            if self.formatting[i] is None:
                break
            other = self.nodes[self.formatting[i]]
            if other.tag == node.tag and sorted(other.attrs) == sorted(node.attrs):
                equal.append(i)
        if len(equal) >= 3:
            del self.formatting[equal[-1]]
        self.formatting.append(idx)

    def text(self, data):
        if self.body is None and not self.is_open("template"):
            if not data.strip("\t\n\f\r "):
                return
            self.open_body()
        if self.formatting:
            self.reopen_formatting()
        self.add_text(_unescape(data) if "&" in data else data)

    def add_text(self, data):
        self.parts.append(data)
        self.owners.append(self.stack[-1])

    def raw(self, tag, data):
        """Content of the raw-text element just opened, which ends here."""
        self.add_text(_unescape(data) if tag in ESCAPABLE_RAW and "&" in data else data)
        self.pop_to(len(self.stack) - 1)

    def start(self, tag, attrs, self_closing):
        """Open an element; False when the tag is ignored."""
        if tag == "html":
            self.add_attrs(0, attrs)
            return False
        if tag == "head":
            if self.head is None and self.body is None:
                self.head = self.push("head", attrs)
            return False
        if tag == "body":
            self.open_body(attrs)
            return False
        if self.body is None and not self.is_open("template"):
            if tag not in HEAD:
                self.open_body()
            elif self.head is None:
                self.head = self.push("head", [])
        if self.foreign:
            self.push(tag, attrs, not self_closing)
            return not self_closing
        if tag in ROOM_MAKERS:
            if tag == "image":
                tag = "img"
            elif not self.make_room(tag):
                return False
        if tag in BLOCKS_CLOSING_P:
            if "p" in self.tags:
                self.close(P_ONLY, BUTTON_SCOPE)
            if tag in HEADINGS and self.tags[-1] in HEADINGS:
                self.pop_to(len(self.stack) - 1)
        elif self.formatting and tag not in NOT_REOPENING:
            self.reopen_formatting()
        idx = self.push(tag, attrs, not (tag in VOID or (self_closing and tag in FOREIGN)))
        if tag in FORMATTING:
            self.remember_formatting(idx)
        return True

    def make_room(self, tag):
        """Close what the start tag implies closed; False when the tag has no place here."""
        if tag in ITEMS:
            self.close(ITEMS[tag], ITEM_LIMITS[ITEMS[tag]])
        elif tag in ("option", "optgroup"):
            self.close(("option",), SPECIAL)
            if tag == "optgroup":
                self.close(("optgroup",), SPECIAL)
        elif tag == "button":
            self.close(("button",), SCOPE)
        elif tag == "form":
            return not self.is_open("form")
        elif tag == "a":
            for i in range(len(self.formatting) - 1, -1, -1):
                if self.formatting[i] is None:
                    break
                if self.nodes[self.formatting[i]].tag == "a":
                    self.end("a")
                    break
        elif tag in TABLE_PARTS:
            table = self.find(TABLES, ())
            if table < 0:
                return False
            if tag in ("td", "th"):
                self.close(CELLS, TABLES)
            elif tag == "tr":
                self.close(ROW_CLOSERS, TABLES)
            else:
                self.pop_to(table + 1)
        return True

    def end(self, tag):
        if tag in ("html", "body"):
            if self.body is None:
                self.open_body()
        elif tag == "br":
            self.start("br", [], False)
        elif tag == "head" or (self.body is None and not self.is_open("template")):
            if tag == "head" and self.body is None:
                self.pop_to(1)
                self.head = 0 if self.head is None else self.head
        elif tag == "p":
            if not self.close(P_ONLY, BUTTON_SCOPE):
                self.push("p", [], False)
        elif tag in FORMATTING:
            self.end_formatting(tag)
        elif tag == "li":
            self.close(("li",), LIST_SCOPE)
        elif tag in HEADINGS:
            self.close(HEADINGS, SCOPE)
        elif tag == "template":
            self.close(("template",), ())
        elif tag == "table" or tag in TABLE_PARTS:
            self.close((tag,), TABLE_LIMITS - {tag})
        elif tag in BLOCKS_CLOSING_P or tag in MARKERS or tag == "button":
            self.close((tag,), SCOPE)
        else:
            self.close((tag,), SPECIAL)

    def end_formatting(self, tag):
        """Close a formatting element; one that holds open blocks stays open but is not reopened later."""
        at = len(self.formatting) - 1
        while at >= 0 and self.formatting[at] is not None and self.nodes[self.formatting[at]].tag != tag:
            at -= 1
        if at < 0 or self.formatting[at] is None:
            self.close((tag,), SPECIAL)
            return
        idx = self.formatting.pop(at)
        if idx in self.stack:
            depth = self.stack.index(idx)
            if SPECIAL.isdisjoint(self.tags[depth + 1 :]):
                self.pop_to(depth)


def _attr_value(value):
    return _ATTR_ENTITY.sub(lambda m: _unescape(m.group()), value) if "&" in value else value


def _read_attrs(src, pos):
    """Attributes from pos on, the position after the tag (None at the end of the input) and whether it closes itself."""
    attrs = []
    while True:
        closing = _TAG_END.match(src, pos)
        if closing:
            return attrs, closing.end(), src[closing.end() - 2] == "/"
        m = _ATTR.match(src, pos)
        if m is None:
            return attrs, None, False
        key, double, single, bare = m.groups()
        if bare and bare[0] in "\"'":
            return attrs, None, False
        value = double if double is not None else single if single is not None else bare or ""
        attrs.append((key.lower(), _attr_value(value)))
        pos = m.end()


def _raw_end(src, tag, pos):
    """Start of the end tag of a raw-text element, or the end of the input."""
    if tag == "plaintext":
        return len(src)
    if tag != "script":
        m = _RAW_END[tag].search(src, pos)
        return m.start() if m else len(src)
    state = 0  # 0 plain, 1 inside <!--, 2 inside <script> inside <!--
    for m in _SCRIPT_STEP.finditer(src, pos):
        step = m.group()
        if step == "<!--":
            state = state or 1
        elif step == "-->":
            state = 0
        elif m.group(1) and state < 2:
            return m.start()
        elif state:
            state = 1 if m.group(1) else 2
    return len(src)


def parse_tree(src):
    """Tree of one page."""
    if "\r" in src:
        src = src.replace("\r\n", "\n").replace("\r", "\n")
    tree, pos, size = _Tree(), 0, len(src)
    search, start_tag, end_tag = _TAG.search, tree.start, tree.end
    while pos < size:
        m = search(src, pos)
        at = m.start() if m else size
        if at > pos:
            tree.text(src[pos:at])
        if m is None:
            break
        comment, bogus, slash, name = m.groups()
        if comment:
            if src.startswith((">", "->"), m.end()):
                pos = src.index(">", m.end()) + 1
            else:
                closing = _COMMENT_END.search(src, m.end())
                pos = closing.end() if closing else size
            continue
        if bogus:
            pos = src.find(">", at + 2) + 1 or size
            continue
        tag, after = name.lower(), m.end()
        if after < size and src[after] == ">":
            attrs, pos, self_closing = [], after + 1, False
        else:
            attrs, pos, self_closing = _read_attrs(src, after)
            if pos is None:
                break
        if slash:
            end_tag(tag)
        elif start_tag(tag, attrs, self_closing) and tag in RAW:
            stop = _raw_end(src, tag, pos)
            tree.raw(tag, src[pos:stop])
            closing = _read_attrs(src, stop + len(tag) + 2)[1] if stop < size else None
            pos = size if closing is None else closing
    if tree.body is None:
        tree.open_body()
    tree.pop_to(0)
    return tree
