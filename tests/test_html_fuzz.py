"""The tree builder on random markup: it never fails, and its tree is sound."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from gleanframe.functions import htmltree as H

TAGS = (
    "a b i p div ul li dl dt dd table tr td th tbody caption colgroup select option optgroup form button h1 h2 svg math path "
    "template script style title textarea noscript iframe head body html br img input meta link span object plaintext image pre frameset"
).split()
PIECES = st.one_of(
    st.sampled_from([f"<{t}>" for t in TAGS] + [f"</{t}>" for t in TAGS]),
    st.sampled_from([f"<{t} class='x' id=y/>" for t in TAGS]),
    st.sampled_from(["<!--", "-->", "<!doctype html>", "<", ">", "</", "<!", "<?", "&amp;", "&#x0;", "&#xD800;", "'", '"', "=", " ", "\x00", "é", "text"]),
    st.text(max_size=4),
)


def check(src):
    tree = H.parse_tree(src)
    nodes = tree.nodes
    assert not tree.stack and not tree.tags and tree.foreign == 0
    children = [0] * len(nodes)
    for idx, n in enumerate(nodes):
        assert n.parent < idx <= n.end < len(nodes)
        assert n.start <= n.stop <= len(tree.parts)
        if idx:
            p = nodes[n.parent]
            children[n.parent] += 1
            assert p.start <= n.start and n.stop <= p.stop and n.end <= p.end
    assert children == [n.children for n in nodes]
    assert len(tree.owners) == len(tree.parts)
    assert nodes[tree.body].tag == "body"
    "".join(tree.parts).encode()


@settings(max_examples=1500, deadline=None)
@given(st.lists(PIECES, max_size=40).map("".join))
def test_random_markup(src):
    check(src)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>/!-'\"= apbdivscript&;#x", max_size=200))
def test_random_characters(src):
    check(src)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=200))
def test_random_bytes(body):
    check(body.decode("utf-8", "replace"))
