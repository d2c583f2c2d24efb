"""Recovery rules of the tree builder, without Spark."""

from __future__ import annotations

import pytest

from gleanframe.functions import htmltree as H
from gleanframe.functions.selectors import compile_selector


def outline(src):
    """Nested (tag, children) of the body."""
    tree = H.parse_tree(src)
    kids = {}
    for i, n in enumerate(tree.nodes):
        kids.setdefault(n.parent, []).append(i)

    def show(i):
        inner = "".join(show(k) for k in kids.get(i, ()))
        return f"{tree.nodes[i].tag}({inner})" if inner else tree.nodes[i].tag

    return " ".join(show(k) for k in kids.get(tree.body, ()))


def texts(src, tag):
    tree = H.parse_tree(src)
    return ["".join(tree.parts[n.start : n.stop]) for n in tree.nodes if n.tag == tag]


def attrs(src, tag):
    return [n.attrs for n in H.parse_tree(src).nodes if n.tag == tag]


@pytest.mark.parametrize(
    ("src", "want"),
    [
        ("<p>a<p>b", "p p"),
        ("<p>a<div>b</div>", "p div"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "ul(li li(ul(li)) li)"),
        ("<dl><dt>a<dd>b<dt>c</dl>", "dl(dt dd dt)".replace(" ", "")),
        ("<table><tr><td>a<td>b<tr><th>c</table>", "table(tr(tdtd)tr(th))"),
        ("<select><option>a<option>b</select>", "select(optionoption)"),
        ("<br/><img><input>", "br img input"),
        ("<div/>x", "div"),
        ("a</div>b</span>", ""),
        ("x</p>y", "p"),
        ("<b>x</br>y</b>", "b(br)"),
        ("<h1>a<h2>b</h2>", "h1 h2"),
        ("<h1>a</h3>b", "h1"),
        ("<a>x<a>y</a>", "a a"),
        ("<svg><path/><g><path/></g></svg><p>x", "svg(pathg(path)) p"),
        ("<form><form><input></form>", "form(input)"),
        ("<tr><td>x</td></tr>", ""),
        ("<p><b>x</p><p>y</p>", "p(b) p(b)"),
        ("<div></p></div>", "div(p)"),
        ("<button>a<button>b", "button button"),
        ("<ul><li>a<ul></li><li>b</ul>", "ul(li(ul(li)))"),
        ("<p>a</body></html><i>late</i>", "p(i)"),
    ],
)
def test_structure(src, want):
    assert outline(src).replace(" ", "") == want.replace(" ", "")


def test_repeated_formatting_is_kept_three_times_only():
    tree = H.parse_tree("<p><b>" * 40 + "x")
    assert len(tree.stack) == 0
    assert len(tree.nodes) < 3 + 40 * 6


def test_raw_text():
    assert texts('<script>var t="</p>";if(a<b){}</script>', "script") == ['var t="</p>";if(a<b){}']
    assert texts("<script><!-- <script>x</script> --></script>y", "script") == ["<!-- <script>x</script> -->"]
    assert texts("<style>p>b{}</STYLE >z", "style") == ["p>b{}"]
    assert texts("<noscript><p>Enable &amp; go</p></noscript>", "noscript") == ["<p>Enable &amp; go</p>"]
    assert texts("<title>A &amp; <b></title>", "title") == ["A & <b>"]
    assert texts("<textarea>&lt;p></textarea>", "textarea") == ["<p>"]
    assert texts("<script>never closed <p>", "script") == ["never closed <p>"]


def test_attributes():
    assert attrs("<p A=1 b='2' C=\"3\" d e=x/y>", "p") == [[("a", "1"), ("b", "2"), ("c", "3"), ("d", ""), ("e", "x/y")]]
    assert attrs('<p t="a>b" u = v>', "p") == [[("t", "a>b"), ("u", "v")]]
    assert attrs('<a href="?a=1&copy=2&amp;b&lt;">', "a") == [[("href", "?a=1&copy=2&b<")]]
    assert attrs("<p class=a class=b>", "p") == [[("class", "a"), ("class", "b")]]
    assert attrs('<p title="never closed', "p") == []


def test_comments_and_declarations():
    assert outline("<!-- a > <p> --><i></i>") == "i"
    assert outline("<!--><p>x") == "p"
    assert outline("<!doctype html><?php echo ?></ x><p>y") == "p"
    assert outline("<!-- never closed <p>") == ""
    assert texts("<p>1 < 2 <3</p>", "p") == ["1 < 2 <3"]


def test_head_and_body_are_implied():
    tree = H.parse_tree("<title>t</title><meta name=a><p>x")
    assert [(n.tag, n.parent) for n in tree.nodes] == [("html", -1), ("head", 0), ("title", 1), ("meta", 1), ("body", 0), ("p", 4)]
    tree = H.parse_tree("<html lang=en><body class=a><body class=b id=c>x")
    assert tree.nodes[0].attrs == [("lang", "en")]
    assert tree.nodes[tree.body].attrs == [("class", "a"), ("id", "c")]


def test_empty_page_has_a_body():
    tree = H.parse_tree("")
    assert [n.tag for n in tree.nodes] == ["html", "body"]


def test_too_deep_is_an_error():
    with pytest.raises(H.ParseError):
        H.parse_tree("<div>" * 600)
    assert len(H.parse_tree("<div>" * 400).nodes) == 402


def test_entities_without_semicolon_and_carriage_returns():
    assert texts("<p>a &amp b &nosuch; &#65;\r\nc</p>", "p") == ["a & b &nosuch; A\nc"]


def test_selectors_outside_the_dialect():
    for bad in ("a b", "a > b", "", "a,", "a:hover", "a[x^=y]", "a:not([x=y])"):
        with pytest.raises(ValueError):
            compile_selector(bad)
