import pytest

from corpusflow.functions.html import anchors_of, extract_content, headings_of, links_of, main_by_density, resolve_link, shell_of, strip_html, tape_of


@pytest.mark.parametrize(
    "page,text",
    [
        ("", ""),
        ("<p>one  two</p><p>three</p>", "one two\n\nthree"),
        ("a<br>b", "ab"),
        ("a<hr/>b", "a\n\nb"),
        ("<script>x()</script>seen<style>p{}</style>", "seen"),
        ("&amp;lt;b&amp;gt; &copy; ", "<b> ©"),
        ("text <!-- gone --> more ", "text more"),
        ("tail &amp", ""),
        ("<title>T</title><p>x</p>", "Tx"),
        ("<script>never closed <p>x</p>", ""),
    ],
)
def test_strip(page, text):
    assert strip_html(page) == text


def test_places_in_order():
    assert strip_html(extract_content("<div id=content>a</div><main>b</main><article>c</article>")) == "b"
    assert strip_html(extract_content("<article>a <main>b</main></article>")) == "a b"
    assert strip_html(extract_content("<div class='x content'>a</div><p>b</p>")) == "a"
    assert strip_html(extract_content("<div class='my-content'>a</div><p>b</p>")) == "a\n\nb"
    assert strip_html(extract_content("<main>a<p>b</p>")) == "ab"
    assert strip_html(extract_content("<main>a<main>b</main>c</main>d")) == "ab\n\nc"
    assert extract_content(None) == extract_content("  ") == ""


def test_value_less_class_is_empty():
    assert strip_html(extract_content("<div class>x</div>")) == "x"


def test_density():
    words = "word " * 60
    assert main_by_density(tape_of(f"<div>{words}</div>")).strip() == words.strip()
    assert main_by_density(tape_of("<div>" + "word " * 50 + "</div>")) is None
    assert main_by_density(tape_of(f"<div>{words}<a>x</a><a>y</a><a>z</a><a>q</a></div>")) is not None
    assert main_by_density(tape_of(f"<div>{words}" + "<a>x</a>" * 9 + "</div>")) is None
    assert main_by_density(tape_of(f"<div>{words}<nav>n</nav></div>")) is None
    inner = main_by_density(tape_of(f"<div><section>{words}</section></div>"))
    assert "section" not in inner  # of equals the one that closes first


def test_boilerplate():
    assert strip_html(extract_content("<main><nav>n</nav><div class='left-sidebar'>s</div><p class=protocol>t</p><p id=toc2>i</p>kept</main>")) == "kept"
    assert strip_html(extract_content("<main>a<nav>b")) == "a"
    assert strip_html(extract_content("<main><nav>b<p>c</main>")) == ""
    assert strip_html(extract_content("<main>&lt;div&gt;x&lt;/div&gt;</main>")) == "x"  # escaped markup is markup after extraction


def test_headings():
    text, found = headings_of(tape_of("<h1> A <b>b</b></h1><p>x</p><h2></h2><h3>C</h3><svg><h2>no</h2></svg>"))
    assert [(a, b) for a, b, _ in found] == [(1, "A b"), (3, "C")]
    assert text == "A b\n\nx\n\nC"
    assert found[0][2] == 4


@pytest.mark.parametrize(
    "href,want",
    [
        ("b.html", ("d/b.html", "")), ("../x/y.html#z", ("x/y.html", "#z")), ("./b", ("d/b", "")), ("sub/index.html", ("d/sub", "")),
        ("../index.html", None), ("#a", None), ("", None), ("https://h/x", None), ("mailto:a@b", None), ("javascript:x", None),
        ("tel:1", ("d/tel:1", "")), ("/root/a", ("/root/a", "")), ("a?q=1", ("d/a?q=1", "")),
    ],
)
def test_links(href, want):
    assert resolve_link(href, "d/page.html") == want


def test_anchors():
    assert anchors_of(tape_of("<a href=x>one <b>two</b></a><a>none</a><a href>no</a><a href=y>open")) == [("x", "one two"), ("", "none")]
    assert links_of(tape_of("<a href=x> t </a>"), "p.html") == [("x", "", "t")]


def test_shells():
    assert shell_of(tape_of("<body>ab <p> cd </p><script>ef</script></body>gone")) == (8, False)
    assert shell_of(tape_of("<body><div id=app></div></body>")) == (0, True)
    assert shell_of(tape_of("<div id=app></div>")) == (0, False)
