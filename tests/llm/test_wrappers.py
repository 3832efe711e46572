from motorlake.llm import wrappers
from motorlake.llm.html_tree import match, parse

PAGES = "page_id long, url string, html string, host string, text string, part string, groups string"


def page(k, body):
    return (
        f"<!DOCTYPE html><html><head><title>t {k}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>"
        f"<nav><ul><li><a href='/'>Home</a><li>About</ul></nav><!-- c --><div class=\"ad\">Buy {k}</div>{body}"
        "<footer>&copy; all</footer></body></html>"
    )


def run(spark, data, **options):
    rows = [(k, u, h, "z", "z", "z", "z") for k, (u, h) in enumerate(data)]
    got = wrappers.main_texts(spark.createDataFrame(rows, PAGES), **options).collect()
    assert len(got) == len(rows)
    assert all(r.n_chars == len(r.text) for r in got)
    return {r.page_id: r.text for r in got}


def test_article(spark):
    html = page(1, "<article><header><h1>A &amp; B&nbsp;c</h1></header><p><b>one\n  two<br>three<p>four &lt;b&gt; &#233;<ul><li>x<li>y</ul>"
                   "<div class='share-bar'>Share</div><aside>no</aside><form>no<input></form></article><section id='comments'><p>reader</p></section>")
    cut = html[: html.index("four") + 4]
    got = run(spark, [("http://a.org/1", html), ("http://a.org/2", cut), (None, None), ("no url", ""), ("http://b.org", "plain <i>te</i>xt")])
    assert got[0] == "A & B c\none two three\nfour <b> é\nx\ny"
    assert got[1] == "A & B c\none two three\nfour"
    assert (got[2], got[3], got[4]) == ("", "", "plain text")


def test_template_without_marks(spark):
    """No element says what it is: only the alignment of the host's pages does."""
    data = [("http://c.org/%d" % k, f"<body><div><p>Site name</p><p>All rights kept</p></div><div><p>Story {k} begins</p><p>and ends {k * k}</p></div></body>") for k in range(30)]
    got = run(spark, data)
    assert got == {k: f"Story {k} begins\nand ends {k * k}" for k in range(30)}
    # Copies of one page prove no template, and a host of one page has none.
    same = run(spark, [("http://d.org/", "<div><p>All</p><p>the same</p></div>")] * 12 + [("http://e.org", "<div><p>alone</p></div>")])
    assert set(same.values()) == {"All\nthe same", "alone"}


def test_boilerplate_outweighs_the_story(spark):
    """Three times as much boilerplate as story, in many slots or in one, is template; copies still prove none."""
    notice = "These terms hold for every visit to this place and for all that is shown on it, as ever. "
    many = "".join(f"<p>Menu entry {c * 8}</p>" for c in "abcdefgh")
    data = [(f"http://k.org/{k}", f"<div>{many}</div><div><p>Story {k} of {k * k * 7919} and more {k}</p></div><div><p>Kept</p></div>") for k in range(20)]
    data += [(f"http://l.org/{k}", f"<div><p>Story {k} of {k * k * 7919} and more</p></div><div><p>{notice * 2}</p></div>") for k in range(20)]
    got = run(spark, data)
    assert set(got.values()) == {f"Story {k} of {k * k * 7919} and more {k}" for k in range(20)} | {f"Story {k} of {k * k * 7919} and more" for k in range(20)}
    body = "".join(f"<p>A sentence that all copies have, number {k}.</p>" for k in range(20))
    near = run(spark, [(f"http://m.org/{k}", f"<div><p>Read {k}</p>{body}</div>") for k in range(20)])
    assert all(t.count("A sentence") == 20 for t in near.values())


def test_every_layout_and_small_hosts_vote(spark):
    """A layout of a tenth of a host's pages, over many groups, and hosts of three pages have templates too."""
    def body(k):
        story = f"<p>Story {k} of {k * k * 7919}</p><p>It ends {k * 31}</p>"
        return f"<div class='old'><div class='x'><p>Old frame</p></div><div>{story}</div></div>" if k % 10 == 0 else f"<div><div><p>New frame</p></div><div>{story}</div></div>"

    want = {k: f"Story {k} of {k * k * 7919}\nIt ends {k * 31}" for k in range(160)}
    assert run(spark, [(f"http://n.org/{k}", body(k)) for k in range(160)], pages_per_group=16) == want
    small = run(spark, [(f"http://o{k % 2}.org/{k}", body(k * 10)) for k in range(7)])
    assert small == {k: want[k * 10] for k in range(7)}


def test_repeated_rows_are_dealt_out(spark):
    rows = [(1, "http://q.org/1", "<p>Same</p>", "z", "z", "z", "z")] * 200
    deal = wrappers.dealt(spark.createDataFrame(rows, PAGES), pages_per_group=20).groupBy("host", "part").count()
    assert deal.count() == 10


def test_groups_are_bounded(spark):
    data = [(f"http://f.org/{k}", page(k, f"<article><p>text {k}</p></article>")) for k in range(50)] + [("http://f.org/0", page(0, "<article><p>text 0</p></article>"))]
    assert run(spark, data, pages_per_group=8) == {k: f"text {k % 50}" for k in range(51)}
    assert run(spark, []) == {}


def test_layout_words():
    tree = parse("<div class='with-sidebar content header'><article class='post'><p>a</p><div class='comments'>no</div></article></div><div class='sidebar'>no</div>")
    assert wrappers.blocks(tree, set()) == ["a"]


def test_names_are_whole():
    """Custom elements and empty svg hide nothing, and values of other attributes hide nothing."""
    def text(body):
        return wrappers.blocks(parse(body), set())

    assert text("<p>a</p><svg-icon></svg-icon><p>b</p><title-bar>c</title-bar><select-box>d</select-box>") == ["a", "b", "c", "d"]
    assert text("<p>a</p><svg/><p>b</p><svg width='1' /><p>c</p><svg><title>no</title></svg><p>d</p>") == ["a", "b", "c", "d"]
    assert text("<article data-hidden='false'><p aria-label=\"hidden gems of Rome\">a</p><p data-style='x' title='style=display:none'>b</p></article>") == ["a", "b"]
    assert text("<p hidden>no</p><p HIDDEN=''>no</p><p aria-hidden=true>no</p><p style=\"color:red; display: none\">no</p><p data-class='ad'>a</p><p class=ad>no</p>") == ["a"]
    assert text("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds<math/> here</p><object data='x'>instead</object>") == ["so x=2 holds here", "instead"]


def test_tree_matching():
    a, b = parse("<div><h1>x</h1><p>1</p><p>2</p><div><p>q</p></div></div>"), parse("<div><h1>y</h1><p>1</p><table><tr><td>n</table><div><p>r</p></div></div>")
    assert len(match(a, b)) == 6
    deep = parse("<div>" * 5000 + "x")
    assert wrappers.blocks(deep, set()) == ["x"] and len(match(deep, deep)) > 100
