"""Main text of pages by wrapper induction.

Pages of one host are dealt into groups of about ``PAGES``, pages of one layout (the paths of
their structural elements) together; a host with a third of all pages is many groups.  In a group each
page's tree is aligned by simple tree matching with reference pages of its own layout, or with the
group's first pages where no other page has its layout.  Each alignment is a vote on the reference's
nodes, known by their path and text; the votes of all groups are added up by host.  Nodes that carry
the same text in nearly all alignments are the host's template; slots that vary are content.  Alignments of pages that are copies of each other say nothing about the template and are
not counted: pages are copies if they agree in most of what varies between pages (each slot counts by
the share of alignments in which it differs), however much boilerplate stands around it.  Content is then read inside the article (or main) element where there is one, else from
the whole body, leaving out template nodes and elements that are by tag, class, id or role menus,
headers, footers, sidebars, notices, adverts, forms or reader comments.

The text is one line per block, in page order; white space in a block is one space.  Character
references are decoded.

Defined results: null or empty pages give an empty text with 0 characters.  A missing or broken
address counts as an empty host.  A template needs five pages that agree, or three on a host of at most five pages; where
fewer are seen only the elements' kinds decide.  Repeated rows each give a row, null ids and addresses are returned
as null, and an empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from motorlake.llm.html_tree import Node, match, parse, shape
from motorlake.llm.rows import column, located
from motorlake.session import settle

PAGES = 64
#: Reference pages of a layout, pages that must speak, and their share with the same text.
REFERENCES, SPEAK, SAME = 2, 5, 0.9
#: Pages that must speak on a host of at most SPEAK pages.
FEW = 3
#: Two pages that share so much of what varies on the host, or differ in so little of all, are copies.
COPIES, DIFFER = 0.5, 0.05
#: Elements that never hold main text, and words in class, id or role that mark such parts.
DROPPED = frozenset("head nav aside footer form button dialog menu fieldset".split())
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments comment-list consent cookie "
    "cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pager pagination "
    "popup promo promoted promotion recommended related replies respond rail share sharing sidebar signup skip social sponsor "
    "sponsored subscribe tags toolbar widget widgets contentinfo complementary search alert".split()
)
CONTENT = frozenset(["article", "main"])


#: Said of the layout, not of the part itself.
LAYOUT = re.compile(r"\b(?:no|with|without|has)[-_][a-z]+")
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])


def _marked(node: Node, inside: bool) -> bool:
    if not node.marks:
        return False
    words = set(re.split(r"[^a-z]+", LAYOUT.sub(" ", node.marks))) & BOILERPLATE
    return bool(words - {"header"} if inside else words)


def dropped(node: Node, inside: bool) -> bool:
    """Is the element by its kind no main text?  A header inside the article belongs to it, and a
    part that holds the article is no boilerplate, whatever its class says."""
    if node.hidden or node.tag in DROPPED:
        return True
    if node.tag == "header":
        return not inside
    if node.tag in ("html", "body", "main") or node.tag in HEADINGS or node.holds_content:
        return False
    return _marked(node, inside)


def without_copies(aligned: list[list[tuple[int, bool, int]]]) -> list[tuple[int, list[tuple[int, bool, int]]]]:
    """Number and slots of the alignments with one reference that are not with a copy of it; a slot is (key, same text, length)."""
    seen: dict[int, list[int]] = {}
    for slots in aligned:
        for v, s, _ in slots:
            counts = seen.setdefault(v, [0, 0])
            counts[0] += 1
            counts[1] += not s

    def speaks(slots: list[tuple[int, bool, int]]) -> bool:
        varies = [(n * seen[v][1] / seen[v][0], s) for v, s, n in slots]
        differs = sum(n for _, s, n in slots if not s)
        return sum(w for w, s in varies if s) <= COPIES * sum(w for w, _ in varies) and 0 < differs >= DIFFER * sum(n for *_, n in slots)

    return [(k, slots) for k, slots in enumerate(aligned) if speaks(slots)]


def votes(trees: list[Node]) -> dict[int, list[int]]:
    """Of each node key in a reference: pages of the group that were aligned with it, and those with the same text."""
    layouts: dict[int, list[int]] = {}
    for k, tree in enumerate(trees):
        layouts.setdefault(shape(tree), []).append(k)
    alone = [m[0] for m in layouts.values() if len(m) == 1]
    # A small group has so few pages that each can be a reference.
    most = len(trees) if len(trees) <= SPEAK else REFERENCES
    tasks = [(r, members) for members in layouts.values() if len(members) > 1 for r in members[:most]]
    if alone:
        tasks += [(r, alone) for r in range(min(most, len(trees)))]
    told: dict[int, dict[int, bool]] = {}
    for r, members in tasks:
        reference = trees[r]
        others = [k for k in members if k != r]
        aligned = [[(v.key, u.own() == (own := v.own()), sum(map(len, own))) for u, v in match(trees[k], reference) if v.key] for k in others]
        for k, slots in without_copies(aligned):
            for v, s, _ in slots:
                pages = told.setdefault(v, {})
                pages[others[k]] = pages.get(others[k], False) or s
    return {v: [len(pages), sum(pages.values())] for v, pages in told.items()}


def constant(n: int, same: int, few: bool) -> bool:
    return n >= (FEW if few else SPEAK) and same >= SAME * n


def blocks(tree: Node, template: set[int]) -> list[str]:
    """Texts of the content blocks in page order, without nodes whose key is in ``template``."""
    return [text for key, text in candidates(tree) if key not in template]


def candidates(tree: Node) -> list[tuple[int, str]]:
    """Key and text of what may be content by the elements' kinds."""

    def walk(top: Node, inside: bool) -> list[tuple[int, str]]:
        out, todo = [], [(top, 0, inside)]
        while todo:
            item, key, within = todo.pop()
            if isinstance(item, str):
                out.append((key, item))
            elif not dropped(item, within):
                within = within or item.tag in CONTENT
                todo.extend((x, item.key, within) for x in reversed(item.items))
        return out

    found, todo = [], [tree]
    while todo:  # the outermost content elements in page order
        node = todo.pop()
        if dropped(node, False):
            continue
        if node.tag in CONTENT:
            found.append(node)
        else:
            todo.extend(reversed(node.children()))
    return [b for n in found for b in walk(n, True)] if found else walk(tree, False)


def extract_group(pages: list[str | None]) -> list[str]:
    """Main texts of the pages of a host that is one group."""
    trees = [parse(p or "") for p in pages]
    template = {v for v, (n, same) in votes(trees).items() if constant(n, same, len(trees) <= SPEAK)}
    return ["\n".join(blocks(t, template)) for t in trees]


def dealt(
    pages: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
    pages_per_group: int = PAGES,
) -> DataFrame:
    """host, part, page_id, url, html: the pages, those of a group together."""
    pages, place = located(pages)

    @F.arrow_udf("bigint")
    def layout(html: pa.Array) -> pa.Array:
        return pa.array([shape(parse(x)) for x in html.to_pylist()], pa.int64())

    rows = pages.select(
        column(pages, id_column).alias("page_id"), column(pages, url_column).cast("string").alias("url"),
        F.coalesce(column(pages, html_column).cast("string"), F.lit("")).alias("html"), F.xxhash64(place).alias("place"),
    ).withColumn("host", F.lower(F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")))).withColumn("layout", layout("html"))
    # Only hosts of more than one group are joined back; stored, so that the planner knows their size.
    size = F.lit(pages_per_group)
    layouts = settle(rows.groupBy("host", "layout").agg(F.count(F.lit(1)).alias("n")), "layouts")
    large = settle(
        layouts.groupBy("host").agg(F.sum("n").alias("pages"), F.ceil(F.sum(F.when(F.col("n") < size, F.col("n"))) / size).alias("rare"))
        .where(F.col("pages") > size).select("host", "rare"), "hosts"
    )
    wide = settle(layouts.where(F.col("n") >= size).join(large.select("host"), "host", "left_semi").select("host", "layout", F.ceil(F.col("n") / size).alias("groups")), "wide")
    # Which group a page is in follows from its layout and its own place, so reruns agree and equal
    # pages are dealt out.  Hosts of one group are part 0; layouts of less than a group share groups.
    part = (
        F.when(F.col("groups").isNotNull(), F.xxhash64("layout", F.pmod("place", F.col("groups"))))
        .when(F.col("rare").isNotNull(), F.xxhash64(F.pmod("layout", F.col("rare"))))
        .otherwise(F.lit(0).cast("long"))
    )
    # Dealt by host and group: what a join by host leaves together must not stay so.
    return (
        rows.join(large, "host", "left").join(wide, ["host", "layout"], "left")
        .select("host", part.alias("part"), "page_id", "url", "html").repartition("host", "part")
    )


def main_texts(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", pages_per_group: int = PAGES) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    spread = dealt(pages, id_column, url_column, html_column, pages_per_group)
    kind = spread.schema["page_id"].dataType.simpleString()

    def vote(group: pa.Table) -> pa.Table:
        texts = group["html"].to_pylist()
        order = sorted(range(len(texts)), key=lambda k: hashlib.md5(texts[k].encode("utf-8", "surrogatepass")).digest())
        trees = [parse(texts[k]) for k in order]
        told = votes(trees)
        # Every key that may be content asks for the host's verdict, voted on here or not.
        keys = sorted({key for t in trees for key, _ in candidates(t)})
        few = group["part"][0].as_py() == 0 and len(trees) <= SPEAK
        return pa.table({
            "host": pa.array([group["host"][0].as_py()] * len(keys), pa.string()), "part": pa.array([group["part"][0].as_py()] * len(keys), pa.int64()),
            "key": pa.array(keys, pa.int64()), "n": pa.array([told.get(k, (0, 0))[0] for k in keys], pa.int64()),
            "same": pa.array([told.get(k, (0, 0))[1] for k in keys], pa.int64()), "few": pa.array([few] * len(keys), pa.bool_()),
        })

    template = (
        spread.groupBy("host", "part").applyInArrow(vote, "host string, part bigint, key bigint, n bigint, same bigint, few boolean")
        .groupBy("host", "key").agg(F.sum("n").alias("n"), F.sum("same").alias("same"), F.max("few").alias("few"), F.collect_list("part").alias("parts"))
        .where((F.col("n") >= F.when(F.col("few"), FEW).otherwise(SPEAK)) & (F.col("same") >= SAME * F.col("n")))
        .select("host", F.explode("parts").alias("part"), "key")
    )

    def extract(group: pa.Table, known: pa.Table) -> pa.Table:
        drop = set(known["key"].to_pylist())
        texts = ["\n".join(blocks(parse(x), drop)) for x in group["html"].to_pylist()]
        return pa.table(
            {"page_id": group["page_id"], "url": group["url"], "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
        )

    # Both uses of ``spread`` read one shuffle.
    return spread.groupBy("host", "part").cogroup(template.groupBy("host", "part")).applyInArrow(
        extract, f"page_id {kind}, url string, text string, n_chars bigint"
    )
