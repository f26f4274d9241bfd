"""Main text of web pages by a site style tree.

Pages of one host are merged into a style tree: a branch is known by its path of style keys
(tag and class, digits left out), and each page that has the branch adds its presentation (the
sequence of child tags), its content (the text) and how much of it stands in links. A branch's
importance joins the entropies of both:

    importance = (1 - g ** l) * H(presentation) + g ** l * H(content),     g = 0.9, l = presentations

with entropies in units of log(pages), so a branch that says the same on every page has 0 and one
that differs on every page 1; a branch outside of article and main whose text is nearly all links has 0. Pages of a host that say and
show the same count once. With many presentations the sum fades the content out, and the mix of a few
shapes falls with log(pages), so importance alone condemns nothing: a branch is removed where importance
and H(content) are low, its own and those of every judged branch inside it. Both are drawn towards 1 by the weight of a few
pages that would differ: on n pages s counts as (w + n * s) / (w + n). w is such that a branch that always says
the same reaches the threshold on `min_pages` (8) different pages; so fewer pages say too little, by the same rule for every host.

The merge is a distinct over pages that have judged branches, keyed by all they hold, and an aggregation by (branch,
feature) with map-side combine, so a host with a third of all pages is no more than a few hot keys with
partial sums. A branch is its host and path as a 128-bit hash, so deep pages cost no more than their tags: a page is walked in
linear time, and what branches hold comes from running sums and rolling hashes. What stands inside a branch is found by
doubling steps up the tree, as many as the logarithm of its depth.

What HTML says by itself needs no statistics: menus, headers, footers, asides, forms, scripts and
the like are removed by tag, role or class words; where a page marks its article (or main part), only
that is text. Paragraphs, headings and list items that stand in the article are never judged by
repetition, only whole containers are: a passage that many pages quote stays.

Defined results: null or empty html gives an empty text; a page is processed whole; unclosed tags end
with their parents, a new paragraph ends an open one; a page without a host is a host of its own
name ""; a repeated page row is extracted row by row; an empty table gives none; columns text and n_chars are replaced, all
others stay.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrina.llm.common import ROW, join_unique, pack_row, quoted, scratch

#: Comments, tags (quotes count behind "=" only), tags whose quotes never close, other markup. After a tag of
#: the second last kind the rest of a page is read without quotes, so that nothing is searched twice.
COMMENT, PLAIN_TAG, OTHER = r"<!--.*?(?:-->|\Z)", r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", r"<[!?/][^>]*>"
TAG = re.compile(rf"""{COMMENT}|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*"[^"]*"|=\s*'[^']*'|=)*+)>|{PLAIN_TAG}|{OTHER}""", re.S)
UNQUOTED = re.compile(f"{COMMENT}|(?!)()()()|{PLAIN_TAG}|{OTHER}", re.S)
ATTR = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
#: A start tag of the first kind ends an open element of the second, up to the nearest scope.
ENDS_P = BLOCK - {"html", "body", "tbody", "tfoot", "thead", "tr"}
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
SCOPE = frozenset(("table", "ul", "ol", "dl", "td", "th", "body", "html", "article", "section", "div", "select", "main"))
CELL = frozenset(("td", "th", "br", "option"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
NOISE_TAGS = frozenset("nav header footer aside form script style noscript template iframe button select textarea dialog head title menu datalist noembed noframes".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of class names and ids that name what is not the article.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup "
    "login sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs footer header masthead share sharing social related recommended comment comments respond disqus reply replies pagination pager widget toolbar search skip".split()
)
COMMENT_WORDS = frozenset("comment comments respond disqus reply replies related recommended".split())
#: Elements that are judged by the site's statistics: containers, never the text carriers themselves, and
#: nothing inline, which would go from the middle of a sentence.
JUDGED = frozenset("div section ul ol dl table figure center details fieldset".split())
GAMMA, THRESHOLD, LINK_SHARE, MIN_PAGES = 0.9, 0.2, 0.75, 8
#: Removed branches up to so many bytes in all are broadcast; of more, each page gets its own by a join.
BROADCAST_BYTES = 32 << 20
#: A branch in a Python set takes about so many bytes.
BRANCH_BYTES = 128
#: Modulus and base of rolling hashes.
MODULUS, BASE = (1 << 61) - 1, 0x2F0B4C47A9D5E3
BARRIERS = SCOPE | NOISE_TAGS


def path_id(parent: bytes, key: str) -> bytes:
    """A branch: its parent's hash and its own key."""
    import xxhash

    return xxhash.xxh3_128_digest(parent + key.encode())


def host_id(host: str) -> bytes:
    return path_id(b"", host)


class Element:
    __slots__ = ("above", "children", "dropped", "first", "headings", "inside", "link", "path", "root", "tag")

    def __init__(self, tag: str, path: bytes, dropped: str, root: bool, headings: bool, link: bool, inside: bool, above: bytes | None, first: int) -> None:
        #: above: the nearest judged branch around it; first: the first piece of text in it
        self.tag, self.path, self.dropped, self.root, self.headings, self.link, self.inside, self.above, self.first = tag, path, dropped, root, headings, link, inside, above, first
        self.children: list[str] = []


class Branches:
    """What a page's judged branches show and say, collected while it is walked."""

    def __init__(self) -> None:
        self.hashes, self.chars, self.links = [0], [0], [0]
        self.found: dict[bytes, list] = {}

    def text(self, text: str, link: bool) -> None:
        import xxhash

        self.hashes.append((self.hashes[-1] * BASE + xxhash.xxh3_64_intdigest(text) + 1) % MODULUS)
        self.chars.append(self.chars[-1] + len(text))
        self.links.append(self.links[-1] + len(text) * link)

    def close(self, e: Element) -> None:
        """A judged element that holds text, and nothing around it is left out."""
        import xxhash

        end = len(self.hashes) - 1
        said = (self.hashes[end] - self.hashes[e.first] * pow(BASE, end - e.first, MODULUS)) % MODULUS
        shown = xxhash.xxh3_64_intdigest(" ".join(e.children))
        own = self.found.setdefault(e.path, [e.above, e.inside, 0, 0, 0, 0])
        # a branch that a page has more than once: all of it, in order
        own[2] = (own[2] * BASE + shown + 1) % MODULUS
        own[3] = (own[3] * BASE + said + 1) % MODULUS
        own[4] += self.chars[end] - self.chars[e.first]
        own[5] += self.links[end] - self.links[e.first]


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(raw)} if raw and not raw.isspace() else {}


def _noise(tag: str, attrs: dict[str, str]) -> str:
    """Why an element is none of the article: 'tag', 'comment', 'class', or ''."""
    if tag in NOISE_TAGS:
        return "tag"
    if not attrs:
        return ""
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "") or attrs.get("role", "").lower() in NOISE_ROLES:
        return "tag"
    named = set(re.split(r"[^a-z]+", f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()))
    if named & COMMENT_WORDS:
        return "comment"
    return "class" if named & NOISE_WORDS else ""


def walk(html: str, root_tag: str, removed: frozenset[bytes] = frozenset(), host: bytes = b"", tree: Branches | None = None) -> list[str]:
    """The blocks of text inside the outermost root elements (all of the page if root_tag is empty).

    removed: branches that the site's statistics rule out. tree: collects what judged branches hold.
    """
    blocks: list[str] = []
    now: list[str] = []

    def flush() -> None:
        if now:
            if text := " ".join(entities.unescape("".join(now)).split()):
                blocks.append(text)
            now.clear()

    stack = [Element("", host, "", not root_tag, False, False, False, None, 0)]
    open_at: dict[str, list[int]] = {}  # places in the stack, by tag
    barriers: list[int] = []
    headings = 0  # open ones

    def close() -> None:
        nonlocal headings
        gone = stack.pop()
        open_at[gone.tag].pop()
        if gone.tag in BARRIERS:
            barriers.pop()
        headings -= gone.tag in HEADINGS
        if gone.tag in BLOCK:
            flush()
        if tree is not None and gone.tag in JUDGED and not gone.dropped and len(tree.hashes) - 1 > gone.first:
            tree.close(gone)

    def add(text: str) -> None:
        last = stack[-1]
        if last.root and (not last.dropped or last.headings and headings):
            now.append(text)
        if tree is not None and not last.dropped and not text.isspace():
            tree.text(text, last.link)

    at, size, last_end, pattern = 0, len(html), html.rfind(">"), TAG
    while at < size:
        # behind the last ">" no tag can end, and nothing is searched; an open comment hides the rest
        m = pattern.search(html, at) if at <= last_end or "<!--" in html[at:] else None
        if m is None:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        if m[5]:
            pattern = UNQUOTED
        tag = tag.lower()
        if m[1] or m[4]:
            if open_at.get(tag):
                place = open_at[tag][-1]
                while len(stack) > place:
                    close()
            elif tag in BLOCK:
                flush()
            continue
        raw = m[3] if m[2] else m[6]
        if tag in RAW and not raw.endswith("/"):
            end = RAW[tag].search(html, at, last_end + 1)
            at = end.end() if end else size
            continue
        if tag in CELL:
            add(" ")
        ends = ("p",) if tag in ENDS_P else ()
        ends += SAME.get(tag, ())
        if ends:
            barrier = next((i for i in reversed(barriers) if stack[i].tag not in ends), 0)
            places = [own[i] for t in ends if (own := open_at.get(t)) and (i := bisect_right(own, barrier)) < len(own)]
            if places:
                place = min(places)
                while len(stack) > place:
                    close()
        if tag in BLOCK:
            flush()
        parent = stack[-1]
        if tree is not None:
            parent.children.append(tag)
        if tag in VOID:
            continue
        attrs = _attributes(raw)
        named = re.sub(r"[\d\s]+", " ", attrs.get("class", "")).strip().lower() if attrs else ""
        path = path_id(parent.path, f">{tag}.{named}" if named else f">{tag}") if tree is not None or removed else b""
        noise = _noise(tag, attrs)
        opens = tag == root_tag and not parent.root
        if tag in ("html", "body", "main") or (tag == "article" and noise == "class"):
            noise = ""
        dropped = parent.dropped
        if opens and dropped == "class":
            dropped = ""
        dropped = dropped or noise or ("site" if path in removed else "")
        in_headings = parent.headings or (tag == "header" or "header" in named) and not parent.dropped
        above = parent.path if parent.tag in JUDGED else parent.above
        open_at.setdefault(tag, []).append(len(stack))
        if tag in BARRIERS:
            barriers.append(len(stack))
        headings += tag in HEADINGS
        stack.append(Element(tag, path, dropped, parent.root or opens and not dropped, in_headings, parent.link or tag == "a", parent.inside or tag in ("article", "main"), above, len(tree.hashes) - 1 if tree is not None else 0))
    while len(stack) > 1:
        close()
    flush()
    return blocks


def main_text(html: str, removed: frozenset[bytes] = frozenset(), host: str = "") -> str:
    """The article's blocks, one a line; statistics that would leave nothing are not applied."""
    small = html.lower()
    for root in ("article", "main", ""):
        if not root or f"<{root}" in small:
            for branches in (removed, frozenset()):
                if blocks := walk(html, root, branches, host_id(host)):
                    return "\n".join(blocks)
                if not removed:
                    break
    return ""


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def page_branches(html: str, host: str) -> tuple[int, dict[bytes, list]]:
    """A page's text outside of menus and the like as one hash, and of each of its judged branches: the judged branch
    above it, whether it is in an article or main part, presentation, content, characters, characters in links."""
    tree = Branches()
    walk(html, "", frozenset(), host_id(host), tree)
    return tree.hashes[-1], tree.found


BRANCH = "path: binary, above: binary, inside: boolean, shown: long, said: long, chars: long, links: long"
PAGE = f"page binary, host string, said long, own array<struct<{BRANCH}>>"


def _page_key(url_col: str, html_col: str):
    """The same for rows of the same address and page."""
    return F.unhex(F.sha2(F.concat(F.coalesce(quoted(url_col), F.lit("")), F.lit("\x00"), F.coalesce(quoted(html_col), F.lit(""))), 256))


def branches_of_pages(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page (a key of address and page), host, said, own (its judged branches) of pages that have any; one row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "above", "inside", "shown", "said", "chars", "links"]
        branch = pa.struct([("path", pa.binary()), ("above", pa.binary()), ("inside", pa.bool_()), *[(n, pa.int64()) for n in names[3:]]])
        for batch in batches:
            keys, hosts, texts, owns = [], [], [], []
            for i in range(batch.num_rows):
                host = host_of(batch.column(1)[i].as_py())
                text, own = page_branches(batch.column(2)[i].as_py() or "", host)
                if own:
                    keys.append(batch.column(0)[i].as_py())
                    hosts.append(host)
                    texts.append(text)
                    owns.append([dict(zip(names, (path, *held), strict=True)) for path, held in own.items()])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hosts, pa.string()), pa.array(texts, pa.int64()), pa.array(owns, pa.list_(branch))], ["page", "host", "said", "own"])

    return pages.select(_page_key(url_col, html_col).alias("page"), quoted(url_col).alias("url"), quoted(html_col).alias("html")).mapInArrow(run, PAGE)


def site_importance(seen: DataFrame) -> DataFrame:
    """path, above, host, n_pages, importance and content (its entropy alone) of every judged branch of branches_of_pages().

    Pages of a host with the same text and the same branches count as one.
    """
    each = seen.select("host", "said", "own").distinct().select("host", F.explode("own").alias("b")).select("host", "b.*")
    fixed = ["path", "above", "inside", "host"]
    zero = F.lit(0).cast("long")
    kinds = F.explode(F.array(F.struct(F.lit("p").alias("kind"), F.col("shown").alias("feature"), zero.alias("c"), zero.alias("k")), F.struct(F.lit("c").alias("kind"), F.col("said").alias("feature"), F.col("chars").alias("c"), F.col("links").alias("k"))))
    counted = each.select(*fixed, kinds.alias("x")).select(*fixed, "x.*").groupBy(*fixed, "kind", "feature").agg(F.count("*").alias("n"), F.sum("c").alias("chars"), F.sum("k").alias("links"))
    of = lambda kind, col: F.sum(F.when(F.col("kind") == kind, col))
    sums = counted.groupBy(*fixed).agg(
        of("c", F.col("n")).alias("n_pages"),
        of("p", F.col("n") * F.log("n")).alias("p_sum"),
        of("c", F.col("n") * F.log("n")).alias("c_sum"),
        of("p", F.lit(1)).alias("kinds"),
        F.sum("chars").alias("chars"),
        F.sum("links").alias("links"),
    )
    pages_log = F.log("n_pages")
    entropy = lambda c: F.when(F.col("n_pages") > 1, 1 - F.col(c) / F.col("n_pages") / pages_log).otherwise(F.lit(1.0))
    fade = F.pow(F.lit(GAMMA), F.col("kinds"))
    weighed = (1 - fade) * entropy("p_sum") + fade * entropy("c_sum")
    linked = (F.col("links") >= LINK_SHARE * F.col("chars")) & ~F.col("inside")
    return sums.select("path", "above", "host", "n_pages", F.when(linked, 0.0).otherwise(weighed).alias("importance"), entropy("c_sum").alias("content"))


def removable(importance: DataFrame, threshold: float = THRESHOLD, min_pages: int = MIN_PAGES) -> DataFrame:
    """path of the branches to remove: importance and content are low, theirs and those of every judged branch
    inside them. Each round looks twice as far down the tree."""
    weight = threshold * min_pages / (1 - threshold)
    score = (weight + F.col("n_pages") * F.greatest("importance", "content")) / (weight + F.col("n_pages"))
    tree = scratch(importance.select("path", F.col("above").alias("up"), score.alias("score")), "style-tree")
    ones = tree.select("path", F.lit(1).alias("n"))
    while not tree.filter("up is not null").isEmpty():
        below = scratch(tree.filter("up is not null").groupBy(F.col("up").alias("path")).agg(F.max("score").alias("below")), "style-tree-below")
        raised = join_unique(tree, below, "path", "left", counted=ones).select("path", "up", F.greatest("score", "below").alias("score"))
        next_up = scratch(tree.select(F.col("path").alias("up"), F.col("up").alias("next")), "style-tree-up")
        tree = scratch(join_unique(scratch(raised, "style-tree-raised"), next_up, "up", "left").select("path", F.col("next").alias("up"), "score"), "style-tree")
    return tree.filter(F.col("score") <= threshold + 1e-9).select("path")


def extract_text(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD, min_pages: int = MIN_PAGES) -> DataFrame:
    """pages with text and n_chars in place of nothing else; columns of these names are replaced."""
    seen = scratch(branches_of_pages(pages, url_col=url_col, html_col=html_col), "page-branches")
    model = scratch(removable(site_importance(seen), threshold, min_pages), "removed-branches")
    kept = [c for c in pages.columns if c not in ("text", "n_chars")]
    packed = pack_row(pages.select(*[quoted(c) for c in pages.columns if c in kept or c in (url_col, html_col)]))
    places = {c: i for i, c in enumerate(c for c in pages.columns if c in kept or c in (url_col, html_col))}
    url, html = (F.col(f"{ROW}.c{places[c]}") for c in (url_col, html_col))
    rows = packed.select(ROW, url.alias("url"), html.alias("html"))
    small = model.count() * BRANCH_BYTES <= BROADCAST_BYTES
    if small:
        shared = pages.sparkSession.sparkContext.broadcast(frozenset(bytes(r["path"]) for r in model.collect()))
        source = rows.withColumn("removed", F.lit(None).cast("array<binary>"))
    else:
        own = scratch(seen.select("page", F.explode("own").alias("b")).select("page", F.col("b.path").alias("path")).distinct(), "page-paths")
        lists = scratch(join_unique(own, model.withColumn("one", F.lit(1)), "path").groupBy("page").agg(F.collect_set("path").alias("removed")), "page-removed")  # of a page's own branches
        counted = seen.groupBy("page").agg(F.count("*").alias("n"))
        source = join_unique(rows.withColumn("page", _page_key("url", "html")), lists, "page", "left", counted=counted).select(ROW, "url", "html", "removed")
    out = T.StructType([source.schema[ROW], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none: frozenset[bytes] = frozenset()
        for batch in batches:
            texts = []
            for i in range(batch.num_rows):
                removed = shared.value if small else frozenset(batch.column(3)[i].as_py() or ()) or none
                texts.append(main_text(batch.column(2)[i].as_py() or "", removed, host_of(batch.column(1)[i].as_py())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], out.names)

    done = source.mapInArrow(run, out)
    return done.select(*[F.col(f"{ROW}.c{places[c]}").alias(c) for c in kept], "text", "n_chars")


def contract(pages: DataFrame) -> DataFrame:
    """What op10 returns."""
    return extract_text(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
