"""Offers out of captured pages by declarative rules, one Spec a platform or site.

Reading a spec: `item` selects the cards; `title` the title inside a card (a card without one is
skipped); prices come from one Pair or Cut rule; stock from two lists of tests.

Pair(within, old, new, single, need): the old and new price if the rule's need is met (need="old": an
old price is there; "both": both are), else the single price (the whole container's text if there is
none). Cut(within, drop, cut): the part `cut` is one price, the container's remaining text the other.

Tests: class:X (of the card), parent_class:X, has:S, lacks:S, says:S (its text has a sold-out
phrase), any_says:S (any match's), itself_says:, disabled:S, text:S=a|b (contains a word), offer (an
offer price is left), offer_in:S (the same, where S is there).

Two rules follow what was meant where the original could never match by accident: old prices of
collection cards are found by their class, and cards without a label element have no label.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.functions.prices import SOLD_OUT_WORDS
from vitrina.operators.dom import Node, find, find_all, parse
from vitrina.schema import ON_OFFER, SOLD_OUT


@dataclass(frozen=True)
class Pair:
    within: str = ""
    old: str = ""
    new: str = ""
    single: str = ""
    need: str = "old"
    strip: str = ""
    if_text: tuple[str, str] = ()


@dataclass(frozen=True)
class Cut:
    within: str
    cut: str
    drop: str = ""
    cut_is: str = "old"
    strip: str = ""
    offer_class: str = ""
    single: str = ""


@dataclass(frozen=True)
class Spec:
    item: str
    title: str
    price: Pair | Cut
    gone: tuple[str, ...] = ()
    sale: tuple[str, ...] = ("offer",)
    link: str = "title:a[href]"
    base: str = ""
    needs: str = ""
    title_attr: str = ""
    extra: dict = field(default_factory=dict, hash=False, compare=False)


WOO_PRICE = Pair("span.price", "del", "ins", "bdi | *", "both", strip="IVA INC")
WOO = Spec("li.product", "h2.woocommerce-loop-product__title", WOO_PRICE, ("class:outofstock",), ("class:sale", "offer"), "a.woocommerce-LoopProduct-link[href] | a[href]")
ASTRA = replace(WOO, link="a.ast-loop-product__link[href] | a[href]")
PRESTA = Spec("article.product-miniature", "h2.product-title", Pair("", "span.regular-price", "span.price", "span.price"), ("has:ul.product-flags li.out_of_stock",), ("has:ul.product-flags li.discount", "offer_in:ul.product-flags"))
COLLECTION = Spec(
    "section.grid__item",
    "h3.bs-collection__product-title",
    Pair("div.bs-collection__product-price | section.bs-collection__product-price", "del[class*=old-price]", "div.bs-collection__product-final-price", "div.bs-collection__product-final-price"),
    ("says:div.bs-collection__product-notice", "says:div.bs-stock", "says:div.bs-collection__stock", "class:out-of-stock", "class:outStock", "has:div.bs-collection__product.out-of-stock", "has:div.bs-collection__product.outStock"),
    ("offer", "class:has-discount", "has:div.bs-collection__product.has-discount"),
    "title:a[href] | a[href]",
)
BLOCK = Spec(
    "article.product-block",
    "a.product-block__name",
    Pair("", ".product-block__price--old", ".product-block__price--new", ".product-block__price", "both"),
    ("any_says:div.product-block__label", "disabled:button.product-block__button--add-to-cart"),
    link="title",
)
SIMPLE_BLOCK = replace(BLOCK, price=Pair("div.product-block__pricing", "div.product-block__price--old", "div.product-block__price--new", "div.product-block__price", "both"), gone=("says:div.product-block__label--status",))

SPECS: dict[str, Spec] = {
    **dict.fromkeys(("cartonazo", "laloseta", "lamadriguera", "ludi", "playlander", "kimunaustral", "tertulia", "carontejuegosdemesa"), WOO),
    **dict.fromkeys(("mangaigames", "playcenter", "mirzu"), ASTRA),
    "revaruk": replace(ASTRA, gone=("class:outofstock", "says:span.ast-shop-product-out-of-stock"), sale=("class:sale", "offer", "has:span.ast-onsale-card")),
    "gatoarcano": replace(WOO, gone=("class:outofstock", "has:span.now_sold"), link="a[href]"),
    "labovedadelmago": replace(WOO, sale=("class:sale", "offer", "has:span.onsale")),
    **dict.fromkeys(("aldeajuegos", "lamesadevaras"), PRESTA),
    "planetaloz": replace(PRESTA, title="h1.product-title"),
    "dementegames": replace(PRESTA, gone=("has:ul.product-flags li.out-of-stock",)),
    "top8": replace(COLLECTION, base="https://www.top8.cl"),
    "gameofmagictienda": replace(COLLECTION, base="https://www.gameofmagictienda.cl"),
    "peakgames": replace(COLLECTION, base="https://www.peakgames.cl"),
    "wargaming": replace(COLLECTION, base="https://www.wargaming.cl"),
    "cardgame": replace(COLLECTION, item="div.bs-collection__product", base="https://www.cardgame.cl"),
    "vudugaming": replace(BLOCK, base="https://www.vudugaming.cl"),
    "zonaxgamers": replace(BLOCK, item="div.product-block__wrapper", base="https://zonaxgamers.cl"),
    "playkingdom": replace(SIMPLE_BLOCK, base="https://playkingdom.cl"),
    "juegosdelbosque": replace(SIMPLE_BLOCK, base="https://www.juegosdelbosque.cl"),
    "flexogames": Spec(
        "li.grid__item",
        "div.grid-view-item__title",
        Pair("", "div.price__compare s", "span.price-item--sale", "div.price__regular span.price-item--regular"),
        ("has:dl.price.price--sold-out",),
        (),
        "a.grid-view-item__link",
        "https://www.flexogames.cl",
    ),
    "lafortalezapuq": Spec("figure.product", "h5", Cut("span.product-price-discount", "i", cut_is="new", single="span.product-price"), (), (), "a[href]", "https://www.lafortalezapuq.cl"),
    "updown_juegos": Spec("div.product-element-bottom", "h3.wd-entities-title", WOO_PRICE, ("parent_has:span.out-of-stock",), (), needs="span.price"),
    "ludipuerto": Spec("div.product-grid-item", "h3.wd-entities-title", WOO_PRICE, ("class:outofstock",), ("class:sale", "offer")),
    "cartonespesados": Spec("li.wc-block-product", "h3.wp-block-post-title", replace(WOO_PRICE, within="div.wc-block-components-product-price"), ("class:outofstock",), ("class:onsale", "offer")),
    "elpatiogeek": Spec(
        "div.grid-item",
        "p",
        Pair(
            "",
            "div.sale-tag",
            "div.product-item--price small | div.product-item--price span.h1 span.visually-hidden:last | div.product-item--price span.h1",
            "div.product-item--price small | div.product-item--price span.h1 span.visually-hidden:last | div.product-item--price span.h1",
            if_text=("div.product-item--price span.visually-hidden", "venta"),
        ),
        ("class:sold-out",),
        ("class:on-sale", "offer"),
        "a.product-grid-item",
        "https://www.elpatiogeek.cl",
    ),
    "drjuegos": Spec("article.product-container", "h5.product-name", Pair("", "span.regular-price", "span[class=price product-price]", "span[class=price product-price]"), ("says:div.product-availability",), ("has:div.product-flags",)),
    "piedrabruja": Spec(
        "div.product-card",
        "a.product-card__title",
        Pair("div.price", "span.price__sale", "span.price__regular", "span.price__regular"),
        ("says:button.cowlendar-add-to-cart span[class=hidden md:block]",),
        ("offer", "has:div.badges span.badge--onsale"),
        "title",
        "https://piedrabruja.cl",
    ),
    "magicsur": Spec(
        "article.product-miniature",
        "h2.product-title",
        Pair("div.product-price-and-shipping", "span.regular-price", "span.product-price | span.price", "span.product-price | span.price"),
        ("says:div.product-availability", "says:ul.product-flags"),
        base="https://www.magicsur.cl",
    ),
    "calabozotienda": Spec(
        "div[class=card mb-3 box-shadow]",
        "p.card-text span",
        Pair("", "span[style*=line-through]", "span.font-color", "span.font-color"),
        ("has:span.badge-danger",),
        ("offer", "has:span.burbuja-descuento"),
        "a[href]",
        "https://www.calabozotienda.cl",
    ),
    "cafe2d6": Spec("li.item", "h3", Cut("p.price", "span"), ("class:sold-out", "has:.add-to-agotado"), ("class:on-sale", "offer"), "a[href]", "https://www.cafe2d6.cl"),
    "griffingames": Spec("div.product_item--inner", "h3.product_item--title", WOO_PRICE, ("parent_class:outofstock", "says:a.button"), ("offer", "has:span.onsale")),
    "enroque": Spec(
        "li.js-pagination-result",
        "a.card-link",
        Pair("div.price__default", "s.price__was", "strong.price__current", "strong.price__current"),
        ("has:span.product-label--sold-out", "has:div[class*=price--sold-out]"),
        ("offer", "has:span.product-label--sale"),
        "title",
        "https://juegosenroque.cl",
    ),
    "kaiojuegos": Spec(
        "div.thumbnail-container",
        "h3.product-title",
        Pair("div.product-price-and-shipping", "span.regular-price", "span.price", "span.price"),
        ("says:ul.product-flags", "disabled:button.add-to-cart"),
        ("offer", "text:ul.product-flags=oferta"),
        base="https://kaiojuegos.cl",
    ),
    "manahouse": Spec(
        "div.product-grid-item",
        "a.product-grid-item__title",
        Cut(".product-grid-item__price", "s | del"),
        ("disabled:button[name=add]", "any_says:*[class*=badge]", "any_says:*[class*=label]", "any_says:*[class*=Badge]", "any_says:*[class*=Label]"),
        link="title",
        base="https://manahouse.cl",
    ),
    "devir": Spec(
        "li.product-item",
        "a.product-item-link",
        Pair("div.price-box", "span.old-price span.price", "span.special-price span.price", "span.price", "both"),
        ("text:div.actions-primary=avísame|avisame", "has:div[class=stock unavailable]"),
        link="title",
        base="https://devir.cl",
    ),
    "thirdimpact": Spec(
        "section.grid__item",
        "h3.bs-collection__product-title",
        Pair("div.bs-collection__product-price", "del.bs-collection__old-price", "div[class*=bs-collection__product-final-price]", "div[class*=bs-collection__product-final-price]"),
        ("lacks:button[data-bs=cart.add.collection]", "disabled:button[data-bs=cart.add.collection]"),
        link="a[href]",
        base="https://www.thirdimpact.cl",
    ),
    "buhojuegosdemesa": Spec(
        "a.product-card",
        "div.product-card__name",
        Cut("div.product-card__price", "s", drop="span.visually-hidden"),
        ("says:span.product-card__overlay-btn", "any_says:div.product-tag"),
        link="item",
        base="https://buhojuegosdemesa.cl",
    ),
    "darkhobbies": Spec(
        "product-card",
        "h3.h4 | a[ref=productTitleLink]",
        Pair("product-price", "span.compare-at-price", "span.price", "span.price"),
        ("disabled:button[name=add]", "any_says:.product-badges__badge", "says:button[name=add]"),
        link="a.product-card__link",
        base="https://www.darkhobbies.cl",
    ),
    "shivano": Spec(
        "li.ajax_block_product",
        "a.product-name",
        Pair("div.content_price", "span.old-price", "span.price", "span.price"),
        ("lacks:a.ajax_add_to_cart_button", "says:span.availability"),
        link="title",
        base="https://shivano.cl",
        title_attr="title | span.list-name",
    ),
    "guildreams": Spec(
        "div.bs-product",
        "h2",
        Pair("div.bs-product-price", "div.bs-product-old-price", "div.bs-product-final-price", "div.bs-product-final-price"),
        ("itself_says:", "lacks:button[data-bs=cart.add.collection]"),
        link="a[href]",
        base="https://www.guildreams.com",
    ),
    "jugones": Spec("div.producto", "a.modelo", Cut("a.precio", "small", strip="Antes:", offer_class="oferta"), ("itself_says:",), link="title", base="https://www.jugones.cl"),
    "lautarojuegos": Spec(
        "div.product-block",
        "h4 a",
        Pair("div.list-price", "span.product-block-discount", "span.product-block-normal", "*", "both"),
        ("says:button.adc", "any_says:span.status-tag", "lacks:button.adc"),
        link="title",
        base="https://www.lautarojuegos.cl",
    ),
    "araucania": Spec("li.product", "h3.woocommerce-loop-product__title", Pair("span.price", "del", "ins", "*", "both"), ("class:outofstock", "says:span.stock-label"), link="title:a", base="https://araucaniagaming.cl"),
}
#: Headings and links of articles, for pages that are no shop.
SPECS["article"] = Spec("article", "h1", Pair("", "del", "ins", "bdi"), link="a[href]")
#: The first link of a page.
SPECS["first_link"] = Spec("body", "a[href]", Pair("", "del", "ins", "bdi"), link="title", base="https://base.example")


def says_sold_out(text: str | None) -> bool:
    return any(w in (text or "").lower() for w in SOLD_OUT_WORDS)


def _text(node: Node | None) -> str | None:
    return (node.text() or None) if node is not None else None


def _price(item: Node, rule: Pair | Cut) -> tuple[str | None, str | None]:
    box = find(item, rule.within) if rule.within else item
    if isinstance(rule, Cut):
        if box is None:
            return _text(find(item, rule.single)), None
        dropped = find_all(box, rule.drop) if rule.drop else []
        part = find(box, rule.cut)
        rest = box.text([*dropped, *([part] if part is not None else [])]) or None
        if rule.offer_class and rule.offer_class not in box.classes:
            return rest, None
        cut = (part.text(dropped) or None) if part is not None else None
        if cut and rule.strip:
            cut = cut.replace(rule.strip, "").strip() or None
        if part is None:
            return rest, None
        return (cut, rest) if rule.cut_is == "old" else (rest, cut)
    if box is None:
        return None, None
    old, new = find(box, rule.old), find(box, rule.new)
    if rule.need == "both" and old is not None and new is not None or rule.need == "old" and _text(old) and (not rule.if_text or rule.if_text[1] in (_text(find(item, rule.if_text[0])) or "").lower()):
        return _text(old), _text(new)
    single = None
    for choice in rule.single.split(" | "):
        node = box if choice == "*" else find(box, choice)
        single = _text(node)
        if single:
            break
    if single is None and rule.need == "both" and rule.within == "" and rule.old.startswith("."):
        single = _text(box)
    if single and rule.strip:
        single = single.replace(rule.strip, "").strip() or None
    return None, single


def _pair(original: str | None, current: str | None) -> tuple[str | None, str | None]:
    if original is None:
        return current, None
    return original, None if current == original else current


def _holds(test: str, item: Node, offer: bool) -> bool:
    how, _, what = test.partition(":")
    if how == "offer":
        return offer
    if how == "offer_in":
        return offer and find(item, what) is not None
    if how == "class":
        return what in item.classes
    if how == "parent_class":
        return item.parent is not None and what in item.parent.classes
    if how == "has":
        return find(item, what) is not None
    if how == "parent_has":
        return find(item.parent, what) is not None
    if how == "lacks":
        return find(item, what) is None
    if how == "says":
        return says_sold_out(_text(find(item, what)))
    if how == "any_says":
        return any(says_sold_out(n.text()) for n in find_all(item, what))
    if how == "itself_says":
        return says_sold_out(item.text())
    if how == "disabled":
        node = find(item, what)
        return node is not None and "disabled" in node.attrs
    if how == "text":
        selector, _, words = what.rpartition("=")
        text = (_text(find(item, selector)) or "").lower()
        return any(w in text for w in words.split("|"))
    raise ValueError(f"unknown test {test!r}")


def _link(item: Node, title: Node, rule: str, base: str) -> str | None:
    node = None
    for choice in rule.split(" | "):
        node = item if choice == "item" else title if choice == "title" else find(title, choice[6:]) if choice.startswith("title:") else find(item, choice)
        if node is not None:
            break
    href = node.attrs.get("href") if node is not None else None
    return (href if href.startswith("http") else base + href) if href else None


def extract_card(spec: Spec, item: Node) -> dict | None:
    """The offer of one card; None if it shows none."""
    title = find(item, spec.title)
    if title is None or spec.needs and find(item, spec.needs) is None:
        return None
    name = title.text()
    if spec.title_attr:
        attr, _, other = spec.title_attr.partition(" | ")
        name = title.attrs.get(attr) or _text(find(title, other))
    if spec.title == "p" and not name:
        return None
    original, current = _pair(*_price(item, spec.price))
    gone = any(_holds(t, item, current is not None) for t in spec.gone)
    sale = any(_holds(t, item, current is not None) for t in spec.sale)
    return {"title": name, "original_price": original, "current_price": current, "stock_status": SOLD_OUT if gone else ON_OFFER if sale else None, "url": _link(item, title, spec.link, spec.base)}


def extract_page(spec_name: str, html: str | None) -> list[dict]:
    """The offers of one page, in order. A card that can't be read is left out and logged, never the page; a page of an
    unknown spec has no offers."""
    spec = SPECS.get(spec_name)
    if spec is None:
        logging.warning("no rules for %r: its pages give no offers", spec_name)
        return []
    out = []
    for item in find_all(parse(html), spec.item) if html else []:
        try:
            offer = extract_card(spec, item)
        except Exception as e:  # whatever is wrong with one card must not cost the page
            logging.warning("%s: card left out: %s", spec_name, e)
            continue
        if offer is not None:
            out.append(offer)
    return out


OFFERS = "store string, page int, pos int, title string, original_price string, current_price string, stock_status string, url string"


def extract_offers(pages: DataFrame, specs: DataFrame) -> DataFrame:
    """Offers of captured pages (store, page, html) by their stores' specs (store, spec).

    pos numbers a page's offers. Pages go through Python in Arrow batches without a shuffle; the
    registry is a fixed small table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["store", "page", "pos", "title", "original_price", "current_price", "stock_status", "url"]
        kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 5]
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                store, page, html, spec = (batch.column(k)[i].as_py() for k in range(4))
                rows += [(store, page, pos, *o.values()) for pos, o in enumerate(extract_page(spec, html))]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    joined = pages.join(F.broadcast(specs.select("store", "spec")), "store")
    return joined.select("store", "page", "html", "spec").mapInArrow(run, OFFERS)
