"""Cards as each shop lays them out, one query for each site's rules.

The cards are written by hand from what the shops' pages look like, not from the rules that read them. Each part is a
product: plain, on offer, sold out, or both. {p} stands for the price, {g} for what says whether it is sold out, {G} for more
classes of the card, {t} {o} {c} {u} for title, old and new price and address.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrina.operators import extract


class Layout(NamedTuple):
    card: str
    plain: str
    offer: str
    #: What {g} and {G} are for products to be had and sold out ones; without any the shop never says so.
    alive: str = ""
    gone: str = ""
    gone_class: str = ""
    base: str = ""
    #: Whether an offer is marked as one.
    marks: bool = True


WOO_PLAIN, WOO_OFFER = "<bdi>{o}</bdi>", "<del>{o}</del> <ins>{c}</ins>"
WOO = Layout('<ul><li class="product{G}"><a href="/decoy">d</a><a class="woocommerce-LoopProduct-link" href="{u}"><h2 class="woocommerce-loop-product__title">{t}</h2></a><span class="price">{p}</span>{g}</li></ul>', WOO_PLAIN, WOO_OFFER, gone_class=" outofstock")
ASTRA = WOO._replace(card=WOO.card.replace("woocommerce-LoopProduct-link", "ast-loop-product__link"))
PRESTA = Layout('<article class="product-miniature"><h2 class="product-title"><a href="{u}">{t}</a></h2>{p}<ul class="product-flags">{g}</ul></article>', '<span class="price">{o}</span>', '<span class="regular-price">{o}</span><span class="price">{c}</span>', gone='<li class="out_of_stock">x</li>')
FINAL = '<div class="bs-collection__product-final-price">{}</div>'
GRID = Layout(
    '<section class="grid__item"><h3 class="bs-collection__product-title"><a href="{u}">{t}</a></h3><div class="bs-collection__product-price">{p}</div>{g}</section>',
    FINAL.format("{o}"),
    '<del class="bs-collection__old-price">{o}</del>' + FINAL.format("{c}"),
    gone='<div class="bs-stock">Agotado</div>',
)
BLOCK_PLAIN, BLOCK_OFFER = '<div class="product-block__price">{o}</div>', '<div class="product-block__price--old">{o}</div><div class="product-block__price--new">{c}</div>'
BLOCK = Layout('<article class="product-block"><a class="product-block__name" href="{u}">{t}</a>{p}{g}</article>', BLOCK_PLAIN, BLOCK_OFFER, gone='<div class="product-block__label">Sin stock</div>')
PRICED = Layout('<article class="product-block"><a class="product-block__name" href="{u}">{t}</a><div class="product-block__pricing">{p}</div>{g}</article>', BLOCK_PLAIN, BLOCK_OFFER, gone='<div class="product-block__label--status">Agotado</div>')
OLD_PRICE = '<span class="regular-price">{o}</span><span class="price">{c}</span>'

LAYOUTS: dict[str, Layout] = {
    **dict.fromkeys(("cartonazo", "laloseta", "lamadriguera", "ludi", "playlander", "kimunaustral", "tertulia", "carontejuegosdemesa", "labovedadelmago"), WOO),
    **dict.fromkeys(("mangaigames", "playcenter", "mirzu"), ASTRA),
    "revaruk": ASTRA._replace(gone='<span class="ast-shop-product-out-of-stock">Agotado</span>', gone_class=""),
    "gatoarcano": Layout('<ul><li class="product"><a href="{u}"><h2 class="woocommerce-loop-product__title">{t}</h2></a><span class="price">{p}</span>{g}</li></ul>', WOO_PLAIN, WOO_OFFER, gone='<span class="now_sold">x</span>'),
    **dict.fromkeys(("aldeajuegos", "lamesadevaras"), PRESTA),
    "planetaloz": PRESTA._replace(card=PRESTA.card.replace("h2", "h1")),
    "dementegames": PRESTA._replace(gone='<li class="out-of-stock">x</li>'),
    "top8": GRID._replace(base="https://www.top8.cl"),
    "gameofmagictienda": GRID._replace(base="https://www.gameofmagictienda.cl", gone='<div class="bs-collection__product-notice">Sin stock</div>'),
    "peakgames": GRID._replace(base="https://www.peakgames.cl", gone='<div class="bs-collection__stock">No disponible</div>'),
    "wargaming": GRID._replace(base="https://www.wargaming.cl", gone='<div class="bs-collection__product outStock">x</div>'),
    "cardgame": GRID._replace(base="https://www.cardgame.cl", card=GRID.card.replace('<section class="grid__item">', '<div class="bs-collection__product">').replace("</section>", "</div>")),
    "vudugaming": BLOCK._replace(base="https://www.vudugaming.cl"),
    "zonaxgamers": BLOCK._replace(
        base="https://zonaxgamers.cl",
        card=BLOCK.card.replace('<article class="product-block">', '<div class="product-block__wrapper">').replace("</article>", "</div>"),
        alive='<button class="product-block__button--add-to-cart">x</button>',
        gone='<button class="product-block__button--add-to-cart" disabled>x</button>',
    ),
    "playkingdom": PRICED._replace(base="https://playkingdom.cl"),
    "juegosdelbosque": PRICED._replace(base="https://www.juegosdelbosque.cl"),
    "flexogames": Layout(
        '<ul><li class="grid__item"><a class="grid-view-item__link" href="{u}">x</a><div class="grid-view-item__title">{t}</div>{g}{p}</li></ul>',
        '<div class="price__regular"><span class="price-item--regular">{o}</span></div>',
        '<div class="price__compare"><s>{o}</s></div><span class="price-item--sale">{c}</span>',
        '<dl class="price"></dl>',
        '<dl class="price price--sold-out"></dl>',
        base="https://www.flexogames.cl",
        marks=False,
    ),
    "lafortalezapuq": Layout('<figure class="product"><a href="{u}">x</a><h5>{t}</h5>{p}</figure>', '<span class="product-price">{o}</span>', '<span class="product-price-discount">{o}<i>{c}</i></span>', base="https://www.lafortalezapuq.cl", marks=False),
    "updown_juegos": Layout('<div><div class="product-element-bottom"><h3 class="wd-entities-title"><a href="{u}">{t}</a></h3><span class="price">{p}</span></div>{g}</div>', WOO_PLAIN, WOO_OFFER, gone='<span class="out-of-stock">x</span>', marks=False),
    "ludipuerto": Layout('<div class="product-grid-item{G}"><h3 class="wd-entities-title"><a href="{u}">{t}</a></h3><span class="price">{p}</span></div>', WOO_PLAIN, WOO_OFFER, gone_class=" outofstock"),
    "cartonespesados": Layout('<ul><li class="wc-block-product{G}"><h3 class="wp-block-post-title"><a href="{u}">{t}</a></h3><div class="wc-block-components-product-price">{p}</div></li></ul>', WOO_PLAIN, WOO_OFFER, gone_class=" outofstock"),
    "elpatiogeek": Layout(
        '<div class="grid-item{G}"><a class="product-grid-item" href="{u}"><p>{t}</p></a>{p}</div>',
        '<div class="product-item--price"><small>{o}</small></div>',
        '<div class="product-item--price"><span class="visually-hidden">Precio de venta</span><small>{c}</small></div><div class="sale-tag">{o}</div>',
        gone_class=" sold-out",
        base="https://www.elpatiogeek.cl",
    ),
    "drjuegos": Layout(
        '<article class="product-container"><h5 class="product-name"><a href="{u}">{t}</a></h5>{p}<div class="product-availability">{g}</div></article>',
        '<span class="price product-price">{o}</span>',
        '<span class="regular-price">{o}</span><span class="price product-price">{c}</span><div class="product-flags">x</div>',
        gone="Agotado",
    ),
    "piedrabruja": Layout(
        '<div class="product-card"><a class="product-card__title" href="{u}">{t}</a><div class="price">{p}</div><button class="cowlendar-add-to-cart"><span class="hidden md:block">{g}</span></button></div>',
        '<span class="price__regular">{o}</span>',
        '<span class="price__sale">{o}</span><span class="price__regular">{c}</span>',
        "Comprar",
        "Agotado",
        base="https://piedrabruja.cl",
    ),
    "magicsur": Layout(
        '<article class="product-miniature"><h2 class="product-title"><a href="{u}">{t}</a></h2><div class="product-price-and-shipping">{p}</div>{g}</article>',
        '<span class="product-price">{o}</span>',
        '<span class="regular-price">{o}</span><span class="product-price">{c}</span>',
        gone='<div class="product-availability">Fuera de stock</div>',
        base="https://www.magicsur.cl",
    ),
    "calabozotienda": Layout(
        '<div class="card mb-3 box-shadow"><a href="{u}">x</a><p class="card-text"><span>{t}</span></p>{p}{g}</div>',
        '<span class="font-color">{o}</span>',
        '<span style="text-decoration:line-through">{o}</span><span class="font-color">{c}</span>',
        gone='<span class="badge-danger">x</span>',
        base="https://www.calabozotienda.cl",
    ),
    "cafe2d6": Layout('<ul><li class="item{G}"><a href="{u}">x</a><h3>{t}</h3><p class="price">{p}</p></li></ul>', "{o}", "<span>{o}</span> {c}", gone_class=" sold-out", base="https://www.cafe2d6.cl"),
    "griffingames": Layout('<div class="card{G}"><div class="product_item--inner"><h3 class="product_item--title"><a href="{u}">{t}</a></h3><span class="price">{p}</span></div></div>', WOO_PLAIN, WOO_OFFER, gone_class=" outofstock"),
    "enroque": Layout(
        '<ul><li class="js-pagination-result"><a class="card-link" href="{u}">{t}</a><div class="price__default">{p}</div>{g}</li></ul>',
        '<strong class="price__current">{o}</strong>',
        '<s class="price__was">{o}</s><strong class="price__current">{c}</strong>',
        gone='<span class="product-label--sold-out">x</span>',
        base="https://juegosenroque.cl",
    ),
    "kaiojuegos": Layout('<div class="thumbnail-container"><h3 class="product-title"><a href="{u}">{t}</a></h3><div class="product-price-and-shipping">{p}</div><ul class="product-flags"><li>{g}</li></ul></div>', '<span class="price">{o}</span>', OLD_PRICE, gone="Agotado", base="https://kaiojuegos.cl"),
    "manahouse": Layout(
        '<div class="product-grid-item"><a class="product-grid-item__title" href="{u}">{t}</a><div class="product-grid-item__price">{p}</div>{g}</div>',
        "{o}",
        "<s>{o}</s> {c}",
        '<button name="add">x</button>',
        '<button name="add" disabled>x</button>',
        base="https://manahouse.cl",
    ),
    "devir": Layout(
        '<ul><li class="product-item"><a class="product-item-link" href="{u}">{t}</a><div class="price-box">{p}</div><div class="actions-primary">{g}</div></li></ul>',
        '<span class="price">{o}</span>',
        '<span class="old-price"><span class="price">{o}</span></span><span class="special-price"><span class="price">{c}</span></span>',
        "Agregar",
        "Avísame",
        base="https://devir.cl",
    ),
    "thirdimpact": GRID._replace(
        card='<section class="grid__item"><a href="{u}">x</a><h3 class="bs-collection__product-title">{t}</h3><div class="bs-collection__product-price">{p}</div>{g}</section>',
        alive='<button data-bs="cart.add.collection">x</button>',
        gone='<button data-bs="cart.add.collection" disabled>x</button>',
        base="https://www.thirdimpact.cl",
    ),
    "buhojuegosdemesa": Layout(
        '<a class="product-card" href="{u}"><div class="product-card__name">{t}</div><div class="product-card__price"><span class="visually-hidden">Precio</span>{p}</div>{g}</a>',
        "{o}",
        "<s>{o}</s> {c}",
        gone='<div class="product-tag">Agotado</div>',
        base="https://buhojuegosdemesa.cl",
    ),
    "darkhobbies": Layout(
        '<product-card><a class="product-card__link" href="{u}">x</a><h3 class="h4">{t}</h3><product-price>{p}</product-price>{g}</product-card>',
        '<span class="price">{o}</span>',
        '<span class="compare-at-price">{o}</span><span class="price">{c}</span>',
        gone='<span class="product-badges__badge">Agotado</span>',
        base="https://www.darkhobbies.cl",
    ),
    "shivano": Layout(
        '<ul><li class="ajax_block_product"><a class="product-name" title="{t}" href="{u}"><span class="list-name">x</span></a><div class="content_price">{p}</div>{g}</li></ul>',
        '<span class="price">{o}</span>',
        '<span class="old-price">{o}</span><span class="price">{c}</span>',
        '<a class="ajax_add_to_cart_button">x</a>',
        '<span class="availability">Agotado</span>',
        base="https://shivano.cl",
    ),
    "guildreams": Layout(
        '<div class="bs-product"><a href="{u}"><h2>{t}</h2></a><div class="bs-product-price">{p}</div>{g}</div>',
        '<div class="bs-product-final-price">{o}</div>',
        '<div class="bs-product-old-price">{o}</div><div class="bs-product-final-price">{c}</div>',
        '<button data-bs="cart.add.collection">x</button>',
        "<i>x</i>",
        base="https://www.guildreams.com",
    ),
    "jugones": Layout('<div class="producto"><a class="modelo" href="{u}">{t}</a>{p}{g}</div>', '<a class="precio">{o}</a>', '<a class="precio oferta"><small>Antes: {o}</small>{c}</a>', gone="<b>Agotado</b>", base="https://www.jugones.cl"),
    "lautarojuegos": Layout(
        '<div class="product-block"><h4><a href="{u}">{t}</a></h4><div class="list-price">{p}</div>{g}</div>',
        "{o}",
        '<span class="product-block-discount">{o}</span><span class="product-block-normal">{c}</span>',
        '<button class="adc">Agregar</button>',
        '<button class="adc">Agotado</button>',
        base="https://www.lautarojuegos.cl",
    ),
    "araucania": Layout('<ul><li class="product{G}"><h3 class="woocommerce-loop-product__title"><a href="{u}">{t}</a></h3><span class="price">{p}</span></li></ul>', "{o}", "<del>{o}</del><ins>{c}</ins>", gone_class=" outofstock", base="https://araucaniagaming.cl"),
}

PRODUCTS_SQL = """WITH k AS (
  SELECT p_partkey, p_name AS t, '$' || replace(format('{:,}', floor(p_retailprice)::BIGINT), ',', '.') AS o, '$' || replace(format('{:,}', floor(p_retailprice * 0.8)::BIGINT), ',', '.') AS c,
    CASE WHEN p_partkey % 3 = 0 THEN 'https://shop.example/p/' ELSE '/p/' END || p_partkey AS u, p_partkey % 2 = 1 AS offer, p_partkey % 4 >= 2 AS gone
  FROM part)"""


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as a product (PRODUCTS_SQL)."""
    price = lambda x: F.concat(F.lit("$"), F.replace(F.format_number(F.floor(x), 0), F.lit(","), F.lit(".")))
    key = F.col("p_partkey")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        key,
        F.col("p_name").alias("t"),
        price(F.col("p_retailprice")).alias("o"),
        price(F.col("p_retailprice") * 0.8).alias("c"),
        F.concat(F.when(key % 3 == 0, "https://shop.example/p/").otherwise("/p/"), key.cast("string")).alias("u"),
        (key % 2 == 1).alias("offer"),
        (key % 4 >= 2).alias("gone"),
    )


def written(layout: Layout) -> Column:
    """A product as a card."""
    either = lambda test, yes, no: F.when(F.col(test), F.lit(yes)).otherwise(F.lit(no))
    out = F.lit(layout.card)
    for mark, value in (("{p}", either("offer", layout.offer, layout.plain)), ("{g}", either("gone", layout.gone, layout.alive)), ("{G}", either("gone", layout.gone_class, "")), *[("{" + c + "}", F.col(c)) for c in "tocu"]):
        out = F.replace(out, F.lit(mark), value)
    return out


def read_cards(spark: SparkSession, sf_dir: str, site: str) -> DataFrame:
    """The offers that a site's rules read from cards in its layout."""
    pages = products(spark, sf_dir).select(F.lit(site).alias("store"), F.col("p_partkey").cast("int").alias("page"), written(LAYOUTS[site]).alias("html"))
    specs = spark.createDataFrame([(site, site)], "store string, spec string")
    return extract.extract_offers(pages, specs).drop("store", "pos")


def expected_sql(layout: Layout) -> str:
    says_gone = "gone" if layout.gone or layout.gone_class else "false"
    says_offer = "offer AND c <> o" if layout.marks else "false"
    return (
        f"{PRODUCTS_SQL} SELECT p_partkey::INT AS page, t AS title, o AS original_price, CASE WHEN offer AND c <> o THEN c END AS current_price, "
        f"CASE WHEN {says_gone} THEN 'Agotado' WHEN {says_offer} THEN 'Oferta' END AS stock_status, CASE WHEN starts_with(u, 'http') THEN u ELSE '{layout.base}' || u END AS url FROM k"
    )
