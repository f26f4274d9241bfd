"""The site registry and the URLs of a site's pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Site, its catalogue, its page style; in registry order. The extraction spec and the
#: snapshot file carry the site's name unless NAMES says otherwise.
SITES = [
    ("flexo", "https://www.flexogames.cl/collections/juegos-de-mesa", "shopify"),
    ("lafortalezapuq", "https://www.lafortalezapuq.cl/jdm", "shopify"),
    ("planetaloz", "https://www.planetaloz.cl/14-juegos-de-mesa", "page_param"),
    ("updown", "https://www.updown.cl/categoria-producto/juegos-de-mesa", "woo"),
    ("aldeajuegos", "https://www.aldeajuegos.cl/7-juegos-de-mesa", "page_param"),
    ("elpatiogeek", "https://www.elpatiogeek.cl/collections/all", "shopify"),
    ("mangaigames", "https://mangaigames.cl/tienda", "woo"),
    ("cartonespesados", "https://cartonespesados.cl/product-category/juegos-de-mesa", "woo"),
    ("cartonazo", "https://cartonazo.com/categoria-producto/juego-de-mesa", "woo"),
    ("dementegames", "https://dementegames.cl/10-juegos-de-mesa", "page_param"),
    ("drjuegos", "https://www.drjuegos.cl/2-todos-los-productos", "page_param"),
    ("vudugaming", "https://www.vudugaming.cl/juegos-de-mesa", "page_param"),
    ("piedrabruja", "https://piedrabruja.cl/collections/juegos-de-mesa", "shopify"),
    ("gatoarcano", "https://gatoarcano.cl/product-category/juegos-de-mesa", "gatoarcano"),
    ("ludipuerto", "https://www.ludipuerto.cl/categoria-producto/juegos-de-mesa", "woo"),
    ("magicsur", "https://www.magicsur.cl/15-juegos-de-mesa-magicsur-chile", "page_param"),
    ("gameofmagictienda", "https://www.gameofmagictienda.cl/collection/juegos-de-mesa", "page_param"),
    ("top8", "https://www.top8.cl/collection/juegos-de-mesa", "page_param"),
    ("revaruk", "https://revaruk.cl/product-category/juegos-de-mesa", "woo"),
    ("cardgame", "https://www.cardgame.cl/collection/juegos-de-mesa", "page_param"),
    ("labovedadelmago", "https://www.labovedadelmago.cl/categoria-producto/juegos-de-mesa", "woo"),
    ("calabozotienda", "https://www.calabozotienda.cl/tienda/familia/JUEGOS%20DE%20MESA", "calabozo"),
    ("zonaxgamers", "https://zonaxgamers.cl/juegos-de-mesa", "page_param"),
    ("cafe2d6", "https://www.cafe2d6.cl/collections/all", "shopify"),
    ("griffingames", "https://www.griffingames.cl/categoria-producto/juegos-de-mesa", "woo"),
    ("playcenter", "https://playcenter.cl/categoria-producto/juegos-de-mesa", "woo"),
    ("enroque", "https://juegosenroque.cl/collections/todos-los-juegos-de-mesa", "shopify"),
    ("kaiojuegos", "https://kaiojuegos.cl/18-juegos-de-mesa", "page_param"),
    ("manahouse", "https://manahouse.cl/collections/juegos-de-mesa", "shopify"),
    ("devir", "https://devir.cl/juegos-de-mesa", "p"),
    ("thirdimpact_asmodee", "https://www.thirdimpact.cl/brand/asmodee", "page_param"),
    ("thirdimpact_devir", "https://www.thirdimpact.cl/brand/devir", "page_param"),
    ("buho", "https://buhojuegosdemesa.cl/collections/catalogo", "shopify"),
    ("mirzu", "https://mirzu.cl/tienda", "woo"),
    ("peakgames", "https://www.peakgames.cl/collection/juegos-de-mesa", "page_param"),
    ("laloseta", "https://laloseta.cl/categoria-producto/juego-de-mesa", "woo"),
    ("lamadriguera", "https://tiendalamadriguera.cl/product-category/juegos-de-mesa", "woo"),
    ("lamesadevaras", "https://lamesadevaras.cl/9-juegos-de-mesa", "page_param"),
    ("ludi", "https://www.ludi.cl/tienda", "product-page"),
    ("wargaming", "https://www.wargaming.cl/collection/juegos-de-mesa", "page_param"),
    ("darkhobbies", "https://www.darkhobbies.cl/collections/all", "shopify"),
    ("shivano", "https://shivano.cl/12-juegos-de-mesa", "p"),
    ("playlander", "https://playlander.cl/categoria-producto/juegosdemesa", "woo"),
    ("guildreams", "https://www.guildreams.com/collection/juegos-de-mesa", "page_param"),
    ("playkingdom", "https://playkingdom.cl/juegos-de-mesa", "page_param"),
    ("juegosdelbosque", "https://www.juegosdelbosque.cl/categorias", "page_param"),
    ("kimunaustral", "https://kimunaustral.cl/shop", "woo"),
    ("jugones", "https://www.jugones.cl/juegos-de-mesa", "page_param"),
    ("tertulia", "https://tertulia.cl/categoria-producto/juego-de-mesa", "product-page"),
    ("lautarojuegos", "https://www.lautarojuegos.cl/juegos-de-mesa", "page_param"),
    ("araucania", "https://araucaniagaming.cl/productos/juegosdemesa", "woo"),
    ("carontejuegosdemesa", "https://carontejuegosdemesa.cl/categoria-producto/juego-de-mesa", "woo"),
]
#: Site -> (spec, file stem) where they differ from its name.
NAMES = {
    "flexo": ("flexogames", "flexogames"),
    "updown": ("updown_juegos", "updown"),
    "thirdimpact_asmodee": ("thirdimpact", "thirdimpact_asmodee"),
    "thirdimpact_devir": ("thirdimpact", "thirdimpact_devir"),
    "buho": ("buhojuegosdemesa", "buho"),
    "lamadriguera": ("lamadriguera", "tiendalamadriguera"),
    "carontejuegosdemesa": ("carontejuegosdemesa", "caronte"),
}
STYLES = ("shopify", "page_param", "p", "woo", "product-page", "gatoarcano", "calabozo")


def site_rows() -> list[tuple[int, str, str, str, str, str]]:
    """registry_pos, store, base_url, spec, pagination, output file."""
    return [(i, name, url, NAMES.get(name, (name, name))[0], style, f"{NAMES.get(name, (name, name))[1]}_jdm.csv") for i, (name, url, style) in enumerate(SITES)]


def sites(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(site_rows(), "registry_pos int, store string, base_url string, spec string, pagination string, output string")


def page_url(base: Column, style: Column, page: Column) -> Column:
    """The address of a page; null for an unknown style beyond page 1."""
    n = page.cast("string")
    joiner = F.when(base.contains("?"), "&").otherwise("?")
    return (
        F.when(style == "gatoarcano", F.concat(base, F.lit("/?jsf=epro-archive-products&pagenum="), n))
        .when(style == "calabozo", F.concat(base, F.lit("/"), n))
        .when(page == 1, base)
        .when(style.isin("shopify", "page_param"), F.concat(base, F.lit("?page="), n))
        .when(style == "p", F.concat(base, F.lit("?p="), n))
        .when(style == "woo", F.concat(base, F.lit("/page/"), n, F.lit("/")))
        .when(style == "product-page", F.concat(base, joiner, F.lit("product-page="), n))
    )


def build_url(base: str, style: str, page: int) -> str:
    """The same for one page; an unknown style beyond page 1 is an error."""
    if style == "gatoarcano":
        return f"{base}/?jsf=epro-archive-products&pagenum={page}"
    if style == "calabozo":
        return f"{base}/{page}"
    if page == 1:
        return base
    forms = {"shopify": "?page={}", "page_param": "?page={}", "p": "?p={}", "woo": "/page/{}/", "product-page": ("&" if "?" in base else "?") + "product-page={}"}
    if style not in forms:
        raise ValueError(f"unknown pagination style {style!r}")
    return base + forms[style].format(page)


def page_urls(site_table: DataFrame, pages: int) -> DataFrame:
    """store, page, url of the first pages of each site."""
    each = site_table.select("store", "base_url", "pagination", F.explode(F.sequence(F.lit(1), F.lit(pages))).alias("page"))
    return each.select("store", "page", page_url(F.col("base_url"), F.col("pagination"), F.col("page")).alias("url"))
