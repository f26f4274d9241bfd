"""Command line: python -m vitrina.cli --name "catan" | --deals | --list | --update."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vitrina.functions.titles import normalize_text
from vitrina.operators import catalog
from vitrina.render import paginate, table_lines


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vitrina", description="Compare product offers of many shops")
    p.add_argument("-u", "--update", action="store_true", help="capture the sites again and merge them")
    p.add_argument("-w", "--workers", type=int, default=20, help="sites captured at a time")
    p.add_argument("--dry-run", action="store_true", help="one page a site")
    p.add_argument("--sites", nargs="+", metavar="NAME", help="sites to update")
    p.add_argument("-n", "--name", metavar="QUERY", help="search for a title")
    p.add_argument("--sort", choices=catalog.SORTS, default="discount")
    p.add_argument("--deals", action="store_true", help="offers with a reduced price")
    p.add_argument("--lower-price", metavar="PRICE")
    p.add_argument("--higher-price", metavar="PRICE")
    p.add_argument("--price", metavar="FROM:TO")
    p.add_argument("--in-stock", action="store_true")
    p.add_argument("--list", action="store_true", help="the whole catalogue")
    p.add_argument("--store", metavar="NAME")
    p.add_argument("--help_info", action="store_true", help="show this help")
    p.add_argument("--data", default="data", help="folder of snapshots")
    p.add_argument("--catalogue", default="data/catalogue", help="Parquet catalogue that updates write and everything else reads")
    return p


def search_mode(offers: DataFrame, query: str, sort: str, ask: Callable[[str], str] = input, show: Callable[[str], None] = print) -> None:
    hits = catalog.search(offers, query).collect()  # a person chooses from them
    if not hits:
        return show(f"Sin resultados para {query!r}")
    for i, hit in enumerate(hits, 1):
        show(f"{i:>3}. {hit['title']}  ({hit['score']:.0f}%)")
    try:
        chosen = int(ask("Número (0 termina): "))
    except ValueError:
        return show("Opción no válida")
    if chosen == 0:
        return None
    if not 1 <= chosen <= len(hits):
        return show("Opción no válida")
    norm = normalize_text(hits[chosen - 1]["title"])
    title = catalog.modal_title(offers, norm).first()["title"]
    paginate(table_lines(catalog.price_table(offers, norm, sort), title or norm), ask, show)


def show_rows(table: DataFrame, title: str, ask: Callable[[str], str] = input, show: Callable[[str], None] = print) -> None:
    n = table.count()
    if not n:
        return show("Sin resultados")
    paginate(table_lines(table, f"{title} ({n})"), ask, show)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, ask: Callable[[str], str] = input, show: Callable[[str], None] = print) -> int:
    p = parser()
    a = p.parse_args(argv)
    if not a.name and (a.deals or a.list) and a.sort not in catalog.LIST_SORTS:
        p.error(f"--sort must be one of {', '.join(catalog.LIST_SORTS)} here")
    if a.help_info or not (a.name or a.deals or a.list or a.update):
        show(p.format_help())
        return 0
    from vitrina.session import local_session
    from vitrina.sources.snapshots import load_offers

    spark = spark or local_session(a.workers if a.update and not (a.name or a.deals or a.list) else "*")
    if a.name:
        search_mode(load_offers(spark, a.data, catalogue=a.catalogue), a.name, a.sort, ask, show)
    elif a.deals:
        rows = catalog.deals(load_offers(spark, a.data, catalogue=a.catalogue), store=a.store, in_stock_only=a.in_stock, lower=a.lower_price, higher=a.higher_price, price=a.price, sort=a.sort)
        show_rows(rows, "Ofertas", ask, show)
    elif a.list:
        show_rows(catalog.list_offers(load_offers(spark, a.data, catalogue=a.catalogue), store=a.store, sort=a.sort, in_stock_only=a.in_stock), "Catálogo", ask, show)
    else:
        from vitrina.sources.sites import site_rows
        from vitrina.update import update

        known = {r[1] for r in site_rows()}
        for name in [s for s in a.sites or [] if s not in known]:
            show(f"Tienda desconocida: {name}")
        wanted = [s for s in a.sites or [] if s in known]
        if a.sites and not wanted:
            return 1
        paginate(table_lines(update(spark, a.catalogue, wanted or None, a.dry_run, a.workers, show), "Resumen"), ask, show)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
