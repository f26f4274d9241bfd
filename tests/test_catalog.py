import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vitrina import cli, render, update
from vitrina.operators import catalog
from vitrina.plans import queries
from vitrina.schema import OFFER, PAGE
from vitrina.sources import captures, sites, snapshots
from vitrina.sources.sites import site_rows
from vitrina.streaming.ingest import ingest_pages

ROWS = [
    ("Catan - Juego de Mesa", "$30.000", "$24.000", "Oferta", "https://a/1", "a", 0, 0),
    ("CATAN", "$32.000", "$30.000", None, "/1", "b", 1, 0),
    ("Catan Big Box", "$66.990", None, "Agotado", "https://a/2", "a", 0, 1),
    ("Azul", "$0", None, "Agotado", "https://b/2", "b", 1, 1),
    ("Azul", None, "$5.000", None, "https://b/2", "b", 1, 2),
]
SCHEMA = "title string, original_price string, current_price string, stock_status string, url string, store string, registry_pos int, row_pos long"


@pytest.fixture(scope="module")
def offers(spark):
    return catalog.with_match_columns(spark.createDataFrame(ROWS, SCHEMA)).cache()


def test_search_and_price_table(offers):
    assert [tuple(r) for r in catalog.search(offers, "catan").collect()] == [("Catan", 100.0), ("Catan Big Box", 100.0)]
    assert catalog.search(offers, "").collect() == []
    table = catalog.price_table(offers, "catan").collect()
    assert [r["Descuento"] for r in table] == ["-20%", "-6%"] and [r["URL"] for r in table] == ["https://a/1", "N/A"]
    assert catalog.modal_title(offers, "catan").first()["title"] == "CATAN"


def test_deals_and_lists(offers):
    assert [r["Producto"] for r in catalog.deals(offers).collect()] == ["Catan", "CATAN", "Azul"]
    assert [r["Oferta"] for r in catalog.deals(offers, price="20.000:25.000", lower="1").collect()] == ["$24.000"]
    assert [r["Oferta"] for r in catalog.deals(offers, lower="24000", sort="offer").collect()] == ["$30.000", "$24.000"]
    assert catalog.list_offers(offers, in_stock_only=True).count() == 3
    assert [r["Disponibilidad"] for r in catalog.list_offers(offers, store="b", sort="price").collect()] == ["Disponible", "Disponible", "Agotado"]
    assert [r["rank"] for r in catalog.ranked(offers, "original").filter("store = 'a'").orderBy("row_pos").collect()] == [1, 2]
    with pytest.raises(ValueError):
        catalog.sort_keys("nothing")


def test_summary_merge_and_sets(spark, offers, tmp_path):
    stores = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "store string, registry_pos int")
    assert [tuple(r) for r in catalog.update_summary(offers, stores).collect()] == [("a", 2, 1, 1), ("b", 3, 2, 1), ("c", 0, 0, 0)]
    fresh = offers.filter("store = 'a'").limit(1)
    merged = catalog.merge_stores(offers, fresh, stores.filter("store <> 'c'"))
    assert merged.count() == 1
    path = str(tmp_path / "catalogue")
    offers.write.partitionBy("store").parquet(path)
    catalog.merge_into(path, spark.createDataFrame(fresh.collect(), fresh.schema), stores.filter("store = 'b' or store = 'a'"))
    assert [r["store"] for r in spark.read.parquet(path).select("store").collect()] == ["a"]
    assert [r["store"] for r in catalog.unknown_stores(spark.createDataFrame([("z",), ("a",), ("z",)], "store string"), stores).collect()] == ["z"]


def test_keep_first(spark):
    rows = spark.createDataFrame([("a", "t", 2, "x"), ("a", "t", 1, "y"), ("a", None, 1, "z")], "store string, title string, pos int, v string")
    got = {(r["title"], r["v"]) for r in catalog.keep_first(rows, ["store", "title"], ["pos"]).collect()}
    assert got == {("t", "y"), (None, "z")}


def test_snapshots(spark, offers, tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    (data / "cartonazo_jdm.csv").write_text('title,original_price,current_price,stock_status,url\n"Catan, ""Big""",$1.000,,,https://x\nAzul - Juego de Mesa,"$12,990",,Agotado,https://y\n', encoding="utf-8")
    (data / "nobody_jdm.csv").write_text("title,original_price,current_price,stock_status,url\nx,,,,\n", encoding="utf-8")
    got = snapshots.load_offers(spark, str(data)).orderBy("row_pos").collect()
    assert [(r["store"], r["title"], r["original_price"], r["current_price"]) for r in got] == [("cartonazo", 'Catan, "Big"', "$1.000", None), ("cartonazo", "Azul", "$12,990", None)]
    (data / "products.json").write_text("{broken", encoding="utf-8")
    assert snapshots.load_offers(spark, str(data)).count() == 2
    (data / "products.json").write_text('{"b": [], "a": [{"title": "Uno", "original_price": "$1", "current_price": null, "stock_status": null, "url": "u"}]}', encoding="utf-8")
    assert [(r["store"], r["title"]) for r in snapshots.load_offers(spark, str(data)).collect()] == [("a", "Uno")]
    assert snapshots.load_offers(spark, str(tmp_path)).count() == 0
    document = snapshots.merged_document(offers, spark.createDataFrame([("a",), ("empty",)], "store string"))
    assert {(r["store"], len(r["offers"])) for r in document.collect()} == {("a", 2), ("empty", 0)}
    snapshots.write_csv(offers, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == len(ROWS)
    parts = [offers.select("store", "title"), spark.createDataFrame([], OFFER)]
    assert snapshots.union_stores(parts).columns == ["store", "title", "original_price", "current_price", "stock_status", "url"]


def test_csv_files_follow_stores_or_rows(spark, tmp_path):
    """Every task has rows of every store: one layout has a file a store, the other a file a task; both read back whole."""
    columns = [*OFFER.names, "store", "row_pos"]
    made = [(f' "T {i}",\nx ', "$1", None if i % 2 else "$2", None, f"u{i}", f"s{i % 40:02}", i // 40) for i in range(400)]
    rows = spark.createDataFrame(made, "title string, original_price string, current_price string, stock_status string, url string, store string, row_pos long").repartition(8)
    want = sorted(map(str, rows.select(OFFER.names).collect()))
    snapshots.write_csv(rows, str(tmp_path / "stores"))
    files = list((tmp_path / "stores").glob("store=*/*.csv"))
    assert len({p.parent for p in files}) == 40 and len(files) <= 40 + 4
    back = snapshots.read_csv(spark, [str(tmp_path / "stores/*/*.csv")])
    assert sorted(map(str, back.select(OFFER.names).collect())) == want
    own = [r["url"] for r in snapshots.read_csv(spark, sorted(map(str, (tmp_path / "stores/store=s07").glob("*.csv")))).orderBy("row_pos").collect()]
    assert own == [f"u{i}" for i in range(7, 400, 40)]
    snapshots.write_csv(rows, str(tmp_path / "rows"), by_store=False)
    assert len(list((tmp_path / "rows").glob("*.csv"))) <= 8
    told = snapshots.read_csv(spark, [str(tmp_path / "rows")], by_store=False)
    assert sorted(map(str, told.select(*columns[:-1]).collect())) == sorted(map(str, rows.select(*columns[:-1]).collect()))


def test_csv_query_writes_no_folder_a_store(spark, sf_dir):
    shelf = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shelf.glob("csv-*"))
    queries.REGISTRY["src_csv_scan"](spark, sf_dir)
    (made,) = set(shelf.glob("csv-*")) - before
    assert list(made.glob("*.csv")) and not [p for p in made.iterdir() if p.is_dir()]


def test_json_round_trip(spark, offers, tmp_path):
    """What the sinks write, as lines or as one document, the scan reads."""
    targets = spark.createDataFrame([("empty", 2), ("b", 1), ("a", 0)], "store string, registry_pos int")
    own = [*OFFER.names, "store", "registry_pos", "row_pos"]
    want = sorted(map(str, offers.select(own).collect()))
    snapshots.write_json(offers, targets, str(tmp_path / "lines"))
    assert sorted(map(str, snapshots.read_json(spark, str(tmp_path / "lines")).select(own).collect())) == want
    assert '"store":"empty"' in "".join(p.read_text() for p in (tmp_path / "lines").glob("*.json"))
    snapshots.write_document(offers, targets, str(tmp_path / "products.json"))
    assert list(json.loads((tmp_path / "products.json").read_text(encoding="utf-8"))) == ["a", "b", "empty"]
    assert sorted(map(str, snapshots.read_json(spark, str(tmp_path / "products.json")).select(own).collect())) == want
    assert snapshots.load_offers(spark, str(tmp_path)).count() == len(ROWS)
    snapshots.write_document(offers, targets.limit(0), str(tmp_path / "none.json"))
    assert (tmp_path / "none.json").read_text() == "{}" and snapshots.load_json(spark, str(tmp_path / "none.json")).count() == 0
    snapshots.write_json(offers, targets.limit(0), str(tmp_path / "no-lines"))
    assert snapshots.load_json(spark, str(tmp_path / "no-lines")).count() == 0


def test_one_rule_for_queries_and_titles(spark):
    """Letters that only full decomposition resolves are found by their own title."""
    odd = catalog.with_match_columns(spark.createDataFrame([("ﬁreball ™", "$1", None, None, "u", "a", 0, 0), (None, "$1", None, None, "u", "a", 0, 1), ("ﬁreball ™", "$2", None, None, "u", "a", 0, 2)], SCHEMA))
    assert odd.count() == 3 and [r["title"] for r in catalog.search(odd, "ﬁreball ™").collect()] == ["ﬁreball ™"]
    asked = spark.createDataFrame([("fireball tm",), ("ﬁreball ™",), ("",), ("nothing like it",)], "query string")
    for block in (10_000, 1):
        assert sorted(r["query"] for r in catalog.search_many(odd, asked, block=block).collect()) == ["fireball tm", "ﬁreball ™"]


def test_equal_prices_keep_the_load_order(spark):
    rows = [(f"t{9 - i}", "$10.000", None, None, "u", "ab"[i % 2], i % 2, i) for i in range(10)]
    got = catalog.sort_offers(catalog.with_match_columns(spark.createDataFrame(rows, SCHEMA)), "price").collect()
    assert [(r["registry_pos"], r["row_pos"]) for r in got] == sorted((i % 2, i) for i in range(10))


def card(title):
    return f'<li class="product"><h2 class="woocommerce-loop-product__title">{title}</h2><span class="price"><bdi>$1</bdi></span></li>'


def test_urls_and_reader():
    assert sites.build_url("B", "product-page", 2) == "B?product-page=2" and sites.build_url("B?x", "product-page", 2) == "B?x&product-page=2"
    assert sites.build_url("B", "devir", 1) == "B"
    with pytest.raises(ValueError):
        sites.build_url("B", "devir", 2)
    seen = {"https://mirzu.cl/tienda": card("a"), "https://mirzu.cl/tienda/page/2/": card("b"), "https://mirzu.cl/tienda/page/3/": card("b")}
    reader = captures.SiteReader([r for r in sites.site_rows() if r[1] == "mirzu"], 9, 0, seen.get)
    assert [(p, bool(h)) for _, p, _, h in reader.read(reader.partitions()[0])] == [(1, True), (2, True)]
    failing = captures.SiteReader([r for r in sites.site_rows() if r[1] == "mirzu"], 9, 0, {"https://mirzu.cl/tienda": card("a")}.get)
    assert [(p, bool(h)) for _, p, _, h in failing.read(failing.partitions()[0])] == [(1, True), (2, False)]


def test_reader_has_no_last_page():
    """A shop of 450 listing pages is read whole unless max_pages is given."""

    def shop(url):
        page = int(url.rstrip("/").rsplit("/", 1)[1]) if "/page/" in url else 1
        return card(f"t{page}") if page <= 450 else "<html></html>"

    for options, last in (({}, 450), ({"max_pages": "3"}, 3), ({"dry_run": "true"}, 1)):
        reader = captures.SiteSource({"sites": "mirzu", "pause": "0", **options}).reader(None)
        reader.get, reader.pause = shop, 0
        assert [p for _, p, _, _ in reader.read(reader.partitions()[0])] == list(range(1, last + 1))


def test_stop_rule_and_stream(spark, tmp_path):
    pages = [("mirzu", 1, "u", card("a") + card("a")), ("mirzu", 2, "u", card("b")), ("mirzu", 3, "u", card("b")), ("mirzu", 4, "u", card("c")), ("ludi", 1, "u", None), ("ludi", 2, "u", card("d"))]
    source = tmp_path / "pages"
    spark.createDataFrame(pages, PAGE).write.parquet(str(source))
    ingest_pages(spark, str(source), str(tmp_path / "cat"), str(tmp_path / "ck")).awaitTermination(60)
    assert sorted((r["store"], r["title"]) for r in spark.read.parquet(str(tmp_path / "cat")).collect()) == [("mirzu", "a"), ("mirzu", "b")]


def test_pages_of_a_store_arrive_in_batches(spark, tmp_path):
    """Page 1 in one run, page 2 in the next, page 1 again in a third: the catalogue holds both pages, the newest of each."""
    source, cat = tmp_path / "pages", str(tmp_path / "cat")

    def arrive(*pages):
        spark.createDataFrame(pages, PAGE).coalesce(1).write.mode("append").parquet(str(source))
        ingest_pages(spark, str(source), cat, str(tmp_path / "ck")).awaitTermination(60)
        spark.catalog.clearCache()
        return sorted((r["store"], r["title"]) for r in spark.read.parquet(cat).collect())

    assert arrive(("mirzu", 1, "u", card("a")), ("ludi", 1, "u", card("x"))) == [("ludi", "x"), ("mirzu", "a")]
    assert arrive(("mirzu", 2, "u", card("b"))) == [("ludi", "x"), ("mirzu", "a"), ("mirzu", "b")]
    assert arrive(("mirzu", 1, "u", card("c")), ("mirzu", 3, "u", card("d"))) == [("ludi", "x"), ("mirzu", "b"), ("mirzu", "c"), ("mirzu", "d")]


def test_update_captures_once_and_the_command_line_reads_it(spark, tmp_path, monkeypatch):
    """A shop that answers differently each time is asked once; what an update writes is what searches and lists show."""
    log = tmp_path / "asked"
    log.touch()
    shown = card("TITLE")

    def shops(spark, names=None, dry_run=False, workers=None):
        def ask(rows):
            for store, page in rows:
                with open(log, "a") as f:
                    f.write(store)
                yield (store, page, "u", shown.replace("TITLE", f"{store} {page} asked {log.stat().st_size}"))

        pages = [(n, p) for n in names for p in (1, 2)]
        return spark.createDataFrame(spark.sparkContext.parallelize(pages, 1).mapPartitions(ask), PAGE)

    monkeypatch.setattr(update, "capture", shops)
    cat = str(tmp_path / "data" / "catalogue")
    said = []
    got = update.update(spark, cat, ["mirzu"], show=said.append).collect()
    assert [tuple(r) for r in got] == [("mirzu", 2, 0, 0)] and log.read_text() == "mirzu" * 2 and "mirzu: 2 páginas" in said[0]
    update.update(spark, cat, ["ludi"]).collect()
    spark.catalog.clearCache()
    rows = snapshots.load_offers(spark, str(tmp_path / "data"), catalogue=cat)
    assert sorted({r["store"] for r in rows.collect()}) == ["ludi", "mirzu"] and rows.count() == 4
    out = []
    assert cli.main(["--list", "--data", str(tmp_path / "data"), "--catalogue", cat], spark, lambda _: "", out.append) == 0
    assert sum("asked" in x for x in out) == 4 or any("mirzu 1" in x for x in out)
    out.clear()
    cli.main(["-n", "ludi 2 asked", "--data", str(tmp_path / "data"), "--catalogue", cat], spark, lambda _: "1", out.append)
    assert any("ludi 2" in x for x in out)
    monkeypatch.setattr(update, "capture", lambda spark, *_: spark.createDataFrame([("mirzu", 1, "u", None)], PAGE))
    assert [tuple(r) for r in update.update(spark, cat, ["mirzu"]).collect()] == [("mirzu", 0, 0, 0)]
    assert snapshots.load_catalogue(spark, str(tmp_path / "nowhere")) is None


def test_workers_share_the_sites():
    rows = site_rows()
    assert len(captures.SiteReader(rows, 1, 0).partitions()) == len(rows)
    dealt = captures.SiteSource({"workers": "4"}).reader(None).partitions()
    assert len(dealt) == 4 and sorted(x[0] for p in dealt for x in p.chosen) == sorted(r[1] for r in rows)


def test_render_and_cli(spark, tmp_path):
    table = spark.createDataFrame([("Un producto de nombre bastante largo", None)], "Producto string, Oferta string")
    lines = list(render.table_lines(table, "T"))
    assert lines[0] == "\nT" and lines[1].startswith("Producto") and lines[-1] == "" and all(len(x) <= 28 for x in lines[1:])
    shown = []
    render.paginate(iter("abc"), lambda _: "q", shown.append, 2)
    assert shown == ["a", "b"]
    data = tmp_path / "d"
    data.mkdir()
    (data / "ludi_jdm.csv").write_text("title,original_price,current_price,stock_status,url\nCatan,$2.000,$1.000,,https://x\n", encoding="utf-8")
    out = []
    assert cli.main(["--deals", "--data", str(data)], spark, lambda _: "", out.append) == 0 and any("-50%" in x for x in out)
    out.clear()
    cli.main(["-n", "catan", "--data", str(data)], spark, lambda _: "1", out.append)
    assert any("100%" in x for x in out) and any("https://x" in x for x in out)
    out.clear()
    cli.main(["--list", "--store", "none", "--data", str(data), "--catalogue", str(data / "none")], spark, lambda _: "", out.append)
    assert out == ["Sin resultados"]
    with pytest.raises(SystemExit):
        cli.main(["--deals", "--sort", "store"], spark)
