import pytest

from akin.schemas import RAW_ITEM
from akin.sources import catalog


def raw(spark, rows):
    names = [f.name for f in RAW_ITEM.fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], RAW_ITEM)


@pytest.fixture()
def items(spark):
    return raw(spark, [{"id": i, "name": f"n{i}"} for i in range(100, 0, -1)])


@pytest.mark.parametrize("small", [100_000, 0])
@pytest.mark.parametrize("cap, n", [(15, 20), (20, 20), (1, 10), (0, 100), (None, 100), (500, 100)])
def test_a_cap_is_rounded_up_to_whole_pages(items, monkeypatch, small, cap, n):
    monkeypatch.setattr(catalog, "SMALL_LIMIT", small)
    found = catalog.capped(items, 10, cap)
    assert sorted(r.id for r in found.collect()) == list(range(1, n + 1))


@pytest.mark.parametrize("small", [100_000, 0])
def test_page(items, monkeypatch, small):
    monkeypatch.setattr(catalog, "SMALL_LIMIT", small)
    rows = catalog.page(items, offset=95, limit=10).collect()
    assert [r.id for r in rows] == [96, 97, 98, 99, 100]
    assert {(r.total, r["offset"], r["limit"]) for r in rows} == {(100, 95, 10)}
    assert catalog.page(items, offset=100, limit=10).collect() == []


def test_prepare_flattens_and_falls_back(spark):
    rows = [
        {"id": 1, "name": "A", "genres": ["Drama"], "summary": "<p>x</p>", "rating": (8.5,),
         "network": ("Nova",), "webchannel": ("Web",)},
        {"id": 2, "name": "B", "genres": [], "rating": (None,), "webchannel": ("Web",)},
        {"id": 3, "name": "C", "network": (None,), "rating": (float("nan"),)},
    ]
    found = {r.id: r for r in catalog.prepare(raw(spark, rows)).collect()}
    assert [found[i].platform for i in (1, 2, 3)] == ["Nova", "Web", None]
    assert [found[i].rating_avg for i in (1, 2, 3)] == [8.5, None, None]
    assert [found[i].summary_clean for i in (1, 2, 3)] == ["x", "", ""]
    assert len(found[1]) == 10


def test_an_empty_catalog_is_prepared(spark):
    assert catalog.prepare(raw(spark, [])).collect() == []


def test_metadata_summary_falls_back_when_empty(spark):
    rows = [{"id": 1, "name": "A", "summary": "<p></p>"}, {"id": 2, "name": "B", "summary": "<i>t</i>"}]
    found = catalog.to_metadata(catalog.prepare(raw(spark, rows)))
    assert [r.summary for r in found.orderBy("item_id").collect()] == ["<p></p>", "t"]


def test_catalog_files_round_trip(spark, tmp_path):
    rows = [{"id": 1, "name": 'A, "q"', "genres": ["X", "Y"], "summary": "two\nlines"}, {"id": 2, "genres": []}]
    prepared = catalog.prepare(raw(spark, rows))
    catalog.save_catalog(prepared, f"{tmp_path}/p")
    catalog.save_catalog_csv(prepared, f"{tmp_path}/c")
    expected = prepared.orderBy("id").collect()
    assert catalog.load_catalog(spark, f"{tmp_path}/p").orderBy("id").collect() == expected
    again = catalog.load_catalog_csv(spark, f"{tmp_path}/c").orderBy("id").collect()
    assert [(r.id, r.name, r.genres, r.summary) for r in again] == [
        (r.id, r.name, r.genres, r.summary) for r in expected
    ]


def test_a_missing_catalog_raises(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        catalog.load_catalog(spark, f"{tmp_path}/none").collect()


def test_raw_json_is_read_with_the_fixed_schema(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 7, "name": "N", "rating": {"average": 9}, "extra": 1}\n')
    row = catalog.read_raw(spark, str(tmp_path)).first()
    assert (row.id, row.rating.average, row.network, row.genres) == (7, 9.0, None, None)


@pytest.fixture()
def family(spark):
    parents = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "item_id long, name string")
    turns = [(1, i, f"t{i}" if i % 3 else ("" if i % 2 else None)) for i in range(1, 26)]
    children = spark.createDataFrame(turns + [(2, 5, "z"), (9, 1, "orphan")], "pid long, seq long, text string")
    return parents, children


def test_children_come_in_order_and_childless_parents_stay(family):
    parents, children = family
    rows = catalog.enrich_with_children(parents, children, "item_id", "pid", "seq", "text").collect()
    found = {r.item_id: r for r in rows}
    assert len(rows) == 3
    assert found[1].season_summaries == [f"t{i}" for i in range(1, 26) if i % 3]
    assert [found[i].season_count for i in (1, 2, 3)] == [25, 1, 0]
    assert found[3].season_summaries == []


@pytest.mark.parametrize("orders", [[1999, 2000], [None, 3], [5, 5], [-1, 10**12]])
def test_a_parent_is_one_row_whatever_the_orders(spark, orders):
    parents = spark.createDataFrame([(1, "a")], "item_id long, name string")
    children = spark.createDataFrame([(1, o, t) for o, t in zip(orders, "xy")], "pid long, seq long, text string")
    rich = catalog.enrich_with_children(parents, children, "item_id", "pid", "seq", "text").collect()
    assert [(r.season_summaries, r.season_count) for r in rich] == [(["x", "y"], 2)]
    nested = catalog.nest_children(parents, children, "item_id", "pid", "seq").collect()
    assert [[c.text for c in r.children] for r in nested] == [["x", "y"]]
    assert rich[0].asDict().keys() == {"item_id", "name", "season_summaries", "season_count"}


def test_nested_children_keep_all_columns(family):
    parents, children = family
    rows = {r.item_id: r for r in catalog.nest_children(parents, children, "item_id", "pid", "seq").collect()}
    assert [c.seq for c in rows[1].children] == list(range(1, 26))
    assert rows[2].children[0].asDict() == {"pid": 2, "seq": 5, "text": "z"}
    assert (rows[3].children, rows[3].child_count) == ([], 0)


def test_lookup_by_several_keys(family, spark):
    _, children = family
    keys = spark.createDataFrame([(1, 3), (2, 5), (2, 5), (8, 8)], "pid long, seq long")
    assert sorted((r.pid, r.seq) for r in catalog.lookup(children, keys, ["pid", "seq"]).collect()) == [(1, 3), (2, 5)]


def test_spread_only_touches_small_inputs(spark):
    assert catalog.spread(spark.range(10).coalesce(1), "id").rdd.getNumPartitions() == 8
    many = spark.range(0, 100, 1, 32)
    assert catalog.spread(many, "id") is many


def test_enriched_items_have_the_whole_shape(spark, family):
    _, children = family
    rows = [{"id": 1, "name": "A", "rating": (7.0,), "network": ("N",), "premiered": "2001"}, {"id": 4}]
    found = {
        r.item_id: r
        for r in catalog.enriched_items(raw(spark, rows), children, "pid", "seq", "text").collect()
    }
    assert (found[1].network, found[1].rating, found[1].premiered, found[1].season_count) == ("N", 7.0, "2001", 25)
    assert (found[4].summary, found[4].genres, found[4].season_summaries, found[4].season_count) == ("", [], [], 0)
    assert "webchannel" in found[4].asDict()


def test_json_lines_are_kept_or_rejected_whole(spark, tmp_path):
    lines = [
        '{"id": 1, "name": "a", "rating": {"average": 7.5}, "unknown": [1]}',
        '{"id": 2, "name": "b"',
        '{"id": "x", "name": "c"}',
        '{"name": "d"}',
        '{"id": 5}',
        "not json",
    ]
    (tmp_path / "items.json").write_text("\n".join(lines))
    good, rejects = catalog.scan_json(spark, str(tmp_path / "items.json"))
    rows = {r.id: r for r in good.collect()}
    assert set(rows) == {1, 5} and rows[1].rating.average == 7.5 and rows[5].name is None
    assert "_record" not in good.columns
    found = sorted((r.reason, r.record) for r in rejects.collect())
    assert found == [
        ("damaged", "not json"),
        ("damaged", '{"id": "x", "name": "c"}'),
        ("damaged", '{"id": 2, "name": "b"'),
        ("no id", '{"name":"d"}'),
    ]
