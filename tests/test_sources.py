import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wayfare import schemas
from wayfare.sources import geojson, json_split, readers, writers
from wayfare.sources.events import SINGAPORE, SYDNEY, format_events, parse_cells, parse_events
from wayfare.sources.routes import format_routes, parse_routes
from wayfare.functions.time import format_offset_ts
from wayfare.streaming.slots import slot_centroids, write_slots


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_record_sizes():
    assert len(schemas.CELL_INVENTORY.fields) == 28
    assert len(schemas.EVENT.fields) == 12


def test_event_line_with_late_time_field(spark):
    line = "x|agent-7|src|505-02-12-34|call|-38.218597|146.247389|site|2020-10-25 10:09:28.000|2020-10-25 10:09:29.000"
    events = parse_events(lines(spark, line), SYDNEY)
    row = events.withColumn("t", format_offset_ts("event_time")).first()
    assert (row.agent_id, row.lat, row.lon, row.lac, row.cell_id, row.t) == ("agent-7", -38.218597, 146.247389, "12", "34", "2020-10-24 23:09:28+0000")
    assert [f.name for f in events.drop("t").schema] == [f.name for f in schemas.EVENT]


def test_event_lines_that_do_not_parse(spark):
    good = "2020-01-01 08:00:00|a|m|505-02-1-2|call|bad|103.5|imei"
    got = parse_events(lines(spark, good, "2020-01-01 08:00:00|a|m", "never|a|m|c|t|1|2|i", good.replace("505-02-1-2", "505")), SINGAPORE).collect()
    assert [(r.lat, r.lon, r.lac) for r in got] == [(None, 103.5, "1"), (None, 103.5, "")]
    assert parse_events(lines(spark, good), SYDNEY).count() == 0


def test_event_text(spark):
    events = parse_events(lines(spark, "2020-01-01 08:00:00|a|m|505-02-1-2|call||103.5|i"), SINGAPORE)
    assert events.select(format_events(events).alias("v")).first()["v"] == "2020-01-01 00:00:00+0000|a|m|505-02-1-2|call||103.5|i"


def test_cell_lines(spark):
    full = "c1|s|n|1.5|103.5|a|b|c|d|true|nonsense|Tower"
    got = parse_cells(lines(spark, full, "c2|s|n|1|2", full.replace("c1", "c3").replace("Tower", ""))).collect()
    assert [(r.cgi, r.is_kde, r.is_indoor, r.building) for r in got] == [
        ("c1", True, False, "Tower"), ("c2", False, False, "Unknown"), ("c3", True, False, "Unknown")
    ]
    with pytest.raises(Exception, match="bad latitude"):
        parse_cells(lines(spark, "c|s|n|north|2")).collect()


def test_route_lines(spark):
    leg = "08:00:00,103.5,1.25,08:10:00,103.75,1.5,TRAIN,r1"
    good = f'WEEKDAY\t08:00\t"S1"\tS2\t{leg};{leg}'
    got = parse_routes(lines(spark, good, good + ";short", good.replace("103.5", "x"), "a\tb"))
    assert got.count() == 1
    assert got.select(format_routes().alias("v")).first()["v"] == good.replace('"', "")


def test_geojson_round_trip(spark):
    point = {"type": "Point", "coordinates": [1.5, 2]}
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "id": "a\"b", "properties": {"n": 1, "s": "1", "o": {"k": [True, None]}, "z": None}, "geometry": point},
        {"type": "Feature", "properties": {}, "geometry": point},
    ]}
    features = geojson.parse_feature_collections(lines(spark, json.dumps(doc)))
    texts = features.select(geojson.feature_text().alias("f"))
    back = json.loads(geojson.feature_collections(texts.withColumn("doc", F.lit(1)), "f", ("doc",)).first().value)
    key = lambda f: json.dumps(f, sort_keys=True)
    assert sorted(back["features"], key=key) == sorted(doc["features"], key=key)
    again = geojson.parse_features(texts.select(F.col("f").alias("value")))
    named = again.where(F.col("id").isNotNull()).select(
        geojson.feature_property("s").alias("s"), geojson.feature_property("n").alias("n"), geojson.feature_property("o").alias("o"), geojson.feature_property("none").alias("none")
    ).first()
    assert (named.s, named.n, json.loads(named.o), named.none) == ("1", "1", {"k": [True, None]}, None)
    with pytest.raises(Exception, match="no property"):
        again.select(geojson.feature_property("s", required=True)).collect()


def test_collections_by_named_columns(spark):
    texts = spark.range(25).select((F.col("id") % 3).alias("k"), F.concat(F.lit('{"type":"Feature","id":"'), "id", F.lit('"}')).alias("f"))
    docs = [json.loads(r.value) for r in geojson.feature_collections(texts, "f", ("k",)).collect()]
    assert sorted(len(d["features"]) for d in docs) == [8, 8, 9]
    assert {f["id"] for d in docs for f in d["features"]} == {str(k) for k in range(25)}
    with pytest.raises(ValueError):
        geojson.feature_collections(texts, "f", ())


def test_multipolygon_json(spark):
    df = spark.createDataFrame([('{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]}',)], "g string")
    row = df.select(geojson.geojson_to_polygons("g").alias("p")).select(geojson.polygons_to_geojson("p", 4326).alias("t"), geojson.geojson_wkid(F.lit("{}")).alias("w")).first()
    assert len(json.loads(row.t)["coordinates"]) == 2 and json.loads(row.t)["crs"]["properties"]["name"] == "EPSG:4326" and row.w == 4326


def test_missing_column_fails(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(1).write.parquet(path)
    with pytest.raises(ValueError, match="missing columns"):
        readers.read_parquet_typed(spark, path, schemas.WEIGHT)
    spark.range(1).selectExpr("id as agent_id", "'1' as weight", "1 as more").write.parquet(path + "2")
    with pytest.raises(ValueError, match="agent_id is bigint"):
        readers.read_parquet_typed(spark, path + "2", schemas.WEIGHT)


def test_csv_modes(spark, tmp_path):
    path = str(tmp_path / "c")
    df = spark.createDataFrame([(1, "a;b")], "n int, s string")
    writers.write_csv(df, path, delimiter=";", single_file=True)
    with pytest.raises(Exception):
        writers.write_csv(df, path, mode="error")
    back = spark.read.option("sep", ";").option("header", True).csv(path)
    assert [tuple(r) for r in back.collect()] == [("1", "a;b")]


def test_dated_folders(spark, tmp_path):
    for root, day in (("new", "d1"), ("old", "d1"), ("old", "d2")):
        writers.write_parquet(spark.range(1).selectExpr(f"'{root}' as r"), str(tmp_path / root / "lbs" / day))
    roots = [str(tmp_path / "new"), str(tmp_path / "old")]
    assert [readers.read_dated(spark, roots, d).first().r for d in ("d1", "d2")] == ["new", "old"]
    with pytest.raises(FileNotFoundError):
        readers.read_dated(spark, roots, "d3")


def test_stream_equals_batch_on_closed_slots(spark, tmp_path):
    rows = [(f"a{k % 3}", 1 + k / 100, 103.0, 1_700_000_000 + 37 * k) for k in range(200)]
    df = spark.createDataFrame(rows, "agent_id string, lat double, lon double, s long").withColumn("at", F.timestamp_seconds("s"))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df.repartition(5).write.parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 10).parquet(source)
    write_slots(slot_centroids(stream, "at"), out, str(tmp_path / "state")).awaitTermination()
    got = {(r.agent_id, r.slot): (r.n, round(r.centre_lat, 9)) for r in spark.read.parquet(out).collect()}
    batch = {(r.agent_id, r.slot): (r.n, round(r.centre_lat, 9)) for r in slot_centroids(df, "at").collect()}
    assert got and got == {k: batch[k] for k in got}
    assert len(batch) - len(got) <= 9


def test_geometry_text_of_every_type(spark):
    texts = {
        "POINT (1 -2.5)": "[1,-2.5]",
        "MULTIPOINT (1 1, 2 2)": "[[1,1],[2,2]]",
        "LINESTRING (0 0, 1e3 1)": "[[0,0],[1e3,1]]",
        "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))": "[[[0,0],[1,1]],[[2,2],[3,3]]]",
        "POLYGON ((0 0, 1 0, 1 1, 0 0))": "[[[0,0],[1,0],[1,1],[0,0]]]",
        "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))": "[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]",
        "POLYGON EMPTY": "[]",
    }
    odd = {"MULTIPOINT ((1 1), (2 2))": "[[1,1],[2,2]]", "point(1 2 3)": "[1,2]", "GEOMETRYCOLLECTION (POINT (1 1))": None, "no shape": None, None: None}
    df = spark.createDataFrame([(t,) for t in [*texts, *odd]], "w string")
    got = {r.w: (r.j, r.b) for r in df.withColumn("j", geojson.wkt_to_geojson("w")).withColumn("b", geojson.geojson_to_wkt("j")).collect()}
    for w, coordinates in (texts | odd).items():
        assert (got[w][0] and json.dumps(json.loads(got[w][0])["coordinates"])) == (coordinates and json.dumps(json.loads(coordinates))), w
    assert all(got[w][1].replace("1000.0", "1e3") == w for w in texts), got


def test_a_rerun_replaces_its_days_only(spark, tmp_path):
    path, kind = f"{tmp_path}/days", "n int, date string"
    first = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02"), (3, "2024-01-03"), (4, None)], kind)
    for fmt in ("parquet", "csv"):
        writers.write_days(first, f"{path}-{fmt}", fmt=fmt)
        writers.write_days(spark.createDataFrame([(20, "2024-01-02"), (21, "2024-01-02")], kind), f"{path}-{fmt}", fmt=fmt)
        writers.write_days(first.limit(0), f"{path}-{fmt}", fmt=fmt)
        found = readers.read_days(spark, f"{path}-{fmt}", kind, "2024-01-01", "2024-01-31", fmt=fmt)
        assert sorted((r.n, r.date) for r in found.collect()) == [(1, "2024-01-01"), (3, "2024-01-03"), (20, "2024-01-02"), (21, "2024-01-02")]
        one = readers.read_days(spark, f"{path}-{fmt}", kind, "2024-01-03", fmt=fmt)
        assert [r.n for r in one.collect()] == [3] and "PartitionFilters: [isnotnull(date" in one._jdf.queryExecution().toString()


@pytest.mark.parametrize("split", [None, "200"])
def test_features_of_split_files(spark, tmp_path, split):
    """Features of documents cut anywhere, with brackets, quotes and escapes in strings, and members around the array."""
    names = ['a"}{', "\\", '\\"', "[{", "}" * 9, "", "é\n", None] * 4
    for k, indent in enumerate((None, 1)):
        features = [{"type": "Feature", "properties": {"name": n, "k": i, "deep": {"a": [{"b": "}"}]}}, "geometry": {"type": "Point", "coordinates": [i, k]}} for i, n in enumerate(names)]
        doc = {"type": "FeatureCollection", "crs": {"properties": {"name": "{["}}, "tags": ["}", {"x": 1}], "features": features, "note": "} ] {"}
        (tmp_path / f"doc{k}.json").write_text(json.dumps(doc, indent=indent) + "\n" * k)
    (tmp_path / "empty.json").write_text('{"type":"FeatureCollection","features":[]}')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        if split:
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        found = json_split.feature_texts(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    by_file = {}
    for r in found:
        by_file.setdefault(r.path[-9:], []).append((r.feature, json.loads(r.value)))
    assert {f: len(v) for f, v in by_file.items()} == {"doc0.json": 32, "doc1.json": 32}
    for k in (0, 1):
        told = [v for _, v in sorted(by_file[f"doc{k}.json"], key=lambda p: p[0])]
        assert [(v["properties"]["name"], v["properties"]["k"], v["geometry"]["coordinates"]) for v in told] == [(n, i, [i, k]) for i, n in enumerate(names)]


def test_large_tables_make_several_documents(spark, tmp_path, monkeypatch):
    """No task holds or writes the whole table; each file is a whole document."""
    from wayfare.checks import codec_checks
    from wayfare.checks.registry import QUERIES

    rows = [(k, k % 3, "R", float(k)) for k in range(57)] + [(5, 2, "R", 5.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_returnflag string, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(codec_checks, "_DOCUMENT_ROWS", 10)
    kept = {}
    read = codec_checks.read_features
    monkeypatch.setattr(codec_checks, "read_features", lambda s, path: kept.setdefault("f", read(kept.setdefault("s", s), kept.setdefault("path", path))))
    found = QUERIES["x9_geojson_large_file"](spark, str(tmp_path)).collect()
    assert sorted((r.id, r.quantity) for r in found) == sorted((k, q) for k, _, _, q in rows)
    documents = [json.loads(f.read_text()) for f in Path(kept["path"]).rglob("*.txt")]
    assert len(documents) == 6 and max(len(d["features"]) for d in documents) < 20


def test_documents_go_when_their_round_is_read(spark, tmp_path, monkeypatch):
    """The text of a whole table never lies on disk at once."""
    from wayfare.checks import codec_checks
    from wayfare.checks.registry import QUERIES

    rows = [(k, k % 3, "R", float(k)) for k in range(95)] + [(5, 2, "R", 5.0), (None, 1, "N", 1.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_returnflag string, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(codec_checks, "_DOCUMENT_ROWS", 10)
    monkeypatch.setattr(codec_checks, "_DOCUMENTS_AT_ONCE", 3)
    paths, read = [], codec_checks.read_features

    def counted(s, path):
        paths.append((path, len(list(Path(path).rglob("*.txt"))), [p for p, *_ in paths if Path(p).exists()]))
        return read(s, path)

    monkeypatch.setattr(codec_checks, "read_features", counted)
    found = QUERIES["x9_geojson_large_file"](spark, str(tmp_path)).collect()
    assert sorted((r.id, r.quantity) for r in found) == sorted((k, q) for k, _, _, q in rows if k is not None)
    assert sum(n for _, n, _ in paths) == 10 and max(n for _, n, _ in paths) <= 3
    assert not any(left for *_, left in paths) and not any(Path(p).exists() for p, *_ in paths)


def test_text_of_documents_is_not_stored_again(spark, tmp_path, monkeypatch):
    """Of a file in many splits only the features that cross from one to another are written, two parts for a split at most."""
    features = [{"type": "Feature", "properties": {"k": k, "t": '} {"' * (k % 5)}, "geometry": None} for k in range(400)]
    (tmp_path / "doc.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    kept = []
    materialize = json_split.materialize
    monkeypatch.setattr(json_split, "materialize", lambda df, label: kept.append(t := materialize(df, label)) or t)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        found = json_split.feature_texts(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [json.loads(r.value)["properties"]["k"] for r in sorted(found, key=lambda r: r.feature)] == list(range(400))
    splits = kept[0].count()
    assert splits > 5
    texts = [t for t in kept if "value" in t.columns]
    assert texts and all(t.count() <= 2 * splits for t in texts)
