import numpy as np
import pytest

from mapweave.config import Config
from mapweave.server import FolderReader, respond
from mapweave.sources import folder, geotiff
from mapweave.sources.png import decode_rgba, encode_rgba

RAMP = np.arange(1, 17, dtype=np.float32).reshape(4, 4)


def put(root, path, data):
    at = root / path
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_bytes(data)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("kind", ["u1", "i2", "u2", "i4", "f4", "f8"])
@pytest.mark.parametrize(("compression", "predictor", "tile"), [(1, 1, None), (8, 1, 16), (8, 2, None), (32773, 1, None), (1, 1, 32)])
def test_geotiff_round_trip(order, kind, compression, predictor, tile):
    if predictor == 2 and kind[0] == "f":
        pytest.skip("predictor 2 is for whole numbers")
    band = np.random.default_rng(1).integers(0, 100, (37, 53)).astype(kind)
    got = geotiff.GeoTiff(geotiff.write_geotiff(band, (10.0, 20.0), (2.0, 3.0), 3857, -9999, compression, predictor, tile, order, cog=True))
    assert (got.band() == band).all()
    assert (got.origin_x, got.origin_y, got.px_w, got.px_h, got.crs_code, got.nodata, got.is_cog) == (10.0, 20.0, 2.0, -3.0, 3857, -9999.0, True)


def test_lzw_of_known_bytes():
    # Clear, 'a', 'b', the pair 'ab' (code 258), end; 9 bits each.
    bits = "".join(f"{c:09b}" for c in (256, 97, 98, 258, 257))
    data = int(bits.ljust(48, "0"), 2).to_bytes(6, "big")
    assert geotiff._lzw(data) == b"abab"


def test_png_round_trip_with_sparks_own_reader(spark, tmp_path):
    image = np.random.default_rng(2).integers(0, 256, (5, 7, 4)).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(encode_rgba(image))
    got = spark.read.format("image").load(str(tmp_path / "a.png")).select("image.*").first()
    bgra = np.frombuffer(bytes(got["data"]), np.uint8).reshape(5, 7, 4)
    assert (bgra[:, :, [2, 1, 0, 3]] == image).all()
    assert (decode_rgba(encode_rgba(image)) == image).all()


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    half = 20037508.342789244
    whole = (2 * half / 4, 2 * half / 4)
    put(root, "grayscale/ramp.tif", geotiff.write_geotiff(RAMP, (-half, half), whole, 3857))
    holes = RAMP.copy()
    holes[0, 0], holes[1, 1], holes[2, 2], holes[3, 3] = np.nan, 0.0, -0.0, -9999.0
    put(root, "grayscale/holes.tif", geotiff.write_geotiff(holes, (-half, half), whole, 3857, -9999.0))
    put(root, "default/stops.TIFF", geotiff.write_geotiff(RAMP, (-half, half), whole, 3857, cog=True))
    put(root, "default/style.txt", b"# ramp\nINTERPOLATION:INTERPOLATED\n0,0,0,0,255,low\n10,100,200,50,255,high\n")
    put(root, "viridis/geo.tif", geotiff.write_geotiff(RAMP, (-180.0, 90.0), (90.0, 45.0), 4326))
    put(root, "viridis/utm.tif", geotiff.write_geotiff(RAMP, (400000.0, 5800000.0), (1000.0, 1000.0), 32633))
    for style in ("magma", "viridis"):
        put(root, f"{style}/dup.tif", geotiff.write_geotiff(RAMP, (-half, half), whole, 3857))
    put(root, "x/deep/nested/n.TIFF", geotiff.write_geotiff(RAMP, (-half, half), whole, 3857))
    put(root, "x/.hidden.tif", geotiff.write_geotiff(RAMP, (-half, half), whole, 3857))
    put(root, "top.tif", geotiff.write_geotiff(RAMP, (-half, half), whole, 3857))
    put(root, "bad/nocrs.tif", geotiff.write_geotiff(RAMP, (0.0, 0.0), (1.0, 1.0), None))
    put(root, "bad/empty.tif", b"")
    put(root, "bad/cut.tif", geotiff.write_geotiff(RAMP, (0.0, 0.0), (1.0, 1.0), 3857)[:-10])
    put(root, "bad/nothing.tif", geotiff.write_geotiff(np.full((4, 4), -1, np.float32), (0.0, 0.0), (1.0, 1.0), 3857, -1.0))
    put(root, "bad/other.tif", geotiff.write_geotiff(RAMP, (0.0, 0.0), (1.0, 1.0), 2154))
    (root / "bad/folder.tif").mkdir()
    return root


@pytest.fixture(scope="module")
def reader(spark, tree):
    return FolderReader(spark, Config(data_folder=str(tree)))


def test_catalog(reader, tree):
    got = {(r["layer"], r["style"]): r for r in reader.layers.collect()}
    assert set(got) == {("ramp", "grayscale"), ("holes", "grayscale"), ("stops", "default"), ("geo", "viridis"), ("utm", "viridis"), ("dup", "magma"), ("dup", "viridis"), ("n", "nested"), (".hidden", "x")}
    assert (got["holes", "grayscale"]["min_value"], got["holes", "grayscale"]["max_value"]) == (0.0, 15.0)
    assert got["stops", "default"]["is_cog"] and not got["ramp", "grayscale"]["is_cog"]
    assert [s["value"] for s in got["stops", "default"]["colour_stops"]] == [0.0, 10.0]
    assert set(got["utm", "viridis"]["cached_geometry"]) == {32633, 4326, 3857}
    errors = {r["path"].rsplit("/", 1)[1]: r["error"] for r in reader.errors.collect()}
    assert set(errors) == {"nocrs.tif", "empty.tif", "cut.tif", "nothing.tif", "other.tif", "folder.tif"}


def test_cache_answers_for_unchanged_files(spark, reader, tree):
    path = str(tree / folder.CACHE_FILE)
    records = folder.load_cache(spark, path)
    assert records.where("layer = 'ramp'").first()["max_value"] == 16.0
    folder.save_cache(records.replace({16.0: 77.0}, subset=["max_value"]), path)
    layers, _ = folder.build_catalog(spark, str(tree))
    assert layers.where("layer = 'ramp'").first()["max_value"] == 77.0
    (tree / folder.CACHE_FILE).write_text("layer,size_bytes\nramp,x\n")
    layers, _ = folder.build_catalog(spark, str(tree))
    assert layers.where("layer = 'ramp'").first()["max_value"] == 16.0


def test_tile_of_the_world(reader):
    kind, data = reader.get_tile("ramp", 0, 0, 0)
    image = decode_rgba(data)
    assert kind == "image/png"
    want = np.floor((np.repeat(np.repeat(RAMP, 64, 0), 64, 1) - 1) / np.float32(15) * np.float32(255)).astype(np.uint8)
    assert (image[:, :, 0] == want).all() and (image[:, :, 3] == 255).all()


def test_holes_are_transparent(reader):
    image = decode_rgba(reader.get_tile("holes", 0, 0, 0)[1])
    clear = {(y, x) for y in range(4) for x in range(4) if (image[y * 64 : y * 64 + 64, x * 64 : x * 64 + 64, 3] == 0).all()}
    assert clear == {(0, 0), (1, 1), (2, 2), (3, 3)}


def test_other_systems_and_off_tiles(reader):
    assert decode_rgba(reader.get_tile("geo", 0, 0, 0)[1])[:, :, 3].all()
    assert not decode_rgba(reader.get_tile("ramp", 1, 5, 5)[1]).any()
    # The UTM raster lies near 13.5 to 13.6 degrees east, 52.3 north: in tile 9/275/168.
    assert decode_rgba(reader.get_tile("utm", 9, 275, 168)[1]).any()


def test_responses(reader):
    assert respond(reader, "/tiles/none/0/0/0")[:2] == (404, "text/plain")
    assert respond(reader, "/tiles/ramp/a/0/0")[0] == 400
    assert respond(reader, "/tiles/ramp/0/0/0")[:2] == (200, "image/png")
    status, kind, body = respond(reader, "/layers")
    assert (status, kind) == (200, "application/json") and b'"3857"' in body
    assert respond(reader, "/")[1] == "text/html"


def test_blocks_and_stream(spark, reader, tree, tmp_path):
    from mapweave.operators.raster import from_blocks, to_blocks
    from mapweave.sources.folder import pixels_of
    from mapweave.streaming.tile_requests import render_stream

    layers = reader.layers.where("layer IN ('ramp', 'stops')")
    pixels = geotiff.read_pixels(layers)
    assert sorted(map(tuple, from_blocks(to_blocks(pixels, 3), 3).collect())) == sorted(map(tuple, pixels.collect()))
    spark.createDataFrame([("ramp", 0, 0, 0), ("stops", 1, 0, 0), ("ramp", 0, 0, 0)], "layer string, z int, x bigint, y bigint").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("layer string, z int, x bigint, y bigint").parquet(str(tmp_path / "in"))
    render_stream(stream, layers, pixels_of(layers), str(tmp_path / "out"), str(tmp_path / "check"), 32).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


class Broken:
    def get_tile(self, *_):
        raise RuntimeError("bug")


def test_internal_errors_are_no_missing_tiles(caplog):
    assert respond(Broken(), "/tiles/a/0/0/0")[0] == 500 and "bug" in caplog.text


def test_page_asks_for_tiles(reader):
    page = respond(reader, "/")[2].decode()
    assert "/layers" in page and "/tiles/" in page


def test_style_argument_and_far_tiles(reader):
    assert reader.get_tile("dup", 0, 0, 0, "viridis")[1] != reader.get_tile("dup", 0, 0, 0, "magma")[1] == reader.get_tile("dup", 0, 0, 0)[1]
    with pytest.raises(LookupError):
        reader.get_tile("dup", 0, 0, 0, "nosuch")
    assert not decode_rgba(reader.get_tile("ramp", 0, (1 << 32) - 1, (1 << 32) - 1)[1]).any()


def test_only_blocks_of_the_window_are_read(tmp_path):
    from mapweave.sources.files import PAGE, Ranges

    band = np.random.default_rng(3).random((1024, 1024)).astype(np.float32)
    for tile in (64, None):
        (tmp_path / "a.tif").write_bytes(geotiff.write_geotiff(band, (0.0, 0.0), (1.0, 1.0), 3857, tile=tile))
        with Ranges(str(tmp_path / "a.tif")) as data:
            got = geotiff.GeoTiff(data).window(500, 520, 130, 200)
            assert (got == band[500:521, 130:201]).all()
            assert data.fetched <= 12 * PAGE and data.size > 4_000_000


def test_tiles_of_a_large_raster_in_bands(spark, tmp_path, monkeypatch):
    band = np.random.default_rng(4).integers(1, 200, (300, 500)).astype(np.float32)
    put(tmp_path, "grayscale/big.tif", geotiff.write_geotiff(band, (0.0, 30000.0), (100.0, 100.0), 3857, compression=8, tile=64))
    monkeypatch.setattr(geotiff, "BAND_ROWS", 50)
    layers, _ = folder.build_catalog(spark, str(tmp_path), use_cache=False)
    near = spark.createDataFrame([("big", 95, 160, -5, 70), ("none", 0, 1, 0, 1)], "layer string, r0 int, r1 int, c0 int, c1 int")
    got = {(r["row_"], r["col"]): r["v"] for r in folder.pixels_of(layers)(near).collect()}
    assert got == {(r, c): band[r, c] for r in range(95, 161) for c in range(71)}
    assert geotiff.read_pixels(layers).count() == band.size


def test_bands_of_several(tmp_path):
    # Two samples a pixel: written as one band of double width, told apart by the header.
    two = np.arange(2 * 4 * 6, dtype=np.float32).reshape(4, 12)
    data = bytearray(geotiff.write_geotiff(two, (0.0, 0.0), (1.0, 1.0), 3857))
    _, at = geotiff.struct.unpack("<HI", bytes(data[2:8]))
    for k in range(geotiff.struct.unpack_from("<H", data, at)[0]):
        place = at + 2 + 12 * k
        tag = geotiff.struct.unpack_from("<H", data, place)[0]
        if tag == geotiff.WIDTH:
            geotiff.struct.pack_into("<I", data, place + 8, 6)
        elif tag == geotiff.SAMPLES:
            geotiff.struct.pack_into("<H", data, place + 8, 2)
    for k in (1, 2):
        assert (geotiff.GeoTiff(bytes(data), k).band() == two[:, k - 1 :: 2]).all()
    with pytest.raises(ValueError, match="no band 3"):
        geotiff.GeoTiff(bytes(data), 3)


def test_catalog_of_a_uri(spark, tree):
    layers, errors = folder.build_catalog(spark, f"file://{tree}", use_cache=False)
    got = {r["layer"]: r for r in layers.collect()}
    assert {"ramp", "holes", "stops", "geo", "utm", "dup", "n"} <= set(got)  # Spark's listing hides names that begin with a dot
    assert [s["value"] for s in got["stops"]["colour_stops"]] == [0.0, 10.0] and got["holes"]["max_value"] == 15.0
    assert "nocrs.tif" in {r["path"].rsplit("/", 1)[1] for r in errors.collect()}


def test_summary_for_people(reader):
    from mapweave.operators import catalog

    summary = catalog.style_summary(reader.layers, "path")
    got = {r["style"]: r for r in catalog.summary_text(summary).collect()}
    assert got["default"]["breaks"] == "0.00, 10.00" and got["default"]["colours"] == "#000000 #64c832" and got["default"]["warnings"] == "breaks don't cover the data"
    assert got["grayscale"]["breaks"] == "auto" and got["grayscale"]["colours"].split()[::9] == ["#000000", "#ffffff"] and got["grayscale"]["warnings"] == "0 of 2 cloud-optimised"
    assert got["viridis"]["colours"].startswith("#440154 ") and len(got["viridis"]["colours"].split()) == 10
    counts = catalog.totals(summary).first()
    assert (counts["n_styles"], counts["n_layers"], counts["n_not_cog"]) == (6, 9, 5)


def test_progress_passes_over_failed_files(spark):
    from pyspark.sql import functions as F

    from mapweave.operators.catalog import load_progress

    files = spark.createDataFrame([(i, 10 * i, i % 3 == 0) for i in range(1, 11)], "ord int, size_bytes long, bad boolean")
    got = [tuple(r) for r in load_progress(files, failed=F.col("bad")).orderBy("ord").select("loaded_bytes", "position", "percent").collect()]
    want, place, read = [], 0, 0
    for i in range(1, 11):
        place, read = place + (i % 3 != 0), read + 10 * i
        want.append((read, place, 10.0 * place))
    assert got == want


def test_exports():
    import mapweave

    assert mapweave.Config is Config and mapweave.FolderReader is FolderReader and all(hasattr(mapweave, n) for n in mapweave.__all__)
    with pytest.raises(AttributeError):
        mapweave.nothing


@pytest.mark.parametrize("wrong", [{"tile_size_y": 128}, {"band": 0}, {"tile_size_x": 0, "tile_size_y": 0}])
def test_settings_are_checked(wrong):
    with pytest.raises(ValueError):
        Config(**wrong)


def test_no_source():
    with pytest.raises(ValueError, match="No source"):
        Config(data_folder=None).root()


def test_empty_folder(spark, tmp_path):
    layers, errors = folder.build_catalog(spark, str(tmp_path))
    assert layers.isEmpty() and errors.isEmpty()
