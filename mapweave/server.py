"""A small HTTP front: tiles, the layer list and a map page. Rendering stays in Spark."""

from __future__ import annotations

import argparse
import json
import logging
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.config import Config
from mapweave.operators import catalog, tiles
from mapweave.sources.folder import build_catalog, pixels_of


class TileReader(Protocol):
    """What a back end offers."""

    def list_layers(self) -> DataFrame: ...

    def get_tile(self, layer: str, z: int, x: int, y: int, style: str | None = None) -> tuple[str, bytes]: ...


class FolderReader:
    """Tiles of a folder of style folders. `style` picks among layers of one name; by default the first by path serves."""

    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.size, self.band = spark, config.tile_size_x, config.band
        self.layers, self.errors = build_catalog(spark, config.root(), band=config.band, default_style=config.default_style)
        self.layers = self.layers.cache()

    def list_layers(self) -> DataFrame:
        return catalog.list_layers(self.layers)

    def get_tile(self, layer: str, z: int, x: int, y: int, style: str | None = None) -> tuple[str, bytes]:
        """Content type and bytes of a tile; LookupError for an unknown layer."""
        found = catalog.first_per_name(self.layers.where((F.col("layer") == layer) & (F.lit(style is None) | (F.col("style") == F.lit(style)))))
        if found.isEmpty():
            raise LookupError(f"Layer not found: '{layer}'")
        request = self.spark.createDataFrame([(layer, z, x, y)], "layer string, z int, x bigint, y bigint")
        rgba = tiles.tile_rgba(request, found, pixels_of(found, self.band), self.size)
        row = tiles.tile_png(rgba, self.size).first()
        return row["content_type"], bytes(row["bytes"])


PAGE = """<!DOCTYPE html>
<meta charset=utf-8><title>Layers</title>
<style>body { margin: 0; font: 14px sans-serif } #bar { padding: 6px } #map { position: relative; overflow: hidden; height: calc(100vh - 40px); background: #ddd; cursor: grab } #map img { position: absolute; width: 256px; height: 256px }</style>
<div id=bar><select id=pick></select> <button id=in>+</button> <button id=out>-</button> <span id=at></span></div><div id=map></div>
<script>
const half = 20037508.342789244, map = document.getElementById("map"), pick = document.getElementById("pick"), most = 18;
let layers = [], zoom = 0, x = 0, y = 0;  // the middle of the view, in metres
const metres = () => 2 * half / 256 / 2 ** zoom;
function draw() {
  const layer = layers.find(l => l.layer === pick.value);
  map.replaceChildren();
  if (!layer) return;
  const left = (x + half) / metres() - map.clientWidth / 2, top = (half - y) / metres() - map.clientHeight / 2, n = 2 ** zoom;
  for (let i = Math.max(0, Math.floor(left / 256)); i < n && i * 256 < left + map.clientWidth; i++)
    for (let j = Math.max(0, Math.floor(top / 256)); j < n && j * 256 < top + map.clientHeight; j++) {
      const tile = new Image();
      tile.style.transform = `translate(${i * 256 - left}px, ${j * 256 - top}px)`;
      tile.src = `/tiles/${encodeURIComponent(layer.layer)}/${zoom}/${i}/${j}`;
      map.append(tile);
    }
  document.getElementById("at").textContent = `${layer.style}, zoom ${zoom}`;
}
function fit() {
  const found = layers.find(l => l.layer === pick.value), e = found && found.geometry[3857].extent;
  if (!e) return;
  [x, y] = [(e.minx + e.maxx) / 2, (e.miny + e.maxy) / 2];
  const span = Math.max((e.maxx - e.minx) / map.clientWidth, (e.maxy - e.miny) / map.clientHeight);
  zoom = Math.max(0, Math.min(most, Math.floor(Math.log2(2 * half / 256 / span))));
  draw();
}
function step(by) { zoom = Math.max(0, Math.min(most, zoom + by)); draw(); }
let held = null;
map.onpointerdown = e => { held = [e.clientX, e.clientY, x, y]; map.setPointerCapture(e.pointerId); };
map.onpointerup = e => { if (held) { x = held[2] - (e.clientX - held[0]) * metres(); y = held[3] + (e.clientY - held[1]) * metres(); held = null; draw(); } };
map.onwheel = e => { e.preventDefault(); step(e.deltaY < 0 ? 1 : -1); };
document.getElementById("in").onclick = () => step(1);
document.getElementById("out").onclick = () => step(-1);
pick.onchange = fit;
fetch("/layers").then(r => r.json()).then(rows => { layers = rows; pick.append(...rows.map(l => new Option(`${l.layer} (${l.style})`, l.layer))); fit(); });
</script>"""
log = logging.getLogger(__name__)


def layers_json(layers: DataFrame) -> str:
    rows = [json.loads(r[0]) for r in catalog.layers_response(layers).select(F.to_json(F.struct("layer", "style", "geometry"))).toLocalIterator()]
    return json.dumps(rows)


def respond(reader: TileReader, path: str) -> tuple[int, str, bytes]:
    """Status, content type and body for a path."""
    parts = [p for p in path.split("?")[0].split("/") if p]
    if not parts:
        return 200, "text/html", PAGE.encode()
    if parts == ["layers"]:
        return 200, "application/json", layers_json(reader.list_layers()).encode()
    if len(parts) == 5 and parts[0] == "tiles":
        try:
            z, x, y = map(int, parts[2:])
            if not (0 <= z < 256 and 0 <= x < 1 << 32 and 0 <= y < 1 << 32):
                raise ValueError("out of range")
        except ValueError as e:
            return 400, "text/plain", str(e).encode()
        try:
            kind, body = reader.get_tile(parts[1], z, x, y)
            return 200, kind, body
        except LookupError as e:
            return 404, "text/plain", str(e).encode()
        except Exception:
            log.exception("tile %s", path)
            return 500, "text/plain", b"the tile could not be drawn"
    return 404, "text/plain", b"no such page"


def serve(reader: TileReader, port: int) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            status, kind, body = respond(reader, self.path)
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="mapweave")
    parser.add_argument("--data-folder", default="data")
    parser.add_argument("--port", type=int, default=8000)
    got = parser.parse_args(args)
    config = Config(data_folder=got.data_folder, port=got.port)
    logging.basicConfig(level=logging.INFO, format="%(levelname)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    reader = FolderReader(SparkSession.builder.appName("mapweave").getOrCreate(), config)
    summary = catalog.style_summary(reader.layers, "path")
    catalog.summary_text(summary).show(1000, truncate=False)
    counts = catalog.totals(summary).first()
    print(f"{counts['n_layers']} layers in {counts['n_styles']} styles, {counts['n_not_cog']} with layers that aren't cloud-optimised")
    if not counts["n_layers"]:
        print("No layers: put GeoTIFF files into folders named after their styles below", config.root())
        return
    serve(reader, got.port).serve_forever()


if __name__ == "__main__":
    main()
