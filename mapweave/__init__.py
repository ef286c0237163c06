"""Raster tile analytics on Spark: layer catalogues, tile rendering and style summaries as DataFrames."""

#: Public names and the modules that they come from; loaded when they are first asked for, so that workers load only what they run.
_FROM = {
    "Config": "config", "FolderReader": "server", "TileReader": "server", "respond": "server", "serve": "server",
    "tile_values": "operators.tiles", "tile_rgba": "operators.tiles", "tile_png": "operators.tiles",
    "build_catalog": "sources.folder", "load_cache": "sources.folder", "save_cache": "sources.folder", "pixels_of": "sources.folder",
}
__all__ = list(_FROM)


def __getattr__(name: str):
    if name not in _FROM:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    from importlib import import_module

    return getattr(import_module(f"{__name__}.{_FROM[name]}"), name)
