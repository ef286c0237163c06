"""Files by path or URI, read in ranges: local ones with Python, others through pyarrow's file systems."""

from __future__ import annotations

from collections import OrderedDict

PAGE = 1 << 16


def local(path: str) -> str | None:
    """The plain path of a local file; None for other file systems."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    return None if "://" in path else path


def _opened(path: str):
    plain = local(path)
    if plain is not None:
        return open(plain, "rb")  # noqa: SIM115
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1).replace("s3n://", "s3://", 1))
    return store.open_input_file(inside)


def read_all(path: str) -> bytes:
    with _opened(path) as file:
        return file.read()


class Ranges:
    """A file as bytes that are read when they are asked for, in pages; `fetched` counts them. OSError as files raise it."""

    def __init__(self, path: str, most: int = 64):
        self.path, self.file, self.fetched = path, _opened(path), 0
        self.file.seek(0, 2)
        self.size = self.file.tell()
        self._pages: OrderedDict[int, bytes] = OrderedDict()
        self._most = most

    def __len__(self) -> int:
        return self.size

    def __enter__(self) -> Ranges:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        self.fetched += n
        return self.file.read(n)

    def _page(self, k: int) -> bytes:
        if k not in self._pages:
            if len(self._pages) >= self._most:
                self._pages.popitem(last=False)
            self._pages[k] = self._read(k * PAGE, min(PAGE, self.size - k * PAGE))
        return self._pages[k]

    def __getitem__(self, part: slice) -> bytes:
        start, stop, _ = part.indices(self.size)
        if stop - start > PAGE:
            return self._read(start, stop - start)
        return b"".join(self._page(k) for k in range(start // PAGE, -(-stop // PAGE)))[start % PAGE :][: max(0, stop - start)]
