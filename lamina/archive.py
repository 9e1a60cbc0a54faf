"""An archive as a Python mapping, for use on the driver; cluster work goes through lamina.sources.archive."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import Any

import numpy as np

from lamina.operators import dtype
from lamina.operators.crypto import CryptographyError
from lamina.operators.tree import flatten, restructure
from lamina.sources import format as codec
from lamina.sources.archive import check_mode, name_of, open_archive, payload
from lamina.sources.streams import open_stream

__all__ = ["Archive", "CryptographyError", "save"]


class Archive(Mapping):
    """Top-level keys of an archive and what lies below them, read when asked for."""

    def __init__(self, source, keep: Callable[[Any], object] | None = None, secret=None, verify: bool = False, headers: dict | None = None):
        self.file = source if hasattr(source, "read") else open_stream(source, headers=headers)
        self.header, entries = open_archive(self.file)
        check_mode(self.header, secret)
        self.secret, self.verify = secret, verify
        shown = lambda path: path[0] if len(path) == 1 and isinstance(path[0], str) else path
        self.entries = {e.path: e for e in entries if keep is None or keep(shown(e.path))}

    def __getitem__(self, key):
        below = self._below((key,))
        if not below:
            raise KeyError(key)
        return self._object(below, 1)

    def __iter__(self) -> Iterator:
        return iter(dict.fromkeys(p[0] for p in self.entries))

    def __len__(self) -> int:
        return len({p[0] for p in self.entries})

    def __contains__(self, key) -> bool:
        return any(p[0] == key for p in self.entries)

    def _below(self, prefix: tuple) -> list[tuple]:
        return [p for p in self.entries if p[: len(prefix)] == prefix]

    def _object(self, paths: list[tuple], cut: int):
        if len(paths) == 1 and len(paths[0]) == cut:
            return self.array(paths[0])
        return restructure([(p[cut:], self.array(p)) for p in paths])

    def array(self, path: tuple, verify: bool | None = None) -> np.ndarray:
        """One array by its whole path."""
        e = self.entries[path]
        _, body = payload(self.file, self.header, e, self.secret, self.verify if verify is None else verify)
        values = dtype.decode(body, *codec.split_dtype(e.dtype))
        return values.reshape(e.shape)

    def tree(self, prefix: tuple = (), default: Any = None, keep: Callable[[Any], object] | None = None):
        """The nested object below a path, an array if the path is a leaf, or default if nothing is there."""
        if isinstance(prefix, str | int):
            raise TypeError("a prefix is a tuple of keys")
        paths = [p for p in self._below(tuple(prefix)) if keep is None or keep(p)]
        return self._object(paths, len(prefix)) if paths else default

    def read(self, keep: Callable[[Any], object] | None = None, n: int = -1, after: tuple | None = None, raw: bool = True) -> Iterator[tuple]:
        """(module index, kind, name, array, is opaque, type name) in file order, at most n (-1: all), beyond after.
        Opaque arrays are an error unless raw."""
        if n < -1:
            raise ValueError("the number of arrays must be -1, 0 or positive")
        paths = [p for p in self.entries if keep is None or keep(p[0] if len(p) == 1 else p)]
        if after is not None:
            paths = paths[paths.index(after) + 1 :]
        for p in paths if n < 0 else paths[:n]:
            e = self.entries[p]
            numpy_dtype, torch_dtype = codec.split_dtype(e.dtype)
            if "V" in numpy_dtype and not raw:
                raise ValueError(f"{name_of(p)} is of type {torch_dtype}: raw data must be allowed")
            record, body = payload(self.file, self.header, e, self.secret, self.verify)
            values = dtype.decode(body, numpy_dtype, torch_dtype).reshape(e.shape)
            yield record.module_idx, e.tensor_type, name_of(p), values, "V" in numpy_dtype, torch_dtype

    def check(self, module: Mapping[str, np.ndarray]) -> tuple[bool, list[tuple[str, bool]]]:
        """Whether a module's arrays have the digests stored for their names, together and one by one."""
        out = []
        for p, e in self.entries.items():
            name, ok = name_of(p), False
            if name in module:
                self.file.seek(e.header_offset)
                record = codec.read_record(self.file, self.header.has_crypt, e)
                try:
                    codec.check_payload(record, b"" if e.is_meta else np.ascontiguousarray(module[name]).tobytes())
                    ok = True
                except codec.FormatError:
                    ok = False
            out.append((name, ok))
        return all(ok for _, ok in out), out

    def load_into(self, module: dict, keep: Callable[[Any], object] | None = None) -> int:
        """Puts arrays at their dotted names into nested dicts of modules; how many. Nested state has no module."""
        count = 0
        for _, kind, name, values, *_ in self.read(keep):
            if kind == codec.STATE_DICT:
                raise ValueError(f"{name} is nested state and can't be loaded into a module")
            at = module
            *above, last = name.lstrip(".").split(".")
            for step in above:
                at = at[step]
            at[last] = values
            count += 1
        return count

    @property
    def total_bytes(self) -> int:
        return sum(e.full_length for e in self.entries.values())

    def close(self) -> None:
        self.file.close()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()


def save(obj: Any, target, kind: int = codec.STATE_DICT, **options) -> None:
    """Writes nested mappings and sequences of numpy arrays as an archive, in the order of the structure."""
    rows = []
    for path, leaf in flatten(obj):
        a = np.asarray(leaf)
        order = a.dtype.str
        if order[1:] not in codec.ITEM_SIZES or order[0] == ">":
            raise TypeError(f"arrays of type {a.dtype} can't be stored")
        rows.append((path, kind, 0, order, a.shape, np.ascontiguousarray(a).tobytes()))
    if hasattr(target, "write"):
        codec.write_archive(rows, target, **options)
    else:
        with open_stream(target, "wb") as file:
            codec.write_archive(rows, file, **options)
