"""Where modules are: search paths by resource type, newest first; in-memory resources; completion of names."""

from __future__ import annotations

import os
import posixpath

import pyarrow.fs as pafs

#: Relation -> resource type; extension -> mime type; mime type -> reader.
RELATIONS = {"ontology": "ontology", "typesystem": "typesystem", "document": "document", "": "any"}
MIME_TYPES = {"markup": "text/vnd.treeloom", "xml": "text/vnd.treeloom+xml", "css": "text/css"}
READERS = {"text/vnd.treeloom": "markup", "text/vnd.treeloom+xml": "xml"}
PRODUCES = {"text/vnd.treeloom": {"document", "ontology", "typesystem"}, "text/vnd.treeloom+xml": {"document", "ontology", "typesystem"}}


#: Data folders of the machine and of the user.
DEFAULT_ROOTS = ("/usr/share/treeloom", os.path.expanduser("~/.local/share/treeloom"))


def deduce(relation: str, path: str, wanted: set[str] | None = None) -> tuple[str, set[str]]:
    """Reader and resource types of a request; raises ValueError where they can't be told or do not agree."""
    extension = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else "markup"
    mime = MIME_TYPES.get(extension)
    if mime is None or mime not in READERS:
        raise ValueError(f"no reader for {path}")
    if relation not in RELATIONS:
        raise ValueError(f"unknown relation {relation}")
    types = PRODUCES[mime] if relation == "" else {RELATIONS[relation]} & PRODUCES[mime]
    types = types & wanted if wanted else types
    if not types:
        raise ValueError(f"{path} can't be a {relation}")
    return READERS[mime], types


class Locator:
    """Finds modules by name.  paths: resource type -> folders; static: path -> text."""

    def __init__(self, paths: dict[str, list[str]] | None = None, static: dict[str, str] | None = None):
        self.paths = {k: list(v) for k, v in (paths or {}).items()}
        self.static = static or {}

    def add_path(self, kind: str, folder: str) -> None:
        """The newest path is searched first."""
        have = self.paths.setdefault(kind, [])
        if folder in have:
            have.remove(folder)
        have.insert(0, folder)

    def add_roots(self, *bases: str) -> None:
        """Data folders: modules lie in their ontology and typesystem folders, anything in the folders themselves."""
        for base in bases:
            for kind in ("", "ontology", "typesystem"):
                folder = posixpath.join(base, kind) if kind else base
                if self._is_folder(folder):
                    self.add_path(kind, folder)

    def _is_folder(self, path: str) -> bool:
        fs, base = self._fs(path)
        return fs.get_file_info(base).type == pafs.FileType.Directory

    @staticmethod
    def _fs(path: str):
        if "://" in path:
            return pafs.FileSystem.from_uri(path)
        return pafs.LocalFileSystem(), path

    def _names(self, folder: str) -> list[str]:
        if not folder:
            return []
        fs, base = self._fs(folder)
        return [f.path for f in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if f.is_file]

    @staticmethod
    def _complete(path: str, names: list[str]) -> list[str]:
        """The file itself, else name.* without backups."""
        if path in names:
            return [path]
        return sorted(n for n in names if n.startswith(path + ".") and not n.endswith("~") and not n.endswith("backup"))

    def autocomplete(self, path: str) -> list[str]:
        folder = posixpath.dirname(path) or "."
        return self._complete(path, [*self._names(folder), *self.static])

    def locate(self, path: str, kind: str = "", relative_to: str = "") -> str | None:
        """Full path; ./ and ../ look beside the importing file only."""
        candidates = []
        if not path.startswith(("./", "../")):
            candidates += [posixpath.join(p, path) for k in (kind, "") for p in self.paths.get(k, [])]
        candidates += [posixpath.normpath(posixpath.join(posixpath.dirname(relative_to), path)), path]
        for c in candidates:
            found = self._complete(c, list(self.static))
            if not found and self.paths:
                found = self._complete(c, self._names(posixpath.dirname(c)))
            if found:
                return found[0]
        return None

    def read(self, path: str) -> str:
        if path in self.static:
            return self.static[path]
        fs, p = self._fs(path)
        with fs.open_input_stream(p) as f:
            return f.read().decode()

    def listing(self, extensions: tuple[str, ...]) -> list[str]:
        out = [*self.static]
        for folders in self.paths.values():
            for f in folders:
                out += self._names(f)
        return sorted(p for p in out if p.rsplit(".", 1)[-1] in extensions)
