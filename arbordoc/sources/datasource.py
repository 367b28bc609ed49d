"""A Spark data source for the entries of encoded maps: spark.read.format("arbordoc").option("path", folder)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

from .cursor import Document, to_json
from .documents import ENDINGS, format_of_name, parse_json, render_to
from .encoder import Options


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path)


class FilePartition(InputPartition):
    def __init__(self, uri: str, fmt: str):
        self.uri, self.fmt = uri, fmt


class EntriesReader(DataSourceReader):
    """One partition per file. Filters on key go into the document: equality and IN become lookups, a prefix becomes a range scan of the index."""

    def __init__(self, options: dict):
        self.options = options
        self.keys: set[str] | None = None
        self.prefix = ""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("key",):
                self._only({f.value})
            elif isinstance(f, In) and f.attribute == ("key",):
                self._only(set(f.value))
            elif isinstance(f, StringStartsWith) and f.attribute == ("key",) and (f.value.startswith(self.prefix) or self.prefix.startswith(f.value)):
                self.prefix = max(self.prefix, f.value, key=len)
            else:
                yield f

    def _only(self, keys: set) -> None:
        self.keys = keys if self.keys is None else self.keys & keys

    def partitions(self) -> list[FilePartition]:
        from pyarrow import fs

        store, base = _store(self.options["path"])
        info = store.get_file_info(base)
        files = [info] if info.is_file else store.get_file_info(fs.FileSelector(base))
        found = [(f.path, self.options.get("format") or format_of_name(f.path)) for f in sorted(files, key=lambda f: f.path) if f.is_file]
        return [FilePartition(p, f) for p, f in found if f in ("text", "binary", "json")]

    def read(self, partition: FilePartition):
        store, _ = _store(self.options["path"])
        with store.open_input_file(partition.uri) as f:
            data = f.read()
        if partition.fmt == "json":
            value = parse_json(data.decode())
            rows = value.items() if isinstance(value, dict) else ()
            rows = ((k, to_json(v)) for k, v in rows if k.startswith(self.prefix) and (self.keys is None or k in self.keys))
        else:
            d = Document(data.strip() if partition.fmt == "text" else data, partition.fmt)
            root = d.target(d.root)
            if self.keys is not None:
                hits = ((k, d.find(root, k)) for k in sorted(self.keys) if k.startswith(self.prefix))
                found = ((k, r) for k, r in hits if r is not None)
            else:
                found = d.prefix(root, self.prefix)
            rows = ((k, to_json(d.value(r))) for k, r in found)
        for k, v in rows:
            yield partition.uri, k, v


class Written(WriterCommitMessage):
    def __init__(self, folder: str):
        self.folder = folder


class DocumentsWriter(DataSourceWriter):
    """Each task writes the documents (name, json) of its partition as files of their own into a folder that readers don't see; names must be different.

    When all tasks have ended well their files move into place; overwrite: what was there in any of the formats goes. A job that fails leaves nothing.
    """

    def __init__(self, options: dict, overwrite: bool = False):
        self.options, self.overwrite, self.job = options, overwrite, f"_writing-{uuid.uuid4().hex}"

    def write(self, rows) -> WriterCommitMessage:
        store, base = _store(self.options["path"])
        fmt = self.options.get("format", "text")
        ending = ENDINGS[fmt]
        folder = f"{base}/{self.job}/{uuid.uuid4().hex}"
        store.create_dir(folder, recursive=True)
        tune = {k: kind(self.options[k]) for k, kind in (("index_over", float), ("chain_over", int), ("delimiters", str), ("share_below", float)) if k in self.options}
        for r in rows:
            with store.open_output_stream(f"{folder}/{r['name']}{ending}") as out:
                render_to(out, parse_json(r["json"]), fmt, Options(**tune))
        return Written(folder)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, base = _store(self.options["path"])
        made = [f.path for m in messages if m for f in store.get_file_info(fs.FileSelector(m.folder)) if f.is_file]
        names = [p.rpartition("/")[2] for p in made]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError(f"several documents have the name {next(n for n in names if names.count(n) > 1)!r}")
        there = {f.base_name: f.path for f in store.get_file_info(fs.FileSelector(base, allow_not_found=True)) if f.is_file and (format_of_name(f.path) or f.path.endswith(ENDINGS["tree"]))}
        for n, p in there.items():
            if self.overwrite or n in names:
                store.delete_file(p)
        for n, p in zip(names, made):
            store.move(p, f"{base}/{n}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, base = _store(self.options["path"])
        if store.get_file_info(f"{base}/{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{base}/{self.job}")


class ArbordocSource(DataSource):
    """Reading gives (file, key, value as JSON text), one row per entry of each file's root map. Options: path, format (else by the file's ending).

    Filters on key are pushed down when spark.sql.python.filterPushdown.enabled is true. Paths are opened by pyarrow's file systems.
    """

    @classmethod
    def name(cls) -> str:
        return "arbordoc"

    def schema(self) -> str:
        return "file string, key string, value string"

    def reader(self, schema) -> EntriesReader:
        return EntriesReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DocumentsWriter:
        return DocumentsWriter(dict(self.options), overwrite)


def register(spark) -> None:
    spark.dataSource.register(ArbordocSource)
