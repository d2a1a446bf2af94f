"""Corpora of source files: folders and archives as rows of files, files as rows of lines."""

from __future__ import annotations

import io
import lzma
import re
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taintloom.functions.catalog import COLLECTORS

# Limits of an archive.
MAX_FILES, MAX_TOTAL, MAX_FILE = 10_000, 200 * 1024 * 1024, 50 * 1024 * 1024

FILES = "project_id string, path string, language string, text string"


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 text; bytes that are none are deleted."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))


def in_scope(relative: Column, language: str, collector: str = "pipeline") -> Column:
    """Does a collector take a path? It has suffixes for each language (in any case, or as they are written), and folders and
    beginnings of folders that it leaves out. Parts are those below the project's root: a project that is itself stored
    below a folder named build is scanned."""
    c = COLLECTORS[collector]
    parts = F.split(relative, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1) if c["folders_only"] else parts
    suffix = F.regexp_extract(relative, r"(\.[^./]+)$", 1)
    ok = (F.lower(suffix) if c["any_case"] else suffix).isin(c["suffixes"].get(language, [])) & ~F.arrays_overlap(folders, F.array(*(F.lit(x) for x in c["excluded"])))
    if c["excluded_beginnings"]:
        ok &= ~F.exists(folders, lambda x: x.rlike("^(?:" + "|".join(map(re.escape, c["excluded_beginnings"])) + ")"))
    return ok


def read_files(spark: SparkSession, root: str, project_id: str, language: str, collector: str = "pipeline") -> DataFrame:
    """The files of one language below a folder that a collector takes. Suffix and folder filters run before any file's bytes
    are read into text."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.sub(r"^\w+:/*", "/", root).rstrip("/") + "/"
    relative = F.substring_index(F.col("path"), base, -1)
    return raw.where(in_scope(relative, language, collector)).select(F.lit(project_id).alias("project_id"), relative.alias("path"), F.lit(language).alias("language"), decoded(F.col("content")).alias("text"))


def member_fault(name: str) -> str | None:
    """Why an archive member is refused, or None."""
    clean = name.replace("\\", "/")
    if not clean.strip("/ "):
        return "empty"
    if clean.startswith("/") or re.match(r"^[A-Za-z]:", clean):
        return "absolute"
    if ".." in clean.split("/"):
        return "escaping"
    return None


def members(data: bytes, names: str | None = None) -> Iterator[tuple[str, int, bytes]]:
    """(name, size, bytes) of the regular members of a zip or tar (gz, bz2, xz) archive; all are checked before any is
    given out. ValueError: no archive, an empty one, a refused member or a limit passed. names: a regular expression that
    names must hold; other members are checked, but not read."""
    wanted = re.compile(names or "")
    stream = io.BytesIO(data)
    if zipfile.is_zipfile(stream):
        with zipfile.ZipFile(stream) as z:
            infos = [i for i in z.infolist() if not i.is_dir() and (i.external_attr >> 28) in (0, 8)]
            _check([(i.filename, i.file_size) for i in infos])
            for i in infos:
                if wanted.search(i.filename):
                    yield i.filename, i.file_size, z.read(i)
        return
    stream.seek(0)
    try:
        tar = tarfile.open(fileobj=stream)
    except tarfile.TarError as e:
        raise ValueError("not a zip or tar archive") from e
    with tar:
        infos = [m for m in tar.getmembers() if m.isreg()]
        _check([(m.name, m.size) for m in infos])
        for m in infos:
            if wanted.search(m.name):
                yield m.name, m.size, tar.extractfile(m).read()


def _check(found: list[tuple[str, int]]) -> None:
    if not found:
        raise ValueError("the archive is empty")
    for name, size in found:
        if fault := member_fault(name):
            raise ValueError(f"{fault} member name: {name!r}")
        if size > MAX_FILE:
            raise ValueError(f"member too large: {name!r}")
    if len(found) > MAX_FILES or sum(s for _, s in found) > MAX_TOTAL:
        raise ValueError("the archive has too many files or bytes")


#: Bytes of members that a task gives out at a time.
FRAME_BYTES = 16 << 20


def read_archives(spark: SparkSession, path: str, names: str | None = None) -> DataFrame:
    """(archive, name, size, content, fault) of archives' members, an archive to a task; nothing is written to disk. A
    refused archive gives one row with its fault instead of an error, so one bad upload doesn't fail a batch. names: a
    regular expression for the members to read."""
    return unpacked(spark.read.format("binaryFile").load(path).select("path", "content"), names)


def unpacked(archives: DataFrame, names: str | None = None) -> DataFrame:
    """The same for archives (path, content) that are rows already. An archive is read through once before any of its members
    is given out, so a broken one gives its fault alone; members are then given out some FRAME_BYTES at a time, so that a
    task holds an archive and few of its members."""
    columns = ["archive", "name", "size", "content", "fault"]

    def unpack(frames):
        import pandas as pd

        for f in frames:
            for archive, content in f[["path", "content"]].itertuples(index=False):
                try:
                    for _ in members(content, names):
                        pass
                except (ValueError, OSError, EOFError, zipfile.BadZipFile, zlib.error, lzma.LZMAError) as e:
                    yield pd.DataFrame([(archive, None, None, None, str(e))], columns=columns)
                    continue
                rows, held = [], 0
                for n, s, c in members(content, names):
                    rows.append((archive, n, s, c, None))
                    held += s
                    if held > FRAME_BYTES:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=columns)

    return archives.select("path", "content").mapInPandas(unpack, "archive string, name string, size long, content binary, fault string")


def archive_guard(found: DataFrame, key: str = "archive") -> DataFrame:
    """(key, files, bytes, ok): the archive limits as one aggregation over member rows (name, size)."""
    sums = found.groupBy(key).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.max("size").alias("largest"))
    return sums.select(key, "files", "bytes", ((F.col("files") <= MAX_FILES) & (F.col("bytes") <= MAX_TOTAL) & (F.col("largest") <= MAX_FILE)).alias("ok"))


def code_lines(files: DataFrame) -> DataFrame:
    """(project_id, path, language, line_no, code): lines from 1."""
    split = files.select("project_id", "path", "language", F.posexplode(F.split("text", "\n", -1)).alias("__p", "code"))
    return split.select("project_id", "path", "language", (F.col("__p") + 1).alias("line_no"), "code")
