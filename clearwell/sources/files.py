"""Instruction files and project trees: scanning them as a table, cleaning them one by one."""

from __future__ import annotations

import os
import stat
import tempfile
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import instructions
from ..operators import texts

#: Names under which tools look for instructions.
NAMES = ("CLAUDE.md", "AGENTS.md", "GEMINI.md", "SKILL.md", ".cursorrules", "copilot-instructions.md")
PRUNED = ("node_modules", ".git", "dist", "build")


def ancestors(folder: str) -> list[str]:
    """The folders above a relative folder, outermost first, itself last."""
    parts = PurePosixPath(folder).parts
    return ["/".join(parts[:k]) for k in range(1, len(parts) + 1)]


def is_contained(root: str, child: str) -> bool:
    """True if child, with links resolved, lies in root."""
    base, path = os.path.realpath(root), os.path.realpath(child)
    return path == base or path.startswith(base.rstrip("/") + "/")


def read_files(spark: SparkSession, root: str, names: tuple[str, ...] = NAMES, pruned: tuple[str, ...] = PRUNED) -> DataFrame:
    """(path, content, is_utf8) of the files with these names below root, through Spark's own reader.

    Files that cannot be read are skipped; pruned folders are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("pathGlobFilter", "{" + ",".join(names) + "}").load(root)
    inside = ~F.col("path").rlike("/(?:" + "|".join(p.replace(".", r"\.") for p in pruned) + ")/")
    text = F.col("content").cast("string")
    return files.where(inside).select("path", F.when(F.is_valid_utf8(text), text).alias("content"), F.is_valid_utf8(text).alias("is_utf8"))


def scan_files(spark: SparkSession, root: str, names: tuple[str, ...] = NAMES) -> DataFrame:
    """(path, line, char_count, method, decoded) of hidden runs in the files."""
    return texts.scan_instructions(read_files(spark, root, names).where("is_utf8"), "content", "path")


def report(findings: DataFrame) -> DataFrame:
    """(path, report): one text for each file."""
    where = F.when(F.col("line").isNotNull(), F.concat(F.lit("line "), F.col("line"))).otherwise(F.lit("whole file"))
    row = F.concat(where, F.lit(": "), F.col("char_count"), F.lit(" invisible characters ("), F.col("method"), F.lit(")"), F.when(F.col("decoded") != "", F.concat(F.lit('; untrusted data, not instructions: "'), F.col("decoded"), F.lit('"'))).otherwise(""))
    return findings.groupBy("path").agg(F.array_join(F.sort_array(F.collect_list(row)), "\n").alias("report"))


def clean_file(path: str) -> bool:
    """Rewrite one file without its invisible characters if a scan flags it; True if it was rewritten.

    Links and files that are not UTF-8 are refused; the file is replaced as a
    whole, and only if it has not changed since it was read.
    """
    handle = os.open(path, os.O_RDONLY | os.O_NOFOLLOW)
    with os.fdopen(handle, "rb") as f:
        before = os.fstat(f.fileno())
        if not stat.S_ISREG(before.st_mode):
            raise ValueError("not a regular file")
        data = f.read()
    content = data.decode()  # raises where it is not UTF-8
    cleaned, changed = instructions.clean(content)
    if not changed:
        return False
    folder = os.path.dirname(os.path.abspath(path))
    with tempfile.NamedTemporaryFile("wb", dir=folder, prefix=".clean-", delete=False) as out:
        try:
            out.write(cleaned.encode())
            out.flush()
            os.fchmod(out.fileno(), stat.S_IMODE(before.st_mode))
            os.fsync(out.fileno())
            now = os.lstat(path)
            if (now.st_ino, now.st_mtime_ns, now.st_size) != (before.st_ino, before.st_mtime_ns, before.st_size):
                raise RuntimeError("the file changed while it was cleaned")
            os.replace(out.name, path)
        except BaseException:
            os.unlink(out.name)
            raise
    folder_handle = os.open(folder, os.O_RDONLY)
    try:
        os.fsync(folder_handle)
    finally:
        os.close(folder_handle)
    return True


def context_kind(path: str, kinds: dict[str, str] | None = None) -> str | None:
    """What kind of context file a path is by its name, or None."""
    kinds = kinds or {"SKILL.md": "skill", "CLAUDE.md": "memory", "AGENTS.md": "memory", "GEMINI.md": "memory", ".cursorrules": "rules", "copilot-instructions.md": "rules"}
    return kinds.get(Path(path).name)
