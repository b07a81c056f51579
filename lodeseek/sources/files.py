"""Directory source: Spark's binaryFile reader, classified, filtered and hashed with column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash

# The lists that decide what is indexed.
LANGUAGES = {
    ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "jsx", ".py": "python", ".rs": "rust", ".go": "go", ".java": "java", ".rb": "ruby",
    ".php": "php", ".c": "c", ".cpp": "cpp", ".h": "c", ".hpp": "cpp", ".cs": "c_sharp", ".swift": "swift", ".kt": "kotlin", ".scala": "scala",
    ".lua": "lua", ".sh": "bash", ".bash": "bash", ".zsh": "bash", ".css": "css", ".html": "html", ".vue": "vue", ".svelte": "svelte",
}
DOC_EXTENSIONS = [".md", ".mdx", ".rst", ".txt", ".adoc"]
IGNORED_DIRS = ["node_modules", ".next", ".git", "dist", "build", "out", ".output", "coverage", "__pycache__", ".cache", ".turbo", "target", "vendor", ".venv", "venv", ".env"]
IGNORED_FILES = ["package-lock.json", "pnpm-lock.yaml", "yarn.lock", "bun.lockb"]


def extension(path: Column) -> Column:
    """From the last dot on, case kept; a name without a dot gives its last character."""
    return F.when(F.contains(path, F.lit(".")), F.regexp_extract(path, r"(\.[^.]*)\z", 1)).otherwise(F.right(path, F.lit(1)))


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(table, extension(path))


def is_doc(path: Column) -> Column:
    return extension(path).isin(DOC_EXTENSIONS)


def is_ignored(path: Column) -> Column:
    """A directory on the relative path is ignored or hidden, or the file is a lock file."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.exists(dirs, lambda d: d.isin(IGNORED_DIRS) | F.startswith(d, F.lit("."))) | F.element_at(parts, -1).isin(IGNORED_FILES)


def relative_path(path: Column, root: str) -> Column:
    plain = F.regexp_replace(path, "^[a-z0-9]+:/*", "/")
    bare = "/" + root.split(":", 1)[-1].strip("/") + "/"
    return F.when(F.startswith(plain, F.lit(bare)), F.substr(plain, F.lit(len(bare) + 1))).otherwise(plain)


def classified(files: DataFrame) -> DataFrame:
    """(path, content) -> path, content, hash, size, language (null for documents), is_doc; ignored and unknown files are left out."""
    rows = files.where(~is_ignored(F.col("path"))).withColumn("language", language_of(F.col("path"))).withColumn("is_doc", is_doc(F.col("path")))
    rows = rows.where(F.col("language").isNotNull() | F.col("is_doc"))
    return rows.select("path", "content", content_hash(F.col("content")).alias("hash"), F.octet_length("content").cast("long").alias("size"), "language", "is_doc")


def read_directory(spark: SparkSession, root: str, subdirectory: str = "") -> DataFrame:
    """Files under root (or a part of it), with paths relative to root in both cases. The extensions are filtered in the listing, before contents are read."""
    globs = ",".join(sorted({*(e[1:] for e in LANGUAGES), *(e[1:] for e in DOC_EXTENSIONS)}))
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + globs + "}").load(f"{root.rstrip('/')}/{subdirectory}".rstrip("/"))
    return classified(raw.select(relative_path(F.col("path"), root).alias("path"), F.decode("content", "UTF-8").alias("content")))
