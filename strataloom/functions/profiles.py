"""The kind and the languages of a repository by the names of its files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Endings of file names and the languages that they stand for.
LANGUAGES = {
    "py": "Python", "js": "JavaScript", "jsx": "JSX", "ts": "TypeScript", "tsx": "TSX", "php": "PHP", "java": "Java", "kt": "Kotlin", "go": "Go",
    "rs": "Rust", "c": "C", "h": "C", "cpp": "C++", "hpp": "C++", "cs": "C#", "rb": "Ruby", "swift": "Swift", "scala": "Scala", "sql": "SQL", "sh": "Bash",
    "html": "HTML", "css": "CSS", "scss": "SCSS", "json": "JSON", "yaml": "YAML", "yml": "YAML", "toml": "TOML", "xml": "XML", "md": "Markdown", "vue": "Vue",
}


def language_of(filename: Column) -> Column:
    """The language of a file by its name's ending; null for others, and for folders."""
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.when(filename.endswith("/"), None).otherwise(F.get(F.array(names[F.lower(F.regexp_extract(filename, r"\.([^./]+)$", 1))]), F.lit(0)))


def languages(files: DataFrame) -> DataFrame:
    """(repo, language, files) of files(repo, filename)."""
    rows = files.withColumn("language", language_of(F.col("filename"))).where("language IS NOT NULL")
    return rows.groupBy("repo", "language").agg(F.count(F.lit(1)).alias("files"))


def profiles(files: DataFrame) -> DataFrame:
    """(repo, profile) of files(repo, filename): laravel by one telling file, python by its project files, else universal."""
    # fixed values: the telling names
    name = F.col("filename")
    laravel = (name == "artisan") | name.endswith(".blade.php") | name.startswith("app/Http/")
    python = name.isin("setup.py", "pyproject.toml")
    found = files.groupBy("repo").agg(F.max(F.coalesce(laravel, F.lit(False))).alias("a"), F.max(F.coalesce(python, F.lit(False))).alias("b"))
    return found.select("repo", F.when(F.col("a"), "laravel").when(F.col("b"), "python").otherwise("universal").alias("profile"))


def tree_profile(tree: Column) -> Column:
    """The profile by a printed tree of folders and files."""
    # fixed values: the telling parts of a tree
    flat = F.lower(F.regexp_replace(tree, r"[\u2502\u251c\u2514\u2500\u250c\u2510\u2518\u2524\u252c\u2534\u253c\s]+", " "))
    has = lambda *parts: F.greatest(*[F.contains(flat, F.lit(p)) for p in parts], F.lit(False))
    folders = has("app/ http/", "app/ livewire/", "app/ filament/", "app/http/", "app/livewire/", "app/filament/")
    laravel = (has("artisan") & has("composer.json")) | has(".blade.php") | (has("artisan") & folders)
    return F.when(laravel, "laravel").when(has(".py") & has("setup.py", "pyproject.toml", "requirements.txt"), "python").otherwise("universal")
