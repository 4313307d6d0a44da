"""What a path says: language, relevance, test code, module."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
LANGUAGES = {
    "py": "python",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript",
    "ts": "typescript", "tsx": "tsx",
    "go": "go", "rs": "rust",
    "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp",
    "java": "java", "rb": "ruby", "php": "php", "swift": "swift",
    "kt": "kotlin", "scala": "scala", "lua": "lua",
    "sh": "bash", "bash": "bash", "cs": "c_sharp",
}
IRRELEVANT_SUFFIXES = [
    "css", "scss", "sass", "less", "md", "rst",
    "png", "jpg", "jpeg", "gif", "svg", "ico", "bmp", "webp",
    "woff", "woff2", "ttf", "eot", "otf",
    "pdf", "zip", "tar", "gz", "bz2", "lock",
]
IGNORED_DIRECTORIES = [
    ".git", ".hg", ".svn", ".venv", "venv", "env", "__pycache__",
    "node_modules", ".mypy_cache", ".ruff_cache", ".pytest_cache",
    "dist", "build", ".eggs", ".tox", ".cache", "htmlcov", ".idea", ".vscode",
]
IGNORED_SUFFIXES = ["pyc", "pyo", "so", "o", "a", "dylib", "class"]


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def suffix(path: Column) -> Column:
    """Last suffix in lower case without its dot; '' for none and for names that only begin with a dot."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def language(path: Column) -> Column:
    """Language by suffix; null where it is unknown."""
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(names, suffix(path))


def is_irrelevant(path: Column) -> Column:
    """Files that cannot matter for security."""
    return F.coalesce(suffix(path).isin(IRRELEVANT_SUFFIXES), F.lit(False))


def is_ignored(path: Column) -> Column:
    """Files that a directory walk leaves out."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.lit(0), F.size(F.split(path, "/")) - 1))
    inside = F.arrays_overlap(folders, F.array(*[F.lit(d) for d in IGNORED_DIRECTORIES]))
    return F.coalesce(inside | suffix(path).isin(IGNORED_SUFFIXES), F.lit(False))


def path_key(path: Column) -> Column:
    """Key that joins paths with and without `./`: every leading dot and slash dropped. Never for display."""
    return F.regexp_replace(path, r"^[./]+", "")


def is_test_path(path: Column) -> Column:
    key, name = path_key(path), base_name(path_key(path))
    found = (
        key.startswith("tests/") | key.startswith("test/") | name.startswith("test_") | name.endswith("_test.py") | (name == "conftest.py")
    )
    return F.coalesce(found, F.lit(False))


def module_name(path: Column) -> Column:
    """Dotted module of a Python path; a package for its __init__; '' for anything else."""
    dotted = F.translate(F.regexp_replace(path, r"\.py$", ""), "/", ".")
    return F.when(path.endswith(".py"), F.regexp_replace(dotted, r"(^|\.)__init__$", "")).otherwise("")
