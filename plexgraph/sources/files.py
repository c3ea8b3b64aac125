"""Source files, change history and diffs as DataFrames."""

from __future__ import annotations

import fnmatch
import subprocess
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Languages by extension, Ruby files by name, and names and endings that are never read as source.
LANGUAGES = {
    "py": "python",
    "ts": "typescript", "tsx": "tsx",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "rb": "ruby", "rake": "ruby", "gemspec": "ruby", "ru": "ruby", "rbi": "ruby",
    "go": "go",
}
RUBY_FILES = ["Gemfile", "Rakefile", "Guardfile", "Capfile", "Vagrantfile", "Brewfile", "Podfile"]
IGNORED_NAMES = [
    ".git", ".idea", ".vscode", ".DS_Store",
    "node_modules", "dist", "build", "coverage",
    "__pycache__", ".venv", "venv", ".env", ".eggs", "egg-info", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".coverage", "htmlcov",
    "package-lock.json", "yarn.lock", "poetry.lock", "uv.lock",
]
IGNORED_ENDINGS = [".pyc", ".pyo", ".so", ".dylib", ".min.js", ".bundle.js", ".map"]


def language(path: Column) -> Column:
    """Language of a path by its name, then its extension; null if unknown."""
    name = F.element_at(F.split(path, "/"), -1)
    ext = F.regexp_extract(name, r"^.+\.([^.]+)$", 1)
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.when(name.isin(RUBY_FILES), "ruby").otherwise(F.try_element_at(known, ext))


def is_ignored(path: Column, patterns: list[str] | None = None) -> Column:
    """Whether a part of the path is one of the usual leftovers, or the path fits one of the glob patterns."""
    parts = F.split(path, "/")
    bad = F.arrays_overlap(parts, F.array(*[F.lit(n) for n in IGNORED_NAMES]))
    for e in IGNORED_ENDINGS:
        bad = bad | F.exists(parts, _ends_with(e))
    for p in patterns or []:
        anchored, bare = p.startswith("/"), p.strip("/")
        regex = fnmatch.translate(bare).removesuffix(r"\z").removesuffix(r"\Z").replace("(?s:", "(?:")
        bad = bad | F.rlike(path, F.lit(f"^{regex}(/|$)" if anchored or "/" in bare else f"(^|/){regex}(/|$)"))
    return bad


def _ends_with(ending: str):
    return lambda p: F.endswith(p, F.lit(ending))


def from_folder(spark: SparkSession, root: str, patterns: list[str] | None = None) -> DataFrame:
    """(path, content, language) of the files under a folder that Spark can read; binary, empty and unknown files are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file:")
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), f"^.*?{_quoted(base.lstrip('/'))}/", "")
    rows = raw.select(path.alias("path"), F.try_validate_utf8(F.col("content").cast("string")).alias("content"))
    return _wanted(rows, patterns)


def _quoted(text: str) -> str:
    import re

    return re.escape(text)


def _wanted(rows: DataFrame, patterns: list[str] | None) -> DataFrame:
    kept = rows.where(~is_ignored(F.col("path"), patterns)).withColumn("language", language(F.col("path")))
    return kept.where("language IS NOT NULL AND content IS NOT NULL AND trim(content) <> ''")


def git_paths(repo: str, timeout: int = 10) -> list[str] | None:
    """Tracked and untracked files that git doesn't ignore, sorted; null if git fails."""
    try:
        out = subprocess.run(["git", "ls-files", "-z", "--cached", "--others", "--exclude-standard"], cwd=repo, capture_output=True, timeout=timeout, check=True).stdout
    except (OSError, subprocess.SubprocessError):
        return None
    return sorted({p for p in out.decode("utf-8", "replace").split("\0") if p})


def from_repo(spark: SparkSession, repo: str, patterns: list[str] | None = None) -> DataFrame:
    """Files of a git work tree, or of the folder where git can't tell. The driver lists paths; tasks read the files."""
    paths = git_paths(repo)
    if paths is None:
        ignore = Path(repo, ".gitignore")
        extra = [x.strip() for x in ignore.read_text().splitlines() if x.strip() and not x.startswith("#")] if ignore.is_file() else []
        return from_folder(spark, repo, [*(patterns or []), *extra])
    known = spark.createDataFrame([(p,) for p in paths], "path string")
    return from_folder(spark, repo, patterns).join(known, "path", "left_semi")


def commits(lines: DataFrame, marker: str = "COMMIT:") -> DataFrame:
    """(commit, item) from the lines (pos, line) of ``git log --name-only`` whose headers start with a marker."""
    is_header = F.startswith("line", F.lit(marker))
    w = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)  # one repository's log
    numbered = lines.withColumn("commit", F.sum(is_header.cast("long")).over(w))
    return numbered.where(~is_header & (F.trim("line") != "") & (F.col("commit") > 0)).select("commit", F.trim("line").alias("item")).distinct()


def git_log(spark: SparkSession, repo: str, months: int = 6, timeout: int = 60) -> DataFrame:
    """(commit, item): files of each commit of the last months; empty if git fails."""
    try:
        run = subprocess.run(["git", "log", f"--since={months} months ago", "--name-only", "--pretty=format:COMMIT:%H"], cwd=repo, capture_output=True, timeout=timeout, check=True)
        lines = run.stdout.decode("utf-8", "replace").splitlines()
    except (OSError, subprocess.SubprocessError):
        lines = []
    return commits(spark.createDataFrame(list(enumerate(lines)), "pos long, line string"))


def hunks(diff: DataFrame) -> DataFrame:
    """(file, start, stop) of the new side of the hunks in a unified diff (id, diff); an empty hunk counts as one line."""
    lines = diff.select("id", F.posexplode(F.split("diff", "\n")).alias("pos", "line"))
    file = F.when(F.rlike("line", F.lit("^diff --git ")), F.regexp_extract("line", "^diff --git a/.* b/(.*)$", 1))
    w = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("file", F.last(file, ignorenulls=True).over(w))
    head = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    found = marked.where(F.rlike("line", F.lit(head)) & F.col("file").isNotNull())
    start = F.regexp_extract("line", head, 1).cast("long")
    count = F.when(F.regexp_extract("line", head, 2) == "", "1").otherwise(F.regexp_extract("line", head, 2)).cast("long")
    return found.select("file", start.alias("start"), (start + F.greatest(count, F.lit(1)) - 1).alias("stop"))


def changed_files(repo: str, base: str, head: str | None = None, timeout: int = 30) -> dict[str, str]:
    """path -> git's status letter between two refs, or between a ref and the work tree; untracked files count as added."""
    git = lambda *a: subprocess.run(["git", *a], cwd=repo, capture_output=True, timeout=timeout, check=True).stdout.decode("utf-8", "replace")
    out = {}
    for row in git("diff", "--name-status", base, *([head] if head else [])).splitlines():
        status, *names = row.split("\t")
        out[names[-1]] = status[0]
        if status[0] == "R":
            out[names[0]] = "D"
    if not head:
        out |= {p: "A" for p in git("ls-files", "--others", "--exclude-standard").splitlines()}
    return out


def content_at(repo: str, ref: str, path: str, timeout: int = 30) -> str | None:
    run = subprocess.run(["git", "show", f"{ref}:{path}"], cwd=repo, capture_output=True, timeout=timeout)
    return run.stdout.decode("utf-8", "replace") if run.returncode == 0 else None


def work_tree(repo: str, path: str) -> str | None:
    """A file's content as it stands in the work tree; null if it isn't there."""
    file = Path(repo, path)
    return file.read_text("utf-8", "replace") if file.is_file() else None


def paths_at(repo: str, ref: str, timeout: int = 30) -> list[str]:
    """Paths of all files at a ref."""
    out = subprocess.run(["git", "ls-tree", "-r", "-z", "--name-only", ref], cwd=repo, capture_output=True, timeout=timeout, check=True).stdout
    return sorted(p for p in out.decode("utf-8", "replace").split("\0") if p)


def registry(spark: SparkSession, folder: str) -> DataFrame:
    """(name, path, stats): one row for each ``<name>/meta.json`` of a registry folder."""
    meta = spark.read.option("multiLine", "true").schema("name string, path string, last_indexed_at string, stats map<string,bigint>").json(f"{folder}/*/meta.json")
    return meta
