"""Files as rows: reading, ignoring, classifying and routing them."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions of each language, dependency manifests, lock files, binary extensions, role patterns.
LANGUAGES = {
    "javascript": (".js", ".jsx", ".mjs", ".cjs"),
    "typescript": (".ts", ".tsx", ".mts", ".cts"),
    "python": (".py", ".pyw", ".pyi"),
    "java": (".java",),
    "go": (".go",),
    "php": (".php", ".phtml"),
    "ruby": (".rb", ".rake", ".gemspec"),
    "csharp": (".cs",),
    "c": (".c", ".h"),
    "cpp": (".cpp", ".cc", ".cxx", ".hpp", ".hxx"),
    "rust": (".rs",),
    "kotlin": (".kt", ".kts"),
    "swift": (".swift",),
}
DEPENDENCY_FILES = (
    "package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml",
    "requirements.txt", "Pipfile", "Pipfile.lock", "poetry.lock", "setup.py", "setup.cfg", "pyproject.toml",
    "pom.xml", "build.gradle", "build.gradle.kts", "gradle.lockfile",
    "go.mod", "go.sum", "Cargo.toml", "Cargo.lock", "Gemfile", "Gemfile.lock",
    "composer.json", "composer.lock", "packages.config", "Directory.Packages.props",
)
LOCK_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Pipfile.lock", "poetry.lock", "composer.lock", "Cargo.lock", "Gemfile.lock", "gradle.lockfile", "go.sum")
BINARY_EXTENSIONS = (
    ".exe", ".dll", ".so", ".dylib", ".o", ".obj", ".class", ".jar", ".war", ".ear", ".zip", ".tar", ".gz", ".rar",
    ".png", ".jpg", ".jpeg", ".gif", ".ico", ".svg", ".bmp", ".webp", ".mp3", ".mp4", ".wav", ".avi", ".mov", ".wmv",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".woff", ".woff2", ".ttf", ".eot", ".otf", ".pyc", ".pyo", ".wasm",
)
VENDOR_FOLDER = r"(?i)(?:^|[\\/])(?:vendor|third[_-]?party|bower_components|externals?)[\\/]"
VENDOR_FILE = r"(?i)(?:jquery|lodash|underscore|backbone|angular|react\.production|vue\.global|bootstrap|popper|moment(?:\.min)?|d3|select2|sweetalert|highlight|firebug)(?:[.-][\w.]+)?\.js$"
MINIFIED = r"(?i)\.min\.(?:js|css)$"
TEST_FOLDER = r"(?i)(?:^|[\\/])(?:tests?|__tests__|spec|__spec__|fixtures?|mocks?|__mocks__|e2e|integration|cypress|playwright)[\\/]"
TEST_FILE = r"(?i)\.(?:test|spec|mock|fixture|e2e|cy)\."
MAX_BYTES = 5 * 1024 * 1024

EXTENSION_LANGUAGE = {e: language for language, es in LANGUAGES.items() for e in es}


def read_files(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """path, size, content (UTF-8) and readable of the files under a folder, or of one file; larger and empty ones are not read.

    ``length`` is a filter of the reader, so large files are never loaded.
    Spark's readers leave out names that start with ``_`` or a point; a table of
    path and content can hold such files.  A file that is not UTF-8 fails nothing: it has no content and is not readable.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where((F.col("length") <= max_bytes) & (F.col("length") > 0))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return rows.select("path", F.col("length").alias("size"), text.alias("content"), text.isNotNull().alias("readable"))


def relative(path: Column, root: str) -> Column:
    """The part of a path below a folder; a path elsewhere stays."""
    bare = lambda c: F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*:/+", "/")
    base = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/+", "/", root).rstrip("/") + "/"
    return F.when(F.startswith(bare(path), F.lit(base)), F.substr(bare(path), F.lit(len(base) + 1))).otherwise(path)


#: Names of ignore files at the root of a scanned folder.
IGNORE_FILES = (".gitignore", ".codesiftignore")


def ignore_lines(spark: SparkSession, root: str) -> list[str]:
    """The lines of the ignore files at the root of a folder, in order; a folder without them has none.

    Spark's readers leave out names that start with a point, so the driver
    reads these few lines from the file system itself.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found: list[str] = []
    for name in IGNORE_FILES:
        path = jvm.org.apache.hadoop.fs.Path(root, name)
        system = path.getFileSystem(conf)
        if system.exists(path):
            stream = system.open(path)
            try:
                found += jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")
            finally:
                stream.close()
    return found


def glob_regex(pattern: str) -> str:
    """An include glob on relative paths: ``**/`` for any folders, ``*``, ``?`` and ``[...]`` within one name, ``{a,b}`` for either."""
    pieces = re.split(r"(\*\*/|\*\*|\*|\?|\[[^\]]+\]|\{[^}]*\})", pattern)
    known = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}

    def piece(p: str) -> str:
        if p in known:
            return known[p]
        if p.startswith("[") and p.endswith("]"):
            return p.replace("[!", "[^", 1)
        if p.startswith("{") and p.endswith("}"):
            return "(?:" + "|".join(glob_regex(x)[1:-1] for x in p[1:-1].split(",")) + ")"
        return re.escape(p)

    return "^" + "".join(map(piece, pieces)) + "$"


def extension(path: Column) -> Column:
    """From the last point of the name, in lower case; empty if there is none or the name begins with it."""
    name = basename(path)
    tail = F.concat(F.lit("."), F.substring_index(name, ".", -1))
    return F.when(path.isNull(), None).when(F.contains(name, F.lit(".")) & (tail != name), F.lower(tail)).otherwise("")


def basename(path: Column) -> Column:
    return F.substring_index(F.substring_index(path, "/", -1), "\\", -1)


def language(path: Column) -> Column:
    """By extension; null if unknown."""
    table = F.create_map(*(F.lit(x) for pair in EXTENSION_LANGUAGE.items() for x in pair))
    return F.try_element_at(table, extension(path))


def fits(text: Column, expression: str, *words: str) -> Column:
    """``text.rlike(expression)``, tried only on texts that hold one of the words, in any case, that its matches must hold."""
    return reduce(lambda a, b: a | b, (F.contains(F.lower(text), F.lit(w)) for w in words)) & text.rlike(expression)


def classify(files: DataFrame) -> DataFrame:
    """The rows with language ('unknown' for manifests without one) and the five role flags."""
    path, name = F.col("path"), basename(F.col("path"))
    manifest = name.isin(*DEPENDENCY_FILES)
    return files.select(
        "*",
        F.coalesce(language(path), F.when(manifest, "unknown")).alias("language"),
        manifest.alias("is_dependency_file"),
        name.isin(*LOCK_FILES).alias("is_lock_file"),
        (fits(path, VENDOR_FOLDER, "vendor", "third", "bower_components", "external") | fits(name, VENDOR_FILE, ".js")).alias("is_vendor_file"),
        fits(name, MINIFIED, ".min.").alias("is_minified"),
        (path.rlike(TEST_FOLDER) | name.rlike(TEST_FILE)).alias("is_test_file"),
        extension(path).isin(*BINARY_EXTENSIONS).alias("is_binary"),
    )


def discover(files: DataFrame, ignore: Sequence[str] = (), languages: Sequence[str] = (), include: Sequence[str] = (), root: str = "") -> DataFrame:
    """Classified files that are to be scanned: of a known language or a manifest, neither binary nor ignored.

    ``include``: globs of which one must fit the path below ``root``, if there
    are any.  Files and folders whose name starts with a point are left out.
    """

    def wanted(path: Column) -> Column:
        below = relative(path, root) if root else path
        known = F.coalesce(language(path), F.when(basename(path).isin(*DEPENDENCY_FILES), "unknown")).isNotNull()
        kept = known & ~extension(path).isin(*BINARY_EXTENSIONS) & ~ignored(below, ignore) & ~((F.contains(below, F.lit("/.")) | below.startswith(".")) & below.rlike(r"(?:^|/)\.[^./]"))
        return kept & below.rlike("|".join(map(glob_regex, include))) if include else kept

    # Compiled with the rest of the stage; a lambda would be interpreted for each path.
    found = classify(files).where(wanted(F.col("path")))
    if languages and "auto" not in languages:
        found = found.where(F.col("language").isin(*languages) | (F.col("language") == "unknown"))
    return found.drop("is_binary")


def ignore_rules(patterns: Sequence[str]) -> list[tuple[str, bool]]:
    """Ignore-file lines as (expression on the path, whether it takes files back), in order."""
    out = []
    for line in patterns:
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        back = line.startswith("!")
        body = line[back:]
        anchored = "/" in body.rstrip("/")
        folder = body.endswith("/")
        body = body.strip("/")
        pieces = re.split(r"(\*\*/|/\*\*|\*\*|\*|\?|\[[^\]]+\])", body)
        known = {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
        expression = "".join(known.get(p, p if p.startswith("[") and p.endswith("]") else re.escape(p)) for p in pieces)
        out.append((("^" if anchored else "(?:^|/)") + expression + ("/" if folder else "(?:/|$)"), back))
    return out


def ignored(path: Column, patterns: Sequence[str]) -> Column:
    """The last pattern that fits decides, as in ignore files."""
    result = F.lit(False)
    for expression, back in ignore_rules(patterns):
        result = F.when(path.rlike(expression), F.lit(not back)).otherwise(result)
    return result


def by_path(rows: DataFrame) -> DataFrame:
    """The rows dealt out by path to as many tasks as a shuffle has: with the number left to Spark, short texts would meet in few tasks, though they take long."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")


def dealt(files: DataFrame) -> DataFrame:
    """path, language and content of the files, each path in one task: lines and findings that come of them lie by file and need no shuffle.

    The columns travel as one, which Spark does not prune, so that all readers in a query share one shuffle.
    """
    known = files.where(F.col("path").isNotNull() & F.col("content").isNotNull())
    packed = by_path(known.select("path", F.array("language", "content").alias("_file")))
    return packed.select("path", F.get("_file", F.lit(0)).alias("language"), F.get("_file", F.lit(1)).alias("content"))


def route(files: DataFrame) -> DataFrame:
    """Which scanners a classified file goes to: cve for manifests, security for all but lock, vendor and minified files, quality for all."""
    return files.select(
        "*",
        F.col("is_dependency_file").alias("to_cve"),
        (~F.col("is_lock_file") & ~F.col("is_vendor_file") & ~F.col("is_minified")).alias("to_security"),
        F.lit(True).alias("to_quality"),
    )
