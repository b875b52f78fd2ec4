"""Queries of the dependency and advisory operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift.operators import dependencies as deps
from codesift.sources import manifests as src
from codesift.sources.corpus import quoted

QUERIES, ORACLE_SQL = {}, {}

PACKAGES_SQL = f"""packages AS (SELECT DISTINCT l_suppkey AS supplier, l_suppkey % {len(src.FORMATS)} AS kind, l_partkey AS part, 'pkg' || l_partkey AS name,
    (l_partkey % 4) || '.' || (l_partkey % 11) || '.' || ((l_partkey + l_suppkey) % 5) AS version FROM lineitem)"""
#: Rows that a manifest holds besides its parts: name, version, whether for development.
EXTRA = {1: (("example.org/single", "v1.0.0", False),), 2: (("dev-only", "2.0.0", True),), 3: (("mock", "0.3.1", True),), 4: (("rake", "*", False),), 5: (("vendor/tests", "9.5.0", True),), 6: (("org.free:free", "*", False),), 8: (("pytest", "*", True),)}
PARSER = ("requirements", "go_mod", "package_json", "cargo", "gemfile", "composer", "pom", "gradle", "pipfile", "pyproject")


def _sql(kind: int) -> str:
    path = f"'deps/s' || supplier || '/{src.FORMATS[kind][0]}'"
    name = "replace(" + quoted(src.NAMES[kind]) + ", '%n', name)"
    version = "'v' || version" if kind == 1 else "version"
    parts = [f"SELECT {path} AS path, {name} AS name, {version} AS version, {quoted(src.ECOSYSTEMS[kind])} AS ecosystem, false AS is_dev FROM packages WHERE kind = {kind}"]
    for n, v, dev in EXTRA.get(kind, ()):
        parts.append(f"SELECT DISTINCT {path}, {quoted(n)}, {quoted(v)}, {quoted(src.ECOSYSTEMS[kind])}, {str(dev).lower()} FROM packages WHERE kind = {kind}")
    return " UNION ALL ".join(parts)


def _register(kind: int) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return deps.PARSERS[PARSER[kind]](src.manifests(spark, sf_dir)).select("path", "name", "version", "ecosystem", "is_dev")

    QUERIES[f"deps_{PARSER[kind]}"] = query
    ORACLE_SQL[f"deps_{PARSER[kind]}"] = f"WITH {PACKAGES_SQL} {_sql(kind)}"


for _kind in range(len(PARSER)):
    _register(_kind)

ALL_SQL = f"{PACKAGES_SQL}, deps AS ({' UNION ALL '.join(_sql(k) for k in range(len(PARSER)))})"
NAMES_SQL = ", ".join(quoted(n) for n in src.NAMES[:7])
ECOSYSTEMS_SQL = ", ".join(quoted(n) for n in src.ECOSYSTEMS[:7])
ADVISORIES_SQL = f"""advisories AS (SELECT 'GHSA-' || p_partkey || '-' || (k - 1) AS id, replace([{NAMES_SQL}][k], '%n', 'pkg' || p_partkey) AS name, [{ECOSYSTEMS_SQL}][k] AS ecosystem, p_name, p_size,
    (p_size % 4) || '.' || (p_size % 11) || '.0' AS last FROM (SELECT *, unnest(range(1, 8)) AS k FROM part))"""


def key_sql(column: str) -> str:
    return f"list_transform(string_split(replace({column}, 'v', ''), '.'), lambda x: x::INT)"


FIRST_SQL = f"CASE WHEN p_size % 2 = 0 THEN {key_sql('version')} < {key_sql('last')} ELSE {key_sql('version')} <= {key_sql('last')} END"
MATCH_SQL = f"""{ALL_SQL}, {ADVISORIES_SQL},
    pairs AS (SELECT DISTINCT d.path, d.name, d.version, d.ecosystem, a.id AS advisory_id, p_size, p_name, last FROM deps d JOIN advisories a ON a.ecosystem = d.ecosystem AND a.name = d.name),
    judged AS (SELECT *, version = '*' AS any_version, CASE WHEN version = '*' THEN true ELSE {FIRST_SQL} END AS early, version <> '*' AND p_size % 6 = 0 AND {key_sql("CASE WHEN version = '*' THEN '0' ELSE version END")} BETWEEN [3, 9] AND [3, 10, 1] AS late, p_size % 9 = 4 AND replace(version, 'v', '') = '2.5.1' AS listed FROM pairs),
    matched AS (SELECT path, name, version, ecosystem, advisory_id, CASE WHEN early AND p_size % 2 = 0 THEN last END AS fixed, p_size, p_name FROM judged WHERE early OR late OR listed)"""


def advisory_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deps.match_advisories(deps.dependencies(src.manifests(spark, sf_dir)), src.advisories(spark, sf_dir))
    return found.select("path", "name", "version", "ecosystem", "advisory_id", "fixed").distinct()


def advisory_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.advisory_facts(src.advisories(spark, sf_dir))


def cve_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    advisories = src.advisories(spark, sf_dir)
    matched = deps.match_advisories(deps.dependencies(src.manifests(spark, sf_dir)), advisories)
    return deps.cve_findings(matched, advisories).select("path", "rule_id", "severity", "name", "fingerprint", "id", "reference")


LEVEL_SQL = """CASE WHEN p_size % 3 = 0 THEN CASE WHEN p_size % 10 + 0.5 >= 9 THEN 'CRITICAL' WHEN p_size % 10 + 0.5 >= 7 THEN 'HIGH' WHEN p_size % 10 + 0.5 >= 4 THEN 'MEDIUM' ELSE 'LOW' END
    WHEN p_size % 7 = 0 THEN 'LOW' WHEN p_size % 5 = 0 THEN 'HIGH' ELSE 'MEDIUM' END"""
QUERIES |= {"advisory_match": advisory_match, "advisory_facts": advisory_facts, "cve_findings": cve_findings}
ORACLE_SQL |= {
    "advisory_match": f"WITH {MATCH_SQL} SELECT path, name, version, ecosystem, advisory_id, fixed FROM matched",
    "advisory_facts": f"WITH {ADVISORIES_SQL} SELECT id AS advisory_id, {LEVEL_SQL} AS level, CASE WHEN p_size % 2 = 0 THEN last END AS fixed_version, 'CWE-' || (p_size * 7) AS cwe, id || ': ' || substr('Flaw in ' || p_name, 1, 100) AS title FROM advisories",
    "cve_findings": f"""WITH {MATCH_SQL}, f AS (SELECT DISTINCT path, advisory_id AS rule_id, lower({LEVEL_SQL}) AS severity, name, substr(sha256('cve:' || advisory_id || ':' || name || ':' || path), 1, 16) AS fingerprint FROM matched)
        SELECT *, 'cve-' || substr(fingerprint, 1, 8) AS id, 'https://github.com/advisories/' || rule_id AS reference FROM f""",
}
