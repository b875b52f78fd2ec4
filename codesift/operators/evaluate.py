"""Precision and recall against expected rows (path, line, category)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines a finding may be away from the expected one.
TOLERANCE = 5


def exact_matches(expected: DataFrame, found: DataFrame) -> DataFrame:
    """expected rows and ``hit``: whether a finding of the category is on the very line."""
    e = expected.select(F.col("path").alias("e_path"), F.col("line").alias("e_line"), F.col("category").alias("e_category"))
    f = found.select("path", "line_no", "category").distinct().withColumn("one", F.lit(True))
    joined = e.join(f, (F.col("e_path") == F.col("path")) & (F.col("e_line") == F.col("line_no")) & (F.col("e_category") == F.col("category")), "left")
    return joined.select(F.col("e_path").alias("path"), F.col("e_line").alias("line"), F.col("e_category").alias("category"), F.coalesce("one", F.lit(False)).alias("hit"))


def recall_by(matched: DataFrame, column: str) -> DataFrame:
    tp = F.count_if("hit")
    return matched.groupBy(column).agg(F.count(F.lit(1)).alias("expected"), tp.alias("tp"), F.round(tp / F.count(F.lit(1)), 6).alias("recall"))


#: Paths of files that are known to be harmless.
SAFE = r"safe|Safe"


def false_positives(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Findings, but for quality, in a file that is known to be harmless, or without any expected row of their file and category."""
    named = expected.select("path", "category").distinct().withColumn("_expected", F.lit(True))
    rows = found.where("scanner <> 'quality'").join(named, ["path", "category"], "left")
    return rows.where(F.col("_expected").isNull() | F.col("path").rlike(SAFE)).drop("_expected")


def greedy(expected: DataFrame, found: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """path, category, expected, tp: each expected row, in order, takes the first unused finding within ``tolerance`` lines.

    A fold over the rows of one file and category.
    """
    keys = ["path", "category"]
    e = expected.groupBy(*keys).agg(F.array_sort(F.collect_list("line")).alias("es"))
    f = found.groupBy(*keys).agg(F.array_sort(F.collect_list("line_no")).alias("fs"))
    start = F.struct(F.coalesce("fs", F.array().cast("array<int>")).alias("left"), F.lit(0).alias("tp"))

    def step(s, line):
        at = F.array_position(F.transform(s["left"], lambda x: F.abs(x - line) <= tolerance), True)
        rest = F.filter(s["left"], lambda x, i: i != (at - 1).cast("int"))
        return F.struct(F.when(at > 0, rest).otherwise(s["left"]).alias("left"), (s["tp"] + F.when(at > 0, 1).otherwise(0)).alias("tp"))

    return e.join(f, keys, "left").select(*keys, F.size("es").cast("long").alias("expected"), F.aggregate("es", start, step)["tp"].cast("long").alias("tp"))


#: What is wrong in the example projects: language, file, line, category.
GROUND_TRUTH = (
    ("javascript", "node-backend/config/db.js", 6, "secrets"),
    ("javascript", "node-backend/controllers/authController.js", 7, "auth"),
    ("javascript", "node-backend/controllers/authController.js", 9, "auth"),
    ("javascript", "node-backend/controllers/authController.js", 12, "auth"),
    ("javascript", "node-backend/controllers/userController.js", 7, "injection"),
    ("javascript", "node-backend/controllers/userController.js", 10, "xss"),
    ("javascript", "node-backend/controllers/userController.js", 17, "injection"),
    ("javascript", "node-backend/utils/crypto.js", 5, "crypto"),
    ("javascript", "node-backend/utils/crypto.js", 10, "crypto"),
    ("javascript", "node-backend/package.json", 10, "cve"),
    ("javascript", "node-backend/package.json", 9, "cve"),
    ("python", "python-app/app.py", 13, "injection"),
    ("python", "python-app/app.py", 16, "xss"),
    ("python", "python-app/app.py", 22, "injection"),
    ("python", "python-app/requirements.txt", 1, "cve"),
    ("python", "python-app/requirements.txt", 2, "cve"),
    ("go", "go-service/main.go", 11, "secrets"),
    ("go", "go-service/main.go", 18, "file-ops"),
    ("go", "go-service/go.mod", 6, "cve"),
    ("java", "java-app/App.java", 14, "injection"),
    ("java", "java-app/App.java", 20, "api-security"),
    ("java", "java-app/pom.xml", 10, "cve"),
    ("python", "python-app/django_views.py", 9, "injection"),
    ("python", "python-app/django_views.py", 13, "xss"),
    ("javascript", "node-backend/controllers/nestUserController.ts", 13, "injection"),
    ("javascript", "node-backend/controllers/nestUserController.ts", 19, "api-security"),
    ("php", "php-app/app/Http/Controllers/UserController.php", 14, "injection"),
    ("php", "php-app/resources/views/user.blade.php", 3, "xss"),
    ("php", "php-app/composer.json", 4, "cve"),
)


def ground_truth(spark: SparkSession) -> DataFrame:
    """language, path (below the examples), line and category."""
    return spark.createDataFrame(list(GROUND_TRUTH), "language string, path string, line int, category string")


def near_matches(expected: DataFrame, found: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """The expected rows and ``hit``: whether a finding of the category is within ``tolerance`` lines; of the cve category, anywhere in the file."""
    keys = ["path", "category"]
    e = expected.withColumn("_e", F.struct(*expected.columns))
    near = (F.col("category") == "cve") | (F.abs(F.col("line") - F.col("line_no")) <= tolerance)
    pairs = e.join(found.select(*keys, "line_no").distinct(), keys, "left")
    return pairs.groupBy("_e").agg(F.max(F.coalesce(F.when(F.col("line_no").isNotNull(), near), F.lit(False))).alias("hit")).select("_e.*", "hit")


def report(matched: DataFrame, wrong: DataFrame) -> DataFrame:
    """language (``all`` for the total), expected, tp, missed, recall, and for the total false alarms, precision and f1."""
    tp, n = F.count_if("hit"), F.count(F.lit(1))
    rows = matched.groupingSets([[], ["language"]], "language").agg(n.alias("expected"), tp.alias("tp"), (n - tp).alias("missed"), F.round(F.coalesce(F.try_divide(tp, n), F.lit(0.0)), 6).alias("recall"), F.grouping_id().alias("_g"))
    total = F.col("_g") == 1
    rows = rows.join(wrong.agg(F.count(F.lit(1)).alias("false_alarms")).withColumn("_g", F.lit(1).cast("bigint")), "_g", "left")
    precision = F.when(total, F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("false_alarms")), F.lit(0.0)))
    rows = rows.select(F.when(total, "all").otherwise(F.col("language")).alias("language"), "expected", "tp", "missed", "recall", "false_alarms", precision.alias("precision"))
    return rows.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.when(F.col("precision").isNotNull(), 0.0)))


def metrics(tp: int, expected: int, fp: int) -> dict[str, float]:
    recall = tp / expected if expected else 0.0
    precision = tp / (tp + fp) if tp + fp else 0.0
    return {"recall": recall, "precision": precision, "f1": 2 * precision * recall / (precision + recall) if precision + recall else 0.0}
