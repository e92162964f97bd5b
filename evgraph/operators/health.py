"""Graded checks over texts and tables: catalog, metrics, debt, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Id, threshold (violated above it), area, severity, minutes of
#: remediation, minutes per unit over the threshold.
CATALOG = (
    ("complex-function", 10, "maintainability", "major", 10, 1),
    ("long-function", 50, "maintainability", "minor", 10, 0),
    ("many-parameters", 5, "maintainability", "minor", 5, 0),
    ("deep-nesting", 4, "maintainability", "minor", 10, 0),
    ("large-file", 1000, "maintainability", "minor", 30, 0),
    ("large-class", 47, "maintainability", "major", 60, 0),
    ("duplicated-block", 9, "maintainability", "major", 15, 0),
    ("module-cycle", 0, "maintainability", "major", 60, 0),
    ("hub-module", 9, "maintainability", "major", 60, 0),
    ("layer-direction", 0, "maintainability", "major", 30, 0),
    ("part-independence", 0, "maintainability", "major", 30, 0),
    ("public-entry", 0, "maintainability", "minor", 10, 0),
    ("core-purity", 0, "maintainability", "major", 60, 0),
    ("hardcoded-secret", 0, "security", "blocker", 30, 0),
    ("sql-injection", 0, "security", "critical", 30, 0),
    ("command-injection", 0, "security", "critical", 30, 0),
    ("code-injection", 0, "security", "critical", 30, 0),
    ("tls-verify-off", 0, "security", "critical", 10, 0),
    ("unsafe-deserialize", 0, "security", "critical", 30, 0),
    ("weak-hash", 0, "security", "major", 10, 0),
    ("debug-enabled", 0, "security", "major", 5, 0),
    ("cors-any-origin", 0, "security", "major", 10, 0),
    ("endpoint-without-auth", 0, "security", "major", 20, 0),
    ("shared-datastore", 1, "performance", "major", 240, 0),
    ("query-in-loop", 0, "performance", "major", 20, 0),
    ("blocking-in-async", 0, "performance", "major", 15, 0),
    ("hub-on-request-path", 2, "performance", "major", 60, 0),
    ("no-timeout", 0, "reliability", "major", 10, 0),
    ("swallowed-error", 0, "reliability", "major", 10, 0),
    ("no-retry", 0, "reliability", "minor", 15, 0),
)
#: Areas, severities from least to worst, debt ratio limits of A to D,
#: minutes that a line of code costs, and prefixes of comment and skipped lines.
AREAS = ("maintainability", "reliability", "security", "performance")
SEVERITIES = ("info", "minor", "major", "critical", "blocker")
RATIOS = ((0.05, "A"), (0.10, "B"), (0.20, "C"), (0.50, "D"))
MINUTES_PER_LINE = 30
COMMENTS = ("#", "//", "/*", "*", "--")
SKIPPED = ("#", "//", "/*", "*", "import ", "from ", "package ", "using ", "require(")
WINDOW = 10


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CATALOG), "check string, threshold long, area string, severity string, minutes long, per_unit long")


def exceeded(measured: DataFrame, key: list[str], metrics: dict[str, str], checks: DataFrame) -> DataFrame:
    """Violations: each metric column unpivoted to its check and compared to the
    threshold, with minutes for what is over it. ``checks`` is a fixed dimension."""
    values = [F.struct(F.lit(check).alias("check"), F.col(c).cast("long").alias("value")) for c, check in metrics.items()]
    long = measured.select(*key, F.explode(F.array(*values)).alias("m")).select(*key, "m.check", "m.value")
    over = long.join(F.broadcast(checks), "check").filter("value > threshold")
    minutes = F.col("minutes") + F.col("per_unit") * (F.col("value") - F.col("threshold"))
    return over.select(*key, "check", "value", minutes.alias("minutes"), "area", "severity")


def code_lines(text: Column) -> Column:
    """Lines of a text that are neither blank nor comments."""
    comment = lambda x: F.array_contains(F.array(*[F.startswith(x, F.lit(p)) for p in COMMENTS]), True)
    trimmed = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(F.replace(x, F.lit("\t"), F.lit(" "))))
    return F.size(F.filter(trimmed, lambda x: (x != "") & ~comment(x)))


def ratio_rating(debt: Column, lines: Column) -> Column:
    ratio = F.when(lines > 0, debt / (lines * MINUTES_PER_LINE)).otherwise(F.lit(0.0))
    rating = F.when(ratio <= RATIOS[0][0], RATIOS[0][1])
    for limit, letter in RATIOS[1:]:
        rating = rating.when(ratio <= limit, letter)
    return rating.otherwise("E")


def area_ratings(violations: DataFrame, spark: SparkSession) -> DataFrame:
    """A for an area without violations, else by its worst severity."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    worst = violations.groupBy(F.col("area").alias("a")).agg(F.max(rank).alias("worst"))
    areas = spark.createDataFrame([(a,) for a in AREAS], "area string")
    letter = F.element_at(F.array(*[F.lit(x) for x in "ABCDE"]), F.coalesce("worst", F.lit(1)).cast("int"))
    return areas.join(worst, F.col("area") == F.col("a"), "left").select("area", letter.alias("grade"))


def _bind(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def clean_lines(text: Column) -> Column:
    """(n, line) of the lines that count for duplicates: white space collapsed;
    blanks, comments, imports and lines without letters or digits left out."""
    skip = lambda x: F.array_contains(F.array(*[F.startswith(x, F.lit(p)) for p in SKIPPED]), True)
    all_lines = F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n"),
        lambda x, n: F.struct(n.alias("n"), F.trim(F.regexp_replace(x, "[ \\t\\r\\f\\x0B]+", " ")).alias("line")),
    )
    return F.filter(all_lines, lambda x: x.line.rlike("[\\p{L}\\p{N}]") & ~skip(x.line))


def windows(texts: DataFrame, id_col: str, text: str, size: int = WINDOW) -> DataFrame:
    """Each run of ``size`` counted lines of each text: ``i`` and a hash of it. Made
    inside the row, so nothing is shuffled before the hashes are."""
    starts = lambda x: F.sequence(F.lit(0), F.size(x) - size)
    digest = lambda x, i: F.md5(F.array_join(F.transform(F.slice(x, i + 1, F.lit(size)), lambda y: y.line), "\n").cast("binary"))
    made = _bind(
        clean_lines(F.col(text)),
        lambda x: F.when(F.size(x) >= size, F.transform(starts(x), lambda i: F.struct(i.alias("i"), F.element_at(x, i + 1).n.alias("n"), digest(x, i).alias("hash")))),
    )
    return texts.select(id_col, F.inline(made))


def duplicated(found: DataFrame, id_col: str) -> DataFrame:
    """Hashes of windows that occur in two places or more."""
    return found.groupBy("hash").agg(F.count("*").alias("places"), F.count_distinct(id_col).alias("texts"), F.min(F.struct(id_col, "i")).alias("first")).filter("places > 1").select(
        "hash", "places", "texts", F.col(f"first.{id_col}").alias(f"first_{id_col}"), F.col("first.i").alias("first_i")
    )


def duplicate_runs(found: DataFrame, id_col: str, size: int = WINDOW) -> DataFrame:
    """Maximal stretches of repeated windows in each text, as gaps and islands
    within the text: first counted line and length in counted lines."""
    from pyspark.sql import Window as W

    twice = found.groupBy("hash").agg(F.count("*").alias("places")).filter("places > 1").withColumnRenamed("hash", "h")
    marked = found.join(twice, F.col("hash") == F.col("h"), "left_semi")
    island = F.col("i") - F.row_number().over(W.partitionBy(id_col).orderBy("i"))
    return marked.withColumn("island", island).groupBy(id_col, "island").agg(F.min("i").alias("start"), (F.count("*") + size - 1).alias("length")).drop("island")


def module_checks(deps: DataFrame) -> DataFrame:
    """Import cycles (one violation per strong component of two or more, at its least
    member) and hubs (more than nine in and more than nine out)."""
    from evgraph.operators.traverse import strong_components

    on_cycle = strong_components(deps).groupBy(F.col("component").alias("module")).agg(F.count("*").alias("value")).filter("value > 1")
    cycles = on_cycle.select(F.lit("module-cycle").alias("check"), "module", "value")
    hub = hubs(deps.filter("src <> dst")).select(F.lit("hub-module").alias("check"), F.col("id").alias("module"), F.least("fan_in", "fan_out").alias("value"))
    return cycles.unionByName(hub)


def hubs(deps: DataFrame, limit: int = 9) -> DataFrame:
    """``id``, ``fan_in``, ``fan_out`` of nodes with more than ``limit`` of either."""
    pairs = deps.select("src", "dst").distinct()
    fan_in = pairs.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan_in"))
    fan_out = pairs.groupBy(F.col("src").alias("m")).agg(F.count("*").alias("fan_out"))
    return fan_in.join(fan_out, F.col("id") == F.col("m")).filter((F.col("fan_in") > limit) & (F.col("fan_out") > limit)).drop("m")


def shared(uses: DataFrame, resource: str, owner: str, limit: int) -> DataFrame:
    """``resource``, ``owners`` of what more than ``limit`` owners use."""
    return uses.groupBy(resource).agg(F.count_distinct(owner).alias("owners")).filter(F.col("owners") > limit)


def heavy(members: DataFrame, owner: list[str], weight: Column, limit: int = 47) -> DataFrame:
    """Owners whose members' weights add up to more than ``limit``, with the ``value``."""
    return members.groupBy(*owner).agg(F.sum(weight).alias("value")).filter(F.col("value") > limit)


def class_checks(functions: DataFrame, limit: int = 47) -> DataFrame:
    """Classes whose methods' complexities add up to more than ``limit``. ``functions``:
    path, qualified_name, complexity."""
    owner = F.substring_index("qualified_name", ".", 1)
    methods = functions.filter(F.col("qualified_name").contains(".")).select("path", owner.alias("class"), "complexity")
    return heavy(methods, ["path", "class"], F.col("complexity"), limit).select(F.lit("large-class").alias("check"), "path", "class", "value")


def function_metrics(functions: DataFrame, checks: DataFrame) -> DataFrame:
    """The four limits of a function, from measured facts."""
    metrics = {"complexity": "complex-function", "lines": "long-function", "params": "many-parameters", "nesting": "deep-nesting"}
    return exceeded(functions, ["path", "qualified_name", "start_line"], metrics, checks)


def without_exceptions(violations: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Violations (check, file, line) but those excepted for a file or one of its
    lines (check, file, line; a null line stands for all)."""
    e = exceptions.select(F.col("check").alias("e_check"), F.col("file").alias("e_file"), F.col("line").alias("e_line"))
    on = (F.col("check") == F.col("e_check")) & (F.col("file") == F.col("e_file")) & (F.col("e_line").isNull() | (F.col("line") == F.col("e_line")))
    return violations.join(e, on, "left_anti")


def assess(parts: list[DataFrame], exceptions: DataFrame | None, checks: DataFrame) -> DataFrame:
    """All violations (check, file, line, value) with area, severity and minutes."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    kept = without_exceptions(every, exceptions) if exceptions is not None else every
    minutes = F.col("minutes") + F.col("per_unit") * F.greatest(F.col("value") - F.col("threshold"), F.lit(0))
    return kept.join(F.broadcast(checks), "check").select("check", "file", "line", "value", minutes.alias("minutes"), "area", "severity")
