"""Version ranges: sortable keys of versions, and what all requirement lines of an application allow together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfreight.functions.text import strip
from wayfreight.operators.deps import dependency_drop, line_filter
from wayfreight.session import shared_dir

# Where a version stands beside the release it belongs to. Real numbers of a release are never negative.
PHASES = {"dev": -5, "a": -4, "alpha": -4, "b": -3, "beta": -3, "c": -2, "rc": -2, "pre": -2, "preview": -2}
FINAL = -1
POST = ("post", "rev", "r")

_NAME = r"^([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)\s*(?:\[[^\]]*\])?\s*(.*)$"
_SPECIFIER = r"^(===|==|~=|!=|<=|>=|<|>)\s*v?(.+)$"
_VERSION = (
    r"^(?:([0-9]{1,18})!)?([0-9]{1,18}(?:\.[0-9]{1,18})*)"
    r"(?:[-_.]?(alpha|beta|preview|dev|post|rev|pre|rc|a|b|c|r)[-_.]?([0-9]{0,18}))?$"
)
_LAST = (1 << 63) - 1


def version_key(version: Column) -> Column:
    """An array of numbers that sorts as the versions do; null for what is not a version.

    Epoch, release without trailing zeros, phase, number: 1.dev0 < 1a1 < 1rc1 < 1 = 1.0 < 1.post0 < 1.0.1 < 1.1 < 1.10.
    A version has one suffix at most; numbers have 18 digits at most.
    """
    version = F.lower(version)
    release = F.split(F.regexp_replace(F.regexp_extract(version, _VERSION, 2), r"(\.0+)+$", ""), r"\.")
    word = F.regexp_extract(version, _VERSION, 3)
    number = F.coalesce(F.regexp_extract(version, _VERSION, 4).try_cast("bigint"), F.lit(0).cast("bigint"))
    phase = F.lit(FINAL)
    for name, place in PHASES.items():
        phase = F.when(word == name, place).otherwise(phase)
    number = F.when(word == "", 0).when(word.isin(*POST), number + 1).otherwise(number)
    epoch = F.coalesce(F.regexp_extract(version, _VERSION, 1).try_cast("bigint"), F.lit(0).cast("bigint"))
    key = F.concat(F.array(epoch), F.transform(release, lambda n: n.try_cast("bigint")), F.array(phase.cast("bigint"), number.cast("bigint")))
    return F.when(version.rlike(_VERSION), key)


def _phase(key: Column) -> Column:
    return F.element_at(key, -2)


def _moved(key: Column, phase: int, number: int) -> Column:
    """The same release at another phase."""
    return F.concat(F.slice(key, 1, F.size(key) - 2), F.array(F.lit(phase).cast("bigint"), F.lit(number).cast("bigint")))


def _next_release(version: Column) -> Column:
    """``1.3`` after ``1.2``, as text: its last number raised."""
    parts = F.split(version, r"\.")
    raised = (F.element_at(parts, -1).try_cast("bigint") + 1).cast("string")
    return F.concat_ws(".", F.slice(parts, 1, F.size(parts) - 1), F.array(raised))


def constraints(files: DataFrame) -> DataFrame:
    """One row for each version specifier of each requirement line, and one for a line without any.

    ``package`` is lower-case with single hyphens; ``marker`` what follows a semicolon. ``lower`` is
    (key, open, text) and ``upper`` (key, closed, text), so that the largest lower and the smallest upper
    bound are the tightest. ``excludes`` marks ``!=``: its bounds say what is left out. A specifier that
    cannot be read has no bounds and ``readable`` false. Extras and comments are cut off; lines of options,
    addresses and files name no package and are left out.
    """
    line = F.regexp_replace(F.col("line"), r"(^|\s)#.*$", "")
    rows = line_filter(files).select(
        "app_id", strip(F.substring_index(line, ";", 1)).alias("named"), F.when(line.contains(";"), strip(F.regexp_extract(line, r";(.*)$", 1))).otherwise("").alias("marker")
    )
    rows = rows.filter(F.col("named").rlike(_NAME) & ~F.col("named").rlike(r"[@/\\]"))
    listed = F.regexp_replace(F.regexp_extract("named", _NAME, 2), r"^\((.*)\)$", "$1")
    rows = rows.select(
        "app_id",
        F.regexp_replace(F.lower(F.regexp_extract("named", _NAME, 1)), "[-_.]+", "-").alias("package"),
        "marker",
        F.explode_outer(F.filter(F.transform(F.split(listed, ","), strip), lambda s: s != "")).alias("specifier"),
    )
    sign = F.regexp_extract("specifier", _SPECIFIER, 1)
    given = strip(F.lower(F.regexp_extract("specifier", _SPECIFIER, 2)))
    whole = given.rlike(r"\.\*$") & sign.isin("==", "!=")
    rows = rows.select("*", sign.alias("sign"), whole.alias("whole"), F.when(whole, F.regexp_replace(given, r"\.\*$", "")).otherwise(given).alias("version"))
    version, sign, whole = F.col("version"), F.col("sign"), F.col("whole")
    # What has to agree in ``~=``: the release without its last number.
    stem = F.when(sign == "~=", F.regexp_extract(version, r"^((?:[0-9]+!)?[0-9]+(?:\.[0-9]+)*)\.[0-9]+", 1)).when(whole, version)
    rows = rows.select("*", version_key(version).alias("key"), _next_release(stem).alias("next"))
    key, after = F.col("key"), F.col("next")
    plain = version.rlike(r"^(?:[0-9]+!)?[0-9.]+$")
    readable = key.isNotNull() & (sign != "") & F.when(whole, plain).when(sign == "~=", version_key(after).isNotNull()).otherwise(True)

    def bound(key: Column, flag: int, text: Column) -> Column:
        return F.struct(key.alias("key"), F.lit(flag).alias("flag"), text.alias("text"))

    # An open bound at a final version leaves out its previews below it, or the later builds of it.
    under = F.when(_phase(key) == FINAL, _moved(key, PHASES["dev"], 0)).otherwise(key)
    over = F.when((_phase(key) == FINAL) & (F.element_at(key, -1) == 0), _moved(key, FINAL, _LAST)).otherwise(key)
    lower = (
        F.when(whole, bound(_moved(key, PHASES["dev"], 0), 0, F.concat(F.lit(">="), version, F.lit(".dev0"))))
        .when(sign.isin("==", "===", "!=", ">=", "~="), bound(key, 0, F.concat(F.lit(">="), version)))
        .when(sign == ">", bound(over, 1, F.concat(F.lit(">"), version)))
    )
    upper = (
        F.when(whole | (sign == "~="), bound(_moved(version_key(after), PHASES["dev"], 0), 0, F.concat(F.lit("<"), after, F.lit(".dev0"))))
        .when(sign.isin("==", "===", "!=", "<="), bound(key, 1, F.concat(F.lit("<="), version)))
        .when(sign == "<", bound(under, 0, F.concat(F.lit("<"), version)))
    )
    return rows.select(
        "app_id", "package", "marker", "specifier", F.coalesce(readable, F.lit(False)).alias("readable"),
        (sign == "!=").alias("excludes"), F.when(readable, lower).alias("lower"), F.when(readable, upper).alias("upper"),
    )


def _kept(df: DataFrame) -> DataFrame:
    at = shared_dir(df.sparkSession, "constraints")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def version_ranges(files: DataFrame) -> DataFrame:
    """What the requirement lines of an application allow together, for each package and marker.

    ``lower`` and ``upper`` are the tightest bounds as specifiers, null where open. ``status``: ``any``,
    ``range``, ``pinned`` (one version is left) or ``conflict`` (none is). ``requirement`` is the line that says
    all of it, null for a conflict. ``exclusions`` counts the ``!=`` that reach into the range, ``unreadable``
    the specifiers that count for nothing. Each exclusion is held against the range by itself: several that
    only together leave nothing are no conflict. Equal versions in different spelling: the greater text stays
    in ``lower`` and the smaller in ``upper``.

    Bounds are maxima and minima, which combine before the shuffle: an application with a third of all files
    sends one row for each task and package. Exclusions meet the finished ranges as single rows.
    """
    group = ["app_id", "package", "marker"]
    rows = _kept(constraints(files))
    bounding = ~F.col("excludes")
    ranges = rows.groupBy(*group).agg(
        F.max(F.when(bounding, F.col("lower"))).alias("lower"),
        F.min(F.when(bounding, F.col("upper"))).alias("upper"),
        F.count("specifier").alias("specifiers"),
        F.count_if(F.col("specifier").isNotNull() & ~F.col("readable")).alias("unreadable"),
    )
    gone = rows.filter(F.col("excludes") & F.col("readable")).select(
        *[F.col(c).alias(f"not_{c}") for c in group], "specifier", F.col("lower").alias("first"), F.col("upper").alias("last")
    ).distinct()
    lower, upper, first, last = (F.col(c) for c in ("lower", "upper", "first", "last"))
    same = F.lit(True)
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"not_{c}"))
    # Ends of a range as (key, side): an open lower end lies behind its key, an open upper end before it.
    low, high = F.struct(lower.key, lower.flag), F.struct(upper.key, upper.flag - 1)
    begins, ends = F.struct(first.key, F.lit(0)), F.struct(last.key, last.flag - 1)
    reaches = (lower.isNull() | (low <= ends)) & (upper.isNull() | (begins <= high))
    covers = lower.isNotNull() & upper.isNotNull() & (begins <= low) & (high <= ends)
    left_out = (
        ranges.join(gone, same).filter(reaches)
        .groupBy(*[F.col(f"not_{c}").alias(f"out_{c}") for c in group])
        .agg(F.count("*").alias("exclusions"), F.max(F.coalesce(covers, F.lit(False))).alias("covered"))
    )
    same = F.lit(True)
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"out_{c}"))
    ranges = ranges.join(left_out, same, "left")
    pinned = (lower.key == upper.key) & (lower.flag == 0) & (upper.flag == 1)
    empty = F.coalesce(lower.isNotNull() & upper.isNotNull() & (low > high), F.lit(False)) | F.coalesce("covered", F.lit(False))
    status = (
        F.when(empty, "conflict").when(F.coalesce(pinned, F.lit(False)), "pinned").when(lower.isNull() & upper.isNull(), "any").otherwise("range")
    )
    ranges = ranges.withColumn("status", status)
    tail = F.when(F.col("marker") != "", F.concat(F.lit("; "), "marker")).otherwise("")
    asked = F.when(F.col("status") == "pinned", F.concat(F.lit("=="), F.substring(lower.text, 3, 1 << 20))).otherwise(
        F.concat_ws(",", lower.text, upper.text)
    )
    return ranges.select(
        *group, lower.text.alias("lower"), upper.text.alias("upper"), "specifiers", "unreadable",
        F.coalesce("exclusions", F.lit(0).cast("bigint")).alias("exclusions"), "status",
        F.when(F.col("status") != "conflict", F.concat("package", asked, tail)).alias("requirement"),
    )


def carried_ranges(ranges: DataFrame) -> DataFrame:
    """The ranges that go along to the target platform: packages that :func:`dependency_drop` keeps."""
    return dependency_drop(ranges)
