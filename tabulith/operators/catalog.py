"""Files of a working directory: content, classification, duplicates and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.functions import text as X
from tabulith.sources import workbook

# What file names say.
LOCKS = r"(?i)^(~\$|\.~lock\.|\._)"
INCOMPLETE = r"(?i)\.(tmp|temp|part|partial|partialdownload|crdownload|download|filepart|!ut)$"
CONFLICT = r"(?i)conflicted\s+copy|conflict\s+copy|\(conflict(ed)?\b|冲突副本|沖突副本|_conflict-\d"
TEMPLATE = r"(?i)template|模板|範本|范本"
REVIEW_RETURN = r"(?i)review[\s_-]*(pack|return|returned|back)|reviewed|复核|覆核|審核|审核|回收|已批注"
DELIVERY = r"(?i)deliver(y|ed|able)|delivery[\s_-]*pack|已交付|交付件|交付|归档|歸檔|archive[d]?"
READABLE = r"(?i)\.(xlsx|xlsm|xltx|xltm|csv|json)$"
TEMPLATE_EXTENSION = r"(?i)\.(xltx|xltm)$"


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, mtime, size, digest) of every file below a folder, hashed where it is read. Spark lists no empty files."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("digest"))


def allowed(files_: DataFrame, roots: list[str]) -> tuple[DataFrame, DataFrame]:
    """(inside, skipped): files (path) that lie in one of the folders, each once, with relative; and the others with why."""
    plain = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "/+", "/")
    tops = [F.when(F.startswith(plain, F.lit(r.rstrip("/") + "/")), F.substring(plain, len(r.rstrip("/")) + 2, 4096)) for r in roots]
    dotted = plain.rlike(r"(^|/)\.\.(/|$)")
    known = files_.withColumn("relative", F.when(~dotted, F.coalesce(*tops))).dropDuplicates(["path"])
    skipped = known.where("relative is null").select("path", F.lit("outside_authorized_roots").alias("reason"))
    return known.where("relative is not null"), skipped


def sync_artifact(name: Column) -> Column:
    """Why a name looks like what a sync tool leaves behind."""
    return (
        F.when(name.rlike(LOCKS), "sync_artifact_lock_file").when(name.rlike(INCOMPLETE), "sync_artifact_incomplete_download")
        .when(F.endswith(name, F.lit("~")), "sync_artifact_editor_backup").when(name.rlike(CONFLICT), "sync_artifact_conflict_copy")
    )


def stable(mtime: Column, size: Column, now: Column, before_mtime: Column, before_size: Column, window_s: float = 5.0) -> Column:
    """Old enough, and unchanged since the sample before if there is one."""
    same = before_mtime.isNull() | ((before_mtime == mtime) & (before_size == size))
    return same & (now.cast("double") - mtime.cast("double") >= window_s)


def classified(catalog: DataFrame, start: Column, end: Column) -> DataFrame:
    """catalog (name, mtime, stable and, where workbooks were opened, meta) with classification, disposition, reason and signal.

    The first rule that holds counts. meta: sheet titles and document properties as one text.
    """
    stem = F.regexp_replace("name", r"(?<=.)\.[^.]*$", "")
    artifact = sync_artifact(F.col("name"))
    named = F.when(F.col("name").rlike(TEMPLATE_EXTENSION), "template").when(stem.rlike(REVIEW_RETURN), "review_return").when(stem.rlike(TEMPLATE), "template").when(stem.rlike(DELIVERY), "prior_delivery")
    day = F.to_date("mtime")
    meta = F.col("meta") if "meta" in catalog.columns else F.lit(None).cast("string")
    told = F.when(meta.rlike(REVIEW_RETURN), "review_return").when(meta.rlike(TEMPLATE), "template").when(meta.rlike(DELIVERY), "prior_delivery")
    by_name, named = named, F.coalesce(named, told)
    rule = (
        F.when(artifact == "sync_artifact_conflict_copy", F.struct(F.lit("unknown").alias("c"), F.lit("review").alias("d"), artifact.alias("r")))
        .when(artifact.isNotNull(), F.struct(F.lit("unknown").alias("c"), F.lit("exclude").alias("d"), artifact.alias("r")))
        .when(~F.col("name").rlike(READABLE), F.struct(F.lit("unknown").alias("c"), F.lit("exclude").alias("d"), F.lit("unsupported_extension").alias("r")))
        .when(~F.col("stable"), F.struct(F.lit("unknown").alias("c"), F.lit("review").alias("d"), F.lit("not_stable_yet").alias("r")))
        .when(named.isNotNull(), F.struct(named.alias("c"), F.when(named == "prior_delivery", "exclude").otherwise("review").alias("d"), F.concat(F.lit("classified_as_"), named).alias("r")))
        .when(start.isNull(), F.struct(F.lit("unknown").alias("c"), F.lit("review").alias("d"), F.lit("no_period_window_declared").alias("r")))
        .when(day.between(start, end), F.struct(F.lit("input").alias("c"), F.lit("include").alias("d"), F.lit("current_period_input").alias("r")))
        .when(day < start, F.struct(F.lit("prior_delivery").alias("c"), F.lit("exclude").alias("d"), F.lit("historical_outside_current_period").alias("r")))
        .otherwise(F.struct(F.lit("unknown").alias("c"), F.lit("review").alias("d"), F.lit("modified after the declared current period").alias("r")))
    )
    signal = F.when(artifact.isNotNull(), "name_pattern").when(~F.col("name").rlike(READABLE), "extension").when(~F.col("stable"), "stability_window").when(by_name.isNotNull(), "name_pattern").when(named.isNotNull(), "workbook_metadata").when(start.isNull(), "none").otherwise("modification_time")
    return catalog.withColumn("k", rule).withColumn("signal", signal).select("*", F.col("k.c").alias("classification"), F.col("k.d").alias("disposition"), F.col("k.r").alias("reason")).drop("k")


def glob_regex(pattern: Column) -> Column:
    """The regular expression of a glob."""
    plain = F.regexp_replace(pattern, r"([.^$+(){}|\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(F.replace(plain, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("[!"), F.lit("[^")), F.lit("$"))


def overridden(catalog: DataFrame, overrides: DataFrame, name: str = "name") -> DataFrame:
    """catalog with the first override (pos, pattern, classification and, if it says so, disposition, source) that fits a name, exactly or as a glob.

    None makes a file an input that has not settled or is a sync tool's: those are for review, and say why.
    """
    has = lambda c: F.col(c) if c in overrides.columns else F.lit(None).cast("string")
    rules = overrides.select("pos", "pattern", glob_regex(F.col("pattern")).alias("regex"), F.col("classification").alias("c"), has("disposition").alias("d"), F.coalesce(has("source"), F.lit("user")).alias("s"))
    listed = rules.agg(F.array_sort(F.collect_list(F.struct("pos", "pattern", "regex", "c", "d", "s"))).alias("rules"))  # a recipe's few lines
    out = catalog.join(F.broadcast(listed), F.lit(True), "left").withColumn("o", F.get(F.filter("rules", lambda r: (r.pattern == F.col(name)) | F.regexp_like(F.col(name), r.regex)), 0))
    asked = F.coalesce("o.d", "disposition")
    stable = F.col("stable") if "stable" in catalog.columns else ~F.coalesce(F.col("reason") == "not_stable_yet", F.lit(False))
    unsettled, synced = (asked == "include") & ~stable, (asked == "include") & F.startswith("reason", F.lit("sync_artifact"))
    reason = F.when(unsettled, "override_refused_unstable_file").when(synced, "override_refused_sync_artifact").otherwise(F.concat(F.lit("override:"), "o.s"))
    has_one = F.col("o").isNotNull()
    new = {"disposition": F.when(has_one, F.when(unsettled | synced, "review").otherwise(asked)).otherwise(F.col("disposition")), "reason": F.when(has_one, reason).otherwise(F.col("reason")), "classification": F.coalesce("o.c", "classification")}
    return out.withColumns(new).drop("rules", "o")


def duplicate_groups(catalog: DataFrame, path: str = "path", digest: str = "digest") -> DataFrame:
    """(digest, n, representative) of contents that more than one file has: the shortest path stands for them, then the first."""
    return catalog.groupBy(digest).agg(F.count("*").alias("n"), F.min(F.struct(F.length(path).alias("l"), F.col(path).alias("p")))["p"].alias("representative")).where("n >= 2")


def version_groups(catalog: DataFrame, name: str = "name", digest: str = "digest") -> DataFrame:
    """(version_key, files, contents) of names that differ in version decorations only and have different contents."""
    keyed = catalog.select(X.version_key(F.col(name)).alias("version_key"), F.col(digest).alias("digest"))
    return keyed.groupBy("version_key").agg(F.count("*").alias("files"), F.count_distinct("digest").alias("contents")).where("files >= 2 and contents >= 2")


def settled(catalog: DataFrame) -> DataFrame:
    """catalog (name, relative, digest, disposition, reason) after duplicates and versions: of files with one content one name
    stays, and names that may be versions of each other are for review, unless they are excluded."""
    known = catalog.where("digest is not null")
    groups = duplicate_groups(known, "relative").select("digest", "representative")
    out = catalog.join(groups, "digest", "left")
    copy = F.col("representative").isNotNull() & (F.col("representative") != F.col("relative"))
    out = out.withColumns({"disposition": F.when(copy, "exclude").otherwise(F.col("disposition")), "reason": F.when(copy, "duplicate_content").otherwise(F.col("reason")), "duplicate_of": F.when(copy, F.col("representative"))}).drop("representative")
    out = out.withColumn("version_key", F.when(F.col("digest").isNotNull(), X.version_key(F.col("name"))))
    several = version_groups(out.where("disposition <> 'exclude' and digest is not null")).select("version_key", F.lit(True).alias("several"))
    out = out.join(several, "version_key", "left")
    hit = F.coalesce("several", F.lit(False)) & (F.col("disposition") != "exclude")
    return out.withColumns({"disposition": F.when(hit, "review").otherwise(F.col("disposition")), "reason": F.when(hit, "version_candidates_require_confirmation").otherwise(F.col("reason"))}).drop("several")


def disposition_counts(catalog: DataFrame) -> DataFrame:
    """(disposition, n), 0 where there is none."""
    each = catalog.agg(*[F.count_if(F.col("disposition") == d).alias(d) for d in ("include", "review", "exclude")])
    return each.select(F.explode(F.map_from_entries(F.array(*[F.struct(F.lit(d).alias("d"), F.col(d).alias("n")) for d in ("include", "review", "exclude")]))).alias("disposition", "n"))


def scan(spark: SparkSession, roots: list[str], start: Column | None = None, end: Column | None = None, now: Column | None = None, window_s: float = 5.0, before: DataFrame | None = None, overrides: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, skipped) below some folders: what each file is, what is to be done with it, and why.

    before: samples of an earlier scan (path, mtime, size). Files that have not settled or that a sync tool
    left are not read for their content's sake; their digest is null.
    """
    raw = None
    for root in roots:
        own = files(spark, root)
        raw = own if raw is None else raw.unionByName(own)
    inside, skipped = allowed(raw, roots)
    none = F.lit(None)
    if before is not None:
        inside = inside.join(before.select("path", F.col("mtime").alias("_m"), F.col("size").alias("_s")), "path", "left")
    else:
        inside = inside.withColumns({"_m": none.cast("timestamp"), "_s": none.cast("long")})
    inside = inside.withColumn("stable", stable(F.col("mtime"), F.col("size"), now if now is not None else F.current_timestamp(), F.col("_m"), F.col("_s"), window_s)).drop("_m", "_s")
    opened = F.col("stable") & sync_artifact(F.col("name")).isNull() & F.col("name").rlike(READABLE)
    inside = inside.withColumn("digest", F.when(opened, F.col("digest")))
    meta = None
    for root in roots:
        own = workbook.metadata(spark, root).select(F.col("file").alias("path"), F.concat_ws(" ", F.array_join("titles", " "), "title", "category", "keywords", "subject").alias("meta"))
        meta = own if meta is None else meta.unionByName(own)
    inside = inside.join(meta.dropDuplicates(["path"]), "path", "left").withColumn("meta", F.when(opened, F.col("meta")))
    found = settled(classified(inside, start if start is not None else none.cast("date"), end if end is not None else none.cast("date"))).drop("meta")
    return (overridden(found, overrides, "relative") if overrides is not None else found), skipped
