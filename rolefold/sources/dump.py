"""Bulk statement statistics: statements of items with qualifiers, and dumps of JSON lines.

A statement table has (item, property, kind, rank, qualifiers array<struct<property,kind>>).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANKS = ("preferred", "normal", "deprecated")
#: Title prefixes of pages that aren't articles (fixed values).
NAMESPACES = ("Talk", "User", "Wikipedia", "File", "MediaWiki", "Template", "Help", "Category", "Portal", "Draft", "Module", "Book", "TimedText", "Education Program", "Gadget", "Topic", "Special")
SNAK = "struct<snaktype:string,property:string,datatype:string,datavalue:struct<value:struct<id:string>>>"
ENTITY = (
    "id string, type string, sitelinks map<string,struct<title:string>>, "
    f"claims map<string,array<struct<rank:string,mainsnak:{SNAK},qualifiers:map<string,array<{SNAK}>>,references:array<struct<snaks:map<string,array<{SNAK}>>>>>>>"
)
#: Qualifier properties with a meaning of their own (fixed values): start, end and point in time, and the reasons for a rank.
START, END, POINT, LOW_REASON, HIGH_REASON = "P580", "P582", "P585", "P2241", "P7452"


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """Entities of a dump that is one JSON array with an element a line; bz2 files are split by Spark."""
    line = F.regexp_replace("value", r",\s*$", "")
    return spark.read.text(path).where("length(value) > 2").select(F.from_json(line, ENTITY).alias("e")).select("e.*").where("id IS NOT NULL")


def is_seed(title: Column) -> Column:
    """A title that isn't in another namespace: the part before the first colon decides."""
    return title.isNotNull() & ~(title.contains(":") & F.substring_index(title, ":", 1).isin(*NAMESPACES))


def statements(entities: DataFrame) -> DataFrame:
    """(item, seed, property, kind, datatype, rank, qualifiers, references): a row per statement; references are arrays of properties."""
    seed = is_seed(F.element_at("sitelinks", F.lit("enwiki"))["title"])
    each = entities.select("id", F.coalesce(seed, F.lit(False)).alias("seed"), F.explode("claims").alias("property", "list")).select("id", "seed", "property", F.explode("list").alias("s"))
    snaks = F.flatten(F.map_values("s.qualifiers"))
    flat = F.transform(snaks, lambda q: F.struct(q["property"].alias("property"), q["snaktype"].alias("kind"), q["datatype"].alias("datatype"), q["datavalue"]["value"]["id"].alias("value")))
    none = F.array().cast("array<struct<property:string,kind:string,datatype:string,value:string>>")
    cited = F.transform("s.references", lambda r: F.transform(F.flatten(F.map_values(r["snaks"])), lambda q: q["property"]))
    return each.select(
        F.col("id").alias("item"), "seed", "property", F.col("s.mainsnak.snaktype").alias("kind"), F.col("s.mainsnak.datatype").alias("datatype"), F.col("s.rank").alias("rank"),
        F.coalesce(flat, none).alias("qualifiers"), F.coalesce(cited, F.array().cast("array<array<string>>")).alias("references"),
    )


def _entries() -> Column:
    """What one statement adds to the counters: (statistic, key, n)."""
    q, refs, rank = F.col("qualifiers"), F.col("references"), F.col("rank")
    entry = lambda name, key, n=1: F.struct(F.lit(name).alias("statistic"), key.cast("string").alias("key"), (F.lit(n) if isinstance(n, int) else n).cast("long").alias("n"))
    per = lambda name, items: F.transform(items, lambda x: F.struct(F.lit(name).alias("statistic"), x.cast("string").alias("key"), F.lit(1).cast("long").alias("n")))
    of = lambda field: F.transform(q, lambda x: x[field])
    every = F.lit("")
    reasons = lambda prop: F.filter(q, lambda x: x["property"] == prop)
    said = lambda prop: F.transform(reasons(prop), lambda x: F.when(x["kind"] == "value", x["value"]).otherwise(F.concat(F.lit("<"), x["kind"], F.lit(">"))))
    why = lambda name, prop, at: F.when(rank == at, F.when(F.size(reasons(prop)) == 0, per(name, F.array(F.lit("<none>")))).otherwise(per(name, said(prop)))).otherwise(F.array().cast(_ENTRIES))
    timeless = F.filter(q, lambda x: ~x["property"].isin(START, END))
    single = F.array(
        entry("statements", every), entry("by_rank", rank), entry("main_snaktype", F.col("kind")), entry("main_datatype", F.col("datatype")),
        entry("qualified_statements", every, (F.size(q) > 0).cast("int")), entry("qualifier_snaks_hist", F.size(q)), entry("qualifier_props_hist", F.size(F.array_distinct(of("property")))),
        entry("arity_all_hist", arity(F.col("kind"), q)), entry("arity_no_interval_hist", arity(F.col("kind"), timeless)),
        entry("referenced_statements", every, (F.size(refs) > 0).cast("int")), entry("references", every, F.size(refs)),
    )
    return F.concat(
        single, per("qualifier_snaktype", of("kind")), per("qualifier_datatype", of("datatype")), per("qualifier_property", of("property")), per("reference_property", F.flatten(refs)),
        why("deprecated_reasons", LOW_REASON, "deprecated"), why("preferred_reasons", HIGH_REASON, "preferred"),
    )


_ENTRIES = "array<struct<statistic:string,key:string,n:bigint>>"


def scope_statistics(rows: DataFrame) -> DataFrame:
    """(scope, statistic, key, n): all counters of statements at once, for all items and for seeds alone.

    One pass: a statement's entries are summed in its task before anything is
    shuffled, so what moves is a few thousand counters a task.
    """
    scopes = F.when(F.col("seed"), F.array(F.lit("all"), F.lit("seed"))).otherwise(F.array(F.lit("all")))
    each = rows.select(scopes.alias("scopes"), F.explode(_entries()).alias("e")).groupBy("scopes", "e.statistic", "e.key").agg(F.sum("e.n").alias("n"))
    return each.select(F.explode("scopes").alias("scope"), "statistic", "key", "n").groupBy("scope", "statistic", "key").agg(F.sum("n").alias("n")).where("n > 0")


def property_statistics(rows: DataFrame) -> DataFrame:
    """A row per main property: how many of its statements are qualified, ranked, referenced, timed, or odd in several ways."""
    q = F.col("qualifiers")
    many = lambda *props: F.size(F.filter(q, lambda x: x["property"].isin(*props)))
    n = lambda cond, name: F.count_if(cond).alias(name)
    rank = F.col("rank")
    low, high = many(LOW_REASON), many(HIGH_REASON)
    return rows.groupBy("property").agg(
        F.count("*").alias("statements"), n(F.size(q) > 0, "qualified"), n(rank == "deprecated", "deprecated"), n(rank == "preferred", "preferred"), n(F.size("references") > 0, "referenced"),
        n(many(START, END, POINT) > 0, "timed"), n(many(START) > 1, "multi_start"), n(many(END) > 1, "multi_end"), n(many(START, END, POINT) > 1, "multi_time"),
        n(F.exists(q, lambda x: x["property"] == F.col("property")), "self_qualified"), n((low > 0) & (rank != "deprecated"), "low_reason_elsewhere"), n((high > 0) & (rank != "preferred"), "high_reason_elsewhere"),
        F.sum(F.when(rank != "deprecated", low).otherwise(0)).alias("low_reason_snaks_elsewhere"), F.sum(F.when(rank != "preferred", high).otherwise(0)).alias("high_reason_snaks_elsewhere"),
    )


def pruned(entities: DataFrame) -> DataFrame:
    """Seeds alone, with their title and statements but no other sitelinks: what a slice keeps of a dump."""
    title = F.element_at("sitelinks", F.lit("enwiki"))["title"]
    return entities.where(is_seed(title)).select("id", title.alias("title"), F.size("sitelinks").alias("n_sitelinks"), "claims")


def write_pruned(entities: DataFrame, path: str, per_file: int = 1_000_000) -> None:
    """The slice as gzip files of JSON lines."""
    pruned(entities).write.option("maxRecordsPerFile", per_file).json(path, compression="gzip")


def arity(row_kind: Column, qualifiers: Column) -> Column:
    """The item, the main value and each qualifier value, without those said not to exist."""
    return 1 + (row_kind != "novalue").cast("int") + F.size(F.filter(qualifiers, lambda q: q["kind"] != "novalue"))


def rank_histogram(rows: DataFrame) -> DataFrame:
    """(rank, n) with a row for every rank, also without statements."""
    every = rows.sparkSession.createDataFrame([(r,) for r in RANKS], "rank string")
    return every.join(rows.groupBy("rank").agg(F.count("*").alias("n")), "rank", "left").select("rank", F.coalesce("n", F.lit(0)).alias("n"))


def arity_histogram(rows: DataFrame) -> DataFrame:
    return rows.groupBy(arity(F.col("kind"), F.col("qualifiers")).alias("arity")).agg(F.count("*").alias("n"))


def qualifier_pairs(rows: DataFrame) -> DataFrame:
    """(property, qualifier, n): on how many statements of a property a qualifier occurs."""
    each = rows.select("property", F.explode(F.array_distinct(F.transform("qualifiers", lambda q: q["property"]))).alias("qualifier"))
    return each.groupBy("property", "qualifier").agg(F.count("*").alias("n"))


def time_series(rows: DataFrame, time_property: str) -> DataFrame:
    """(property, n): groups of an item's statements of a property of which at least two are timed."""
    timed = rows.where(F.exists("qualifiers", lambda q: q["property"] == time_property))
    return timed.groupBy("item", "property").agg(F.count("*").alias("k")).where("k >= 2").groupBy("property").agg(F.count("*").alias("n"))


def index_rows(rows: DataFrame) -> DataFrame:
    """(item, statements, properties, qualifiers, deprecated): a row of sizes per item."""
    return rows.groupBy("item").agg(
        F.count("*").alias("statements"), F.count_distinct("property").alias("properties"),
        F.sum(F.size("qualifiers")).alias("qualifiers"), F.count_if(F.col("rank") == "deprecated").alias("deprecated"),
    )


def size_histogram(sizes: DataFrame, column: str, top: int = 500) -> DataFrame:
    """(size, n) with one last bucket."""
    return sizes.groupBy(F.least(F.col(column), F.lit(top)).alias("size")).agg(F.count("*").alias("n"))


def usage_rows(pairs: DataFrame, totals: DataFrame, least_uses: int = 10, share: float = 0.001) -> DataFrame:
    """Qualifiers used often enough to count as roles; totals: (property, main)."""
    return pairs.join(totals, "property").where((F.col("n") >= least_uses) & (F.col("n") >= F.col("main") * share)).select("property", "qualifier", "n")


def property_order(rows: DataFrame, column: str = "property") -> DataFrame:
    """Natural order of ids: P2 before P10."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.regexp_extract(column, r"([0-9]+)$", 1).try_cast("long"), column)))
