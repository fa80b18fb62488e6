"""The taxonomy and the labels that outlive rebuilds, keyed by normal form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.rules import NOISE
from ..functions.text import norm

TAXONOMY = "domains array<struct<name:string,categories:array<struct<name:string,desc:string,examples:array<string>>>>>, unclassified struct<name:string,desc:string,count:int>"
ASSIGNED = "batch int, assignments array<struct<id:bigint,text:string,cat:string>>"


def taxonomy_of(spark: SparkSession, path: str, merged: dict[str, list[str]] | None = None) -> DataFrame:
    """The taxonomy file as rows; ``merged`` groups categories, which otherwise stand for themselves."""
    raw = spark.read.schema(TAXONOMY).option("multiLine", True).json(path)
    rows = raw.select(F.explode("domains").alias("d")).select(F.col("d.name").alias("domain"), F.explode("d.categories").alias("c"))
    rows = rows.select(F.col("c.name").alias("name"), "domain", F.col("c.desc").alias("description"))
    rest = raw.filter("unclassified IS NOT NULL").select(F.col("unclassified.name").alias("name"), F.lit("非知识点").alias("domain"), F.col("unclassified.desc").alias("description"))
    return ordered_taxonomy(rows.unionByName(rest), merged)


def ordered_taxonomy(rows: DataFrame, merged: dict[str, list[str]] | None = None) -> DataFrame:
    """With ``merged`` and ``sort_order``; a taxonomy is some ninety rows."""
    of = {cat: big for big, cats in (merged or {}).items() for cat in cats}
    name = F.col("name")
    big = F.coalesce(F.create_map(*[F.lit(x) for kv in of.items() for x in kv])[name], name) if of else name
    place = F.row_number().over(Window.orderBy("domain", "name")) - 1
    return rows.withColumn("merged", big).withColumn("sort_order", place)


def assignments(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Labels by normal form from the files of assignments; the last file wins."""
    rows = spark.read.schema(ASSIGNED).option("multiLine", True).json(paths).select(F.input_file_name().alias("file"), F.posexplode("assignments").alias("pos", "a"))
    rows = rows.select(norm(F.col("a.text")).alias("norm"), F.col("a.cat").alias("cat"), "file", "pos").filter("norm <> ''")
    return latest(rows, "norm", [F.desc("file"), F.desc("pos")]).select("norm", "cat")


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_r = 1").drop("_r")


def merged_labels(old: DataFrame, new: DataFrame) -> DataFrame:
    """The label table with new labels over old ones."""
    both = old.select("norm", "cat", F.lit(0).alias("_age")).unionByName(new.select("norm", "cat", F.lit(1).alias("_age")))
    return latest(both, "norm", [F.desc("_age"), F.asc("cat")]).drop("_age")


def labeled(questions: DataFrame, labels: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Questions with category, domain and merged label; a label outside the taxonomy is none."""
    known = labels.join(taxonomy.select(F.col("name").alias("cat"), "domain", "merged"), "cat")
    base = questions.drop("llm_cat", "llm_domain", "llm_merged")
    out = base.join(known, "norm", "left")
    return out.withColumns({c: F.coalesce(x, F.lit("")) for c, x in (("llm_cat", "cat"), ("llm_domain", "domain"), ("llm_merged", "merged"))}).drop("cat", "domain", "merged")


def label_stats(questions: DataFrame, labels: DataFrame) -> DataFrame:
    """How many labels there are, and how many questions carry one."""
    one = F.lit(1).alias("_one")
    applied = questions.agg(F.count_if(F.col("llm_cat") != "").alias("applied"))
    return labels.agg(F.count(F.lit(1)).alias("labels")).select("labels", one).join(applied.select("applied", one), "_one").drop("_one")


def category_report(questions: DataFrame, few: int = 4) -> DataFrame:
    """Questions by category, with a mark on categories of few."""
    out = questions.filter((F.col("llm_cat") != "") & (F.col("llm_cat") != NOISE)).groupBy("llm_domain", "llm_cat").agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("few", F.col("n") <= few)


def candidates(counted: DataFrame, whole: bool = False) -> DataFrame:
    """The questions to be labelled, in the default order: those without a label, or all but noise."""
    rows = counted.filter(F.lit(True) if whole else F.col("llm_cat") == "")
    return rows.filter(F.col("llm_cat") != NOISE).select("question_id", F.col("canonical").alias("text"), F.col("category").alias("module"), "topic", "n").orderBy(F.desc("n"), F.char_length("canonical"), "question_id")


def module_report(batch: DataFrame) -> DataFrame:
    """How many questions to be labelled each module has, most first."""
    return batch.groupBy("module").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "module")


def load_report(assigned: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """One row about raw assignments (``text``, ``cat``): all, without a text, of unknown categories, noise, and norms labelled."""
    known = taxonomy.select(F.col("name").alias("cat"), F.lit(True).alias("_known")).distinct()
    rows = assigned.withColumn("norm", norm(F.coalesce("text", F.lit("")))).join(known, "cat", "left")
    blank = F.col("norm") == ""
    return rows.agg(
        F.count(F.lit(1)).alias("assigned"),
        F.count_if(blank).alias("without_text"),
        F.count_if(~blank & F.col("_known").isNull()).alias("unknown"),
        F.count_if(~blank & (F.col("cat") == NOISE)).alias("noise"),
        F.count_distinct(F.when(~blank & F.col("_known"), F.col("norm"))).alias("norms"),
    )


def coverage(batches: DataFrame, assigned: DataFrame) -> DataFrame:
    """Per batch the rows asked (``batch``, ``id``) and answered, and whether the ids are the same."""
    asked = batches.groupBy("batch", "id").agg(F.count(F.lit(1)).alias("a"))
    got = assigned.groupBy("batch", "id").agg(F.count(F.lit(1)).alias("b"))
    met = asked.join(got, ["batch", "id"], "left").union(got.join(asked, ["batch", "id"], "left_anti").select("batch", "id", F.lit(None).cast("long").alias("a"), "b"))
    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    out = met.groupBy("batch").agg(F.sum(a).alias("asked"), F.sum(b).alias("answered"), F.every(a == b).alias("whole"))
    return out.withColumn("whole", F.col("whole") & (F.col("asked") > 0))


def rule_precision(texts: DataFrame, rules: dict[str, str], noise: str = "noise") -> DataFrame:
    """For each rule its hits, the share of them that is noise, and the share of all noise that it hits."""
    from ..functions.regex import found

    marks = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), found(F.col("text"), p).alias("hit")) for k, p in rules.items()]))
    rows = texts.select(F.col(noise).alias("is_noise"), marks.alias("m")).select("is_noise", "m.*")
    out = rows.groupBy("rule").agg(F.count_if("hit").alias("hits"), F.count_if(F.col("hit") & F.col("is_noise")).alias("noise_hits"), F.count_if("is_noise").alias("all_noise"))
    return out.select("rule", "hits", "noise_hits", F.round(F.try_divide("noise_hits", "hits"), 6).alias("precision"), F.round(F.try_divide("noise_hits", "all_noise"), 6).alias("coverage"))
