"""Transcripts, the answers found in them, and what these answers say about a diagnosis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lrforge.functions.numeric import odds_label, to_number
from lrforge.functions.text import answer_of, clinical_context, parse_response, transcript_prompt

ITEM = "array<struct<finding:string,explanation:string,abbreviations:map<string,string>>>"
EVIDENCE = f"`for` {ITEM}, against {ITEM}, summary string"
ITEMS = 5


def transcripts(turns: DataFrame, key: str = "conv_id", order: str = "turn", text: str = "text", separator: str = "\n") -> DataFrame:
    """One row a conversation: its turns in order, joined, and how many they are."""
    ordered = F.array_sort(F.collect_list(F.struct(order, text)))
    return turns.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x[text]), separator).alias("transcript"), F.count("*").alias("turns"))


def template(rows: DataFrame) -> DataFrame:
    """Rows (diagnosis, Information, LR, ...) as (diagnosis, info, lr); those without information go."""
    return rows.where("Information is not null").select("diagnosis", F.col("Information").alias("info"), F.col("LR").cast("string").alias("lr"))


def fill_labels(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Ratios that a template leaves open, filled from estimates (diagnosis, info, odds): a label of five."""
    joined = rows.join(estimates, ["diagnosis", "info"], "left")
    return joined.select("diagnosis", "info", F.coalesce("lr", odds_label(F.col("odds"))).alias("lr"))


def prompts(transcript_rows: DataFrame, templates: DataFrame) -> DataFrame:
    """A prompt for each transcript and diagnosis; diagnoses are a small stated set, kept as one array a row."""
    asked = templates.groupBy("diagnosis").agg(F.array_sort(F.collect_set("info")).alias("infos"))
    every = asked.agg(F.array_sort(F.collect_list(F.struct("diagnosis", "infos"))).alias("all"))
    spread = transcript_rows.join(F.broadcast(every)).select("conv_id", "transcript", F.explode("all").alias("d"))
    return spread.select("conv_id", F.col("d.diagnosis").alias("diagnosis"), transcript_prompt(F.col("d.infos"), F.col("transcript")).alias("prompt"))


def answers(responses: DataFrame) -> DataFrame:
    """Lines `info: answer` of a response as (conv_id, diagnosis, info, answer); what wasn't asked is null."""
    line = F.explode(F.split("response", "\n")).alias("line")
    parts = responses.select("conv_id", "diagnosis", line).select("conv_id", "diagnosis", F.regexp_extract("line", r"^\s*(.*?)\s*:\s*([^:]*)$", 1).alias("info"), F.regexp_extract("line", r":\s*([^:]*)$", 1).alias("said"))
    return parts.where("info <> ''").select("conv_id", "diagnosis", "info", answer_of(F.col("said")).alias("answer"))


def matched(answer_rows: DataFrame, templates: DataFrame) -> DataFrame:
    """Answers with the ratio of their information; an answer without one has null."""
    return answer_rows.join(templates, ["diagnosis", "info"], "left").withColumn("lr_value", to_number(F.col("lr")))


def posterior_odds(matches: DataFrame, prior_odds: Column) -> DataFrame:
    """Odds of each diagnosis after the findings that were answered yes, ratios taken as independent."""
    log_lr = F.when(F.col("answer") & (F.col("lr_value") > 0), F.ln("lr_value"))
    return matches.groupBy("conv_id", "diagnosis").agg(F.count_if(log_lr.isNotNull()).alias("used"), (prior_odds * F.exp(F.coalesce(F.sum(log_lr), F.lit(0.0)))).alias("odds"))


def top_evidence(long: DataFrame, group: list[str], n: int = 5, lr: str = "lr", item: str = "finding") -> DataFrame:
    """The n findings that speak most for and most against each group, ranked, ties by name."""
    ranked = long.select(*group, item, lr, F.row_number().over(W.partitionBy(*group).orderBy(F.desc(lr), item)).alias("rf"), F.row_number().over(W.partitionBy(*group).orderBy(F.asc(lr), item)).alias("ra"))
    sides = F.explode(F.array(F.struct(F.lit("for").alias("side"), F.col("rf").alias("rank")), F.struct(F.lit("against").alias("side"), F.col("ra").alias("rank"))))
    return ranked.select(*group, item, lr, sides.alias("s")).where(F.col("s.rank") <= n).select(*group, "s.side", "s.rank", item, lr)


def contexts(features: DataFrame, key: str, order: str = "info") -> DataFrame:
    """Numbered lines of a case's features with their status."""
    status = F.when(F.col("answer"), "present").when(~F.col("answer"), "absent").otherwise("not asked")
    ordered = F.array_sort(F.collect_list(F.struct(order, status.alias("status"))))
    return features.groupBy(key).agg(clinical_context(F.transform(ordered, lambda x: F.struct(x[order].alias("feature"), x["status"].alias("status")))).alias("context"))


def combined(features: DataFrame, key: str, groups: dict[str, list[str]], group: str = "category", item: str = "finding", order: str = "finding_order") -> DataFrame:
    """(key, category, findings): each case's findings by named unions of categories, category after category, each in its own order.

    groups: name -> categories, a stated list; a category may be in several. A union without a finding gives no row.
    """
    names = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(i).alias("place"), F.lit(c).alias("of")) for name, cs in groups.items() for i, c in enumerate(cs)])
    each = features.withColumn("g", F.explode(F.filter(names, lambda x: x["of"] == F.col(group))))
    ordered = F.array_sort(F.collect_list(F.struct("g.place", order, item)))
    return each.groupBy(key, F.col("g.name").alias("category")).agg(F.transform(ordered, lambda x: x[item]).alias("findings"))


def evidence(responses: DataFrame, key: list[str], response: str = "response") -> tuple[DataFrame, DataFrame]:
    """(items, faults) of responses to feedback prompts.

    items: (key, side, rank, finding, explanation, abbreviations). faults: (key, fault), a row a response that is no such JSON, or
    hasn't five findings on a side, or one without a text; its items, if any, are given all the same.
    """
    read = responses.select(*key, parse_response(F.col(response), EVIDENCE).alias("e"))
    sides = F.array(F.struct(F.lit("for").alias("side"), F.col("e.for").alias("list")), F.struct(F.lit("against").alias("side"), F.col("e.against").alias("list")))
    each = read.select(*key, F.explode(sides).alias("s")).select(*key, "s.side", F.posexplode("s.list").alias("rank", "i"))
    items = each.select(*key, "side", (F.col("rank") + 1).alias("rank"), "i.finding", "i.explanation", F.coalesce("i.abbreviations", F.create_map().cast("map<string,string>")).alias("abbreviations"))
    blank = lambda side: F.exists(F.col(f"e.{side}"), lambda x: F.trim(F.coalesce(x["finding"], F.lit(""))) == "")
    fault = F.when(F.col("e.for").isNull() | F.col("e.against").isNull(), "no lists").when((F.size("e.for") != ITEMS) | (F.size("e.against") != ITEMS), F.format_string("%d for, %d against", F.size("e.for"), F.size("e.against"))).when(blank("for") | blank("against"), "a finding without a text")
    return items, read.select(*key, fault.alias("fault")).where("fault is not null")
