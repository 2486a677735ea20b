"""The queries of the llm operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.llm.levels import labelled_sample, level_check, reading_levels, train_levels
from lexforge.llm.mixing import mix_targets_of, mixture
from lexforge.llm.packing import byte_tokens, containers_of, fill_containers, fill_report
from lexforge.llm.plain import not_plain, plain_spelling
from lexforge.llm.sampling import balanced_sample, targets_of
from lexforge.llm.sentences import sentences
from lexforge.llm.terms import distinctive_terms, term_frequency
from lexforge.sources.tables import table


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    scores = distinctive_terms(table(spark, base, "rashi", "rec_id", "dh", "t"), "rec_id", ["dh", "t"])
    return scores.where("n_in_record >= 3 and n_records between 2 and 8").select("rec_id", "term")


def p1_scores(spark: SparkSession, base: str) -> DataFrame:
    scores = distinctive_terms(table(spark, base, "rashi", "rec_id", "dh", "t"), "rec_id", ["dh", "t"])
    return scores.select("rec_id", "term", "n_in_record", "record_terms", "n_occurrences", "n_records", (F.round("p_log10", 3) + F.lit(0.0)).alias("p_log10"), F.round("score", 3).alias("score"))


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return not_plain(table(spark, base, "rashi", "rec_id", "dh", "t", "vt"), "rec_id", ["dh", "t", "vt"])


def p2_plain(spark: SparkSession, base: str) -> DataFrame:
    return plain_spelling(table(spark, base, "rashi", "rec_id", "dh", "t", "vt"), "rec_id", ["dh", "t", "vt"]).select("rec_id", "field", "plain", "changed")


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return sentences(table(spark, base, "rashi", "rec_id", "t"), "rec_id", "t")


#: White space of any script, as a regular-expression class.
BLANKS = "[\\x{09}-\\x{0d}\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def p3_check(spark: SparkSession, base: str) -> DataFrame:
    """What the sentences of each record must keep: every sign but blanks once, in order, numbered from 1, no blank at the ends."""
    texts = table(spark, base, "rashi", "rec_id", "t")
    cut_ = sentences(texts, "rec_id", "t").groupBy("rec_id").agg(F.sort_array(F.collect_list(F.struct("sent_no", "start_pos", "end_pos"))).alias("s"))
    both = texts.join(cut_, "rec_id").select("rec_id", "s", F.transform("s", lambda x: F.substring(F.col("t"), x["start_pos"] + 1, x["end_pos"] - x["start_pos"])).alias("parts"))
    signs = F.length(F.regexp_replace(F.array_join("parts", ""), BLANKS, ""))
    numbered = F.forall("s", lambda x: F.get(F.col("s"), x["sent_no"] - 1)["start_pos"] == x["start_pos"])
    ordered = F.forall("s", lambda x: (x["start_pos"] < x["end_pos"]) & (x["end_pos"] <= F.coalesce(F.get(F.col("s"), x["sent_no"])["start_pos"], F.lit((1 << 31) - 1))))
    trimmed = ~F.exists("parts", lambda p: p.rlike(f"^{BLANKS}|{BLANKS}$"))
    return both.select("rec_id", signs.cast("bigint").alias("signs"), numbered.alias("numbered"), ordered.alias("ordered"), trimmed.alias("trimmed"))


QUERY_BOUNDS = (("dhwords_lo", "dhwords_hi"), ("lk_lo", "lk_hi"))


def _sampled(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    targets = targets_of(table(spark, base, "sample_targets"), QUERY_BOUNDS)
    return balanced_sample(table(spark, base, "queries_partial", "id", "dhWords", "lk"), "id", ("dhWords", "lk"), targets, QUERY_BOUNDS)


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return _sampled(spark, base)[1].where("short").select(F.col("plan_id").cast("int").alias("plan_id"), F.col("stratum_id").cast("int").alias("stratum_id"))


def p5_sample(spark: SparkSession, base: str) -> DataFrame:
    return _sampled(spark, base)[0]


def p5_report(spark: SparkSession, base: str) -> DataFrame:
    return _sampled(spark, base)[1]


def p5_check(spark: SparkSession, base: str) -> DataFrame:
    """What the sample itself must keep, for each stratum: its minimum, the plan's size, every id once, and no stratum more than a row off."""
    sample, report = _sampled(spark, base)
    strata = sample.select("plan_id", F.explode("strata").alias("stratum_id")).groupBy("plan_id", "stratum_id").agg(F.count(F.lit(1)).alias("n"))
    plans = sample.groupBy("plan_id").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("ids"))
    targets = table(spark, base, "sample_targets").select(F.col("plan_id").cast("bigint").alias("plan_id"), F.col("stratum_id").cast("bigint").alias("stratum_id"), "min_rows", "sample_size")
    per_plan = Window.partitionBy("plan_id")
    both = report.join(targets, ["plan_id", "stratum_id"]).join(strata, ["plan_id", "stratum_id"], "left").join(plans, "plan_id", "left").na.fill(0, ["n", "rows", "ids"])
    least = F.least("min_rows", "available")
    size = F.greatest(F.sum(least).over(per_plan), F.least(F.max("sample_size").over(per_plan), F.sum("available").over(per_plan)))
    return both.select(
        F.col("plan_id").cast("int").alias("plan_id"), F.col("stratum_id").cast("int").alias("stratum_id"), "available", F.round("wanted", 4).alias("wanted"),
        (F.col("n") >= least).alias("minimum_kept"), (F.abs(F.col("rows") - size) <= 1).alias("size_kept"), (F.col("rows") == F.col("ids")).alias("ids_once"), (F.abs(F.col("n") - F.col("attainable")) < 1).alias("balanced"),
    )


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    return term_frequency(table(spark, base, "rashi", "dh", "t"), ["dh", "t"]).where("mark is not null").select("field", "term", "mark")


def p6_terms(spark: SparkSession, base: str) -> DataFrame:
    return term_frequency(table(spark, base, "rashi", "dh", "t"), ["dh", "t"])


def _packed(spark: SparkSession, base: str) -> DataFrame:
    capacities = containers_of(table(spark, base, "containers"))
    return fill_containers(table(spark, base, "documents", "doc_id", "text"), "doc_id", byte_tokens("text"), capacities)


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    return _packed(spark, base).where("n_parts > 1 and part_no = 1").select("capacity_id", "doc_id")


def p7_containers(spark: SparkSession, base: str) -> DataFrame:
    return _packed(spark, base)


def p7_check(spark: SparkSession, base: str) -> DataFrame:
    """What the containers hold, for each capacity: all tokens of all documents once, no container overfull, whole documents in one piece."""
    rows = _packed(spark, base)
    fill = rows.groupBy("capacity_id", "capacity_tokens", "container").agg(F.sum("n_tokens").alias("n"))
    least = F.ceil(F.sum("n") / F.first("capacity_tokens"))
    held = fill.groupBy("capacity_id").agg(F.sum("n").alias("tokens"), (F.max("n") <= F.first("capacity_tokens")).alias("none_overfull"), (F.count(F.lit(1)) <= least * 1.06 + 3).alias("few"))
    whole = rows.groupBy("capacity_id").agg(F.count_distinct("doc_id").alias("docs"), (F.count_if((F.col("part_no") < F.col("n_parts")) & (F.col("n_tokens") < F.col("capacity_tokens"))) == 0).alias("in_one_piece"))
    return held.join(whole, "capacity_id").select("capacity_id", "docs", "tokens", "none_overfull", "few", "in_one_piece")


def p7_report(spark: SparkSession, base: str) -> DataFrame:
    return fill_report(_packed(spark, base))


def _mixed(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    return mixture(table(spark, base, "documents", "doc_id", "source", "text"), "doc_id", "source", "text", mix_targets_of(table(spark, base, "mix_targets")))


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    return _mixed(spark, base)[1].where("short").select("mix_id", "source")


def p8_mixture(spark: SparkSession, base: str) -> DataFrame:
    return _mixed(spark, base)[0]


def p8_check(spark: SparkSession, base: str) -> DataFrame:
    """What the drawn documents themselves come to, for each source of a mix: within one document of what can be had, no repeat beyond the cap."""
    targets = mix_targets_of(table(spark, base, "mix_targets"))
    drawn, report = _mixed(spark, base)
    sums = drawn.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("n_copies")).alias("n"), F.max("n_copies").alias("copies"), F.max("tokens").alias("largest"))
    caps = spark.createDataFrame([(m, s, float(targets.repeats[i, k])) for i, m in enumerate(targets.mixes) for k, s in enumerate(targets.sources)], "mix_id int, source string, cap double")
    aim = F.least("target_tokens", "most_tokens")
    both = report.join(sums, ["mix_id", "source"], "left").join(caps, ["mix_id", "source"]).na.fill(0, ["n", "copies", "largest"])
    return both.select("mix_id", "source", F.round(aim, 2).alias("attainable"), "short", (F.abs(F.col("n") - aim) <= F.col("largest")).alias("reached"), (F.col("copies") <= F.col("cap")).alias("cap_kept"), (F.col("n") == F.col("actual_tokens")).alias("reported"), (F.col("objective") <= F.col("objective_start") / 2).alias("fitted"))


def p8_report(spark: SparkSession, base: str) -> DataFrame:
    return _mixed(spark, base)[1]


def _level_model(spark: SparkSession, base: str):
    return train_levels(labelled_sample(table(spark, base, "level_refs"), "lang", "read_level", "text"))


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    checked = level_check(table(spark, base, "documents", "doc_id", "text", "level_tag").where("level_tag is not null"), "doc_id", "text", "level_tag", _level_model(spark, base))
    return checked.where("abs(declared - level) >= 3").select("doc_id")


def p9_levels(spark: SparkSession, base: str) -> DataFrame:
    return reading_levels(table(spark, base, "documents", "doc_id", "text"), "doc_id", "text", _level_model(spark, base)).select("doc_id", "level", "lang", F.round("posterior", 6).alias("posterior"), "n_unigrams")


def p9_profile(spark: SparkSession, base: str) -> DataFrame:
    levels = reading_levels(table(spark, base, "documents", "doc_id", "text"), "doc_id", "text", _level_model(spark, base))
    return levels.groupBy("lang", "level").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_unigrams").alias("n_unigrams"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("p") and k[1].isdigit() and callable(v)}
