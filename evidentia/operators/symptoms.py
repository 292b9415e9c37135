"""Detectors of anomalous patterns. Each returns (symptom_type, subject, n, confidence)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Kinds of symptoms and of wrong premises, in the order of feature vectors.
SYMPTOM_TYPES = (
    "EPICYCLE_ACCUMULATION",
    "UNEXPLAINED_COINCIDENCE",
    "STRUCTURED_OBSTACLE",
    "UNIVERSAL_QUANTITY",
    "UNEXPLAINED_VALUE",
    "NULL_RESULT",
    "FRAMEWORK_MISMATCH",
    "DUAL_DESCRIPTION",
    "PROLIFERATION_WITHOUT_SELECTION",
)
ERROR_TYPES = ("UNNECESSARY_ASSUMPTION", "MISIDENTIFIED_FUNDAMENTAL", "FALSE_DICHOTOMY", "WRONG_LEVEL_OF_DESCRIPTION", "INVERTED_CAUSATION", "IMPLICIT_BACKGROUND", "CONTINUITY_ASSUMPTION")


def capped(base: float, step: float, n: Column, most: float) -> Column:
    return F.least(F.lit(most), F.lit(base) + F.lit(step) * n)


def symptom(kind: str, subject: Column, n: Column, confidence: Column) -> list[Column]:
    return [F.lit(kind).alias("symptom_type"), subject.cast("string").alias("subject"), n.cast("long").alias("n"), confidence.cast("double").alias("confidence")]


def cells(df: DataFrame, group: str, topic: str, labels: Column | None = None) -> DataFrame:
    """(group, topic, n, labels): how many items of a group are on a topic, and the distinct labels of these items. What several detectors need, in one pass."""
    kept = F.array_distinct(F.flatten(F.collect_set(labels))) if labels is not None else F.array().cast("array<string>")
    return df.groupBy(group, topic).agg(F.count("*").alias("n"), kept.alias("labels"))


def epicycles(df: DataFrame, group: str, topic: str, other: str = "other", n: str | None = None) -> DataFrame:
    """Groups with many items on few topics, or mostly on none: one conditional aggregation. Rows count ``n`` items each, if given."""
    is_other, items = F.col(topic) == other, F.col(n) if n else F.lit(1)
    out = df.groupBy(group).agg(F.sum(items).alias("total"), F.countDistinct(F.when(~is_other, F.col(topic))).alias("types"), F.coalesce(F.sum(F.when(is_other, items)), F.lit(0)).alias("others"))
    ratio = F.col("total") / F.greatest("types", F.lit(1))
    found = out.filter((F.col("total") >= 3) & ((ratio > 5) | ((F.col("others") / F.col("total") > 0.6) & (F.col("total") >= 5))))
    return found.select(*symptom("EPICYCLE_ACCUMULATION", F.col(group), F.col("total"), capped(0.4, 0.1, ratio, 0.9)))


def coincidences(df: DataFrame, group: str, topic: str, other: str = "other", least: int = 3) -> DataFrame:
    """Topics that several groups reach."""
    n = F.col("n_groups")
    found = df.filter(F.col(topic) != other).groupBy(topic).agg(F.countDistinct(group).alias("n_groups")).filter(n >= least)
    return found.select(*symptom("UNEXPLAINED_COINCIDENCE", F.col(topic), n, capped(0.5, 0.1, n, 0.95)))


def coincidence_premises(df: DataFrame, group: str, topic: str, premises: DataFrame, premise: str, other: str = "other", least: int = 3) -> DataFrame:
    """(topic, n_groups, n_shared): topics that several groups reach, and how many premises all of these share; none means that the agreement is independent."""
    reached = df.filter(F.col(topic) != other).select(topic, group).distinct()
    wide = reached.groupBy(topic).agg(F.count("*").alias("n_groups")).filter(F.col("n_groups") >= least)
    held = reached.join(premises.select(group, premise).distinct(), group).groupBy(topic, premise).agg(F.count("*").alias("_k"))
    shared = held.join(wide, topic).filter("_k = n_groups").groupBy(topic).agg(F.count("*").alias("n_shared"))
    return wide.join(shared, topic, "left").select(topic, "n_groups", F.coalesce("n_shared", F.lit(0).cast("long")).alias("n_shared"))


def structured_obstacles(df: DataFrame, group: str, kind: str, least_groups: int = 3, least: int = 3, most_kinds: int = 3) -> DataFrame:
    """Kinds of obstacles that several groups share, and groups whose obstacles are of few kinds."""
    n = F.col("n")
    wide = df.groupBy(kind).agg(F.countDistinct(group).alias("n")).filter(n >= least_groups)
    narrow = df.groupBy(group).agg(F.count("*").alias("n"), F.countDistinct(kind).alias("k")).filter((n >= least) & (F.col("k") <= most_kinds))
    one = wide.select(*symptom("STRUCTURED_OBSTACLE", F.col(kind), n, capped(0.4, 0.1, n, 0.9)))
    return one.unionAll(narrow.select(*symptom("STRUCTURED_OBSTACLE", F.col(group), n, F.lit(0.6))))


def universal_quantities(df: DataFrame, group: str, topic: str, other: str = "other", least: int = 3) -> DataFrame:
    n = F.col("n_groups")
    found = df.filter(F.col(topic) != other).groupBy(topic).agg(F.countDistinct(group).alias("n_groups")).filter(n >= least)
    sure = F.when(n >= 4, capped(0.5, 0.1, n, 0.95)).otherwise(capped(0.4, 0.1, n, 0.8))
    return found.select(*symptom("UNIVERSAL_QUANTITY", F.col(topic), n, sure))


def watched_labels(topic: str, text: str, watched: Sequence[tuple[str, Sequence[str], str]], other: str = "other") -> Column:
    """Labels of the watched values (label, topics, pattern) that an item is on the topics of, or has the pattern of in its text, in any case."""
    hit = lambda topics, pattern: F.col(topic).isin(list(topics)) | (F.col(text).ilike(pattern) & (F.col(topic) != other))
    return F.array_compact(F.array(*(F.when(hit(topics, pattern), F.lit(label)) for label, topics, pattern in watched)))


def unexplained_values(df: DataFrame, group: str, labels: Column) -> DataFrame:
    """Watched values, by how many groups have items with the label. One pass for all."""
    n = F.col("n_groups")
    found = df.select(group, F.explode(labels).alias("label")).groupBy("label").agg(F.countDistinct(group).alias("n_groups"))
    return found.select(*symptom("UNEXPLAINED_VALUE", F.col("label"), n, capped(0.4, 0.15, n, 0.9)))


def mismatches(pairs: DataFrame, a: str = "a", b: str = "b", severity: str = "severity", n: str = "n", known: Sequence[str] = ()) -> DataFrame:
    """A symptom per pair of contradicting groups, as sure as its worst contradiction, and one for each known mismatch."""
    sure = F.when(F.col(severity) == "fundamental", 0.9).when(F.col(severity) == "major", 0.7).otherwise(0.5)
    out = pairs.select(*symptom("FRAMEWORK_MISMATCH", F.concat_ws("|", a, b), F.col(n), sure))
    if known:
        out = out.unionAll(facts(pairs, "FRAMEWORK_MISMATCH", [(x, 1.0) for x in known]))
    return out


def proliferation(df: DataFrame, group: str) -> DataFrame:
    n = F.col("n")
    return df.agg(F.countDistinct(group).alias("n")).filter(n >= 2).select(*symptom("PROLIFERATION_WITHOUT_SELECTION", F.lit("groups"), n, capped(0.5, 0.05, n, 0.95)))


def dual_descriptions(claims: DataFrame, conjectures: DataFrame) -> DataFrame:
    """Claims (a, b, kind) that agree or map, and conjectures (title, kind, status, groups array, three flags) not disproved."""
    one = claims.filter(F.col("kind").isin("agrees", "maps_to")).select(*symptom("DUAL_DESCRIPTION", F.concat_ws("|", "a", "b"), F.lit(1), F.lit(0.75)))
    flags = reduce(Column.__add__, (F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in ("algebraic", "numerical", "dimensional")))
    open_ = conjectures.filter(F.col("kind").isin("duality", "equivalence", "mapping") & (F.col("status") != "disproved") & (F.size("groups") >= 2))
    return one.unionAll(open_.select(*symptom("DUAL_DESCRIPTION", F.col("title"), F.size("groups"), capped(0.5, 0.15, flags, 0.95))))


def facts(like: DataFrame, kind: str, rows: Sequence[tuple[str, float]]) -> DataFrame:
    """Literal symptoms (subject, confidence)."""
    schema = T.StructType([T.StructField("s", T.StringType()), T.StructField("c", T.DoubleType())])
    return like.sparkSession.createDataFrame(list(rows), schema).select(*symptom(kind, F.col("s"), F.lit(1), F.col("c")))


def detect_all(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def detected(spark: SparkSession, detectors: Mapping[str, Callable[[], DataFrame]]) -> tuple[DataFrame, dict[str, str]]:
    """The symptoms of all detectors that can be planned, and what kept the others from it, by name: a missing table or column of one leaves the rest."""
    found, failed = [], {}
    for name, detect in detectors.items():
        try:
            df = detect()
            df.schema  # plans the query, so that an unknown column or table shows here
            found.append(df)
        except Exception as e:  # whatever a detector raises
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
    empty = spark.createDataFrame([], "symptom_type string, subject string, n long, confidence double")
    return detect_all(empty, *found), failed


def feature_vector(df: DataFrame, key: str, kind: str, confidence: str, group: str, topic: str, kinds: Sequence[str] = SYMPTOM_TYPES) -> DataFrame:
    """(key, features): presence, counts and highest confidence of each kind, then distinct groups and topics, number and mean confidence. One aggregation."""
    is_ = lambda k: F.col(kind) == k
    present = [F.max(is_(k).cast("double")) for k in kinds]
    counts = [F.count_if(is_(k)).cast("double") for k in kinds]
    highest = [F.coalesce(F.max(F.when(is_(k), F.col(confidence))), F.lit(0.0)).cast("double") for k in kinds]
    rest = [F.countDistinct(group).cast("double"), F.countDistinct(F.when(F.col(topic) != "", F.col(topic))).cast("double"), F.count("*").cast("double"), F.avg(confidence)]
    return df.groupBy(key).agg(F.array(*present, *counts, *highest, *rest).alias("features"))


def time_slices(df: DataFrame, key: str, year: str, stuck: str, symptoms: str, offsets: Sequence[int] = (-20, -10, -5, -1)) -> DataFrame:
    """Earlier snapshots of records: the first symptoms only, the fewer the earlier; records without symptoms have none."""
    stages = F.array(*(F.struct(F.lit(i + 1).alias("i"), F.lit(o).alias("offset")) for i, o in enumerate(offsets)))
    each = df.filter(F.size(symptoms) > 0).withColumn("_s", F.explode(stages))
    keep = F.greatest(F.lit(1), F.floor(F.size(symptoms) * F.col("_s.i") / (len(offsets) + 1)).cast("int"))
    return each.select(
        key,
        (F.col(year) + F.col("_s.offset")).alias(year),
        F.greatest(F.lit(1), F.col(stuck) + F.col("_s.offset")).alias(stuck),
        F.slice(symptoms, F.lit(1), keep).alias(symptoms),
    )


def random_drops(df: DataFrame, key: str, symptoms: str, seed: int, copies: int = 3) -> DataFrame:
    """Copies of records with one or two symptoms dropped, chosen by a seeded hash: the same on every run."""
    each = df.filter(F.size(symptoms) > 1).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    drop = F.least(F.lit(1) + F.pmod(F.xxhash64(F.lit(seed), key, "copy"), F.lit(2)).cast("int"), F.size(symptoms) - 1)
    ranked = F.array_sort(F.transform(symptoms, lambda x, i: F.struct(F.xxhash64(F.lit(seed), F.col(key), F.col("copy"), i).alias("h"), i.alias("i"), x.alias("x"))))
    kept = F.array_sort(F.transform(F.slice(ranked, drop + 1, F.size(symptoms)), lambda r: F.struct(r["i"].alias("i"), r["x"].alias("x"))))
    return each.select(key, "copy", F.transform(kept, lambda r: r["x"]).alias(symptoms))


def augment_all(df: DataFrame, key: str, year: str, stuck: str, symptoms: str, seed: int, negatives: DataFrame | None = None, copies: int = 3) -> DataFrame:
    """(key, year, stuck, symptoms, way): records, their earlier snapshots, copies with symptoms dropped; then the negatives and copies of those."""

    def dropped(rows: DataFrame) -> DataFrame:
        return random_drops(rows, key, symptoms, seed, copies).drop("copy").join(rows.select(key, year, stuck), key).withColumn("way", F.lit("dropped"))

    cols = [key, year, stuck, symptoms, "way"]
    own = df.select(key, year, stuck, symptoms)
    parts = [own.withColumn("way", F.lit("record")), time_slices(own, key, year, stuck, symptoms).withColumn("way", F.lit("slice")), dropped(own)]
    if negatives is not None:
        no = negatives.select(key, year, stuck, symptoms)
        parts += [no.withColumn("way", F.lit("negative")), dropped(no)]
    return reduce(DataFrame.unionByName, (p.select(cols) for p in parts))


# What to question for each kind of wrong premise; {subject} is the symptom's.
SUGGESTIONS = {
    "UNNECESSARY_ASSUMPTION": "Drop what {subject} takes for granted and see what remains.",
    "MISIDENTIFIED_FUNDAMENTAL": "Derive {subject} from something else.",
    "FALSE_DICHOTOMY": "Look for one thing behind both sides of {subject}.",
    "WRONG_LEVEL_OF_DESCRIPTION": "Describe {subject} at another level.",
    "INVERTED_CAUSATION": "Swap cause and effect in {subject}.",
    "IMPLICIT_BACKGROUND": "Let the fixed background of {subject} change.",
    "CONTINUITY_ASSUMPTION": "Make {subject} discrete, or continuous.",
}


def suggestions(df: DataFrame, error: str, subject: str, templates: dict[str, str] = SUGGESTIONS) -> DataFrame:
    """``df`` with ``suggestion``, the template of the kind of error with the subject put in; null for unknown kinds."""
    table = F.create_map(*(F.lit(x) for kv in templates.items() for x in kv))
    return df.withColumn("suggestion", F.replace(F.try_element_at(table, F.col(error)), F.lit("{subject}"), F.col(subject)))
