"""Queries over expressions of competing groups, given as rows; trees need Python, the rest is joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import expressions as E
from evidentia.functions.text import simple_fraction
from evidentia.operators import clusters, pairs, ranking
from evidentia.plans.registry import known, query
from evidentia.sources.literals import FRAMEWORKS

FORMULAS = [
    (1, "alpha", "area", "A/(4*G)"),
    (2, "beta", "area", "A/(4*G)"),
    (3, "gamma", "area", "A/(4*G) - 3*log(A/G)/2"),
    (4, "beta", "area", "A/(4*G) - 3/2*log(A/G)"),
    (5, "alpha", "growth", "x**2*y"),
    (6, "beta", "growth", "y*x*x"),
    (7, "gamma", "growth", "1/x + y"),
    (8, "delta", "growth", "(x + y)**2"),
    (9, "alpha", "growth", "x**2 + 2*x*y + y**2"),
    (10, "delta", "area", "broken ((("),
    (11, "delta", "limit", "G*M/r + 1"),
    (12, "beta", "limit", "1"),
]


def formulas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FORMULAS, "id int, grp string, topic string, expr string")


@query(
    known(
        "topic varchar, id_a int, id_b int, structural double, numerical double, dimensional double, score double, label varchar",
        ('area', 1, 10, 0.0, None, 1.0, 0.428571, 'analogous'),
        ('area', 1, 2, 1.0, 1.0, 1.0, 1.0, 'exact'),
        ('area', 2, 10, 0.0, None, 1.0, 0.428571, 'analogous'),
        ('area', 3, 10, 0.0, None, 1.0, 0.428571, 'analogous'),
        ('area', 3, 4, 1.0, 1.0, 1.0, 1.0, 'exact'),
        ('area', 4, 10, 0.0, None, 1.0, 0.428571, 'analogous'),
        ('growth', 5, 6, 1.0, 1.0, 0.5, 0.884615, 'structural'),
        ('growth', 5, 7, 0.8, 0.01, 0.5, 0.366154, 'analogous'),
        ('growth', 8, 9, 1.0, 1.0, 0.5, 0.884615, 'structural'),
    )
)
def expression_matches(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different groups within a topic, with structural, dimensional and numerical scores and their weighted mean."""
    found = pairs.cross_group_pairs(formulas(spark), "id", "grp", ["topic"], keep=["expr"])
    scores = {
        "structural": E.udf(E.structural_score, "double")(F.col("expr_a"), F.col("expr_b")),
        "numerical": E.udf(E.agreement, "double")(F.col("expr_a"), F.col("expr_b")),
        "dimensional": ranking.dimension_score(F.col("topic"), F.col("topic"), {"area": "[L]^2"}),
    }
    scored = found.select("topic", "id_a", "id_b", *(c.alias(k) for k, c in scores.items()))
    total = ranking.weighted_mean({k: F.col(k) for k in scores})
    return scored.withColumn("score", F.round(total, 6)).withColumn("label", ranking.match_label(F.col("score"))).filter("score >= 0.3")


@query(
    known(
        "id_a int, id_b int, distance int",
        (1, 10, None),
        (1, 2, 0),
        (1, 3, 18),
        (1, 4, 18),
        (11, 12, 8),
        (2, 10, None),
        (2, 3, 18),
        (3, 10, None),
        (3, 4, 0),
        (4, 10, None),
        (5, 6, 4),
        (5, 7, 1),
        (5, 8, 4),
        (6, 7, 5),
        (6, 8, 6),
        (6, 9, 11),
        (7, 8, 4),
        (7, 9, 8),
        (8, 9, 8),
    )
)
def tree_distance(spark: SparkSession, d: str) -> DataFrame:
    def of(a: str, b: str) -> int | None:
        x, y = E.parse(a), E.parse(b)
        return None if x is None or y is None else E.distance(x, y)

    found = pairs.cross_group_pairs(formulas(spark), "id", "grp", ["topic"], keep=["expr"])
    return found.select("id_a", "id_b", E.udf(of, "int")(F.col("expr_a"), F.col("expr_b")).alias("distance"))


@query(
    known(
        "skeleton varchar, n_groups bigint, n bigint, significance double",
        ('Add(Mul(c, log(Mul(Pow(v1, c), v0))), Mul(Pow(Mul(c, v1), c), v0))', 2, 2, 0.4),
        ('Mul(Pow(Mul(c, v1), c), v0)', 2, 2, 0.4),
    )
)
def skeleton_groups(spark: SparkSession, d: str) -> DataFrame:
    """Skeletons that two or more groups share, and how significant: 0.4, from three groups on 0.6."""
    rows = formulas(spark).withColumn("skeleton", E.udf(lambda t: None if E.parse(t) is None else E.skeleton(E.parse(t)), "string")(F.col("expr")))
    out = rows.filter("skeleton is not null").groupBy("skeleton").agg(F.countDistinct("grp").alias("n_groups"), F.count("*").alias("n")).filter("n_groups >= 2")
    return out.withColumn("significance", F.when(F.col("n_groups") >= 3, 0.6).otherwise(0.4))


@query(
    known(
        "property varchar, n_groups bigint, n bigint, significance double",
        ('even_in_x', 2, 2, 0.5),
        ('homogeneous_in_A_deg_1.0', 2, 2, 0.5),
        ('homogeneous_in_G_deg_-1.0', 2, 2, 0.5),
        ('homogeneous_in_x_deg_2.0', 2, 2, 0.5),
        ('homogeneous_in_y_deg_1.0', 2, 2, 0.5),
        ('odd_in_A', 2, 2, 0.5),
        ('odd_in_G', 2, 2, 0.5),
        ('odd_in_y', 2, 2, 0.5),
    )
)
def parity_scan(spark: SparkSession, d: str) -> DataFrame:
    rows = formulas(spark).select("grp", F.explode(E.udf(E.parity, "array<string>")(F.col("expr"))).alias("property"))
    out = rows.groupBy("property").agg(F.countDistinct("grp").alias("n_groups"), F.count("*").alias("n")).filter("n_groups >= 2")
    return out.withColumn("significance", F.least(F.col("n_groups") / 4, F.lit(1.0)))


@query(
    known(
        "id_a int, id_b int, c_a double, c_b double, fraction varchar",
        (1, 2, 4.0, 4.0, '1'),
        (1, 3, 4.0, -1.5, '-8/3'),
        (1, 3, 4.0, 4.0, '1'),
        (1, 4, 4.0, -1.5, '-8/3'),
        (1, 4, 4.0, 4.0, '1'),
        (2, 3, 4.0, -1.5, '-8/3'),
        (2, 3, 4.0, 4.0, '1'),
        (3, 4, -1.5, -1.5, '1'),
        (3, 4, -1.5, 4.0, '-3/8'),
        (3, 4, 4.0, -1.5, '-8/3'),
        (3, 4, 4.0, 4.0, '1'),
        (5, 8, 2.0, 2.0, '1'),
        (8, 9, 2.0, 2.0, '1'),
    )
)
def coefficient_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients of different groups within a topic whose ratio is a simple fraction."""
    rows = formulas(spark).select("id", "grp", "topic", F.explode(E.udf(E.coefficients, "array<double>")(F.col("expr"))).alias("c"))
    found = pairs.cross_group_pairs(rows, "id", "grp", ["topic"], keep=["c"]).withColumn("ratio", F.col("c_a") / F.col("c_b"))
    return found.withColumn("fraction", simple_fraction(F.col("ratio"))).filter("fraction is not null").select("id_a", "id_b", "c_a", "c_b", "fraction").distinct()


@query(
    known(
        "topic varchar, symbol varchar, at varchar, n_groups bigint, n_behaviours bigint, n_diverging bigint, significance double",
        ('area', 'A', '0', 3, 2, 2, 0.8),
        ('area', 'A', 'oo', 3, 1, 3, 0.7),
        ('area', 'G', '0', 3, 1, 3, 0.7),
        ('area', 'G', 'oo', 3, 2, 2, 0.8),
        ('growth', 'x', '0', 4, 3, 1, 0.8),
        ('growth', 'x', 'oo', 4, 2, 3, 0.8),
        ('growth', 'y', '0', 4, 2, 0, 0.8),
        ('growth', 'y', 'oo', 4, 1, 4, 0.7),
    )
)
def limit_disagreement(spark: SparkSession, d: str) -> DataFrame:
    """Per topic, symbol and limit: where groups differ (0.8), and where two or more diverge (0.7)."""

    def behaviours(text: str) -> list[str]:
        e = E.parse(text)
        found = [(s, at, E.limit_behaviour(text, s, at)) for s in (E.symbols(e) if e is not None else ()) for at in ("0", "oo", "1")]
        return [f"{s}|{at}|{b}" for s, at, b in found if b]

    each = formulas(spark).select("grp", "topic", F.explode(E.udf(behaviours, "array<string>")(F.col("expr"))).alias("x")).withColumn("p", F.split("x", r"\|"))
    rows = each.select("grp", "topic", F.col("p")[0].alias("symbol"), F.col("p")[1].alias("at"), F.col("p")[2].alias("behaviour"))
    out = rows.groupBy("topic", "symbol", "at").agg(F.countDistinct("grp").alias("n_groups"), F.countDistinct("behaviour").alias("n_behaviours"), F.countDistinct(F.when(F.col("behaviour") == "diverges", F.col("grp"))).alias("n_diverging"))
    return out.filter("n_groups >= 2 and (n_behaviours > 1 or n_diverging >= 2)").withColumn("significance", F.when(F.col("n_behaviours") > 1, 0.8).otherwise(0.7))


SUBSTITUTED = [(1, "a", "t", "kappa**2*x"), (2, "b", "t", "16*pi*G*x"), (3, "c", "t", "l_P**2*y"), (4, "a", "t", "G*y"), (5, "b", "u", "alpha_prime*x"), (6, "c", "u", "l_s**2*x"), (7, "a", "u", "x*l_s**2"), (8, "a", "v", "a*b + c*d + 1"), (9, "b", "v", "a*b + c*d"), (10, "c", "v", "broken (")]


@query(known("id_a int, id_b int, way varchar, significance double", (1, 2, "kappa_to_G", 0.85), (3, 4, "l_P_to_G", 0.85), (5, 6, "alpha_to_l_s", 0.85), (5, 7, "alpha_to_l_s", 0.85), (6, 7, "equal", 0.9), (8, 9, "near", 0.7)))
def substitution_matches(spark: SparkSession, d: str) -> DataFrame:
    """Pairs within a topic that are equal, equal once constants of one are written in the other's, or nearly so."""
    rows = spark.createDataFrame(SUBSTITUTED, "id int, grp string, topic string, expr string")
    found = pairs.cross_group_pairs(rows, "id", "grp", ["topic"], keep=["expr"])
    level = E.udf(lambda a, b: [{"way": w, "significance": s} for w, s in E.substitution_levels(a, b)], "array<struct<way:string,significance:double>>")
    return found.select("id_a", "id_b", F.explode(level(F.col("expr_a"), F.col("expr_b"))).alias("x")).select("id_a", "id_b", "x.*")


@query(
    known(
        "id_a int, id_b int, algebraic boolean, numerical boolean, counterexample boolean, status varchar",
        (1, 10, None, None, None, 'inconclusive'),
        (1, 2, True, True, False, 'verified'),
        (1, 3, None, False, True, 'disproved'),
        (1, 4, None, False, True, 'disproved'),
        (11, 12, None, False, True, 'disproved'),
        (2, 10, None, None, None, 'inconclusive'),
        (2, 3, None, False, True, 'disproved'),
        (3, 10, None, None, None, 'inconclusive'),
        (3, 4, True, True, False, 'verified'),
        (4, 10, None, None, None, 'inconclusive'),
        (5, 6, True, True, False, 'verified'),
        (5, 7, None, False, True, 'disproved'),
        (5, 8, None, False, True, 'disproved'),
        (6, 7, None, False, True, 'disproved'),
        (6, 8, None, False, True, 'disproved'),
        (6, 9, None, False, True, 'disproved'),
        (7, 8, None, False, True, 'disproved'),
        (7, 9, None, False, True, 'disproved'),
        (8, 9, True, True, False, 'verified'),
    )
)
def verification(spark: SparkSession, d: str) -> DataFrame:
    """Algebraic and numerical verification and counterexamples of pairs, and the verdict."""
    found = pairs.cross_group_pairs(formulas(spark), "id", "grp", ["topic"], keep=["expr"])
    a, b = F.col("expr_a"), F.col("expr_b")
    flags = found.select("id_a", "id_b", E.udf(E.verified, "boolean")(a, b).alias("algebraic"), E.udf(E.numerically_verified, "boolean")(a, b).alias("numerical"), E.udf(E.counterexample, "boolean")(a, b).alias("counterexample"))
    none = F.lit(None).cast("boolean")
    return flags.withColumn("status", ranking.status(F.col("algebraic"), F.col("numerical"), none, F.col("counterexample"), none))


@query(
    known(
        "id int, leader int, tier varchar",
        (1, 1, 'exact'),
        (2, 1, 'exact'),
        (3, 3, 'structural'),
        (4, 3, 'structural'),
        (5, 5, 'structural'),
        (6, 5, 'structural'),
        (8, 8, 'structural'),
        (9, 8, 'structural'),
    )
)
def duplicate_tiers(spark: SparkSession, d: str) -> DataFrame:
    return clusters.duplicate_tiers(formulas(spark), "topic", "id", "expr")


def embedding(spark: SparkSession) -> DataFrame:
    """(id, scaled): structure, fingerprint and engineered features of expressions, standardised: 84 numbers."""
    from evidentia.operators.vectors import standardised

    zero, e = (lambda n: F.array_repeat(F.lit(0.0), n)), F.col("expr")
    vec = F.concat(F.coalesce(E.udf(E.features, "array<double>")(e), zero(14)), F.coalesce(E.udf(E.fingerprint, "array<double>")(e), zero(50)), E.engineered(F.col("slug"), F.col("topic"), e, F.col("confidence")))
    rows = formulas(spark).withColumn("slug", F.get(F.array(*(F.lit(f[0]) for f in FRAMEWORKS)), F.col("id") % 8)).withColumn("confidence", F.lit(0.5) + F.col("id") / 100)
    return standardised(rows.withColumn("v", vec), "id", "v")


@query("select unnest(range(0, 84))::int as pos, 12::bigint as n, true as centred, true as scaled")
def expression_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Of each of the embedding's 84 numbers: over how many expressions it stands, and whether its mean is zero and its deviation one, or zero where it is constant."""
    each = embedding(spark).select("id", F.posexplode("scaled").alias("pos", "x"))
    out = each.groupBy("pos").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    near = lambda c, x: F.abs(F.col(c) - x) < 1e-9
    return out.select("pos", "n", near("m", 0).alias("centred"), (near("s", 1) | near("s", 0)).alias("scaled"))


PROFILES = [
    ("p1", True, True, False, False, True, True),
    ("p2", True, False, False, True, False, False),
    ("p3", False, True, True, True, None, False),
    ("p4", True, None, True, False, False, True),
]
ATTRIBUTES = ("diffeo", "lorentz", "foliation", "discrete", "super", "dual")
_ROWS = ", ".join("(" + ", ".join("null::boolean" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower() for x in r) + ")" for r in PROFILES)


@query(
    f"with t(g, {', '.join(ATTRIBUTES)}) as (values {_ROWS}) select a.g as a, b.g as b, ("
    + " + ".join(f"coalesce((a.{c} = b.{c})::int, 0)" for c in ATTRIBUTES)
    + ")::int as agree, ("
    + " + ".join(f"(a.{c} is not null and b.{c} is not null)::int" for c in ATTRIBUTES)
    + ")::int as checked from t a join t b on a.g < b.g"
)
def symmetry_profile(spark: SparkSession, d: str) -> DataFrame:
    """Attributes on which two profiles agree, of those that both state."""
    t = spark.createDataFrame(PROFILES, "g string, " + ", ".join(f"{c} boolean" for c in ATTRIBUTES))
    a, b = (t.select(*(F.col(c).alias(f"{c}_{s}") for c in t.columns)) for s in "ab")
    both = a.join(b, F.col("g_a") < F.col("g_b"))
    known = [F.col(f"{c}_a").isNotNull() & F.col(f"{c}_b").isNotNull() for c in ATTRIBUTES]
    agree = sum((F.coalesce((F.col(f"{c}_a") == F.col(f"{c}_b")).cast("int"), F.lit(0)) for c in ATTRIBUTES), F.lit(0))
    return both.select(F.col("g_a").alias("a"), F.col("g_b").alias("b"), agree.alias("agree"), sum((k.cast("int") for k in known), F.lit(0)).alias("checked"))


RULES = [("lorentz", "kept by one", 0.9), ("lorentz", "kept by both", 0.7), ("discrete", "both", 0.8), ("foliation", "both", 0.8), ("dual", "one only", 0.6)]


@query(f"""
with t(g, {', '.join(ATTRIBUTES)}) as (values {_ROWS}), p as (select a.g as a, b.g as b, coalesce(a.lorentz, false) as la, coalesce(b.lorentz, false) as lb, coalesce(a.discrete, false) as da, coalesce(b.discrete, false) as db,
 coalesce(a.foliation, false) as fa, coalesce(b.foliation, false) as fb, coalesce(a.dual, false) as ua, coalesce(b.dual, false) as ub from t a join t b on a.g <> b.g)
select a, b, 'lorentz' as symmetry, 'kept by one' as rule, 0.9::double as significance from p where la and not lb union all select a, b, 'lorentz', 'kept by both', 0.7 from p where la and lb and a < b
union all select a, b, 'discrete', 'both', 0.8 from p where da and db and a < b union all select a, b, 'foliation', 'both', 0.8 from p where fa and fb and a < b union all select a, b, 'dual', 'one only', 0.6 from p where ua and not ub
""")
def symmetry_implications(spark: SparkSession, d: str) -> DataFrame:
    """What shared and broken symmetries imply; rules about one side hold in either direction."""
    t = spark.createDataFrame(PROFILES, "g string, " + ", ".join(f"{c} boolean" for c in ATTRIBUTES)).fillna(False)
    a, b = (t.select(*(F.col(c).alias(f"{c}_{s}") for c in t.columns)) for s in "ab")
    both = a.join(b, F.col("g_a") != F.col("g_b"))
    first = F.col("g_a") < F.col("g_b")

    def test(rule: tuple[str, str, float]) -> DataFrame:
        x, y = F.col(f"{rule[0]}_a"), F.col(f"{rule[0]}_b")
        when = x & ~y if "one" in rule[1] else x & y & first
        return both.filter(when).select(F.col("g_a").alias("a"), F.col("g_b").alias("b"), F.lit(rule[0]).alias("symmetry"), F.lit(rule[1]).alias("rule"), F.lit(rule[2]).alias("significance"))

    out = test(RULES[0])
    for rule in RULES[1:]:
        out = out.unionByName(test(rule))
    return out
