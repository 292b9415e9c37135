import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.functions import latex, text as X
from evidentia.operators import clusters, comparison, enrich, evidence, graphs, ranking, regression, reports, scans, semantic, sinks, symptoms, vectors
from evidentia.schema import DDL, empty
from evidentia.sources import landed, literals
from evidentia.streaming.incremental import Checkpoints, PhaseLog, run_phases, stream_keep_first, windowed_counts

from .conftest import SF


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_schemas(spark):
    for name in DDL:
        assert empty(spark, name).count() == 0


def test_round_trip_of_a_base(spark):
    paper = spark.createDataFrame([(1, "x1", "t", ["a"], 2020, "abs", ["g"], 0, False, 1, "")], empty(spark, "papers").schema)
    formula = spark.createDataFrame([("G", "q", "e=1"), ("G", "q", "e=1")], "g string, q string, latex string").withColumn("h", scans.content_hash(F.col("g"), F.col("q"), F.col("latex")))
    new = scans.upsert_keep_first(formula.limit(0), formula, "h", ["latex"])
    assert rows(scans.counts(papers=paper, formulas=new)) == [("formulas", 1), ("papers", 1)]
    assert scans.upsert_keep_first(new, formula, "h", ["latex"]).count() == 0
    assert scans.lookup(paper, "arxiv_id", "x1").count() == 1


def test_predicates(spark):
    df = spark.createDataFrame([(1, "", "raw"), (2, None, "raw"), (3, "n", "raw")], "id int, a string, b string")
    assert [r.x for r in df.orderBy("id").select(scans.first_filled(F.col("a"), F.col("b")).alias("x")).collect()] == ["raw", "raw", "n"]
    assert scans.scan_where(df).count() == 3 and scans.scan_where(df, equal={"a": "n"}, least={"id": 4}).count() == 0
    assert df.select(scans.base_id(F.lit("hep-th/9901v2"))).first()[0] == "hep-th/9901"
    t = df.limit(1).select(scans.tag_by_keywords(F.lit(None).cast("string"), {"x": ["y"]}), scans.vetoed(F.lit("a b"), [["a", "b"], ["z"]])).first()
    assert (t[0], t[1]) == (["unclassified"], True)


def test_consensus_cases(spark):
    df = spark.createDataFrame([("t", "a", 1.0), ("t", "b", 1.05), ("t", "c", 1.0), ("u", "a", 1.0), ("u", "b", 2.0), ("z", "a", 0.0), ("z", "b", None)], "t string, g string, v double")
    got = {r.t: r for r in evidence.consensus(df, "t", "g", "v").collect()}
    assert got["t"].universal and (got["u"].n_agree, got["u"].n_disagree) == (0, 2) and got["z"].rel_spread is None
    table = {r.t: r for r in evidence.comparison_table(df.withColumn("i", F.monotonically_increasing_id()), "t", "g", "v", "i").collect()}
    assert table["t"].universal and table["z"].spread is None and table["z"].n_agree == 0


def test_lattice_order():
    import itertools

    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    cases = list(itertools.product([True, False, None], repeat=5))
    df = spark.createDataFrame(cases, "a boolean, b boolean, c boolean, e boolean, n boolean")

    def want(a, b, c, e, n):
        if e or False in (a, b, c):
            return "disproved"
        if n is False:
            return "known"
        return "verified" if a or b or (c and n) else "inconclusive"

    for r in df.withColumn("s", ranking.status(*(F.col(x) for x in "abcen"))).collect():
        assert r.s == want(r.a, r.b, r.c, r.e, r.n)


def test_weighted_mean_skips_nulls(spark):
    df = spark.createDataFrame([(1.0, None), (None, None)], "a double, b double")
    got = [r[0] for r in df.select(ranking.weighted_mean({"structural": F.col("a"), "numerical": F.col("b")})).collect()]
    assert got == [1.0, 0.0]


def test_text_functions(spark):
    one = spark.range(1)
    assert one.select(X.content_words(F.lit("The quick_brown fox is on it"))).first()[0] == ["quick_brown", "fox"]
    assert one.select(X.simple_fraction(F.lit(0.75)), X.simple_fraction(F.lit(0.1234567)), X.simple_fraction(F.lit(-2.0))).first()[:] == ("3/4", None, "-2")
    assert one.select(X.best_label(F.lit("gauge gravity"), [("a", ["drop"]), ("b", ["gauge", "gravity"])])).first()[0].label == "b"
    assert one.select(X.overlap(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))).first()[0] == 1.0
    assert one.select(X.json_list(F.lit("broken")), X.json_list(F.lit('["x"]'))).first()[:] == ([], ["x"])
    assert X.balanced_json('x {"a": "}"} y') == '{"a": "}"}' and X.balanced_json("[1, {") is None and X.balanced_json(None) is None


def test_latex_places():
    text = "\\section{A}x\\begin{equation*}\\label{l} a=b \\end{equation*}\\subsection{B}\\[ c=d \\] $$ a=b $$"
    got = latex.parse_equations(text)
    assert [(e["latex"], e["environment"], e["label"], e["section"]) for e in got] == [("a=b", "equation*", "l", "A"), ("c=d", "displaymath", "", "B")]


def test_tex_sources(spark, tmp_path):
    project = tmp_path / "p1"
    project.mkdir()
    (project / "main.tex").write_text("\\begin{document}a \\input{part} b \\include{gone}\\end{document}")
    (project / "part.tex").write_text("inner " * 30)
    (tmp_path / "run.env").write_text("# c\nA=1\nB = 'x=y'\n\n")
    files = landed.tex_files(spark, str(tmp_path))
    main = landed.main_files(files)
    assert [r.name for r in main.collect()] == ["main"]
    assert landed.include_once(main, files).first().text == "\\begin{document}a " + "inner " * 30 + " b \\end{document}"
    assert rows(landed.settings(spark, str(tmp_path / "run.env"))) == [("A", "1"), ("B", "x=y")]
    (tmp_path / "papers.json").write_text(json.dumps({"arxiv_id": "1", "title": "loop and string", "year": 2001}) + "\n")
    papers = landed.papers(spark, str(tmp_path / "papers.json"))
    assert landed.tiered({1: papers, 2: papers, 3: papers}, recent={3: 2010}).select("tier").collect()[0].tier == 1
    assert landed.bridges(papers, "title", {"l": ["loop"], "s": ["string"]}).count() == 1


def test_graphs(spark):
    nodes = spark.createDataFrame([(i,) for i in range(4)], "n int")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (0, 2)], "src int, dst int")
    ranks = {r.n: r["rank"] for r in graphs.pagerank(nodes, edges, "n", rounds=60).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and ranks[3] < ranks[1] < ranks[2]
    path = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "src int, dst int")
    assert {r.component for r in graphs.components(path).collect()} == {0, 100}


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 1), (3, [0.0, 3.0], 0), (4, [0.0, 0.0], 1)], "id int, v array<double>, g int")
    assert rows(vectors.similar_pairs(df, "id", "v", 0.9)) == [(1, 2, 1.0)] and vectors.similar_pairs(df, "id", "v", 0.9, group="g").count() == 1
    assert [r.id for r in vectors.top_similar(df, [1.0, 0.0], "id", "v", 2).collect()] == [1, 2]
    scaled = vectors.standardised(df.withColumn("v", F.array(F.lit(5.0), F.col("id").cast("double"))), "id", "v").orderBy("id").collect()
    assert scaled[0].scaled[0] == 0.0 and abs(scaled[0].scaled[1] + 1.3416407865) < 1e-9


def test_clusters(spark):
    df = spark.createDataFrame([(1, "t", "ab"), (2, "t", "abc"), (3, "t", "zz"), (4, "u", "ab")], "id int, b string, x string")
    assert rows(clusters.leader_clusters(df, "b", "id", "x", lambda a, b: a[0] == b[0])) == [(1, 1), (2, 1), (3, 3), (4, 4)]
    points = spark.createDataFrame([(i, "t", [float(x), 0.0]) for i, x in enumerate([0, 0.1, 0.2, 5, 5.1, 5.2, 20])], "id int, b string, v array<double>")
    assert dict(rows(clusters.density_clusters(points, "b", "id", "v", cut=0.5))) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: -1}


def dense(points, cut, min_size=3, min_samples=2):
    """Clusters of one block by brute force."""
    ids, x = [i for i, _ in points], np.array([v for _, v in points])
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(far, 1)[:, min(min_samples, len(x) - 1)]
    near = np.maximum(far, np.maximum(core[:, None], core[None])) <= cut
    out, left = [], set(range(len(x)))
    while left:
        group = todo = {left.pop()}
        while todo:
            todo = {j for i in todo for j in np.flatnonzero(near[i]).tolist()} & left
            left -= todo
            group = group | todo
        out += [(ids[i], min(ids[j] for j in group) if len(group) >= min_size else -1) for i in group]
    return out


@pytest.mark.parametrize("tile", [5, 40, 2048])
def test_density_clusters_by_tiles(spark, tile):
    rng = np.random.default_rng(4)
    # The two blocks share ids.
    blocks = {b: [(i, v) for i, v in enumerate(rng.uniform(0, 1, (n, 2)).tolist())] for b, n in (("t", 90), (None, 60), ("u", 2), ("w", 1))}
    df = spark.createDataFrame([(i, b, v) for b, points in blocks.items() for i, v in points], "id int, b string, v array<double>")
    got = rows(clusters.density_clusters(df, "b", "id", "v", cut=0.09, tile=tile))
    want = [r for points in blocks.values() for r in dense(points, 0.09)]
    assert got == sorted(want, key=str)
    assert len({c for _, c in want}) > 5 and (0, -1) in want


def test_agreement_of_distant_groups_and_outliers(spark):
    df = spark.createDataFrame([(1, 1, "a", "t"), (2, 1, "b", "t"), (3, 1, "b", "t"), (4, 2, "a", "t"), (5, 2, "c", "t"), (6, -1, "a", "t"), (7, -1, "b", "other"), (8, None, "b", None)], "id int, c int, g string, topic string")
    assert rows(clusters.unexpected_agreement(df, "c", "g", [("b", "a"), ("b", "c")])) == [(1, "b", "a", 0.8)]
    assert rows(clusters.outliers(df.select("id", "topic"), df, "id", "c", "topic")) == [(6, "t", 0.5), (8, None, 0.5)]


def test_models_take_whole_tables(spark, tmp_path):
    from evidentia.plans import models

    rng = np.random.default_rng(5)
    vectors_ = [(i, (rng.normal(0, 0.05, 4) + (i % 7)).tolist(), i % 2) for i in range(0, 1400, 10)]
    spark.createDataFrame(vectors_, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(r.vec_id for r in models.density_clusters(spark, str(tmp_path)).collect()) == list(range(0, 1400, 10))
    users = models.table(spark, SF, "events").select("user_id").distinct().count()
    assert users > 60 and models.leave_one_out(spark, SF).first().n == users


def test_symptoms(spark):
    claims = spark.createDataFrame([("a", "b", "agrees"), ("a", "c", "differs")], "a string, b string, kind string")
    conjectures = spark.createDataFrame([("t", "duality", "verified", ["a", "b"], True, None, True), ("u", "duality", "disproved", ["a", "b"], None, None, None), ("v", "mapping", "open", ["a"], None, None, None)], "title string, kind string, status string, groups array<string>, algebraic boolean, numerical boolean, dimensional boolean")
    assert [(r.subject, r.confidence) for r in symptoms.dual_descriptions(claims, conjectures).orderBy("subject").collect()] == [("a|b", 0.75), ("t", 0.8)]
    drops = symptoms.random_drops(spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a"])], "k int, s array<string>"), "k", "s", 3)
    assert drops.count() == 3 and all(1 <= len(r.s) <= 2 for r in drops.collect()) and rows(drops) == rows(drops)


def test_enrichment_replays(spark):
    df = spark.createDataFrame([(1, "one"), (2, "two"), (3, "two")], "id int, t string")
    asked = enrich.prompts(df, "id", "extract", F.concat(F.lit("say "), "t"))
    cache = empty(spark, "response_cache")
    new = enrich.ask(asked, cache, lambda phase, prompt: '```json\n{"items": [{"a": "%s"}]}\n```' % prompt if "two" in prompt else "no json").cache()
    assert new.count() == 2 and enrich.ask(asked, new, lambda *_: "never").count() == 0
    assert rows(enrich.parsed(enrich.answered(asked, new), "id", "a string")) == [(2, "say two"), (3, "say two")]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", 2.0), ("b", 3.0)], "t string, s double")
    out = sinks.report("R", [sinks.section(df, "Top", F.format_string("- %s", "t"), [F.desc("s")], 1)])
    assert out == "# R\n\n## Top\n\n- b\n"
    assert sinks.graph_json(df, df).count() == 4
    sinks.append(df, str(tmp_path / "t"), ["t"])
    assert os.path.isdir(tmp_path / "t" / "t=a")
    assert "\\section{I}" in sinks.latex_document("T", ["A"], "abs", [("I", "x")])


def test_phase_log(spark, tmp_path):
    log = PhaseLog(spark, str(tmp_path / "log"), ["ingest", "extract"])
    log.set("ingest", "running")
    assert log.next() == "ingest"
    log.set("ingest", "completed")
    assert log.next() == "extract"
    log.set("extract", "completed")
    assert log.next() is None


def test_streams_keep_first(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in ([(1, "a"), (1, "b"), (2, "c")], [(2, "d"), (3, "e")]):
        spark.createDataFrame(batch, "k int, v string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("k int, v string").parquet(source)
        stream_keep_first(stream, target, "k", str(tmp_path / "cp"), ["v"]).awaitTermination()
    assert rows(spark.read.parquet(target)) == [(1, "a"), (2, "c"), (3, "e")]


def test_windowed_counts(spark, tmp_path):
    path = str(tmp_path / "e")
    spark.sql("select timestamp'2024-01-01 00:00:10' as ts, 'a' as k union all select timestamp'2024-01-01 00:00:50', 'a' union all select timestamp'2024-01-01 00:07:00', 'b'").write.parquet(path)
    stream = windowed_counts(spark.readStream.schema("ts timestamp, k string").parquet(path), "ts", "k", "5 minutes", "1 minute")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("windowed").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.k, r.n) for r in spark.sql("select k, n from windowed").collect()) == [("a", 2), ("b", 1)]


@pytest.mark.parametrize("name", ["bench", "__spark_entry__"])
def test_top_modules_import(name):
    __import__(name)


def test_phases_resume(spark, tmp_path):
    log, ran = PhaseLog(spark, str(tmp_path / "log"), ["ingest_tier1", "extract", "compare"]), []
    steps = {p: lambda p=p: ran.append(p) for p in log.phases}

    def fails():
        raise ValueError("no")

    with pytest.raises(ValueError, match="no"):
        run_phases(log, steps | {"extract": fails})
    assert run_phases(log, steps) == ["extract", "compare"] and run_phases(log, steps) == ["compare"]
    assert ran == ["ingest_tier1", "extract", "compare", "compare"]


def test_checkpoints(spark, tmp_path):
    points = Checkpoints(spark, str(tmp_path / "c"))
    assert points.get("a") is None and points.get("a", "none") == "none"
    points.set("a", "1")
    points.set("a", "2")
    points.set("b", "3")
    assert (points.get("a"), points.get("b"), points.get("c")) == ("2", "3", None)


def test_models_are_tried_and_routed(spark):
    waits, tries = [], []

    def rude(phase, prompt):
        tries.append(prompt)
        if len(tries) < 4:
            raise OSError
        return "ok"

    assert enrich.patient(rude, sleep=waits.append)("p", "x") == "ok" and waits == [5.0, 10.0, 20.0]
    assert enrich.patient(lambda *_: 1 / 0, tries=2, sleep=lambda _: None)("p", "x") is None
    models = {"a": lambda p, t: "a", "b": lambda p, t: "b"}
    route = enrich.routed(models, {"x": ["z", "b"]}, "a")
    assert (route("x", ""), route("y", "")) == ("b", "a") and enrich.routed(models, {}, "none")("x", "") == "a"
    asked = enrich.prompts(spark.createDataFrame([(1, "good"), (2, "bad")], "id int, t string"), "id", "e", F.col("t"))
    model = enrich.patient(lambda phase, prompt: prompt if prompt == "good" else 1 / 0, tries=1)
    assert [r.response_text for r in enrich.ask(asked, empty(spark, "response_cache"), model).collect()] == ["good"]


def test_prompts(spark):
    papers = spark.createDataFrame([(1, "T", 2020, "a" * 200), (2, None, None, None)], "id int, title string, year int, content string")
    got = {r.id: r.prompt for r in enrich.extraction_prompts(papers, most=90).collect()}
    assert "of T (2020)" in got[1] and "a" * 31 not in got[1] and "[...]" in got[1] and "of  ()" in got[2]
    premises = spark.createDataFrame([("x", f"p{i}", float(i)) for i in range(30)] + [("y", "q", 1.0)], "g string, t string, s double")
    (pair,) = enrich.contradiction_prompts(premises, "g", "t", "s").collect()
    assert pair.pair == "x|y" and pair.prompt.count("\n- p") == 20 and "- p29\n" in pair.prompt and "p9\n" not in pair.prompt
    found = spark.createDataFrame([(1, i) for i in range(5)] + [(2, 9)], "k int, v int")
    assert rows(enrich.first_of_each(found, "k", ["v"])) == [(1, 0), (1, 1), (1, 2), (2, 9)]
    assert rows(enrich.numbered_sections(found, "k", "v", ["v"])) == [(1, "1. 0\n2. 1\n3. 2\n4. 3\n5. 4"), (2, "1. 9")]


def test_run_report(spark):
    formulas = spark.createDataFrame([("a",), ("a",), ("b",)], "theory_slug string")
    conjectures = spark.createDataFrame([("one", "says", "verified", 0.9, "mapping"), ("two", None, "known", 0.5, "universality"), ("three", None, "odd", 0.7, "x")], "title string, statement_natural string, status string, combined_score double, conjecture_type string")
    out = reports.run_report({"papers": 2, "formulas": 3}, formulas, conjectures)
    assert "- papers: 2\n- formulas: 3" in out and "- a: 2\n- b: 1" in out and "- one: says" in out and "- two" in out
    assert out.index("[✓] one (score=0.90, status=verified)") < out.index("[?] three") < out.index("[●] two")
    assert [r.title for r in reports.convergent(conjectures).orderBy("title").collect()] == ["one", "two"]


def test_premise_and_breakthrough_reports(spark):
    make = lambda cells, schema: spark.createDataFrame(cells, schema)
    out = reports.premise_report(
        make([("one", "universality", "open")], "title string, conjecture_type string, status string"),
        make([("Space is smooth ", "a"), ("space is smooth", "b"), ("alone", "a")], "assumption_text string, theory_slug string"),
        make([("drop it", 0.4), ("turn it", 0.6)], "proposed_shift string, score double"),
        make([("clash", "major")], "description string, severity string"),
        make([("no data", "x")], "description string, k string"),
        top=1,
        narrative="The end.",
    )
    assert "- space is smooth (2 frameworks)" in out and "- turn it (0.60)" in out and "drop it" not in out and "- [major] clash" in out and out.endswith("The end.\n")
    out = reports.breakthrough_report(
        make([("A",), ("A",)], "symptom_type string"), make([("light", 1905, 0.8)], "field string, year int, similarity double"), make([("X", 0.7)], "error string, probability double"),
        make([("area",)], "topic string"), make([("turn it", 0.6)], "proposed_shift string, score double"), 0.5, 20,
    )
    assert "- A: 2" in out and "- light (1905): 0.80" in out and "- X: 0.70" in out and "- records: 20" in out


def test_console_and_investigations(spark, tmp_path):
    df = spark.createDataFrame([(1, "x" * 60, 0.25), (2, None, None)], "id int, t string, s double")
    assert reports.console_table(df, ["id"], width=5).splitlines() == ["id | t     | s", "---+-------+-----", "1  | xxxxx | 0.25", "2  |       |"]
    reports.investigation_json(df, str(tmp_path / "i"))
    assert spark.read.json(str(tmp_path / "i")).count() == 2
    assert reports.investigation_text({"b": 1, "a": "é"}) == '{"a": "é", "b": 1}'


def test_a_failing_detector_leaves_the_rest(spark):
    good = lambda: symptoms.facts(spark.range(1), "NULL_RESULT", [("x", 0.5)])
    found, failed = symptoms.detected(spark, {"good": good, "bad": lambda: spark.range(1).select("nowhere"), "also": good})
    assert found.count() == 2 and set(failed) == {"bad"}


def test_obstacles_of_droppable_premises(spark):
    df = spark.createDataFrame([("a", "open", 0.9, "x"), ("b", "verified", 0.95, "y"), ("c", None, 0.4, None), ("d", "open", 0.2, "z")], "t string, st string, s double, w string")
    found = comparison.droppable(df, "t", "st", "s")
    assert [r.t for r in found.collect()] == ["a", "c"]
    assert [r.what_it_might_mean for r in comparison.obstacles_of(found, "t", "s", "w").collect()] == ["Droppability: 0.90. x", "Droppability: 0.40. "]


def test_semantic_vectors(spark):
    df = spark.createDataFrame([(1, "area of the horizon"), (2, "the horizon area of"), (3, "nothing alike here"), (4, "12 !")], "id long, t string")
    vectors_ = {r.id: np.array(r.vector) for r in semantic.word_vectors(df, "id", "t").collect()}
    assert set(vectors_) == {1, 2, 3} and all(abs((v * v).sum() - 1) < 1e-12 for v in vectors_.values())
    assert [(r.id_a, r.id_b) for r in semantic.like_each_other(df, "id", "t", 0.99).collect()] == [(1, 2)]


@pytest.mark.parametrize("block", [7, 1000])
def test_pairs_by_blocks(spark, block):
    rng = np.random.default_rng(3)
    vs = rng.normal(size=(60, 6))
    vs[5] = 0
    data = [(i, v.tolist(), i % 3) for i, v in enumerate(vs)] + [(60, None, 0), (61, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0], 0), (62, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1)]
    df = spark.createDataFrame(data, "id long, v array<double>, g int")
    unit = vs / np.maximum(np.linalg.norm(vs, axis=1, keepdims=True), 1e-300)
    cos = unit @ unit.T
    want = sorted((i, j) for i in range(60) for j in range(i + 1, 60) if 5 not in (i, j) and 0.5 <= cos[i, j] < 0.9 and i % 3 != j % 3)
    got = vectors.similar_pairs(df, "id", "v", 0.5, 0.9, "g", block=block).collect()
    assert sorted((r.id_a, r.id_b) for r in got) == want and all(abs(r.cosine - cos[r.id_a, r.id_b]) < 1e-12 for r in got)
    near = vectors.nearest_profiles(df.filter("id < 20"), df.withColumnRenamed("id", "o"), "id", "o", "v", 4, not_itself=True, block=block).collect()
    for i in range(20):
        order = sorted((j for j in range(60) if j not in (i, 5)), key=lambda j: (-round(cos[i, j], 9), j))[:4]
        assert [r.o for r in sorted((r for r in near if r.id == i), key=lambda r: r["rank"])] == (order if i != 5 else [])
    assert vectors.similar_pairs(df.limit(0), "id", "v", 0.5).count() == 0


def test_forest_left_out_one_by_one(spark):
    data = [(i, [float(i % 2), float(i)], i % 2) for i in range(6)]
    got = vectors.leave_one_out_forest(spark.createDataFrame(data, "k int, f array<double>, c int"), "k", "f", "c", trees=5).collect()
    assert sorted((r.k, r.c) for r in got) == [(i, i % 2) for i in range(6)] and all(r.predicted in (0, 1) for r in got)


def test_gaps_of_many_groups(spark, monkeypatch):
    monkeypatch.setattr(evidence, "GROUPS", 2)
    df = spark.createDataFrame([("t", g) for g in "abcde"] + [("u", "b"), ("u", "e"), ("v", "a")], "t string, g string")
    assert rows(evidence.coverage_gaps(df, "t", "g")) == [("u", "2/5", "a,c,d"), ("v", "1/5", "b,c,d,e")]


def test_components_of_texts(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("z", "z")], "src string, dst string")
    assert rows(graphs.components(edges)) == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x"), ("z", "z")]


def test_literal_tables(spark):
    assert [literals.frameworks(spark).count(), literals.symmetries(spark).count(), literals.connections(spark).count(), literals.turning_points(spark).count()] == [8, 8, 14, 15]
    assert set(symptoms.ERROR_TYPES) >= {r.error for r in literals.records(spark).unionByName(literals.open_problems(spark)).select("error").distinct().collect()}
    slugs = {f[0] for f in literals.FRAMEWORKS}
    assert all(set(f) <= slugs and t in literals.TOPICS for f, t, _, _ in literals.CONNECTIONS) and {s[0] for s in literals.SYMMETRIES} == slugs


def test_command_line(spark, tmp_path, capsys):
    from evidentia.__main__ import VIEWS, main
    from evidentia.plans.catalogue import QUERIES

    assert all(n in QUERIES for names in VIEWS.values() for n in names)
    assert main(["list"]) == 0 and "symptoms_all" in capsys.readouterr().out
    assert main(["sql", "point_lookup"]) == 0 and "c_custkey = 42" in capsys.readouterr().out
    assert main(["run", "point_lookup", "--data", SF]) == 0 and "c_custkey" in capsys.readouterr().out
    assert main(["view", "investigate-top", "--data", SF, "--out", str(tmp_path)]) == 0 and spark.read.parquet(f"{tmp_path}/worth_investigating").count() == 7
    assert main(["run", "nothing", "--data", SF]) == 1
    assert main(["phases", "--log", str(tmp_path / "log"), "--reset"]) == 0 and "next: ingest_tier1" in capsys.readouterr().out


def test_archives_and_pdfs(spark, tmp_path):
    import gzip
    import io
    import tarfile
    import zlib

    def tar(mode, **files):
        held = io.BytesIO()
        with tarfile.open(fileobj=held, mode=mode) as out:
            for name, text in files.items():
                info = tarfile.TarInfo(f"src/{name}.tex")
                info.size = len(text)
                out.addfile(info, io.BytesIO(text.encode()))
        return held.getvalue()

    for name, content in {"one.tar.gz": tar("w:gz", main="A", intro="B"), "two.tar": tar("w", main="C"), "three.gz": gzip.compress(b"D"), "four.gz": b"broken", "five.txt": b"no"}.items():
        (tmp_path / name).write_bytes(content)
    assert rows(landed.tex_archives(spark, str(tmp_path))) == [("one", "intro", "B"), ("one", "main", "A"), ("three", "main", "D"), ("two", "main", "C")]
    page = lambda data, extra=b"": b"<< /Length %d %s >> stream\n%s\nendstream" % (len(data), extra, data)
    first, second = b"BT (Hello \\(you\\)) Tj T* [(wo) -20 (rld)] TJ ET", zlib.compress(b"BT (\\101rea) Tj ET")
    pdf = b"%PDF-1.4\n" + page(first) + page(second, b"/Filter /FlateDecode") + page(b"\xff\xd8", b"/Filter /DCTDecode")
    (tmp_path / "p.pdf").write_bytes(pdf)
    (tmp_path / "q.pdf").write_bytes(b"nothing")
    assert rows(landed.pdf_texts(spark, str(tmp_path))) == [("p", "Hello (you)\nworld\nArea"), ("q", "")]


def test_references_and_hits(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"paper": "a", "references": ["b", "c", "b", "", null, "a"]}\n{"paper": "b", "references": null}\n')
    (tmp_path / "h.json").write_text('{"query": "q", "data": [{"title": "x", "citationCount": 30}, {"title": "y", "citationCount": null}]}\n{"query": "none", "data": []}\n')
    assert rows(landed.references(spark, str(tmp_path / "r.json"))) == [("a", "b"), ("a", "c")]
    assert rows(landed.references(spark, str(tmp_path / "r.json"), 1)) == [("a", "b")]
    assert rows(landed.search_hits(spark, str(tmp_path / "h.json"))) == [("none", 0, 0), ("q", 2, 1)]


def test_symbolic_regression(spark):
    points = spark.createDataFrame([(0.0, 1.0, 3.0), (1.0, 1.0, 1.0), (0.5, 0.0, 7.0), (0.0, 0.0, 2.0), (1.0, 0.0, 5.0)], "a double, b double, c double").withColumn("y", 2 * F.abs(F.col("a") + F.col("b") - 1.6) + 1.4)
    best = regression.symbolic_fit(points, "y", ["a", "b", "c"], [1.6], rounds=3, keep=60).first()
    assert best.loss < 1e-12 and "abs" in best.expr and abs(abs(best.slope) - 2) < 1e-9
    assert regression.symbolic_fit(points, "a", ["a"], rounds=1).first().expr == "a"


def test_drawings(spark):
    df = spark.createDataFrame([(0.0, 1.0, "a<b"), (2.0, 3.0, "c"), (None, 1.0, "c")], "x double, y double, t string")
    svg = reports.scatter_svg(df, "x", "y", "t", size=100)
    assert svg.count("<circle") == 2 and 'cx="20.0" cy="80.0"' in svg and 'cx="80.0" cy="20.0"' in svg and "a&lt;b" in svg
    svg = reports.heatmap_svg(df.dropna(), "t", "y", "x", cell=10)
    assert svg.count("<rect") == 2 and 'width="20" height="20"' in svg
    assert "<circle" not in reports.scatter_svg(df.limit(0), "x", "y", "t")


@pytest.mark.parametrize("tile", [9, 5000])
def test_clusters_that_last(spark, tile):
    rng = np.random.default_rng(5)
    centres = [(0, 0), (10, 0), (10, 1.6), (0, 10)]
    points = [(i, (np.array(centres[i % 4]) + rng.normal(0, 0.15, 2)).tolist(), "one") for i in range(60)]
    points += [(100, [40.0, 40.0], "one"), (200, [0.0, 0.0], "two"), (201, [0.1, 0.0], "two"), (300, [1.0, 1.0], None)]
    df = spark.createDataFrame(points, "id long, v array<double>, b string")
    got = {r.id: r.cluster for r in clusters.stable_clusters(df, "b", "id", "v", 5, 2, tile=tile).collect()}
    assert len(got) == len(points) and all(got[i] == -1 for i in (100, 200, 201, 300))
    for k in range(4):
        own = [got[i] for i in range(k, 60, 4)]
        assert max(set(own), key=own.count) == k and own.count(k) >= 13, (k, own)


def test_gap_rows(spark):
    """More groups than one bitmap has bits; nulls and repeated rows."""
    n = 32_768 + 10
    df = spark.range(n).selectExpr("'a' as t", "id as g").unionAll(spark.createDataFrame([("b", 3), ("b", 3), ("c", None), (None, 4), ("b", n - 1)], "t string, g long"))
    got = evidence.gap_rows(df, "t", "g").groupBy("t").agg(F.count("*").alias("n"), F.count_if(F.col("g").isin(3, n - 1)).alias("m"), F.min("g").alias("low"), F.max("g").alias("high")).collect()
    assert {tuple(r) for r in got} == {("b", n - 2, 0, 0, n - 2), ("c", n, 2, 0, n - 1)}
    assert evidence.gap_rows(df.limit(0), "t", "g").count() == 0


def novel_brute(items, cited):
    best = {}
    for i, p, g, t in items:
        for j, q, h, u in items:
            if t == u and t is not None and i < j and g != h and p is not None and q is not None:
                at, way = (min(p, q), max(p, q)), (-t, i, j)
                best[at] = min(best.get(at, way), way)
    return {(at, way) for at, way in best.items() if at not in cited and at[::-1] not in cited}


@pytest.mark.parametrize("ids", [10_000, 25])
def test_novel_matches_of_a_topic(spark, ids):
    """Equal to all pairs of a topic, also where an item stands in several rows; through both ways."""
    rng = random.Random(ids)
    keys = rng.sample(range(ids), 150) if ids > 150 else [rng.randrange(ids) for _ in range(150)]
    items = [(i, rng.choice([*range(6), None]), rng.choice("abc"), rng.choice([1, 2, None])) for i in keys]
    cited = {(1, 2), (4, 0), (3, 3)}
    df, cites = spark.createDataFrame(items, "id int, paper int, g string, t int"), spark.createDataFrame([*cited], "src int, dst int")
    told = lambda out: {((r.paper_low, r.paper_high), (-r.score, r.id_a, r.id_b)) for r in out.collect()}
    want = novel_brute(items, cited)
    assert told(comparison.novel_topic_matches(df, cites, "id", "paper", "g", ["t"], F.col("t"))) == want and want
    if ids > 150:
        matches = df.alias("a").join(df.alias("b"), "t").filter("a.id < b.id").select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), F.col("t").alias("score"))
        assert told(comparison.novel_matches(matches, df.select("id", "paper", "g"), cites, "id", "paper", "g")) == want


def test_novel_matches_form_few_pairs(spark):
    """One topic of many items: no more of them meet than papers ask for."""
    df = spark.range(20_000).select("id", (F.col("id") % 4).alias("paper"), (F.col("id") % 7).alias("g"), F.lit(1).alias("t"))
    assert comparison.first_items(df, "id", "paper", "g", ["t"]).count() == 8
