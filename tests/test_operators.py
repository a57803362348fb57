"""Operators against small literal fixtures, invariants and hand-solved cases."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.functions import answers, roles, scalars
from spectraloom.operators import descriptors, ledger, literature, records, spectra, study, tables, validation
from spectraloom.operators.descriptors import Spec
from spectraloom.session import numbered, running
from spectraloom.sources import files
from spectraloom.streaming import jobs


def one(spark, column, *values):
    """The column's value for each text of `c`."""
    rows = spark.createDataFrame(list(enumerate(values)), "i int, c string").select("i", column.alias("v")).collect()
    return [r.v for r in sorted(rows)]


def test_scalars(spark):
    assert one(spark, scalars.finite_double("c"), "1d", "1_000", "nan", "inf", " 2.5 ", "", "0x10", None) == [None, None, None, None, 2.5, None, None, None]
    assert one(spark, scalars.normalize_doi("c"), "https://doi.org/10.1038/s41467-024-12345-6.", "DOI: 10.1/x", None) == ["10.1038/s41467-024-12345-6", None, None]
    assert one(spark, scalars.first_integer("c"), "ref 007b", "none") == [7, None]
    assert one(spark, scalars.spectrum_identity("c"), "ro-007-1-o", "NF-1-2")[0] == ("RO", 7, 1, "O")
    assert one(spark, scalars.clean_marker("c"), " N/A ", "—", "0") == [None, None, "0"]
    assert one(spark, scalars.safe_filename("c"), "a/b:c  d.", "...") == ["a_b_c d", "document"]
    assert "sk" not in one(spark, scalars.redacted("c"), "api_key=sk1 x")[0]


def test_longest_json():
    assert answers.first_document('x {"a": 1} tail') == '{"a": 1}'
    assert answers.first_document("[1, 2") is None and answers.first_document(None) is None


@pytest.mark.parametrize(
    "name,role",
    [
        ("制备工艺 | 基膜 | 截留分子量", "preparation"), ("制备工艺 | 水相单体种类", "preparation"), ("分离层/膜结构参数 | MWCO", "structure"), ("分离层/膜结构参数 | Zeta电位mV (pH=7)", "structure"), ("膜性能参数 | R(NaCl)", "performance"),
        ("操作参数 | 浓度（ppm）", "test_condition"), ("XPS参数 | HABD计算", "structure_proxy"), ("XPS参数 | C(%)", "xps"), ("N__point_count", "quality"),
    ],
)
def test_scientific_roles(spark, name, role):
    assert one(spark, roles.scientific_role("c"), name) == [role]


def gaussian(x, mu=400.0, sigma=1.1):
    return np.exp(-((x - mu) ** 2) / (2 * sigma**2))


def summary(spark, grids):
    rows = [(name, float(x), float(y)) for name, (xs, ys) in grids.items() for x, y in zip(xs, ys, strict=True)]
    return {r.spectrum_id: r for r in spectra.summaries(spark.createDataFrame(rows, "spectrum_id string, x double, y double")).collect()}


def test_summaries_do_not_depend_on_the_grid(spark):
    dense = np.linspace(395, 405, 1001)
    uneven = np.concatenate([np.linspace(395, 398, 800), np.linspace(398, 405, 400)[1:]])
    double = np.concatenate([dense, dense[:300]])
    got = summary(
        spark,
        {
            "dense": (dense, gaussian(dense)), "uneven": (uneven, gaussian(uneven)), "double": (double, gaussian(double)), "four": ([1, 2, 3, 4], [1, 2, 3, 4]), "distinct": ([1, 2, 3, 4, 4], [1, 2, 3, 4, 5]),
            "flat": ([1, 2, 3, 4, 5], [2] * 5), "gaps": ([1, 2, float("nan"), 4, 5, 6, 7], [0, 1, 9, float("inf"), 2, 1, 0]),
        },
    )
    a = got["dense"]
    assert abs(a.centroid_eV - 400) < 0.05 and a.spread_eV > 0 and a.energy_q10_eV < a.energy_q50_eV < a.energy_q90_eV
    for c in ("centroid_eV", "spread_eV", "central_80_width_eV", "spectral_entropy"):
        assert abs(a[c] - got["uneven"][c]) < 0.02 and abs(a[c] - got["double"][c]) < 1e-10
    assert abs(a.high_energy_fraction_above_centroid - 0.5) < 0.01 and got["double"].duplicate_energy_points == 300
    assert [got[k].status for k in ("four", "distinct", "flat", "gaps")] == ["failed", "failed", "failed", "usable"]
    assert got["four"].centroid_eV is None and got["gaps"].point_count == 5


def test_cells_keep_source_rows(spark):
    cells = records.cells_of_text(spark.createDataFrame([("b", "s", "Ref,a\n1,2\n\n2,3")], "source string, sheet string, content string"))
    assert sorted((r.row_no, r.value) for r in cells.where("col_no = 0 and row_no > 1").collect()) == [(2, "1"), (4, "2")]
    assert records.header_rows(cells).collect()[0].header_row == 1


def test_descriptors(spark):
    df = spark.createDataFrame([(3.0, 1.0, "NF"), (1.0, 1.0, "RO"), (-2.0, 0.0, "NF")], "a double, b double, dataset string")
    values = lambda s: [r[0] for r in df.select(descriptors.computed(df, s)).collect()]
    assert values(Spec("x1", "normalized_difference", ("a", "b"))) == [0.5, 0.0, -1.0]
    assert values(Spec("x1", "ratio", ("a", "b"))) == [3.0, 1.0, None]
    assert values(Spec("x1", "log_ratio", ("a", "b"))) == [pytest.approx(math.log(3)), 0.0, None]
    assert values(Spec("x1", "difference", ("a", "b"), scope=("NF",), bounds={"a": (0.0, 10.0)})) == [2.0, None, None]
    assert descriptors.problems(Spec("bad name", "ratio", ("a", "b", "c"))) == ["symbol", "arity"]
    kept, manifest = descriptors.materialised(df, [Spec("few", "ratio", ("a", "b"))])
    assert kept.columns == df.columns and manifest.first().reason == "too few finite values"


def test_cohort_flags(spark):
    df = spark.createDataFrame([(0, 1.0, "a", 1.0, 1.0), (1, float("inf"), "b", 1.0, 2.0), (2, 3.0, "", 1.0, 3.0), (3, 4.0, "d", 1.0, None), (4, 5.0, "e", 1.0, 5.0)], "i int, y double, g string, a double, c double")
    flags = validation.flagged(df, "y", "g", ["c"])
    assert [r.i for r in flags.where("eligible").orderBy("i").collect()] == [0, 4]
    report = validation.attrition(flags).first()
    assert (report.bad_target_or_group, report.missing_candidates, report.rows_scored) == (2, 1, 2)
    for wrong in (("y", "g", ["y"], ["c"]), ("y", "g", [], ["c"]), ("y", "g", ["a"], ["a"])):
        with pytest.raises(ValueError):
            validation.check_arguments(df, *wrong)


def test_folds(spark):
    rows = [(g,) for g in range(23) for _ in range(1 + g % 6)]
    df = spark.createDataFrame(rows, "g int")
    for made in (validation.greedy_folds(df, "g", 5), validation.rank_folds(df, "g", 5)):
        assert made.count() == 23 and made.agg(F.sum("rows")).first()[0] == len(rows)
        loads = [r[1] for r in made.groupBy("fold").agg(F.sum("rows")).collect()]
        assert len(loads) == 5 and max(loads) - min(loads) <= 6
        assert validation.overlaps(made, "g").count() == 0
        nested = validation.nested_folds(made, "g", 3)
        assert nested.count() == 23 * 4 and nested.join(made.select("g", F.col("fold").alias("outer")), ["outer", "g"]).count() == 0


def test_linear_solutions():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 2))
    y = 3 * x[:, 0] - 2 * x[:, 1] + 1 + rng.normal(size=60) * 0.1
    held = np.column_stack([np.ones(60), x, y])
    gram = held.T @ held
    centred, target = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(centred.T @ centred + 10 * np.eye(2), centred.T @ target)
    assert np.allclose(validation.ridge(gram, 10.0)[1:], want)
    w = validation.elastic_net(gram, 0.1, 0.5)[1:]
    slope = -centred.T @ (target - centred @ w) / 60 + 0.1 * 0.5 * w
    assert np.allclose(slope, -0.05 * np.sign(w), atol=1e-6)
    assert np.allclose(validation.elastic_net(gram, 1e6, 1.0)[1:], 0)


def test_studies_cover_every_row_once(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(64):
        a, c = rng.normal(size=2)
        rows.append((i, i // 8, float(a), float(c), float(a + 2 * c + 0.1 * rng.normal())))
    df = spark.createDataFrame(rows, "i int, paper int, a double, c double, y double")
    folds = validation.rank_folds(df, "paper", 4)
    made, chosen = validation.linear_study(df, folds, validation.nested_folds(folds, "paper", 2), "paper", ["a", "c"], "y")
    got = made.collect()
    assert sorted(r.i for r in got) == list(range(64)) and len(chosen) == 4
    assert np.mean([(r.y - r.predicted) ** 2 for r in got]) < 0.1
    forest = validation.forest_study(df, folds, "paper", ["a", "c"], "y", trees=5, depth=4).collect()
    assert sorted(r.i for r in forest) == list(range(64)) and np.mean([(r.y - r.predicted) ** 2 for r in forest]) < np.var([r[4] for r in rows])


def test_metrics_edges(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 2.0), ("b", 1.0, 5.0), ("c", 1.0, 3.0), ("c", 2.0, 3.0)], "s string, observed double, predicted double")
    got = {r.s: r for r in validation.metrics(df, ["s"]).collect()}
    assert got["a"].r2 is None and got["b"].r2 is None and got["c"].r2 is not None and all(r.spearman is None for r in got.values())


def test_sign_flip(spark):
    deltas = spark.createDataFrame([(0.1,), (0.2,), (0.3,)], "delta double")
    assert validation.sign_flip(deltas).first().p_value == 1 / 8
    many = spark.createDataFrame([(0.1 + i / 100,) for i in range(16)], "delta double")
    assert validation.sign_flip(many).first().p_value < 0.01 and validation.sign_flip(many).first() == validation.sign_flip(many).first()
    assert validation.sign_flip(deltas.limit(0)).first().p_value is None


def test_ranks_without_one_task(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 3), i) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, v int")
    assert sorted(r.n for r in numbered(df, [F.col("k"), F.col("v")], "n").collect()) == list(range(200))
    for r in running(df.withColumn("w", F.lit(1)), ["k"], ["v"], "w", "before").collect():
        assert r.before == sum(1 for k, v in rows if k == r.k and v < r.v)


def test_top_rows_and_latest(spark):
    df = spark.createDataFrame([(i % 2, i * 7 % 50, i) for i in range(100)], "k int, v int, i int")
    got = tables.top_rows(df, ["k"], [F.desc("v"), F.col("i")], 3).collect()
    for k in (0, 1):
        want = sorted(((-v, i) for kk, v, i in ((j % 2, j * 7 % 50, j) for j in range(100)) if kk == k))[:3]
        assert sorted((r.place, r.i) for r in got if r.k == k) == [(n + 1, i) for n, (_, i) in enumerate(want)]
    assert {r.k: r.i for r in tables.latest(df, ["k"], ["i"]).collect()} == {0: 98, 1: 99}


def test_upsert_is_idempotent(spark):
    schema = "doc_key string, doi string, year int, local_path string, sha256 string, title string, metadata string, status string, reason string, created_at int, updated_at int"
    old = spark.createDataFrame([("k", None, 2000, "/f", None, "T", "m", "parsed", None, 1, 1)], schema)
    new = spark.createDataFrame([("k", 1, "10.1/a", None, None, None, "Untitled", "n", "queued", "r", 5), ("z", 2, None, None, None, None, "Z", "n", "queued", "r", 5)], "doc_key string, seq int, doi string, year int, local_path string, sha256 string, title string, metadata string, status string, reason string, stamp int")
    first = literature.upserted(old, new)
    rows = {r.doc_key: r for r in first.collect()}
    assert (rows["k"].doi, rows["k"].title, rows["k"].status, rows["k"].created_at, rows["k"].metadata) == ("10.1/a", "T", "parsed", 1, "n")
    again = literature.upserted(first, new).select(*first.columns)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, first.collect()))


def test_empty_key_set_selects_nothing(spark):
    docs = spark.createDataFrame([("a", 2001, "t")], "doc_key string, year int, title string")
    queue = spark.createDataFrame([("a", "queued")], "doc_key string, status string")
    assert literature.fetchable(docs, queue, None, 5).count() == 1 and literature.fetchable(docs, queue, queue.limit(0), 5).count() == 0


def test_context_limits(spark):
    turns = [("short", i, "q", "a", "completed") for i in range(23)] + [("long", i, "q", "x" * 35_000, "completed") for i in range(3)] + [("bad", 0, "q", "a", "failed")]
    got = ledger.context(spark.createDataFrame(turns, "conversation_id string, seq int, question string, answer string, status string")).collect()
    short, long = ([r for r in got if r.conversation_id == k] for k in ("short", "long"))
    assert (len(short), min(r.seq for r in short), short[0].omitted) == (20, 3, 3) and (len(long), long[0].omitted) == (2, 1) and len(got) == 22


def test_progress_and_submissions(spark):
    c = F.col
    rows = spark.createDataFrame([(30.0, 12.0, 5.0, 1.0), (0.0, 1.0, None, None), (None, None, 5.0, 9.0)], "a double, b double, c double, d double")
    assert [r[0] for r in rows.select(scalars.progress_ratio((c("a"), c("b")), (c("c"), c("d")))).collect()] == [0.4, None, 1.0]
    made = ledger.submissions(spark.createDataFrame([("r", "o", "p", 1), ("r", "o", "p", 2), ("r", "o", "q", 3)], "request_id string, owner string, payload string, seq int"))
    assert [r.verdict for r in made.orderBy("seq").collect()] == ["accepted", "duplicate", "conflict"]


CHUNKS = [(1, 1, '{"ok":', None), (1, 2, "true}", "stop"), (2, 1, "half", None)]


def chunk_frame(spark):
    rows = [(r, s, c, None, None, None, None, None, f, None, None) for r, s, c, f in CHUNKS]
    return spark.createDataFrame(rows, jobs.CHUNK)


def test_assembled_answers(spark):
    got = {r.request_id: (r.status, r.content) for r in ledger.assembled(chunk_frame(spark)).collect()}
    assert got == {1: ("complete", '{"ok":true}'), 2: ("incomplete", None)}


def test_stream_equals_batch(spark, tmp_path):
    chunk_frame(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(jobs.CHUNK).parquet(str(tmp_path / "in"))
    run = jobs.assemble_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).outputMode("append").start()
    run.awaitTermination()
    got = spark.read.schema(jobs.DONE).parquet(str(tmp_path / "out")).collect()
    batch = jobs.assemble_batch(chunk_frame(spark)).where("status = 'complete'").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch))


def test_files(spark, tmp_path):
    (tmp_path / "NF-N").mkdir()
    (tmp_path / "NF-N" / "NF-1-2-N.csv").write_text("be,counts\n400,1\nx,2\n401,3\n")
    (tmp_path / "NF-N" / "NF-1-3-N.tsv").write_text("400\t5\n")
    points = files.spectrum_points(files.spectra_files(spark, str(tmp_path))).collect()
    assert sorted(map(tuple, points)) == [("NF-1-2-N", 400.0, 1.0), ("NF-1-2-N", 401.0, 3.0), ("NF-1-3-N", 400.0, 5.0)]
    found = files.inventory(spark, str(tmp_path)).collect()
    assert len(found) == 2 and {(r.dataset, r.element) for r in found} == {("NF", "N")} and all(len(r.sha256) == 64 for r in found)
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text('{"task_id": "a", "status": "running"}')
    (tmp_path / "j" / "b.json").write_text("{broken")
    (tmp_path / "j" / "c.json").write_text('{"status": "x"}')
    assert [r.task_id for r in files.journals(spark, str(tmp_path / "j")).collect()] == ["a"]


def test_relationship_studies():
    roles_of = {"m": "preparation", "n": "xps", "d": "xps", "t": "structure", "p": "test_condition", "f": "performance"}
    groups = {"preparation": ["m"], "xps": ["n", "d"]}
    validation.check_study("preparation_xps_to_structure", "t", groups, ["p"], roles_of)
    for task, target, chosen, controls in (("xps_to_structure", "f", {"xps": ["n"]}, []), ("xps_to_structure", "t", {"preparation": ["m"]}, []), ("xps_to_structure", "t", {"xps": ["m"]}, []), ("xps_to_structure", "t", {"xps": ["n", "n"]}, []), ("xps_to_structure", "t", {"xps": ["n"]}, ["m"])):
        with pytest.raises(ValueError):
            validation.check_study(task, target, chosen, controls, roles_of)
    assert validation.feature_sets(groups, ["p"], ["d"]) == {"controls": ["p"], "preparation": ["p", "m"], "xps": ["p", "n", "d"], "combined": ["p", "m", "n", "d"], "measured_only": ["p", "m", "n"]}
    assert validation.feature_sets({"xps": ["n"]}, []) == {"training_mean": [], "xps": ["n"]}


def test_linear_grid_is_the_surveys(spark):
    assert len(validation.LINEAR) == 27 and {c[1] for c in validation.LINEAR if c[0] == "net"} == {0.001, 0.01, 0.1, 1.0, 10.0} and {c[2] for c in validation.LINEAR if c[0] == "net"} == {0.05, 0.25, 0.5, 0.75, 0.95}
    # the true weights are small and the target is noise besides: only the strongest penalty shrinks enough
    rng = np.random.default_rng(3)
    rows = [(i, i // 8, float(rng.normal()), float(rng.normal()), float(rng.normal())) for i in range(64)]
    df = spark.createDataFrame(rows, "i int, paper int, a double, c double, y double")
    folds = validation.rank_folds(df, "paper", 4)
    nested = validation.nested_folds(folds, "paper", 2)
    _, chosen = validation.linear_study(df, folds, nested, "paper", ["a", "c"], "y")
    # brute force over rows
    fold, inner = {r.paper: r.fold for r in folds.collect()}, {(r.outer, r.paper): r.inner for r in nested.collect()}

    def fit(part, c):
        held = np.array([(1.0, *r[2:]) for r in part])
        gram = held.T @ held
        return validation.ridge(gram, c[1]) if c[0] == "ridge" else validation.elastic_net(gram, c[1], c[2])

    for outer, *best, _ in chosen:
        train = [r for r in rows if fold[r[1]] != outer]
        errors = []
        for c in validation.LINEAR:
            each = []
            for k in sorted({inner[outer, r[1]] for r in train}):
                w = fit([r for r in train if inner[outer, r[1]] != k], c)
                test = [r for r in train if inner[outer, r[1]] == k]
                each.append(np.mean([np.mean([abs(r[4] - w @ [1, r[2], r[3]]) for r in test if r[1] == g]) for g in {r[1] for r in test}]))
            errors.append(np.mean(each))
        assert errors[validation.LINEAR.index(tuple(best))] <= min(errors) + 1e-9


def test_forest_chooses_over_inner_folds(spark):
    rng = np.random.default_rng(5)
    # a fine step function: a shallow forest or large leaves can't follow it
    rows = [(i, i % 12, float(x), float(np.sign(np.sin(20 * x)) * 5)) for i, x in enumerate(rng.uniform(0, 3, 360))]
    df = spark.createDataFrame(rows, "i int, paper int, a double, y double")
    folds = validation.rank_folds(df, "paper", 2)
    made = validation.forest_study(df, folds, "paper", ["a"], "y", trees=3, nested=validation.nested_folds(folds, "paper", 2), grid=[(1, 40), (8, 1)]).collect()
    assert sorted(r.i for r in made) == list(range(360)) and {(r.depth, r.leaf) for r in made} == {(8, 1)}
    assert len(validation.FOREST) == 9
    # gaps take the training median, with an indicator that tells them apart
    gone = df.withColumn("a", F.when(F.col("i") % 5 != 0, F.col("a"))).withColumn("y", F.when(F.col("i") % 5 == 0, 50.0).otherwise(F.col("y")))
    made = validation.forest_study(gone, folds, "paper", ["a"], "y", trees=20, depth=6).collect()
    assert len(made) == 360 and all(r.predicted > 25 for r in made if r.a is None)
    with pytest.raises(ValueError, match="no training values"):
        validation.forest_study(df.join(folds.select("paper", "fold"), "paper").withColumn("a", F.when(F.col("fold") == 0, F.col("a"))).drop("fold"), folds, "paper", ["a"], "y", trees=3)


def test_stream_over_batches_equals_batch(spark, tmp_path):
    rows = [
        (1, 3, "c", "r3", None, None, None, None, "stop", None, None), (1, 2, "b", None, 0, None, "f", "{1", None, None, None), (2, 1, "x", None, None, None, None, None, None, 1, 1),
        (1, 1, "a", "r1", 0, "t0", None, None, None, 5, None), (1, 4, None, None, 1, "t1", "g", "{}", None, None, None),
        (1, 5, None, None, 0, None, None, "}", None, 7, 9), (3, 1, "alone", None, None, None, None, None, "stop", None, None),
    ]
    # the finish marker comes in the first batch, earlier fragments and the usage later
    for n, part in enumerate((rows[:3], rows[3:5], rows[5:])):
        spark.createDataFrame(part, jobs.CHUNK).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(jobs.CHUNK).parquet(str(tmp_path / "in"))
        run = jobs.assemble_stream(stream, timeout_ms=3_600_000).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).outputMode("append").start()
        run.awaitTermination()
    got = jobs.newest_answers(spark.read.schema(jobs.DONE).parquet(str(tmp_path / "out"))).collect()
    want = jobs.assemble_batch(spark.createDataFrame(rows, jobs.CHUNK)).where("status = 'complete'").select(*got[0].__fields__).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    one = next(r for r in got if r.request_id == 1)
    assert (one.content, one.reasoning, one.prompt_tokens, one.n_chunks, [c.arguments for c in one.calls]) == ("abc", "r1r3", 7, 5, ["{1}", "{}"])


def test_prepared_encodes_every_training_level(spark):
    rows = [(i, i % 2, float(i), f"v{i // 4:03}") for i in range(600)] + [(600, 0, 1.0, None), (601, 1, 1.0, None), (602, 1, 1.0, "rare")]
    df = spark.createDataFrame(rows, "i int, fold int, x double, c string")
    made = {(r.outer, r.i): r for r in validation.prepared(df, "fold", ["x"], ["c"], 2).collect()}
    assert len(made) == 2 * len(rows)
    for outer in (0, 1):
        levels = sorted({r[3] or "missing" for r in rows if r[1] != outer})
        for i, _, _, c in rows:
            got, name = made[outer, i], c or "missing"
            assert got.width_c == len(levels) and got.hot_c == (levels.index(name) if name in levels else None)


def test_guards_of_every_dataset(spark):
    rows = [("big", g, g % 3, 1.0, float(g) if g % 3 == 1 else None) for g in range(12)] + [("few", g, g, 1.0, 1.0) for g in range(3)] + [("two", g % 2, g % 2, 1.0, 1.0) for g in range(20)] + [(None, g, g % 3, 1.0, 1.0) for g in range(12)]
    df = spark.createDataFrame(rows, "d string, g int, fold int, a double, b double")
    assert {r.d: r.reason for r in validation.guards(df, "g", ("d",)).collect()} == {"big": None, "few": "too few rows", "two": "too few groups", None: None}
    # b has values in fold 1 alone, so fold 1's training rows have none
    assert {r.d: r.reason for r in validation.guards(df, "g", ("d",), "fold", ("a", "b")).collect()} == {"big": "no training values: b", "few": "too few rows", "two": "too few groups", None: None}
    assert validation.guards(df.where("d = 'big'"), "g", (), "fold", ("a", "b")).first().reason == "no training values: b"


@pytest.mark.parametrize(("k", "seed"), [(5, 1), (3, 2), (7, 3), (40, 4)])
def test_greedy_folds_follow_the_rule(spark, k, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 1, 1, 2, 3, 17, 60]) for _ in range(30)]
    df = spark.createDataFrame([(g,) for g, n in enumerate(sizes) for _ in range(n)], "g int")
    loads, want = [[0, f] for f in range(min(k, 30))], {}
    for g in sorted(range(30), key=lambda g: (-sizes[g], g)):
        at = min(loads)
        want[g] = at[1]
        at[0] += sizes[g]
    assert {r.g: r.fold for r in validation.greedy_folds(df, "g", k).collect()} == want


def test_greedy_folds_send_the_driver_sizes_alone():
    loads = [(0, 0), (10**7, 1), (3, 2)]
    made = validation._turns(loads, 1, 30 * 10**6)
    assert len(made) < 10 and sum(x for x, _ in loads) == 10**7 + 3 + 30 * 10**6 and max(loads)[0] - min(loads)[0] <= 1


def study_rows():
    rng = np.random.default_rng(17)
    rows = []
    for i in range(160):
        a, b = rng.normal(), rng.normal()
        kind = ("p", "q", "r", None)[int(rng.integers(4))]
        rows.append((i, f"g{i % 16:02}", None if i % 7 == 0 else float(a), str(round(b, 3)) if i % 11 else "n/a", kind, float(1000 + 3 * a - b + (2 if kind == "q" else 0) + 0.1 * rng.normal())))
    return rows


def slow_design(rows, train, at):
    """Median imputing with indicators, standard scaling and one-hot levels of training rows, for one row."""
    out = [1.0]
    number = lambda r, c: None if r[c] in (None, "n/a") else float(r[c])
    filled = {c: [number(r, c) if number(r, c) is not None else np.median([number(t, c) for t in train if number(t, c) is not None]) for r in (*train, at)] for c in (2, 3)}
    out += [(filled[c][-1] - np.mean(filled[c][:-1])) / np.std(filled[c][:-1]) for c in (2, 3)]
    out += [float(number(at, c) is None) for c in (2, 3)]
    levels = {r[4] or "missing" for r in train}
    return out + [float((at[4] or "missing") == x and x in levels) for x in sorted({r[4] or "missing" for r in rows})]


def test_study_matches_brute_force(spark):
    rows = study_rows()
    df = spark.createDataFrame(rows, "i int, g string, a double, b string, c string, y double")
    grid = [("ridge", 1.0, 0.0), ("ridge", 10.0, 0.0), ("net", 0.01, 0.5), ("net", 1.0, 0.95)]
    made, manifest, chosen = study.compared(df, {"training_mean": [], "all": ["a", "b", "c"], "b": ["b"]}, "g", "y", k=4, inner=2, grid=grid)
    got = {(r.feature_set, r.i): r for r in made.collect()}
    assert len(got) == 3 * len(rows) and {r.model for r in got.values()} == {"linear", "training_mean"}
    fold, inner = {}, {}
    for r in manifest.collect():
        if r.part == "test":
            fold[r.g] = r.outer
        else:
            inner[r.outer, r.g] = r.inner
    assert len(fold) == 16 and len(inner) == 16 * 3

    def fit(train, c):
        x = np.array([slow_design(rows, train, r) for r in train])
        y = np.array([r[5] for r in train])
        held = np.column_stack([x, y - y.mean()])
        gram = held.T @ held
        w = validation.ridge(gram, c[1]) if c[0] == "ridge" else validation.elastic_net(gram, c[1], c[2])
        return lambda r: y.mean() + w @ slow_design(rows, train, r)

    for outer, *best in chosen["all"]:
        train = [r for r in rows if fold[r[1]] != outer]
        errors = []
        for c in grid:
            each = []
            for k in (0, 1):
                predict = fit([r for r in train if inner[outer, r[1]] != k], c)
                missed = {}
                for r in train:
                    if inner[outer, r[1]] == k:
                        missed.setdefault(r[1], []).append(abs(r[5] - predict(r)))
                each.append(np.mean([np.mean(v) for v in missed.values()]))
            errors.append(np.mean(each))
        assert grid.index(tuple(best)) == int(np.argmin(errors)), (errors, best)
        predict = fit(train, tuple(best))
        for r in rows:
            if fold[r[1]] == outer:
                assert got["all", r[0]].predicted == pytest.approx(predict(r), abs=1e-6)
                assert got["training_mean", r[0]].predicted == pytest.approx(np.mean([t[5] for t in train]))
    miss = {s: np.mean([abs(r.observed - r.predicted) for (name, _), r in got.items() if name == s]) for s in ("training_mean", "all", "b")}
    assert miss["all"] < miss["b"] < miss["training_mean"]


def test_study_rejects_what_it_cannot_fit(spark):
    df = spark.createDataFrame(study_rows(), "i int, g string, a double, b string, c string, y double")
    for bad, words in ((df.where("g < 'g02'"), "too few groups"), (df.where("i < 11"), "too few rows"), (df.withColumn("a", F.when(F.col("g") == "g00", F.col("a"))), "no training values")):
        with pytest.raises(ValueError, match=words):
            study.compared(bad, {"all": ["a"]}, "g", "y", k=4, inner=2)
    design = study.Design(df, ["a"], ["c"], "y")
    assert design.width == 1 + 2 + 4 and {len(r.x) for r in df.select(design.row().alias("x")).collect()} == {design.width}
    assert (study.Design(df, [], ["i"], "y", most=100).wide, study.Design(df, [], ["i"], "y", most=100).width) == ("i", 1)
    with pytest.raises(ValueError, match="levels"):  # one may have any number of levels, but not two
        study.Design(df.withColumn("k", F.col("i") + 1), [], ["i", "k"], "y", most=100)


def test_relationship_cohort(spark):
    rows = [(1, "NF", "10.1/A", "r1", 1.0, 2.0, 3.0), (2, "NF", None, "r2", 1.0, 2.0, 3.0), (3, "NF", "nan", " ", 1.0, 2.0, 3.0), (4, "RO", "10.1/b", "r4", 1.0, 2.0, 3.0), (5, "NF", "10.1073/PNAS.5/-/DCSupplemental/x", "r5", None, 2.0, 3.0), (6, "NF", "10.1073/pnas.5", "r6", 1.0, None, 3.0), (7, "NF", "10.1/a", "r7", 1.0, 2.0, None)]
    df = spark.createDataFrame(rows, "i int, dataset string, doi string, ref string, x double, s double, y double")
    roles_of = {"x": "xps", "s": "structure", "y": "performance"}
    pick = lambda **more: {r.i: r.study_group for r in study.cohort(df, "xps_to_performance", "y", {"xps": ["x"]}, [], roles_of, ["NF"], **more).collect()}
    assert pick() == {1: "10.1/a", 6: "10.1073/pnas.5"}
    assert pick(fallback="ref") == {1: "10.1/a", 2: "r2", 6: "10.1073/pnas.5"}
    assert pick(measured=False) == {1: "10.1/a", 5: "10.1073/pnas.5", 6: "10.1073/pnas.5"}
    with pytest.raises(ValueError):
        study.cohort(df, "xps_to_structure", "y", {"xps": ["x"]}, [], roles_of, ["NF"])


def test_columns_are_numeric_by_their_share_of_numbers(spark):
    rows = [(i, "odd" if i % 10 == 0 else str(i), "odd" if i % 4 == 0 else str(i), "n/a" if i % 2 else "-", None if i % 3 else "5", float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "i int, one_in_ten string, one_in_four string, markers string, few string, x double")
    assert study.types(df, df.columns) == {"i": "numeric", "one_in_ten": "numeric", "one_in_four": "categorical", "markers": "categorical", "few": "numeric", "x": "numeric"}
    assert study.typed(df, ["one_in_ten", "x"], {"one_in_ten": "categorical"}) == (["x"], ["one_in_ten"])
    # the odd text counts as missing
    noisy = df.withColumns({"g": F.concat(F.lit("g"), F.col("i") % 8), "y": F.col("i") * 2.0})
    made, _, _ = study.compared(noisy, {"all": ["one_in_ten"]}, "g", "y", k=4, inner=2, grid=[("ridge", 1e-6, 0.0)])
    miss = [abs(r.predicted - r.y) for r in made.collect() if r.one_in_ten is not None]
    assert len(miss) == 36 and max(miss) < 1.0


def test_a_study_needs_a_variable_of_each_role_and_a_dataset(spark):
    roles_of = {"p": "preparation", "x": "xps", "s": "structure", "y": "performance"}
    with pytest.raises(ValueError, match="each role"):
        validation.check_study("chain_to_performance", "y", {"preparation": ["p"], "structure": ["s"]}, [], roles_of)
    validation.check_study("chain_to_performance", "y", {"preparation": ["p"], "xps": ["x"], "structure": ["s"]}, [], roles_of)
    df = spark.createDataFrame([("NF", "10.1/a", 1.0, 2.0)], "dataset string, doi string, x double, y double")
    with pytest.raises(ValueError, match="dataset"):
        study.cohort(df, "xps_to_performance", "y", {"xps": ["x"]}, [], roles_of, [])


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(4)
    rows = [(g, float(v)) for g, n in (("a", 1), ("b", 2), ("c", 1000)) for v in rng.integers(-40, 40, n)] + [("d", None), ("e", 5.0)] + [("c", 7.0)] * 500
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in tables.quantiles(tables.value_counts(df, ["g"], ["v"]).drop("field"), ["g"], [0.0, 0.1, 0.5, 0.9, 1.0]).collect()}
    for g in "abce":
        own = [v for k, v in rows if k == g]
        assert got[g].n == len(own) and np.allclose(got[g].q, np.quantile(own, [0.0, 0.1, 0.5, 0.9, 1.0]))
    assert set(got) == set("abce")


def test_batch_hits_of_no_batch_and_of_none(spark):
    from spectraloom.operators import literature

    schema = "batch int, doc_key string, seq int"
    rows = [(1, "a", 5), (1, "a", 3), (1, "b", 4), (2, "a", 9), (None, "c", 8), (None, "a", 7), (None, "c", 2)]
    got = {tuple(r) for r in literature.batch_hits(spark.createDataFrame(rows, schema), ["doc_key"], "batch", "seq").select("batch", "doc_key", "seq", "position").collect()}
    assert got == {(1, "a", 3, 1), (1, "b", 4, 2), (2, "a", 9, 1), (None, "c", 2, 1), (None, "a", 7, 2)}
    assert literature.batch_hits(spark.createDataFrame([], schema), ["doc_key"], "batch", "seq").count() == 0


def by_group_alone(df, group):
    """Whether a plan joins rows by nothing but `group`, which brings a group to one task."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return bool(re.search(rf"(SortMerge|ShuffledHash)Join(\(skew=\w+\))? \[{group}#\d+L?\], ", plan))


def test_quartiles_keep_groups_spread(spark, monkeypatch):
    rows = [(g, float(v)) for g in "ab" for v in [*range(101), 500, -400]] + [(None, 3.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = {g: (np.quantile([v for h, v in rows if h == g], 0.25), 0.0, 100.0) for g in "ab"}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cuts = tables.quantiles(tables.value_counts(df, ["g"], ["v"]).drop("field"), ["g"], [0.25])
        assert not by_group_alone(cuts, "g") and not by_group_alone(records.box(df, "g", "v"), "g") and not by_group_alone(records.histogram(df, "g", "v", 4), "g")
        for few in (tables.FEW_GROUPS, 1):
            monkeypatch.setattr(tables, "FEW_GROUPS", few)
            assert {r.g: (r.q1, r.low, r.high) for r in records.box(df, "g", "v").collect()} == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_metrics_read_rows_once_and_keep_groups_spread(spark, monkeypatch):
    rng = random.Random(4)
    rows = [("g", 1e7 + rng.randrange(40), float(rng.randrange(3))) for _ in range(400)] + [("h", float(i), 1.0) for i in range(9)] + [("i", None, 1.0), ("i", 2.0, 3.0), ("i", 4.0, None), ("i", 5.0, 2.0)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame(rows, "g string, observed double, predicted double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    kept = []
    monkeypatch.setattr(validation, "checkpointed", lambda made: kept.append(made) or tables.checkpointed(made))
    try:
        got = {r.g: r for r in validation.metrics(df.mapInArrow(counted, df.schema), ["g"]).collect()}
        assert read.value == len(rows)
        assert not any(by_group_alone(made, "g") for made in kept)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    o, p = (np.array([r[i] for r in rows[:400]]) for i in (1, 2))
    rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    assert (got["g"].n, got["g"].mae, got["g"].rmse) == (400, pytest.approx(np.abs(o - p).mean()), pytest.approx(np.sqrt(((o - p) ** 2).mean())))
    assert got["g"].r2 == pytest.approx(1 - ((o - p) ** 2).sum() / ((o - o.mean()) ** 2).sum(), rel=1e-9) and got["g"].spearman == pytest.approx(np.corrcoef(rank(o), rank(p))[0, 1])
    assert got["h"].spearman is None and got["h"].n == 9
    assert (got["i"].n, got["i"].mae, got["i"].spearman is None) == (4, 2.0, False)


def test_linear_study_holds_few_numbers_and_shuffles_rows_once(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, i % 12, None if i % 13 == 0 else rng.gauss(0, 1), rng.choice("xyz"), rng.gauss(0, 1)) for i in range(240)]
    df = spark.createDataFrame(rows, "i int, paper int, a double, c string, y double")
    made = []

    def predicted():
        out, _, chosen = study.compared(df, {"all": ["a", "c"], "none": []}, "paper", "y", 3, 2)
        made.append(out._jdf.queryExecution().executedPlan().toString())
        return {(r.i, r.feature_set): r.predicted for r in out.collect()}, chosen

    whole, best = predicted()
    assert "hashpartitioning(paper" not in made[0]
    monkeypatch.setattr(study, "MOST_HELD", 1)
    monkeypatch.setattr(study, "MOST_TERMS", 0)
    parts, chosen = predicted()
    assert chosen == best and parts.keys() == whole.keys() and all(abs(parts[k] - v) < 1e-12 for k, v in whole.items())
    sums = df.where("a is not null").select("paper", F.array("a").alias("x"), "y").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        got = study._partial_sums(sums, ["paper"], lambda key, x, y: np.array([x.sum(), len(y)])).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) > 12  # a task gave its sums more than once
    for p in range(12):
        own = [r[2] for r in rows if r[1] == p and r[2] is not None]
        assert np.allclose(np.sum([r.v for r in got if r.paper == p], axis=0), [sum(own), len(own)])
