"""Hand-computed values, edge cases and metamorphic checks of the core operators."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lotmill.functions import names, text
from lotmill.operators import decide, grid, knn, lookups, production, quality, records, sweep, versions
from lotmill.operators.skew import ranked, skew_join
from lotmill.plans import lookup_queries, text_queries
from lotmill.plans.text_queries import CASES


def test_names(spark):
    df = spark.createDataFrame([("D:/pool/BUSBAR/Shots/Good/shot000641 (1).jpg",), ("busbar%2FShots%2Fgood%2F000.jpg",), ("busbar\\x\\bad\\12.png#1",), ("nothing",), (None,), ("",), ("a%zz/x/good/5.png",)], "s string")
    got = [r[0] for r in df.select(names.picture(F.col("s"))).collect()]
    assert got == ["busbar|good|641", "busbar|good|0", "busbar|bad|12", None, None, None, "a%zz|good|5"]
    lots = spark.createDataFrame([("[lot.a.1]",), ("??",), ("",), (None,), ("Lot A 1",)], "s string")
    assert [r[0] for r in lots.select(names.plain_lot(F.col("s"))).collect()] == ["LOTA1", None, None, None, "LOTA1"]
    files = spark.createDataFrame([(".\\Line_1//2025\\L\\IMG.x.PNG",), ("a/b/c",), (None,)], "s string")
    assert [r[0] for r in files.select(names.file_name(F.col("s"))).collect()] == ["line_1/2025/l/img.x", None, None]


def test_find_without_filter_is_empty_and_limit_is_ordered(spark):
    df = spark.createDataFrame([(2, "b", "l"), (1, "a", "l"), (3, "c", "m")], "row_id bigint, path string, line string")
    assert records.find(df).count() == 0
    assert [r.path for r in records.find(df, 1, line="l").collect()] == ["a"]


def test_dates_and_flags(spark):
    df = spark.createDataFrame([("2025-02-30",), (" 2025-02-03T1",), ("03.02.2025",), (None,)], "d string")
    assert [str(r[0]) for r in df.select(records.date_or_null(F.col("d"))).collect()] == ["None", "2025-02-03", "None", "None"]


def test_covers_is_three_valued(spark):
    df = spark.range(1).select(F.create_map(F.lit("date"), F.array(F.lit("x"))).alias("c"))
    got = df.select(records.covers(F.col("c"), F.lit("date"), F.lit("x")), records.covers(F.col("c"), F.lit("date"), F.lit("y")), records.covers(F.col("c"), F.lit("lot"), F.lit("x"))).first()
    assert tuple(got) == (True, False, None)


def test_skew_join_equals_plain_join(spark):
    many = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 7}") for i in range(500)] + [(999, None)], "i bigint, k string")
    few = spark.createDataFrame([("hot", 1), ("k0", 2), ("k9", 3)], "k string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = skew_join(many, few, ["k"], F.col("i"), how, rows_per_group=10, broadcast_rows=0)
        b = many.join(few, "k", how)
        assert sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(b.columns)).collect()))


def test_every_hot_key_is_cut_up(spark):
    from lotmill.operators.skew import hot_keys, salted, salted_grid

    rows = spark.range(1500 * 6).select((F.col("id") % 1500).alias("k"), "id").unionAll(spark.range(70).select(F.lit(7).cast("bigint"), F.col("id") + 100_000))
    few = spark.range(1500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for head in (100_000, 20):  # all in the plan or broadcast, or most of them in a table
        hot = hot_keys(rows, ["k"], 4, head)
        assert len(hot.head) + (hot.tail.count() if hot.tail else 0) == 1500
        a, b = salted(rows, few, ["k"], hot, F.col("id"))
        assert a.groupBy("k", "__salt").count().where("count > 6").count() <= 12 and b.where("k = 7").count() == 19
        joined = a.join(b, ["k", "__salt"])
        assert joined.count() == rows.count() and joined.where("v <> 2 * k").count() == 0
    x, y = spark.range(90).select((F.col("id") % 2).alias("k"), "id"), spark.range(60).select((F.col("id") % 3).cast("int").alias("k"), F.col("id").alias("j"))
    a, b = salted_grid(x, y, ["k"], hot_keys(x, ["k"], 10), hot_keys(y, ["k"], 10), F.col("id"), F.col("j"))
    got = sorted((r.id, r.j) for r in a.join(b, ["k", "__salt", "__salt_b"]).collect())
    assert got == sorted((r.id, r.j) for r in x.join(y, "k").collect())


def test_small_enough_counts_bytes(spark):
    from lotmill.operators.skew import small_enough

    df = spark.range(3).select("id", F.repeat(F.lit("x"), 100).alias("s"))
    assert small_enough(df) and not small_enough(df, size=200) and not small_enough(df, rows=2) and small_enough(df.limit(0))


def test_quantiles_equal_numpy(spark, monkeypatch):
    from lotmill.operators.skew import quantiles

    rng = np.random.default_rng(5)
    v = {"a": rng.random(301).tolist(), "b": [1.0, 2.0], "c": [5.0], "d": rng.integers(0, 3, 100).astype(float).tolist()}
    df = spark.createDataFrame([(k, x) for k, xs in v.items() for x in xs] + [("a", None), ("n", None)], "k string, v double")
    monkeypatch.setattr("lotmill.operators.skew.WINDOW_ROWS", 0)
    got = {r.k: (r.n, r.lo, r.med, r.hi) for r in quantiles(df, ["k"], "v", {"lo": 0.01, "med": 0.5, "hi": 0.99}).collect()}
    assert set(got) == set(v)
    for k, xs in v.items():
        assert got[k][0] == len(xs) and np.allclose(got[k][1:], np.quantile(xs, [0.01, 0.5, 0.99]))


def test_ranked_counts_through(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), "id", (F.col("id") % 5).alias("s"))
    rows = ranked(df, ["g"], F.xxhash64("id"), ["id"], F.col("s")).orderBy("g", "__rank").collect()
    for g in (0, 1):
        mine = [r for r in rows if r.g == g]
        assert [r["__rank"] for r in mine] == list(range(1, 501))
        assert [r["__upto"] for r in mine] == list(np.cumsum([r.s for r in mine]))


def test_criteria_most_specific_wins_and_no_rule_is_null(spark):
    rules = spark.createDataFrame([("wide", None, None, "2025-01-01", None, 0), ("late", "a", None, "2025-03-01", None, 1), ("tie", None, "x", None, None, 2)], "rule_id string, line string, obj string, effective_from string, effective_to string, rule_order int")
    rules = rules.withColumn("effective_from", F.to_date("effective_from")).withColumn("effective_to", F.to_date("effective_to"))
    facts = spark.createDataFrame([(1, "a", "x", "2025-03-01"), (2, "a", "y", "2025-02-01"), (3, "b", "y", "2024-02-01"), (4, None, None, None)], "id bigint, line string, obj string, at string").withColumn("at", F.to_date("at"))
    got = {r.id: r.rule_id for r in lookups.criteria_asof(facts, rules, ["id"], "at", ["line", "obj"], ["rule_id"]).collect()}
    assert got == {1: "late", 2: "wide", 3: None, 4: None}


def test_asof_with_ties_nulls_and_empty(spark):
    f = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 5), (4, "a", None)], "id bigint, k string, t int")
    e = spark.createDataFrame([("a", 3, 10), ("a", 3, 20), ("a", None, 99), ("a", 6, 1)], "k string, s int, v int")
    got = {r.id: r.v for r in lookups.asof_backward(f, e, ["k"], "t", "s", ["v"], ["v"], F.col("id"), 1).collect()}
    assert got == {1: 20, 2: None, 3: None, 4: None}
    assert lookups.asof_backward(f, e.limit(0), ["k"], "t", "s", ["v"], ["v"], F.col("id")).count() == 4


def _scores(spark, pos, neg):
    return spark.createDataFrame([("b", float(s), True) for s in pos] + [("b", float(s), False) for s in neg] + [("b", None, True), ("b", float("nan"), False), ("b", 1.0, None)], "k string, score double, defect boolean")


def test_sweep_golden(spark):
    s = _scores(spark, [0.4, 0.5, 0.6], [0.1, 0.2, 0.3])
    pts = {round(r.threshold, 6): r for r in sweep.curve(s, ["k"]).collect()}
    assert (pts[0.4].detected, pts[0.4].false_positives) == (3, 0)
    assert sweep.threshold_for(sweep.curve(s, ["k"]), ["k"]).first().threshold == 0.4
    assert sweep.auroc(_scores(spark, [0.5] * 3, [0.5] * 4), ["k"]).first().auroc == 0.5
    assert sweep.auroc(_scores(spark, [], [0.5]), ["k"]).first().auroc is None
    normals = [0.3, 0.35, 0.4, 0.48, 0.5, 0.55, 0.6, 0.7, 0.8, 0.9]
    assert sweep.feasibility(_scores(spark, [0.45, 0.52, 0.58], normals), ["k"]).first().achievable is False
    assert sweep.feasibility(_scores(spark, [0.45], normals), ["k"]).first().achievable is None


def test_thinned_keeps_ends(spark):
    pts = spark.range(101).select(F.lit("b").alias("k"), F.col("id").cast("double").alias("threshold"))
    got = sorted(r.threshold for r in sweep.thinned(pts, ["k"], 11).collect())
    assert got[0] == 0 and got[-1] == 100 and len(got) == 11


def test_grid_golden(spark):
    maps = [("m", i, 0, 0, 1.0) for i in range(9)] + [("m", 9, 0, 0, 99.0)]
    cells = spark.createDataFrame(maps, "k string, map int, row int, col int, value double")
    assert grid.cell_baseline(cells, ["k"]).first().median == 1.0
    assert grid.cell_baseline(cells, ["k"], 11).count() == 0
    peaks = [("a", r, c, {(5, 5): 9.0, (5, 6): 8.9, (15, 15): 8.0}.get((r, c), 1.0)) for r in range(20) for c in range(20)]
    df = spark.createDataFrame(peaks, "map string, row int, col int, value double")
    assert [(r.row, r.col) for r in grid.hottest_cells(df, ["map"], 2).orderBy("place").collect()] == [(5, 5), (15, 15)]
    top = grid.hottest_cell(df, ["map"]).first()
    assert (top.row, top.col, top.value) == (5, 5, 9.0)


def test_blobs(spark):
    m = np.zeros((5, 5))
    m[0, 0] = m[1, 1] = m[1, 2] = m[4, 4] = 5
    assert list(grid.components(m > 1)) == [2, 1, 1]
    rows = [("a", r, c, float(m[r, c])) for r in range(5) for c in range(5)]
    got = grid.blobs(spark.createDataFrame(rows, "map string, row int, col int, value double"), ["map"], 2.0).first()
    assert (got.blob_count, got.largest_area, got.total_area) == (3, 2, 4)
    assert grid.blobs(spark.createDataFrame([], "map string, row int, col int, value double"), ["map"], 2.0).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 6), st.integers(1, 6), st.integers(1, 13), st.integers(1, 13))
def test_upsample_keeps_ends_and_range(h, w, th, tw):
    m = np.random.default_rng(h * 7 + w).random((h, w))
    u = grid.upsample(m, th, tw)
    assert u.shape == (th, tw) and u.min() >= m.min() - 1e-12 and u.max() <= m.max() + 1e-12
    assert u[0, 0] == m[0, 0] and (th == 1 or tw == 1 or np.isclose(u[-1, -1], m[-1, -1]))


def test_patch_box_out_of_grid_is_null(spark):
    df = spark.createDataFrame([(0, 0), (7, 7), (8, 0), (-1, 0)], "r int, c int")
    got = [r[0] for r in df.select(grid.patch_box(F.col("r"), F.col("c"), F.lit(8), F.lit(8), 512, 512, 4)).collect()]
    assert tuple(got[0]) == (0, 0, 68, 68) and tuple(got[1]) == (444, 444, 512, 512) and got[2] is None and got[3] is None


def test_coreset_and_isolation(spark):
    x = np.array([[0.0], [0.1], [5.0], [9.0]])
    assert list(knn.greedy_coreset(x, 2)) == [0, 3] and list(knn.greedy_coreset(x, 9)) == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        knn.greedy_coreset(x, 0)
    rng = np.random.default_rng(1)
    rows = [("b", i, [float(v) for v in rng.random(4)]) for i in range(40)]
    bank = spark.createDataFrame(rows, "key string, bank_row bigint, embedding array<float>")
    assert knn.coreset(bank, 0.2).count() == 8
    z = [r.z for r in knn.isolation(bank, 8).collect()]
    assert len(z) == 40 and abs(np.mean(z)) < 1e-9 and abs(np.std(z) - 1) < 1e-9
    assert knn.isolation(bank.limit(9), 8).count() == 0


def test_coreset_in_rounds_equals_one_greedy_run(spark):
    rng = np.random.default_rng(3)
    banks = {"even": rng.random((301, 4)), "near": np.repeat(rng.random((20, 4)), 15, axis=0) + rng.random((300, 4)) * 1e-3, "same": np.repeat(rng.random((5, 4)), 50, axis=0), "small": rng.random((30, 4))}
    rows = [(k, 7 + i, [float(v) for v in x]) for k, b in banks.items() for i, x in enumerate(b)]
    bank = spark.createDataFrame(rows, "key string, bank_row bigint, embedding array<double>")
    got = {}
    for r in knn.coreset(bank, 0.1, cap=29, group_rows=60).collect():
        got.setdefault(r.key, []).append(r.bank_row)
        assert r.capped == (len(banks[r.key]) > 295)
    want = {k: [7 + int(i) for i in knn.greedy_coreset(b, min(29, round(len(b) * 0.1)))] for k, b in banks.items()}
    assert {k: sorted(v) for k, v in got.items()} == want


def test_removal_candidates_rest_on_isolation(spark, tmp_path):
    near = [("B 1", i, "plain", [float(i % 4)] + [0.0] * 31) for i in range(20)]
    bank = near + [("b 1", 20, "apart", [99.0] + [0.0] * 31)]
    spark.createDataFrame(bank, "bank_version string, bank_row bigint, source_image string, embedding array<float>").selectExpr("*", "1 as patch_row", "1 as patch_col").write.parquet(f"{tmp_path}/bank_patches.parquet")
    hits = [("b 1", 1.0, [("plain",)]), ("b 1", 1.5, [("plain",)]), ("b 1", 1.0, [("apart",)]), ("b 1", 3.0, [("far",)])]
    spark.createDataFrame(hits, "bank_version string, score double, matches array<struct<bank_image: string>>").write.parquet(f"{tmp_path}/inference_results.parquet")
    got = {r.bank_image: (r.place, r.evidence_count, r.hits) for r in text_queries.removal_candidates(spark, str(tmp_path)).collect()}
    assert got == {"apart": (1, 2, 1), "plain": (2, 1, 2)}  # counts of rows would put plain first


def test_exact_neighbours_in_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    b, q = rng.integers(0, 4, (300, 3)).astype(float), rng.integers(0, 4, (60, 3)).astype(float)
    bank = spark.createDataFrame([("k", i, v.tolist()) for i, v in enumerate(b)], "key string, bank_row bigint, embedding array<double>")
    qs = spark.createDataFrame([("k", i, v.tolist()) for i, v in enumerate(q)] + [("none", 99, [0.0] * 3), (None, 98, [0.0] * 3)], "key string, query_id bigint, embedding array<double>")
    got = {}
    for r in knn.nearest_exact(bank, qs, 3, block_rows=40, query_rows=17).orderBy("place").collect():
        got.setdefault(r.query_id, []).append(r.bank_row)
    want = {i: sorted(range(300), key=lambda j: (((b[j] - v) ** 2).sum(), j))[:3] for i, v in enumerate(q)}
    assert got == want


def test_clock_takes_days_with_blanks_and_times(spark, tmp_path):
    rows = [(1, "l", "2025-03-03"), (2, "l", " 2025-03-03"), (3, "l", "2025-03-03T00:00:00"), (4, "l", "2025/03/03"), (5, "l", None), (6, None, "2025-03-03"), (7, "l", "2025-13-03")]
    spark.createDataFrame(rows, "row_id bigint, line string, date_str string").write.parquet(f"{tmp_path}/mes.parquet")
    got = {r.row_id: (r.start_s, r.end_s) for r in lookup_queries.production_clock(spark, str(tmp_path)).collect()}
    day = 1740960000
    assert got == {1: (day + 1, day + 32), 2: (day + 34, day + 66), 3: (day + 69, day + 102)}


def test_clock_equals_the_recursion(spark):
    rng = np.random.default_rng(3)
    rows = [("l", i, f"2025-01-{1 + i // 40:02d}", int(rng.integers(1, 5000)), int(rng.integers(0, 50))) for i in range(100)]
    df = spark.createDataFrame(rows, "line string, i int, day string, d int, g int").withColumn("day", F.to_date("day"))
    got = [r.start_s for r in production.production_clock(df, ["line"], ["i"], "day", F.col("d"), F.col("g")).orderBy("i").collect()]
    end, want = None, []
    base = {d: int(t) for d, t in df.select(F.col("day").cast("string"), F.unix_timestamp(F.col("day").cast("timestamp"))).distinct().collect()}
    for _, _, day, d, g in rows:
        start = base[day] + 1 if end is None else max(end + g, base[day] + 1)
        want.append(start)
        end = start + d
    assert got == want


def test_decision_table(spark):
    flat = [(i, None, v, q, p, True, d, c, k, s) for ids, v, q, p, d, c, k, s, _ in CASES for i in ids]
    got = {r.case_id: r.cause for r in decide.decide(spark.createDataFrame(flat, decide.EVIDENCE)).collect()}
    want = {i: e for ids, *_, e in CASES for i in ids}
    assert sum(got[i] == want[i] for i in want) == 22 and got["NO-002"] is None
    none = decide.decide(spark.createDataFrame([("u", None, True, None, None, True, None, None, None, None)], decide.EVIDENCE)).first()
    assert none.outcome == "withheld" and none.cause is None


def test_unknown_evidence_decides_nothing(spark):
    ev = lambda **k: tuple({**dict.fromkeys(f.split()[0] for f in decide.EVIDENCE.split(", ")), **k}.values())
    rows = [ev(case_id="seen", defect_visible=False, quality_ok=False), ev(case_id="unseen", quality_ok=False), ev(case_id="patch", has_nearest=True, coverage=False), ev(case_id="bare"), ev(case_id="twin", duplicate_similarity=0.85)]
    got = {r.case_id: (r.outcome, r.cause, r.candidates) for r in decide.decide(spark.createDataFrame(rows, decide.EVIDENCE)).collect()}
    assert got["seen"] == ("withheld", None, []) and got["unseen"] == ("decided", "equipment_optics", []) and got["twin"] == ("duplicate", None, [])
    assert got["patch"][2] == ["bank_contamination", "normal_overlap", "coverage_gap"] and len(got["bare"][2]) == 4


def test_collected_evidence(spark):
    ddl = "case_id string, line string, object_name string, bank_version string, score double, threshold double, area double, defect_area double, review_area double, top_image string, asked map<string, string>"
    cases = [("a", "l", "o", "b", 1.9, 2.0, 3.0, 2.5, 1.5, "p1", {"date": "d1", "lot": "x", "equipment": "e9"}), ("b", "l", "o", "c", float("nan"), 2.0, None, 2.5, 1.5, None, {"date": "d1", "lot": None}), ("c", None, None, None, None, None, None, None, None, "p2", None), ("d", "l", "o", "b", 2.0, 2.0, 1.6, 2.5, None, "p3", {"lot": "x"})]
    con = spark.createDataFrame([("l", "o", {"date": ["d1"], "equipment": ["e1"]})], "line string, object_name string, conditions map<string, array<string>>")
    sweeps, labels = spark.createDataFrame([("b", True)], "bank_version string, achievable boolean"), spark.createDataFrame([("p1", True), ("p2", False)], "image string, is_defect boolean")
    out = decide.collect_evidence(spark.createDataFrame(cases, ddl), con, sweeps, labels)
    got = {r.case_id: (r.position, r.has_nearest, r.patch_is_defect, r.coverage, r.missing_axes, r.criteria_verdict, r.sweep_achievable) for r in out.collect()}
    assert got == {"a": ("near", True, True, False, ["equipment"], "defect", True), "b": (None, False, None, True, [], None, None), "c": (None, True, False, None, [], None, None), "d": ("above", True, None, None, [], "pass", True)}
    rows = decide.evidence_rows(out)
    assert rows.count() == 28 and {r.item_no for r in rows.where("case_id = 'a' and not usable").collect()} == {1, 2}


def test_similar_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    pick = lambda v: [None, "", *v][int(rng.integers(0, len(v) + 2))]
    rows = [(i, pick("ab"), pick("xyz"), pick("p")) for i in range(200)]
    w = {"o": 0.45, "d": 0.4, "l": 0.15}
    issues = spark.createDataFrame(rows, "issue_id bigint, o string, d string, l string")
    got = {}
    for r in text.similar(issues, issues.where("issue_id % 9 = 0").withColumnRenamed("issue_id", "probe_id"), w, 4).orderBy("probe_id", "place").collect():
        got.setdefault(r.probe_id, []).append((r.issue_id, r.similarity, r.matched_on))
    for p in rows[::9]:
        want = []
        for i in rows:
            on = [k for k, a, b in zip(w, p[1:], i[1:], strict=True) if a and a == b]
            if on:
                want.append((i[0], round(sum(w[k] for k in on), 4), ",".join(on)))
        assert got.get(p[0], []) == sorted(want, key=lambda x: (-x[1], x[0]))[:4]


def test_terms_of_many_and_long_texts(spark):
    vocab = spark.createDataFrame([(f"term{i:06d}", f"alias {i:06d}") for i in range(1000)] + [(None, "x"), ("", "y"), ("deep", None)], "term string, alias string")
    texts = spark.createDataFrame([(1, "z" * 300_000 + "ALIAS 000007" + " term000003"), (2, ""), (3, None), (4, "term000003"), (5, "xxterm000003xx")], "id bigint, text string")
    got = {r.id: (r.term, r.stage) for r in text.match_terms(texts, vocab, "id", "text").collect()}
    assert got == {1: ("term000007", 2), 4: ("term000003", 1), 5: ("term000003", 3)}
    assert {r.id: (r.term, r.stage) for r in text.match_terms(texts, vocab, "id", "text", part_rows=400).collect()} == got
    assert text.match_terms(texts, vocab.limit(0), "id", "text").count() == 0


def test_tables_of_a_run_are_removed(spark):
    from lotmill.session import clear, new_table_path

    path = new_table_path(spark, "x")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    clear(spark)
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_quality(spark):
    long = spark.createDataFrame([("a", "m", 1.0), ("a", "m", 3.0), ("a", "m", None), ("b", "m", 5.0)], "line string, metric string, value double")
    got = {r.line: (r.n, r.mean, round(r.std, 6)) for r in quality.baseline(long, ["line"]).collect()}
    assert got == {"a": (2, 2.0, 1.414214), "b": (1, 5.0, 0.0)}
    img = spark.createDataFrame([("x", 8, 8, [float(i % 8) for i in range(64)]), ("n", 8, 8, None)], "image string, height int, width int, pixels array<double>")
    out = {r.image: r for r in quality.metrics_of_images(img).collect()}
    assert out["x"].brightness == 3.5 and out["n"].brightness is None


def test_versions(spark):
    m = spark.createDataFrame([("i", 1, "a"), ("i", 1, "b"), ("i", 2, "b"), ("i", 2, "c"), ("i", 2, "c"), ("i", 4, "c")], "item string, n int, member string")
    got = {r.n: (r.added, r.removed, r.kept) for r in versions.consecutive_changes(m, ["item"]).collect()}
    assert got == {1: (2, 0, 0), 2: (1, 1, 1), 4: (1, 0, 0)}
    v = spark.createDataFrame([("a-v12",), ("a-v3_20250101-0000_abcdef",), ("none",), (None,)], "v string")
    assert [r[0] for r in v.select(versions.version_number(F.col("v"))).collect()] == [12, 3, None, None]


def test_text(spark):
    df = spark.createDataFrame([('```json\n{"verdict": " Defect", "confidence": 7}\n```',), ("no object",), (None,)], "t string")
    got = [tuple(r[0]) for r in df.select(text.parsed_verdict(F.col("t"), ["defect"])).collect()]
    assert got == [("defect", 1.0), ("unknown", None), ("unknown", None)]
    ids = spark.createDataFrame([("see LOT-ABC-1 and PCB1-X-22, a-b",), ("",), (None,)], "t string").select(text.product_ids(F.col("t")))
    assert [r[0] for r in ids.collect()] == [["PCB1-X-22"], [], None]
    vocab = spark.createDataFrame([("scratch", "kratzer"), ("deep scratch", None)], "term string, alias string")
    texts = spark.createDataFrame([(1, "Scratch"), (2, "ein Kratzer"), (3, "a deep scratch"), (4, "none"), (5, None)], "id bigint, text string")
    assert {r.id: (r.term, r.stage) for r in text.match_terms(texts, vocab, "id", "text").collect()} == {1: ("scratch", 1), 2: ("scratch", 2), 3: ("deep scratch", 3)}


def test_numbers_as_text(spark):
    df = spark.createDataFrame([(1.25,), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in df.select(text.display_number(F.col("x"), 1)).collect()] == ["1.3", "no record", "no record"]


def test_running_spans_tasks(spark):
    from lotmill.operators.skew import running

    df = spark.range(2000).select(F.when(F.col("id") % 3 == 0, "small").otherwise("hot").alias("g"), "id", (F.col("id") % 7).alias("v"))
    for bound in (0, 50_000):  # over ranges, and by one window
        rows = running(df, ["g"], [F.desc("id")], ["v"], totals=True, window_rows=bound).orderBy("g", F.desc("id")).collect()
        for g in ("small", "hot"):
            mine = [r for r in rows if r.g == g]
            assert [r["__upto_v"] for r in mine] == list(np.cumsum([r.v for r in mine])) and {r["__all_v"] for r in mine} == {sum(r.v for r in mine)}
    assert running(df.limit(0), ["g"], [F.desc("id")], ["v"]).count() == 0


def test_governance(spark):
    from lotmill.operators import governance as gov

    rows = spark.createDataFrame([(1, "a", "x"), (2, None, "y"), (3, "b", "z")], "id int, k string, v string")
    new = spark.createDataFrame([(9, "a", "new"), (8, None, "n")], "id int, k string, v string")
    assert sorted(r.id for r in gov.upsert(rows, new, "k").collect()) == [2, 3, 8, 9]
    shown = gov.shown_rows(rows.withColumn("g", F.lit(1)), ["g"], ["id"], "v", 2).orderBy("place").collect()
    assert [r.cell for r in shown] == ["x", "y", "... 1 more"]
    days = spark.createDataFrame([("a", "2025-01-30", "2025-02-02"), ("b", "2025-01-02", "2025-01-01"), ("c", None, "2025-01-01")], "k string, a string, z string").withColumn("a", F.to_date("a")).withColumn("z", F.to_date("z"))
    assert gov.date_range(days, ["k"], "a", "z").count() == 4
    assert gov.frequencies(rows, "k", ["a", "q"], 1).where("short").first().k == "q"
    assert [r.k for r in gov.repeated(rows.unionAll(rows), ["k"]).orderBy("k").collect()] == ["a", "b"]
    folders = spark.createDataFrame([("i", "f1", "v1")], "item string, folder string, version string")
    pointers = spark.createDataFrame([("i", "f1"), ("j", "gone"), ("k", None)], "item string, folder string")
    assert {r.item: r.version for r in gov.current_folders(pointers, folders, ["item"]).collect()} == {"i": "v1", "j": None, "k": None}


def test_supplements_and_members(spark):
    r = spark.createDataFrame([("l", "o", "d", "lot", "e", "pass", "p1"), ("l", "o", None, "lot", None, "defect", "p2"), ("l", "o", "d", None, "e", None, "p3"), ("l", "o", "d", "lot", "e", None, "in")], "line string, object_name string, captured_at string, lot string, equipment string, truth string, path string")
    got = {(x.axis, x.value): x.images for x in records.supplements(r, spark.createDataFrame([("in",)], "path string")).collect()}
    assert got == {("date", "d"): 2, ("lot", "lot"): 1, ("equipment", "e"): 2}
    a, b = spark.createDataFrame([("k", "x"), ("k", "x"), ("m", "y")], "k string, v string"), spark.createDataFrame([("k", "x"), ("n", "z")], "k string, v string")
    assert {x.k: x.same for x in records.same_members(a, b, ["k"], "v").collect()} == {"k": True, "m": False, "n": False}


def test_long_values_stay_quick(spark):
    import time

    df = spark.createDataFrame([("a" * 200_000,), ("a/" * 100_000,), (" " * 200_000 + "x",), ("{" * 200_000,), ("a-" * 100_000,), ("1" * 200_000,)], "s string")
    began = time.time()
    s = F.col("s")
    assert df.select(names.picture(s), names.file_name(s), names.plain_lot(s), text.product_ids(s), text.brace_span(s), text.display_path(s), records.product_id(s, s, s)).collect()
    assert time.time() - began < 60
