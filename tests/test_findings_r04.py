"""Findings of round 4: plans of the page chain that filled the driver, and rows of uploads that went to disk again and again."""

import re

from pdpspark.operators import extract, match, sections
from pdpspark.plans import match_queries, section_queries
from pdpspark.session import placed, settings

PAGE = """<html><body><p>outside</p><div class="c-wrapper ST0003"><div class="c-text-contents__headline">Title {i}</div>
<picture><source srcset="/content/dam/a{i}.jpg"><img src="/content/dam/a{i}.jpg" alt="A"></picture></div>
<div class="c-wrapper ST0014 column-2"><ul><li class="card"><p class="c-text-contents__headline">One</p><img src="/content/dam/b.jpg"></li>
<li class="card"><p class="c-text-contents__headline">Two</p><a href="/x"><img src="/content/dam/c.jpg"></a><img src="/content/dam/d.jpg"></li></ul></div>
<div class="c-wrapper ST0030"><div class="c-specs"><dl><dt>Size</dt><dd>5 cm</dd></dl></div></div></body></html>"""


def _pages(spark):
    return spark.createDataFrame([(i, PAGE.format(i=i)) for i in range(4)], "page_id long, html string")


def test_page_chain_shuffles_once(spark, monkeypatch):
    plans, cut = [], section_queries.cut_lineage

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    for module in (section_queries, extract, sections):
        monkeypatch.setattr(module, "cut_lineage", noted)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        secs, _ = section_queries.assemble(extract.nodes(_pages(spark)))
        rows = secs.collect()
    assert len(plans) > 10 and len({r.page_id for r in rows}) == 4
    assert sum(p.count("Exchange") for p in plans) <= 4
    assert max(p.count("Join") for p in plans) <= 24
    assert spark.conf.get("spark.sql.adaptive.enabled") == before


def test_component_nodes_keep_the_texts_that_rules_read(spark):
    full = extract.nodes(_pages(spark)).cache()
    lean = extract.component_nodes(full).cache()
    kept = {(r.tag, r.text) for r in lean.where("page_id = 0 and text is not null").collect()}
    assert kept == {("div", "Title 0"), ("p", "One"), ("p", "Two"), ("dt", "Size"), ("dd", "5 cm")}
    sets = []
    for nodes in (full, lean):
        comps = extract.wrappers(nodes)
        sets.append([sorted(map(repr, df.collect())) for df in (
            extract.component_table(nodes, comps), extract.component_texts(nodes, comps), extract.component_media(nodes, comps),
            extract.specs(nodes, comps), extract.item_boxes(nodes, comps), extract.compares(nodes, comps))])
    assert sets[0] == sets[1] and all(sets[0][:3])


def test_settings_come_back(spark):
    try:
        with settings(spark, {"spark.sql.adaptive.enabled": "false", "spark.pdpspark.none": "x"}):
            assert spark.conf.get("spark.sql.adaptive.enabled") == "false"
            raise ValueError
    except ValueError:
        pass
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true" and spark.conf.get("spark.pdpspark.none", None) is None


def test_placed_rows_are_not_shuffled_again(spark):
    rows = placed(spark.range(100).selectExpr("id % 7 as k", "id as v"), ["k"], 100, 10)
    assert rows.rdd.getNumPartitions() == 10
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        other = spark.range(7).selectExpr("id as k", "id * 2 as w")
        joined = rows.join(other, "k", "left").join(rows.select("k").where("v < 3").distinct(), "k", "left_semi")
        assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
        assert sorted((r.k, r.v, r.w) for r in joined.collect()) == sorted((i % 7, i, i % 7 * 2) for i in range(100) if i % 7 < 3)


def test_matching_writes_no_table_of_keys(spark, monkeypatch):
    said = [("a", "AB1234.X", "", ""), ("a", "CD5678", "", ""), ("b", "AB1234ZZ", "CD5678", "x"), ("c", "nothing", "", "see AB1234 here"),
            ("d", None, None, None), (None, "AB1234", "", "")]
    rows = spark.createDataFrame(said, "row string, sku string, parent_sku string, name string")
    index = match.model_keys(spark.createDataFrame([("s1", "AB1234"), ("s2", "AB1234"), ("s3", "CD5678")], "slug string, model string"))
    seen, cut = [], match.cut_lineage
    freed = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    monkeypatch.setattr(match, "cut_lineage", lambda df: seen.append((df.columns, spark.conf.get(freed))) or cut(df))
    before = spark.conf.get(freed)
    hits = {tuple(r) for r in match.match_keys(rows, index).collect()}
    assert hits == {("a", "AB1234", "sku"), ("a", "CD5678", "sku"), ("b", "CD5678", "sku"), ("c", "AB1234", "name")}
    assert seen and not any("tier" in columns for columns, _ in seen) and {on for _, on in seen} == {"true"}
    assert spark.conf.get(freed) == before
    out = {(r.row, r.sku): (r.candidates, r.by) for r in match.match_rows(rows, index).collect()}
    assert out[("a", "CD5678")] == (["s1", "s2", "s3"], "sku") and out[("c", "nothing")] == (["s1", "s2"], "name") and out[(None, "AB1234")] == ([], "")


def _by_row(df):
    """Shuffles by row in the plan of df."""
    return len(re.findall(r"Exchange hashpartitioning\(row#", df._jdf.queryExecution().executedPlan().toString()))


def test_upload_summary_shuffles_hits_only(spark, tmp_path):
    spark.createDataFrame([(i, f"lace {i}", f"Brand#{i}") for i in range(10, 14)], "p_partkey long, p_name string, p_brand string").selectExpr(
        "*", "'T' as p_type", "1 as p_size").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(o, 10 + o % 5, o, o % 7 + 1) for o in range(28)]  # part 14 is in no catalogue
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        out = match_queries.upload_summary(spark, str(tmp_path))
        assert _by_row(out) == 1
        rows = {r.upload_id: (r.n_rows, r.n_matched, r.n_found) for r in out.collect()}
    nums = [(o + n, n) for o, p, _, n in lines if p < 14]
    # suffixed, glued, bundled and lower-cased codes match, so do codes in names of longer numbers; seven letters after a code are too many
    assert {k: (v[0], v[2]) for k, v in rows.items()} == {
        u: (sum(m % 7 == u for m, _ in nums), sum(m % 7 == u and m % 3 == 0 for m, _ in nums)) for u in {m % 7 for m, _ in nums}}
    assert sum(v[1] for v in rows.values()) == sum(n != 7 for _, n in nums)


def test_unmatched_shuffles_hits_once(spark):
    rows = placed(spark.createDataFrame([("a", "AB1234", ""), ("a", "zz", ""), ("b", "AB1 + CD2", ""), ("c", "EF5678", ""), (None, "x", "")],
                                        "row string, sku string, parent_sku string"), ["row"], 5, 1)
    hits = spark.createDataFrame([("a", "AB1234", "sku"), ("a", "AB1234", "sku"), ("c", "EF5678", "sku")], "row string, key string, by string")
    cat = spark.createDataFrame([("s1", "AB1234", "th"), ("s2", "EF5678", "de")], "slug string, model string, country string")
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        out = match.unmatched(rows, hits, cat, "th")
        assert _by_row(out) == 1
        assert sorted((r.row or "", r.sku) for r in out.collect()) == [("", "x"), ("c", "EF5678")]
