"""Rows out of HTML tables, and tables with indexes."""

from pyspark.sql import functions as F

from tandem.operators import htmltables
from tandem.sources import indexed

PAGE = """<h3>Lost</h3><table class="wikitable sortable"><tr><th>Team</th><th>Moves</th></tr>
<tr><td>A &amp; B</td><td>To <a href="/x" title="X, the  team">X</a><br>For <a href="/y"></a><a href="/z">Z<b>z</b></a></td></tr>
<tr><td> </td><td></td></tr></table>
<h2>Trades</h2><h3>June</h3><h4>June 5</h4>
<table><tr><td>outer <table class="inner"><tr><td>nested</td></tr><tr><td>more</td></tr></table></td><td>last</td></tr><tr><td>after</tr></table>
<script>document.write("<table><tr><td>no")</script><h2>Free <i>agency</i></h2><table class=""><tbody><tr><td>open"""


def _plain():
    link = lambda text, title, href: {"text": text, "title": title, "href": href}
    x, z = link("X", "X, the team", "/x"), link("Z z", "", "/z")
    return [
        ("Unsectioned", "Lost", 1, ["wikitable", "sortable"], 0, ["Team", "Moves"], []),
        ("Unsectioned", "Lost", 1, ["wikitable", "sortable"], 1, ["A & B", "To X For Z z"], [x, z]),
        ("Trades", "June 5", 2, [], 0, ["outer nested more", "last"], []),
        ("Trades", "June 5", 2, [], 3, ["after"], []),
        ("Trades", "June 5", 3, ["inner"], 0, ["nested"], []),
        ("Trades", "June 5", 3, ["inner"], 1, ["more"], []),
        ("Free agency", None, 4, [], 0, ["open"], []),
    ]


def test_rows_keep_to_their_tables():
    assert htmltables.parse(PAGE) == _plain()
    assert htmltables.parse(None) == htmltables.parse("") == htmltables.parse("<tr><td>no table") == []


def test_rows_pass_as_arrow_beside_kept_columns(spark):
    pages = spark.createDataFrame([(1, PAGE, "a"), (2, None, "b"), (3, "", None), (4, PAGE, None)], "page int, html string, cells string").repartition(2)
    out = htmltables.table_rows(pages, "html", ["page", "cells"])
    assert out.columns == ["page", "cells_", "section", "subsection", "table_index", "table_classes", "row_index", "cells", "links"]
    got = sorted((r["page"], r["cells_"], *[[x.asDict() for x in v] if k == "links" else v for k, v in r.asDict().items() if k not in ("page", "cells_")]) for r in out.collect())
    assert got == sorted([(1, "a", *r) for r in _plain()] + [(4, None, *r) for r in _plain()], key=lambda r: (r[0], r[4], r[6])) or sorted(got, key=str) == sorted([(1, "a", *r) for r in _plain()] + [(4, None, *r) for r in _plain()], key=str)
    assert htmltables.table_rows(pages.limit(0), "html", ["page"]).count() == 0


def _scanned(df):
    df.collect()
    plan, seen = df._jdf.queryExecution().executedPlan(), []

    def visit(p):
        if p.nodeName().startswith("AdaptiveSparkPlan"):
            return visit(p.executedPlan())
        if p.nodeName().startswith("Scan"):
            seen.append(p.metrics().apply("numOutputRows").value())
        children = p.children()
        for i in range(children.size()):
            visit(children.apply(i))

    visit(plan)
    return sum(seen)


def test_bucketed_tables_join_without_an_exchange_and_lookups_skip_row_groups(spark):
    orders = spark.range(20000).select(F.col("id").alias("k"), (F.hash("id").cast("long") * 2).alias("code"), (F.col("id") % 10).alias("v"))
    indexed.save_indexed(orders, "idx_orders", "k", 4, {"code": 20000})
    indexed.save_indexed(orders.select("k", F.col("v").alias("w")), "idx_more", "k", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("idx_orders").join(spark.table("idx_more"), "k")
        assert joined.where("v = w").count() == 20000
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        plain = orders.join(orders.select("k", F.col("v").alias("w")), "k")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" in plain
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    orders.repartition(4, "k").write.mode("overwrite").format("parquet").saveAsTable("plain_orders")
    some = orders.where("k = 777").first()["code"]
    find = lambda name, code: spark.table(name).where(F.col("code") == F.lit(code))
    assert [r["k"] for r in find("idx_orders", some).collect()] == [777]
    odd = some + 1 if some < 0 else some - 1  # within minimum and maximum, and in no row
    assert _scanned(find("plain_orders", odd)) > 0
    assert _scanned(find("idx_orders", odd)) == 0
    indexed.ordered_view(spark, "idx_board", "idx_orders", ["v DESC", "k"])
    assert [r["k"] for r in spark.table("idx_board").limit(3).collect()] == [9, 19, 29]
