"""The security part of the health grade comes from the security scan."""

import duckdb

from weftline.plans import registry
from weftline.sources import adapters

SF = "/root/testdata/sf0.001"


def test_security_counts_are_those_of_the_scan(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    n = {s: k for s, k in con.sql(f"SELECT severity, n FROM ({registry.oracle_sql()['sec_summary']}) WHERE severity IS NOT NULL").fetchall()}
    want = min(30, 10 * n.get("high", 0) + 4 * n.get("medium", 0) + n.get("low", 0))
    row = registry.queries()["health"](spark, SF).first()
    assert row["d_security"] == want > 0
    assert row["score"] == max(0, 100 - sum(row[c] for c in row.asDict() if c.startswith("d_")))


def test_medium_and_low_findings_count(spark, monkeypatch):
    text = "el.innerHTML = a\nel.innerHTML = b\nconsole.log(a)\nconsole.log(b)\nconsole.log(c)\n"
    monkeypatch.setattr(adapters, "files", lambda spark, sf: spark.createDataFrame([("src/a.js", "js", text)], "path string, lang string, text string"))
    assert registry.queries()["health"](spark, SF).first()["d_security"] == 2 * 4 + 3
