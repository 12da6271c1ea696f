from lexspan import queries
from lexspan.functions import stats


def test_numbers_of_draws(spark, tmp_path, monkeypatch):
    rows = [(f"model-{m}", 1.0, "top_k", float(i), i / 20.0, (i * (m + 2)) % 13 / 13.0 if m else i / 9.0) for m in range(3) for i in range(12)]
    joined = spark.createDataFrame(rows, "model string, temperature double, decoder string, parameter double, coverage double, mean_ttr double")
    monkeypatch.setattr(queries, "_joined_t", lambda spark, sf_dir: joined)
    p = {r.model: r.p for r in queries.queries()["permutation_p"](spark, "").collect()}
    assert p["model-0"] < 1 / 1001
    drawn, bootstrap = [], stats.cluster_bootstrap
    monkeypatch.setattr(stats, "cluster_bootstrap", lambda *a: drawn.append(a[5]) or bootstrap(*a))
    r = queries.queries()["pooled_spearman"](spark, "").first()
    assert r.low <= r.rho <= r.high
    folder = f"file://{tmp_path}"
    spark.createDataFrame([("g", k, float(k)) for k in range(9)], "o_orderpriority string, o_custkey long, o_totalprice double").write.parquet(f"{folder}/orders.parquet")
    r = queries.queries()["cluster_bootstrap"](spark, folder).first()
    assert 0 < r.low < r.high < 8 and drawn == [10_000, 2_000]
