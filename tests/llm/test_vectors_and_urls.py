from __future__ import annotations

import re

import numpy as np
import pytest
from recall import recall, seen

from dagframe.llm import ann, url_filter

EMBEDDINGS = "/root/testdata/sf0.001/embeddings.parquet"


def _brute(ids, vectors, q, k=10):
    away = np.sqrt(((vectors - vectors[q]) ** 2).sum(1))
    keep = ids != ids[q]
    order = np.lexsort((ids[keep], away[keep]))[:k]
    return list(zip(ids[keep][order].tolist(), away[keep][order].tolist(), strict=True))


def test_nearest_recall_and_scores(spark):
    rows = spark.read.parquet(EMBEDDINGS)
    pdf = rows.toPandas()
    ids, vectors = pdf.vec_id.to_numpy(), np.array(pdf.embedding.tolist(), float)
    hit = n = 0
    got = ann.nearest(rows, rows.where("vec_id % 20 = 0")).toPandas()
    for q, found in got.groupby("query_id"):
        want = _brute(ids, vectors, int(np.flatnonzero(ids == q)[0]))
        found = found.sort_values("rank")
        assert found["rank"].tolist() == list(range(1, 11))
        away = {int(i): float(np.sqrt(((vectors[ids == i][0] - vectors[ids == q][0]) ** 2).sum())) for i in found.vec_id}
        assert np.allclose(found.score, [away[i] for i in found.vec_id], rtol=0, atol=1e-12)
        assert sorted(zip(found.score, found.vec_id)) == list(zip(found.score, found.vec_id))
        hit += len({i for i, _ in want} & set(found.vec_id))
        n += len(want)
    assert got.query_id.nunique() == (ids % 20 == 0).sum() and hit >= 0.9 * n


def test_recall_where_windows_are_a_small_part_of_the_table(spark):
    """Directions without structure in 64 dimensions, as in the tables: recall against all rows, and how many of them are looked at."""
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(10000, 64))
    vectors = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)
    import pandas as pd

    rows = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(10000), "embedding": vectors.tolist()})).selectExpr("vec_id", "cast(embedding as array<float>) AS embedding")
    found = ann.nearest(rows, rows.where("vec_id % 100 = 0")).toPandas()
    assert len(found) == 1000 and recall(found, np.arange(10000), vectors.astype(float)) >= 0.9
    index = ann.Index(vectors.astype(float), 10000, ann.CURVES, int(10000 // max(ann.LEAST, 10000 * ann.SHARE)), ann.SEED)
    every, distinct = seen(index, vectors.astype(float), np.arange(0, 10000, 100))
    assert every < 0.85 and distinct < 0.5


def test_structured_vectors_do_with_windows_of_a_fixed_size(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(6000, 4)) @ rng.normal(size=(4, 32))
    import pandas as pd

    rows = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(6000), "embedding": vectors.tolist()}))
    found = ann.nearest(rows, rows.where("vec_id % 50 = 0"), curves=8, window=400).toPandas()
    assert recall(found, np.arange(6000), vectors) >= 0.9


def _other_rows(kind, n=3000):
    rng = np.random.default_rng(6)
    normal = rng.normal(size=(n, 64))
    if kind == "tight groups":
        return rng.normal(size=(10, 64))[rng.integers(0, 10, n)] + 1e-4 * normal
    if kind == "unlike lengths":
        return normal * np.exp(2 * rng.normal(size=(n, 1)))
    if kind == "far from zero":
        return normal + 1e4
    if kind == "far outliers":
        return np.where(np.arange(n)[:, None] < n // 200, 1e6, 1e-2) * normal
    return rng.normal(size=(n, int(kind.split()[0])))


@pytest.mark.parametrize("kind", ["tight groups", "unlike lengths", "far from zero", "far outliers", "256 components", "2 components", "1 component"])
def test_recall_on_other_rows(spark, kind):
    """Rows that one grid of codes cannot tell apart, that crowd in a few cells, that rounding blurs, and that need wider windows."""
    import pandas as pd

    vectors = _other_rows(kind, 9000 if kind == "256 components" else 3000).astype(np.float32)
    rows = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(vectors)), "embedding": vectors.tolist()})).selectExpr("vec_id", "cast(embedding as array<float>) AS embedding")
    found = ann.nearest(rows, rows.where("vec_id % 50 = 0")).toPandas()
    assert len(found) == len(vectors) // 5 and recall(found, np.arange(len(vectors)), vectors.astype(float)) >= 0.92


def test_codes_tell_how_far_they_are_off():
    rng = np.random.default_rng(7)
    for dim in (1, 3, 33, 64):
        vectors = rng.normal(size=(500, dim)) * np.exp(3 * rng.normal(size=(500, 1))) + 50
        index = ann.Index(vectors, 500, 2, 10, 1)
        codes = index.codes(vectors)
        off = np.sqrt(((index.decoded(codes) - index.scaled(vectors)) ** 2).sum(1))
        assert np.allclose(codes["error"], off, rtol=1e-6) and (off <= codes["size"] * dim**0.5 / index.top / 1.99).all()


def test_blocks_and_queries_that_are_split(spark, monkeypatch):
    rows = spark.read.parquet(EMBEDDINGS)
    whole = {(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(rows, rows.where("vec_id % 20 = 0")).collect()}
    monkeypatch.setattr(ann, "MOST_ROWS", 40)
    monkeypatch.setattr(ann, "MOST_QUERIES", 8)
    split = {(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(rows, rows.where("vec_id % 20 = 0")).collect()}
    assert len(split) == len(whole) and len(split & whole) >= 0.98 * len(whole)


def test_vectors_that_take_no_part_and_copies(spark):
    rows = [(100 * i, [1.0, 0.0, float(i)], "x") for i in range(1, 4)]
    rows += [(i, [1.0, 0.0, 1.0], "x") for i in range(50, 90)]
    rows += [(500, None, "x"), (600, [0.0, 0.0, 0.0], "x"), (700, [1.0, None, 2.0], "x"), (800, [1.0, float("nan"), 2.0], "x"), (900, [float("inf"), 0.0, 2.0], "x"), (None, [1.0, 1.0, 1.0], "x"), (1000, [1.0, 2.0], "x"), (1100, [], "x"), (200, [1.0, 0.0, 2.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = ann.nearest(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in got} == {100, 200, 300}
    assert [(r.vec_id, r.score) for r in got if r.query_id == 100] == [(i, 0.0) for i in range(50, 60)]
    assert [(r.vec_id, r.score) for r in got if r.query_id == 200] == [(i, 1.0) for i in range(50, 60)]
    few = df.where("vec_id in (100, 200, 300)")
    assert [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(few, few).orderBy("query_id", "rank").collect()] == [(100, 1, 200), (100, 2, 300), (200, 1, 100), (200, 2, 300), (300, 1, 200), (300, 2, 100)]
    assert ann.nearest(df.where("false"), df).count() == 0


def test_hilbert_neighbours_touch():
    cells = np.array([[x, y] for x in range(8) for y in range(8)])
    path = cells[np.argsort(ann.hilbert_keys(cells, 3))]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()
    cells = np.array([[x, y, z] for x in range(4) for y in range(4) for z in range(4)])
    path = cells[np.argsort(ann.hilbert_keys(cells, 2))]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def _plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(str.maketrans(url_filter.UPPER, url_filter.LOWER))
    best = None
    for verdict, rule in url_filter.RULES:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best


def test_hosts_paths_and_rules(spark):
    urls = ["http://A.Example.COM/en/1?x=1", "https://www.example.com/en/2#f", "http://x.net/es/3", "http://xnet/es/3", "http://net/fr/", "ftp://a.com", "http://a.com/", "http://com/x", None, "", "no scheme", "http://", "http://h?q=://x", "https://example.com/EN/1", "http://b.org/en/1", "http://u@c.example.com:80/en/", "x" * 5000 + "://a.com/" + "y" * 20000, "http://example.com.evil.org/en/", "://com/"]
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)] + [(0, urls[0], "h", "r"), (None, None, None, None)], "page_id long, url string, host string, rule string")
    got = url_filter.filter_urls(df).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        host, path, best = _plain(urls[r.page_id] if r.page_id is not None else None)
        assert (r.host, r.path, r.rule) == (host, path, best and best[0])
        assert r.verdict == best[1] if best else r.verdict in ("allow", "block")
    assert url_filter.filter_urls(df.where("false")).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(df.where("page_id = 14")).collect()} == {"allow"}


def test_trees_predict_held_out_labels(spark):
    """Fitted to one half of the labelled URLs, they are right on most of the other."""
    from pyspark.sql import functions as F

    from dagframe.llm.common import Scratch

    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("url")
    host, path = url_filter.host_and_path(F.col("url"))
    own = pages.withColumns({"host": host, "path": path}).withColumn("fit", url_filter.rule_of(F.col("host"), F.col("path"))).where("fit is not null")
    labelled = own.select("url", "host", "path", (F.col("fit.verdict") == "block").cast("double").alias("label"))
    first = F.pmod(F.xxhash64("url", F.lit("half")), F.lit(2)) == 0
    model = url_filter.fit_url_model(labelled.where(first), Scratch(spark, "test"))
    judged = model.verdicts(labelled.where(~first))
    right, most = judged.agg(F.avg((F.col("model_verdict") == F.when(F.col("label") > 0, "block").otherwise("allow")).cast("int")), F.greatest(F.avg("label"), 1 - F.avg("label"))).first()
    assert right > most + 0.05


def test_statistics_cover_labelled_urls_outside_the_sample(spark):
    """Every part's share is counted over all distinct labelled URLs, and joins that shuffle give the same verdicts."""
    from collections import Counter

    from pyspark.sql import functions as F

    from dagframe.llm.common import BROADCAST_BYTES, Scratch

    rows = [(f"http://h{i % 7}.site{i % 150}.org/d{i % 40}/{i}", float(i % 150 % 2)) for i in range(1500)]
    df = spark.createDataFrame(rows + rows[:200], "url string, label double")
    host, path = url_filter.host_and_path(F.col("url"))
    labelled = df.withColumns({"host": host, "path": path})
    model = url_filter.fit_url_model(labelled, Scratch(spark, "test"), sample=100)
    for part, of in {"domain": lambda u: u.split("/")[2].split(".", 1)[1], "segment": lambda u: u.split("/")[3]}.items():
        n, blocked = Counter(of(u) for u, _ in rows), Counter(of(u) for u, x in rows if x)
        assert {r[0]: r[1] for r in model.rates[part].collect()} == {p: blocked[p] / (k + url_filter.PRIOR) for p, k in n.items()}
    ask = labelled.select("url", "host", "path")
    one = Counter(model.verdicts(ask).collect())
    model.sizes = dict.fromkeys(model.sizes, BROADCAST_BYTES + 1)
    assert Counter(model.verdicts(ask).collect()) == one and one.total() == len(rows) + 200
