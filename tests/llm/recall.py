"""Recall of op7_nearest by brute force: python tests/llm/recall.py TABLES_DIR."""

from __future__ import annotations

import os
import sys

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


def recall(found, ids: np.ndarray, vectors: np.ndarray, k: int = 10) -> float:
    """Share of each query's k nearest, over all rows, that are among found (rows of query_id and vec_id)."""
    got: dict[int, set[int]] = {}
    for q, v in zip(found.query_id, found.vec_id, strict=True):
        got.setdefault(int(q), set()).add(int(v))
    hit, place = 0, {int(i): n for n, i in enumerate(ids)}
    for q, near in got.items():
        away = np.sqrt(((vectors - vectors[place[q]]) ** 2).sum(1))
        keep = ids != q
        hit += len(near & set(ids[keep][np.lexsort((ids[keep], away[keep]))[:k]].tolist()))
    return hit / (k * len(got))


def seen(index, vectors: np.ndarray, queries: np.ndarray) -> tuple[float, float]:
    """Rows that a query's windows hold: (all, distinct), as shares of the table."""
    every, distinct = 0, np.zeros((len(queries), len(vectors)), bool)
    for c in range(len(index.axes)):
        near = np.abs(index.blocks(vectors, c)[None] - index.blocks(vectors[queries], c)[:, None]) <= 1
        every += near.mean()
        distinct |= near
    return float(every), float(distinct.mean())


def main() -> None:
    import time

    from pyspark.sql import SparkSession

    from dagframe.llm import ann

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    rows = spark.read.parquet(f"{sys.argv[1]}/embeddings.parquet")
    pdf = ann.clean_vectors(rows, "vec_id", "embedding").dropDuplicates(["id"]).toPandas()
    ids, vectors = pdf.id.to_numpy(), np.array(pdf.vec.tolist(), float)
    began = time.perf_counter()
    found = ann.op7_nearest(spark, sys.argv[1]).toPandas()
    took = time.perf_counter() - began
    n = len(ids)
    index = ann.Index(vectors[:: max(1, n // ann.SAMPLE)], n, ann.CURVES, max(1, int(n // max(ann.LEAST, n * ann.SHARE))), ann.SEED)
    every, distinct = seen(index, vectors, np.arange(0, n, max(1, n // 200)))
    print(f"{n} vectors, {found.query_id.nunique()} queries, {took:.1f} s: recall {recall(found, ids, vectors):.3f}, codes compared a query {every:.2f} n ({distinct:.2f} n distinct), originals {ann.RERANK * (ann.NEIGHBOURS + 1)}")
    spark.stop()


if __name__ == "__main__":
    main()
