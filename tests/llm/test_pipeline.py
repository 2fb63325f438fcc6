"""The pipeline, stage by stage, against plain versions."""

from __future__ import annotations

from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from brute import near, quality, repeats
from conftest import SMALL

from dagframe.llm import secrets
from dagframe.llm.common import Scratch


def plain_quality(docs):
    """Rows that stay, by their text and by their host's shrunk failure rate."""
    failed = []
    for r in docs:
        n, _, _, _, again = quality(r.text)
        failed.append(n < 20 or 100 * again > 30 * n)
    hosts = defaultdict(list)
    for r, f in zip(docs, failed, strict=True):
        hosts[r.source].append(f)
    n, m = len(docs), len(hosts)
    mean = sum(failed) / n
    noise = mean * (1 - mean)
    spread = sum(sum(f) ** 2 / len(f) for f in hosts.values()) / n - mean**2 - noise * m / n
    strength = min(10000, max(1, noise / spread - 1)) if spread > 0 else 10000
    rate = {h: (sum(f) + mean * strength) / (len(f) + strength) for h, f in hosts.items()}
    return [r for r, f in zip(docs, failed, strict=True) if not f and rate[r.source] <= 0.8]


def plain_near(docs):
    groups = near([(r.doc_id, r.text) for r in docs], 5, 80)
    return [r for r, (k, n, c) in zip(docs, groups, strict=True) if not n or k == c]


def test_each_stage_agrees_with_its_plain_version(spark):
    scratch, docs = Scratch(spark, "test"), spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "suffix_dedup", "secret_scan", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.orderBy("doc_id").collect()
        docs = scratch.save(stage(spark, docs, SMALL), name)
        after = docs.orderBy("doc_id").collect()
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        if name == "quality_rules":
            assert after == plain_quality(before)
        elif name == "near_duplicates":
            assert after == plain_near(before)
        elif name == "suffix_dedup":
            want = {k: (n, gone) for k, n, gone, _, _ in repeats([(r.doc_id, r.text) for r in before])}
            for r in after:
                n, gone = want[r.doc_id]
                size = len(r.text.encode())
                assert n - gone - 6 * (gone > 0) <= size <= n - gone and r.n_chars == len(r.text)
            assert {r.doc_id for r in before} - {r.doc_id for r in after} <= {k for k, (n, gone) in want.items() if n - gone < 10}
        elif name == "secret_scan":
            path = secrets.default_vocabulary()
            for a, b in zip(before, after, strict=True):
                found = secrets.spans(a.text, secrets.KINDS, path)
                text, at = "", 0
                for start, _, end in found:
                    if start >= at:
                        text += a.text[at:start] + "[SECRET]"
                    at = max(at, end)
                assert b.text == text + a.text[at:] and b.n_chars == len(b.text)
        else:
            pieces = Counter()
            for r in after:
                pieces[r.doc_id] += r.length
            assert pieces == {r.doc_id: r.doc_tokens for r in after} and set(pieces) == {r.doc_id for r in before}


def test_run_is_the_chain_of_stages(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0


@pytest.mark.parametrize("which", ["edges", "nothing"])
def test_stages_take_odd_rows(spark, which, request):
    docs = request.getfixturevalue(which)
    for name, stage in corpus_pipeline.STAGES:
        docs = Scratch(spark, "odd").save(stage(spark, docs, SMALL), name)
        docs.count()


def test_null_ids_go_by_their_own_text(spark):
    good = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(None, "short", "en", "s", 5), (None, good, "en", "s", 9), (1, "short", "en", "s", 5), (2, good + " end", "en", "s", 5), (2, "short", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.quality(spark, docs.where("text <> 'none'"), SMALL)
    assert Counter((r.doc_id, r.text[:2]) for r in kept.collect()) in (Counter({(None, "w0"): 1, (2, "w0"): 1}), Counter())
