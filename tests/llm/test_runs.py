"""The fingerprint index batch by batch: orders, compaction, earlier rows hit by later batches, repeated ids, hot keys."""

import random

import pytest

from palimpsest.llm import substring as S

from . import brute
from .test_contracts import frame, planted


@pytest.mark.parametrize("seed, hot", [(1, 1000), (2, 3)])
def test_batches_in_any_order(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(S, "HOT", hot)
    rows = planted(seed)
    random.Random(seed).shuffle(rows)
    index = S.FingerprintIndex(spark, 35, fanout=2)
    spans = None
    for k in range(4):
        found = index.add(S.rows_of(frame(spark, rows[k::4]), "doc_id", "text"))
        spans = found if spans is None else spans.unionByName(found)
    assert len(index.summaries) < 4  # compaction came by itself
    got = S.without_repeats(frame(spark, rows), spans, "doc_id", "text", "dedup").collect()
    assert {r.doc_id: (r.dedup.n_words, r.dedup.n_removed, brute.sha(r.dedup.kept)) for r in got} == brute.op5(rows)


def test_a_later_batch_hits_an_earlier_row(spark):
    words = [f"w{k}" for k in range(200)]
    index = S.FingerprintIndex(spark, 35)
    first = index.add(S.rows_of(frame(spark, [(1, " ".join(words[:90]))]), "doc_id", "text"))
    assert first.count() == 0
    later = index.add(S.rows_of(frame(spark, [(2, " ".join(words[40:80])), (3, " ".join(words[100:160]))]), "doc_id", "text"))
    assert {(r.id, r.start + k) for r in later.collect() for k in range(r.to - r.start)} == {(1, k) for k in range(40, 80)} | {(2, k) for k in range(40)}


def test_repeated_ids_with_other_texts(spark):
    p, q = (" ".join(f"{c}{k}" for k in range(60)) for c in "pq")
    rows = [(1, p), (2, p), (2, q), (None, q + " more"), (None, "short")]
    got = S.remove_repeats(frame(spark, rows).selectExpr("*", "'x' spans", "1 asked", "'y' _repeat_key", "2 own_id", "3 id", "4 hash")).collect()
    assert sorted((r.doc_id or 0, r.dedup.n_words, r.dedup.n_removed) for r in got) == [(0, 1, 0), (0, 61, 60), (1, 60, 60), (2, 60, 60), (2, 60, 60)]
    got = S.remove_repeats(frame(spark, rows[:3])).collect()
    assert sorted((r.doc_id, r.dedup.n_removed) for r in got) == [(1, 60), (2, 0), (2, 60)]
