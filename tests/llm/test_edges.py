"""All operators on nulls, empty and very long texts, repeated rows, clashing columns and empty tables."""

from __future__ import annotations

from llm import decontaminate, importance, licenses, mixing, pieces, quality_rules, repeats, superminhash, surrogates, toxicity


def test_decontaminate(spark, edge, empty):
    text = edge.where("doc_id = 5").first().text
    items = spark.createDataFrame([(1, text), (2, None), (None, "a b c"), (3, ""), (4, "one"), (4, "one")], "item_id long, text string")
    rows = decontaminate.find_leaks(edge, items).collect()
    assert len(rows) == edge.count() and rows[0].score == "x"
    assert {r.doc_id for r in rows if r.leaks} == {5, 6, 8}  # 8 holds the one-word item
    assert not any(r.leaks for r in decontaminate.find_leaks(edge, items.where("false")).collect())
    assert decontaminate.find_leaks(empty, items).count() == 0


def test_toxicity(spark, edge, empty, labels):
    model = toxicity.fit(edge, labels)
    rows = toxicity.score(edge, model).collect()
    assert len(rows) == edge.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(empty, model).count() == 0
    flat = toxicity.fit(edge, labels.where("false"))
    assert {r.score for r in toxicity.score(edge, flat).collect()} == {0.0}
    toxicity.score(edge, toxicity.fit(empty, labels)).collect()


def test_repeats(edge, empty):
    rows = repeats.remove_repeats(edge).collect()
    assert len(rows) == edge.count() and repeats.remove_repeats(empty).count() == 0
    copies = [r for r in rows if r.id == 4]
    assert all(not r.kept for r in copies)  # a copy of document 0
    assert all(r.n_bytes == 0 for r in rows if r.id in (1, 2))
    long = next(r for r in rows if r.id == 9)
    assert bytes(long.kept) == b"x" and len(long.spans) == 1  # the window at 1 also starts at 0, so all but the first byte go


def test_quality(edge, empty, labels):
    rows = quality_rules.quality(edge, labels).collect()
    assert len(rows) == edge.count() and all(r.base_failed and not r.kept for r in rows if r.n_words < 20)
    assert quality_rules.quality(empty, labels).count() == 0
    assert all(r.score == 0 for r in quality_rules.quality(edge, labels.where("false")).collect())


def test_surrogates(edge, empty):
    rows = surrogates.replace_personal_data(edge).collect()
    assert len(rows) == edge.count() and all(r.n_replaced == 0 for r in rows)
    assert sorted(str(r.text) for r in rows) == sorted(str(r.text) for r in edge.collect())
    assert surrogates.replace_personal_data(empty).count() == 0


def test_near_duplicates(edge, empty):
    rows = superminhash.near_duplicates(edge).collect()
    assert len(rows) == edge.count() and superminhash.near_duplicates(empty).count() == 0
    assert all(r.component == 0 for r in rows if r.id == 4)
    assert all(r.kept and r.n_shingles == 0 for r in rows if r.id in (1, 2, 3))


def test_licenses(edge, empty):
    assert licenses.scan_licenses(edge).where("size(licenses) > 0").count() == 0 and licenses.scan_licenses(empty).count() == 0


def test_mixing(edge, empty):
    rows = mixing.score(edge, vocabulary=64).collect()
    assert len(rows) == edge.count() and all(r.score < 0 for r in rows if r.n_tokens > 1)
    assert all(r.n_tokens == 1 for r in rows if r.id in (1, 2, 3))
    assert mixing.score(empty).count() == 0


def test_resample(edge, empty, labels):
    rows = importance.resample(edge, labels).collect()
    assert len(rows) == edge.count() and all(r.score == "x" for r in rows)
    assert len({r.selected for r in rows if r.doc_id == 4}) == 1
    assert all(r.selected for r in importance.resample(edge, labels.where("false")).collect())
    assert importance.resample(empty, labels).count() == 0


def test_pieces(edge, empty):
    rows = pieces.encode(edge, check_col="round_trip").collect()
    assert all(r.round_trip for r in rows) and all((r.ids is None) == (r.text is None) for r in rows)
    assert pieces.encode(empty).count() == 0 and pieces.decode(pieces.encode(empty)).count() == 0
