"""The personal-data trees learn from every base match."""

from secondpass.llm import pii


def test_fit_counts_every_base_match(spark, monkeypatch):
    docs = spark.range(300).selectExpr(
        "id AS doc_id", "concat('call +1 555 010 ', 1000 + id % 7, ' at 10.0.0.', id % 400, ' card 4111 1111 1111 111', id % 10, ' a@b', id % 3, '.org') AS text")
    found, kept = pii.candidates(docs), {}
    plain = pii.pin
    monkeypatch.setattr(pii, "pin", lambda df, label="pinned": kept.setdefault(label, plain(df, label)))
    fitted = pii.fit(found)
    every = found.selectExpr("inline(found)").where("ok IS NOT NULL")
    counted = kept["pii-counted"]
    assert counted.selectExpr("sum(n)").first()[0] == every.count() >= 1200
    assert counted.where("label = 1").selectExpr("sum(n)").first()[0] == every.where("ok").count()
    assert counted.count() < every.count() and fitted is not None
