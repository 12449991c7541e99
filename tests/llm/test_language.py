from isohypse.llm import language as L


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = L.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out AND length(text) > 100").collect()
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97


def test_long_texts_keep_their_margin(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model, own = L.fit(docs.where(~L.held_out())), {}
    for r in docs.where(L.held_out()).where("lang IS NOT NULL").select("lang", "text").distinct().collect():
        own.setdefault(r.lang, []).append(r.text or "")
    for lang, texts in own.items():
        text = " ".join(texts)
        for size in (3_000_000, 10_000_000):
            got, _, sure = model.predict((text * (size // len(text) + 1))[:size])
            assert got == lang and sure, (lang, size)


def test_edge_cases(documents, rows):
    out = L.identify(documents).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    for i in (-1, -2, -3):
        assert by[i].lang_pred == "und" and by[i].score == 0.0 and not by[i].sure
    assert all(0 <= r.score <= 1 for r in out) and by[-4].lang_pred in ("en", "fr", "de", "es")
    assert L.accepted(documents).columns == documents.columns


def test_without_any_label_all_is_undetermined(documents, empty):
    assert L.identify(documents.where("doc_id < 0")).where("lang_pred <> 'und'").count() == 0
    assert L.identify(empty).count() == 0
