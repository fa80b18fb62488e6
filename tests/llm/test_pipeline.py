"""The pipeline's stages on planted cases."""

import corpus_pipeline


def test_stages(documents, dice):
    words = [f"wort{k}" for k in range(4000)]
    text = lambda n: " ".join(dice.choice(words) for _ in range(n))
    passage = text(60)
    docs = [(k, text(80)) for k in range(40)]
    docs += [(100, docs[0][1]), (101, docs[1][1].replace("wort1", "wort1x", 1) + " end"), (102, "junk"), (103, "again and again it says " * 30)]
    docs += [(200, text(70) + " " + passage + " " + text(70)), (201, text(70) + " " + passage + " " + text(70)), (202, text(50) + " mail me.you@site.example.com " + text(50))]
    df = documents(docs).drop("_id")
    columns = df.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "simhash_near_duplicates", "suffix_array_dedup", "pii_surrogates", "pattern_packing"]
    kept = stages["quality_rules"](df.sparkSession, df, "")
    assert {r.doc_id for r in df.collect()} - {r.doc_id for r in kept.collect()} == {102, 103} and kept.columns == columns
    one = stages["simhash_near_duplicates"](df.sparkSession, kept, "")
    assert {r.doc_id for r in kept.collect()} - {r.doc_id for r in one.collect()} == {100, 101} and one.columns == columns
    cut = stages["suffix_array_dedup"](df.sparkSession, one, "")
    rows = {r.doc_id: r for r in cut.collect()}
    assert passage in rows[200].text and passage not in rows[201].text and rows[201].n_chars == len(rows[201].text) and cut.columns == columns
    clean = stages["pii_surrogates"](df.sparkSession, cut, "")
    rows = {r.doc_id: r for r in clean.collect()}
    assert "me.you@site" not in rows[202].text and rows[3].text == docs[3][1] and clean.columns == columns
    packed = stages["pattern_packing"](df.sparkSession, clean, "").collect()
    assert {r.doc_id for r in packed} == set(rows)
