"""The near-duplicate stage finds copies by SimHash first."""

from strandframe.llm import resemblance


def test_simhash_names_copies_and_the_shingles_confirm_them(spark, monkeypatch):
    words = [f"word{i * 7919 % 4001}" for i in range(400)]
    near = words[:-1] + ["other"]
    rows = [(5, " ".join(words)), (2, " ".join(near)), (9, "a text of its own with few words"), (None, " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    bodies = docs.where("doc_id IS NOT NULL").selectExpr("unhex(md5(text)) _id", "doc_id _key", "text _body")
    gone = resemblance.print_copies(bodies, "_key").join(bodies, "_id")
    assert [r._key for r in gone.collect()] == [5]
    used, own = [], resemblance.print_copies
    monkeypatch.setattr(resemblance, "print_copies", lambda *a: used.append(1) or own(*a))
    kept = resemblance.one_of_similar(docs).collect()
    assert used and sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 2), (False, 9), (True, 0)]
