from tessera.streaming.notes import note_claims, write_claims


def test_a_stream_gives_the_claims_of_the_table(spark, tmp_path):
    rows = [(1, "Ann Lee — found by mail. Email: ann@x.org. Skills: Go, Rust, and Go."), (2, None), (3, "")]
    notes = spark.createDataFrame(rows, "note_id long, text string")
    notes.write.parquet(str(tmp_path / "in"))
    query = write_claims(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert query.awaitTermination(120)
    want = sorted((r["entity_key"], r["field_path"], r["value"]) for r in note_claims(notes).collect())
    got = sorted((r["entity_key"], r["field_path"], r["value"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == want == [("notes:1", "emails", "ann@x.org"), ("notes:1", "full_name", "Ann Lee"), ("notes:1", "skills", "Go"), ("notes:1", "skills", "Rust")]
