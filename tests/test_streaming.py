from recollect.functions.embedding import HashingEmbedder
from recollect.sources.store import MemoryStore
from recollect.streaming.ingest import apply_changes, stream_files

E = HashingEmbedder()
SCHEMA = "rel_path string, content string, seq long"
ONE = "package a\n\nfunc One() int {\n\treturn 1\n}\n"


def test_changes_follow_a_stream(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path / "home"))
    inbox = str(tmp_path / "inbox")
    spark.createDataFrame([("a.go", ONE, 1), ("b.md", "hello\nworld", 1)], SCHEMA).coalesce(1).write.mode("append").json(inbox)

    def run():
        changes = spark.readStream.schema(SCHEMA).json(inbox)
        query = stream_files(store, "p", changes, E, str(tmp_path / "checkpoint"), availableNow=True)
        query.awaitTermination(120)
        return {(r.file_path, r.text): r.id for r in store.rows("p").collect()}

    first = run()
    assert {path for path, _ in first} == {"a.go", "b.md"}
    rows = [("a.go", "package a\n", 2), ("a.go", ONE.replace("return 1", "return 2"), 3), ("b.md", None, 2), ("c.md", "new", 1)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(inbox)
    second = run()
    assert {path for path, _ in second} == {"a.go", "c.md"}
    assert any("return 2" in text for _, text in second)
    kept = set(first) & set(second)
    assert kept and all(first[k] == second[k] for k in kept)
    assert run() == second


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path / "home"))
    changed = spark.createDataFrame([("a.go", ONE, 1)], SCHEMA)
    assert apply_changes(store, "p", changed, E)["chunksCreated"] == 2
    again = apply_changes(store, "p", changed, E)
    assert (again["chunksCreated"], again["chunksUnchanged"], again["chunksDeleted"]) == (0, 2, 0)
