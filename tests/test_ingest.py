import json
import os

import pytest
from pyspark.sql import functions as F

from recollect.functions.embedding import HashingEmbedder
from recollect.functions.patterns import glob_regex, path_filter, split_patterns
from recollect.plans.ingest import ingest_files, ingest_tree
from recollect.sources import store as store_module
from recollect.sources.ignore import ignored, parse_rules
from recollect.sources.legacy import decode_tags, encode_tags, migrate, upgrade
from recollect.sources.store import ConcurrentCommit, MemoryStore, project_slug
from recollect.sources.walk import read_contents, walk

E = HashingEmbedder()
ALPHA = "package a\n\nfunc One() int {\n\treturn 1\n}\n\nfunc Two() int {\n\treturn 2\n}\n"
BETA = "package b\n\nfunc Three() int {\n\treturn 3\n}\n"
WEB = "export function view(x: number) {\n  return x;\n}\n\nexport function edit(x: number) {\n  return x + 1;\n}\n"
TOOL = "def run():\n    return 1\n\n\ndef stop():\n    return 2\n"


def _write(root, files):
    for rel, text in files.items():
        path = os.path.join(root, rel)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as handle:
            handle.write(text if isinstance(text, bytes) else text.encode())


@pytest.fixture
def tree(tmp_path):
    root = str(tmp_path / "src")
    _write(root, {
        "a/alpha.go": ALPHA, "b/beta.go": BETA, "_hidden/.gamma.go": "package g\n\nfunc G() {}\n", "web/view.ts": WEB,
        "web/extra.ts": "export const one = 1;\n", "tool.py": TOOL, ".gitignore": "generated/\n*.log\n",
        "generated/x.go": "package x\n", "noise.log": "log\n", "node_modules/m/i.js": "var a = 1\n", "blob.bin": b"a\0b",
    })
    return root


def _names(df):
    return sorted(r.rel_path for r in df.collect())


def test_walk_honours_rules_and_finds_hidden_names(spark, tree):
    kept = [".gitignore", "_hidden/.gamma.go", "a/alpha.go", "b/beta.go", "blob.bin", "tool.py", "web/extra.ts", "web/view.ts"]
    assert _names(walk(spark, tree)) == kept
    assert _names(walk(spark, tree, respect_gitignore=False)) == sorted([*kept, "generated/x.go", "noise.log"])
    assert _names(walk(spark, tree, include=["*.go", "web/"], exclude=["extra"])) == ["web/view.ts"]
    assert _names(walk(spark, tree, include=["**/*.go"])) == ["_hidden/.gamma.go", "a/alpha.go", "b/beta.go"]
    assert _names(walk(spark, tree, max_files=3)) == kept[:3]
    assert _names(walk(spark, tree, max_depth=0)) == [".gitignore", "blob.bin", "tool.py"]
    assert "a/alpha.go" not in _names(walk(spark, tree, skip_dirs=["a"]))
    with pytest.raises(NotADirectoryError, match="not a directory"):
        walk(spark, tree + "/missing")


def test_walk_nested_rules_and_symlinks(spark, tmp_path):
    root = str(tmp_path / "r")
    _write(root, {
        ".gitignore": "/build\n*.tmp\n!keep.tmp\ndocs/*.md\n", "build/x": "1", "sub/build/y": "1", "a.tmp": "1", "keep.tmp": "1",
        "docs/a.md": "1", "docs/sub/b.md": "1", "sub/.gitignore": "!b.tmp\nsecret\n", "sub/b.tmp": "1", "sub/secret/z": "1", "secret": "1",
    })
    os.symlink(os.path.join(root, "docs"), os.path.join(root, "link"))
    assert _names(walk(spark, root)) == [".gitignore", "docs/sub/b.md", "keep.tmp", "secret", "sub/.gitignore", "sub/b.tmp", "sub/build/y"]


def test_many_directories_are_split_into_tasks(spark, tmp_path):
    root = str(tmp_path / "wide")
    _write(root, {f"d{i}/e{j}/f.txt": "x" for i in range(30) for j in range(10)})
    df = walk(spark, root)
    assert df.count() == 300 and len(set(_names(df))) == 300
    assert df.select(F.spark_partition_id()).distinct().count() > 30


@pytest.mark.parametrize(
    "rules, path, is_dir, want",
    [
        ("*.log", "a/b.log", False, True), ("*.log", "a/b.txt", False, False), ("# c\n\n*.x", "a.x", False, True),
        ("gen/", "gen", True, True), ("gen/", "gen", False, False), ("/top", "top", False, True), ("/top", "a/top", False, False),
        ("a/b", "a/b/c", False, True), ("a/b", "x/a/b", False, False), ("**/z", "z", False, True), ("**/z", "a/b/z", False, True),
        ("a/**/z", "a/z", False, True), ("a/**", "a/b/c", False, True), ("f?.go", "f1.go", False, True), ("f?.go", "f/x.go", False, False),
        ("f[0-9].go", "f7.go", False, True), ("f[!0-9].go", "f7.go", False, False), ("f[^0-9].go", "fx.go", False, True),
        ("*.a\n!b.a", "b.a", False, False), ("!b.a\n*.a", "b.a", False, True), (r"\#x", "#x", False, True), (r"\!x", "!x", False, True),
        ("a.b", "axb", False, False), ("x  ", "x", False, True), ("x\\ ", "x ", False, True),
    ],
)
def test_ignore_rules(rules, path, is_dir, want):
    assert ignored(path, is_dir, [parse_rules(rules, "")]) is want
    assert ignored("d.r/" + path, is_dir, [parse_rules(rules, "d.r")]) is want
    assert ignored("dxr/" + path, is_dir, [parse_rules("/" + rules.split("\n")[0], "d.r")]) is False


def test_patterns(spark):
    assert glob_regex("src/**/*.go") == r"^src/.*/[^/]*\.go$"
    assert split_patterns(" a, ,b ") == ["a", "b"] and split_patterns("") is None and split_patterns(None) is None
    df = spark.createDataFrame([("src/a/b.go",), ("src/b.go",), ("lib/b.gox",), ("a+b.go",)], "p string")
    keep = {r[0] for r in df.where(path_filter(F.col("p"), ["src/*/?.go", "a+"], ["lib"])).collect()}
    assert keep == {"src/a/b.go", "a+b.go"}


def test_reading_skips_binary_large_and_missing(spark, tmp_path):
    root = str(tmp_path)
    _write(root, {"ok": b"caf\xc3\xa9 \xff", "late": b"x" * 9000 + b"\0", "early": b"x\0", "big": b"y" * 100})
    listed = spark.createDataFrame([(n, s) for n, s in [("ok", 7), ("late", 50), ("early", 2), ("big", 101), ("gone", 1)]], "rel_path string, size long")
    got = {r.rel_path: r.content for r in read_contents(listed, root, 100).collect()}
    assert set(got) == {"ok"} and got["ok"] == "café �"


def _ingest(store, project, tree, **options):
    return ingest_tree(store, project, tree, E, **options)


def _counts(s):
    return tuple(s[k] for k in ("chunksCreated", "chunksUpdated", "chunksUnchanged", "chunksDeleted", "chunksEmbedded"))


def test_incremental_scenario(spark, tree, tmp_path):
    store = MemoryStore(spark, str(tmp_path / "home"))
    dry = _ingest(store, "p", tree, dry_run=True)
    assert dry["dryRun"] and dry["chunksCreated"] > 0 and dry["chunksEmbedded"] == 0 and store.projects() == []
    cold = _ingest(store, "p", tree)
    n = cold["totalChunks"]
    assert (cold["filesScanned"], cold["filesSkipped"], cold["filesChanged"]) == (7, 1, 7)
    assert _counts(cold) == (n, 0, 0, 0, n) and sum(cold["byLanguage"].values()) == n == dry["chunksCreated"]
    rows = store.rows("p").orderBy("id").collect()
    assert [r.id for r in rows] == list(range(1, n + 1))
    assert [(r.file_path, r.line_start) for r in rows] == sorted((r.file_path, r.line_start) for r in rows)
    assert {r.tags[0] for r in rows} >= {"func", "function", "preamble"} and all(len(r.embedding) == 384 for r in rows)

    assert _counts(_ingest(store, "p", tree)) == (0, 0, n, 0, 0)

    _write(tree, {"b/beta.go": BETA.replace("return 3", "return 33")})
    edit = _ingest(store, "p", tree)
    assert _counts(edit) == (1, 0, n - 1, 1, 1) and edit["filesChanged"] == 1

    before = {r.text: r for r in store.rows("p").where("file_path = 'a/alpha.go'").collect()}
    one, two = ALPHA.split("\n\n")[1], ALPHA.split("\n\n")[2].rstrip("\n")
    _write(tree, {"a/alpha.go": f"package a\n\n{two}\n\n{one}\n"})
    swap = _ingest(store, "p", tree)
    assert swap["chunksEmbedded"] <= 2 and swap["chunksUpdated"] >= 1
    after = {r.text: r for r in store.rows("p").where("file_path = 'a/alpha.go'").collect()}
    moved = [t for t in after if t in before and after[t].line_start != before[t].line_start]
    assert moved and all(after[t].id == before[t].id and after[t].embedding == before[t].embedding for t in moved)
    assert all(after[t].updated_at > before[t].updated_at and after[t].created_at == before[t].created_at for t in moved)

    store.insert([{"text": "a note", "project": "p"}], E)
    os.remove(os.path.join(tree, "tool.py"))
    gone = _ingest(store, "p", tree)
    assert gone["filesDeleted"] == 1 and gone["chunksDeleted"] > 0 and gone["chunksEmbedded"] == 0
    assert store.rows("p").where("kind = 'manual'").count() == 1

    other = _ingest(store, "q", tree)
    assert other["chunksEmbedded"] == other["totalChunks"] == gone["totalChunks"]
    assert _ingest(store, "p", tree)["chunksEmbedded"] == 0
    reopened = MemoryStore(spark, str(tmp_path / "home"))
    ids = [r.id for r in reopened.all_rows().select("id").collect()]
    assert len(ids) == len(set(ids)) and reopened.projects() == ["p", "q"]


def test_identical_chunks_in_one_file_stay_stable(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path / "home"))
    same = "func Same() int {\n\treturn 1\n}\n"
    files = spark.createDataFrame([("a.go", f"package a\n\n{same}\n{same}\n{same}")], "rel_path string, content string")
    first = ingest_files(store, "p", files, E)
    assert first["chunksCreated"] == 4
    assert _counts(ingest_files(store, "p", files, E)) == (0, 0, 4, 0, 0)
    fewer = spark.createDataFrame([("a.go", f"package a\n\n{same}")], "rel_path string, content string")
    assert ingest_files(store, "p", fewer, E)["chunksDeleted"] == 2 and store.rows("p").count() == 2


def test_two_roots_in_one_project(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path / "home"))
    files = spark.createDataFrame([("a/x.go", ALPHA), ("b/y.go", BETA)], "rel_path string, content string")
    ingest_files(store, "p", files, E)
    only_b = files.where("rel_path LIKE 'b/%'")
    assert ingest_files(store, "p", only_b, E, path_prefix="b/", dry_run=True)["filesDeleted"] == 0
    assert ingest_files(store, "p", only_b, E)["filesDeleted"] == 1


def test_store_buckets_deletes_and_isolation(spark, tmp_path, monkeypatch):
    store = MemoryStore(spark, str(tmp_path / "home"), rows_per_bucket=2)
    names = ["p", "007", "a/b*c _", "a_b", "a b", "..", "ü~%41"]
    for name in names:
        store.insert([{"text": f"note in {name}", "project": name, "tags": ["t"]}], E)
    assert len({project_slug(n) for n in names}) == len(names)
    assert store.projects() == sorted(names)
    for name in names:
        assert [r.project for r in store.rows(name).collect()] == [name]
    files = spark.createDataFrame([(f"f{i}.go", f"package f{i}\n\nfunc F{i}() {{}}\n") for i in range(12)], "rel_path string, content string")
    ingest_files(store, "p", files, E)  # the project outgrows its single bucket
    entry = store._manifest["projects"]["p"]
    assert entry["count"] > 4 and len(entry["buckets"]) > 1 and store.rows("p").count() == 25
    doomed = store.rows("p").where("file_path = 'f3.go'").select("id")
    id3 = doomed.first().id
    untouched = {b: f for b, f in entry["buckets"].items()}
    assert store.remove(id3, "a_b") is None
    assert store.remove(id3, "p")["file_path"] == "f3.go" and store.remove(id3, "p") is None
    changed = [b for b, f in store._manifest["projects"]["p"]["buckets"].items() if untouched.get(b) != f]
    assert len(changed) <= 1
    ids = store.rows("p").where("file_path IN ('f4.go', 'f5.go')").select("id").unionAll(spark.range(10_000, 10_005))
    assert store.remove_many(ids, "p") == 4 and store.remove_many(spark.range(9000, 9001), "p") == 0
    assert store.rows("p").count() == 20
    newest = store.insert([{"text": "again", "project": "p"}], E)[0]
    assert newest == store._manifest["next_id"] - 1 > store.rows("p").where(f"id <> {newest}").agg(F.max("id")).first()[0]
    monkeypatch.setattr(store_module, "FOLDERS_PER_BUCKET", 3)
    assert store.clear_project("a b").count() == 1 and "a b" not in store.projects()
    before = store.all_rows().count()
    assert store.vacuum() == 0 and store.vacuum(grace_hours=0) > 0 and store.all_rows().count() == before


def test_many_small_commits_are_folded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "FOLDERS_PER_BUCKET", 3)
    store = MemoryStore(spark, str(tmp_path / "home"))
    for i in range(3):
        store.insert([{"text": f"n{i}", "project": "p"}], E)
    assert len(store.folders("p")) == 3
    files = spark.createDataFrame([("a.go", ALPHA)], "rel_path string, content string")
    ingest_files(store, "p", files, E)
    assert len(store.folders("p")) == 1 and store.rows("p").count() == 6


def test_meta_and_two_writers(spark, tmp_path):
    home = str(tmp_path / "home")
    a, b = MemoryStore(spark, home), MemoryStore(spark, home)
    a.set_meta("k", "1")
    a.set_meta("k", "2")
    assert a.get_meta("k") == "2" and a.get_meta("none") is None and MemoryStore(spark, home).get_meta("k") == "2"
    with pytest.raises(ConcurrentCommit):
        b.set_meta("k", "3")
    b.set_meta("k", "4")  # after a conflict a handle goes on from the newest version
    assert MemoryStore(spark, home).get_meta("k") == "4"


def test_writers_do_not_lose_each_others_rows(spark, tmp_path):
    home = str(tmp_path / "home")
    a, b = MemoryStore(spark, home), MemoryStore(spark, home)
    assert a.insert([{"text": "one", "project": "p1"}, {"text": "two", "project": "p2"}], E) == [1, 2]
    assert a.rows("p1").count() == a.rows("p2").count() == 1
    # Planned on an old version, so written anew; and an old handle's vacuum spares what it did not know.
    assert b.insert([{"text": "three", "project": "p2"}], E) == [3]
    assert a.vacuum(grace_hours=0) == 1 and MemoryStore(spark, home).all_rows().count() == 3  # the folder of b's first attempt
    assert a.bytes("p2") > a.bytes("p1") > 0 == a.bytes("none")


def test_bulk_insert_and_load_are_one_commit_each(spark, tmp_path, monkeypatch):
    store = MemoryStore(spark, str(tmp_path / "home"))
    rows = spark.createDataFrame([(f"p{i % 3}" if i % 7 else None, f"text {i}") for i in range(60)], "project string, text string")
    assert store.insert_many(rows, E) == 60 and store._manifest["version"] == 1
    found = store.all_rows().collect()
    assert sorted(r.id for r in found) == list(range(1, 61))
    assert {(r.project, r.text) for r in found} == {(r.project or "default", r.text) for r in rows.collect()}
    fresh = MemoryStore(spark, str(tmp_path / "other"))
    monkeypatch.setattr(fresh, "_publish", lambda draft: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        fresh.load(store.all_rows(), 61, {"k": "v"})
    again = MemoryStore(spark, str(tmp_path / "other"))
    assert again.projects() == [] and again.get_meta("k") is None  # nothing of it is seen
    again.load(store.all_rows(), 61, {"k": "v"})
    assert again.all_rows().count() == 60 and again._manifest["next_id"] == 61 and again._manifest["version"] == 1


def test_limits_and_late_nuls(spark, tmp_path):
    """What a limit keeps from being read stays stored; a NUL anywhere makes a file binary."""
    store, root = MemoryStore(spark, str(tmp_path / "home")), tmp_path / "src"
    root.mkdir()
    (root / "a.md").write_text("small\n")
    (root / "b.md").write_text("line\n" * 150_000)  # above half a megabyte
    (root / "c.md").write_text("x" * 20_000 + "\0\n")
    assert ingest_tree(store, "p", str(root), E)["filesScanned"] == 2
    paths = lambda: {r.file_path for r in store.rows("p").select("file_path").distinct().collect()}
    assert paths() == {"a.md", "b.md"}
    for limits in ({"max_file_bytes": 1000}, {"max_files": 1}):
        assert ingest_tree(store, "p", str(root), E, **limits)["filesDeleted"] == 0 and paths() == {"a.md", "b.md"}
    (root / "b.md").unlink()
    assert ingest_tree(store, "p", str(root), E, max_files=1)["filesDeleted"] == 1 and paths() == {"a.md"}


def test_two_files_of_one_path_are_refused(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path / "home"))
    files = spark.createDataFrame([("a.go", "func A() {\n}\n"), ("a.go", "func B() {\n}\n")], "rel_path string, content string")
    with pytest.raises(ValueError, match="one path"):
        ingest_files(store, "p", files, E)
    assert store.projects() == []


def test_a_path_prefix_is_a_whole_folder(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path / "home"))
    files = spark.createDataFrame([("svc/a/x.md", "one\n"), ("svc/ab/y.md", "two\n")], "rel_path string, content string")
    ingest_files(store, "p", files, E)
    gone = ingest_files(store, "p", files.where("false"), E, path_prefix="svc/a")
    assert gone["filesDeleted"] == 1 and [r.file_path for r in store.rows("p").collect()] == ["svc/ab/y.md"]


OLD = "id long, text string, tags string, embedding binary, created_at string"


def _old(spark):
    import numpy as np

    vector = lambda i: bytearray(np.full(384, i / 100, dtype="<f4").tobytes())
    rows = [
        (3, "first", '["work", "x"]', vector(1), "2024-01-02T03:04:05.678Z"), (5, "second", '["a", 1, null, {"b": 2}]', vector(2), None),
        (8, "third", "broken [", vector(3), "2024-01-02T03:04:05.678Z"), (9, "fourth", None, vector(4), "2024-01-02T03:04:05.678Z"),
    ]
    return spark.createDataFrame(rows, OLD)


def test_migration(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path / "home"))
    assert migrate(store, _old(spark)) == 4 and migrate(store, _old(spark)) == 0
    rows = {r.id: r for r in store.rows("default").collect()}
    assert {i: r.tags for i, r in rows.items()} == {3: ["work", "x"], 5: ["a"], 8: [], 9: []}
    assert all(r.kind == "manual" and r.created_at == r.updated_at and r.content_hash is None for r in rows.values())
    assert [round(rows[i].embedding[7], 4) for i in (3, 5, 8, 9)] == [0.01, 0.02, 0.03, 0.04]
    assert store.get_meta("schema_version") == "2" and store.get_meta("migrated_from_version") == "1" and store.get_meta("migrated_at")
    assert store.insert([{"text": "next"}], E) == [10]


def test_migration_of_partial_and_current_tables(spark):
    old = _old(spark)
    bare = upgrade(old.drop("tags", "created_at")).collect()
    assert all(r.tags == [] and r.created_at is not None for r in bare)
    current = upgrade(old)
    assert upgrade(current).columns == current.columns and upgrade(old.where("false")).count() == 0
    with pytest.raises(ValueError, match="missing"):
        upgrade(old.drop("embedding"))


def test_tag_json(spark):
    raw = ['["a","b"]', "[]", '"a"', "{}", "", None, '[1,true,"x",["y"]]', '["q\\"uote"]']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string")
    got = [r[0] for r in df.orderBy("i").select(decode_tags(F.col("r"))).collect()]
    assert got == [["a", "b"], [], [], [], [], [], ["x"], ['q"uote']]
    assert json.loads(spark.range(1).select(encode_tags(F.array(F.lit("a"), F.lit('b"')))).first()[0]) == ["a", 'b"']


def test_ignore_rules_as_tables(spark):
    """Tables of rules and paths give what the walk gives, folder by folder."""
    from recollect.sources.ignore import ignored_paths, rule_table

    files = {
        "": "*.log\n!keep.log\n/build\ndocs/*.md\ntmp/\n[ab]?.txt\n\\#odd\n# note\n", "sub": "!x.log\nsecret\n*.md\n!deep/**/n.md\n",
        "sub/deep": "*\n!*.go\n", "a.b": "c+d\n",
    }
    names = ["x.log", "keep.log", "build", "n.md", "tmp", "ab.txt", "#odd", "secret", "c+d", "main.go", "deep"]
    folders = ["", "sub", "sub/deep", "docs", "build", "tmp", "sub/tmp", "a.b", "axb", "sub/deep/n.md", "docs/build"]
    paths = sorted({f"{f}/{n}" if f else n for f in folders for n in names})
    rules = rule_table(spark.createDataFrame(list(files.items()), "base string, content string"))
    got = {r.rel_path: r.ignored for r in ignored_paths(spark.createDataFrame([(p,) for p in paths] * 2 + [(None,)], "rel_path string"), rules).collect()}

    def walked(path):
        parts = path.split("/")
        for n in range(1, len(parts) + 1):
            above = ["/".join(parts[:k]) for k in range(n)]
            sets = [parse_rules(files[b], b) for b in above if b in files]
            if ignored("/".join(parts[:n]), n < len(parts), sets):
                return True
        return False

    assert got == {p: walked(p) for p in paths} and len(set(got.values())) == 2
