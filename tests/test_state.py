"""Unchanged files are not read again, and nothing else is taken for unchanged."""

import os
import time

import pytest

from recollect.functions.embedding import HashingEmbedder
from recollect.plans import ingest
from recollect.sources.chunker import ChunkOptions
from recollect.sources.store import MemoryStore

FILES = {
    "one.py": "def area(w, h):\n    return w * h\n\n\ndef edge(w, h):\n    return 2 * (w + h)\n",
    "sub/two.go": "package sub\n\nfunc Twice(n int) int {\n\treturn 2 * n\n}\n",
    "notes.md": "# Shapes\n\nAreas and edges.\n",
    "blob.bin": "a\0b",
}


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    time.sleep(0.15)  # beyond the span in which a file may change unseen
    return root


@pytest.fixture
def store(spark, tmp_path):
    return MemoryStore(spark, str(tmp_path / "home"))


def run(store, root, **options):
    out = ingest.ingest_tree(store, "shop", str(root), HashingEmbedder(), **options)
    return {k: v for k, v in out.items() if k not in ("elapsedMs", "root", "project", "dryRun")}


def test_unchanged_files_are_not_read(store, tree, monkeypatch):
    first = run(store, tree)
    rows = sorted(map(tuple, store.rows("shop").select("id", "content_hash").collect()))

    def never(*_):
        raise AssertionError("read again")

    monkeypatch.setattr(ingest, "read_contents", never)
    again = run(store, tree)
    assert again["chunksUnchanged"] == again["totalChunks"] == first["totalChunks"] and again["byLanguage"] == first["byLanguage"]
    assert (again["filesScanned"], again["filesSkipped"]) == (first["filesScanned"], first["filesSkipped"]) == (3, 1)
    assert (again["chunksEmbedded"], again["filesChanged"], again["filesDeleted"]) == (0, 0, 0)
    assert rows == sorted(map(tuple, store.rows("shop").select("id", "content_hash").collect()))
    with pytest.raises(AssertionError):  # other chunk sizes: another state
        run(store, tree, options=ChunkOptions(window=50))


def test_same_size_edit_with_time_put_back(store, tree):
    run(store, tree)
    path = tree / "one.py"
    before = path.stat()
    path.write_text(FILES["one.py"].replace("w * h", "h * w"))
    os.utime(path, ns=(before.st_atime_ns, before.st_mtime_ns))
    assert path.stat().st_size == before.st_size and path.stat().st_mtime_ns == before.st_mtime_ns
    edited = run(store, tree)
    assert (edited["filesChanged"], edited["chunksCreated"], edited["chunksDeleted"]) == (1, 1, 1)
    assert edited["filesScanned"] == 3 and any("h * w" in r.text for r in store.rows("shop").select("text").collect())


def test_stored_chunks_that_changed_are_made_again(store, tree):
    first = run(store, tree)
    lost = store.rows("shop").where("file_path = 'sub/two.go'").first()
    store.remove(lost.id, "shop")
    assert run(store, tree)["chunksCreated"] == 1
    assert run(store, tree)["chunksUnchanged"] == first["totalChunks"]


def test_vanished_and_new_files(store, tree):
    first = run(store, tree)
    own = store.rows("shop").where("file_path = 'notes.md'").count()
    (tree / "notes.md").unlink()
    gone = run(store, tree)
    assert gone["filesDeleted"] == 1 and gone["chunksUnchanged"] == first["totalChunks"] - own
    (tree / "notes.md").write_text(FILES["notes.md"])
    assert run(store, tree, dry_run=True)["chunksCreated"] == own
    back = run(store, tree)
    assert back["chunksCreated"] == own and back["totalChunks"] == first["totalChunks"]
    fresh = run(store, tree)  # written just now: read once more, and nothing found
    assert fresh["chunksUnchanged"] == first["totalChunks"] and fresh["chunksCreated"] == 0


def test_limits_leave_unread_files_alone(store, tree):
    first = run(store, tree)
    small = run(store, tree, max_file_bytes=30)
    assert small["filesDeleted"] == 0 and store.rows("shop").count() == first["totalChunks"]


def test_embedding_time_and_batch_size(spark, store, tree, tmp_path):
    import json

    from recollect.engine import Engine

    assert run(store, tree)["embedMs"] > 0 and run(store, tree)["embedMs"] == 0
    engine = Engine(spark, str(tmp_path / "other"))
    assert json.loads(engine.ingest_codebase(str(tree), "shop", batch_size=4))["chunksCreated"] > 0
    with pytest.raises(ValueError):
        engine.ingest_codebase(str(tree), "shop", batch_size=257)
