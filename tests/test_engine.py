import os
import re

import pytest

from recollect import cli
from recollect.engine import Engine, project_name, tag_list
from recollect.operators import knn
from recollect.plans import recall as plan
from recollect.render import hit_line, list_line, recall_header

CHECKSUM = """def frame_checksum(payload, seed):
    value = seed
    for position, octet in enumerate(payload):
        value = (value * 31 + octet + position) & 0xFFFF
    return value
"""
MIXER = "def blend_paints(shades, ratios):\n" + "".join(f"    shade{i} = stir(shades[{i}], ratios, minutes={i})\n" for i in range(25)) + "    return pour(shade24)\n"
GAUGE = "interface Needle { angle: number }\n\nexport const swing = (needle: Needle, pressure: number) => {\n  needle.angle = Math.min(270, pressure * 3);\n  return needle;\n};\n"


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    return Engine(spark, str(tmp_path_factory.mktemp("engine") / "home"))


@pytest.fixture(scope="module")
def code(engine, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("code"))
    files = {
        "drivers/uart.py": "import serial\n\n\n" + CHECKSUM, "drivers/radio.py": "import antenna\n\n\n" + CHECKSUM,
        "workshop/mixer.py": "import paint\n\n\n" + MIXER, "panel/gauge.ts": GAUGE,
    }
    for rel, text in files.items():
        os.makedirs(os.path.dirname(os.path.join(root, rel)), exist_ok=True)
        with open(os.path.join(root, rel), "w") as handle:
            handle.write(text)
    engine.ingest_codebase(root, "plant")
    return "plant"


def _ids(text):
    return [int(i) for i in re.findall(r"^\[(\d+)\]", text, re.M)]


def test_notes_from_start_to_end(engine):
    assert engine.recall("anything", project="fresh") == "No memories stored in project 'fresh' yet."
    assert engine.list_memories(project="fresh") == "No memories in project 'fresh'."
    said = engine.remember("The budget meeting is on Monday", "Work,  work plans")
    first = int(re.search(r"id=(\d+)", said)[1])
    assert said == f"Remembered (id={first}, project=default, tags=work,plans): The budget meeting is on Monday"
    engine.remember("Grandmother bakes apple cake", "family")
    third = engine.remember("Trains to the coast leave hourly")
    assert "tags" not in third
    found = engine.recall("when is the budget meeting", limit=1).split("\n")
    assert re.fullmatch(r"# 1 result\(s\) from project 'default' \(~\d+ tokens\)", found[0])
    assert re.fullmatch(rf"\[{first}\] \(score=0\.\d{{4}}, tags=work,plans\) The budget meeting is on Monday", found[1])
    listed = engine.list_memories()
    assert listed.startswith("# 3 memories in project 'default'") and _ids(listed) == [first + 2, first + 1, first]
    assert _ids(engine.list_memories(tag=" FAMILY")) == [first + 1]
    assert engine.list_memories(tag="none") == "No memories tagged 'none' in project 'default'."
    assert len(_ids(engine.list_memories(limit=2))) == 2
    assert engine.forget(first, "fresh") == f"No memory found with id={first} in project 'fresh'."
    assert engine.forget(first) == f"Deleted memory (id={first}) from project 'default'."
    assert first not in _ids(engine.recall("when is the budget meeting"))


def test_projects_are_isolated(engine):
    engine.remember("rotate the shared signing keys", project="north")
    engine.remember("rotate the shared signing keys", project="south")
    engine.remember("only the north knows the heron", project="north")
    assert len(_ids(engine.recall("heron", project="north"))) == 2
    assert "heron" not in engine.recall("heron", project="south")
    assert "heron" not in engine.list_memories(project="south")
    assert re.search(r"^north: 2 memories \(2 indexed\)$", engine.list_projects(), re.M)


def test_budget_bounds_the_answer(engine, code):
    query = "checksum of a frame payload"
    big, small = (engine.recall(query, project=code, max_tokens=n) for n in (4000, 150))
    used = [int(re.search(r"using (\d+)/", a)[1]) for a in (big, small)]
    assert used[0] <= 4000 and used[1] <= 150
    assert len(_ids(small)) < len(_ids(big)) and _ids(small)[0] == _ids(big)[0]
    assert "dropped by budget/dedup" in small.split("\n")[0]


def test_identical_code_is_answered_once(engine, code):
    answer = engine.recall("frame_checksum payload seed", project=code, max_tokens=6000, limit=50)
    assert answer.count("def frame_checksum") == 1 and len(set(_ids(answer))) == len(_ids(answer))
    result = engine.search("frame_checksum payload seed", project=code, max_tokens=6000)
    assert result.candidates == result.survivors == 7
    assert all(h["file_path"] and h["line_start"] for h in result.hits)


def test_limits_scores_and_headers_only(engine, code):
    assert len(_ids(engine.recall("checksum", project=code, limit=1))) == 1
    assert len(_ids(engine.recall("checksum", project=code))) == 5
    strict = engine.recall("nothing like any of this", project=code, min_score=0.99)
    assert strict == f"No matching memories in project '{code}' above score=0.99."
    bare = engine.recall("blend paint shades", project=code, include_text=False).split("\n")[1:]
    assert all(re.fullmatch(r"\[\d+\] \(score=-?\d\.\d{4}, [^ ]+:\d+-\d+\)", line) for line in bare)


def test_warm_vectors_follow_the_table(engine, code):
    n = engine.warm(code)
    assert n == 8
    before = engine.search("blend paint shades", project=code)
    engine.remember("a note: blend paint shades", project=code)
    after = engine.search("blend paint shades", project=code)
    assert {h["id"] for h in after.hits} - {h["id"] for h in before.hits}
    stats = engine.index_stats(code)
    assert stats["live"] == 9 and stats["bytes"] > 0 and len(stats["digest"]) == 16
    assert engine.index_stats("nowhere") == {"live": 0, "digest": None, "bytes": 0}


def test_many_queries_give_the_same_answers(engine, code, spark):
    asked = [(1, code, "checksum of a frame payload", 5, None, None), (2, code, "blend paint shades", 2, None, None), (3, code, "needle pressure", 5, 120, None), (4, code, "checksum", 5, None, 0.9), (5, "nowhere", "x", 5, None, None)]
    queries = spark.createDataFrame(asked, "query_id long, project string, query string, limit int, max_tokens int, min_score double")
    rows = engine.recall_many(queries).where("chosen").orderBy("query_id", "rank").collect()
    for query_id, project, query, limit, max_tokens, min_score in asked:
        single = engine.search(query, limit, project, max_tokens, min_score)
        assert [(r.id, r.score, r.cost) for r in rows if r.query_id == query_id] == [(h["id"], h["score"], h["cost"]) for h in single.hits]
    stats = {r.query_id: r for r in engine.recall_many_stats(queries).collect()}
    assert stats[3].tokens_used <= 120 and stats[2].returned == 2


def test_hits_beyond_the_broadcast_bound_give_the_same_answers(engine, code, spark, monkeypatch):
    queries = spark.createDataFrame([(1, code, "frame checksum"), (2, code, "blend paint shades")], "query_id long, project string, query string")
    columns = ["query_id", "rank", "id", "score", "cost", "candidates", "survivors"]
    want = {tuple(r) for r in engine.recall_many(queries).select(*columns).collect()}
    monkeypatch.setattr(plan, "BROADCAST_HITS", 0)
    monkeypatch.setattr(knn, "BROADCAST_QUERIES", 1)
    assert {tuple(r) for r in engine.recall_many(queries).select(*columns).collect()} == want


def test_a_third_of_the_rows_being_copies_leaves_one_of_them(engine, spark):
    rows = [{"text": f"note {i} about topic {i * 7}", "project": "copies"} for i in range(20)]
    rows += [{"text": "the very same words once more", "project": "copies"} for _ in range(10)]
    engine.store.insert(rows, engine.embedder)
    result = engine.search("the very same words once more", project="copies", max_tokens=100_000)
    assert result.candidates == 30 and sum(h["text"].startswith("the very") for h in result.hits) == 1
    assert result.hits[0]["text"].startswith("the very") and result.survivors == 21


def test_copies_beyond_the_first_round(engine, spark):
    """More copies than are fetched first, near copies that only de-duplication tells, and a few others."""
    near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty "
    rows = [("flood", "the same note again and again")] * 450 + [("flood", near * 3 + str(i)) for i in range(450)] + [("flood", f"other note {i}") for i in range(5)]
    assert engine.store.insert_many(spark.createDataFrame(rows, "project string, text string"), engine.embedder) == 905
    for query in ("the same note again", "seven eight nine ten"):
        result = engine.search(query, project="flood", max_tokens=100_000)
        assert len(result.hits) == result.survivors == 7 and result.truncated == 0
    assert len(engine.search("seven eight nine ten", 6, "flood").hits) == 6
    queries = spark.createDataFrame([(1, "flood", "seven eight nine ten", 100_000), (1, "copies", "no project of this kind", 50)], "query_id long, project string, query string, max_tokens int")
    assert engine.recall_many(queries).where("chosen AND project = 'flood'").count() == 7


def test_every_query_has_its_counters(engine, code, spark):
    asked = [(1, code, "checksum", None), (2, code, "checksum", 0.999), (1, "no such project", "checksum", None)]
    queries = spark.createDataFrame(asked, "query_id long, project string, query string, min_score double")
    rows = {(r.project, r.query_id): r for r in engine.recall_many_stats(queries).collect()}
    assert len(rows) == 3 and rows["no such project", 1].candidates == rows["no such project", 1].returned == 0
    assert rows[code, 2].candidates > 0 and rows[code, 2].returned == 0 and rows[code, 1].returned > 0


@pytest.mark.parametrize(
    "call",
    [
        lambda e: e.remember(""), lambda e: e.recall(""), lambda e: e.recall("x", limit=0), lambda e: e.recall("x", limit=201),
        lambda e: e.recall("x", max_tokens=0), lambda e: e.recall("x", max_tokens=200_001), lambda e: e.recall("x", min_score=1.5),
        lambda e: e.forget(0), lambda e: e.list_memories(limit=1001), lambda e: e.list_memories(kind="other"),
        lambda e: e.ingest_codebase("/tmp", ""), lambda e: e.ingest_codebase("/tmp", "p", chunk_overlap=-1), lambda e: e.ingest_codebase("/tmp", "p", chunk_lines=0),
    ],
)
def test_arguments_are_checked(engine, call):
    with pytest.raises(ValueError):
        call(engine)


def test_names_and_rendering():
    assert project_name(" \t﻿") == project_name(None) == "default" and project_name(" a b ") == "a b"
    assert tag_list("B, a  b,,") == ["b", "a"] and tag_list(None) == []
    row = dict(id=3, kind="code", text="x" * 300, tags=["func"], file_path="a.go", line_start=1, line_end=9, score=0.12345, created_at="T")
    assert hit_line(row).startswith("[3] (score=0.1235, a.go:1-9) xxx") or hit_line(row).startswith("[3] (score=0.1234, a.go:1-9) xxx")
    assert hit_line({**row, "kind": "manual", "file_path": None}, False) == "[3] (score=0.1235, tags=func)".replace("0.1235", f"{0.12345:.4f}")
    assert list_line(row) == "[3] (T, a.go:1-9, tags=func) " + "x" * 200 + "…"
    assert len(list_line(row, 160).split(") ")[1]) == 161
    assert recall_header("p", 2, 10, None, 5) == "# 2 result(s) from project 'p' (~10 tokens)"
    assert recall_header("p", 2, 10, 20, 5) == "# 2 result(s) from project 'p' using 10/20 tokens (3 lower-ranked dropped by budget/dedup)"
    assert recall_header("p", 2, 10, 20, 2) == "# 2 result(s) from project 'p' using 10/20 tokens"


def test_command_line(engine, code, capsys, monkeypatch, tmp_path):
    def run(*argv):
        status = cli.run(engine, cli.arguments().parse_args(argv))
        return status, capsys.readouterr()

    status, out = run("remember", "call", "the", "plumber", "--tags", "home", "--project", "cli")
    assert status == 0 and out.out.endswith("call the plumber\n") and "remember" not in out.out
    id = re.search(r"id=(\d+)", out.out)[1]
    assert f"[{id}]" in run("recall", "plumber", "--project", "cli")[1].out
    assert run("list", "--project", "cli", "--tag", "HOME")[1].out.startswith(f"[{id}] (")
    assert "cli: 1 memories" in run("projects")[1].out
    assert run("forget", id, "--project", "other")[0] == 1
    assert run("forget", id, "--project", "cli")[0] == 0
    assert "No memories" in run("list", "--project", "cli")[1].out
    (tmp_path / "a.md").write_text("hello\n")
    assert '"chunksCreated": 1' in run("ingest", str(tmp_path), "--project", "cli", "--dry-run")[1].out
    assert run("recall", "x", "--project", code, "--max-tokens", "200", "--min-score", "-1")[0] == 0
    monkeypatch.setenv("RECOLLECT_HOME", "/data/home")
    assert cli.main(["db"]) == 0 and "/data/home/memories" in capsys.readouterr().out
    assert cli.main(["version"]) == 0
    for wrong in (["ingest", "x"], ["forget", "x"], ["unknown"], []):
        with pytest.raises(SystemExit):
            cli.arguments().parse_args(wrong)
