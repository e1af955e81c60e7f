import random

import corpus
import oracle
import pytest

from recollect.operators.diff import by_language
from recollect.sources import chunker
from recollect.sources.chunker import ChunkOptions, chunk_files

GO = '''// Package gauge reads tank levels.
package gauge

type Reader interface {
	Level() (float64, error)
}

func (t *tank) Level() (float64, error) { return t.level, nil }

const (
	low  = 1
	high = 9
)

// Mean of the readers that answer.
// Zero without any.
func Mean(readers ...Reader) (mean float64) {
	for _, r := range readers {
		if x, err := r.Level(); err == nil {
			mean += x / float64(len(readers))
		}
	}
	return mean
}
'''

TRICKY_GO = '''package tricky

func First() string {
	a := "} not a brace {"
	b := `a raw string {
func Fake() {
}`
	c := '{' // a comment {
	/* func Other() {
	*/
	return a + b + string(c)
}

func Second() int {
	return 2
}
'''

TS = '''import { a } from "./a";

export interface Shape {
  sides: number;
}

export type Name = string;

const LIMIT = 3;

export async function load(id: string): Promise<string> {
  return `${id}: { ${a} `;
}

export class Box {
  open() { return 1; }

  close() { return 2; }
}

export const twice = (x: number) => {
  return 2 * x;
};

export default twice;
'''

PYTHON = '''"""Tools {for
def nothing():
tests."""
import os

LIMIT = 3


# Boxes hold things.
@register
@frozen
class Box:
    def open(self):
        return "("

    def close(self):
        return 2


def first(x):
    """Return x (and more."""
    return x


@cached
async def second(
    a,
    b,
):
    return a
'''


def _chunks(spark, files, **options):
    df = spark.createDataFrame(list(files.items()), "rel_path string, content string")
    return chunk_files(df, ChunkOptions.of(**options)).orderBy("rel_path", "ordinal").collect()


def _units(rows, path):
    return [(r.unit_kind, r.unit, r.start_line, r.end_line) for r in rows if r.rel_path == path]


def _covers(text, rows):
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    covered = {n for r in rows for n in range(r.start_line, r.end_line + 1)}
    assert all(not oracle.words(line) or n in covered for n, line in enumerate(lines, 1))
    for r in rows:
        assert r.content == "\n".join(lines[r.start_line - 1 : r.end_line])


@pytest.fixture(scope="module")
def units(spark):
    files = {"a.go": GO, "t.go": TRICKY_GO, "b.ts": TS, "c.py": PYTHON, "w.go": GO.replace("\n", "\r\n")}
    rows = _chunks(spark, files)
    for path, text in files.items():
        _covers(text, [r for r in rows if r.rel_path == path])
    return rows


def test_go_units(units):
    assert _units(units, "a.go") == [
        ("preamble", "", 1, 3), ("interface", "Reader", 4, 6), ("method", "Level", 8, 8),
        ("block", "", 9, 13), ("func", "Mean", 14, 24),
    ]
    assert _units(units, "w.go") == _units(units, "a.go")


def test_literals_and_comments_do_not_open_blocks(units):
    assert [u[:2] for u in _units(units, "t.go")] == [("preamble", ""), ("func", "First"), ("func", "Second")]


def test_typescript_units(units):
    found = _units(units, "b.ts")
    assert [u[:2] for u in found if u[0] in oracle.MAJOR] == [
        ("interface", "Shape"), ("type", "Name"), ("function", "load"), ("class", "Box"), ("function", "twice"),
    ]
    box = next(r for r in units if r.rel_path == "b.ts" and r.unit == "Box")
    assert "open()" in box.content and "close()" in box.content


def test_python_units_keep_decorators_and_do_not_overlap(units):
    found = _units(units, "c.py")
    assert [u[:2] for u in found if u[0] in oracle.MAJOR] == [("class", "Box"), ("function", "first"), ("function", "second")]
    assert all(a[3] < b[2] for a, b in zip(found, found[1:]))
    box, second = (next(r for r in units if r.rel_path == "c.py" and r.unit == u) for u in ("Box", "second"))
    assert box.content.lstrip("\n").startswith("# Boxes hold things.\n@register\n@frozen\nclass Box")
    assert second.content.startswith("@cached\nasync def second(")


def test_oversize_units_are_cut_with_overlap_and_keep_their_name(spark):
    text = "func Big() {\n" + "\twork()\n" * 400 + "}\n"
    rows = _chunks(spark, {"big.go": text}, max_lines=100, split_overlap=20)
    assert len(rows) >= 4 and all(r.unit == "Big" and r.end_line - r.start_line < 100 for r in rows)
    assert all(b.start_line == a.start_line + 80 for a, b in zip(rows, rows[1:]))
    _covers(text, rows)
    long_lines = "func Wide() {\n" + ("\t" + "x" * 200 + "\n") * 60 + "}\n"
    assert len(_chunks(spark, {"wide.go": long_lines})) == 1  # only lines are cut


def test_degenerate_files(spark):
    rows = _chunks(spark, {"e.go": "", "b.txt": " \n\n\t\n", "one.md": "just one line", "none.go": "x y\nz\n", "n.py": "\n\n"})
    assert [(r.rel_path, r.unit_kind) for r in rows] == [("none.go", "lines"), ("one.md", "lines")]


@pytest.mark.parametrize("options", [{}, {"window": 50, "overlap": 10}, {"window": 5, "overlap": 0}, {"window": 9, "overlap": 8}, {"window": 3, "overlap": 7}])
def test_line_windows(spark, options):
    rng = random.Random(3)
    files = {}
    for n in (1, 2, 7, 8, 9, 30, 48, 49, 60, 61, 108, 200, 333):
        for blank in (0.0, 0.15, 0.6):
            files[f"f{n}_{blank}.md"] = "\n".join("" if rng.random() < blank else f"line {i}" for i in range(n))
    rows = _chunks(spark, files, **options)
    for path, text in files.items():
        mine = [r for r in rows if r.rel_path == path]
        lines = text.split("\n")
        lines = lines[:-1] if len(lines) > 1 and not lines[-1] else lines
        oracle.check_windows(lines, [(r.start_line - 1, r.end_line - 1) for r in mine], **options)
        _covers(text, mine)


def test_small_spans_merge(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for f in range(60):
        at, spans = 0, []
        for _ in range(rng.randrange(1, 14)):
            size = rng.choice([1, 1, 2, 3, 4, 5, 9])
            spans.append((at, at + size - 1, rng.choice(["var", "preamble", "func", "binding"]), f"u{at}"))
            at += size
        rows += [(f"f{f}", *s) for s in spans]
        want[f"f{f}"] = spans
    df = spark.createDataFrame(rows, "rel_path string, start int, end int, kind string, unit string")
    got = chunker._merge_small(df, 4).orderBy("rel_path", "start").collect()
    for path, spans in want.items():
        oracle.check_merging(spans, [(r.start, r.end, r.kind, r.unit) for r in got if r.rel_path == path])


def test_random_code_is_covered_and_keeps_brackets_balanced(spark):
    rng = random.Random(7)
    pieces = ["func F{}() {{\n\ta()\n}}", "// note {}", "var x{} = 1", "type T{} struct {{\n\tb int\n}}", "", "/* open {} {{\n}} */", "const s{} = `{{\n`", "x{} := '{{'"]
    files = {f"r{i}.go": "\n".join(rng.choice(pieces).format(j) for j in range(40)) + "\n" for i in range(20)}
    rows = _chunks(spark, files)
    for path, text in files.items():
        mine = [r for r in rows if r.rel_path == path]
        _covers(text, mine)
        assert all(a.end_line < b.start_line for a, b in zip(mine, mine[1:]))
        functions = [r for r in mine if r.unit_kind == "func"]
        assert len(functions) == text.count("func F")


def test_published_chunk_counts(spark):
    files = spark.createDataFrame(list(corpus.files("orchard")), "rel_path string, content string")
    counts = {r.lang: r.chunks for r in by_language(chunk_files(files)).collect()}
    assert counts == {"go": 4581, "python": 4572, "ts": 4072}


def test_one_exchange_serves_the_scan(spark):
    df = spark.createDataFrame([("a.go", GO)], "rel_path string, content string")
    plan = chunker.chunk_code_files(df)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.split("\n") if " Exchange " in line]
    assert len(exchanges) == 2 and all("REPARTITION_BY_COL" in line for line in exchanges)
    # Both are the same exchange, so the second one is reused when the query runs.
    assert len({line.split("Exchange")[1].split(",")[1] for line in exchanges}) == 1


def test_contents_are_read_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame([(f"a{i}.go", GO) for i in range(20)], "rel_path string, content string")
    chunks = chunker.chunk_code_files(df.mapInArrow(count, df.schema))
    assert chunks.count() == 100 and reads.value == 20


def test_languages_of_chunks(spark):
    rows = _chunks(spark, {"a.go": GO, "b.tsx": TS, "c.jsx": TS, "d.pyi": PYTHON, "e.rs": "fn main() {}\n"})
    assert {r.rel_path: r.lang for r in rows} == {"a.go": "go", "b.tsx": "ts", "c.jsx": "js", "d.pyi": "python", "e.rs": "text"}
