"""A synthetic code base from counts alone: so many modules of so many files, eight functions to a
file, Go, TypeScript and Python in turn. Everything else is drawn from the words below."""

import random

MODULES = {"orchard": 14, "harbour": 9}
FILES_PER_MODULE, FUNCTIONS = 109, 8
SUBJECTS = ["tide", "pallet", "crate", "beacon", "pump", "valve", "sensor", "winch", "ballast"]
ACTIONS = ["measure", "stack", "inspect", "drain", "align", "weigh", "sort"]


def _names(rng, n):
    return [f"{rng.choice(ACTIONS)}_{rng.choice(SUBJECTS)}_{n}_{k}" for k in range(FUNCTIONS)]


def _camel(name, first_upper):
    parts = name.split("_")
    head = parts[0].capitalize() if first_upper else parts[0]
    return head + "".join(p.capitalize() for p in parts[1:])


def _go(rng, n):
    out = ["package yard", "", 'import "math"', ""]
    for name in _names(rng, n):
        a, b = rng.randint(2, 90), rng.randint(2, 90)
        out += [
            f"func {_camel(name, True)}(levels []float64) float64 {{", f"\tbest := math.Inf({rng.choice([-1, 1])})",
            "\tfor i, level := range levels {", f"\t\tif i%{a} == 0 && level > {b}.5 {{", f"\t\t\tbest = math.Max(best, level/{a})",
            "\t\t}", "\t}", "\treturn best", "}", "",
        ]
    return "go", "\n".join(out)


def _ts(rng, n):
    out = []
    for name in _names(rng, n):
        a, b = rng.randint(2, 90), rng.randint(2, 90)
        out += [
            f"/** {name.replace('_', ' ')} above {a}. */", f"export function {_camel(name, False)}(rows: number[]): number {{",
            f"  let total = {b};", "  for (const row of rows) {", f"    if (row > {a}) total += row % {b};", "  }", "  return total;", "}", "",
        ]
    return "ts", "\n".join(out)


def _python(rng, n):
    out = ["from collections import deque", "", ""]
    for name in _names(rng, n):
        a, b = rng.randint(2, 90), rng.randint(2, 90)
        out += [
            f"def {name}(readings, window={a}):", f"    recent = deque(maxlen={b})", "    for reading in readings:",
            f"        if reading >= window + {b}:", "            recent.append(reading)", "    return sum(recent)", "", "",
        ]
    return "py", "\n".join(out)


def files(project, files_per_module=FILES_PER_MODULE):
    """``(path, content)`` of every file."""
    for n in range(MODULES[project] * files_per_module):
        suffix, text = (_go, _ts, _python)[n % 3](random.Random(f"{project} {n}"), n)
        yield f"{project}/area{n // files_per_module}/part{n}.{suffix}", text


def questions(project, count):
    rng = random.Random(f"questions {project}")
    return [f"{rng.choice(ACTIONS)} the {rng.choice(SUBJECTS)} in area {rng.randrange(MODULES[project])}" for _ in range(count)]
