"""What matching holds in Python is bounded by bytes of lines, not by their number."""

import tracemalloc

import pyarrow as pa

from ravelin.functions.anchors import STEP_BYTES, Prefilter


def test_steps_of_a_batch_give_what_whole_batches_give():
    wanted = Prefilter([(0, "(?i)eval\\s*\\("), (1, "curl")])
    lines = pa.array(["", None, "EVAL (x)", "x" * STEP_BYTES, "curl eval(", "ſ curl"] * 3)
    assert wanted.candidates(lines).to_pylist() == [[], [], [0], [], [0, 1], [1]] * 3
    assert wanted.candidates(lines.slice(4, 2)).to_pylist() == [[0, 1], [1]]
    assert wanted.candidates(pa.array([], pa.string())).to_pylist() == []


def test_memory_of_long_lines():
    wanted = Prefilter([(0, "%[0-9]")])
    wanted.candidates(pa.array(["x"]))
    lines = pa.array(["a % of words " * 8000] * 200)
    tracemalloc.start()
    wanted.candidates(lines)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 12 * STEP_BYTES
