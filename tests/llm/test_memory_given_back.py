"""What tasks of the language model hold: nothing that is already handed on, and little once they are done."""

import re
import subprocess
import sys

import numpy as np

from palimpsest.llm import hpylm

MEASURED = """
import re, numpy as np
from palimpsest.llm import hpylm
size = lambda: int(re.search(r"VmRSS:\\s+(\\d+)", open("/proc/self/status").read()).group(1)) // 1024
before, draw = size(), np.random.default_rng(1)
sums = hpylm.Counts()
for _ in range(6):
    sums.add(draw.integers(0, 1 << 60, 250_000).astype(np.uint64), draw.integers(0, 1 << 60, 250_000).astype(np.uint64))
sums.settle()
print(size() - before)
"""


def test_counts_are_handed_on_once():
    sums = hpylm.Counts()
    word, context = np.array([7, 3, 7], np.uint64), np.array([1, 2, 1], np.uint64)
    sums.add(word, context)
    w, c, n = sums.by_word()
    assert (w.tolist(), c.tolist(), n.tolist()) == ([3, 7], [2, 1], [1, 2])
    assert len(sums.held[0]) == 0


def test_memory_goes_back_after_counting():
    """1.5 million pairs of 24 bytes are 36 MB; freed ones stayed with the process."""
    said = subprocess.run([sys.executable, "-c", MEASURED], capture_output=True, text=True, check=True, cwd=re.sub(r"/palimpsest/.*", "", hpylm.__file__))
    assert int(said.stdout) < 80
