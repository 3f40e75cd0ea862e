"""Very long texts: the same results as in one piece, and a bounded memory."""

import random
import subprocess
import sys

import numpy as np
import pytest

from kinspark.llm import crf, imatch, mil, neardup, rules, text as T

from .conftest import sentence_text

KERNELS = {
    "crf": lambda c: crf.line_features(c),
    "mil": lambda c: (*mil.sentences(c), *mil.word_features(c)),
    "rules": lambda c: (rules.measure(c),),
    "neardup": lambda c: neardup.shingle_sets(c, 4),
    "imatch": lambda c: imatch.terms(c),
}


@pytest.mark.parametrize("name", KERNELS)
def test_segments_change_nothing(monkeypatch, name):
    rng = random.Random(3)
    raw = (sentence_text(rng, 900) + "\n" + "x" * 3000 + " é " + sentence_text(rng, 300)).encode()
    whole = KERNELS[name](T.Chunk([raw]))
    monkeypatch.setattr(T, "GIANT", 100)
    monkeypatch.setattr(T, "CHUNK_BYTES", 1000)
    for a, b in zip(whole, KERNELS[name](T.Chunk([raw])), strict=True):
        assert np.array_equal(a, b)


USE = """
import resource, sys
import numpy as np, pyarrow as pa
sys.path.insert(0, {root!r})
from kinspark.llm import crf, imatch, mil, neardup, rules, text as T
rng = np.random.default_rng(0)
words = np.array(["w%dx" % k for k in range(30000)])
text = "\\n".join(" ".join(words[rng.integers(0, 30000, 12)]) for _ in range({mb} * 13000))
column = pa.array([text])
size = len(text)
del text
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
if {name!r} == "crf":
    crf.Model().score(column)
elif {name!r} == "mil":
    mil.Model().score(column)
elif {name!r} == "rules":
    rules.Model(None, 2.0).judge(column)
elif {name!r} == "neardup":
    [neardup.bands(s) for _, _, c in T.chunks(column) for s in neardup.shingle_sets(c, 4)]
else:
    lexicon = np.zeros(0, np.uint64)
    [imatch.fingerprints(c, lexicon, imatch._member_table(lexicon)) for _, _, c in T.chunks(column)]
print(size >> 20, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10)
"""


@pytest.mark.parametrize("name", ["crf", "mil", "rules", "neardup", "imatch"])
def test_a_text_of_many_megabytes_takes_bounded_memory(name):
    root = __file__.rsplit("/tests/", 1)[0]
    out = subprocess.run([sys.executable, "-c", USE.format(root=root, name=name, mb=50)], capture_output=True, text=True, timeout=300)
    size, used = map(int, out.stdout.split())
    assert size >= 40 and used < 20 * size + 200, (size, used)
