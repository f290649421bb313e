"""One very long text in bounded memory: each case in a process of its own, with its peak beyond what it held before."""

import subprocess
import sys

import pytest

SIZE = 30_000_000
MAKE = f"""
import resource, sys
import numpy as np
import pyarrow as pa
rng = np.random.default_rng(1)
letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz     ", np.uint8)
text = letters[rng.integers(0, len(letters), {SIZE})].tobytes().decode()
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
"""
CASES = {
    "near copies": "from stratum.llm import minhash as M\nM.signatures(*M.shingles(['small text'])[:2], 1)\nbefore = peak()\ndoc, h, _ = M.shingles([text])\nM.signatures(doc, h, 1)",
    "language": "from stratum.llm import langid as L\nL.gram_counts('small')\nbefore = peak()\nL.gram_counts(text)",
    "repeats": "from stratum.llm import repeats as R\nraw = text.encode()\nbefore = peak()\nfor at in range(0, len(raw), R.STRETCH):\n    R.find_runs(np.frombuffer(raw[at : at + R.STRETCH + 199], np.uint8), 200)",
    "quality": "from stratum.llm import quality as Q\nbefore = peak()\nQ.text_features(text)",
    "tokens": "import public_tokenizers\nfrom stratum.llm.tokens import IdBytes\nids = IdBytes(public_tokenizers.path('byte_bpe_50k.json'))\nids('small')\nbefore = peak()\nids(text)",
}


@pytest.mark.parametrize("case", CASES)
def test_a_very_long_text(case):
    import os

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"import sys\nsys.path.insert(0, {root!r})\n{MAKE}\n{CASES[case]}\nprint(int(peak() - before))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) < 1000, f"{out.stdout.strip()} MB for a text of {SIZE // 10**6} MB"
