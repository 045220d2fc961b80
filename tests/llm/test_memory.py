"""Peak memory of the workers' functions over a batch of very long texts, in a process of their own."""

import os
import subprocess
import sys

import pytest

RUN = """
import random, re, sys, threading, time
import numpy as np, pandas, pyarrow as pa, pyarrow.compute
from tenderlens.llm import line_dedup, quality_rules, substring_dedup, suffix_dedup, textvec

def now():
    return int(re.search(r"Pss_Anon: +(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

rng = random.Random(1)
words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
def text(size):
    t = " ".join(rng.choice(words) + ("\\n" if rng.random() < 0.05 else "") for _ in range(size // 5))
    return t[:size]
texts = [text(100_000) for _ in range(int(sys.argv[2]))] + [text(int(sys.argv[3]))]
ids = pa.array(range(len(texts)), pa.int64())
batch = pa.RecordBatch.from_pydict({"doc_id": ids, "key": ids, "content": ids, "text": pa.array(texts)})
del texts

def anchors(batches):
    for b in batches:
        for _, part in textvec.blocks(b):
            x = suffix_dedup.Anchors(part, 400)
            yield x.h[0].of(*x.strings()[1:])
            for p in x.starts():
                yield x.inner(p)

run = {"op2": substring_dedup._whole, "op5": quality_rules._measures, "op8": anchors, "op10": line_dedup._facts(line_dedup.BANDS)}[sys.argv[1]]
base, peak, done = now(), 0, False
def watch():
    global peak
    while not done:
        peak = max(peak, now())
        time.sleep(0.005)
t = threading.Thread(target=watch)
t.start()
for _ in run([batch]):
    pass
done = True
t.join()
print(peak - base)
"""


def peak(op, texts, longest):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = os.environ | {"PYTHONPATH": root, "OMP_NUM_THREADS": "1"}
    return float(subprocess.run([sys.executable, "-c", RUN, op, str(texts), str(longest)], env=env, capture_output=True, text=True, check=True).stdout)


@pytest.mark.parametrize("op", ["op2", "op5", "op8", "op10"])
def test_memory_follows_the_block_not_the_batch(op):
    assert peak(op, 200, 100_000) < 60


@pytest.mark.parametrize("op", ["op2", "op5", "op8", "op10"])
def test_one_very_long_text(op):
    assert peak(op, 1, 5_000_000) < 250
