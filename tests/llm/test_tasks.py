"""What a worker keeps of a task's memory."""

import pathlib
import subprocess
import sys

TASK = """
import os, pyarrow as pa
from tapeline.llm.tasks import lean
kept = []
def held():
    return int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGESIZE") >> 20
def run(batches):
    for batch in batches:
        texts = [bytes(2048 + i % 2) for i in range(100_000)]
        kept.extend(texts[::100])  # so that what is free lies between what is not
        yield batch
before = held()
list({task}(iter([pa.record_batch([pa.array([1])], names=["n"])])))
print(held() - before)
"""


def grown(task: str) -> int:
    root = str(pathlib.Path(__file__).parents[2])
    return int(subprocess.run([sys.executable, "-c", TASK.replace("{task}", task)], cwd=root, capture_output=True, text=True, check=True).stdout)


def test_a_worker_gives_back_what_its_task_took():
    assert grown("run") > 100 and grown("lean(run)") < 60
