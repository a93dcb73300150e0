import ctypes
import subprocess
import sys

import pytest

RETAINED = """
import re
import numpy as np
from auditspark.llm.common import per_process, release

def mb():
    return int(re.search(r"VmRSS:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

def make():
    held = [np.ones(64 << 10, np.uint8) for _ in range(3200)]
    above.append(np.ones(64 << 10, np.uint8))  # freed memory below it is not at the end
    return held

above, start = [], mb()
per_process("one", make, large=True)
full = mb()
release()
print(start, full, mb())
"""


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="another C library")
def test_release_gives_memory_back():
    run = subprocess.run([sys.executable, "-c", RETAINED], capture_output=True, text=True, check=True)
    start, full, after = map(float, run.stdout.split())
    assert full - start > 150 and after - start < 40
