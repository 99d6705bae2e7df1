"""Task code must run on executors that have no copy of the package."""

import subprocess
import sys

import numpy as np
from pyspark import cloudpickle

from foreunc.functions.random import Draws
from foreunc.operators import propagate


def test_task_code_is_self_contained(tmp_path):
    draws = Draws(1)

    def task():
        return propagate.noise_block(draws, 0.25, np.arange(1, 4), 2)

    # The task itself stands for a function of the library, which is pickled by value.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    try:
        (tmp_path / "task.pkl").write_bytes(cloudpickle.dumps(task))
    finally:
        cloudpickle.unregister_pickle_by_value(sys.modules[__name__])
    code = "import pickle; print(pickle.load(open('task.pkl', 'rb'))().tolist())"
    out = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120
    )
    assert out.returncode == 0, out.stderr
    assert out.stdout.strip() == str(task().tolist())
