"""Functions that run in Python workers must not need the package on the executors."""

import subprocess
import sys

import pytest
from pyspark import cloudpickle

from sievewright.operators import splits
from sievewright.sources import files
from sievewright.streaming import collect

LOAD = "import sys; from pyspark import cloudpickle; cloudpickle.loads(sys.stdin.buffer.read()); assert 'sievewright' not in sys.modules"


@pytest.mark.parametrize("function", [splits._fold_classes([0.7, 0.3], False),
                                      collect._quota(3, ["id"], None), files._probe_batch])
def test_worker_functions_travel_by_value(function, tmp_path):
    subprocess.run([sys.executable, "-c", LOAD], input=cloudpickle.dumps(function), cwd=tmp_path, check=True, timeout=60)
