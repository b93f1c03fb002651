"""Operators for training-data pipelines. Nothing else in the library imports this subpackage."""

import os

#: The numpy models multiply small matrices in many tasks at once; threads within each would only get in the way.
os.environ.setdefault("OMP_NUM_THREADS", "1")
