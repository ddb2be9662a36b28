"""Operators of training-data pipelines.  Nothing outside this subpackage imports it."""

import os

# Models are trained on small matrices, for which threads of the BLAS library only get in each other's way.
os.environ.setdefault("OMP_NUM_THREADS", "1")
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
