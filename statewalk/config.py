"""Default analysis parameters and execution limits."""

from __future__ import annotations

import os

# The defaults of the analysis.
K_VALUES = tuple(range(2, 11))
STARTS_MODEL_SELECTION = 10
STARTS_SELECTED_K = 50
MAX_ITERATIONS = 800
DURATION_CAP = 200
MASTER_SEED = 20260710
OCCUPANCY_PERMUTATIONS = 5000
OCCUPANCY_SEED = 20260711
SOJOURN_PERMUTATIONS = 5000
SOJOURN_SEED = 20260712
SOJOURN_ALPHA = 1e-3
TRANSITION_PERMUTATIONS = 5000
TRANSITION_SEED = 20260713
BOOTSTRAPS = 2000
BOOTSTRAP_SEED = 20260714
LARGE_DIFFERENCE = 0.075
FDR_LEVEL = 0.05
LOUVAIN_REPETITIONS = 150
CONSENSUS_THRESHOLD = 0.50
COMMUNITY_SEED = 20260715
EDGE_PROPORTIONS = (0.15, 0.20, 0.25)
LAYOUT_SEED = 20260716
REFERENCE_GROUP = "TD"
TARGET_GROUP = "Dyslexia"

# Execution limits. They decide how work is cut up, never what is computed.
HOT_ROWS = 1 << 22        # a key with more rows is cut into blocks before it is ordered
SLICE_ROWS = 1 << 20      # timepoints of one subject handled by one window partition
CHUNK_ROWS = 4096         # timepoints of one subject handled by one HSMM kernel call
QUANTILE_VALUES = 1 << 20  # distinct values per group up to which one aggregate buffer is used


def project_root(root: str | None = None) -> str:
    """Explicit argument, then the HSMM_PROJECT_ROOT variable, then the working directory."""
    return root or os.environ.get("HSMM_PROJECT_ROOT") or "."
