"""Executors need no copy of the package: what they run travels by value."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
CODE = """
import sys
sys.path.insert(0, {root!r})
from tessera.plans import catalog
from tessera.session import local_session
spark = local_session(2, 2, "2g")
for name in {names!r}:
    assert catalog.QUERIES[name](spark, {data!r}).count() > 0, name
"""


def test_python_on_executors_travels_by_value(sf_dir, tmp_path):
    names = ["epsilon_edges", "prototype_top1_match", "rerank_mode_counts", "robust_centroid_similarity", "intra_label_distance_stats", "move_plan_collisions", "prototype_fold", "stabilize_track"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = CODE.format(root=str(ROOT), names=names, data=sf_dir)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=600)
