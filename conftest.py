"""Makes the package importable in tests, here and in the Python workers."""

import os
import sys
from pathlib import Path

root = str(Path(__file__).resolve().parent)
sys.path.insert(0, root)
os.environ["PYTHONPATH"] = os.pathsep.join([root, *filter(None, [os.environ.get("PYTHONPATH")])])
