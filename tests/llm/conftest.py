import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from conftest_llm import awkward, awkward_rows, clashing, empty  # noqa: E402, F401
