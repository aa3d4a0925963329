"""Makes the package importable from the tests, wherever they are started."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
