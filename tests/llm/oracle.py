"""Run queries of the llm subpackage next to their SQL twins: ``SF_DIR=... python tests/llm/oracle.py [names]``."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from judgealign.llm import catalog as llm  # noqa: E402
from judgealign.plans import catalog  # noqa: E402
from tests import oracle  # noqa: E402

if __name__ == "__main__":
    catalog.QUERIES, catalog.ORACLES = llm.QUERIES, llm.ORACLES
    sys.exit(oracle.main())
