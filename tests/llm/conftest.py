import sys
import uuid
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture()
def folder(tmp_path):
    return f"file://{tmp_path}/{uuid.uuid4().hex}"
