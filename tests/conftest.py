import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from maillake.session import local_session
    s = local_session(4, shuffle_partitions=8, app="maillake-tests")
    yield s
    s.stop()


@pytest.fixture()
def mbox_file(tmp_path):
    from tests.mailfixtures import write_four_message_mbox
    return write_four_message_mbox(tmp_path / "list.mbox")
