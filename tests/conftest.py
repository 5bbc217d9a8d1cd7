from __future__ import annotations

import os
import sys
import uuid

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerline.session import build_session  # noqa: E402

ZERO_AMOUNT = "000000000000"


def make_line(entity="00001", date="202601", idtype="11", ident="20345123458",
              activity="001", situation="01", loans="0000001500,5", unused=ZERO_AMOUNT,
              guarantees="00000000500,", other="00000000100,", rest=None,
              flags="000000", days="0000") -> str:
    """One 171-character registry line (text; encode as Latin-1 to write)."""
    rest = rest or [ZERO_AMOUNT] * 7
    line = (entity + date + idtype + ident.ljust(11) + activity + situation + loans + unused
            + guarantees + other + "".join(rest) + flags + days)
    assert len(line) == 171, len(line)
    return line


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", shuffle_partitions=4, app_name="ledgerline-tests")
    yield s
    s.stop()


@pytest.fixture()
def write_file(tmp_path):
    """Write lines (str → Latin-1, bytes as they are) to a fresh file; returns its path."""
    def _write(lines, name=None, terminator=b"\n"):
        d = tmp_path / f"in-{uuid.uuid4().hex[:8]}"
        d.mkdir()
        p = d / (name or "debtors.txt")
        data = b"".join((ln if isinstance(ln, bytes) else ln.encode("latin-1")) + terminator
                        for ln in lines)
        p.write_bytes(data)
        return str(p)
    return _write


@pytest.fixture()
def workspace(spark, tmp_path):
    from ledgerline.plans.import_job import Workspace
    return Workspace(str(tmp_path / f"ws-{uuid.uuid4().hex[:8]}"))
