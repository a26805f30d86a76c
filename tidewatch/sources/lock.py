"""One run at a time on this machine."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path


@contextmanager
def run_lock(path: str, stale_seconds: float = 3600) -> Iterator[Path]:
    """Hold a lock file. A second holder gets a RuntimeError, unless the file is older than `stale_seconds`; then it is taken over."""
    file = Path(path)
    held = json.dumps({"pid": os.getpid(), "started": time.time()})
    for last in (False, True):
        try:
            with file.open("x") as f:
                f.write(held)
            break
        except FileExistsError:
            if last or file.exists() and time.time() - file.stat().st_mtime <= stale_seconds:
                raise RuntimeError(f"another run holds {file}") from None
            file.unlink(missing_ok=True)
    try:
        yield file
    finally:
        file.unlink(missing_ok=True)
