"""Leases: one holder at a time, by numbered files that only one can create.

A holder's number is higher than that of all before it. One that stops renewing, by a crash or
a long pause, is passed over when its time is up; it learns of that at its next renewal.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from logharrow.sources import files

SECONDS = 600.0


class Busy(Exception):
    """Somebody else holds the lease."""


def _holder(spark: SparkSession, folder: str) -> tuple[int, dict]:
    """The highest number taken so far, and what its file says; 0 before the first."""
    numbers = sorted(int(n) for n in files.list_files(spark, folder) if n.isdigit())
    if not numbers:
        return 0, {}
    text = files.read_text(spark, f"{folder}/{numbers[-1]:012d}")
    try:
        return numbers[-1], json.loads(text or "")
    except json.JSONDecodeError:  # just being written
        return numbers[-1], {"until": time.time() + SECONDS}


@contextmanager
def held(spark: SparkSession, root: str, name: str, seconds: float = SECONDS) -> Iterator[int]:
    """Hold a lease while the block runs, renewed in the background; its fencing number."""
    folder = f"{root.rstrip('/')}/_leases/{name}"
    last, told = _holder(spark, folder)
    if told.get("until", 0.0) > time.time():
        raise Busy(f"{name} of {root} is at work")
    number = last + 1
    path = f"{folder}/{number:012d}"
    if not files.create_new(spark, path, json.dumps({"until": time.time() + seconds})):
        raise Busy(f"{name} of {root} was just taken")
    done = threading.Event()

    def renew() -> None:
        while not done.wait(seconds / 3):
            if _holder(spark, folder)[0] != number:
                return  # passed over
            files.write_text(spark, path, json.dumps({"until": time.time() + seconds}))

    keeper = threading.Thread(target=renew, daemon=True)
    keeper.start()
    try:
        yield number
    finally:
        done.set()
        keeper.join()
        if _holder(spark, folder)[0] == number:
            files.write_text(spark, path, json.dumps({"until": 0.0}))
        for old in [n for n in files.list_files(spark, folder) if n.isdigit() and int(n) < number]:
            files.remove(spark, f"{folder}/{old}")


def still_holds(spark: SparkSession, root: str, name: str, number: int) -> bool:
    """Whether nobody has taken the lease over since."""
    return _holder(spark, f"{root.rstrip('/')}/_leases/{name}")[0] == number
