"""Model calls that are journaled: a task that is tried again asks only what no try before it has been told.

Answers are appended to files in a folder that all tasks share, a file for each batch of requests. Requests come to a task in
the order of their keys, so a file holds a range of keys and is named after it; a task lists the files of a prefix of keys when
it comes to that prefix, and holds the answers of those files only that reach around the present key.
"""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any, NamedTuple

from pyarrow import fs as arrow_fs

#: Characters of a key that name the folder of its file.
PREFIX = 2
BUSY = ("rate limit", "429")
#: Batches' worth of requests that are read ahead while their answers are known.
AHEAD = 64


class Calls(NamedTuple):
    """How a task calls a model: ``in_flight`` calls at once, ``batch`` answers to a journal's file, and up to ``tries`` tries of
    a call that the model turns away as too many, ``pause`` seconds apart at first and twice as far each time."""

    in_flight: int = 1
    batch: int = 16
    tries: int = 5
    pause: float = 1.0


class Journal(NamedTuple):
    """``folder`` is shared by all tasks. Faults count for the run that met them only; ``model`` names whose answers these are."""

    folder: str
    model: str = ""
    run: str = ""

    def begun(self) -> Journal:
        """This journal for a new run, whose tasks share each other's faults too."""
        return self._replace(run=uuid.uuid4().hex)


class Reader:
    """A task's view of a journal, for keys that ascend."""

    def __init__(self, journal: Journal):
        self.journal = journal
        self.fs, self.path = arrow_fs.FileSystem.from_uri(journal.folder)
        self.prefix, self.files, self.answers = None, [], {}

    def _list(self, prefix: str) -> list[tuple[str, str, str]]:
        found = self.fs.get_file_info(arrow_fs.FileSelector(f"{self.path}/{prefix}", allow_not_found=True))
        # A name is the first key, the last one and an id; a draft has another ending.
        return sorted(tuple(x.base_name.removesuffix(".jsonl").split("~")[:2]) + (x.path,) for x in found if x.base_name.endswith(".jsonl"))

    def get(self, key: str, signature: str) -> Any:
        """The answer that was given to this request; none if it wasn't answered."""
        if key[:PREFIX] != self.prefix:
            self.prefix = key[:PREFIX]
            self.files, self.answers = self._list(self.prefix), {}
        while self.files and self.files[0][0] <= key:
            _, last, path = self.files.pop(0)
            if last >= key:
                self.answers = {k: v for k, v in self.answers.items() if k[0] >= key} | self._load(path)
        return self.answers.get((key, signature))

    def _load(self, path: str) -> dict:
        with self.fs.open_input_stream(path) as f:
            rows = [json.loads(x) for x in f.read().decode().splitlines()]
        return {(r["key"], r["signature"]): r["answer"] for r in rows if not r["failed"] or r["run"] == self.journal.run}

    def append(self, entries: list[tuple[str, str, Any, bool]]) -> None:
        """Write answers (key, signature, answer, whether it is a fault) down; a file for each prefix of their keys."""
        by_prefix: dict[str, list] = {}
        for e in sorted(entries, key=lambda e: e[:2]):
            by_prefix.setdefault(e[0][:PREFIX], []).append(e)
        for prefix, own in by_prefix.items():
            self.fs.create_dir(f"{self.path}/{prefix}")
            name = f"{self.path}/{prefix}/{own[0][0]}~{own[-1][0]}~{uuid.uuid4().hex}"
            with self.fs.open_output_stream(f"{name}.draft") as f:
                f.write("".join(json.dumps({"key": k, "signature": s, "answer": a, "failed": bad, "run": self.journal.run}, ensure_ascii=False) + "\n" for k, s, a, bad in own).encode())
            self.fs.move(f"{name}.draft", f"{name}.jsonl")


def patient(call: Callable[[], Any], calls: Calls) -> Any:
    """The result of ``call``, asked again after a pause while the model turns calls away as too many."""
    for k in range(calls.tries):
        try:
            return call()
        except Exception as e:
            if k + 1 >= calls.tries or not any(x in str(e).lower() for x in BUSY):
                raise
            time.sleep(calls.pause * 2**k * random.uniform(0.75, 1.25))
    raise AssertionError("unreachable")


def answered(rows: Iterator[tuple[str, str, Any]], ask: Callable[[Any], tuple[Any, bool]], calls: Calls, journal: Journal | None) -> Iterator[Any]:
    """An answer for each of ``rows`` (key, signature, request), in order; keys ascend where there is a journal.

    ``ask`` gives an answer and whether it is a fault. Rows of one signature that come together are asked for once.
    """
    reader = Reader(journal) if journal else None
    with ThreadPoolExecutor(max_workers=calls.in_flight) as pool:
        done, known = False, {}
        while not done:
            # Requests that are alike follow each other, maybe into the next batch.
            batch, known, fresh = [], dict([known.popitem()]) if known else {}, {}
            while len(fresh) < calls.batch and len(batch) < AHEAD * calls.batch:
                row = next(rows, None)
                if row is None:
                    done = True
                    break
                key, signature, request = row
                batch.append((key, signature))
                if (key, signature) in known or (key, signature) in fresh:
                    continue
                found = reader.get(key, signature) if reader else None
                if found is None:
                    fresh[key, signature] = request
                else:
                    known[key, signature] = found
            if fresh:
                told = dict(zip(fresh, pool.map(ask, fresh.values()), strict=True))
                if reader:
                    reader.append([(k, s, a, bad) for (k, s), (a, bad) in told.items()])
                known |= {k: a for k, (a, _) in told.items()}
            for x in batch:
                yield known[x]
            if batch:
                known[batch[-1]] = known.pop(batch[-1])
