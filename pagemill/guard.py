"""Calls that may hang, crash or fail, in a process of their own with a deadline for each call."""

from __future__ import annotations

import multiprocessing
from collections.abc import Callable


class Guarded:
    """Calls what make() returns, made once in a process beside the task, and gives each call so many seconds.

    A call that takes longer, or kills its process, costs its own row an error; the process is ended and the next
    call gets a new one, so a hung engine never holds up a stage. Use as a context: the process ends with it.
    """

    def __init__(self, make: Callable[[], Callable], seconds: float):
        self.make, self.seconds = make, seconds
        self.process = self.pipe = None

    def __enter__(self) -> Guarded:
        return self

    def __exit__(self, *_) -> None:
        self.end()

    def __call__(self, *arguments) -> tuple[object, str | None]:
        """(value, None), or (None, what went wrong)."""
        if self.process is None:
            self.begin()
        try:
            self.pipe.send(arguments)
            if not self.pipe.poll(self.seconds):
                self.end()
                return None, f"TimeoutError: no answer within {self.seconds:g} seconds"
            return self.pipe.recv()
        except (EOFError, OSError) as error:
            self.end()
            return None, f"ProcessLookupError: the process ended ({type(error).__name__})"

    def begin(self) -> None:
        context = multiprocessing.get_context("fork")  # what make() holds need not be pickled again
        self.pipe, theirs = context.Pipe()
        self.process = context.Process(target=_serve, args=(theirs, self.pipe, self.make), daemon=True)
        self.process.start()
        theirs.close()

    def end(self) -> None:
        if self.process is not None:
            self.process.kill()
            self.process.join()
            self.pipe.close()
            self.process = self.pipe = None


def _serve(pipe, other, make: Callable[[], Callable]) -> None:
    other.close()
    called, failed = None, None
    try:
        called = make()
    except Exception as error:  # noqa: BLE001  each call reports it
        failed = f"{type(error).__name__}: {error}"
    while True:
        try:
            arguments = pipe.recv()
        except EOFError:
            return
        try:
            pipe.send((None, failed) if failed else (called(*arguments), None))
        except Exception as error:  # noqa: BLE001  a row that fails must not stop the others
            pipe.send((None, f"{type(error).__name__}: {error}"))
