"""Extraction in a child process that may be lost.

Parsers of untrusted files can loop in C code, where no alarm reaches them, eat memory, or bring their process down. So each task has one child: it
has a limit of address space, gets one file at a time, and is killed and started anew when a file takes too long or it goes. The file gets a row with its
error; the task and the other files go on. While it works the child sends heartbeats, so the error tells a parser that only took too long from one that no
longer answered.
"""

from __future__ import annotations

import contextlib
import importlib
import os
import pickle
import select
import struct
import subprocess
import sys
import threading
import time

from .limits import Limits

#: Bytes of address space of a child, and seconds between its heartbeats.
MEMORY, BEAT = 4 << 30, 0.5
PARSER = "mailquarry.extract.dispatch:extract"


class Supervisor:
    """Runs a parser (module:function of name, data, limits, seconds, to status, text, error) in a child of its own."""

    def __init__(self, limits: Limits | None = None, seconds: float = 60.0, memory: int = MEMORY, parser: str = PARSER):
        self.limits, self.seconds, self.memory, self.parser = limits or Limits(), seconds, memory, parser
        self.child: subprocess.Popen | None = None
        self.restarts = -1

    def __enter__(self) -> Supervisor:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        if self.child:
            self.child.kill()
            self.child.wait()
            for pipe in (self.child.stdin, self.child.stdout):
                with contextlib.suppress(OSError):
                    pipe.close()
            self.child = None

    def _start(self) -> subprocess.Popen:
        env = os.environ | {"PYTHONPATH": os.pathsep.join(p for p in sys.path if p)}
        self.restarts += 1
        self.child = subprocess.Popen([sys.executable, "-m", "mailquarry.extract.supervised", str(self.memory), self.parser], stdin=subprocess.PIPE, stdout=subprocess.PIPE, env=env, bufsize=0)
        kind, _ = self._frame(time.monotonic() + 60)  # it says when it is ready
        if kind != b"R":
            self.close()
            raise RuntimeError("the child of the extraction doesn't start")
        return self.child

    def _read(self, n: int, until: float) -> bytes | None:
        """n bytes of the child's answers; nothing at its end or when the time is over."""
        out, pipe = bytearray(), self.child.stdout
        while len(out) < n:
            ready, _, _ = select.select([pipe], [], [], max(0.0, until - time.monotonic()))
            part = os.read(pipe.fileno(), min(n - len(out), 1 << 20)) if ready else b""
            if not part:
                return None
            out += part
        return bytes(out)

    def _frame(self, until: float) -> tuple[bytes, bytes]:
        """Kind and content of an answer; no kind at the end or when the time is over."""
        head = self._read(9, until)
        if head is None:
            return b"", b""
        kind, size = struct.unpack("<cQ", head)
        body = self._read(size, until)
        return (kind, body) if body is not None else (b"", b"")

    def extract(self, name: str | None, data: bytes | None) -> tuple[str, str | None, str | None]:
        """Status, text and error of a file, whatever it does to its parser."""
        child = self.child if self.child and self.child.poll() is None else self._start()
        sent = pickle.dumps((name, data, self.limits, self.seconds))
        began = beat = time.monotonic()
        # what the parser itself stops in time comes back as its own error
        until = began + self.seconds + 2
        with contextlib.suppress(BrokenPipeError):
            child.stdin.write(struct.pack("<Q", len(sent)))
            for at in range(0, len(sent), 1 << 20):
                child.stdin.write(sent[at : at + (1 << 20)])
        while True:
            kind, body = self._frame(until)
            if kind == b"A":
                return pickle.loads(body)
            if kind == b"H":
                beat = time.monotonic()
                continue
            late = time.monotonic() >= until
            code = None if late else child.wait()
            answered = time.monotonic() - beat < 4 * BEAT
            self.close()
            if late:
                return "error", None, f"TimeoutError: stopped after {self.seconds:g} s" + ("" if answered else ", it no longer answered")
            return "error", None, f"the parser's process ended with {code}"


def main(memory: int, parser: str) -> None:
    with contextlib.suppress(ImportError):
        import resource

        resource.setrlimit(resource.RLIMIT_AS, (memory, memory))
        resource.setrlimit(resource.RLIMIT_CORE, (0, 0))
    source, target = sys.stdin.buffer, os.dup(1)
    os.dup2(2, 1)  # what a parser prints is no answer
    own = threading.Lock()
    busy = threading.Event()

    def say(kind: bytes, body: bytes = b"") -> None:
        with own:
            rest = memoryview(struct.pack("<cQ", kind, len(body)) + body)
            while rest:
                rest = rest[os.write(target, rest) :]

    def beats() -> None:
        while True:
            busy.wait()
            time.sleep(BEAT)
            if busy.is_set():
                say(b"H")

    module, function = parser.split(":")
    parse = getattr(importlib.import_module(module), function)
    threading.Thread(target=beats, daemon=True).start()
    say(b"R")
    while head := source.read(8):
        name, data, limits, seconds = pickle.loads(source.read(struct.unpack("<Q", head)[0]))
        busy.set()
        try:
            answer = parse(name, data, limits, seconds)
        except MemoryError:
            answer = "error", None, "MemoryError: beyond the limit of the extraction"
        busy.clear()
        say(b"A", pickle.dumps(answer))


if __name__ == "__main__":
    main(int(sys.argv[1]), sys.argv[2])
