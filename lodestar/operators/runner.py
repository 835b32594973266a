"""Runs planned commands, if asked to. Without a runner a plan stays a plan."""

from __future__ import annotations

import shlex
import subprocess

from pyspark.sql import DataFrame


def run_commands(planned: DataFrame, slices: int = 10, column: str = "command", dry: bool = True) -> DataFrame:
    """(command, code) of each planned command. ``dry`` gives null codes and starts nothing; otherwise each task runs its
    share of commands, one after another, without a shell: words are as shlex has them. A command that cannot be started
    has the code 127. Retried tasks run theirs again."""

    def start(command: str) -> int:
        try:
            return subprocess.run(shlex.split(command), check=False).returncode
        except OSError:
            return 127

    def go(batches):
        for b in batches:
            codes = [None if dry else start(c) for c in b["command"]]
            yield b.assign(code=codes).astype({"code": "Int32"})

    return planned.selectExpr(f"{column} as command").repartition(slices).mapInPandas(go, "command string, code int")
